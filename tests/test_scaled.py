"""Upserts of a stream, greedy acceptance, ids, ranked lists, captions and similarity joins against plain versions, and their
queries against SQL."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectio.functions import phrases
from lectio.functions.files import Files
from lectio.operators import acceptance, deck, planning, quiz, simjoin
from lectio.plans import registry, scaled
from lectio.sources.documents import captions
from lectio.streaming import upserts

SF = "/root/testdata/sf0.001"
TABLES = "documents pages events benchmark conversations labels".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [*scaled.ORACLES])
def test_query_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{SF}/{t}.parquet') else ''}'")
    a, b = registry.QUERIES[name](spark, SF).toPandas(), c.sql(registry.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    shown = lambda d: d[cols].astype(object).where(d[cols].notna(), None).map(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(shown(a), shown(b))


# --- upserts -------------------------------------------------------------------------------------------------------

KEYED = "model string, at int, v double"


def put(spark, path, *batches, first=0, buckets=8):
    table = upserts.BucketTable(spark, path, ["model"], ["at"], buckets)
    for k, rows in enumerate(batches, first):
        table.upsert(spark.createDataFrame(rows, KEYED), k)
    return table


def shown(table):
    return sorted(((r.model, r.at, r.v) for r in table.read().collect()), key=str)


def files(spark, table):
    """The files of each bucket as the newest manifest names them."""
    return {b: [n for n in Files(spark).names(f"{table.path}/{f}") if n.endswith(".parquet")] for b, f in table.manifest()["buckets"].items()}


def test_stream_upsert(spark, tmp_path):
    for rows in [[("a", 1, 1.0), ("b", 2, 2.0)], [("a", 3, 3.0), ("c", 4, 4.0)]]:
        spark.createDataFrame(rows, KEYED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(KEYED).parquet(str(tmp_path / "in"))
        upserts.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["model"], ["at"]).awaitTermination()
    assert shown(upserts.BucketTable(spark, str(tmp_path / "out"), ["model"], ["at"])) == [("a", 3, 3.0), ("b", 2, 2.0), ("c", 4, 4.0)]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = put(spark, str(tmp_path), [(f"m{k}", 1, float(k)) for k in range(40)])
    before = files(spark, table)
    put(spark, str(tmp_path), [("m7", 2, 70.0)], first=1)
    after = files(spark, table)
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) > 4
    assert shown(table) == sorted([(f"m{k}", 1, float(k)) for k in range(40) if k != 7] + [("m7", 2, 70.0)])


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    table = put(spark, str(tmp_path), [("a", 1, 1.0)], [("a", 2, 2.0), ("b", 1, 1.0)])
    now = table.manifest()
    put(spark, str(tmp_path), [("a", 9, 9.0)], first=1)  # its number is done
    put(spark, str(tmp_path), [("a", 9, 9.0)], first=0)
    assert table.manifest() == now and shown(table) == [("a", 2, 2.0), ("b", 1, 1.0)]


def test_a_batch_that_fails_before_its_manifest_runs_again(spark, tmp_path, monkeypatch):
    table = put(spark, str(tmp_path), [("a", 1, 1.0)])
    with monkeypatch.context() as m:
        m.setattr(Files, "write_once", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            put(spark, str(tmp_path), [("a", 2, 2.0), ("b", 1, 5.0)], first=1)
    assert shown(table) == [("a", 1, 1.0)]
    put(spark, str(tmp_path), [("a", 2, 2.0), ("b", 1, 5.0)], first=1)
    assert shown(table) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_late_rows_null_keys_new_columns_and_old_versions(spark, tmp_path):
    table = put(spark, str(tmp_path), [("a", 5, 5.0), (None, 1, 1.0)], [("a", 3, 3.0), (None, 2, 2.0)], [], [("c", 1, 1.0)], [("d", 1, 1.0)])
    assert shown(table) == sorted([("a", 5, 5.0), (None, 2, 2.0), ("c", 1, 1.0), ("d", 1, 1.0)], key=str)
    assert len([n for n in Files(spark).names(f"{tmp_path}/manifest") if n.endswith(".json")]) == upserts.KEPT
    named = {f.split("/")[1] for n in Files(spark).names(f"{tmp_path}/manifest") for f in __import__("json").loads(Files(spark).read(f"{tmp_path}/manifest/{n}"))["buckets"].values()}
    assert set(Files(spark).names(f"{tmp_path}/data")) == named
    table.upsert(spark.createDataFrame([("a", 6, 6.0, "x")], KEYED + ", note string"), 9)
    assert {r.model: r.note for r in table.read().collect()} == {"a": "x", None: None, "c": None, "d": None}


def test_any_cut_of_the_stream_gives_the_same_table(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"m{rnd.randrange(12)}", k, float(k)) for k in range(80)]
    rnd.shuffle(rows)
    want = {}
    for m, at, v in rows:
        want[m] = max(want.get(m, (-1, 0)), (at, v))
    for n in (1, 3):
        table = put(spark, str(tmp_path / str(n)), *(rows[k::n] for k in range(n)), buckets=3)
        assert shown(table) == sorted((m, *x) for m, x in want.items())


# --- acceptance ----------------------------------------------------------------------------------------------------


def share(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def greedy(rows, least):
    stay = []
    for g, at, t in sorted(rows, key=lambda r: (r[0], r[1])):
        if not any(x == g and share(set(t), set(u)) >= least for x, _, u in stay):
            stay.append((g, at, t))
    return sorted((g, at) for g, at, _ in stay)


def token_rows(seed):
    """Near copies, chains in which every second one stays, equal sets, empty ones, and what shares little."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for g in ("x", "y"):
        base = rnd.sample(words, 12)
        sets = [sorted(set(base[: rnd.randrange(9, 13)] + rnd.sample(words, rnd.randrange(0, 3)))) for _ in range(25)]
        sets += [[f"c{j}" for j in range(k, k + 10)] for k in range(0, 40)] + [[], []] + sets[:4]
        sets += [rnd.sample(words, rnd.randrange(1, 8)) for _ in range(20)]
        rnd.shuffle(sets)
        rows += [(g, k, s) for k, s in enumerate(sets)]
    return rows


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_acceptance_against_the_loop(spark, rounds):
    rows = token_rows(rounds)
    df = spark.createDataFrame(rows, "g string, at int, tokens array<string>").repartition(3)
    got = acceptance.accepted(df, ["g"], ["at"], F.col("tokens"), 0.72, rounds)
    assert got.columns == ["g", "at", "tokens"]
    assert sorted((r.g, r["at"]) for r in got.collect()) == greedy(rows, 0.72)


def test_acceptance_of_nothing_and_of_repeated_rows(spark):
    schema = "g string, at int, tokens array<string>"
    assert acceptance.accepted(spark.createDataFrame([], schema), ["g"], ["at"], F.col("tokens"), 0.7).count() == 0
    rows = [("x", 1, ["a", "b"])] * 2 + [(None, 1, ["a", "b"]), ("x", 2, ["b", "a"])]
    assert sorted(map(str, acceptance.accepted(spark.createDataFrame(rows, schema), ["g"], ["at"], F.col("tokens"), 0.7).select("g", "at").collect())) == ["Row(g='x', at=1)"] * 2 + ["Row(g=None, at=1)"]


def test_independent_set_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(9)] + [(20, k) for k in range(21, 40)] + [(21, 22)]
    gone = {r.id for r in acceptance.independent(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert gone == {1, 3, 5, 7, 9, *range(21, 40)}


def test_decks_against_the_loop(spark):
    rnd = random.Random(4)
    words = [f"palabra{k}" for k in range(30)]
    rows = [(d, s, b, " ".join(rnd.sample(words[: 8 + 4 * d], 6)) + ".") for d in range(3) for s in range(8) for b in range(3)]
    want = []
    for d in range(3):
        bullets = greedy([(d, (s, b), [w for w in t[:-1].split()]) for x, s, b, t in rows if x == d], 0.72)
        stay = {at for _, at in bullets}
        slides = {s: [w for x, s2, b, t in rows if x == d and s2 == s and (s, b) in stay for w in t[:-1].split()] for s in range(8)}
        shown_slides = {s for _, s in greedy([(d, s, w) for s, w in slides.items() if w], 0.78)}
        for s in sorted(shown_slides):
            want += [(d, s, k, t) for k, t in enumerate([t for x, s2, b, t in rows if x == d and s2 == s and (s, b) in stay], 1)]
    df = spark.createDataFrame(rows, "doc_id long, slide_index int, bullet_index int, bullet string").repartition(2)
    assert sorted(tuple(r) for r in deck.unrepeated(df).collect()) == want


def test_similar_pairs_against_all_pairs(spark):
    rows = [(i, t) for i, (_, _, t) in enumerate(token_rows(9))]
    want = sorted((a, b, round(share(set(s), set(t)), 9)) for a, s in rows for b, t in rows if a < b and share(set(s), set(t)) >= 0.7)
    got = simjoin.similar_pairs(spark.createDataFrame(rows, "id long, tokens array<string>").repartition(3), 0.7).collect()
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in got) == want


# --- ids, lists, captions ------------------------------------------------------------------------------------------


def test_ids_by_three_steps(spark):
    ids = ["def:rotor", "def:rotor_del_eje", "def:rotor_a", "DEF:Góndola", "ex:parque_eólico", "def:a__b", "def:-x-"]
    asked = [(1, a) for a in ["def:rotor", "def:ROTOR", "def:rotor_del", "DEF:gondola", "ex:parque", "ex:rotor", "def:a", "def:", "def:x", "def:roto", None, "nada", "def:rotor"]] + [(2, "def:rotor")]
    df = spark.createDataFrame(asked, "doc_id long, ref string")
    found = planning.resolved(df, spark.createDataFrame([(1, i) for i in ids], "doc_id long, atom_id string"), "ref")
    got = {(r.doc_id, r.ref): r.atom_id for r in found.collect()}
    assert found.count() == len(asked)
    assert got == {
        (1, "def:rotor"): "def:rotor", (1, "def:ROTOR"): "def:rotor", (1, "def:rotor_del"): "def:rotor_del_eje", (1, "DEF:gondola"): "DEF:Góndola", (1, "ex:parque"): "ex:parque_eólico",
        (1, "ex:rotor"): None, (1, "def:a"): "def:a__b", (1, "def:"): None, (1, "def:x"): "def:-x-", (1, "def:roto"): None, (1, None): None, (1, "nada"): None, (2, "def:rotor"): None,
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan and all("=" in line for line in plan.split("\n") if "Join " in line)


def test_related_against_all_pairs(spark):
    rnd = random.Random(6)
    rows = [("d", rnd.choice(["def", "ex", "rel", "dt"]), k, f"a{k:03}", rnd.choice(["s", "t", "u", "v", None, ""]) if k < 70 else f"own{k}") for k in range(80)] + [("e", "def", 1, "z", "s")]
    want = []
    for d, kind, _, a, sub in rows:
        others = [(-(2 * (sub is not None and sub != "" and sub == o_sub) + (o_kind in ("ex", "rel"))), o) for d2, o_kind, _, o, o_sub in rows if d2 == d and o != a]
        want += [(d, a, n, o, -s) for n, (s, o) in enumerate(sorted(others)[:8], 1)]
    df = spark.createDataFrame(rows, "doc_id string, kind string, pos int, atom_id string, subtopic string").repartition(3)
    assert sorted(tuple(r) for r in quiz.related(df).collect()) == sorted(want)


def test_captions_against_all_pairs(spark):
    rnd = random.Random(8)
    blocks = [(d, p, b, y := rnd.randrange(40), y + rnd.randrange(1, 4), rnd.choice(["", " ", "short", f"a caption  number {b}"])) for d in (1, 2) for p in (1, 2) for b in range(9)]
    images = [(d, p, i, rnd.choice([0.01, 0.5]), y := rnd.randrange(40), y + rnd.randrange(1, 9)) for d in (1, 2, 3) for p in (1, 2) for i in range(6)]
    want = []
    for d, p, i, s, y0, y1 in images:
        near = [(min(abs(b0 - y1), abs(b1 - y0)), b, " ".join(t.split())) for d2, p2, b, b0, b1, t in blocks if (d2, p2) == (d, p) and t.strip()]
        if s >= 0.02 and near and 10 <= len(min(near)[2]) <= 300:
            want.append((d, p, i, min(near)[2]))
    a = spark.createDataFrame(images, "doc_id long, page int, image int, share double, y0 int, y1 int")
    b = spark.createDataFrame(blocks, "doc_id long, page int, block int, y0 int, y1 int, text string")
    assert sorted(tuple(r) for r in captions(a, b).collect()) == want


@pytest.mark.parametrize("most", [0, phrases.MOST])
def test_passages_in_texts(spark, monkeypatch, most):
    """By the index in the plan, and by a join where it would be too large."""
    monkeypatch.setattr(phrases, "MOST", most)
    rnd = random.Random(3)
    words = ["uno", "dos", "tres", "cuatro", "Cinco", "séis"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(0, 40))) for _ in range(60)] + [None, "", "uno", "UNO,  dos!"]
    passages = [" ".join(rnd.choices(words, k=rnd.randrange(1, 8))) for _ in range(25)] + ["", None, "uno", "nada de esto está", "uno"]
    bare = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower().replace("é", "e").replace("á", "a")).split())
    want = sorted((i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if bare(p) and f" {bare(p)} " in f" {bare(t)} ")
    got = simjoin.containing(spark.createDataFrame(list(enumerate(passages)), "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(map(tuple, got.select("item_id", "doc_id").collect())) == want and len(want) > 20
    none = spark.createDataFrame([], "item_id long, text string")
    assert simjoin.containing(none, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0
