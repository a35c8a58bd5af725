"""Cases that a review found: queries against their SQL on documents that show the difference."""

import random

import duckdb
from pyspark.sql import functions as F

from lectio.functions import tables
from lectio.functions.text import one_space, one_space_of
from lectio.operators import acceptance, deck, package, simjoin
from lectio.plans import registry

FOUR = "**Rotor**: parte que gira con el viento.\n**Torre**: cuerpo que sostiene el eje.\n**Pala**: hoja que recibe el aire.\n**Freno**: pieza que para el giro."
BANNED = "**Mezcla**: une agua y caliza en un cubo."  # its option has the letters of "a y c"


def both(spark, tmp_path, name, texts, columns="doc_id long, text string"):
    """The sorted rows of a query and of its SQL over these documents."""
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(tmp_path))
    c.execute(f"CREATE TABLE found AS {registry.ORACLES[name]}")
    return sorted(map(tuple, df.collect()), key=str), sorted(c.execute(f"SELECT {', '.join(df.columns)} FROM found").fetchall(), key=str)


def test_a_plan_is_cut_by_its_own_numbers(spark, tmp_path):
    """Of four atoms' seven questions the fifth and sixth repeat; the seventh does not move up."""
    got, want = both(spark, tmp_path, "quiz_plan_sanitized", [FOUR, BANNED, None])
    assert got == want and [r[1] for r in got if r[0] == 0] == [1, 2, 3, 4]


def test_a_document_whose_questions_are_all_dropped_is_topped_up(spark, tmp_path):
    got, want = both(spark, tmp_path, "study_record", [FOUR, BANNED, "nada"])
    assert got == want and got[1] == (1, "ok", None, 1)
    quiz = package.study(spark.createDataFrame([(1, BANNED)], "doc_id long, text string")).quiz.collect()
    assert [(q["question_id"], q["concept_id"], q["correct"]) for q in quiz] == [(1, "def:mezcla", "A")]


def test_similar_sets_in_blocks(spark, monkeypatch):
    """Blocks of any size and few buckets give all pairs; a set is compared with all sizes that can be like it, and a pair that shares
    too few keys is ruled out before its tokens are read."""
    r = random.Random(4)
    made = []
    for _ in range(60):
        own = r.sample(range(400), r.choice([1, 2, 5, 12, 40, 90]))
        made += [own] + [own[: max(1, round(len(own) * r.uniform(0.7, 1)))] + r.sample(range(400, 900), r.choice([0, 1, 2, 9])) for _ in range(3)]
    made = sorted({tuple(sorted(m)) for m in made})
    sets = simjoin.set_classes(spark.createDataFrame([(i, [f"t{x}" for x in m]) for i, m in enumerate(made)], "id long, tokens array<string>"))
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j): share(made[i], made[j]) for j in range(len(made)) for i in range(j) if share(made[i], made[j]) >= 0.7 - 1e-9}
    for size, few in ((2_000_000, 1 << 22), (150, 64)):
        monkeypatch.setattr(simjoin, "BLOCK_KEYS", size)
        monkeypatch.setattr(simjoin, "COUNT_BUCKETS", few)
        met = simjoin.met_by_keys(sets, 0.7).collect()
        assert len(met) == len(set(met)) and {(x.x, x.y) for x in met} >= set(want)
        assert len(met) < 20 * len(want)
        assert {(x.x, x.y): x.similarity for x in simjoin.distinct_pairs(sets, 0.7).collect()} == want


def test_rows_of_acceptance_leave_texts_behind(spark):
    """What tokens are taken from is not written with each row."""
    rows = spark.createDataFrame([("s", k, 0, 0, t) for k, t in enumerate(["la turbina gira con fuerza", "La turbina gira con fuerza.", "otra cosa distinta"])], "source string, doc_id long, slide_index int, bullet_index int, bullet string")
    found = deck.unrepeated_by_source(rows, drop=("bullet",))
    assert "bullet" not in found.columns and sorted(x.doc_id for x in found.collect()) == [0, 2]


def test_similar_sets_share_keys(spark, monkeypatch):
    """Of sets of any size, below and above what is found by two tokens at a time, each similar pair shares a key."""
    monkeypatch.setattr(simjoin, "LONG", 12)
    monkeypatch.setattr(simjoin, "PART_KEYS", 500)
    rng = random.Random(7)
    found = set()
    for k in range(60):
        base = rng.sample(range(150), rng.randint(1, 20))
        for _ in range(4):
            found.add(frozenset([x for x in base if rng.random() > 0.1] + rng.sample(range(150), rng.randint(0, 2))))
    tokens = {k: x for k, x in enumerate(sorted(map(sorted, found))) if x}
    rows = spark.createDataFrame([(k, [str(t) for t in x]) for k, x in tokens.items()], "id long, tokens array<string>")
    sets = rows.select("id", simjoin.token_ids(F.col("tokens")).alias("tokens"))
    for threshold in (0.4, 0.72, 0.9):
        keys: dict[int, set] = {}
        for r in simjoin.shared_keys(sets, threshold).collect():
            keys.setdefault(r.id, set()).add(r.token)
        alike = [(a, b) for a in tokens for b in tokens if a < b and len(set(tokens[a]) & set(tokens[b])) / len(set(tokens[a]) | set(tokens[b])) >= threshold]
        assert alike and all(keys.get(a, set()) & keys.get(b, set()) for a, b in alike)


def test_acceptance_leaves_out_what_shares_one_word(spark, monkeypatch):
    """Sets that have one rare token in common and no other are like nothing, and are not looked at again."""
    seen: dict[str, int] = {}

    def written(df, name, *more):
        out = tables.written(df, name, *more)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(acceptance, "written", written)
    rows = [("s", k, [f"r{k // 2}", *(f"{x}{k}" for x in "abcdefg")]) for k in range(400)] + [("s", 1000 + k, [*"abcdefgh", f"n{k}"]) for k in range(30)]
    got = acceptance.accepted(spark.createDataFrame(rows, "g string, at int, tokens array<string>"), ["g"], ["at"], F.col("tokens"), 0.72)
    assert sorted(r["at"] for r in got.collect()) == [*range(400), 1000]
    assert seen["met"] <= 60


def test_last_pairs_by_join_and_by_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("s", k, sorted(rng.sample("abcdefghijk", rng.randint(4, 8)))) for k in range(120)]
    df = spark.createDataFrame(rows, "g string, at int, tokens array<string>")
    kept: list[tuple[int, set]] = []
    for _, k, t in rows:
        if all(len(set(t) & o) / len(set(t) | o) < 0.72 for _, o in kept):
            kept.append((k, set(t)))
    for most in (64, 0):
        monkeypatch.setattr(acceptance, "MOST_PAIRS", most)
        got = acceptance.accepted(df, ["g"], ["at"], F.col("tokens"), 0.72, 1)
        assert sorted(r["at"] for r in got.collect()) == [k for k, _ in kept]


def test_bullets_without_needless_regexes(spark):
    """Quick ways around regexes give what these give."""
    base = "una frase que tiene bastantes letras."
    texts = [None, "", base, f"  {base}\t", "una  frase con dos blancos y bastantes letras.", "una\u3000frase\u00a0con\r\nblancos y bastantes letras. ,", f"{base} -—·,", f"{base} ,\u2028", f"é{base}\x0b ", f"{base} -\u200b"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r for r in df.select(one_space("t"), one_space_of(F.col("t"))).collect() if r[0] != r[1]] == []
    want = {r.k: r.b for r in df.select("k", deck.clean_bullet(F.col("t")).alias("b")).collect() if r.b is not None}
    assert len(want) > 5 and {r.k: r.bullet for r in deck.cleaned(df, F.col("t")).collect()} == want
