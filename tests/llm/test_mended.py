"""Repeated ids and wholly equal rows, and templates that go wrong or lack a value."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lectio.llm import chat, components, embeddings, jaccard, mixing, packing, quality_rules, simhash, suffix_dedup
from lectio.llm.tokens import Encoder, default_path


def plain(rows, least=0.95):
    """n_links of each row and the component of each id, from all pairs."""
    m = np.array([v for _, v in rows])
    m = m / np.sqrt((m * m).sum(axis=1))[:, None]
    near = m @ m.T >= least
    reach = {i: {i} for i, _ in rows}
    for _ in rows:
        for a in range(len(rows)):
            for b in np.flatnonzero(near[a]):
                both = reach[rows[a][0]] | reach[rows[b][0]]
                for x in both:
                    reach[x] = reach[x] | both
    return sorted((i, int(near[k].sum()) - 1, min(reach[i])) for k, (i, _) in enumerate(rows))


def repeated(kind):
    r = np.random.default_rng(12)
    x = np.float32(r.normal(size=(25, 5)))
    vectors = [*x, *(np.float32(x[:12] + r.normal(size=(12, 5)) * 0.1)), *x[:5], *x[:3]]
    ids = [int(r.integers(0, 22)) for _ in vectors]
    return [(kind(i), list(map(float, v))) for i, v in zip(ids, vectors)] + [(kind(5), [1.0, 0.0, 0.0, 0.0, 0.0]), (kind(5), [0.0, 1.0, 0.0, 0.0, 0.0]), (kind(6), [1.0, 0.01, 0.0, 0.0, 0.0])]


@pytest.mark.parametrize(("kind", "name"), [(int, "long"), (lambda i: f"v{i:02}", "string")])
def test_embeddings_with_repeated_ids(spark, kind, name):
    rows = repeated(kind)
    df = spark.createDataFrame(rows, f"vec_id {name}, embedding array<float>").repartition(3)
    assert sorted(tuple(r) for r in embeddings.grouped(df).select("vec_id", "n_links", "component_id").collect()) == plain(rows)


def test_embeddings_with_repeated_ids_against_sql(spark, tmp_path):
    rows = repeated(int)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = c.sql(embeddings.ORACLE)
    assert sorted(tuple(r) for r in embeddings.op5_embeddings(spark, str(tmp_path)).select(*found.columns).collect()) == sorted(found.fetchall())


# --- wholly equal rows -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def equal(spark):
    """Twelve rows that are one, and one that is another."""
    text = "the same words again and again " * 30
    return spark.createDataFrame([(7, text, "a")] * 12 + [(8, "some other words", "a")], "doc_id long, text string, source string").repartition(3), text


def test_equal_rows_are_packed_each(equal):
    df, text = equal
    ids, at = Encoder(default_path()).encode(pa.array([text]), packing.END)
    rows = packing.pack(df).filter("doc_id = 7").collect()
    assert sum(r.length for r in rows) == 12 * len(ids) and {r.doc_tokens for r in rows} == {len(ids)}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype("<u4").tobytes())
    assert Counter(i for r in rows for i in range(r.start, r.start + r.length)) == dict.fromkeys(range(len(ids)), 12)


def test_equal_rows_in_simhash_and_suffixes(equal):
    df, text = equal
    found = simhash.grouped(df, simhash.NARROW).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == {(7, 7): 12, (8, 8): 1}
    cut = suffix_dedup.digests(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in cut) == {(7, len(text), len(text)): 12, (8, 16, 0): 1}


def test_equal_rows_are_mixed_and_judged_each(equal):
    df, text = equal
    assert df.count() == 13 and quality_rules.ledger(df).filter("doc_id = 7").count() == 12
    taken = mixing.mix(df).collect()
    assert all(r.doc_id in (7, 8) for r in taken) and sum(len(r.text.split()) for r in taken) == 12 * 180 + 3


# --- near-dedup of the pipeline ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def copies(spark):
    """Pairs of texts: near by fingerprint and by set, by set alone, by fingerprint alone; their sets and fingerprints."""
    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**6)}"
    made = []
    for n in [600] * 12 + [50] * 12:  # one changed word is less than the fingerprint tells, or more
        w = [word() for _ in range(n)]
        made += [w, [*w[: n // 2], word(), *w[n // 2 + 1 :]]]
    for _ in range(6):  # nearly all shingles are repeats of a few
        line = [word() for _ in range(11)]
        made += [line * 60 + [word() for _ in range(15)] for _ in range(2)]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in made]
    fps = [int.from_bytes(simhash.fingerprint(" ".join(w), 5), "little") for w in made]
    pairs = [(i, j) for j in range(len(made)) for i in range(j)]
    alike = {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    near = {(i, j) for i, j in pairs if (fps[i] ^ fps[j]).bit_count() <= 4}
    assert min(len(alike & near), len(alike - near), len(near - alike)) >= 3
    return spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string").repartition(3), alike, near


def firsts(n, linked):
    """The nodes that stay: no smaller one is linked (links are pairs here)."""
    return set(range(n)) - {j for _, j in linked}


def test_near_fingerprints_against_all_pairs(copies):
    docs, _, near = copies
    found = simhash.near(docs.selectExpr("doc_id AS node", "text"))
    assert {(x.u, x.v) for x in found.collect()} == near
    assert components.components(found).filter("node = component").count() == len(near)


def test_dedup_links_by_fingerprints_first(copies, monkeypatch):
    """The stage finds near copies by their fingerprints, with the search by sets switched off, and checks them exactly."""
    docs, alike, near = copies
    monkeypatch.setattr(jaccard, "pairs", lambda rows, t, turn: rows.sparkSession.createDataFrame([], "u bigint, v bigint"))
    assert {x.doc_id for x in simhash.dedup(docs).collect()} == firsts(docs.count(), alike & near)


def test_dedup_loses_nothing_to_fingerprints(copies, monkeypatch):
    """Similar texts whose fingerprints are apart are found by their sets, which are asked for them alone."""
    docs, alike, near = copies
    asked, pairs = [], jaccard.pairs
    monkeypatch.setattr(jaccard, "pairs", lambda *a: asked.append(pairs(*a)) or asked[-1])
    assert {x.doc_id for x in simhash.dedup(docs).collect()} == firsts(docs.count(), alike)
    assert asked[0].count() == len(alike - near)  # by node, not by doc_id


# --- templates ---------------------------------------------------------------------------------------------------------


def rendered(template, **scope):
    return "".join(t for t, _ in chat.compiled(template, {"yes": True, "no": False})(**scope))


@pytest.mark.parametrize("dead", ["{{ 1 + 'x' }}", "{{ 'abc'[10] }}", "{{ 5 < 'a' }}", "{% for x in 5 %}{% endfor %}", "{{ 'x' in 5 }}"])
def test_branches_that_never_run(dead):
    assert rendered("{% if no %}" + dead + "{% endif %}ok") == "ok"
    assert rendered("{% if yes %}ok{% else %}" + dead + "{% endif %}") == "ok"
    assert rendered("{% if a %}" + dead + "{% endif %}ok", a=False) == "ok"


def test_what_is_not_there_is_empty():
    assert rendered("[{{ a }}{{ m.x }}{{ m['y'] }}{{ m.x.y }}{{ 'abc'[10] }}{% for x in q %}!{% endfor %}]", m={"z": 1}) == "[]"
    assert rendered("{{ 5 | upper }}{{ m.z | lower }}{{ m | length }}", m={"z": 1}) == "511"


@pytest.mark.parametrize(("template", "place"), [("{{ 1 + 'x' }}", "1 + 'x'"), ("{{ m.z < 'a' }}", "m.z < 'a'"), ("{% for x in m.z %}{% endfor %}", "m.z")])
def test_errors_say_where(template, place):
    with pytest.raises(chat.TemplateError, match=re.escape(place)):
        rendered(template, m={"z": 1})
