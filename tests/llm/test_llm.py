"""Every operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute
force or the SQL; on empty tables; and the pipeline against a plain version of its stages."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from lectio.llm import chat, components, embeddings, jaccard, line_dedup, mixing, packing, quality_model, quality_rules, simhash, suffix, suffix_dedup, tokens, warc
from lectio.llm.tokens import Encoder, default_path

rnd = random.Random(11)
WORDS = ["".join(rnd.choice("abcdeñéß") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]


def prose(n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


COMMON = "This line is shared by very many documents."
BASE = [prose(rnd.randrange(60, 200)) for _ in range(12)]
TEXTS = [
    *BASE, BASE[0], BASE[0], BASE[1] + " " + prose(3), BASE[1].replace(" ", "  "), None, "", " \t\n", "one", "two words", "a b c d", "ÁÉÍ Straße\x0bvt\x0cff",
    *(f"{prose(60)}\n{COMMON}\n\n{prose(20)}\n {COMMON.upper()} \n{COMMON}" for _ in range(4)), "word " * 3000, "x" * 5000, "\n\n\n", prose(3000), "### *** $$$ " * 30, "STOP!! " * 80,
]
CLASH = "size target kept words pos key node fp anchor span part n taken word line h1 component score m copies"


def frame(spark, texts=TEXTS):
    """Documents of the texts, with repeated and null ids at the end and columns named as the operators name theirs."""
    ids = [*range(len(texts) - 2), 3, None] if len(texts) > 4 else list(range(len(texts)))
    rows = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "text": pd.Series(texts, dtype=object), "source": [(None, "b", "a", "é")[i % 4] for i in range(len(texts))]})
    for c in CLASH.split():
        rows[c] = "clash"
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH.split())
    data = [tuple(None if x is pd.NA else x for x in r) for r in rows.itertuples(index=False)]
    return spark.createDataFrame([(int(r[0]) if r[0] is not None else None, *r[1:]) for r in data], schema).repartition(3), pd.DataFrame(data, columns=rows.columns)


def rows_of(df, columns=None):
    found = df.select(*columns) if columns else df
    return sorted(map(tuple, found.collect()), key=repr)


def by_sql(sql: str, **tables: pd.DataFrame):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(f"{name}_", t)
        casts = {"doc_id": "BIGINT", "text": "VARCHAR", "source": "VARCHAR", "page_id": "BIGINT", "html": "VARCHAR"}
        c.sql(f"CREATE TABLE {name} AS SELECT {', '.join(f'{k}::{casts[k]} AS {k}' for k in t.columns if k in casts)} FROM {name}_")
    found = c.sql(sql)
    return found.columns, sorted((tuple(r) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="module")
def edge(spark):
    df, pdf = frame(spark)
    return df.cache(), pdf


@pytest.fixture(scope="module")
def nothing(edge):
    return edge[0].limit(0)


# --- 1 -------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    html = [None, "", "a", "a", "é" * 9000, "é" * 9000, "x" * 40000, "<p>\r\n0\r\n\r\n</p>", "a"]
    ids = [1, 2, 3, 9, 5, 6, 7, 8, 9]
    pages = spark.createDataFrame([(i, None if i == 2 else "http://e x/", h, "clash", 1) for i, h in zip(ids, html)], "page_id long, url string, html string, refers_to string, sha1 int").repartition(3)
    files = warc.archives(pages, segment_bytes=7000, archive_bytes=400).cache()
    assert files.count() > 3
    back = warc.read(files, with_payload=True).cache()
    assert back.filter("error IS NOT NULL").count() == 0
    got = sorted((r.record_id.split(":")[2], r.record_type, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in back.collect())
    want = []
    for i, h in zip(ids, html):
        data = (h or "").encode()
        last = max(j for j, g in zip(ids, html) if (g or "") == (h or ""))
        want.append((str(i), "response" if i == last else "revisit", len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), data if i == last else None))
    assert got == sorted(want)
    assert warc.read(warc.archives(pages.limit(0))).count() == 0


def test_warc_min_bytes_and_damage(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.read(warc.archives(pages, min_bytes=5)).collect()} == {"response"}
    parts = list(warc.page_records(1, "u", b"z" * 3000, None, "0-0", 1000))
    assert len(parts) == 4
    cases = {"gap": parts[0] + parts[2] + parts[3], "short": parts[0] + parts[1] + parts[2], "twice": b"".join([*parts, parts[1]]), "head": b"".join(parts[1:]), "bad": b"\x1f\x8bnothing", "whole": b"".join(reversed(parts))}
    for name, content in cases.items():
        row = warc.read(spark.createDataFrame([(name, bytearray(content))], "name string, content binary")).collect()
        assert len(row) == 1 and (row[0].error is None) == (name == "whole"), (name, row)
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc" and warc.dechunked(warc.chunked(b"q" * 9999, 7)) == b"q" * 9999


# --- 2 -------------------------------------------------------------------------------------------------------------


def check_pieces(pieces: pd.DataFrame, texts: list, length: int):
    e = Encoder(default_path())
    want = Counter()
    for t in texts:
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(len(ids), zlib.crc32(ids.tobytes()))] += 1
    q = pieces.sort_values(["sequence_id", "offset"])
    place = (q.sequence_id * length + q.offset).to_numpy()
    assert (place == np.concatenate([[0], q.length.cumsum()[:-1]])).all() and ((q.offset + q.length) <= length).all()
    # a document's pieces follow each other from its start
    begins = q[q.start == 0]
    assert len(begins) == len(texts)
    assert sum(begins.doc_tokens) == q.length.sum() == sum(n * c for (n, _), c in want.items())
    whole = Counter((int(n), int(c)) for n, k, c in zip(q.doc_tokens, q.length, q.ids_crc32) if n == k)
    assert not whole - want


def test_packing(edge, nothing):
    df, pdf = edge
    check_pieces(packing.pack(df, length=256).toPandas(), list(pdf.text), 256)
    found = packing.sequences(df, length=256, pad=9).collect()
    assert {len(r.ids) for r in found} == {256}
    assert packing.pack(nothing).count() == 0


def test_tokens_word_by_word():
    import pyarrow as pa

    e = Encoder(default_path())
    assert e.by_word
    cases = ["don't <|endoftext|>x it's 'sun I'LL 5²x ½ µm Ünï  a\x0bb\x0cc\x85d İstanbul ΟΔΟΣ é ́x ﬁ 中文 \x00\x01 a\tb", "", None, "   ", "x " * 9, "×÷ ABC!!d#$1234 _a_ <|startoftext|><|endoftext|>", *BASE]
    ids, at = e.encode(pa.array(cases, pa.string()), 1)
    for k, t in enumerate(cases):
        assert ids[at[k] : at[k + 1]].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


# --- 3 -------------------------------------------------------------------------------------------------------------


def test_quality_model(spark, edge, nothing):
    df, pdf = edge
    junk = [f"{w}### {w}*** " * 40 for w in WORDS[:60]]
    good = [prose(120) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(junk + good)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60), 1) for i in range(120)] + [(5000, 1, 0), (None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(docs, labels)
    got = quality_model.score(docs, model).toPandas().set_index("doc_id").sort_index()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    out = got[got.held_out]
    assert ((out.predicted == 1) == (out.index >= 60)).mean() > 0.95 and got.score.between(0, 1).all()
    again = quality_model.train(docs.repartition(5), labels)
    assert np.array_equal(again.weights, model.weights)
    rows = quality_model.score(df, model)
    assert rows.count() == len(pdf) and rows.filter("score IS NULL OR held_out IS NULL").count() == 0
    assert quality_model.score(nothing, model).count() == 0
    assert quality_model.train(docs, labels.limit(0)).scores(np.zeros((1, len(quality_model.FEATURES))))[0] == 0.5


# --- 4 -------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, linked):
    comp = dict.fromkeys(ids)
    for i in ids:
        comp[i] = i
    while True:
        before = dict(comp)
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return comp


@pytest.mark.parametrize("block", [50_000, 2])
def test_simhash(spark, edge, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    df, pdf = edge
    got = simhash.grouped(df, simhash.NARROW).collect()
    fps = [(r.doc_id, int.from_bytes(r.fp, "little")) for r in got]
    assert sorted(fps, key=repr) == sorted(((None if pd.isna(i) else int(i), plain_fingerprint(t)) for i, t in zip(pdf.doc_id, pdf.text)), key=repr)
    real = [(i, f) for i, f in fps if i is not None]
    comp = plain_components({i for i, _ in real}, [(a, b) for a, f in real for b, g in real if a < b and (f ^ g).bit_count() <= 4])
    for r in got:
        assert r.component_id == (None if r.doc_id is None else comp[r.doc_id])


def test_simhash_links_near_fingerprints(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for k in range(8):
            x = int(b)
            for bit in r.choice(64, r.integers(1, 8), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    classes = spark.createDataFrame([(bytearray(f.to_bytes(8, "little")), i) for i, f in enumerate(fps)], "fp binary, node long")
    got = {x.node: x.component for x in components.components(simhash.links(classes, simhash.NARROW)).collect()}
    want = plain_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_simhash_dedup(edge, nothing):
    df, pdf = edge
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 0 in ids and 12 not in ids and 13 not in ids and 15 not in ids and set(range(1, 12)) <= set(ids)
    assert simhash.dedup(nothing).count() == 0


@pytest.mark.parametrize("buckets", [1 << 22, 64])
def test_simhash_dedup_by_exact_similarity(spark, monkeypatch, buckets):
    """Pairs around a similarity of 0.8, chains of them, and a passage that many share, against all pairs of sets."""
    monkeypatch.setattr(jaccard, "BUCKETS", buckets)
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    passage, made = [word() for _ in range(40)], []
    for k in range(120):
        w = [word() for _ in range(r.randrange(20, 160))]
        made.append(w)
        for _ in range(r.choice([1, 1, 2, 6])):  # every changed word changes five shingles
            w = list(w)
            for at in r.sample(range(len(w)), max(1, round(len(w) * r.uniform(0.01, 0.035)))):
                w[at] = word()
            made.append(w)
    made += [passage + [word() for _ in range(r.randrange(1, 30))] for _ in range(40)] + [["a", "b"], ["A", "b"], ["a", "c"], [], []]
    sets = [{" ".join(w[i : i + 5]).lower() for i in range(max(1, len(w) - 4))} if w else set() for w in made]
    alike = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y) > 0
    linked = [(i, j) for j in range(len(made)) for i in range(j) if alike(sets[i], sets[j])]
    want = {i for i, c in plain_components(range(len(made)), linked).items() if i == c}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in simhash.dedup(docs).collect()} == want


def test_simhash_dedup_dense_group(spark):
    """A group of which only some pairs are similar meets its components in the rounds, not pair by pair at the end."""
    r = random.Random(9)
    base, made = [f"w{k}" for k in range(150)], []
    for _ in range(200):
        w = list(base)
        for at in r.sample(range(len(w)), r.choice([1, 2, 3, 4])):
            w[at] = f"x{r.randrange(10**9)}"
        made.append(w)
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in made]
    linked = [(i, j) for j in range(len(made)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(linked) < 0.9 * 200 * 199 / 2
    want = plain_components(range(len(made)), linked)
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "node long, text string").repartition(3)
    found = [(x.u, x.v) for x in jaccard.links(texts, 0.8, 5).collect()]
    assert set(found) <= {(min(p), max(p)) for p in linked} and plain_components(range(len(made)), found) == want
    counts = jaccard.frequencies(texts, 5)
    h = np.frombuffer(b"".join(jaccard.shingle_set(" ".join(w), 5) for w in made), "<u8")
    n = np.bincount(jaccard.bucket(h, jaccard.BUCKETS), minlength=jaccard.BUCKETS)
    assert (counts == np.round(8 * np.log2(n + 1)).astype(np.uint8)).all()
    assert not jaccard.frequencies(texts.limit(0), 5).any()


# --- 5 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("tile", "d"), [(4096, 64), (16, 64), (8, 5)])
def test_embeddings(spark, monkeypatch, tile, d):
    monkeypatch.setattr(embeddings, "TILE", tile)
    r = np.random.default_rng(d)
    x = r.normal(size=(60, d))
    near = np.concatenate([x[:20] + r.normal(size=(20, d)) * s for s in (0.05, 0.2, 0.3)])
    data = [list(map(float, np.float32(v))) for v in np.concatenate([x, near, near[:3], near[:2] * 2])]
    data += [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [float("inf")] * d, [1.0] * (d + 1), [], [None] * d]
    data += [[1.0, 1.0], [1.0, 1.01], [2.0, 2.0], [1.0, -1.0], [0.0], [3.0], [5.0], [-1.0], *(list(map(float, np.float32(v))) for v in np.repeat(r.normal(size=(3, d + 3)), 4, axis=0) + r.normal(size=(12, d + 3)) * 0.1)]
    rows = [(i, v, 1) for i, v in enumerate(data)] + [(None, data[0], 1)]
    got = {q.vec_id: q for q in embeddings.grouped(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").repartition(3)).collect()}
    link = []
    for length in {len(v) for v in data if v}:  # vectors of each length with each other
        ok = [i for i, v in enumerate(data) if v is not None and len(v) == length and None not in v and np.isfinite(v).all() and any(v)]
        m = np.array([data[i] for i in ok], np.float64).reshape(-1, length)
        m /= np.sqrt((m * m).sum(axis=1))[:, None]
        link += [(ok[i], ok[j]) for i, j in zip(*np.nonzero(m @ m.T >= 0.95)) if i != j]
    n, comp = Counter(i for i, _ in link), plain_components(range(len(data)), link)
    assert len(link) > 20
    for i in range(len(data)):
        assert (got[i].n_links, got[i].component_id) == (n[i], comp[i]), i
    assert got[None].component_id is None
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.grouped(empty).count() == 0


# --- 6 -------------------------------------------------------------------------------------------------------------


def test_mixing(edge, nothing):
    df, pdf = edge
    got = mixing.shares(df).select("doc_id", "size", "source_size", "target", "taken", "copies", "finish")
    columns, want = by_sql(mixing.ORACLE, documents=pdf)
    assert list(columns) == got.columns and want == rows_of(got)
    for source in set(pdf.source):
        mine = [r for r, s in zip(plain_mix(pdf), pdf.source) if s == source]
        assert sum(r[1] for r in mine) == int(mine[0][0])  # each source takes its target
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    sent = Counter()
    for r in mixed.collect():
        sent[r.source] += len((r.text or "").encode().split())
    assert sent == +Counter({s: int(t[0]) for s, t in zip(pdf.source, plain_mix(pdf))})
    assert mixing.mix(nothing).count() == mixing.shares(nothing).count() == 0


def plain_mix(pdf):
    """(target, taken, copies, finish times of the copies) of each row."""
    size = [len((t or "").encode().split()) for t in pdf.text]
    sources = sorted(set(pdf.source), key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(n for n, x in zip(size, pdf.source) if x == s) for s in sources}
    left, free, target = sum(size), set(sources), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
        free -= over
    target |= share
    out = [None] * len(pdf)
    for s in sources:
        key = lambda i: (hashlib.md5(f"mix:{'' if pd.isna(pdf.doc_id[i]) else int(pdf.doc_id[i])}".encode()).hexdigest(), size[i])
        rows, at = sorted((i for i in range(len(pdf)) if pdf.source[i] == s or (s is None and pdf.source[i] is None)), key=key), 0
        sent = Counter()
        done = {i: [] for i in rows}
        for _ in range(3):
            for i in rows:
                take = min(size[i], int(target[s]) - at)
                at += size[i]
                if take > 0:
                    sent[i] += take
                    done[i].append(at / target[s])
        for i in rows:
            out[i] = (target[s], sent[i], len(done[i]), done[i])
    return out


def test_mix_is_in_the_order_of_finish_times(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_WORDS", 200)
    texts = [prose(rnd.randrange(1, 60)) for _ in range(90)] + ["x"] * 4
    df = spark.createDataFrame([(i, t, "abc"[min(i % 7, 2)]) for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    pdf = df.toPandas()
    plain = plain_mix(pdf)
    want = sorted((t, hashlib.md5(f"mix:{i}".encode()).hexdigest(), k, i) for i, r in zip(pdf.doc_id, plain) for k, t in enumerate(r[3]))
    mixed = mixing.mix(df)
    assert mixed.rdd.getNumPartitions() > 5
    assert [r.doc_id for r in mixed.collect()] == [x[3] for x in want]
    assert mixing.mix(df.repartition(2)).collect() == mixed.collect()


def test_first_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  a b\n\nc d ", 3), ("a", 1), ("a b", 0)], "t string, n long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["  a b\n\nc", "a", ""]


# --- 7 -------------------------------------------------------------------------------------------------------------


def plain_repeats(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        yield len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize(("spans", "window", "gram"), [(4096, 400, 96), (2, 24, 8)])
def test_suffix_dedup(spark, edge, nothing, monkeypatch, spans, window, gram):
    monkeypatch.setattr(suffix_dedup, "SHARD_SPANS", spans)
    df, pdf = edge
    got = rows_of(suffix_dedup.digests(df, window, gram), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == sorted(plain_repeats(pdf.text, window), key=repr)
    flags = [r.shares_passage for r in sorted(suffix_dedup.digests(df, window, gram).collect(), key=lambda r: (r.n_bytes, r.kept_sha256, r.passages))]
    assert any(flags) and not all(flags)
    assert suffix_dedup.digests(nothing, window, gram).count() == 0


def test_suffix_dedup_short_periods(spark):
    """A run of equal spans is one row, and the result is still that of brute force."""
    texts = ["=" * 20_000, "ab" * 9_000 + prose(30), "=" * 500 + prose(100) + "=" * 450, prose(90), "abcdefghij" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert suffix_dedup.occurrences(docs).count() < 300
    got = [tuple(r)[1:5] for r in sorted(suffix_dedup.digests(docs).collect())]
    assert got == list(plain_repeats(texts, 400))


def test_passages_of_words(spark):
    """Every passage of 50 words that another document has is seen, whatever its bytes; nothing shorter than 40 words is."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 5)))
    texts = [[word() for _ in range(r.randrange(100, 300))] for _ in range(60)]
    shared = {}
    for k in range(0, 40, 2):
        n = (50, 51, 90, 39, 20)[k // 2 % 5]
        at, to = r.randrange(len(texts[k]) - n), r.randrange(len(texts[k + 1]))
        texts[k + 1][to:to] = texts[k][at : at + n]
        shared[k] = shared[k + 1] = n >= 50
    texts[50] = texts[50][:30] * 3  # a passage that only one document has, twice
    made = [(" \n"[i % 2]).join(w).upper() if i % 3 == 0 else "  ".join(w) for i, w in enumerate(texts)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    for row in suffix_dedup.digests(docs).collect():
        assert row.shares_passage == (row.passages > 0) == shared.get(row.doc_id, False), row


def test_word_parts():
    text = " ".join(f"w{i}" for i in range(5000)).encode()
    parts = list(suffix_dedup.word_parts(text, 3000, 50))
    assert all(len(p) <= 3000 for p in parts) and len(parts) > 5
    windows = {tuple(p.split()[i : i + 50]) for p in parts for i in range(len(p.split()) - 49)}
    words = text.split()
    assert {tuple(words[i : i + 50]) for i in range(len(words) - 49)} <= windows
    assert b"".join(suffix_dedup.word_parts(b"x" * 10_000, 3000, 50)) == b"x" * 10_000


def test_suffix_dedup_long_text_in_chunks(spark):
    """A text of several chunks, as the smallest chunk can be."""
    text = prose(60_000)
    text = text + " mid " + text[1000:3000]
    b = text.encode()
    old = suffix_dedup.CHUNK_BITS
    try:
        suffix_dedup.CHUNK_BITS = 16
        suffix_dedup.powers.cache_clear()
        parts = [b[k : k + (1 << 16)] for k in range(0, len(b) - 400 + 1, (1 << 16) - 400 + 1)]
        starts = []
        for k, p in enumerate(parts):
            s, n, _, _, _, run = suffix_dedup.spans_in(p, np.array([0, len(p)]), 400, 96)
            assert (run == 1).all()
            starts += [k * ((1 << 16) - 399) + a + i for a, m in zip(s.tolist(), n.tolist()) for i in range(m)]
        assert starts == list(range(len(b) - 399))
    finally:
        suffix_dedup.CHUNK_BITS = old
        suffix_dedup.powers.cache_clear()


def test_suffix_array():
    r = random.Random(3)
    for k in range(400):
        d = bytes(r.choice(b"ab" if k % 3 else b"abc\x00\xff") for _ in range(r.randrange(60)))
        d = (d * 4)[:60] if k % 5 == 0 else d
        want = sorted(range(len(d)), key=lambda i: d[i:])
        assert suffix.suffix_array(d).tolist() == want
        if len(d) > 1:
            p = suffix.permuted_prefixes(d, np.array(want), 24)
            for a, b in zip(want, want[1:]):
                assert p[b] == next((k for k in range(24) if d[a + k : a + k + 1] != d[b + k : b + k + 1] or a + k >= len(d) or b + k >= len(d)), 24)


# --- 8 -------------------------------------------------------------------------------------------------------------


def test_chat(spark):
    pieces = ["#", "###", ": ", ":", " ", "\\", "</turn>", "</", "turn>\n", "\n", "a", "ñ", "😀", "### Assistant: "]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, ": x"]), None if rnd.random() < 0.1 else "".join(rnd.choice(pieces) for _ in range(rnd.randrange(12))), "clash") for c in range(30) for t in range(rnd.randrange(1, 6))]
    rows += [(3, 0, "user", "again", ""), (3, 0, "user", "again", ""), (None, 1, "assistant", "x" * 200_000, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r is not None, r or "", x is not None, x or "") for i, t, r, x, _ in rows if i == c), key=lambda q: (q[0], q[1], q[2].encode(), q[3], q[4].encode()))
        said = "".join(f"{q[2]}\n{q[4]}\n" for q in turns)
        loss = "".join(q[4] for q in turns if q[2] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= len(said) and r.marked_chars >= r.loss_chars
    assert chat.digests(df.limit(0)).count() == 0
    for part in chat.formatted(df).collect():
        assert part.part == 0 and len(part.formatted) == got[part.conv_id].formatted_chars
        assert sum(s.end - s.start for s in part.spans) == got[part.conv_id].marked_chars


def test_chat_loss_is_what_the_template_marks(spark):
    rows = [(1, 0, "user", "a ### b"), (1, 1, "assistant", "c: \\d"), (1, 2, "assistant", "### "), (2, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    result = lambda template: {r.conv_id: (r.n_turns, r.loss_chars, r.loss_sha256) for r in chat.digests(df, template).collect()}
    loss = "c: \\d### "
    assert result(chat.TURNS) == {1: (3, len(loss), sha(loss)), 2: (1, 0, sha(""))}
    unmarked = chat.TURNS.replace("{% generation %}", "").replace("{% endgeneration %}", "")
    assert result(unmarked) == {1: (3, 0, sha("")), 2: (1, 0, sha(""))}
    users = chat.TURNS.replace("'assistant'", "'user'")
    assert result(users) == {1: (3, 7, sha("a ### b")), 2: (1, 4, sha("only"))}
    last = "<s>" + chat.TURNS.replace("m.role == 'assistant'", "m.role == 'assistant' and loop.last") + "<e>"
    assert result(last) == {1: (3, 4, sha("### ")), 2: (1, 0, sha(""))}
    texts = {r.conv_id: r.formatted for r in chat.formatted(df, last).collect()}
    assert texts[2] == "<s>### user: only</turn>\n<e>" and texts[1].count("<s>") == texts[1].count("<e>") == 1


def test_chat_marks_across_pieces():
    """However the marked text is cut into pieces, the loss is the same."""
    r = random.Random(2)
    for _ in range(300):
        turns = [(r.choice(["user", "assistant"]), "".join(r.choice(["#", "###", ": ", "\\", "</turn>", "x", "\n"]) for _ in range(r.randrange(6)))) for _ in range(4)]
        now = chat.Digest()
        for text, loss in chat.compiled(chat.TURNS, chat.MARKS)(messages=[{"role": a, "text": b} for a, b in turns]):
            while text:
                n = r.randrange(1, 4)
                now.add(text[:n], loss)
                text = text[n:]
        now.add("", last=True)
        said = "".join(b for a, b in turns if a == "assistant")
        assert (now.n_turns, now.loss_chars, now.loss.hexdigest()) == (4, len(said), hashlib.sha256(said.encode()).hexdigest())


def test_templates():
    t = chat.compiled("{% if a == 'x' and not b %}{{ a ~ '!' | upper }}{% elif b %}b{% else %}c{% endif %}{# no #}{% for m in ms %}{{ m.k + 'z' }}{% endfor %}", {"a": "x"})
    assert "".join(p for p, _ in t(b=False, ms=[{"k": "1"}, {"k": "2"}])) == "x!1z2z"
    folded = chat.fold_body(chat.parse("a{{ 'b' + s }}{% if s == 'c' %}d{% else %}{{ x }}{% endif %}"), {"s": "c"})
    assert folded == (chat.Emit(chat.Const("abcd")),)
    marked = list(chat.compiled("u{% generation %}{{ x }}{% endgeneration %}v", {})(x="T"))
    assert marked == [("u", False), ("T", True), ("v", False)]
    more = chat.compiled("{% set k = 'x' %}{% if 'b' in a and not c and 2 <= n %}{{ ms[0].k ~ k }}{% endif %}{% for m in ms %}{% if loop.first %}<{% endif %}{{ loop.index }}{{ m['k'] }}{% if not loop.last %},{% else %}>{% endif %}{% endfor %}{{ a not in 'abc' }}", {"a": "b", "k": "folded?"})
    assert "".join(p for p, _ in more(c=False, n=2, ms=[{"k": "1"}, {"k": "2"}])) == "1x<11,22>False"
    assert chat.compiled(chat.TURNS, chat.MARKS).streams("messages") and not more.streams("ms")
    assert not chat.compiled("{% for a in x %}{% for m in messages %}{{ m.k }}{% endfor %}{% endfor %}", {}).streams("messages")
    for bad in ("{% set a %}", "{{ a[0 }}", "{{ a not b }}", "{{ a.__class__ }}", "{{ a | eval }}", "{% for x in %}{% endfor %}", "{% if a %}", "{{ a( }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


# --- 9 and 10 ------------------------------------------------------------------------------------------------------


def test_line_dedup(edge, nothing):
    from pyspark.sql import functions as F

    df, pdf = edge
    found = line_dedup.with_bitmaps(df, line_dedup.drop_bitmaps(df))
    got = found.select(
        "doc_id", F.size(line_dedup.split_lines(F.col("text"))).cast("long"), F.expr("coalesce(aggregate(lectio_words__, 0L, (a, w) -> a + bit_count(w.bits)), 0L)"),
        F.sha2(F.coalesce(line_dedup.kept_text(), F.lit("")), 256),
    )
    assert by_sql(line_dedup.ORACLE, documents=pdf)[1] == rows_of(got)
    assert sum(r[2] for r in rows_of(got)) == 11
    assert line_dedup.dedup(df).columns == df.columns and line_dedup.dedup(nothing).count() == 0


def test_line_dedup_repeated_rows(spark):
    """Rows with the same id and text are documents of their own; a line that a text has twice is still of one document."""
    line = "This one line is long enough to count."
    docs = pd.DataFrame({"doc_id": [1, 1, 2, 3, 3, 5, 6], "text": [line, line, line, "b" + line, "b" + line, f"c{line}\nc{line}\nc{line}", f"c{line}"], "source": "s"})
    df = spark.createDataFrame(list(docs.itertuples(index=False)), "doc_id long, text string, source string").repartition(3)
    got = line_dedup.with_bitmaps(df, line_dedup.drop_bitmaps(df)).selectExpr("doc_id", "coalesce(aggregate(lectio_words__, 0L, (a, w) -> a + bit_count(w.bits)), 0L) n").collect()
    want = sorted((r[0], r[2]) for r in by_sql(line_dedup.ORACLE, documents=docs)[1])
    assert sorted(map(tuple, got)) == want == [(1, 1), (1, 1), (2, 0), (3, 0), (3, 0), (5, 0), (6, 0)]


def test_line_dedup_many_lines(spark):
    """Bitmaps of several words."""
    texts = ["\n".join(f"line number {i % 150} of all of them" for i in range(300)), "\n".join(f"line number {i} of all of them" for i in range(0, 150, 2)), "\n".join(f"LINE number {i} of all of them " for i in range(0, 150, 3))]
    df, pdf = frame(spark, texts)
    assert [(len(r.text.split("\n")) if r.text else 0) for r in sorted(line_dedup.dedup(df).collect(), key=lambda r: r.doc_id)] == [250, 50, 50]
    assert by_sql(line_dedup.ORACLE, documents=pdf)[1][0][2] == 50


def test_quality_rules(edge, nothing):
    df, pdf = edge
    found = quality_rules.ledger(df).cache()
    base = quality_rules.verdict(found["failure_bits"], "base-1")
    columns, want = by_sql(quality_rules.ORACLE, documents=pdf)
    got = found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), quality_rules.verdict(found["failure_bits"], "web-1").alias("kept"), "failure_bits")
    assert want == rows_of(got, columns)
    for policy in quality_rules.POLICIES:
        mask = quality_rules.policy_mask(policy)
        bits = [r.failure_bits & mask for r in found.collect()]
        for r in quality_rules.ablation(found, policy).collect():
            b = quality_rules.BIT[r.rule]
            assert (r.n_failed, r.n_failed_alone) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits))
    columns_, ablations = by_sql(quality_rules.ABLATION_ORACLE, documents=pdf)
    assert ablations == sorted(((p, *r) for p in quality_rules.POLICIES for r in quality_rules.ablation(found, p).select("rule", "n_failed", "n_failed_alone").collect()), key=repr)
    judged = quality_rules.judged(df)
    assert rows_of(judged.select("doc_id", "lectio_ledger__.*"), found.columns) == rows_of(found)
    kept = quality_rules.keep(df)
    assert kept.columns == df.columns and kept.count() == sum(r[list(columns).index("kept")] for r in want)
    assert quality_rules.keep(nothing).count() == quality_rules.ledger(nothing).count() == 0


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark, edge):
    """Each stage against a plain version of it on what the stage before it gave."""
    df, _ = edge
    docs = df
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        docs = stage(spark, docs, "").cache()
        after = docs.toPandas()
        if k < 4:
            assert docs.columns == df.columns, name
        if name == "quality rules":
            _, rows = by_sql(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE})", documents=before)
            assert len(after) == sum(r[1] for r in rows) and {COMMON in t for t in after.text} == {True, False}
        elif name == "line dedup":
            _, rows = by_sql(line_dedup.ORACLE, documents=before)
            assert sorted(r[3] for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in after.text)
        elif name == "simhash near-dedup":
            ids = set(after.doc_id.dropna())
            assert ids < set(before.doc_id.dropna()) and {0, 1, 13} <= ids and not ids & {12, 14, 15}
        elif name == "mixing":
            _, rows = by_sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE})", documents=before)
            assert Counter(int(i) for i in after.doc_id.dropna()) == +Counter({r[0]: r[1] for r in rows if r[0] is not None})
            assert (after.n_chars == after.text.str.len()).all() if "n_chars" in after else True
        else:
            check_pieces(after, list(before.text), 2048)


def test_pipeline_on_nothing(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_small_memory_gives_the_same_ids():
    """What is let go is encoded again; both halves together stay within the bound."""
    made = ["uno dos, tres uno dos. cuatro", None, "", "  Ártico ﬁn él <|endoftext|> x", "a b c d e f g a b c 12345 it's " * 20]
    e = tokens.Encoder(tokens.default_path())
    e.words = tokens.Memory(4)
    ids, at = e.encode(pa.array(made, pa.string()), 1)
    for text, a, b in zip(made, at[:-1], at[1:]):
        assert ids[a:b].tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    for m in (e.words,):
        assert len(m.new) <= 2 and len(m.old) <= 2
    ids, at = e.encode(pa.array([], pa.string()), 1)
    assert not len(ids) and np.array_equal(at, [0])


def test_operators_reach_workers_that_cannot_import_the_package(tmp_path):
    """Each operator on the caller's own frame, from a process whose workers don't see the repository."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lectio.functions.tables import cleanup
from lectio.llm import chat, embeddings, jaccard, line_dedup, mixing, packing, quality_model, quality_rules, simhash, suffix_dedup, warc
docs = spark.createDataFrame([(i, "some words to read " * 20, "a") for i in range(4)], "doc_id long, text string, source string")
pages = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string")
turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.01])], "vec_id long, embedding array<float>")
labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
found = [warc.read(warc.archives(pages)), packing.pack(docs), packing.sequences(docs), quality_model.score(docs, quality_model.train(docs, labels)), simhash.grouped(docs, simhash.NARROW), simhash.dedup(docs),
    embeddings.grouped(vectors), mixing.mix(docs), suffix_dedup.digests(docs), suffix_dedup.dedup(docs), chat.digests(turns), chat.formatted(turns), line_dedup.dedup(docs), quality_rules.ledger(docs), quality_rules.keep(docs)]
print("ROWS", [len(f.collect()) for f in found], cleanup(spark) > 10)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable, "PYTHONSAFEPATH": "1"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS [1, 4, 1, 4, 4, 1, 2, 4, 4, 4, 1, 1, 4, 4, 0] True" in run.stdout, run.stdout + run.stderr[-3000:]


# --- SQL of 5 and 8 on tables with links, escapes, nulls and repeated rows ------------------------------------------


def against_sql(spark, path, name, df, query, sql):
    df.repartition(3).write.parquet(f"{path}/{name}.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet/*.parquet'")
    found = c.sql(sql)
    assert rows_of(query(spark, str(path)), found.columns) == sorted(found.fetchall(), key=repr)
    return found


def test_embeddings_against_sql(spark, tmp_path):
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 6))
    data = [list(map(float, np.float32(v))) for v in np.concatenate([x, *(x[:15] + r.normal(size=(15, 6)) * s for s in (0.05, 0.2, 0.3)), x[:4], x[:2] * 2])]
    data += [None, [], [0.0] * 6, [float("nan")] + [1.0] * 5, [float("inf")] * 6, [None] * 6, [1.0, 1.0], [1.0, 1.01], [2.0, 2.0], [1.0, -1.0]]
    rows = [(i, v, 1) for i, v in enumerate(data)] + [(None, data[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = against_sql(spark, tmp_path, "embeddings", df, embeddings.op5_embeddings, embeddings.ORACLE).df()
    assert found.n_links.max() > 2 and (found.n_links == 0).any() and not found.kept.all()


def test_chat_against_sql(spark, tmp_path):
    pieces = ["#", "###", "####", ": ", ":", " ", "\\", "</turn>", "</", "turn>\n", "\n", "a", "ñ", "😀", "### Assistant: "]
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, ": x", "\\"]), None if r.random() < 0.1 else "".join(r.choice(pieces) for _ in range(r.randrange(12)))) for c in range(30) for t in range(r.randrange(6))]
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again"), (None, 1, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    against_sql(spark, tmp_path, "conversations", df, chat.op8_chat_template, chat.ORACLE)


def test_quality_fit_against_descent():
    """The weights are those that plain gradient descent finds for the same loss; the threshold leaves as many below as are bad."""
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 4)) * [1, 5, 0.2, 1] + [0, 3, -1, 2]
    y = (x @ [1.0, -0.2, 3.0, 0.0] + r.normal(size=300) > -2).astype(int)
    model = quality_model.fit(x, y, pairs=500)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -6, 6)
    draw = np.random.default_rng(7)
    good, bad = z[y == 1], z[y == 0]
    diff = good[draw.integers(0, len(good), 500)] - bad[draw.integers(0, len(bad), 500)]
    w = np.zeros(4)
    for _ in range(200_000):
        g = -(diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) + quality_model.RIDGE * w
        w -= 0.2 * g
        if np.abs(g).max() < 1e-10:
            break
    assert np.abs(g).max() < 1e-8 and np.allclose(model.weights, w, atol=1e-5)
    assert abs((z @ w < model.threshold).mean() - (y == 0).mean()) < 0.01
