"""Operators 11 to 13: prefix tries and ranked search against brute force and SQL, pieces against the sentencepiece library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lectio.llm import lexical, pieces, trie

CONV = "conv_id long, turn long, role string, text string, path string, turns string, top string, first string, n string, depth string"


def conversations(spark, rows):
    """Turns with further columns named as the operator names its own."""
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], CONV).repartition(3)


def plain_trie(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    own = defaultdict(list)
    label = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, label(r, x)), (r, x)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members, final = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(full) + 1):
            members[tuple(full[:d])].add(c)
        final[tuple(full)].append(c)
    kids, out = Counter(k[:-1] for k in members if k), []
    n_words = lambda k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    for k, m in members.items():
        below = [j for j in members if j[: len(k)] == k]
        out.append((
            min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], sum(not kids[j] for j in below),
            sum((len(members[j]) - 1) * n_words(j) for j in below), hashlib.sha256(",".join(map(str, sorted(final[k]))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def turns():
    """Copies, shared beginnings, ties, repeated rows, nulls, negative ids, and conversations that become turnless."""
    rnd, rows = random.Random(5), []
    for c in [*range(-25, 130), 10**12 + 7]:
        n = rnd.randrange(1, 6)
        rows += [(c, t if t else None, rnd.choice(["user", "system", None]), rnd.choice(["", None, "a b", "a\tb c", "ñ \x0b é", "x" * 3000])) for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 290) for t in range(4)]
    rows += [(300, 1, "user", x) for x in ("b", "a", "b", None)] + [(341, 0, "user", "alone"), (None, 0, "user", "of none"), (300, None, None, None)]
    return rows


@pytest.mark.parametrize("least", [1, 3, 64, 10_000])
def test_trie_against_brute_force(spark, least):
    """Whatever share of the prefixes is heavy, from all that have two paths to none."""
    rows = turns()
    found = trie.prefix_trie(conversations(spark, rows), shares=10**9, least=least)
    assert found.columns == trie.COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_trie(rows)


def test_trie_against_sql(spark):
    rows = turns()
    c = duckdb.connect()
    c.register("rows_", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    c.sql("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM rows_")
    assert sorted(c.sql(trie.ORACLE).fetchall(), key=repr) == plain_trie(rows)


def test_trie_of_nothing_and_of_one_turnless_conversation(spark):
    none = conversations(spark, turns()).limit(0)
    assert trie.prefix_trie(none).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    found = [tuple(r) for r in trie.prefix_trie(conversations(spark, [(c, 0, "user", "gone")])).collect()]
    assert found == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_ends_of_many_copies_and_long_conversations(spark):
    """Blocks of ids of one path over several partitions; a conversation of many turns."""
    rows = [(c * 20, 0, "user", "hello there") for c in range(5000)] + [(7_000_000, t, "user", f"turn {t}") for t in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        found = {(r.depth, r.conv_id): r for r in trie.prefix_trie(conversations(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    one = found[1, 0]
    assert (one.n_convs, one.n_children, one.saved_tokens) == (5000, 0, 4999 * 2)
    assert one.ends_sha256 == hashlib.sha256(",".join(str(c * 20) for c in range(5000)).encode()).hexdigest()
    assert found[3000, 7_000_000].n_leaves == 1 and len(found) == 3002


def test_louds_gives_parents_and_degrees_back():
    degree = np.array([3, 0, 2, 1, 0, 0, 0])
    t = trie.Louds(degree, [1, 4, 7])
    assert t.unpacked().tolist() == [1, 1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0]
    assert t.degree().tolist() == degree.tolist() and t.parent().tolist() == [0, 0, 0, 2, 2, 3]
    n = np.ones(7, np.int64)
    t.upward(np.add, n)
    assert n.tolist() == [7, 1, 3, 2, 1, 1, 1]


# --- 12 ------------------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
lowered = lambda x: [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(x or "")]
SEARCHED = [
    "The cat sat", "the the the cat", None, "", "...", "Élan ÉLAN élan", "dog-cat_dog2 DOG2", "cat " * 4000, "a b c d e f", "the cat sat", "the cat sat", "日本 the 日本語",
    *(" ".join(random.Random(k).choices("the cat sat on a mat dog2 élan of".split(), k=k)) for k in range(40)),
]
ASKED = ["the cat", "THE CAT cat", "Élan 日本", None, "", "nothing that is there", "dog2", "the cat", "of " * 500]


def plain_search(docs, items, top=10):
    counts = [Counter(lowered(t)) for _, t in docs]
    n, length = sum(bool(c) for c in counts), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts):
            m = 10 + 90 * c.total() * n // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(lowered(text)) if c[t])
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def searched(spark):
    ids = [None, *range(len(SEARCHED) - 2), 3]
    docs, items = list(zip(ids, SEARCHED)), list(enumerate(ASKED)) + [(6, "dog2 cat"), (None, "sat")]
    clash = ["clash"] * 6
    return docs, items, spark.createDataFrame([(*d, *clash) for d in docs], "doc_id long, text string, term string, times string, n string, item string, rank string, score string").repartition(5), spark.createDataFrame([(*i, *clash) for i in items], "item_id long, text string, term string, times string, n string, item string, rank string, score string")


@pytest.mark.parametrize("block_terms", [1, 5, lexical.BLOCK_TERMS])
def test_search_against_brute_force(spark, block_terms):
    docs, items, d, i = searched(spark)
    assert sorted((tuple(r) for r in lexical.search(d, i, block_terms=block_terms).collect()), key=repr) == plain_search(docs, items)


def test_search_in_small_batches(spark, monkeypatch):
    """Few matches summed at once, and few rows a batch, give the same."""
    docs, items, d, i = searched(spark)
    block = lexical.Items([t for _, t in items])
    counted = block.count(pa.array([t for _, t in docs], pa.string()))
    n_docs, n_terms = int((counted[0] > 0).sum()), int(counted[0].sum())
    weight = np.arange(1, len(block.terms) + 1)
    item, doc, score = lexical.sums(block, weight, n_docs, n_terms, *counted)
    want = Counter()
    for x, t, k in zip(*counted[1:]):
        for q in block.items[block.first[t] : block.first[t + 1]]:
            want[q, x] += weight[t] * (10**9 * k // (1000 * k + 8 * (10 + 90 * int(counted[0][x]) * n_docs // n_terms)))
    assert dict(zip(zip(item.tolist(), doc.tolist()), score.tolist())) == {k: v for k, v in want.items() if v}
    keys = np.random.default_rng(3).integers(0, 1 << 60, 5000)
    assert (keys[lexical.radix_order(keys)] == np.sort(keys)).all()


def test_search_against_sql(spark):
    docs, items, *_ = searched(spark)
    c = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        c.register(f"{name}_", pd.DataFrame({key: pd.array([r[0] for r in rows], "Int64"), "text": pd.Series([r[1] for r in rows], dtype=object)}))
        c.sql(f"CREATE TABLE {name} AS SELECT {key}::BIGINT AS {key}, text::VARCHAR AS text FROM {name}_")
    assert sorted(c.sql(lexical.ORACLE).fetchall(), key=repr) == plain_search(docs, items)


def test_search_of_nothing(spark):
    _, _, d, i = searched(spark)
    assert lexical.search(d.limit(0), i).collect() == [] and lexical.search(d, i.limit(0)).collect() == []
    assert lexical.search(d.filter("text IS NULL OR text = ''"), i).collect() == []


# --- 13 ------------------------------------------------------------------------------------------------------------

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
CODEC = pieces.Codec(pieces.default_path())
ODD = [None, "", " ", "   ", "▁", "▁▁x ▁", "\0", "a\0b", "﻿", "<s>", "</s> <unk> <0x0A>", "\n\n \n", "é" * 300, "a" * 20_000, "日本語" * 3000, " " * 5000, "\t.com\r\n", "🙂🏽‍🙂", "퟿", "x" * 47, "x" * 48, "x" * 49]


def theirs(texts):
    return [LIBRARY.encode(t or "", add_bos=True, add_eos=True) for t in texts]


def own(texts):
    ids, at = CODEC.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])], CODEC.decode(ids, at)


def test_odd_texts_against_the_library():
    want = theirs(ODD)
    assert own(ODD) == (want, [LIBRARY.decode(x).encode() for x in want])
    assert own([]) == ([], [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab the▁\n .é日"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_any_text_against_the_library(texts):
    want = theirs(texts)
    assert own(texts) == (want, [LIBRARY.decode(x).encode() for x in want])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 270), st.integers(0, 31_999)), max_size=10), max_size=6))
def test_any_ids_decode_as_in_the_library(rows):
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    assert CODEC.decode(np.array([i for r in rows for i in r], np.int64), at) == [LIBRARY.decode(r).encode() for r in rows]


def test_heap_and_matrix_give_the_same(monkeypatch):
    texts = ["internationalization of the misunderstandings", "aaaaaaaaab" * 4, "日本語日本語"]
    want = own(texts)
    monkeypatch.setattr(pieces, "ARRAY_SYMBOLS", 0)
    assert own(texts) == want


def test_a_difference_from_the_library_ends_the_job():
    segments = pa.array([b" the", b"cat"])
    ids, first, size = CODEC.segments(segments)
    CODEC.checked(segments, ids, first, size)
    ids[0] += 1
    with pytest.raises(AssertionError):
        CODEC.checked(segments, ids, first, size)


def test_pieces_of_documents(spark):
    rows = [(k if k % 5 else None, t, "clash", "clash") for k, t in enumerate([*ODD, "again", "again"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string").repartition(3)
    want = [(r[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(i).encode()).hexdigest()) for r, i in zip(rows, theirs(r[1] for r in rows))]
    assert sorted((tuple(r) for r in pieces.digests(docs).collect()), key=repr) == sorted(want, key=repr)
    back = pieces.decoded(pieces.encoded(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((r[0], LIBRARY.decode(i)) for r, i in zip(rows, theirs(r[1] for r in rows))), key=repr)
    assert pieces.digests(docs.limit(0)).collect() == []


def test_tables_of_the_smallest_size(spark):
    """Every document of the smallest table, as the library encodes and decodes it."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not __import__("os").path.exists(path):
        pytest.skip("needs the test tables")
    rows = spark.read.parquet(path).select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op13_pieces(spark, "/root/testdata/sf0.001").collect()}
    want = {r.doc_id: (len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(i).encode()).hexdigest()) for r, i in zip(rows, theirs(r.text for r in rows))}
    assert got == want
