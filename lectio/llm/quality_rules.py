"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. What it measured and whether it failed (one bit a rule) go into a
ledger; a policy is a versioned set of bits that is applied to the ledger afterwards, so that another policy, or the
question what a policy would keep without one of its rules, never reads the texts again.

Rows: the ledger has one row for each input row, repeated doc_ids included. A null or empty text has no words, all its
measurements are 0 and it fails `few_words`. A null doc_id stays null. Only `doc_id` and `text` are read, whatever other
columns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectio.llm.common import ship, table, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_shouted")
SYMBOLS = b"#*$%&|<>"

#: Rules by bit. A rule fails where the SQL expression over the measurements is true.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "shouting": "2 * n_shouted > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Policies by version: the rules that they hold a document to. Versions are never edited, only added.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "shouting", "word_length"),
    "web-2": tuple(RULES),
}
PRODUCTION = "web-1"


def policy_mask(policy: str | Iterable[str]) -> int:
    rules = POLICIES[policy] if isinstance(policy, str) else tuple(policy)
    return sum(BIT[r] for r in set(rules))


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text, in that order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    joined = b"".join(words)
    # code points: every byte but the continuation bytes 10xxxxxx
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), len(lines), repeated(words), sum(map(shouted, words))


def shouted(word: bytes) -> bool:
    """A word that ends in two exclamation marks."""
    return word.endswith(b"!!")


def repeated(words: list) -> int:
    """How many of the words lie in a window of three words that the text has at least twice."""
    n = len(words)
    if n < 4:  # two different windows need four words
        return 0
    number: dict = {}
    c = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    pairs = c[:-1] * len(number) + c[1:]
    if len(number) > 2_000_000:  # three numbers of 21 bits fill the 63 that there are
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(number) + c[2:], return_inverse=True, return_counts=True)
    twice, inside = count[at] > 1, np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def measures() -> Column:
    """A struct of MEASURES of the column `text`."""
    ship()

    @F.arrow_udf("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    def lectio_measures(texts: pa.Array) -> pa.Array:
        rows = np.array([measure(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(MEASURES))], list(MEASURES))

    return lectio_measures("text")


FAILURES = " | ".join(f"IF({rule}, {BIT[name]}L, 0L)" for name, rule in RULES.items())


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and failure_bits (long, bit k: rule k of RULES failed), a row for each row of docs; stored."""
    measured = docs.select("doc_id", measures().alias("m")).select("doc_id", "m.*")
    return written(measured.withColumn("failure_bits", F.expr(FAILURES)), "ledger")


def judged(docs: DataFrame) -> DataFrame:
    """docs with their row of the ledger in the column lectio_ledger__ (MEASURES and failure_bits), stored, so that any
    policy can be applied to it later."""
    bits = FAILURES
    for name in MEASURES:
        bits = re.sub(rf"\b{name}\b", f"lectio_m__.{name}", bits)
    found = docs.withColumn("lectio_m__", measures())
    row = F.struct(*(F.col(f"lectio_m__.{m}").alias(m) for m in MEASURES), F.expr(bits).alias("failure_bits"))
    return written(found.withColumn("lectio_ledger__", row).drop("lectio_m__"), "judged")


def verdict(bits: Column, policy: str | Iterable[str]) -> Column:
    """True where no rule of the policy failed."""
    return bits.bitwiseAND(F.lit(policy_mask(policy))) == 0


def ablation(of: DataFrame, policy: str | Iterable[str]) -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_failed_alone (what the policy would keep without the rule).

    The ledger is first counted by its bits, at most 2 ** len(RULES) rows, whatever its size.
    """
    mask = policy_mask(policy)
    by_bits = of.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(b).alias("bit")) for k, b in BIT.items() if b & mask)))
    return (
        by_bits.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        )
    )


def keep(docs: DataFrame, policy: str | Iterable[str] = PRODUCTION) -> DataFrame:
    """The rows of docs that the policy keeps, with the columns that docs has: the policy applied to the ledger."""
    return judged(docs).filter(verdict(F.col("lectio_ledger__.failure_bits"), policy)).drop("lectio_ledger__")


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """policy, rule, n_failed and n_failed_alone for all policies, from one ledger."""
    of = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = [ablation(of, p).select(F.lit(p).alias("policy"), "rule", "n_failed", "n_failed_alone") for p in POLICIES]
    return reduce(DataFrame.unionByName, found)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger(table(spark, sf_dir, "documents"))
    base = ~verdict(F.col("failure_bits"), "base-1")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & verdict(F.col("failure_bits"), PRODUCTION)).alias("kept"), "failure_bits",
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS word2, lead(word, 2) OVER o AS word3 FROM w
      WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, word2, word3) AS c FROM g WHERE word3 IS NOT NULL),
p AS (SELECT DISTINCT r, i + k AS i FROM t, (VALUES (0), (1), (2)) AS s(k) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM p GROUP BY r),
wm AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars,
              count(*) FILTER (word LIKE '%!!') AS n_shouted FROM w GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lm AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_shouted, 0) AS n_shouted, coalesce(n_lines, 0) AS n_lines
      FROM d LEFT JOIN wm USING (r) LEFT JOIN lm USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
               + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
               + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
               + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
               + CASE WHEN 2 * n_shouted > n_words THEN 16 ELSE 0 END
               + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failure_bits & 3 <> 0 AS base_failed,
       failure_bits & 55 = 0 AS kept, failure_bits FROM b
"""
ABLATION_ORACLE = f"""
WITH bits AS (SELECT failure_bits AS f FROM ({ORACLE})),
p(policy, mask) AS (VALUES {", ".join(f"('{p}', {policy_mask(p)})" for p in POLICIES)}),
r(rule, bit) AS (VALUES {", ".join(f"('{k}', {b})" for k, b in BIT.items())})
SELECT policy, rule, count(f) FILTER (f & bit <> 0) AS n_failed, count(f) FILTER (f & mask = bit) AS n_failed_alone
FROM p JOIN r ON mask & bit <> 0 LEFT JOIN bits ON true GROUP BY policy, rule
"""
