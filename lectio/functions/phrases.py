"""Phrases found in texts: fixed substrings, and lists of word sequences as an index of hashed n-grams.

A short fixed list is a chain of substring searches. A list that comes from data is an index: of each phrase the hash of its first
words; a text is looked through once, its n-grams' hashes are cut down to those of the index before anything is exploded, and
what meets is compared in full. The index goes into the plan up to MOST hashes, counted first; a larger one is joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.functions.text import contains_any, folded

MOST = 20_000


def has_phrase(c: Column, phrases: Iterable[str]) -> Column:
    """Whether a text holds one of a fixed list of phrases, letter by letter."""
    return F.coalesce(contains_any(c, phrases), F.lit(False))


def starts_with_phrase(c: Column, phrases: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | F.startswith(c, F.lit(p))
    return F.coalesce(found, F.lit(False))


def grams(words: Column, n: int) -> Column:
    """The hashes of all n words in a row of an array, in order."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(n))))
    return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<bigint>"))


class PhraseIndex:
    """Phrases (id, phrase: words with one space between them, not empty) by the hash of their first `words` words, all of them
    where a phrase has fewer."""

    def __init__(self, phrases: DataFrame, words: int = 5):
        split = F.split("phrase", " ")
        k = F.least(F.size(split), F.lit(words))
        self.phrases = phrases.select("id", "phrase", k.alias("k"), F.xxhash64(F.slice(split, F.lit(1), k)).alias("h"))
        found = self.phrases.groupBy("k", "h").count().limit(MOST + 1).collect()
        self.small = len(found) <= MOST
        self.hashes = sorted({r["h"] for r in found}) if self.small else []
        self.lengths = sorted({r["k"] for r in found}) if self.small else list(range(1, words + 1))

    def found(self, texts: DataFrame, key: str) -> DataFrame:
        """id and key of each text (key, text: words with one space between them) that holds a phrase as words in a row."""
        texts = texts.select(key, "text", F.explode(F.array(F.split("text", " "))).alias("words"))  # a generator: split once
        words = F.col("words")
        hashes = F.array_distinct(F.flatten(F.array(*(grams(words, k) for k in self.lengths)))) if self.lengths else F.array().cast("array<bigint>")
        if self.small:  # the list goes into the plan once, as one constant
            index = F.from_json(F.lit(str(self.hashes)), "array<bigint>")
            hashes = F.array_intersect(hashes, index)
        met = texts.select(key, "text", F.explode(hashes).alias("h")) if self.small else texts.select(key, F.explode(hashes).alias("h"))
        met = met.join(self.phrases.select("id", "phrase", "h"), "h")
        if not self.small:  # texts meet again only with what they share a hash with
            met = met.select(key, "id", "phrase").distinct().join(texts.select(key, "text"), key)
        spaced = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
        return met.filter(F.contains(spaced("text"), spaced("phrase"))).select("id", key)


def folded_has_phrase(c: Column, phrases: Iterable[str]) -> Column:
    return has_phrase(folded(c), phrases)
