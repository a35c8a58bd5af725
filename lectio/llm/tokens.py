"""Token ids of whole texts by a public tokenizer file, from its words.

A tokenizer that drops white space gives a text the ids of its words, one after the other. Words repeat far more often
than texts, so each slice is split and dictionary-encoded by Arrow. Its different words are cut into pieces by classes of
bytes and the different pieces merged by array operations, all pieces of one length at once; the ids are put together the
same way. Only words with other characters than PLAIN, or that may hold a contraction or a special token, go through the
tokenizer itself; of these a worker remembers a bounded number, and those met again since the last half was let go stay.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pipeline for which word by word is known to be right.
WORD_PRE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORM = ["NFC", "Replace", "Lowercase"]
#: Words of these characters only: lower() and the pattern act on them as the tokenizer's own steps do.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
REMEMBERED = 100_000
SLICE_BYTES = 4 << 20
#: Pieces of up to so many bytes are merged by array operations, longer ones by the tokenizer
ARRAY_BYTES = 32


def byte_letters() -> dict[int, str]:
    """Byte-level alphabets write a byte as itself where Latin-1 prints it, the others as the letters from U+0100 on."""
    printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printed else chr(next(rest)) for b in range(256)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory:
    """A dictionary of at most `most` entries, in two halves: when the newer one is full, the older one goes."""

    def __init__(self, most: int):
        self.half, self.new, self.old = max(most // 2, 1), {}, {}

    def get(self, key: str, make: Callable[[str], bytes]) -> bytes:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = make(key)
            if len(self.new) >= self.half:
                self.old, self.new = self.new, {}
            self.new[key] = found
        return found


class Merges:
    """Byte pair merges of many pieces at once. A round merges the pair of lowest rank, the leftmost of equal ones, of every
    piece that has one; pieces that began with as many bytes then still have as many symbols."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, vocab: dict[str, int], merges: list, letters: dict[int, str], suffix: str):
        self.inner = np.array([vocab.get(letters[b], 0) for b in range(256)], np.int32)
        self.last = np.array([vocab.get(letters[b] + suffix, 0) for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # a hash table with the next slot where one is taken: key and rank
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 8))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, self.NONE, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.key[slot] == -1)
            at, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.key[at], self.rank[at] = keys[left[placed]], left[placed]
            stays = np.ones(len(left), bool)
            stays[placed] = False
            left, slot = left[stays], (slot[stays] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, NONE where they don't merge."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        seen = self.key[slot]
        out = np.where(seen == keys, self.rank[slot], self.NONE)
        left = np.flatnonzero((seen != keys) & (seen != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            seen = self.key[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.rank[slot[left[hit]]]
            left = left[~hit & (seen != -1)]
        return out

    def of_length(self, octets: np.ndarray):
        """(rows, symbols) of pieces (rows of as many bytes), once they are merged."""
        rows, n = np.arange(len(octets)), octets.shape[1]
        s = self.inner[octets]
        s[:, -1] = self.last[octets[:, -1]]
        r = self.ranks(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(s), n - 1)
        while len(rows) and s.shape[1] > 1:
            at = r.argmin(axis=1)
            k = np.arange(len(rows))
            low = r[k, at]
            go = low != self.NONE
            if not go.all():
                yield rows[~go], s[~go]
                rows, s, r, at, low = rows[go], s[go], r[go], at[go], low[go]
                k = np.arange(len(rows))
            if not len(rows):
                return
            n = s.shape[1]
            s[k, at] = self.made[low]
            keep = np.ones(s.shape, bool)
            keep[k, at + 1] = False
            s = s[keep].reshape(len(k), n - 1)
            if n == 2:
                break
            keep = np.ones(r.shape, bool)
            keep[k, at] = False
            r = r[keep].reshape(len(k), n - 2)
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1] = self.ranks(s[left, at[left] - 1], s[left, at[left]])
            right = np.flatnonzero(at < n - 2)
            r[right, at[right]] = self.ranks(s[right, at[right]], s[right, at[right] + 1])
        if len(rows):
            yield rows, s


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte of PLAIN words its class (0 letter, 1 digit, 2 else) and its lower case, letters beyond ASCII aside."""
    kind, lower = np.full(256, 2, np.uint8), np.arange(256, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1] = kind[ord("A") : ord("Z") + 1] = 0
    kind[0x80:] = 0  # of two bytes, the first is 0xC3
    kind[ord("0") : ord("9") + 1] = 1
    lower[ord("A") : ord("Z") + 1] += 32
    return kind, lower


KIND, LOWER = tables()


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = tuple(t["content"] for t in spec.get("added_tokens", ()))
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        self.by_word = (
            [n.get("type") for n in norm.get("normalizers", ())] == WORD_NORM
            and [p.get("type") for p in pre.get("pretokenizers", ())] == ["Split", "ByteLevel"]
            and pre["pretokenizers"][0]["pattern"].get("Regex") == WORD_PRE
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ()))
            and spec["model"]["type"] == "BPE"
        )
        self.letters = {b: c for b, c in byte_letters().items()}
        self.any_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.words = Memory(REMEMBERED)
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], self.letters, spec["model"].get("end_of_word_suffix") or "") if self.by_word else None

    def full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def piece(self, piece: bytes) -> bytes:
        seen = piece.decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(seen)], self.dtype).tobytes()

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and not self.any_special.search(word):
            return b"".join([self.piece(p.encode()) for p in PIECE.findall(word.lower())])
        return self.full(word) if word else b""

    def plain(self, words: pa.Array) -> np.ndarray:
        """Which words are cut right by classes of bytes: PLAIN ones without an apostrophe or the beginning of a special token."""
        ok = pc.match_substring_regex(words, r"^[!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$")
        for mark in {"'", *(t[:2] for t in self.special if t)}:
            ok = pc.and_not(ok, pc.match_substring(words, mark))
        return ok.to_numpy(zero_copy_only=False)

    def by_arrays(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, one after the other, and how many each has."""
        begin, data = binary_parts(words)
        kind, octets = KIND[data], LOWER[data]
        wide = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
        octets[wide] += np.where(data[wide] < 0x9F, np.uint8(32), np.uint8(0))  # U+00C0 to U+00DE
        new = np.empty(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        new[begin[:-1]] = True
        at = np.flatnonzero(new)
        edge = np.append(at, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edge), pa.py_buffer(octets)]).dictionary_encode()
        ids, first, size = self.merged(pieces.dictionary)
        which = pieces.indices.to_numpy()
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])
        edges = upto[np.searchsorted(at, begin)]  # words begin with a piece
        return ids[take], np.diff(edges)

    def merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and where in them each piece's begin and how many they are."""
        begin, data = binary_parts(pieces)
        length = np.diff(begin)
        size, found = np.zeros(len(length), np.int64), []
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            if n > ARRAY_BYTES:
                for r in rows.tolist():
                    ids = np.frombuffer(self.piece(data[begin[r] : begin[r] + n].tobytes()), self.dtype)
                    size[r] = len(ids)
                    found.append((np.array([r]), ids[None, :]))
                continue
            for k, ids in self.merges.of_length(data[begin[rows][:, None] + np.arange(n)]):
                size[rows[k]] = ids.shape[1]
                found.append((rows[k], ids))
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), self.dtype)
        for rows, ids in found:
            out[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, first, size

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of different words, and where in them each word's begin and how many they are."""
        plain = self.plain(words)
        ids, n = self.by_arrays(words.filter(pa.array(plain)))
        size = np.zeros(len(words), np.int64)
        size[plain] = n
        first = np.zeros(len(words), np.int64)
        first[plain] = np.cumsum(n) - n
        rest = [self.words.get(w, self.word) for w in words.filter(pa.array(~plain)).to_pylist()]
        more = np.array([len(x) for x in rest], np.int64) // self.dtype.itemsize
        size[~plain] = more
        first[~plain] = len(ids) + np.cumsum(more) - more
        return np.concatenate([ids, np.frombuffer(b"".join(rest), self.dtype)]), first, size

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), each followed by the id `end`; where each text starts, and the end."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            parts = [self.full(t) for t in texts.to_pylist()]
            last = np.array([end], self.dtype).tobytes()
            ids = np.frombuffer(b"".join(x for p in parts for x in (p, last)), self.dtype)
            return ids, np.concatenate([[0], np.cumsum([len(p) // self.dtype.itemsize + 1 for p in parts])]).astype(np.int64)
        # positions in 32 bits where the ids surely fit: at most one a byte of normalised text, three times as long at worst, and one a text
        kind = np.int32 if (pc.sum(pc.binary_length(texts)).as_py() or 0) + len(texts) < 1 << 29 else np.int64
        split = pc.ascii_split_whitespace(texts)
        of_text = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        source, begin, size = self.ids_of(coded.dictionary)
        source = np.append(source, np.array([end], self.dtype))
        begin, size = np.append(begin, len(source) - 1).astype(kind), np.append(size, 1).astype(kind)
        ends = np.cumsum(of_text)
        words = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(size) - 1)
        del split, coded
        n = size[words]
        upto = np.cumsum(n, dtype=kind)
        at = np.repeat(begin[words] - (upto - n), n)
        at += np.arange(len(at), dtype=kind)
        return source[at], np.concatenate([[0], upto[ends + np.arange(len(ends))]]).astype(np.int64) if len(ends) else np.zeros(1, np.int64)


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each of the strings (none null) starts, and the end; their bytes."""
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(1, np.int64)
    octets = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data is not None else np.zeros(0, np.uint8)
    return begin - begin[0], octets


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: str):
    """The batch in pieces of about SLICE_BYTES of text, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
