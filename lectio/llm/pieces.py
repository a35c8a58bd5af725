"""SentencePiece encoding and decoding of whole texts, for vocabularies of the merge type with byte fallback.

A text becomes one string of symbols: a space is put before it, U+2581 and the space are one symbol. Merging takes the
adjacent pair whose piece has the highest score, of equal scores the leftmost, until no pair is a piece. That is an agenda
of pairs ordered by score; a merge takes a pair off it and puts two new ones on.

Where no piece holds two bytes side by side nothing merges across them, so each text is cut there, exactly, and a slice's
different segments are encoded once each. The agendas of all segments with as many symbols are the rows of one matrix, whose
smallest entries go at once; segments with more symbols than ARRAY_SYMBOLS have a heap each, so that a text without any cut
costs n log n. The sentencepiece library encodes every batch's different segments too; a difference ends the job.

Defined results. A null or empty text has only the begin and end ids and decodes to an empty text. Rows that repeat a doc_id
are encoded each; no rows give no rows. Only doc_id and text are read, other columns and their names don't matter. U+2581
in a text decodes as a space, as in the library. Other kinds of models (unigram, own normalization, user-defined or unused
pieces, no byte fallback) are refused by name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lectio.llm.common import ship, table
from lectio.llm.tokens import Merges, binary_parts, slices

MARK = "▁"
ARRAY_SYMBOLS = 48
#: So many segments go to the library in one text
CHECKED_AT_ONCE = 2000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: number, and value as a number or bytes."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            octet = data[i]
            i += 1
            out |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return out

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[i : i + n]
        i += n


class Pairs(Merges):
    """The pairs of symbols that are pieces, by score: its hash table, and the agendas of many segments at once."""

    def __init__(self, pieces: dict[str, int], score: dict[str, float], symbol):
        ranked = {s: k for k, s in enumerate(sorted({score[p] for p in pieces}, reverse=True))}
        found = {}
        for p, made in pieces.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = (ranked[score[p]], made)
        keys = np.array(list(found), np.int64)
        value = np.array(list(found.values()), np.int64).reshape(-1, 2)
        self.of_rank, self.pair_made = value[:, 0].astype(np.int32), value[:, 1].astype(np.int32)
        self.place(keys)

    def place(self, keys: np.ndarray) -> None:
        """An open hash table from pair to its number."""
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 8))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, self.NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.key[slot] == -1)
            at, first = np.unique(slot[free], return_index=True)
            self.key[at], self.rank[at] = keys[left[free[first]]], left[free[first]]
            stays = np.ones(len(left), bool)
            stays[free[first]] = False
            left, slot = left[stays], (slot[stays] + 1) & ((1 << self.bits) - 1)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair's piece (NONE where it is none), and the piece."""
        number = self.ranks(a, b)
        there = number != self.NONE
        rank, made = np.full(len(number), self.NONE, np.int32), np.zeros(len(number), np.int32)
        rank[there], made[there] = self.of_rank[number[there]], self.pair_made[number[there]]
        return rank, made

    def matrix(self, s: np.ndarray):
        """(rows, symbols) of segments of as many symbols, once no pair is left on their agendas."""
        rows, n = np.arange(len(s)), s.shape[1]
        r, m = (x.reshape(len(s), n - 1) for x in self.look(s[:, :-1].ravel(), s[:, 1:].ravel()))
        while len(rows) and n > 1:
            k = np.arange(len(rows))
            at = r.argmin(axis=1)
            go = r[k, at] != self.NONE
            if not go.all():
                yield rows[~go], s[~go]
                rows, s, r, m, at = rows[go], s[go], r[go], m[go], at[go]
                k = np.arange(len(rows))
            if not len(rows):
                return
            s[k, at] = m[k, at]
            keep = np.ones(s.shape, bool)
            keep[k, at + 1] = False
            n -= 1
            s = s[keep].reshape(len(k), n)
            if n == 1:
                break
            keep = np.ones(r.shape, bool)
            keep[k, at] = False
            r, m = r[keep].reshape(len(k), n - 1), m[keep].reshape(len(k), n - 1)
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1], m[left, at[left] - 1] = self.look(s[left, at[left] - 1], s[left, at[left]])
            right = np.flatnonzero(at < n - 1)
            r[right, at[right]], m[right, at[right]] = self.look(s[right, at[right]], s[right, at[right] + 1])
        if len(rows):
            yield rows, s

    def heap(self, s: np.ndarray) -> np.ndarray:
        """The symbols of one long segment: a heap of (rank, place) with the pairs as they were when they were put on it."""
        n = len(s)
        rank, made = (x.tolist() for x in self.look(s[:-1], s[1:]))
        symbol, after, before = s.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, k, symbol[k], symbol[k + 1], m) for k, (r, m) in enumerate(zip(rank, made)) if r != self.NONE]
        heapq.heapify(agenda)
        while agenda:
            _, k, a, b, m = heapq.heappop(agenda)
            nxt = after[k]
            if symbol[k] != a or nxt >= n or symbol[nxt] != b:
                continue  # one of the two is merged meanwhile
            symbol[k], symbol[nxt] = m, -1
            after[k] = far = after[nxt]
            if far < n:
                before[far] = k
            for i, j in ((before[k], k), (k, far)):
                if i >= 0 and j < n:
                    r, more = self.one(symbol[i], symbol[j])
                    if r is not None:
                        heapq.heappush(agenda, (r, i, symbol[i], symbol[j], more))
        out = np.array(symbol, np.int64)
        return out[out >= 0]

    def one(self, a: int, b: int) -> tuple[int | None, int]:
        if not hasattr(self, "by_pair"):
            there = self.key != -1
            number = self.rank[there]
            self.by_pair = dict(zip(self.key[there].tolist(), zip(self.of_rank[number].tolist(), self.pair_made[number].tolist())))
        return self.by_pair.get(a << 32 | b, (None, 0))


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.vocab_size()
        self.n = n
        trainer, norm = {}, {}
        for k, v in fields(sp.serialized_model_proto()):
            if k == 2:
                trainer |= dict(fields(v))
            elif k == 3:
                norm |= dict(fields(v))
        kinds = {i: "byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "piece" for i in range(n)}
        types = [dict(fields(v)).get(3, 1) for k, v in fields(sp.serialized_model_proto()) if k == 1]
        pieces = {sp.id_to_piece(i).replace(MARK, " "): i for i in range(n) if kinds[i] == "piece"}
        for wrong, what in (
            (trainer.get(3, 1) != 2, "pieces that don't come from merges"),
            (not trainer.get(35, 0), "no byte fallback"),
            (trainer.get(24, 0), "white space as a suffix"),
            (bool(norm.get(2, b"")) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1), "a normalization of its own"),
            (4 in types or "unused" in kinds.values(), "user-defined or unused pieces"),
            (any(" " in p.lstrip(" ") for p in pieces) or any(" " in sp.id_to_piece(i) for i in range(n)), "pieces across words"),
        ):
            if wrong:
                raise ValueError(f"{path}: a model with {what} is not supported")
        score = {p: sp.get_score(i) for p, i in pieces.items()}
        self.pairs = Pairs(pieces, score, lambda s: pieces.get(s, n + ord(s) if len(s) == 1 else None))
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.of_byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)  # characters that are no piece are symbols of their own
        for p, i in pieces.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        beside = np.zeros((256, 256), bool)
        for p in pieces:
            b = np.frombuffer(p.encode(), np.uint8)
            beside[b[:-1], b[1:]] = True
        beside[:, 0x80:0xC0] = True  # never within a character
        self.beside = beside.ravel()
        alone = [b for b in range(1, 128) if not beside[b].any() and not beside[:b, b].any() and not beside[b:, b].any()]
        free = [b for b in range(1, 128) if not beside[b, :0x80].any() and not beside[b, 0xC0:].any() and not beside[:, b].any()]
        self.guard = chr((alone or free or [0])[0])
        unknown = trainer.get(44, b" \xe2\x81\x87 ").decode()
        surface = [b""] * n
        for i in range(n):
            surface[i] = sp.id_to_piece(i).replace(MARK, " ").encode() if kinds[i] == "piece" else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if kinds[i] == "byte" else unknown.encode() if kinds[i] == "unknown" else b""
        self.surface = pa.array(surface, pa.large_binary())
        self.control = np.array([kinds[i] == "control" for i in range(n)])
        self.marked = np.array([kinds[i] == "piece" and s[:1] == b" " for i, s in enumerate(surface)])
        self.plain = np.array([kinds[i] in ("piece", "control") for i in range(n)])

    # --- encoding ---

    def encode(self, texts: pa.Array, check: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with begin and end ids; where each text starts, and the end."""
        texts = pc.fill_null(texts, "")
        if pc.any(pc.match_substring(texts, MARK)).as_py():
            texts = pc.replace_substring(texts, MARK, " ")
        full = pc.not_equal(pc.binary_length(texts), 0)
        begin, data = binary_parts(pc.if_else(full, pc.binary_join_element_wise(" ", texts, ""), texts))
        new = np.ones(len(data), bool)
        if len(data):
            new[1:] = ~self.beside[data[:-1].astype(np.uint16) << 8 | data[1:]]
            new[begin[:-1][begin[:-1] < begin[1:]]] = True
        at = np.flatnonzero(new)
        edge = np.append(at, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids, first, size = self.segments(coded.dictionary)
        if check:
            self.checked(coded.dictionary, ids, first, size)
        ids = np.concatenate([ids, np.array([self.bos, self.eos], np.int32)])
        first, size = np.append(first, [len(ids) - 2, len(ids) - 1]), np.append(size, [1, 1])
        upto = np.searchsorted(at, begin)
        which = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(upto, 2)[1:-1], np.tile([len(size) - 2, len(size) - 1], len(texts)))
        n = size[which]
        ends = np.cumsum(n)
        take = np.repeat(first[which] - (ends - n), n) + np.arange(int(n.sum()))
        return ids[take], np.concatenate([[0], ends[upto[1:] + 2 * np.arange(1, len(texts) + 1) - 1]]) if len(texts) else np.zeros(1, np.int64)

    def segments(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of different segments, and where in them each one's begin and how many they are."""
        begin, data = binary_parts(segments)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        start = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[begin]
        symbols, length = self.of_char[code], np.diff(start)
        size, found = np.zeros(len(length), np.int64), []
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            if n > ARRAY_SYMBOLS:
                parts = ((rows[k : k + 1], self.pairs.heap(symbols[start[r] : start[r] + n])[None, :]) for k, r in enumerate(rows.tolist()))
            else:
                parts = ((rows[k], s) for k, s in self.pairs.matrix(symbols[start[rows][:, None] + np.arange(n)]))
            for k, s in parts:
                strange = (s >= self.n).any(axis=1)
                size[k[~strange]] = s.shape[1]
                found.append((k[~strange], s[~strange]))
                for r, one in zip(k[strange].tolist(), s[strange].tolist()):
                    ids = np.array([i for x in one for i in ([x] if x < self.n else self.of_byte[list(chr(x - self.n).encode())].tolist())])
                    size[r] = len(ids)
                    found.append((np.array([r]), ids[None, :]))
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        for rows, ids in found:
            out[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, first, size

    def checked(self, segments: pa.Array, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Raises where the library gives other ids: it encodes the segments in a row, with a character between them that
        merges with nothing."""
        if self.guard == "\0":
            return  # every character merges with some other
        guard = self.of_byte[ord(self.guard)] if self.of_char[ord(self.guard)] >= self.n else self.of_char[ord(self.guard)]
        lead = self.library.encode(self.guard)  # the space put before a text, and the guard
        for k in range(0, len(segments), CHECKED_AT_ONCE):
            some = segments.slice(k, CHECKED_AT_ONCE)
            text = (self.guard.encode() + self.guard.encode().join(some.to_pylist())).decode()
            stop = k + len(some)
            own = np.insert(ids[first[k] : first[stop - 1] + size[stop - 1]], first[k + 1 : stop] - first[k], guard)
            theirs = np.array(self.library.encode(text, num_threads=1), np.int32)[len(lead) :]
            if not np.array_equal(own, theirs):
                raise AssertionError("the sentencepiece library encodes a segment otherwise")

    # --- decoding ---

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts (UTF-8) of rows of ids that start at `at`. Rows whose first piece is no plain one, or that hold bytes
        which are no UTF-8, are left to the library."""
        shown = self.surface.take(pa.array(ids))
        _, offsets, data = shown.buffers()
        edge = np.frombuffer(offsets, np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        octets = bytes(memoryview(data)[: edge[-1]]) if data is not None else b""
        texts = ~self.control[ids]
        following = np.append(np.flatnonzero(texts), len(ids))
        lead = following[np.searchsorted(following, at[:-1])] if len(at) > 1 else np.zeros(0, np.int64)
        out = []
        for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), lead.tolist()):
            if k >= b:
                out.append(b"")
                continue
            text = octets[edge[a] : edge[b]]
            good = self.plain[ids[k]]
            if good and not text.isascii():
                try:
                    text.decode()
                except UnicodeDecodeError:
                    good = False
            out.append(text[1:] if good and self.marked[ids[k]] else text if good else self.library.decode(ids[a:b].tolist()).encode())
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, path: str | None = None, check: bool = True) -> DataFrame:
    """doc_id and ids (array of int) of each text, with begin and end ids."""
    ship()
    path, kind = path or default_path(), docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = codec(path).encode(batch.column("text"), check)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of ids (null: empty)."""
    ship()
    path, kind = path or default_path(), rows.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = codec(path).decode(ids, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str | None = None, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, only digests leave the task."""
    ship()
    path, kind = path or default_path(), docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                c = codec(path)
                ids, at = c.encode(batch.column("text"), check)
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in c.decode(ids, at)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
