"""Removal of repeated word windows by recompression.

The words of a text are parsed by rounds of recompression: maximal runs of one
word become a symbol, then in each pair round a coin per symbol name (a bit of
its hash) says left or right, and a left symbol followed by a right one is
merged. Names are hashes of content, so every task gives equal symbols the same
global name without an exchange, and whether a boundary between two symbols
survives depends only on the ``REACH`` words on each side of it. Only symbols
of at most 1, 1, 2 words take part in the three pair rounds, which keeps
symbols at four words (runs aside), so each window of 13 words has a surviving
boundary whose reach lies inside the window: equal windows hold equal
boundaries with equal surroundings, wherever they stand.

Spark rounds over the corpus, each a shuffle of packed arrays:

1. the texts are packed into blocks of a few MB, a table in the shared folder;
2. each block sends the hash of the surroundings of each surviving boundary,
   once a block; what only one document has is dropped, the rest is sent back;
3. windows whose boundaries are all shared are candidates; each block sends
   their 96-bit hashes, once a block, with the smallest document that has them;
   a window that starts in a smaller document of another block is sent back;
4. the words under such windows go.

A key held by a third of all documents is one entry a block, so no group grows
beyond the number of blocks times one; buckets are cut to a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import discard, stored
from lapse.session import ship_by_value

WINDOW = 13
#: Longest symbols that each pair round merges; run round and pair rounds reach so many words in all.
ROUNDS = (1, 1, 2)
REACH = 1 + sum(ROUNDS)
#: Longest symbol but for runs; every window has a boundary this far inside.
LONGEST = 2 * max(ROUNDS)
assert 2 * REACH + LONGEST - 1 <= WINDOW  # positions REACH .. WINDOW - REACH cover one symbol

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
#: A null key: larger than any other, nothing is removed for its sake.
LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(h: np.ndarray, n: int, p: np.uint64) -> np.ndarray:
    """Hash of every run of n items, by doubling; entry i covers i .. i + n - 1."""
    power = lambda k: np.uint64(pow(int(p), k, 1 << 64))
    out, done, piece, width = None, 0, h, 1
    while done < n:
        if n & width:
            out = _join(out, done, piece, width, power)
            done += width
        if done < n:
            piece = piece[:-width] * power(width) + piece[width:]
            width *= 2
    return out


def _join(out: np.ndarray | None, done: int, piece: np.ndarray, width: int, power) -> np.ndarray:
    """Runs of ``done + width``: the first ``width`` items from ``piece``, the next ``done`` from ``out``."""
    if out is None:
        return piece
    m = len(out) - width
    return piece[:m] * power(done) + out[width: width + m]


class Block:
    """Words and parse of the texts of one block, end to end."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        from xxhash import xxh3_64_intdigest
        self.ids, self.words = ids, [t.split() for t in texts]
        size = np.array([len(w) for w in self.words], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.h = np.fromiter((x for w in self.words for x in map(xxh3_64_intdigest, w)), np.uint64, int(self.start[-1]))

    def boundaries(self) -> np.ndarray:
        """Positions i of surviving boundaries, and inside runs, with REACH words of the text on both sides."""
        n = len(self.h)
        if not n:
            return np.zeros(0, np.int64)
        first = np.zeros(n, bool)
        first[self.start[:-1][np.diff(self.start) > 0]] = True
        same = np.zeros(n, bool)
        same[1:] = (self.h[1:] == self.h[:-1]) & ~first[1:]
        at = np.flatnonzero(~same)
        name, size = self.h[at], np.diff(np.append(at, n))
        runs = size > 1
        name[runs] = _mix(name[runs] + size[runs].astype(np.uint64) * _Q)
        for k, longest in enumerate(ROUNDS):
            active, coin = size <= longest, (_mix(name + np.uint64((k + 1) * int(_P) % (1 << 64))) >> np.uint64(63)).astype(bool)
            pair = np.flatnonzero((active & ~coin)[:-1] & (active & coin & ~first[at])[1:])
            name[pair] = _mix(name[pair] * _P + name[pair + 1] + np.uint64(k))
            keep = np.ones(len(at), bool)
            keep[pair + 1] = False
            at, name = at[keep], name[keep]
            size = np.diff(np.append(at, n))
        same[at] = True
        pos = np.flatnonzero(same)
        d = self.doc[pos]
        return pos[(pos - REACH >= self.start[d]) & (pos + REACH <= self.start[d + 1])]

    def keys(self, pos: np.ndarray) -> np.ndarray:
        """Hash of the surroundings of each position."""
        return _mix(_grams(self.h, 2 * REACH, _P)[pos - REACH]) if len(pos) else np.zeros(0, np.uint64)

    def windows(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96-bit hash of the windows that begin at the given positions."""
        if not len(begin):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        high = _mix(_grams(self.h, WINDOW, _P)[begin])
        low = _mix(_grams(_mix(self.h ^ _Q), WINDOW, _Q)[begin])
        return high, (low >> np.uint64(32)).astype(np.uint32)

    def candidates(self, pos: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Beginnings of the windows all of whose boundaries are shared (each has one)."""
        n = len(self.h)
        if n < WINDOW or not shared.any():
            return np.zeros(0, np.int64)
        def upto(p):
            marks = np.zeros(n + 1, np.int32)
            marks[p + 1] = 1
            return np.cumsum(marks, dtype=np.int32)
        every, some = upto(pos), upto(pos[shared])
        begin = np.arange(n - WINDOW + 1)
        begin = begin[self.doc[begin] == self.doc[begin + WINDOW - 1]]
        a, b = begin + REACH, begin + WINDOW - REACH + 1
        got = some[b] - some[a]
        return begin[(got > 0) & (got == every[b] - every[a])]


def _pack(texts: list[bytes]) -> bytes:
    body = b"".join(texts)
    return len(body).to_bytes(8, "little") + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def _unpack(blob: bytes, lens: np.ndarray) -> list[bytes]:
    size = int.from_bytes(blob[:8], "little")
    body = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    ends = np.cumsum(lens).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def _block(row: dict) -> Block:
    return Block(np.frombuffer(row["ids"], np.int64), _unpack(row["body"], np.frombuffer(row["lens"], np.int64)))


_PACKED = "block long, ids binary, lens binary, body binary, words long"


def _packed(df: DataFrame, key: str, text: str, block_bytes: int) -> DataFrame:
    """The rows in blocks of about ``block_bytes`` of text (one row may be longer)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, k = [], [], 0, 0

        def full():
            lens = np.array([len(t) for t in texts], np.int64)
            block = (TaskContext.get().partitionId() << 32) + k
            words = sum(len(t.split()) for t in texts)
            return pa.RecordBatch.from_pylist([{"block": block, "ids": np.array(ids, np.int64).tobytes(), "lens": lens.tobytes(), "body": _pack(texts), "words": words}])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                i, t = i.as_py(), (t.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and size + len(t) > block_bytes:
                    yield full()
                    ids, texts, size, k = [], [], 0, k + 1
                ids.append(LAST if i is None else i)
                texts.append(t)
                size += len(t)
        if texts:
            yield full()

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, _PACKED)


def _codes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each key, as one number."""
    return ((keys >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))


def _by_bucket(codes: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of sorted codes by bucket."""
    bucket = (codes >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)]):
        if b > a:
            yield int(bucket[a]), slice(a, b)


def _shared_keys(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, keys): the boundary keys of each block that two documents or more have."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _block(row)
                pos = b.boundaries()
                code, doc = _codes(b.keys(pos), buckets), b.ids[b.doc[pos]] if len(pos) else pos
                order = np.argsort(code, kind="stable")
                code, doc = code[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                if not len(new):
                    continue
                several = np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)
                code = code[new]
                low = code.astype(np.uint32)
                rows = [{"bucket": k, "block": row["block"], "keys": low[s].tobytes(), "several": low[s][several[s]].tobytes()} for k, s in _by_bucket(code)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("several", pa.binary())]))

    def meet(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        several = [np.frombuffer(k, np.uint32) for k in table.column("several").to_pylist()]
        key, n = np.unique(np.concatenate(sent), return_counts=True)
        shared = np.union1d(key[n > 1], np.concatenate(several))
        back = [np.intersect1d(k, shared, assume_unique=True) for k in sent]
        keep = [i for i, k in enumerate(back) if len(k)]
        return pa.table({"block": pa.array([table.column("block")[i].as_py() for i in keep], pa.int64()), "bucket": pa.array([table.column("bucket")[i].as_py() for i in keep], pa.int32()),
                         "keys": pa.array([back[i].tobytes() for i in keep], pa.binary())})

    sent = blocks.mapInArrow(send, "bucket int, block long, keys binary, several binary")
    return sent.groupBy("bucket").applyInArrow(meet, "block long, bucket int, keys binary")


def _with_candidates(blocks: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """The blocks with ``begin``: the candidate windows of each, as positions in the block."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = [np.zeros(0, np.uint64)]
        for k, keys in zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist()):
            codes.append(np.frombuffer(keys, np.uint32).astype(np.uint64) | np.uint64(k << 32))
        known = np.sort(np.concatenate(codes))
        rows = []
        for row in left.to_pylist():
            if not len(known):
                rows.append(row | {"begin": b""})
                continue
            b = _block(row)
            pos = b.boundaries()
            code = _codes(b.keys(pos), buckets)
            shared = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
            rows.append(row | {"begin": _ranges(b.candidates(pos, shared)).tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("body", pa.binary()), ("words", pa.int64()), ("begin", pa.binary())]))

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, _PACKED + ", begin binary")


def _ranges(x: np.ndarray) -> np.ndarray:
    """Sorted positions as (from, to) pairs, end exclusive."""
    if not len(x):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(x) != 1)
    return np.stack([x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])] + 1], axis=1).astype(np.int64)


def _positions(raw: bytes) -> np.ndarray:
    r = np.frombuffer(raw, np.int64).reshape(-1, 2)
    n = r[:, 1] - r[:, 0]
    return np.repeat(r[:, 0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(r) else np.zeros(0, np.int64)


_HASH = np.dtype([("h", "<u8"), ("l", "<u4")])


def _least(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash; first of each distinct hash in that order; the smallest document of each."""
    order = np.lexsort((low, high))
    h, l = high[order], low[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])])) if len(h) else np.zeros(0, np.int64)
    return order, new, np.minimum.reduceat(doc[order], new) if len(h) else doc


def _earlier_windows(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, windows): hashes of candidate windows of a block that start in a smaller document of another block."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin = _positions(row["begin"])
                if not len(begin):
                    continue
                b = _block(row)
                high, low = b.windows(begin)
                order, new, least = _least(high, low, b.ids[b.doc[begin]])
                high, low = high[order][new], low[order][new]
                bucket = (high % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((least, bucket))
                high, low, least, bucket = high[order], low[order], least[order], bucket[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
                rows = []
                for s, e in zip(cuts, cuts[1:]):
                    ids, n = np.unique(least[s:e], return_counts=True)
                    x = np.empty(e - s, _HASH)
                    x["h"], x["l"] = high[s:e], low[s:e]
                    rows.append({"bucket": int(bucket[s]), "block": row["block"], "windows": x.tobytes(), "ids": ids.tobytes(), "n": n.astype(np.int32).tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("windows", pa.binary()), ("ids", pa.binary()), ("n", pa.binary())]))

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        x = np.concatenate([np.frombuffer(r["windows"], _HASH) for r in rows])
        doc = np.concatenate([np.repeat(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["n"], np.int32)) for r in rows])
        order, new, least = _least(x["h"], x["l"], doc)
        first = np.empty(len(x), np.int64)
        first[order] = np.repeat(least, np.diff(np.append(new, len(x))))
        back, blocks_, at = [], [], 0
        for r in rows:
            end = at + len(r["windows"]) // _HASH.itemsize
            hit = x[at:end][first[at:end] < doc[at:end]]
            if len(hit):
                back.append(hit.tobytes())
                blocks_.append(r["block"])
            at = end
        return pa.table({"block": pa.array(blocks_, pa.int64()), "windows": pa.array(back, pa.binary())})

    sent = blocks.select("block", "ids", "lens", "body", "begin").mapInArrow(send, "bucket int, block long, windows binary, ids binary, n binary")
    return sent.groupBy("bucket").applyInArrow(meet, "block long, windows binary")


def _removed(b: Block, begin: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mask of the words of a block that a repeated window covers."""
    gone = np.zeros(len(b.h) + 1, np.int32)
    if len(begin):
        high, low = b.windows(begin)
        doc = b.ids[b.doc[begin]]
        order, new, least = _least(high, low, doc)
        first = np.empty(len(begin), np.int64)
        first[order] = np.repeat(least, np.diff(np.append(new, len(begin))))
        x = np.empty(len(begin), _HASH)
        x["h"], x["l"] = high, low
        hit = begin[(first < doc) | np.isin(x["h"], known["h"]) & _isin(x, known)]
        gone[hit] += 1
        gone[hit + WINDOW] -= 1
    return np.cumsum(gone)[:-1] > 0


def _isin(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    known = known[np.lexsort((known["l"], known["h"]))]
    out = np.zeros(len(x), bool)
    left, right = np.searchsorted(known["h"], x["h"], "left"), np.searchsorted(known["h"], x["h"], "right")
    for step in range(int((right - left).max()) if len(x) else 0):  # windows that agree in the first 64 bits: one, almost always
        at = left + step
        ok = at < right
        out[ok] |= known["l"][at[ok]] == x["l"][ok]
    return out


def _cleaned(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, _HASH), *[np.frombuffer(w, _HASH) for w in right.column("windows").to_pylist()]])
        ids, words, spans, kept = [], [], [], []
        for row in left.to_pylist():
            b = _block(row)
            gone = _removed(b, _positions(row["begin"]), known)
            for d, (i, ws) in enumerate(zip(b.ids.tolist(), b.words)):
                mask = gone[b.start[d]: b.start[d + 1]]
                ids.append(None if i == LAST else i)
                words.append(len(ws))
                spans.append([{"from": s, "to": e} for s, e in _ranges(np.flatnonzero(mask)).tolist()])
                kept.append(b" ".join(compress(ws, (~mask).tolist())).decode("utf-8", "surrogatepass") if len(ws) else "")
        return pa.table({"k": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()),
                         "removed": pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), "kept": pa.array(kept, pa.string())})

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, "k long, n_words long, removed array<struct<from:int,to:int>>, kept string")


def remove_repeats(df: DataFrame, key: str, text: str = "text", block_bytes: int = 4 << 20, bucket_words: int = 2 << 20) -> DataFrame:
    """``key``, ``n_words``, ``removed`` (word ranges, end exclusive), ``n_removed`` and ``kept`` of every row.

    A word goes if a window of 13 words over it also starts in a row with a
    smaller key; windows are judged on the input. ``kept`` is what stays,
    joined by single spaces. Null and empty texts have no words; texts below
    13 words lose none; rows of one key never clean each other, so repeated
    rows are cleaned alike; a null key counts as larger than all others and
    removes nothing elsewhere; an empty table gives an empty result. Other
    columns of ``df`` are not read.
    """
    ship_by_value(__name__)
    blocks = stored(_packed(df, key, text, block_bytes), "blocks")
    words = blocks.agg(F.sum("words")).first()[0] or 0
    buckets = max(1, -(-words // bucket_words))
    found = stored(_with_candidates(blocks, _shared_keys(blocks, buckets), buckets), "candidates")
    discard(blocks)
    out = _cleaned(found, _earlier_windows(found, buckets))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return out.select(F.col("k").alias(key), "n_words", gone.alias("n_removed"), "removed", "kept")
