"""Token ids as directly addressable codes in segment files.

Texts in ascending key order are encoded to token ids, an end id after each,
and the ids are written in segments. A segment is a self-contained byte string:

    magic "DAC1", number of ids, number of levels, then per level
    entries, chunk bytes, continuation bitmap, rank directory

Level 0 holds the low 8 bits of every id; the bitmap marks the ids that go on
in the next level, where the next 8 bits of just those stand, and so on. The
rank directory counts the marks before every 512 entries, so that the place of
an id in the next level is one look-up and a count within 64 bytes: any token
is read without decoding its neighbours.

The rows are dealt by key ranges, sorted inside, and encoded in one pass; the segment table (in key order, with document
ends) is written through Spark and read back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import stored, worker_memo
from lapse.session import ship_by_value

MAGIC = b"DAC1"
CHUNK = 8
STEP = 512  # entries between two ranks of the directory
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dac_encode(ids: np.ndarray) -> bytes:
    """The segment of an array of ids (any unsigned 32-bit integers)."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest >> np.uint32(CHUNK) > 0
        bits = np.packbits(more, bitorder="little")
        steps = np.add.reduceat(_ONES[bits].astype(np.uint32), np.arange(0, len(bits), STEP // 8)) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(steps)]).astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint32(255)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(CHUNK)
    return MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


class DacReader:
    """Random access to the ids of one segment."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.n, levels = struct.unpack_from("<QI", raw, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            chunks = np.frombuffer(raw, np.uint8, n, at + 8)
            bits = np.frombuffer(raw, np.uint8, (n + 7) // 8, at + 8 + n)
            size = -(-len(bits) // (STEP // 8)) + 1
            ranks = np.frombuffer(raw, "<u4", size, at + 8 + n + len(bits))
            at += 8 + n + len(bits) + 4 * size
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            start = i // STEP
            before = bits[start * STEP // 8: i >> 3]
            i = int(ranks[start]) + int(_ONES[before].sum()) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(CHUNK * k)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


#: White space as the pre-tokenizer of byte-level BPE sees it.
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Latin letters, each certainly a letter to the pre-tokenizer; a run of them ends where no other letter can follow.
_LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_MAYBE_LETTERS = "\\xaa\\xb5\\xba\\u0250-\\U0010ffff"


class Encoder:
    """Byte-level BPE of the tokenizers library with a bounded memo of pieces.

    The pre-tokenizer never joins text across the start or end of a run of
    letters with at most one space before it, nor across white space; such
    pieces are encoded on their own, each once, by the library, and a text is
    the concatenation of its pieces' ids. Texts that hold the name of an added token are given to
    the library whole."""

    def __init__(self, file: str, most: int = 1_000_000):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(file)
        self.pieces = re.compile(f" ?[{_LETTERS}]++(?![{_MAYBE_LETTERS}])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.code, self.flat, self.bounds = {}, [np.zeros(0, np.uint32)], np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces: one to a line in a single text, as a line end between two pieces is a token of its own;
        white space, and all if the vocabulary has no such token, one by one."""
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        blank = [p for p in pieces if p.isspace() or "\n" in p or len(line) != 1]
        lines = sorted(set(pieces).difference(blank))
        groups = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(blank, add_special_tokens=False)]
        if lines:
            (e,) = self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == line[0]), len(ids))
            assert len(ends) == len(lines)
            flat, sizes = ids[ids != line[0]], np.diff(np.concatenate([[-1], ends])) - 1
        else:
            flat, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat, sizes = np.concatenate([*groups, flat]), np.concatenate([[len(g) for g in groups], sizes]).astype(np.int64)
        n = len(self.code)
        self.code.update(zip([*blank, *lines], range(n, n + len(sizes))))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.flat.append(flat)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; pieces that are new are learnt in one call."""
        cut = [None if any(a in t for a in self.added) else self.pieces.findall(t) for t in texts]
        fresh = {p for ps in cut if ps for p in ps}.difference(self.code)
        if len(self.code) + len(fresh) > self.most and self.code:
            self._clear()
            fresh = {p for ps in cut if ps for p in ps}
        if fresh:
            self._learn(sorted(fresh))
            self.flat = [np.concatenate(self.flat)]
        out = []
        for t, ps in zip(texts, cut):
            if ps is None:
                out.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            code = np.fromiter(map(self.code.__getitem__, ps), np.int64, len(ps))
            first = self.bounds[code]
            n = self.bounds[code + 1] - first
            out.append(self.flat[0][np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def write_segments(df: DataFrame, key: str, text: str, tokenizer_file: str, end_id: int, parts: int, segment_ids: int = 1 << 20) -> DataFrame:
    """The segment table: ``part``, ``seg``, ``keys``, ``ends`` (of each row's ids in the segment), ``payload``; stored and read back.

    A row stays in one segment, so a segment of one very long text may be larger."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    # rows of one key are ordered by their text's hash: reruns agree, and a hot key is spread over ranges too
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(parts, F.col("k").asc_nulls_first(), "h")
    rows = rows.sortWithinPartitions(F.col("k").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = worker_memo()
        encoder = memo.get(("encoder", tokenizer_file))
        if encoder is None:
            encoder = memo[("encoder", tokenizer_file)] = Encoder(tokenizer_file)
        keys, ids, size, seg, now = [], [], 0, 0, TaskContext.get().partitionId()

        def full():
            ends = np.cumsum([len(i) for i in ids]).tolist()
            return pa.RecordBatch.from_pylist([{"part": now, "seg": seg, "keys": keys, "ends": ends, "payload": dac_encode(np.concatenate(ids))}], schema=schema)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for k, x in zip(part.column(0).to_pylist(), encoder.encode_all(part.column(1).to_pylist())):
                    if size >= segment_ids:
                        yield full()
                        keys, ids, size, seg = [], [], 0, seg + 1
                    keys.append(k)
                    ids.append(np.append(x, np.uint32(end_id)))
                    size += len(ids[-1])
        if keys:
            yield full()

    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("keys", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("payload", pa.binary())])
    ship_by_value(__name__)
    ship_by_value("lapse.llm.common")
    return stored(rows.select("k", "t").mapInArrow(run, "part int, seg int, keys array<long>, ends array<long>, payload binary"), "tokens")


def read_rows(segments: DataFrame, key: str) -> DataFrame:
    """``key``, ``start``, ``n_tokens``, ``ids_crc32`` of every row, decoded from the segments.

    ``start`` counts the ids of all rows before: totals of the segments before
    (running sums inside a part, and over the parts) plus what precedes in the
    segment."""
    size = F.coalesce(F.element_at("ends", -1), F.lit(0).cast("long"))
    narrow = segments.select("part", "seg", size.alias("n"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = narrow.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(over), F.lit(0).cast("long")).alias("base"))
    starts = (narrow.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0).cast("long"))).join(parts, "part")
                    .select("part", "seg", (F.col("base") + F.col("within")).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32
        for b in batches:
            for row in b.to_pylist():
                ids = DacReader(row["payload"]).all().astype("<u4")
                first = [0, *row["ends"][:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(first), pa.int32()), pa.array([row["seg"]] * len(first), pa.int32()), pa.array(row["keys"], pa.int64()), pa.array(first, pa.int64()),
                     pa.array([e - s for s, e in zip(first, row["ends"])], pa.int64()), pa.array([crc32(ids[s:e].tobytes()) for s, e in zip(first, row["ends"])], pa.int64())],
                    names=["part", "seg", "k", "first", "n_tokens", "ids_crc32"])

    ship_by_value(__name__)
    rows = segments.mapInArrow(run, "part int, seg int, k long, first long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seg"]).select(F.col("k").alias(key), (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_table(df: DataFrame, key: str, tokenizer_file: str, text: str = "text", end_id: int = 2, part_bytes: int = 16 << 20) -> DataFrame:
    """Encode, write, read back: ``key``, ``start``, ``n_tokens`` (with the end id) and ``ids_crc32`` of every row.

    Null and empty texts give the end id alone; null keys come first; rows of
    one key stand in the order of their text's hash; an empty table gives an
    empty result. Other columns of ``df`` are not read.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = int(min(100_000, max(1, -(-total // part_bytes))))
    return read_rows(write_segments(df, key, text, tokenizer_file, end_id, parts), key)
