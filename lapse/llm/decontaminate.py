"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton accepts every run of words of every item. Training words stream
through it one by one; at each word it knows the longest run of words, ending
there, that some item contains. Where that length reaches ``window`` words the
last ``window`` words are a window of an item; whole items shorter than that
are found on the suffix links of the state. Matches give the hit word spans of
a text and the items that they come from; what exceeds the coverage limit is
contaminated.

Items are cut to pieces; equal pieces become one, with its items in a table of
their own, and the pieces are dealt to blocks of a bounded number of words.
One pass over the texts hashes their windows and keeps the hashes that a bitmap
of the pieces' window hashes knows (at most ``BITMAP`` bits, whatever the
benchmark's size); these are joined to the hashes, which tells the blocks that
a text may share windows with. Those texts are sent to the tasks of these
blocks, where the automaton decides. Nothing but the bitmap is broadcast by
name, and no item or text passes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.llm.common import stored
from lapse.session import ship_by_value

#: ASCII bytes to words: 0-9 and a-z stay, A-Z in lower case, all else parts words; bytes of other letters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: Bits of the broadcast bitmap at most (16 MB); a fuller one lets more hashes through to the join, and no fewer.
BITMAP = 1 << 27

#: Texts that a task matches with one block where blocks and texts are joined.
TASK_TEXTS = 5000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences.

    ``step[v]``: transitions of state v; ``link``, ``length``: its suffix link
    and longest run. ``at_window[v]``: the state on the links of v that holds
    its last ``window`` words; ``owners``: items by such a state;
    ``short[v]``: the nearest state from v up the links at which a whole item
    of fewer words ends, with ``whole`` listing those (words, item)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.step: list[dict] = [{}]
        self.link, self.length, self.window = [-1], [0], window
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        n = len(self.step)
        order = sorted(range(1, n), key=self.length.__getitem__)
        self.at_window, self.owners = [0] * n, {}
        for v in order:
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[self.link[v]] < window else self.at_window[self.link[v]]
        self.whole: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            v = 0
            for i, w in enumerate(words):
                v = self.step[v][w]
                if i + 1 >= window:
                    self.owners.setdefault(self.at_window[v], set()).add(item)
            if 0 < len(words) < window:
                self.whole.setdefault(v, []).append((len(words), item))
        self.short = [-1] * n
        for v in order:
            self.short[v] = v if v in self.whole else self.short[self.link[v]]

    def _state(self, length: int, link: int, step: dict) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state for the longest run of p followed by w, split off q if q holds longer ones."""
        q = self.step[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = c
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.step[last]:
            return self._split(last, w)
        v = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = v
            p = self.link[p]
        if p >= 0:
            self.link[v] = self._split(p, w)
        return v

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (from, to) of every longest match that counts, by their ends, and the items with one."""
        step, link, length, short, window = self.step, self.link, self.length, self.short, self.window
        spans, items = [], set()
        v = size = 0
        for i, w in enumerate(words):
            to = step[v].get(w)
            if to is None:
                while to is None and v:
                    v = link[v]
                    to = step[v].get(w)
                if to is None:
                    size = 0
                    continue
                size = length[v] + 1
            else:
                size += 1
            v = to
            cover = 0
            if size >= window:
                cover = window
                items |= self.owners[self.at_window[v]]
            u = short[v]
            while u >= 0:
                for n, item in self.whole[u]:
                    if n <= size:
                        cover = max(cover, n)
                        items.add(item)
                u = short[link[u]]
            if cover:
                spans.append((i + 1 - cover, i + 1))
        return spans, items


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pieces(items: DataFrame, item: str, text: str, window: int, most: int) -> DataFrame:
    """(piece, item, n, body): the words of every item, joined by spaces; long items in pieces of at most ``most`` words that share window - 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for b in batches:
            out = []
            for i, t in zip(b.column(0), b.column(1)):
                words, at = words_of(t.as_py()), 0
                while words:
                    piece = words[at: at + most]
                    out.append({"piece": k, "item": i.as_py(), "n": len(piece), "body": b" ".join(piece)})
                    k += 1
                    if at + most >= len(words):
                        break
                    at += most - window + 1
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("piece", pa.int64()), ("item", pa.string()), ("n", pa.int64()), ("body", pa.binary())]))

    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "piece long, item string, n long, body binary")


_ODD = 0x9E3779B97F4A7C15


def window_keys(words: list[bytes], lengths: list[int]) -> np.ndarray:
    """The distinct 64-bit hashes of the runs of each of ``lengths`` words: differences of one running sum, scaled to the run's start."""
    m = len(words)
    h = np.fromiter(map(crc32, words), np.uint64, m) * np.uint64(_ODD)
    h ^= h >> np.uint64(32)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, _ODD, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, pow(_ODD, -1, 1 << 64), np.uint64)]))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:m], dtype=np.uint64)])
    out = [np.zeros(0, np.uint64)]
    for n in lengths:
        if n <= m:
            g = ((upto[n:] - upto[: m - n + 1]) * inverse[: m - n + 1] + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(g ^ (g >> np.uint64(31)))
    return np.unique(np.concatenate(out)).view(np.int64)


def _bitmap(known: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two, 512 or more) with the low bits of every ``h`` set, made in 64 parts."""
    size = bits // 64

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part = np.zeros(size, bool)
        part[np.asarray(rows.column("h")) & (size - 1)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "map": pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())})

    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    parts = known.select(low.alias("h")).distinct().withColumn("part", F.floor(F.col("h") / size))
    out = np.zeros((64, size // 8), np.uint8)
    for r in parts.groupBy("part").applyInArrow(run, "part long, map binary").collect():  # bits / 8 bytes together
        out[r["part"]] = np.frombuffer(r["map"], np.uint8)
    return out.reshape(-1)


def _matched(texts: DataFrame, pairs: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """(_id, spans, pieces): matches of each text (_id, _t) with each block that ``pairs`` names for it."""
    # a block that many texts share is matched by several tasks
    shares = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TASK_TEXTS).cast("long").alias("tasks"))
    left = pieces.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"),
                                               F.lit(None).cast("long").alias("_id"), F.lit(None).cast("string").alias("_t"), "piece", "body")
    right = (pairs.join(shares, "block").join(texts.select("_id", "_t"), "_id")
                  .select("block", F.pmod(F.xxhash64("_id"), F.col("tasks")).alias("task"), F.lit(1).alias("kind"), "_id", "_t",
                          F.lit(None).cast("long").alias("piece"), F.lit(None).cast("binary").alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, a = None, [], None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["block"], r["task"]) != at:
                    at, block, a = (r["block"], r["task"]), [], None
                if not r["kind"]:  # the pieces of a block come before its texts
                    block.append((r["piece"], r["body"].split(b" ")))
                    continue
                a = a or SuffixAutomaton(block, window)
                spans, found = a.matches(words_of(r["_t"]))
                if spans:
                    out.append({"_id": r["_id"], "spans": [{"from": s, "to": e} for s, e in union_spans(spans)], "pieces": sorted(found)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("_id", pa.int64()), ("spans", _SPANS), ("pieces", pa.list_(pa.int64()))]))

    work = left.union(right).repartition("block", "task").sortWithinPartitions("block", "task", "kind")
    return work.mapInArrow(run, "_id long, spans array<struct<from:int,to:int>>, pieces array<long>")


_SPANS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _union(found: DataFrame) -> DataFrame:
    """(_id, _spans): the spans of all blocks of a text as one sorted, disjoint list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [union_spans([(x["from"], x["to"]) for x in s.as_py()]) for s in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"from": s, "to": e} for s, e in x] for x in spans], _SPANS)], names=["_id", "_spans"])

    spans = found.groupBy("_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return spans.mapInArrow(run, "_id long, _spans array<struct<from:int,to:int>>")


def contamination(df: DataFrame, items: DataFrame, key: str, item: str, text: str = "text", item_text: str = "text",
                  window: int = 13, block_words: int = 100_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``n_words``, ``n_hit``, ``spans`` (word ranges, end exclusive), ``items`` (sorted ids as strings) of every row, with ``carry``.

    A window is ``window`` consecutive words of an item, or the whole item if
    it has fewer; a word inside any occurrence of a window is hit. Null and
    empty texts have no words; items without words have no window; a null item
    id counts as the empty string and repeated ids as one. Repeated rows come
    out as they came in. With no items, or no rows, nothing is hit. Carried
    columns named like the key or the results are left out.
    """
    ship_by_value(__name__)
    ship_by_value("lapse.llm.common")
    most = max(block_words, 2 * window)
    named = stored(_pieces(items, item, item_text, window, most).withColumn("same", F.sha2("body", 256)), "items")
    pieces = stored(named.groupBy("same").agg(F.min("piece").alias("piece"), F.first("n").alias("n"), F.first("body").alias("body")), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(-(-total // most) or 1)))
    lengths = sorted(r[0] for r in pieces.select(F.least("n", F.lit(window)).cast("int")).distinct().collect())  # at most ``window`` numbers

    def piece_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, body in zip(b.column(0), b.column(1)):
                words = body.as_py().split(b" ")
                keys = window_keys(words, [min(window, len(words))])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), block.as_py(), np.int64))], names=["h", "block"])

    known = stored(pieces.select("block", "body").mapInArrow(piece_keys, "h long, block long").distinct(), "item-keys")
    bits = min(BITMAP, max(1 << 16, 1 << (16 * known.count()).bit_length()))
    sent = df.sparkSession.sparkContext.broadcast(_bitmap(known, bits))

    def text_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for b in batches:
            n, keys = [], []
            for t in b.column(0):
                words = words_of(t.as_py())
                h = window_keys(words, lengths)
                low = h & (bits - 1)
                n.append(len(words))
                keys.append(h[(bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1])
            at = np.cumsum([0, *map(len, keys)])
            lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), lists.cast(pa.list_(pa.int64()))], names=[*b.schema.names, "_n", "_h"])

    carry = tuple(c for c in carry if c not in (key, "n_words", "n_hit", "spans", "items"))
    rows = df.select(F.col(text).cast("string").alias("_t"), F.col(key).alias("_k"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    keyed = rows.mapInArrow(text_keys, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("_n long, _h array<long>").fields]))
    texts = stored(keyed.withColumn("_id", F.monotonically_increasing_id()), "item-texts")
    pairs = stored(texts.select("_id", F.explode("_h").alias("h")).join(known, "h").select("_id", "block").distinct(), "item-pairs")
    found = stored(_matched(texts, pairs, pieces, window), "item-matches")
    members = stored(named.join(pieces.select("same", F.col("piece").alias("p")), "same").select("p", "item").distinct(), "item-members")
    whose = (found.select("_id", F.explode("pieces").alias("p")).distinct().join(members, "p")
                  .groupBy("_id").agg(F.sort_array(F.collect_set("item")).alias("_items")))
    hits = stored(_union(found).join(whose, "_id"), "item-hits")
    spans = F.coalesce("_spans", F.array().cast("array<struct<from:int,to:int>>"))
    return texts.drop("_t", "_h").join(hits, "_id", "left").select(
        F.col("_k").alias(key), *[F.col(f"_c_{c}").alias(c) for c in carry], F.col("_n").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"]).alias("n_hit"),
        spans.alias("spans"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def contaminated(coverage: int = 20):
    """A row is contaminated if hit words are at least 1 / ``coverage`` of its words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words"))


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans (sorted, disjoint) and what parts them from the next word."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    begins = [m.start() for m in re.finditer(rb"[^ ]+", raw.translate(_TABLE))]  # the table keeps lengths
    begins.append(len(raw))
    parts, at = [], 0
    for s, e in spans:
        parts.append(raw[at: begins[s]])
        at = begins[e]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")


def cleaned(marked: DataFrame, text: str = "text", length: int = 1, coverage: int | None = 20) -> DataFrame:
    """Rows of :func:`contamination` that carry ``text``, with ``cleaned`` (the text without its spans) and ``n_cut`` (words cut).

    Spans of at least ``length`` words are cut (1: all); where hit words reach
    1 / ``coverage`` of the text, all of its spans are, whatever their length
    (None: no such limit). A text without spans to cut stays as it is, null
    included; a text that is all span leaves what stands before its first word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [without_spans(t.as_py(), [(x["from"], x["to"]) for x in c.as_py()]) for t, c in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*b.schema.names[1:], "_cleaned"])

    ship_by_value(__name__)
    ship_by_value("lapse.llm.common")
    every = F.lit(False) if coverage is None else contaminated(coverage)
    cut = F.filter("spans", lambda x: every | (x["to"] - x["from"] >= length))
    rows = marked.select(F.col(text).cast("string").alias("_t"), cut.alias("_cut"), F.struct(*[F.col(f"`{c}`") for c in marked.columns]).alias("_row"))
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("_cleaned", T.StringType())]))
    n_cut = F.aggregate("_cut", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return out.select("_row.*", F.col("_cleaned").alias("cleaned"), n_cut.alias("n_cut"))
