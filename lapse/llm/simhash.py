"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority over the hashes of a text's word
shingles. Two fingerprints within ``2 r`` bits share a point within r bits of
both, so every distinct fingerprint emits all its variants within r bits
(1 + 64 for r = 1); a shuffle on the variants brings all links together. Those
that meet at one variant lie within 2 r of each other: they are verified and
linked to the smallest of them, a star in place of all pairs, which keeps every
connection. At most 1 + 64 distinct fingerprints can meet at a variant, so no
group grows with the data; equal fingerprints are merged before.

Components come from rounds of large-star and small-star steps over the links
of distinct fingerprints, each round a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import boxed, stored
from lapse.session import ship_by_value

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half the
    XXH64 hashes of the ``shingle``-word shingles, repeats included. A-Z are
    lower-cased, words are runs without ASCII white space; fewer words make one
    shingle; no word gives 0."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = [xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        h = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    votes = np.zeros(BITS, np.int64)
    hashes = np.array(h, dtype="<u8")
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = hashes[at: at + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, key: str, text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(``k``, ``h``: hash of the text, ``fp`` as signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], names=["k", "h", "fp"])

    ship_by_value(__name__)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.xxhash64(text).alias("h")).mapInArrow(run, f"k {kind}, h long, fp long")


def ball_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (``a`` > ``b``) between distinct fingerprints (column ``fp``) that keep every connection within ``distance`` bits."""
    if distance not in (1, 2):
        raise ValueError("one flipped bit on each side covers distances 1 and 2")
    masks = [0] + [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(BITS)]
    variants = fps.select("fp", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))).alias("v"))
    meet = Window.partitionBy("v")
    # distance 2: all that meet are within 2 of the smallest; distance 1: each pair differs from the variant by one at most,
    # and the links of distance 1 are those in which the variant is one of the two
    if distance == 2:
        links = variants.select(F.col("fp").alias("a"), F.min("fp").over(meet).alias("b"))
    else:
        own = F.max(F.when(F.col("fp") == F.col("v"), F.col("fp"))).over(meet)
        links = variants.select(F.col("fp").alias("x"), own.alias("y")).where("y is not null").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return links.where((F.col("a") != F.col("b")) & near).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``root``) of every linked node: the smallest node it can reach.

    Alternates large-star (every larger neighbour is linked to the smallest
    one) and small-star (the same among the smaller ones) until the links no
    longer change; the rounds grow with the logarithm of the longest path. A
    round's links are a table; what is compared are its count and checksum."""
    now = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        # stored, so that the join below brings its own exchange: the smallest node of a large component holds most links,
        # and only then can its partition be split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "links-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        large = stored(large, "links-large")
        small = stored(large.groupBy("u").agg(F.min("v").alias("m")), "links-small")
        hung = large.join(small, "u")
        now = stored(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                     .union(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"no fixed point of the components after {most_rounds} rounds")


def simhash_groups(df: DataFrame, key: str, text: str = "text", shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits), ``component_id``, ``root`` (smallest fingerprint of the component) and ``text_hash`` of every row.

    Rows are linked if their fingerprints differ in at most ``distance`` bits;
    ``component_id`` is the smallest key that a row reaches, itself included.
    Null, empty and blank texts have fingerprint 0 and link like any other;
    equal texts always share a component; repeated rows come out as often as
    they came in; a null key takes no part in the minimum (a component of null
    keys alone has a null id); an empty table gives an empty result. Other
    columns of ``df`` are not read.
    """
    fps = stored(fingerprints(df, key, text, shingle, seed), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("k").alias("first"))
    roots = components(ball_links(nodes.select("fp"), distance))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "roots")
    ids = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    classes = stored(named.join(ids, "root").select("fp", "root", "component_id"), "classes")
    # one hot fingerprint may hold a third of the rows: the stored class table leaves this join to be split
    return fps.join(classes, "fp").select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                          "component_id", "root", F.col("h").alias("text_hash"))


def keep_one(df: DataFrame, key: str, text: str = "text", shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """The rows of ``df`` that stay: of each component the row with the smallest key (null last; of several texts the
    one with the smallest hash; of repeated rows one). All columns are kept; the texts are shuffled once."""
    groups = simhash_groups(df, key, text, shingle, distance, seed)
    chosen = (groups.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy("root", key).agg(F.min("text_hash").alias("_h"))
                    .select(F.xxhash64(key, "_h").alias("_row"), "_h").distinct())
    rows = boxed(df, key, text).select("row", F.xxhash64(text).alias("_h"), F.xxhash64(key, F.xxhash64(text)).alias("_row"))
    first = Window.partitionBy("_row", "_h").orderBy("_row")
    return rows.join(chosen, ["_row", "_h"]).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("row.*")
