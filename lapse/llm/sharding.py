"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are first cut into source partitions of bounded size by a seeded hash.
How many rows of source partition p go to shard s is a contingency table with
fixed margins: the partition counts (given) and the shard sizes (N split into
parts at most one apart). For a uniformly random permutation of all rows that
table follows the multivariate hypergeometric law, so it is drawn from that
law row by row. Then

1. *permute locally*: rank the rows of a partition by a seeded hash;
2. *exchange*: the first ``m[p][0]`` ranks go to shard 0, the next ``m[p][1]``
   to shard 1, and so on, so that every shard gets exactly its size;
3. *permute again*: order the rows of a shard by a second seeded hash; the
   position is the slot.

Rows move twice, whatever their number. Slots are ranks in a range of hash
buckets plus the counts of the buckets before, so that no task holds a shard.
Only the table of counts (partitions x shards whole numbers, a few bytes for
thousands of rows) passes through the driver.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import range_bits, stored

#: Weight of a row beside its text bytes: the doc_id.
ROW_BYTES = 8


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """``matrix[p][s]``: rows of source partition p that go to shard s.

    Row sums are ``counts``; column sums are N // shards or one more (the
    first N % shards shards). Drawn exactly: given the room left in every
    shard, partition p takes a multivariate hypergeometric sample of it.
    """
    total = sum(counts)
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    matrix = []
    for n in counts:
        row, left = np.zeros(shards, dtype=np.int64), n
        behind = int(room.sum())
        for s in range(shards):
            behind -= int(room[s])
            row[s] = _hypergeometric(rng, int(room[s]), behind, left)
            left -= int(row[s])
        room -= row
        matrix.append(row.tolist())
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of ``good + bad``; the sampler of
    numpy takes urns below 1e9."""
    if not good or not draws:
        return 0
    if not bad:
        return draws
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # larger urns: inversion over all values within 14 deviations of the mean;
    # neighbouring probabilities follow from p(x+1)/p(x), the rest is below 1e-40
    total, low, high = good + bad, max(0, draws - bad), min(good, draws)
    mean = draws * (good / total)
    spread = int(14 * (mean * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5) + 14
    x = np.arange(max(low, int(mean) - spread), min(high, int(mean) + spread) + 1, dtype=np.float64)
    step = np.log(good - x[:-1]) + np.log(draws - x[:-1]) - np.log(x[:-1] + 1) - np.log(bad - draws + x[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return int(x[min(int(np.searchsorted(upto, rng.random() * upto[-1], side="right")), len(x) - 1)])


def shard_rows(df: DataFrame, key: str, shards: int, seed: int = 11, partitions: int | None = None,
               text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, the ``carry`` columns, ``shard`` and ``slot`` of every row.

    ``shard`` counts are at most one apart; ``slot`` runs from 0 without gaps
    in every shard. Every row of ``df`` comes out once: repeated rows, null
    keys (ordered first) and null texts (size 0 + 8, CRC of the empty string)
    included; an empty table gives an empty result. Rows equal in key and
    text are interchangeable, all others are ordered by seeded hashes and then
    by key and text CRC, so that reruns agree. Other columns of ``df``, of
    whatever name, are not read.
    """
    spark = df.sparkSession
    n_rows = df.count()
    partitions = partitions or 1 << range_bits(n_rows)  # of about 200,000 rows each, 512 or more
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("_k"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("_size"),
                     F.crc32(body.cast("binary")).alias("_crc"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    # xxhash64 skips nulls, so a null key hashes as its text alone
    rows = (rows.withColumn("_h1", F.xxhash64(F.lit(seed), "_k", "_crc", "_size"))
                .withColumn("_h2", F.xxhash64(F.lit(seed + 1), "_k", "_crc", "_size"))
                .withColumn("_p", F.pmod(F.xxhash64(F.lit(seed + 2), "_k", "_crc", "_size"), F.lit(partitions)).cast("int")))
    counts = [0] * partitions
    for r in rows.groupBy("_p").count().collect():  # one row a partition
        counts[r["_p"]] = r["count"]
    upto = np.cumsum(np.array(communication_matrix(counts, shards, seed), dtype=np.int64), axis=1).tolist()
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(upto)), "array<array<bigint>>")).alias("_p", "_upto"))
    # 1. local permutation; the matrix has partitions x shards integers, one row for some 200,000 rows of data
    local = Window.partitionBy("_p").orderBy("_h1", "_k", "_crc")
    dealt = (rows.withColumn("_r", F.row_number().over(local).cast("long") - 1)
                 .join(table, "_p")
                 .withColumn("shard", F.size(F.filter("_upto", lambda u: u <= F.col("_r"))).cast("int")))
    # 2. exchange by shard and hash bucket, 3. permutation inside
    dealt = dealt.drop("_upto", "_r", "_p", "_h1").withColumn("_b", F.shiftrightunsigned("_h2", 64 - range_bits(n_rows // shards)).cast("int"))
    dealt = stored(dealt, "shards")
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
                   .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n"))
    inside = Window.partitionBy("shard", "_b").orderBy("_h2", "_k", "_crc")
    return (dealt.withColumn("_i", F.row_number().over(inside).cast("long") - 1)
                 .join(starts, ["shard", "_b"])
                 .select(F.col("_k").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                         *[F.col(f"_c_{c}").alias(c) for c in carry], "shard", (F.col("_start") + F.col("_i")).alias("slot")))
