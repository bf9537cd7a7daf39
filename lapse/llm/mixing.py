"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

The words of a source lie on one line, its documents in seeded order; the line
is cut into blocks of ``block_words`` words. The mix has as many blocks as all
documents together, and its seats (one block each) go to the sources by
highest quotients ``target / (2 j - 1)``. The rule is house monotone: the seats
of the first t of ``shards`` parts of the mix, apportioned on their own, never
shrink as t grows, so their differences are whole quotas per shard and source.
Seat k of a source is block ``(offset + k) mod blocks`` with a seeded offset:
every block once per epoch, then a run of blocks. What a document gives is the
overlap of its words with those blocks, in closed form, so that no block is
ever a row.

All is DataFrame work. Documents are shuffled once, by source and hash range:
positions on a line are sums inside a range plus the totals of the ranges
before it, so a source that holds most rows is spread over all of them.
Only tables with one row per source (and shard) meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.llm.common import WORD, boxed, range_bits, stored

def _all():
    """Over tables of one row per source."""
    return Window.partitionBy(F.lit(0))


def source_targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from one row (source, source_size) per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    100 % of all sizes; a target stops at ``cap`` times its source's size and
    the excess is shared again by weight, until none is above. Sources in
    order of cap / weight fill up one after the other, so the fixed point is
    read off running sums: a source is full if its cap is below its share of
    what those before it leave.
    """
    dec = "decimal(38,0)"
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w.cast("long")).withColumn("_cap", (F.col("source_size") * cap).cast(dec))
    full = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("weight"), F.col(source).asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(dec)
    t = (t.withColumn("_left", F.sum(F.col("source_size").cast(dec)).over(_all()) - F.coalesce(F.sum("_cap").over(before), zero))
          .withColumn("_wleft", F.sum("weight").over(_all()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
          .withColumn("_full", F.col("_cap").cast("double") * F.col("_wleft") < F.col("_left").cast("double") * F.col("weight")))
    # the first source in order that is not full sees the level for all the rest
    level = F.max(F.when(~F.col("_full"), F.struct(F.col("_wleft"), F.col("_left")))).over(_all())
    return (t.withColumn("_level", level)
             .select(source, "source_size", "weight",
                     F.when(F.col("_full"), F.col("_cap").cast("double"))
                      .otherwise(F.col("weight") * F.col("_level._left").cast("double") / F.col("_level._wleft")).alias("target")))


def block_quotas(targets: DataFrame, source: str, block_words: int = 16, shards: int = 16, cap: int = 3) -> DataFrame:
    """Adds ``blocks`` (of the source) and ``upto``: its seats in the first 1, 2, ... ``shards`` parts of the mix.

    ``upto[t] - upto[t - 1]`` is the quota of shard t. With x the exact share
    in blocks, n the house and s the sources, the seats lie between x (n - s/2) / n
    and x (n + s/2) / n, rounded; only the quotients between those bounds, some
    two a source and shard, are ranked.
    """
    total = F.sum("target").over(_all())
    t = (targets.withColumn("blocks", F.ceil(F.col("source_size") / block_words))
                .withColumn("_pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last())))
                .withColumn("_house", F.ceil(total / block_words)).withColumn("_total", total)
                .withColumn("_s", F.sum((F.col("target") > 0).cast("int")).over(_all()) / 2))
    t = t.withColumn("_shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    n = F.floor(F.col("_house").cast("decimal(38,0)") * F.col("_shard") / shards).cast("long")
    t = t.withColumn("_n", n).withColumn("_x", F.when(F.col("target") > 0, F.col("target") * F.col("_n") / F.col("_total")).otherwise(0.0))
    bound = lambda sign: F.floor(F.col("_x") * (1 + sign * F.col("_s") / F.greatest(F.col("_n"), F.lit(1))) + 0.5)
    t = (t.withColumn("_lo", F.greatest(bound(-1) - 1, F.lit(0).cast("long")))
          .withColumn("_hi", F.when(F.col("target") > 0, bound(1) + 1).otherwise(0).cast("long")))
    by_shard = Window.partitionBy("_shard")
    t = t.withColumn("_need", F.col("_n") - F.sum("_lo").over(by_shard))
    j = t.withColumn("_j", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo") + 1, F.col("_hi")))))
    j = j.withColumn("_q", F.col("target") / (2 * F.col("_j") - 1))
    rank = F.row_number().over(by_shard.orderBy(F.col("_q").desc_nulls_last(), "_pos"))
    j = j.withColumn("_won", (F.col("_q").isNotNull() & (rank <= F.col("_need"))).cast("long"))
    seats = (j.groupBy(source, "source_size", "weight", "target", "blocks", "_shard", "_lo").agg(F.sum("_won").alias("_won"))
              .withColumn("_seats", F.least(F.col("_lo") + F.col("_won"), F.col("blocks") * cap)))
    return (seats.groupBy(source, "source_size", "weight", "target", "blocks")
                 .agg(F.sort_array(F.collect_list("_seats")).alias("upto")))  # ``shards`` numbers, never falling


def _overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0).cast("long"))


def mix_sources(df: DataFrame, key: str, source: str, text: str = "text", seed: int = 6, block_words: int = 16,
                shards: int = 16, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``size``, ``source_size``, ``target``, ``taken``, ``epochs``, ``run`` and ``mix_shard`` of every row, with ``carry``.

    ``size`` counts the words of the text (null: 0). ``taken`` words go into
    the mix: ``epochs`` whole copies plus the word ranges of ``run`` (an array
    of (from, to), 0-based, end exclusive; mostly empty or the whole text).
    ``mix_shard`` is the shard of the row's first seat (null: it gives nothing).
    A row never gives more than ``cap`` times its size. Repeated rows count
    each; a null source is a source; rows without words give 0; an empty table
    gives an empty result. Reruns agree: order and offsets are seeded hashes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("_k"), F.col(source).alias("_src"),
                     F.regexp_count(body, F.lit(WORD)).cast("long").alias("_size"),
                     F.xxhash64(F.lit(seed), F.col(key), body).alias("_h"),
                     *[F.col(c).alias(f"_c_{c}") for c in carry])
    if not carry:  # a narrow table: read the texts once
        rows = stored(rows, "mix")
    # ranges of the hash, of bounded size; the order on the line is that of the hash, however it is cut
    rows = rows.withColumn("_b", F.shiftrightunsigned("_h", 64 - range_bits(rows.count())).cast("int"))
    ranges = rows.groupBy("_src", "_b").agg(F.sum("_size").alias("_n"))
    ranges = stored(ranges, "mix-ranges")
    sizes = ranges.groupBy("_src").agg(F.sum("_n").alias("source_size"))
    quotas = block_quotas(source_targets(sizes, "_src", weights, cap), "_src", block_words, shards, cap)
    before = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranges.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
                    .join(quotas.withColumnRenamed("_src", "_qsrc"), F.col("_src").eqNullSafe(F.col("_qsrc"))).drop("_qsrc")
                    .withColumnsRenamed({"_src": "_ssrc", "_b": "_sb"}))
    inside = Window.partitionBy("_src", "_b").orderBy("_h", "_k").rowsBetween(Window.unboundedPreceding, -1)
    t = rows.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0).cast("long")))
    t = t.join(starts, F.col("_src").eqNullSafe(F.col("_ssrc")) & (F.col("_b") == F.col("_sb")))
    t = t.drop("_ssrc", "_sb")
    seats, m, bw = F.element_at("upto", -1), F.greatest(F.col("blocks"), F.lit(1)), F.lit(block_words)
    a = F.col("_start") + F.col("_in")
    t = (t.withColumn("_a", a).withColumn("_e", a + F.col("_size"))
          .withColumn("epochs", F.floor(seats / m).cast("long")).withColumn("_rest", seats % m)
          .withColumn("_off", F.pmod(F.xxhash64(F.lit(seed + 1), "_src"), m)))
    # the run of the last epoch: blocks [off, off + rest), around the end of the line
    c1, d1 = F.col("_off") * bw, F.least(F.col("_off") + F.col("_rest"), m) * bw
    d2 = F.greatest(F.col("_off") + F.col("_rest") - m, F.lit(0).cast("long")) * bw
    part = lambda c, d: F.struct((F.greatest(F.col("_a"), c) - F.col("_a")).alias("from"), (F.least(F.col("_e"), d) - F.col("_a")).alias("to"))
    zero = F.lit(0).cast("long")
    t = t.withColumn("run", F.filter(F.array(part(zero, d2), part(c1, d1)), lambda r: r["to"] > r["from"]))
    t = t.withColumn("taken", F.col("epochs") * F.col("_size") + _overlap(F.col("_a"), F.col("_e"), c1, d1) + _overlap(F.col("_a"), F.col("_e"), zero, d2))
    block = F.floor(F.col("_a") / block_words).cast("long")
    seat = F.pmod(F.when(F.col("epochs") > 0, block).otherwise(F.floor((F.col("_a") + F.try_element_at("run.from", F.lit(1))) / block_words).cast("long")) - F.col("_off"), m)
    t = t.withColumn("_seat", F.when(F.col("taken") > 0, seat))
    shard = F.when(F.col("_seat").isNotNull(), F.size(F.filter("upto", lambda u: u <= F.col("_seat"))))
    kept = [F.col(f"_c_{c}").alias(c) for c in carry] if key in carry else [F.col("_k").alias(key), *[F.col(f"_c_{c}").alias(c) for c in carry]]
    return t.select(*kept, F.col("_size").alias("size"), "source_size", "target", "taken", "epochs", "run", shard.cast("int").alias("mix_shard"))


def mixed_rows(df: DataFrame, key: str, source: str, text: str = "text", length: str | None = None, **mix) -> DataFrame:
    """The mix as rows with the columns of ``df``: a row for every whole copy and for every piece of a document.

    A piece (at the ends of a source's run, some two a source) holds its words
    joined by single spaces; ``length`` names a column with the characters of
    the text, which pieces set anew. Documents that give nothing are left out.
    """
    t = mix_sources(boxed(df, key, source, text), key, source, text, carry=("row",), **mix)
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to")), F.when(F.col("size") > 0, F.col("epochs")).otherwise(0).cast("int"))
    t = t.withColumn("part", F.explode(F.concat(whole, F.col("run"))))
    n = F.col("part.to") - F.col("part.from")
    words = F.regexp_extract_all(F.col("row")[text], F.lit(WORD), F.lit(0))
    piece = F.array_join(F.slice(words, (F.col("part.from") + 1).cast("int"), n.cast("int")), " ")
    cut = F.col("row").withField(f"`{text}`", piece)
    if length:
        cut = cut.withField(f"`{length}`", F.length(piece).cast(df.schema[length].dataType))
    t = t.select(F.when(n < F.col("size"), cut).otherwise(F.col("row")).alias("row"))
    return t.select("row.*")
