"""Corpus pipeline: toxicity, SimHash near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it back as the next stage's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.llm.common import boxed, stored, table
from lapse.llm.decontaminate import contaminated, contamination
from lapse.llm.mixing import mixed_rows
from lapse.llm.sharding import shard_rows
from lapse.llm.simhash import keep_one
from lapse.llm.toxicity import not_rejected

SHARDS = 24


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; all of them where the labels give it nothing to learn."""
    kept = not_rejected(boxed(docs, "doc_id", "text"), table(spark, sf_dir, "labels"), "doc_id", carry=("row",))
    return kept.select("row.*")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates (shingles of 3 words, 2 bits)."""
    return keep_one(docs, "doc_id", shingle=3, distance=2)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of benchmark items."""
    marked = contamination(boxed(docs, "doc_id", "text"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", carry=("row",))
    return marked.where(~contaminated()).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weights 1, 2, 3: a row for every copy or piece that it takes."""
    return mixed_rows(docs, "doc_id", "source", length="n_chars")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into shards of equal row counts: the documents with ``shard`` and ``slot`` (in place of columns of that name)."""
    placed = shard_rows(boxed(docs, "doc_id", "text"), "doc_id", SHARDS, carry=("row",))
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_near_dedup", near_copies_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Stages 1 to 3 have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
