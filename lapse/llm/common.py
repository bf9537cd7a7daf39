"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapse.session import _WRITTEN, checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given parquet table, read through Spark (any Hadoop path)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage: what follows reads the files, so a lost executor costs
    only its own tasks, and the work above is done once however often the
    result is used. The folder is the one the cluster names in
    ``spark.checkpoint.dir`` (a scratch folder only where it is unset).
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"llm-{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    _WRITTEN.append(path)  # removed when the application ends
    return spark.read.schema(df.schema).parquet(path)


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """``row`` (a struct of all columns of ``df``) and the named columns: whatever else ``df`` has clashes with nothing."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(c) for c in names])


def range_bits(rows: int, least: int = 9, per_range: int = 200_000) -> int:
    """Leading bits of a hash that cut ``rows`` rows to ranges of about ``per_range``, 2 ** ``least`` ranges or more."""
    return max(least, (max(1, -(-rows // per_range)) - 1).bit_length())


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for d in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(d)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def worker_memo() -> dict:
    """A dictionary that lives as long as the Python worker process.

    Functions are shipped to the workers by value, so module globals are new
    in every task; what is costly to build (a tokenizer, an automaton) is kept
    here and found again by the next task of the same worker.
    """
    return sys.__dict__.setdefault("_lapse_llm_memo", {})


#: ASCII white space as the contracts define it: space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
