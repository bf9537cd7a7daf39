"""Session set-up, lineage cuts and size-bounded broadcast helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session defaults: AQE re-plans joins and partition counts at runtime from
# real shuffle statistics (its broadcast decision is the size check for
# dimension tables that grow with the data), and splits skewed join
# partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lapse", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster the master and partition counts come from spark-submit; the
    arguments exist for local runs and tests.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf.setdefault("spark.driver.memory", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared lineage-cut folder named by the cluster.

    Read from ``spark.checkpoint.dir``; only when it is unset in local mode
    (tests) a scratch folder is created: on a cluster every executor would
    write to its own disk, so there it is an error. The RDD checkpoint folder
    of the context is registered once, for ``DataFrame.checkpoint``.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        d = tempfile.mkdtemp(prefix="lapse-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df: DataFrame, name: str | None = None, mode: str = "table", codec: str | None = None) -> DataFrame:
    """Cut lineage of an intermediate that is read many times.

    ``mode='table'`` writes parquet under the shared checkpoint folder and
    reads it back (survives executor loss, keeps column pruning on re-read);
    ``mode='checkpoint'`` uses reliable ``DataFrame.checkpoint``;
    ``mode='cache'`` only persists (no lineage cut). ``codec`` is the parquet
    compression of a table (the session's unless given).
    """
    spark = df.sparkSession
    if mode == "cache":
        return df.persist()
    base = checkpoint_dir(spark)
    if mode == "checkpoint":
        return df.checkpoint(eager=True)
    path = os.path.join(base, f"{name or 'table'}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path, compression=codec)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


# Tables written by ``materialize`` in this process; removed (and only they)
# when the application ends, so intermediates do not pile up in the shared
# checkpoint folder.
_WRITTEN: list[str] = []


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` wrote, once nothing reads them any more.

    Only folders that this process wrote are touched; a table without files
    (no rows) stays until the application ends, as all others do."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            mine = [p for p in _WRITTEN if os.path.basename(p) == os.path.basename(folder)]
            if mine:
                path = jvm.org.apache.hadoop.fs.Path(mine[0])
                path.getFileSystem(conf).delete(path, True)
                _WRITTEN.remove(mine[0])


@atexit.register
def _remove_materialized() -> None:
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    if sc is None or not _WRITTEN:
        return
    try:
        conf = sc._jsc.hadoopConfiguration()
        for p in _WRITTEN:
            path = sc._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  (best effort at shutdown)
        pass
    _WRITTEN.clear()


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame of scalars to every row of ``df``.

    ``scalars`` must be a global aggregate (exactly one row). Each column
    becomes a scalar subquery: Spark evaluates the aggregate once (the
    subqueries over one aggregate are merged), broadcasts the value and uses
    it as a constant in the row expressions; no join is planned.
    """
    return df.withColumns({c: scalars.select(c).scalar() for c in scalars.columns})


BROADCAST_ROWS = 1 << 19  # of a few short columns: some 60 MB at most


def broadcast_if_few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for a broadcast join if it is counted to hold at most ``rows`` rows (of a few short columns), else
    as it is: a side that grows beyond is shuffled."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship_by_value(module_name: str) -> None:
    """Serialise functions of ``module_name`` by value in Python UDFs.

    Workers then need no installed copy of this package: the UDF's code
    travels with the task (on a cluster ``--py-files`` works as well).
    """
    import sys

    from pyspark import cloudpickle
    mod = sys.modules.get(module_name)
    if mod is not None:
        try:
            cloudpickle.register_pickle_by_value(mod)
        except ValueError:
            pass


SHUFFLE_INPUT_BYTES = 4 << 20  # of input for each shuffle partition: the widest shuffles hold some 3 times the input


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Raise the session's number of shuffle partitions where ``input_bytes`` need more, so that sorts fit in memory.

    It is never lowered, and AQE joins neighbours that turn out small. For a
    job whose stored steps all shuffle the input several times over; settings
    for a whole application come from :func:`scale_conf`."""
    n = min(100_000, -(-int(input_bytes) // SHUFFLE_INPUT_BYTES))
    for key, default in (("spark.sql.shuffle.partitions", "200"), ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)):
        now = spark.conf.get(key, default)
        if now is not None and int(now) < n:
            spark.conf.set(key, str(n))


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20, max_partitions: int = 100_000) -> dict:
    """Settings sized for an input of ``input_bytes`` (pass to
    :func:`get_session` as ``extra``, or to spark-submit).

    * scan splits and post-shuffle partitions of ``partition_bytes`` (256 MB
      of compressed parquet is ~1 GB in memory, comfortable for a 4-8 GB
      executor core slice);
    * shuffle partitions = input / partition size (AQE coalesces the small
      ones and splits skewed join partitions above 4x the median);
    * broadcast joins chosen by AQE from measured sizes up to 64 MB.
    """
    n = max(200, min(max_partitions, -(-int(input_bytes) // partition_bytes)))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
