"""Session helpers: a tuned local/cluster session and a shared checkpoint dir."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "seqlake",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one with settings suited to these jobs.

    On a cluster the launcher's settings win; we only fill gaps.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    cpus = os.cpu_count() or 8
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
          .config("spark.driver.memory", os.environ.get("SEQLAKE_DRIVER_MEMORY", "16g"))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set our own only when it is unset.

    The fallback is meant for tests and local runs only; on a cluster the
    setting must name a shared folder (HDFS/S3/...), never a machine-local one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    target = conf_dir or fallback
    if target is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (HDFS, object store) on a cluster")
        import tempfile
        target = tempfile.mkdtemp(prefix="seqlake-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir()


@contextmanager
def short_batches(spark: SparkSession, rows: int = 2048, size: int = 4 << 20):
    """Arrow batches of at most ``rows`` rows (and ``size`` bytes, where Spark bounds them) for the jobs that run inside.

    Spark's 10,000 rows of text are held several times over by the executor and by each Python worker. A smaller setting stays.
    """
    old = {}
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = old[key] = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(key, str(bound))
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut_lineage(df):
    """Reliable checkpoint (never ``localCheckpoint``): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_key(spark: SparkSession, directory: str, table: str = "documents") -> tuple:
    """Key for what is kept per input: the application, the folder, and the table's time and size, so changed input is read anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{table}.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return spark.sparkContext.applicationId, directory, status.getModificationTime(), status.getLen()


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Unlike an RDD checkpoint, the re-read table keeps column pruning and filter
    pushdown (``ReadSchema`` / ``PushedFilters``), so later queries that need
    two columns do not deserialise whole rows. The folder is the cluster's
    ``spark.checkpoint.dir``, which survives executor loss.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._table_path = path
    return out


def materialize_by(df, name: str, column: str, dealt: bool = False):
    """Like :func:`materialize`, in buckets of ``column``: joins on it read the table without a shuffle.

    ``spark.sql.shuffle.partitions`` buckets of one file each; the table is an external one of a unique name.
    ``dealt`` says that the rows come hash-partitioned by the column already (a grouping by it).
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{base}/tables/{table}"
    df = df if dealt else df.repartition(buckets, column)
    df.write.format("parquet").option("path", path).bucketBy(buckets, column).sortBy(column).saveAsTable(table)
    out = spark.table(table)
    out._table_path, out._table_name = path, table
    return out


def discard(*frames) -> None:
    """Delete stored tables that nothing needs any more: their dependents are stored, or fully read.

    Call it only with the very frames that :func:`materialize` or :func:`materialize_by` returned.
    """
    for df in frames:
        path = getattr(df, "_table_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        name = getattr(df, "_table_name", None)
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        df._table_path = None
