"""Session settings and the folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

SPREAD_BYTES = 64 << 20
_scratch: list[str] = []
_tables: list[tuple[SparkSession, str]] = []


def build_session(app: str = "granary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`).

    Where the setting is absent a local session gets a scratch folder of its
    own; a cluster without it is an error, since a machine-local folder would
    lose data with an executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _scratch:
        _scratch.append(tempfile.mkdtemp(prefix="granary-"))
        atexit.register(shutil.rmtree, _scratch[0], ignore_errors=True)
    return "file://" + _scratch[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted by `release`."""
    if not _tables:
        atexit.register(release)
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex[:12]}"
    _tables.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as parquet to the shared folder and read back.

    Cuts the lineage and survives the loss of executors; use it where a result
    feeds more than one later stage and is dearer to recompute than to store.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input dealt out to all cores, for work that is dear per row.

    A file with one row group is read by one task however many cores there are.
    Inputs whose tables have SPREAD_BYTES and more are read by many tasks and not
    shuffled.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df


def plain_unions(spark: SparkSession) -> None:
    """Lets unions forget their inputs' partitioning.

    Spark 4.1 zips the partitions of inputs that are hashed alike, which fails
    where adaptive execution has merged them to different numbers.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def release() -> None:
    """Deletes the tables that `written` has made so far; call it once no result that reads them is needed any more.

    It also runs when Python ends.
    """
    while _tables:
        spark, path = _tables.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended; nothing is left to do then
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
