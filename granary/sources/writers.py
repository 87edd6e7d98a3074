"""Writers: JSON lines, merged parts, reports, flat archives, resumable output."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ROWS = 100_000


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys sorted, nulls kept; written in parallel by Spark's commit protocol."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def ordered_json_lines(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """As `json_lines`, in files that follow one another in `order`."""
    json_lines(df.repartitionByRange(*order).sortWithinPartitions(*order), path, mode)


def report(df: DataFrame, path: str) -> dict | list:
    """A small table as pretty JSON; more than REPORT_ROWS rows are an error."""
    rows = df.limit(REPORT_ROWS + 1).toJSON().collect() if hasattr(df, "toJSON") else [json.dumps(r.asDict(True), default=str) for r in df.limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError("too many rows for a report")
    out = [json.loads(r) for r in rows]
    data = out[0] if len(out) == 1 else out
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
    return data


def submission(df: DataFrame, path: str, order: str = "id") -> None:
    """Rows as one JSON array, or as lines if the path ends in .jsonl, written row by row as they arrive."""
    lines = path.endswith(".jsonl")
    with open(path, "w", encoding="utf-8") as f:
        f.write("" if lines else "[\n")
        for i, r in enumerate(df.orderBy(order).toLocalIterator()):
            f.write(("" if lines or i == 0 else ",\n") + json.dumps(r.asDict(True), ensure_ascii=False, default=str) + ("\n" if lines else ""))
        f.write("" if lines else "\n]\n")


def flat_zip(path: str, archive: str, name: str = "results.json") -> None:
    """One file at the top of a zip archive."""
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(path, name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resume(df: DataFrame, done_path: str, key: str) -> DataFrame:
    """The rows whose key isn't in the table at done_path; all of them if there is none. A null key counts as a key."""
    spark = df.sparkSession
    if not exists(spark, done_path):
        return df
    done = spark.read.parquet(done_path).select(F.col(key).alias("done_")).distinct()
    return df.join(done, F.col(key).eqNullSafe(F.col("done_")), "left_anti")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows with new keys, one per key; returns how many of the keys the table then has."""
    resume(df.dropDuplicates([key]), path, key).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path).join(df.select(F.col(key).alias("key_")).distinct(), F.col(key).eqNullSafe(F.col("key_")), "left_semi").count()


def index_points(df: DataFrame, path: str, buckets: int = 64, key: str = "id") -> None:
    """Points of an index partitioned by a hash of their key, so that a lookup by key reads one partition."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(df: DataFrame, ids: DataFrame, key: str = "id", buckets: int = 64) -> DataFrame:
    """Rows of an `index_points` table by key; dynamic pruning keeps the scan to the keys' partitions."""
    wanted = ids.select(key).distinct().withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return df.join(wanted, ["bucket", key], "left_semi")
