"""The seen-posting store on Parquet.

Two layouts. A snapshot store holds complete versions, `v=1`, `v=2`, ...; a version counts
once its `_SUCCESS` marker is there, and readers take the newest, so nothing that is
being read is ever overwritten. A log store only adds rows, in folders by day and batch:
a micro-batch writes what it saw and nothing else. Its manifest names the live folders, in
numbered files of which the newest counts: readers open the folders of the days they ask for
and list no others, a repeated batch replaces its entries, closed days are compacted, and
days past the time to live are taken off and deleted. One writer, many readers.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsieve.operators.keyed import _first_of_key
from jobsieve.schema import SEEN

LOG_SCHEMA = T.StructType(SEEN.fields + [
    T.StructField("seen_day", T.DateType()), T.StructField("batch_id", T.LongType()),
])


def _versions(spark: SparkSession, root: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    numbers = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    return sorted(n for n in numbers if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/v={n}/_SUCCESS")))


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def empty_seen(spark: SparkSession) -> DataFrame:
    return _empty(spark, SEEN)


def read_seen(spark: SparkSession, root: str) -> DataFrame:
    """Newest complete version; an empty store where there is none."""
    versions = _versions(spark, root)
    return spark.read.schema(SEEN).parquet(f"{root}/v={versions[-1]}") if versions else empty_seen(spark)


def write_seen(df: DataFrame, root: str) -> int:
    """Writes the next version and returns its number."""
    spark = df.sparkSession
    version = (_versions(spark, root) or [0])[-1] + 1
    df.select(*SEEN.fieldNames()).write.mode("overwrite").parquet(f"{root}/v={version}")
    return version


def store_size_kb(spark: SparkSession, root: str) -> DataFrame:
    """One row: size of the store's files in whole KB, from file metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("length")
    return files.agg(F.round(F.sum("length") / 1024).cast("bigint").alias("db_size_kb"))


# Manifest files that stay for readers that are under way.
KEPT_MANIFESTS = 5


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, f"{root}/_manifest")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def live_folders(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(day, batch) of the log's folders that count, as the newest manifest has them."""
    numbers = _manifests(spark, root)
    if not numbers:
        return []
    fs, path = _fs(spark, f"{root}/_manifest/{numbers[-1]:012d}.json")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [(day, batch) for day, batch in json.loads(text)]


def _write_manifest(spark: SparkSession, root: str, entries: list[tuple[str, int]]) -> None:
    """The next manifest: written aside, then renamed, so that readers see all of it or none."""
    numbers = _manifests(spark, root)
    number = numbers[-1] + 1 if numbers else 1
    fs, aside = _fs(spark, f"{root}/_manifest/.{number:012d}-{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(json.dumps(sorted(entries)).encode()))
    finally:
        stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/{number:012d}.json")
    if not fs.rename(aside, target):
        raise RuntimeError(f"{target} is there already: the log has a second writer")
    for old in numbers[:-KEPT_MANIFESTS]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/{old:012d}.json"), False)


def _folder(root: str, day: str, batch: int) -> str:
    return f"{root}/seen_day={day}/batch_id={batch}"


def append_seen_log(rows: DataFrame, root: str, day: str | Column, batch_id: int) -> None:
    """Adds a batch's store rows under their day; a repeated batch replaces what it wrote before, also on another day.

    `day` is one day, or a date for every row; a batch may then have rows of several days.
    """
    spark = rows.sparkSession
    dated = rows.withColumn("seen_day", F.lit(day).cast("date") if isinstance(day, str) else day.cast("date"))
    dated = dated.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    (dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seen_day", "batch_id").parquet(root))
    if isinstance(day, str):
        days = [day]
    else:
        days = [r[0].isoformat() for r in dated.select("seen_day").distinct().collect()]
    _write_manifest(spark, root, [e for e in live_folders(spark, root) if e[1] != batch_id] + [(d, batch_id) for d in days])


def read_seen_log(spark: SparkSession, root: str, since: str | None = None, skip_batch: int | None = None,
                  until: str | None = None) -> DataFrame:
    """Rows of the log's live folders from day `since` to day `until`; `skip_batch` leaves one batch out."""
    folders = [_folder(root, day, batch) for day, batch in live_folders(spark, root)
               if (since is None or day >= since) and (until is None or day <= until) and batch != skip_batch]
    fs, _ = _fs(spark, root)
    folders = [f for f in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f))]  # a batch without rows has none
    if not folders:
        return _empty(spark, LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).option("basePath", root).parquet(*folders)


def compact_seen_log(spark: SparkSession, root: str, before: str) -> int:
    """Folds the folders of every day before `before` into one that holds the last write of each id; returns how many days.

    New folders have negative numbers, so they never meet a batch's. The old ones stay until `vacuum_seen_log`.
    """
    entries = live_folders(spark, root)
    days = sorted({day for day, _ in entries if day < before})
    days = [day for day in days if sum(d == day for d, _ in entries) > 1]
    if not days:
        return 0
    number = min([0, *[batch for _, batch in entries]]) - 1
    closed = read_seen_log(spark, root, days[0], until=days[-1]).where(F.col("seen_day").cast("string").isin(days))
    last = _first_of_key(closed.withColumn("_id", F.concat_ws("\u0001", F.col("seen_day").cast("string"), "posting_id")),
                         "_id", [F.desc("last_updated"), F.desc("batch_id")]).drop("_id")
    (last.withColumn("batch_id", F.lit(number).cast("bigint")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("seen_day", "batch_id").parquet(root))
    _write_manifest(spark, root, [e for e in entries if e[0] not in days] + [(day, number) for day in days])
    return len(days)


def expire_seen_log(spark: SparkSession, root: str, since: str) -> int:
    """Takes the days before `since` off the log and deletes their folders; returns how many days went."""
    entries = live_folders(spark, root)
    gone = sorted({day for day, _ in entries if day < since})
    if gone:
        _write_manifest(spark, root, [e for e in entries if e[0] >= since])
        fs, _ = _fs(spark, root)
        for day in gone:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/seen_day={day}"), True)
    return len(gone)


def vacuum_seen_log(spark: SparkSession, root: str) -> int:
    """Deletes folders below the live days that no longer count; returns how many. Run it when no reader is under way."""
    live = set(live_folders(spark, root))
    fs, _ = _fs(spark, root)
    gone = 0
    for day in sorted({d for d, _ in live}):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/seen_day={day}")
        for status in (fs.listStatus(path) if fs.exists(path) else []):
            name = status.getPath().getName()
            if name.startswith("batch_id=") and (day, int(name[9:])) not in live:
                gone += bool(fs.delete(status.getPath(), True))
    return gone


def current_seen(log: DataFrame) -> DataFrame:
    """The store a log stands for: last write of each id."""
    return _first_of_key(log, "posting_id", [F.desc("last_updated"), F.desc("batch_id")]).select(*SEEN.fieldNames())
