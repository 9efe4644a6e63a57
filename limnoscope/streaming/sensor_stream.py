"""Incremental ingest: repeated rows are dropped once per watermark span, daily figures stay current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from limnoscope.operators.quantiles import distribution_from_counts
from limnoscope.operators.sizing import SALTS
from limnoscope.schemas import SENSOR, SENSOR_IDENTITY


def read_feed(spark: SparkSession, path: str, schema=SENSOR, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """Landed Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def drop_repeated(
    feed: DataFrame, identity: Sequence[str] = SENSOR_IDENTITY, ts: str = "date_time", delay: str = "2 days",
    salt_from: Sequence[str] = (),
) -> DataFrame:
    """The delay must exceed the time after which a row may be delivered again.

    With `salt_from`, columns in which copies differ (arrival number, file), copies are first reduced
    to one per salt, so the task that holds a row copied very often sees few of them.
    """
    once = feed.withWatermark(ts, delay)
    if salt_from:
        salted = once.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(SALTS)).cast("int"))
        once = salted.dropDuplicatesWithinWatermark([*identity, "_salt"]).drop("_salt")
    return once.dropDuplicatesWithinWatermark(list(identity))


def append_to(feed: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Process all landed files, then stop; a restart goes on where the checkpoint ends."""
    writer = feed.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_value_counts(
    feed: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", delay: str = "2 days"
) -> DataFrame:
    """Rows per (day, keys, value). State is spread by value, so a hot sensor is no hot task.

    Rows later than the delay are dropped.
    """
    kept = feed.withWatermark(ts, delay).where(F.col(value).isNotNull())
    counted = kept.groupBy(F.window(ts, "1 day"), *keys, F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return counted.select(F.to_date("window.start").alias("date"), *keys, "_value", "_n")


_BATCH, _MERGED = "batch=", "merged="


def _folders(spark: SparkSession, path: str) -> tuple[int, dict[int, str], dict[int, str]]:
    """(last merged batch or -1, batch folders, finished merged folders) under a path."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    batches, merged = {}, {}
    for status in files.listStatus(root) if files.exists(root) else []:
        name = status.getPath().getName()
        for prefix, found in ((_BATCH, batches), (_MERGED, merged)):
            # A folder counts once its writer has finished.
            if name.startswith(prefix) and files.exists(context._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[int(name[len(prefix):])] = f"{path}/{name}"
    return max(merged, default=-1), batches, merged


def latest_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest count of every (day, keys, value): the last merged folder and the batches after it."""
    last, batches, merged = _folders(spark, path)
    live = [merged[last]] if last >= 0 else []
    live += [folder for k, folder in sorted(batches.items()) if k > last]
    if not live:
        raise FileNotFoundError(f"no stored counts under {path}")
    stored = spark.read.parquet(*live)
    return stored.groupBy("date", *keys, "_value").agg(F.max_by("_n", "batch_id").alias("_n"), F.max("batch_id").alias("batch_id"))


def merge_batches(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Fold all finished batches into one folder of newest counts, then drop what it replaces; the last batch folded.

    The new folder counts only when it is finished, and older ones go only after that, so a reader or a job that is
    interrupted at any point finds the same counts. Readers that listed folders before should list again.
    """
    last, batches, merged = _folders(spark, path)
    newest = max(batches, default=-1)
    if newest > last:
        latest_counts(spark, path, keys).write.mode("overwrite").parquet(f"{path}/{_MERGED}{newest}")
        last = newest
    context = spark.sparkContext
    for gone in [f for k, f in batches.items() if k <= last] + [f for k, f in merged.items() if k < last]:
        place = context._jvm.org.apache.hadoop.fs.Path(gone)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return last


def keep_current(counts: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (), merge_every: int = 0) -> StreamingQuery:
    """Write changed counts of every batch under its number; a repeated batch replaces its own folder.

    With `merge_every`, every so many batches are folded into one folder, so what is stored and read stays as large as
    the newest counts. A batch that comes again after it was folded is left out: its counts are in the merged folder.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        if _folders(batch.sparkSession, path)[0] >= batch_id:
            return
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/{_BATCH}{batch_id}")
        if merge_every and (batch_id + 1) % merge_every == 0:
            merge_batches(batch.sparkSession, path, keys)

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_daily_statistics(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Daily mean, median, range and count from the latest counts."""
    latest = latest_counts(spark, path, keys).drop("batch_id")
    return distribution_from_counts(latest, ["date", *keys], {"value_median": 0.5})
