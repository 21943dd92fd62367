"""Feeds as streams: latest state, change-only reports, snapshots and failure handling.

State is kept in a log with two parts. ``delta`` has one folder of collapsed rows for each micro-batch; after every
``COMPACT_EVERY`` batches the running query folds them into ``base``, a table in buckets of the key
(``jobmetrics.sources.buckets``). Folding writes only the buckets with new rows, and a batch that needs the state of its keys
reads fewer than ``COMPACT_EVERY`` deltas and, in the buckets of its keys, the pages that can hold them. So neither grows
with the keys that a stream has ever seen. A batch that runs again overwrites its own folders, and never reads what it
has written itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from jobmetrics.operators.skew import lookup, top_per_key
from jobmetrics.operators.state import changed_steps, collapse, merge_latest
from jobmetrics.sources.buckets import BUCKETS, BucketedTable
from jobmetrics.sources.feeds import split_rejects

REFRESH = "8 seconds"
MAX_FAILURES = 10
BATCH = "batch"
COMPACT_EVERY = 8


class Log:
    """Latest rows per key, by batch. Rows have the dates of ``state.collapse``: ``create_date`` is the first one."""

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], seq: Sequence[str], every: int = COMPACT_EVERY, buckets: int = BUCKETS
    ):
        self.spark, self.path, self.keys, self.seq, self.every = spark, path, list(keys), list(seq), every
        self.plain = schema
        self.schema = StructType([*schema.fields, StructField(BATCH, IntegerType())])
        self.base = BucketedTable(spark, f"{path}/base", schema, keys, buckets)

    def _batches(self) -> list[int]:
        """Batches whose delta was written in full."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/delta/{BATCH}=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in done)

    def _open(self, before: int | None) -> list[str]:
        """Folders of the deltas that are not in the base, of batches before the given one."""
        folded = max((v for v in self.base.versions() if before is None or v < before), default=-1)
        return [f"{self.path}/delta/{BATCH}={n}" for n in self._batches() if n > folded and (before is None or n < before)]

    def _deltas(self, before: int | None) -> DataFrame:
        folders = self._open(before)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/delta").parquet(*folders)

    def read(self, before: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """One row per key, as of the batch before the given one; at least those whose keys ``near`` has."""
        base = self.base.at(before)
        kept = base.read() if near is None else base.near(near)
        rows = kept.withColumn(BATCH, F.lit(-1)).unionByName(self._deltas(before))
        return collapse(rows, self.keys, [BATCH, *self.seq]).drop(BATCH)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Keep the rows of a batch, one per key, and fold the log when it is time."""
        rows.select(*self.plain.names).write.mode("overwrite").parquet(f"{self.path}/delta/{BATCH}={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.base.at(batch_id)
            fresh = collapse(self._deltas(batch_id + 1), self.keys, [BATCH, *self.seq]).drop(BATCH)
            self.base.merge(fresh, lambda old, new: merge_latest(old, new, self.keys), batch_id)
            self._forget()

    def _forget(self) -> None:
        """Remove what lies before the last fold but one, which a batch that runs again may still read."""
        self.base.forget(2)
        folds = self.base.versions()
        if len(folds) < 2:
            return
        for n in self._batches():
            if n <= folds[-2]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/delta/{BATCH}={n}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _start(writer, checkpoint: str, refresh: str | None) -> StreamingQuery:
    """Run all the time at the given interval, or once over what has arrived."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if refresh is None else writer.trigger(processingTime=refresh)
    return writer.start()


def _state_schema(rows: DataFrame) -> StructType:
    dated = rows.withColumn("create_date", F.lit(None).cast(rows.schema["update_date"].dataType))
    return dated.schema


def upsert_stream(
    updates: DataFrame,
    log: str,
    checkpoint: str,
    keys: Sequence[str],
    seq: Sequence[str],
    refresh: str | None = REFRESH,
    every: int = COMPACT_EVERY,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the latest state of ``updates`` in ``log``. ``refresh=None`` is the final flush."""
    state = Log(updates.sparkSession, log, _state_schema(updates), keys, seq, every, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        state.write(collapse(batch, keys, seq), batch_id)

    return _start(updates.writeStream.foreachBatch(write), checkpoint, refresh)


def read_state(spark: SparkSession, log: str, schema: StructType, keys: Sequence[str], seq: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Current table of a log of updates of the given schema: a later batch wins, inside a batch the order of arrival."""
    dated = _state_schema(spark.createDataFrame([], schema))
    return Log(spark, log, dated, keys, seq, buckets=buckets).read()


def append_rejects(rejects: DataFrame, path: str, checkpoint: str, refresh: str | None = REFRESH) -> StreamingQuery:
    """Keep the reports that could not be read."""
    return _start(rejects.writeStream.format("parquet").option("path", path), checkpoint, refresh)


def within_tolerance(updates: DataFrame, failures: DataFrame, seq: str, limit: int = MAX_FAILURES) -> DataFrame:
    """Updates up to the failure with which tracking of their flow stops, the ``limit``-th one, and the final one.

    The tracker sends one more report when it stops: the first one after that failure, if it can be read.
    """
    stops = (
        top_per_key(failures.select("flow_id", seq), ["flow_id"], [F.col(seq)], limit)
        .groupBy("flow_id")
        .agg(F.max(seq).alias("_stop"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == limit)
        .drop("_n")
    )
    after = lookup(updates.select("flow_id", seq).unionByName(failures.select("flow_id", seq)), stops, ["flow_id"]).filter(F.col(seq) > F.col("_stop"))
    ends = stops.join(after.groupBy("flow_id").agg(F.min(seq).alias("_final")), "flow_id", "left")
    kept = F.col("_stop").isNull() | (F.col(seq) < F.col("_stop")) | F.coalesce(F.col(seq) == F.col("_final"), F.lit(False))
    return lookup(updates, ends, ["flow_id"], "left").filter(kept).drop("_stop", "_final")


def failure_counts(rejects: DataFrame, limit: int = MAX_FAILURES) -> DataFrame:
    """Unreadable reports per flow, and whether it is still tracked."""
    counts = rejects.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n_failed"))
    return counts.withColumn("tracked", F.col("n_failed") < limit)


def tolerant_stream(
    feed: DataFrame, out: str, log: str, checkpoint: str, limit: int = MAX_FAILURES, refresh: str | None = REFRESH, buckets: int = BUCKETS
) -> StreamingQuery:
    """Readable reports of ``feed`` (envelopes with flow_id and seq), batch by batch, of flows that are still tracked.

    A flow is dropped from its ``limit``-th unreadable report on, counted over all batches, but for the final report: the
    first one after that, if it can be read. ``log`` has one row for each flow with failures: how many there were, at
    most ``limit``, and whether the final report has come.
    """
    spark = feed.sparkSession
    kinds = {"n_failed": IntegerType(), "ended": BooleanType(), "update_date": IntegerType(), "create_date": IntegerType()}
    state = Log(spark, log, StructType([feed.schema["flow_id"], *(StructField(name, kind) for name, kind in kinds.items())]), ["flow_id"], [], buckets=buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good, bad = split_rejects(batch)
            known = state.read(batch_id, batch.select("flow_id").filter("flow_id is not null")).select("flow_id", "n_failed", "ended")
            nth = F.row_number().over(Window.partitionBy("flow_id").orderBy("seq"))
            first = bad.select("flow_id", "seq").withColumn("nth", nth).filter(F.col("nth") <= limit)
            seen = first.join(known, "flow_id", "left").withColumn("total", F.col("nth") + F.coalesce("n_failed", F.lit(0)))
            gone = known.filter(F.col("n_failed") >= limit).select("flow_id", F.lit(None).cast("bigint").alias("_stop"), F.lit(True).alias("_gone"), "ended")
            fresh = seen.filter(F.col("total") == limit).select("flow_id", F.col("seq").alias("_stop"), F.lit(False).alias("_gone"), F.lit(False).alias("ended"))
            fresh = fresh.join(gone.select("flow_id"), "flow_id", "left_anti")
            stops = gone.unionByName(fresh).groupBy("flow_id").agg(F.min("_stop").alias("_stop"), F.max("_gone").alias("_gone"), F.max("ended").alias("ended"))
            reports = good.select("flow_id", "seq").unionByName(bad.select("flow_id", "seq"))
            late = lookup(reports, stops, ["flow_id"]).filter("not ended and (_gone or seq > _stop)").groupBy("flow_id").agg(F.min("seq").alias("_final"))
            ends = stops.join(late, "flow_id", "left")
            kept = F.col("_gone").isNull() | (~F.col("_gone") & (F.col("seq") < F.col("_stop"))) | F.coalesce(F.col("seq") == F.col("_final"), F.lit(False))
            out_rows = lookup(good, ends, ["flow_id"], "left").filter(kept).drop("_stop", "_gone", "_final", "ended")
            out_rows.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")
            totals = seen.groupBy("flow_id").agg(F.least(F.max("total"), F.lit(limit)).cast("int").alias("failed"))
            changed = totals.join(late, "flow_id", "full_outer").join(known, "flow_id", "left")
            date = F.lit(batch_id).cast("int")
            changed = changed.select(
                "flow_id",
                F.coalesce(F.greatest("failed", "n_failed"), F.lit(0)).alias("n_failed"),
                (F.coalesce("ended", F.lit(False)) | F.col("_final").isNotNull()).alias("ended"),
                date.alias("update_date"),
                date.alias("create_date"),
            )
            state.write(changed, batch_id)
        finally:
            batch.unpersist()

    return _start(feed.writeStream.foreachBatch(write), checkpoint, refresh)


def changed_steps_stream(
    updates: DataFrame,
    out: str,
    log: str,
    checkpoint: str,
    seq: Sequence[str],
    bucket: str,
    refresh: str | None = REFRESH,
    every: int = COMPACT_EVERY,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Streaming form of ``changed_steps``, written to ``out`` batch by batch.

    The last status of each step is kept in ``log``, one narrow row per step; a batch reads those of its own steps. Inside a batch the rows of a step
    are put in order by slices, as in the batch form; only the first of them needs the kept status.
    """
    spark = updates.sparkSession
    narrow = updates.select("step_id", "step_status", *seq, F.lit(0).alias("update_date"), F.lit(0).alias("create_date"))
    state = Log(spark, log, narrow.schema, ["step_id"], seq, every, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            known = state.read(batch_id, batch).select("step_id", "step_status")
            changes = changed_steps(batch, seq, bucket, known)
            changes.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")
            last = batch.groupBy("step_id").agg(F.max_by(F.struct("step_status", *seq), F.struct(*seq)).alias("_row"))
            state.write(last.select("step_id", "_row.*", F.lit(0).alias("update_date"), F.lit(0).alias("create_date")), batch_id)
        finally:
            batch.unpersist()

    return _start(updates.writeStream.foreachBatch(write), checkpoint, refresh)
