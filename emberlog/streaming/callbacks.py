"""Callbacks of running streams: what failed, and which errors reached their threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..config import Config
from ..operators.issues import errors_of

#: name of the counts that observed() adds to a delivery log
COUNTS = "delivery"


class DeliveryError(Exception):
    """Envelopes of a micro-batch that weren't sent; or, without counts, the end of a query by an error."""

    def __init__(self, message: str, failed: int = 0, refused: int = 0):
        super().__init__(message)
        self.failed, self.refused = failed, refused


def observed(log: DataFrame) -> DataFrame:
    """A delivery log (status, reason) whose tries are counted for DeliveryListener; counting is part of the micro-batch's own pass."""
    status = F.col("status")
    return log.observe(COUNTS, F.count_if(status == "sent").alias("sent"), F.count_if(status == "failed").alias("failed"), F.count_if(status == "refused").alias("refused"), F.max(F.when(status != "sent", F.col("reason"))).alias("reason"))


class DeliveryListener(StreamingQueryListener):
    """Calls on_error for each micro-batch with envelopes that failed or were refused, and when a query ends by an error."""

    def __init__(self, on_error: Callable[[Exception], None]):
        self.on_error = on_error

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counts = (event.progress.observedMetrics or {}).get(COUNTS)
        if counts is not None and counts["failed"] + counts["refused"] > 0:
            self.on_error(DeliveryError(f"{counts['failed']} envelopes failed, {counts['refused']} were refused: {counts['reason']}", counts["failed"], counts["refused"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.on_error(DeliveryError(event.exception))


def listen(spark: SparkSession, on_error: Callable[[Exception], None]) -> DeliveryListener:
    """Adds a listener; spark.streams.removeListener() takes it away."""
    listener = DeliveryListener(on_error)
    spark.streams.addListener(listener)
    return listener


def trigger_reports(fired: DataFrame, records: DataFrame, cfg: Config) -> DataFrame:
    """Alerts of fired rows (fingerprint, seq, timestamp, cnt): settings and the report, with the error that fired."""
    e = errors_of(records).select("seq", "fingerprint", "error")
    client = {"source": cfg.source, "channel": cfg.channel, "runtime": cfg.runtime, "threshold_count": cfg.errors.threshold_count, "window_ms": cfg.errors.threshold_window_ms}
    report = F.struct("fingerprint", F.col("error.boundary").alias("boundary"), F.col("cnt").alias("count"), F.col("timestamp").alias("last_seen"), F.col("error.severity").alias("severity"), F.col("error").alias("sample"))
    return fired.join(e, ["seq", "fingerprint"]).select(*[F.lit(v).alias(k) for k, v in client.items()], "seq", report.alias("report"))


class ThresholdConsumer:
    """foreachBatch function over an issue stream: calls back for the rows that fired, once per micro-batch.

    The fired rows of a micro-batch are written to ``table`` under its number before anything is called, and a mark
    after it; a micro-batch that comes again with its mark is passed over. After a crash between both, its rows are
    called for again, in the same order. Rows come to the driver one by one; firing is rare by its cooldown.
    """

    def __init__(self, callback: Callable[[dict], None], table: str, on_error: Callable[[Exception], None] | None = None):
        self.callback, self.table, self.on_error = callback, table.rstrip("/"), on_error

    def _there(self, spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place, mark = f"{self.table}/batch_id={batch_id}", f"{self.table}-done/batch_id={batch_id}"
        if self._there(spark, f"{mark}/_SUCCESS"):
            return
        if not self._there(spark, f"{place}/_SUCCESS"):
            batch.where("fired").write.mode("overwrite").parquet(place)
        for row in spark.read.schema(batch.schema).parquet(place).orderBy("seq").toLocalIterator():
            try:
                self.callback(row.asDict(recursive=True))
            except Exception as error:  # one report's failure doesn't hold up the others
                if self.on_error is not None:
                    self.on_error(error)
        spark.range(1).write.mode("overwrite").parquet(mark)


def on_threshold(issues: DataFrame, callback: Callable[[dict], None], table: str, checkpoint: str, on_error: Callable[[Exception], None] | None = None, **trigger) -> StreamingQuery:
    """Starts calling back for the fired rows of issue_stream(); they are kept in the Parquet table ``table``. trigger: as of writeStream.trigger()."""
    writer = issues.writeStream.option("checkpointLocation", checkpoint).foreachBatch(ThresholdConsumer(callback, table, on_error))
    return (writer.trigger(**trigger) if trigger else writer).start()
