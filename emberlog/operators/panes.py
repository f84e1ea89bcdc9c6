"""Issue reports that are kept up instead of computed anew: partial aggregates per fingerprint and pane of time.

A store is a folder with three Parquet tables, to which each batch of records adds what it has; a batch that comes again
replaces its own part. Whatever is in them merges, so batches and late records come in any order.

* ``panes``: per fingerprint and pane, the number of errors, the first and last time and the first arrival
* ``moments``: the same per millisecond; a report reads them only for the pane in which its window begins
* ``latest``: per fingerprint the last arrival of all, which is the report's sample

panes and moments are parted by ``slot``, a run of panes, so a report reads no more than its window, and expire() drops what no
window reaches any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ERROR
from .issues import errors_of

_PANES = "fingerprint string, pane long, n long, first_seen long, last_seen long, first_seq long, slot long, batch string"
_MOMENTS = "fingerprint string, pane long, timestamp long, n long, first_seq long, slot long, batch string"
_LATEST = f"fingerprint string, last_seq long, sample {ERROR.simpleString()}, batch string"
#: panes of a slot
SLOT = 64


class IssuePanes:
    """A store of panes ``pane_ms`` wide in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, pane_ms: int = 60_000):
        self.spark, self.path, self.pane_ms = spark, path.rstrip("/"), pane_ms

    def _place(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _write(self, rows: DataFrame, table: str, batch: str, slots: bool) -> None:
        """The batch's part of a table, in place of what it had there before."""
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("slot") if slots else writer).parquet(f"{self._place(table)}/batch={batch}")

    def _read(self, table: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._place(table))
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self._place(table)).parquet(self._place(table))

    def add(self, records: DataFrame, batch: str | int) -> None:
        """Takes up a batch of records. Its errors are aggregated before they are shuffled; moments come first, panes and latest from them."""
        e = errors_of(records).withColumn("pane", F.floor(F.col("timestamp") / self.pane_ms))
        slot = F.floor(F.col("pane") / SLOT).alias("slot")
        moments = e.groupBy("fingerprint", "pane", "timestamp").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
        self._write(moments.select("*", slot), "moments", str(batch), slots=True)
        own = self._read("moments", _MOMENTS).where(F.col("batch") == str(batch))
        self._write(_merged(own, F.col("timestamp"), F.col("timestamp"), "fingerprint", "pane", "slot"), "panes", str(batch), slots=True)
        latest = e.groupBy("fingerprint").agg(F.max("seq").alias("last_seq"), F.max_by("error", "seq").alias("sample"))
        self._write(latest, "latest", str(batch), slots=False)

    def reports(self, window_ms: int, as_of_ms: int) -> DataFrame:
        """As issues.issue_reports() of all records that were added."""
        start = as_of_ms - window_ms
        edge = start // self.pane_ms
        whole = self._read("panes", _PANES).where((F.col("slot") >= edge // SLOT) & (F.col("pane") > edge))
        cut = self._read("moments", _MOMENTS).where((F.col("slot") == edge // SLOT) & (F.col("pane") == edge) & (F.col("timestamp") >= start))
        parts = whole.drop("pane", "slot", "batch").unionByName(_merged(cut, F.col("timestamp"), F.col("timestamp"), "fingerprint"))
        seen = _merged(parts, F.col("first_seen"), F.col("last_seen"), "fingerprint")
        latest = self._read("latest", _LATEST).groupBy("fingerprint").agg(F.max_by("sample", "last_seq").alias("sample"))
        both = seen.join(latest, "fingerprint")
        return both.select("fingerprint", F.col("sample.boundary").alias("boundary"), F.col("n").alias("count"), "first_seen", "last_seen", F.col("sample.severity").alias("severity"), "sample", "first_seq")

    def compact(self, batch: str = "compacted") -> IssuePanes:
        """A store in a new folder with everything merged; the old one can be deleted when no one reads it."""
        other = IssuePanes(self.spark, f"{self.path}-{batch}", self.pane_ms)
        panes = _merged(self._read("panes", _PANES), F.col("first_seen"), F.col("last_seen"), "fingerprint", "pane", "slot")
        other._write(panes, "panes", batch, slots=True)
        moments = self._read("moments", _MOMENTS).groupBy("fingerprint", "pane", "timestamp", "slot").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
        other._write(moments, "moments", batch, slots=True)
        latest = self._read("latest", _LATEST).groupBy("fingerprint").agg(F.max("last_seq").alias("new"), F.max_by("sample", "last_seq").alias("sample"))
        other._write(latest.withColumnRenamed("new", "last_seq"), "latest", batch, slots=False)
        return other

    def expire(self, before_ms: int) -> int:
        """Deletes the slots that end before a time, beyond which no report's window reaches; returns how many folders went."""
        last = before_ms // self.pane_ms // SLOT
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        gone = 0
        for table in ("panes", "moments"):
            pattern = hadoop.Path(f"{self._place(table)}/batch=*/slot=*")
            system = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in system.globStatus(pattern) or []:
                if int(found.getPath().getName().removeprefix("slot=")) < last:
                    system.delete(found.getPath(), True)
                    gone += 1
        return gone


def _merged(rows: DataFrame, first: Column, last: Column, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(first).alias("first_seen"), F.max(last).alias("last_seen"), F.min("first_seq").alias("first_seq"))
