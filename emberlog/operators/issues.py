"""Errors of one fingerprint as issues: counts in a sliding window, reports and triggers.

``seq`` is the order of arrival. A hot fingerprint is dealt by slices of time or of arrivals, never to one task.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..sources.shared import stored
from . import folds, ranks


def errors_of(records: DataFrame) -> DataFrame:
    return records.where("kind = 'error' and error is not null").select("seq", "timestamp", F.col("error.fingerprint").alias("fingerprint"), "error")


def issue_reports(records: DataFrame, window_ms: int, as_of_ms: int) -> DataFrame:
    """Reports as they are read at ``as_of_ms``, which no timestamp exceeds; see folded_counts() otherwise.

    Count, first and last look at the window only; the sample is the last arrival of all.
    Partial aggregates are made before the shuffle.
    """
    e = errors_of(records)
    inside = F.col("timestamp") >= F.lit(as_of_ms - window_ms)
    ts = F.when(inside, F.col("timestamp"))
    g = e.groupBy("fingerprint").agg(F.count(ts).alias("count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max_by("error", "seq").alias("sample"), F.min(F.when(inside, F.col("seq"))).alias("first_seq"))
    return g.where("count > 0").select("fingerprint", F.col("sample.boundary").alias("boundary"), "count", "first_seen", "last_seen", F.col("sample.severity").alias("severity"), "sample", "first_seq")


_BEST_FIRST = (F.desc, "count"), (F.desc, "last_seen"), (F.asc, "first_seq")


def ranked(reports: DataFrame, most: int | None = None) -> DataFrame:
    """Most frequent first, then latest, then first arrived."""
    out = reports.orderBy(*[order(c) for order, c in _BEST_FIRST])
    return out.limit(most) if most else out


def placed(reports: DataFrame) -> DataFrame:
    """All reports with their ``place`` in that order, from 1, without one task that holds them all."""
    return ranks.numbered(reports, [order(c) for order, c in _BEST_FIRST]).withColumn("place", F.col("place") + 1)


def window_counts(records: DataFrame, window_ms: int) -> DataFrame:
    """seq, fingerprint, timestamp and ``cnt``: errors in the window when each arrived. For arrivals in order of time.

    Time is cut into slices of a window's width. A row also goes to the next slice, which its window may reach, so a
    fingerprint that is everywhere is dealt by slices.
    """
    return _window_counts(errors_of(records).select("seq", "fingerprint", "timestamp"), window_ms)


def _window_counts(e: DataFrame, window_ms: int) -> DataFrame:
    own = F.floor(F.col("timestamp") / F.lit(max(window_ms, 1)))
    e = e.withColumn("_own", own).withColumn("_slice", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    reach = Window.partitionBy("fingerprint", "_slice").orderBy("timestamp").rangeBetween(-window_ms, Window.currentRow)
    peers = Window.partitionBy("fingerprint", "_slice", "timestamp").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    return e.withColumn("cnt", F.count("*").over(reach) - F.count("*").over(peers)).where("_own = _slice").drop("_own", "_slice")


def folded_counts(records: DataFrame, window_ms: int) -> DataFrame:
    """The same for arrivals in any order: an error stays only while no later arrival has put it out of its window.

    A fingerprint is cut into blocks of arrivals; see folds.windows().
    """
    return folds.windows(errors_of(records).select("seq", "fingerprint", "timestamp"), window_ms)


def arrived(alive: list[int], t: int, window_ms: int) -> int:
    """Puts a timestamp into the heap of a window, takes out what it ends, and returns how many are left."""
    heappush(alive, t)
    while alive[0] < t - window_ms:
        heappop(alive)
    return len(alive)


def triggers(counts: DataFrame, threshold: int, window_ms: int) -> DataFrame:
    """The rows of counts that fire: enough errors, and none of the key fired within the window before.

    Only rows that reach the threshold are looked at, in order of arrival and in blocks; see folds.cooldowns().
    """
    return folds.cooldowns(counts.where(F.col("cnt") >= threshold), window_ms)


#: fired rows are broadcast to their errors up to this number, which is counted first
MOST_BROADCAST = 100_000


def trigger_rows(records: DataFrame, cfg: Config, in_order: bool = True) -> DataFrame:
    """Alerts: the client's source, channel and runtime, the settings, and the report at that moment.

    Late arrivals may share a seq: they fire in order of time, and equal ones are one alert (the least error is its sample).
    """
    limit, width = cfg.errors.threshold_count, cfg.errors.threshold_window_ms
    counts = window_counts(records, width) if in_order else folded_counts(records, width)
    fired = stored(triggers(counts, limit, width).withColumnRenamed("timestamp", "fired_at"), "fired")
    keys = ["seq", "fingerprint"] if in_order else ["seq", "fingerprint", "fired_at"]
    e = errors_of(records).withColumnRenamed("timestamp", "fired_at").select(*keys, "error")
    e = e.join(F.broadcast(fired) if fired.count() <= MOST_BROADCAST else fired, keys)
    if not in_order:
        e = e.groupBy(*fired.columns).agg(F.min("error").alias("error"))
    client = {"source": cfg.source, "channel": cfg.channel, "runtime": cfg.runtime, "threshold_count": limit, "window_ms": width}
    return e.select(*[F.lit(v).alias(k) for k, v in client.items()], "seq", "fired_at", F.struct("fingerprint", F.col("error.boundary").alias("boundary"), F.col("cnt").alias("count"), F.col("fired_at").alias("last_seen"), F.col("error.severity").alias("severity"), F.col("error").alias("sample")).alias("report"))


def seeded_triggers(restored: DataFrame, records: DataFrame, cfg: Config) -> DataFrame:
    """Triggers of records when restored ones came first: those are counted, never fire and set no cooldown."""
    limit, width = cfg.errors.threshold_count, cfg.errors.threshold_window_ms
    marked = [errors_of(r).select("seq", "fingerprint", "timestamp", F.lit(flag).alias("restored")) for r, flag in ((restored, True), (records, False))]
    counts = _window_counts(marked[0].unionByName(marked[1]), width).where("not restored").drop("restored")
    return triggers(counts, limit, width)
