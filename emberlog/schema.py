"""Schemas of the tables, and the session settings that queries rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

_S, _L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ERROR = _struct(boundary=_S, name=_S, message=_S, fingerprint=_S, handled=T.BooleanType(), severity=_S, stack=_S, component_stack=_S, tags=T.ArrayType(_S))
EVENT = _struct(seq=_L, component=_S, action=_S, kind=_S, channel=_S, label=_S, href=_S, variant=_S, request_id=_S, context=_S, timestamp=_L, error=ERROR)
REPORT = _struct(seq=_L, boundary=_S, error=_struct(name=_S, message=_S, stack=_S), raw=_S, thrown=_S, component_stack=_S, handled=T.BooleanType(), severity=_S, tags=T.ArrayType(_S), context=_S, channel=_S, timestamp=_L)
RECORD = _struct(id=_S, seq=_L, kind=_S, component=_S, action=_S, channel=_S, runtime=_S, label=_S, href=_S, variant=_S, request_id=_S, source=_S, session_id=_S, timestamp=_L, context=_S, error=ERROR)
ISSUE = _struct(fingerprint=_S, boundary=_S, count=_L, first_seen=_L, last_seen=_L, severity=_S, sample=ERROR)
TRIGGER = _struct(source=_S, channel=_S, runtime=_S, threshold_count=T.IntegerType(), window_ms=_L, report=ISSUE)
ENVELOPE = _struct(batch_id=_L, source=_S, channel=_S, runtime=_S, sent_at=_L, n_events=T.IntegerType(), body=_S)


#: keyed state of the streams lies in RocksDB
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> SparkSession:
    """Raises unless the session's state store is one that keyed state needs; settings() sets it."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise RuntimeError(f"keyed state needs spark.sql.streaming.stateStore.providerClass = {STATE_STORE}; call settings(spark) first")
    return spark


def settings(spark: SparkSession) -> SparkSession:
    """Times are UTC; later map keys win; keyed state of streams in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark
