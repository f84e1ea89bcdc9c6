"""A sink for envelopes as a data source: ``df.write.format(...)`` and ``df.writeStream.format(...)``.

Rows need ``envelope_id`` and ``body``. Tasks send their rows themselves. A failing transport fails the task, which
Spark runs again; ids are the same then, so a receiver that knows ids takes each envelope once. When all tasks of a
write or micro-batch have ended, the driver confirms it, once per number: a receiver may hold envelopes back until then.
A micro-batch that is repeated after a crash is confirmed under the same number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..config import Config
from ..functions.text import secure_endpoint
from ..streaming.delivery import http_post


@dataclass
class Sent(WriterCommitMessage):
    envelopes: int


class _Sender:
    """What batch and stream writers share."""

    def __init__(self, endpoint: str, headers: dict, transport: Callable[[dict], None], confirm: bool, columns: list[str]):
        missing = {"envelope_id", "body"} - set(columns)
        if missing:
            raise ValueError(f"envelopes need the columns {', '.join(sorted(missing))}")
        self.endpoint, self.headers, self.transport, self.confirm = endpoint, headers, transport, confirm

    def _post(self, ident: str, body: str) -> None:
        self.transport({"endpoint": self.endpoint, "body": body, "headers": {**self.headers, "idempotency-key": ident}, "keepalive": False})

    def write(self, iterator: Iterator[Row]) -> Sent:
        n = 0
        for row in iterator:
            self._post(row["envelope_id"], row["body"])
            n += 1
        return Sent(n)

    def _confirm(self, number: str, messages: list[Sent | None]) -> None:
        if self.confirm:
            self._post(f"confirm-{number}", json.dumps({"confirmed": number, "envelopes": sum(m.envelopes for m in messages if m is not None)}))


class _Batch(_Sender, DataSourceWriter):
    def __init__(self, number: str, *given):
        super().__init__(*given)
        self.number = number

    def commit(self, messages: list[Sent | None]) -> None:
        self._confirm(self.number, messages)

    def abort(self, messages: list[Sent | None]) -> None:
        pass  # what was sent stays sent; it isn't confirmed


class _Stream(_Sender, DataSourceStreamWriter):
    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        self._confirm(str(batchId), messages)

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        pass


def register(spark: SparkSession, cfg: Config, name: str = "envelopes", confirm: bool = False) -> str:
    """Makes a sink of cfg's endpoint, headers and transport under a name; returns the name. Option ``number``: what a batch is confirmed as."""
    if not cfg.endpoint:
        raise ValueError("a sink of envelopes needs an endpoint")
    given = cfg.endpoint, dict(cfg.headers), cfg.transport or http_post, confirm

    class Envelopes(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Batch(self.options.get("number", "0"), *given, schema.names)

        def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
            return _Stream(*given, schema.names)

    spark.dataSource.register(Envelopes)
    return name


def with_ids(made: DataFrame, queue: str = "queue_key") -> DataFrame:
    """envelopes() with ``envelope_id``: of a queue, its first and its last record."""
    whole = F.sha2(F.concat(F.col(queue).cast("string"), F.lit("\0"), F.col("first_seq").cast("string"), F.lit("\0"), F.col("last_seq").cast("string")), 256)
    return made.withColumn("envelope_id", F.substring(whole, 1, 32))


def admitted(made: DataFrame, cfg: Config) -> DataFrame:
    """The envelopes that cfg's endpoint may have."""
    return made.where(F.lit(not cfg.errors.secure_endpoint_only) | secure_endpoint(F.lit(cfg.endpoint or "")) | ~F.col("has_error"))
