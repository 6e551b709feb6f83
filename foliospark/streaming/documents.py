"""Documents as streams.

Rendering, parsing, formatting and validation work row by row, so a stream of documents needs no
state: the same columns and plans run on streaming tables in append mode.  Corpus counts over a
stream are windowed aggregates behind a watermark; documents later than it are dropped by Spark,
as the watermark says.  `first_documents` keeps one row an id within the watermark; `newest_versions`
keeps the newest version of every document in state, which timers end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliospark.engine import Engine
from foliospark.sources.documents import shared_folder


def render_stream(engine: Engine, stream: DataFrame, source: str = "source", variables: str | None = None) -> DataFrame:
    """The stream with its HTML."""
    return engine.render(stream, source, variables)


def validate_stream(engine: Engine, stream: DataFrame, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Problems of a stream's documents: parsed in Arrow batches and checked by a broadcast join, both stateless."""
    return engine.validate(stream, id_col, source)


def problem_counts(problems: DataFrame, time: str, delay: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, error_id, level, n) of a stream of problems that carries an event time; windows slide where `slide` says so."""
    rows = problems.withWatermark(time, delay).groupBy(F.window(time, window, slide).alias("w"), "error_id", "level").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), "error_id", "level", "n")


def first_documents(stream: DataFrame, time: str, id_col: str = "doc_id", delay: str = "10 minutes") -> DataFrame:
    """The first arrival of each id within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_col])


def drained(stream: DataFrame) -> DataFrame:
    """What a bounded stream gives to its end, through a Parquet table in the shared folder."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Plans that need whole tables (ordered aggregates, sorted diagnostics) on each micro-batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: What `newest_versions` gives: a version's status is new, newer, late or ended.
VERSION = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("version", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("status", T.StringType()), T.StructField("source", T.StringType())])


def _newest(idle_ms: int) -> StatefulProcessor:
    """The processor; its class is made here so that it travels by value, as the process that sets up state has no files of the session."""
    made = Row(*VERSION.fieldNames())
    epoch, tick = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)
    order = lambda r: (r[1], r[2], r[3] is not None, r[3] or "")

    class Newest(StatefulProcessor):
        """Per document the newest version so far; a timer ends the state when none has come for a while."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("newest", "version long, micros long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            held = self.state.get()  # nothing, where the document has no state
            best = None
            for row in rows:  # (doc_id, version, at, source): a document's rows of one batch
                if held and row[1] <= held[0]:
                    yield made(key[0], row[1], row[2], "late", row[3])
                elif best is None or order(row) >= order(best):
                    if best is not None:
                        yield made(key[0], best[1], best[2], "late", best[3])
                    best = row
                else:
                    yield made(key[0], row[1], row[2], "late", row[3])
            if best is not None:
                yield made(key[0], best[1], best[2], "newer" if held else "new", best[3])
                micros = (best[2] - epoch) // tick  # rows have times with a zone, a state would lose it
                micros = max(micros, held[1]) if held else micros
                self.state.update((best[1], micros))
                if held:
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
                self.handle.registerTimer(micros // 1000 + idle_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            version, micros = self.state.get()
            self.state.clear()
            yield made(key[0], version, epoch + micros * tick, "ended", None)

        def close(self) -> None:
            pass

    return Newest()


def newest_versions(stream: DataFrame, id_col: str = "doc_id", version: str = "version", time: str = "at", source: str = "source", delay: str = "10 minutes", idle: timedelta = timedelta(days=1)) -> DataFrame:
    """(doc_id, version, at, status, source) of every version of a stream of documents.

    The greatest version wins, the later and then the larger text of equals.  A version that is no
    greater than its document's newest is `late`, also one that was overtaken in its own batch; the
    first is `new`, others are `newer`.  When the watermark is `idle` past the newest version's time,
    the document's state ends with a row `ended`, and what comes then is new again.  Rows older than
    the watermark (which Spark applies a batch later), and null ids, versions and times, are dropped.
    State is one version number and one time a document; texts are not kept.  The session's state
    store becomes RocksDB, which timers need.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col(id_col).cast("string").alias("doc_id"), F.col(version).cast("long").alias("version"), F.col(time).cast("timestamp").alias("at"), F.col(source).alias("source"))
    rows = rows.filter("doc_id is not null and version is not null and at is not null").withWatermark("at", delay)
    return rows.groupBy("doc_id").transformWithState(_newest(int(idle.total_seconds() * 1000)), VERSION, "Append", "EventTime")


def problem_sessions(problems: DataFrame, time: str, by: list[str], gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, stop, by, n): runs of problems with less than `gap` between one and the next."""
    rows = problems.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")
