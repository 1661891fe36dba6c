"""Configured queries over streams.

Two ways: algebraic queries run incrementally in Spark's state store (streaming_distinct, streaming_sessions); any SQL
runs per closed window by WindowRunner, which keeps what Spark has no state operator for: the accepted messages of open
windows, batch by batch, and where the windows stand. Every write of a batch goes to that batch's own folder and
replaces it, so a batch that runs again after a failure leaves the same results: effectively once. What no later batch
can need is deleted, so the state is that of the open windows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from windrow.config import Config, QuerySpec, SourceSpec
from windrow.functions.alerts import print_alerts
from windrow.functions.spatial import register
from windrow.operators import windows as win
from windrow.operators.sinks import KEYS, result_rows, write_batch
from windrow.plans.lift import lifted
from windrow.sources.ingest import accepted, decode_push, distinct_messages, drop_counts, parse_messages, reference_frame, typed_events

#: Where the windows stand after a batch, on one row for each batch that open windows still need.
CURSOR = "anchor bigint, next_start bigint, high bigint, batch bigint, most bigint"
#: A message: message is a digest of its text, which tells equal ones; reason says why it was dropped, if it was.
LOG = "source string, fields map<string,string>, ts timestamp, sec bigint, message string, reason string"


def message_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, push: bool = False) -> DataFrame:
    """raw: JSON lines (or push envelopes) that arrive as files."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(path)
    return decode_push(lines).select("raw") if push else lines.withColumnRenamed("value", "raw")


def streaming_distinct(events: DataFrame, key: str, size: int, lateness: int = win.LATENESS) -> DataFrame:
    """(window_start, window_end, n): distinct keys of each epoch-aligned window, in append mode, once the watermark passes it."""
    late = f"{lateness} seconds"
    once = events.withWatermark("ts", late).withColumn("window", F.window("ts", f"{size} seconds")).dropDuplicates(["window", key])
    counted = once.groupBy("window").agg(F.count(key).alias("n"))
    return counted.select(F.unix_timestamp("window.start").alias("window_start"), F.unix_timestamp("window.end").alias("window_end"), "n")


def streaming_sessions(events: DataFrame, key: str, gap: int = win.GAP, lateness: int = win.LATENESS) -> DataFrame:
    """(key, window_start, window_end, events) of closed sessions; a session ends with its last event."""
    marked = events.withWatermark("ts", f"{lateness} seconds").where(F.col(key).isNotNull())
    grouped = marked.groupBy(key, F.session_window("ts", f"{gap} seconds"))
    return grouped.agg(F.unix_timestamp(F.min("ts")).alias("window_start"), F.unix_timestamp(F.max("ts")).alias("window_end"), F.count("*").alias("events")).drop("session_window")


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class Cursor:
    """anchor: where windows begin; next_start: the first open window; high: the latest event; live: batches that open
    windows need, and the latest event of each."""

    anchor: int | None = None
    next_start: int | None = None
    high: int | None = None
    live: dict[int, int | None] = field(default_factory=dict)


@dataclass(frozen=True)
class WindowRunner:
    """One query over one stream. mode: anchored_inclusive, half_open, epoch_aligned or sliding; a session query's windows
    are its entities' sessions in any mode.

    A query's sources share its windows. One that is generic, or of sessions, runs over the events of each source with
    that source's names; others run over the events of all their sources together, with the columns of each.
    Beside the results, below results: _windows (records_processed of every window that fired) and _ingest (how many of
    each batch's messages were accepted, or dropped and why). The results of an alert query go to on_alert too.
    """

    config: Config
    query: QuerySpec
    results: str
    state: str
    mode: str = "anchored_inclusive"
    lateness: int = win.LATENESS
    slide: int = win.SLIDE
    gap: int = win.GAP
    strict: bool = False
    on_alert: Callable[[DataFrame, str, str], object] = print_alerts

    @property
    def sources(self) -> list[SourceSpec]:
        return self.config.sources_of(self.query)

    @property
    def by_source(self) -> bool:
        return self.query.data_source == "generic" or self.query.window_type == "session"

    @property
    def keys(self) -> tuple[str, ...]:
        return (*KEYS, *(("entity",) if self.query.window_type == "session" else ()))

    def events(self, log: DataFrame, sources: list[SourceSpec]) -> DataFrame:
        """The typed events of logged messages; equal messages of one source are one event, whatever their batches."""
        once = distinct_messages(log)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (typed_events(once, s, self.strict) for s in sources))

    def windowed(self, events: DataFrame, anchor: int, source: SourceSpec) -> DataFrame:
        size = self.query.window_size
        if self.query.window_type == "session":
            return win.session_windows(events, self.query.id_column(source), self.gap)
        if self.mode == "sliding" or self.query.window_type == "sliding":
            return win.sliding(events, size, self.slide, anchor)
        if self.mode == "epoch_aligned":
            return win.epoch_aligned(events, size)
        return (win.anchored_inclusive if self.mode == "anchored_inclusive" else win.half_open)(events, size, anchor)

    def first_open(self, high: int, anchor: int) -> int:
        """The start of the earliest window that has not closed when the latest event is at `high`."""
        slide = self.slide if "sliding" in (self.mode, self.query.window_type) else self.query.window_size
        origin = 0 if self.mode == "epoch_aligned" else anchor
        past = high - self.lateness - self.query.window_size - origin
        return origin + max(0, -(-past // slide)) * slide

    def cursor(self, spark: SparkSession, batch_id: int) -> Cursor:
        """Where the windows stood after a batch; the beginning, if there was none."""
        try:
            rows = spark.read.schema(CURSOR).parquet(f"{self.state}/cursor/of={batch_id}").collect()  # a row for each live batch
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return Cursor(rows[0].anchor, rows[0].next_start, rows[0].high, {r.batch: r.most for r in rows if r.batch is not None}) if rows else Cursor()

    def log(self, messages: DataFrame, batch_id: int) -> DataFrame:
        """A batch's messages, parsed and written once; those of the query's sources. The counts of all go to _ingest."""
        parsed = parse_messages(messages, self.config.sources)
        own = F.col("source").isin([s.name for s in self.sources])
        reason = F.when(F.col("reason").isNull() & ~own, "other source").otherwise(F.col("reason"))
        fields = F.when(reason.isNull(), F.col("fields")).alias("fields")
        logged = parsed.select("source", fields, "ts", "sec", F.sha2("raw", 256).alias("message"), reason.alias("reason"))
        logged.write.mode("overwrite").parquet(f"{self.state}/events/batch={batch_id}")
        every = messages.sparkSession.read.schema(LOG).parquet(f"{self.state}/events/batch={batch_id}")
        write_batch(drop_counts(every).coalesce(1), f"{self.results}/_ingest", batch_id)
        return accepted(every)

    def fire(self, ready: DataFrame, source: SourceSpec) -> tuple[DataFrame, DataFrame]:
        """(results, records_processed) of closed windows."""
        spark = ready.sparkSession
        refs = {r.name: reference_frame(spark, r) for s in self.sources for r in s.reference_tables.values()}
        found = lifted(spark, ready, self.query.text(source), refs, keys=self.keys)
        counted = ready.groupBy(*self.keys).agg(F.count("*").alias("records_processed"))
        if self.by_source:
            found, counted = (x.withColumn("data_source", F.lit(source.name)) for x in (found, counted))
        return found, counted

    def emit(self, fired: list[tuple[DataFrame, DataFrame]], batch_id: int) -> None:
        keys = (*self.keys, *(("data_source",) if self.by_source else ()))
        spark = fired[0][0].sparkSession
        rows = reduce(DataFrame.unionByName, (result_rows(r, self.query.name, self.query.return_type, keys) for r, _ in fired))
        write_batch(rows, self.results, batch_id)
        write_batch(reduce(DataFrame.unionByName, (c for _, c in fired)), f"{self.results}/_windows", batch_id)
        if self.query.is_alert:
            # the rows as they were written, not computed again
            written = spark.read.schema(rows.schema).parquet(f"{self.results}/batch={batch_id}")
            row = F.from_json("result", fired[0][0].drop(*keys).schema)
            self.on_alert(written.select(row.alias("row")).select("row.*"), self.query.name, self.query.alert_format)

    def batch(self, messages: DataFrame, batch_id: int) -> None:
        """A micro-batch: log its messages, then run the query over the windows that have closed."""
        before = self.cursor(messages.sparkSession, batch_id - 1)
        own = self.log(messages, batch_id)
        least, most = own.agg(F.min("sec"), F.max("sec")).first()
        after = (self.sessions if self.query.window_type == "session" else self.windows)(own, before, batch_id, least, most)
        self.settle(own.sparkSession, before, after, batch_id)

    def read(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        return accepted(spark.read.schema(LOG).parquet(*(f"{self.state}/events/batch={i}" for i in batches)))

    def windows(self, own: DataFrame, before: Cursor, batch_id: int, least: int | None, most: int | None) -> Cursor:
        live = before.live | ({batch_id: most} if most is not None else {})
        if not live and before.anchor is None:
            return before
        anchor = before.anchor if before.anchor is not None else least
        first = least // self.query.window_size * self.query.window_size if before.anchor is None and self.mode == "epoch_aligned" else anchor
        done = before.next_start if before.next_start is not None else first
        high = max(x for x in (before.high, most) if x is not None)
        open_ = max(done, self.first_open(high, anchor))
        if open_ > done and live:
            log = self.read(own.sparkSession, list(live)).where(F.col("sec") >= done)
            fired = []
            for sources in [[s] for s in self.sources] if self.by_source else [self.sources]:
                ready = self.windowed(self.events(log, sources), anchor, sources[0])
                fired.append(self.fire(ready.where((F.col("window_start") >= done) & (F.col("window_start") < open_)), sources[0]))
            self.emit(fired, batch_id)
        return Cursor(anchor, open_, high, {i: m for i, m in live.items() if m >= open_})

    def sessions(self, own: DataFrame, before: Cursor, batch_id: int, least: int | None, most: int | None) -> Cursor:
        """Sessions that ended before the latest event less the lateness and the gap have closed; the messages of the
        others are the next batch's state. Messages that come after their session could still be open are late: dropped."""
        if most is None and before.high is None:
            return before
        high = max(x for x in (before.high, most) if x is not None)
        spark, end = own.sparkSession, high - self.lateness - self.gap
        log = own if before.high is None else own.where(F.col("sec") >= before.high - self.lateness - self.gap)
        if before.live:
            log = log.unionByName(accepted(spark.read.schema(LOG).parquet(*(f"{self.state}/open/batch={i}" for i in before.live))))
        log = distinct_messages(log)
        fired, open_ = [], []
        for s in self.sources:
            own_log = log.where(F.col("source") == s.name)
            ready = self.windowed(typed_events(own_log, s, self.strict), 0, s)
            fired.append(self.fire(ready.where(F.col("window_end") < end), s))
            entity = F.col("fields")[s.id_field]
            still = win.session_windows(own_log.withColumn("__entity", F.when(entity != "", entity)), "__entity", self.gap).where(F.col("window_end") >= end)
            open_.append(still.select("source", "fields", "ts", "sec", "message"))
        self.emit(fired, batch_id)
        write_batch(reduce(DataFrame.unionByName, open_), f"{self.state}/open", batch_id)
        return Cursor(least if before.anchor is None else before.anchor, end, high, {batch_id: high})

    def settle(self, spark: SparkSession, before: Cursor, after: Cursor, batch_id: int) -> None:
        """Write where the windows stand; delete what only batches before the last one needed.

        This batch may run again, so what the cursor before it names stays until the next batch.
        """
        rows = [(after.anchor, after.next_start, after.high, i, m) for i, m in after.live.items()] or [(after.anchor, after.next_start, after.high, None, None)]
        spark.createDataFrame(rows, CURSOR).coalesce(1).write.mode("overwrite").parquet(f"{self.state}/cursor/of={batch_id}")
        old = self.cursor(spark, batch_id - 2)
        for i in {*old.live, batch_id - 1} - {*before.live}:
            for kind in ("events", "open"):
                remove(spark, f"{self.state}/{kind}/batch={i}")
        if self.query.window_type == "session":
            remove(spark, f"{self.state}/events/batch={batch_id - 1}")
        remove(spark, f"{self.state}/cursor/of={batch_id - 2}")

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        """The streaming query; trigger as for DataStreamWriter.trigger (all that is there, once, by default)."""
        if self.query.window_type == "session":
            for s in self.sources:
                self.query.id_column(s)
        writer = messages.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.state}/checkpoint").queryName(self.query.name)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_config(spark: SparkSession, config: Config, messages: DataFrame, results: str, state: str, axis_order: str = "authority", runner: Callable[..., WindowRunner] | None = None, **trigger) -> dict[str, StreamingQuery | Exception]:
    """Every query of a configuration over one stream, each with its own state; failures stay with their query.

    runner makes a query's runner: StatefulRunner, which keeps open windows in Spark's state store, unless another is given,
    such as partial(StatefulRunner, anchor=...) or WindowRunner.

    Queries that the configuration rejected, or that cannot start, stand there with their error. The session gets the
    spatial functions, which know the polygons of the reference tables.
    """
    from windrow.streaming.stateful import StatefulRunner

    rows = (r for s in config.sources.values() for t in s.reference_tables.values() for r in t.rows)
    register(spark, axis_order, [v for r in rows for v in r.values() if isinstance(v, str)])
    out: dict[str, StreamingQuery | Exception] = {name: ValueError(why) for name, why in config.rejected.items()}
    for q in config.queries:
        try:
            out[q.name] = (runner or StatefulRunner)(config, q, f"{results}/{q.name}", f"{state}/{q.name}").start(messages, **trigger)
        except Exception as e:
            out[q.name] = e
    return out


def finish(queries: dict[str, StreamingQuery | Exception]) -> None:
    """Wait for all queries, then raise one error that names each that failed."""
    failed = {}
    for name, q in queries.items():
        try:
            if isinstance(q, Exception):
                raise q
            q.awaitTermination()
        except Exception as e:
            failed[name] = e
    if failed:
        raise RuntimeError("; ".join(f"{n}: {e}" for n, e in failed.items()))
