"""Windows and sessions in Spark's state store, for any SQL over closed windows.

The rows of open windows are list state under their window; a timer per key fires once the watermark has passed the
window's end, and hands the window's rows on, each once. Sessions are kept by entity in the same way. Results, their
figures and alerts are then written as WindowRunner writes them. Windows begin at an anchor that is given or looked up in
the first batch, or at the epoch.

A row whose window has already fired is late: it goes to _late beside the results, with how far behind it was, and changes
no result. What was accepted or dropped is observed in the query's progress: no second job counts it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from windrow.operators import windows as win
from windrow.operators.sinks import write_batch
from windrow.sources.ingest import accepted, observed, parse_messages, typed_events
from windrow.streaming.engine import WindowRunner

#: A row in the state; us: the event time in microseconds.
ROW = "source string, fields string, us bigint, message string"
#: What a key hands on: rows of closed windows, or late rows with how many seconds behind they were.
HANDED = f"window_start bigint, window_end bigint, entity string, {ROW}, behind bigint"
#: Parts of a window's rows, so that no key holds a busy window as a whole.
SHARDS = 32
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How the search for an anchor ends.
FOUND = "the anchor is found"
STATE_COLUMNS = ["source", "fields", "us", "message"]


def handed(rows: pd.DataFrame, start: int | None, end: int | None, entity: str | None, behind: int | None = None) -> pd.DataFrame:
    kinds = {"window_start": "Int64", "window_end": "Int64", "behind": "Int64"}
    out = rows[STATE_COLUMNS].assign(window_start=start, window_end=end, entity=entity, behind=behind)
    return out[["window_start", "window_end", "entity", *STATE_COLUMNS, "behind"]].astype(kinds)


def once(rows: list[tuple]) -> pd.DataFrame:
    """Rows in a frame, equal messages of one source once."""
    return pd.DataFrame(rows, columns=STATE_COLUMNS).drop_duplicates(["source", "message"])


class Windows(StatefulProcessor):
    """Rows of one part of one window, until the watermark passes the window's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end, _ = key
        fires, now = (int(end) + 1) * 1000, timerValues.getCurrentWatermarkInMs()
        known = self.rows.exists()
        for pdf in rows:
            if now >= fires:
                yield handed(pdf, int(start), int(end), None, now // 1000 - int(end))
                continue
            self.rows.appendList(list(pdf[STATE_COLUMNS].itertuples(index=False, name=None)))
            if not known:
                self.handle.registerTimer(fires)
                known = True

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = once(list(self.rows.get()))
        self.rows.clear()
        yield handed(found, int(key[0]), int(key[1]), None)

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """An entity's rows until its sessions have closed: the watermark is past their last row by more than the gap."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", ROW)

    def fires(self, end: int) -> int:
        return (end + self.gap + 1) * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            sec = pdf["us"] // 1_000_000
            late = self.fires(sec) <= now
            if late.any():
                for behind, own in pdf[late].groupby(now // 1000 - sec[late] - self.gap):
                    yield handed(own, None, None, key[1], int(behind))
            own = pdf[~late]
            if len(own):
                self.rows.appendList(list(own[STATE_COLUMNS].itertuples(index=False, name=None)))
                for end in sorted({int(s) for s in sec[~late]}):
                    self.handle.registerTimer(self.fires(end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = once(list(self.rows.get()))
        if not len(found):
            return
        found = found.assign(sec=found["us"] // 1_000_000).sort_values("sec", kind="stable")
        session = (found["sec"].diff() > self.gap).cumsum()
        left = []
        for _, own in found.groupby(session):
            start, end = int(own["sec"].iloc[0]), int(own["sec"].iloc[-1])
            if self.fires(end) <= timerValues.getCurrentWatermarkInMs():
                yield handed(own, start, end, key[1])
            else:
                left += list(own[STATE_COLUMNS].itertuples(index=False, name=None))
        self.rows.clear()
        if left:
            self.rows.put(left)

    def close(self) -> None:
        pass


class Best(StatefulProcessor):
    """The k first rows of a window in some order: what is kept is never more than they are."""

    def __init__(self, k: int, columns: list[str], schema: str, order: list[tuple[str, bool]]):
        self.k, self.columns, self.schema, self.order = k, columns, schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("best", self.schema)

    def first(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values([c for c, _ in self.order], ascending=[up for _, up in self.order], kind="stable").head(self.k)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fires = (int(key[1]) + 1) * 1000
        if timerValues.getCurrentWatermarkInMs() >= fires:
            return iter(())
        held = list(self.rows.get()) if self.rows.exists() else []
        if not held:
            self.handle.registerTimer(fires)
        best = pd.DataFrame(held, columns=self.columns) if held else None
        for pdf in rows:
            best = self.first(pdf[self.columns] if best is None else pd.concat([best, pdf[self.columns]], ignore_index=True))
        self.rows.put(list(best.itertuples(index=False, name=None)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best = self.first(pd.DataFrame(list(self.rows.get()), columns=self.columns)).reset_index(drop=True)
        self.rows.clear()
        yield best.assign(window_start=int(key[0]), window_end=int(key[1]), place=best.index + 1)[["window_start", "window_end", "place", *self.columns]]

    def close(self) -> None:
        pass


def streaming_top_k(windowed: DataFrame, order: list[tuple[str, bool]], k: int, columns: list[str]) -> DataFrame:
    """(window_start, window_end, place, columns) of each closed window's k first rows by order (column, ascending); a stream.

    windowed: a stream with a watermark, and windows assigned. Order columns must not be null; put one that breaks ties
    last. Before the shuffle every batch of rows is cut to its own k first of each window. Start the query inside
    state_provider(). Late rows of windows that have closed are dropped.
    """
    keys = ["window_start", "window_end"]
    kept = windowed.select(*keys, *columns)
    names, up = [c for c, _ in order], [u for _, u in order]

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.sort_values(names, ascending=up, kind="stable").groupby(keys, sort=False).head(k)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in columns)
    best = Best(k, columns, own, order)
    return kept.mapInPandas(cut, kept.schema).groupBy(*keys).transformWithStateInPandas(best, f"window_start bigint, window_end bigint, place int, {own}", "Append", "EventTime")


@contextmanager
def state_provider(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which state with timers asks for."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Figures(StreamingQueryListener):
    """What queries have observed as they went, batch by batch: (query, batch, figures), and to on_batch, if given."""

    def __init__(self, on_batch: Callable[[str, int, dict], object] | None = None):
        self.batches: list[tuple[str, int, dict]] = []
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            found = (event.progress.name, event.progress.batchId, row.asDict())
            self.batches.append(found)
            if self.on_batch:
                self.on_batch(*found)

    def onQueryTerminated(self, event) -> None:
        pass

    def total(self, query: str) -> dict[str, int]:
        """The sums of a query's figures; a batch that ran again counts as its last run."""
        last = {batch: figures for name, batch, figures in self.batches if name == query}
        return {k: sum(f[k] for f in last.values()) for k in next(iter(last.values()), {})}


@dataclass(frozen=True)
class StatefulRunner(WindowRunner):
    """WindowRunner's results with the open windows in Spark's state store.

    anchor: the second at which anchored and sliding windows begin; epoch_aligned windows and sessions need none. Without
    one it is the first batch's earliest accepted event, which is looked up once and kept below state: the source must be
    one that reads what it has again. An entity's open session is one key's state; other windows are kept in SHARDS parts.
    """

    anchor: int | None = None
    shards: int = SHARDS

    def begun(self, messages: DataFrame) -> int:
        if self.query.window_type == "session" or self.mode == "epoch_aligned":
            return 0
        if self.anchor is not None:
            return self.anchor
        kept = self.kept_anchor(messages.sparkSession)
        return self.learnt_anchor(messages) if kept is None else kept

    def kept_anchor(self, spark: SparkSession) -> int | None:
        try:
            return spark.read.schema("anchor bigint").parquet(f"{self.state}/anchor").first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def learnt_anchor(self, messages: DataFrame) -> int:
        """The earliest second of the first batch that has any. That batch is not finished here, so nothing of it is
        acknowledged; the query itself reads it again."""

        def look(batch: DataFrame, _: int) -> None:
            found = win.anchor_of(batch)
            if found is not None:
                batch.sparkSession.createDataFrame([(found,)], "anchor bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.state}/anchor")
                raise StopIteration(FOUND)

        own = accepted(parse_messages(messages, self.config.sources)).where(F.col("source").isin([s.name for s in self.sources]))
        looking = own.writeStream.foreachBatch(look).option("checkpointLocation", f"{self.state}/looking").trigger(availableNow=True).start()
        try:
            looking.awaitTermination()
        except StreamingQueryException as e:
            if FOUND not in str(e):
                raise
        found = self.kept_anchor(messages.sparkSession)
        if found is None:
            raise ValueError(f"query {self.query.name}: no event yet that windows could begin at; give an anchor")
        return found

    def kept(self, messages: DataFrame) -> DataFrame:
        """(keys..., ROW) of the query's own accepted messages, with the watermark on their time."""
        parsed = observed(parse_messages(messages, self.config.sources), "ingest")
        own = accepted(parsed).where(F.col("source").isin([s.name for s in self.sources]))
        marked = own.withWatermark("ts", f"{self.lateness} seconds")
        row = [F.col("source"), F.to_json("fields").alias("fields"), F.unix_micros("ts").alias("us"), F.sha2("raw", 256).alias("message")]
        if self.query.window_type == "session":
            entity = reduce(lambda e, s: F.when(F.col("source") == s.name, F.col("fields")[s.id_field]).otherwise(e), self.sources, F.lit(None).cast("string"))
            return marked.withColumn("entity", entity).where("entity IS NOT NULL AND entity <> ''").select(F.col("source").alias("of"), "entity", *row)
        placed = self.windowed(marked, self.begun(messages), self.sources[0])
        return placed.select("window_start", "window_end", F.pmod(F.xxhash64("raw"), F.lit(self.shards)).alias("shard"), *row)

    def closed(self, messages: DataFrame) -> DataFrame:
        """HANDED: the rows of windows as they close, and late rows."""
        session = self.query.window_type == "session"
        keys = ("of", "entity") if session else ("window_start", "window_end", "shard")
        processor = Sessions(self.gap) if session else Windows()
        return self.kept(messages).groupBy(*keys).transformWithStateInPandas(processor, HANDED, "Append", "EventTime")

    def fired(self, rows: DataFrame, batch_id: int) -> None:
        """A batch of closed windows: run the query over them and write what it gives."""
        rows = rows.persist()
        try:
            write_batch(rows.where("behind IS NOT NULL").select("window_start", "window_end", "entity", "source", "fields", F.timestamp_micros("us").alias("ts"), "behind"), f"{self.results}/_late", batch_id)
            ready = rows.where("behind IS NULL").withColumns({"fields": F.from_json("fields", "map<string,string>"), "ts": F.timestamp_micros("us"), "sec": F.floor(F.col("us") / 1_000_000)})
            if ready.isEmpty():
                return
            results = []
            for sources in [[s] for s in self.sources] if self.by_source else [self.sources]:
                typed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (typed_events(ready, s, self.strict, self.keys) for s in sources))
                results.append(self.fire(typed, sources[0]))
            self.emit(results, batch_id)
        finally:
            rows.unpersist()

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        if self.query.window_type == "session":
            for s in self.sources:
                self.query.id_column(s)
        with state_provider(messages.sparkSession):
            writer = self.closed(messages).writeStream.foreachBatch(self.fired).option("checkpointLocation", f"{self.state}/checkpoint").queryName(self.query.name)
            return writer.trigger(**(trigger or {"availableNow": True})).start()
