"""A stream that pulls messages from a log in shards, and acknowledges them once a checkpoint holds their results.

    spark.dataSource.register(PullSource)
    spark.readStream.format("windrow_pull").option("url", "http://broker:8080/topic").load()

Offsets are positions by shard. The driver asks only where shards begin and end; ranges of positions are read by tasks, so
a batch that runs again reads the same messages. commit() comes after the batch's end is in the checkpoint, and is what
acknowledges: nothing is lost or repeated over a restart. Another broker needs a client with the four methods of HttpLog;
option client names it as module:class, and it is made from the options.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from importlib import import_module
from typing import Any

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Messages of one task, and of one batch of them that is in memory.
A_TASK, AT_ONCE = 100_000, 500
SCHEMA = "raw string, shard string, position bigint"


class HttpLog:
    """A log behind HTTP: GET /shards gives {shard: [first position kept, next position]}; GET /read?shard=&from=&to= one
    JSON string a line, for every position; POST /acknowledge takes {shard: position}, up to which nothing is needed."""

    def __init__(self, options: Mapping[str, str]):
        self.url, self.timeout = options["url"].rstrip("/"), float(options.get("timeout", "30"))

    def _open(self, path: str, data: bytes | None = None):
        return urllib.request.urlopen(urllib.request.Request(self.url + path, data=data), timeout=self.timeout)

    def _shards(self) -> dict[str, list[int]]:
        with self._open("/shards") as r:
            return json.load(r)

    def begins(self) -> dict[str, int]:
        return {k: v[0] for k, v in self._shards().items()}

    def ends(self) -> dict[str, int]:
        return {k: v[1] for k, v in self._shards().items()}

    def read(self, shard: str, start: int, end: int) -> Iterator[str]:
        with self._open("/read?" + urllib.parse.urlencode({"shard": shard, "from": start, "to": end})) as r:
            for line in r:
                yield json.loads(line)

    def acknowledge(self, ends: dict[str, int]) -> None:
        self._open("/acknowledge", json.dumps(ends).encode()).close()


def client_of(options: Mapping[str, str]) -> Any:
    module, _, name = options.get("client", "windrow.sources.pull:HttpLog").partition(":")
    return getattr(import_module(module), name)(options)


@dataclass
class Range(InputPartition):
    """Positions of one shard, the end exclusive."""

    shard: str
    start: int
    end: int


class PullReader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)
        self.a_task = int(options.get("messagespertask", options.get("messagesPerTask", A_TASK)))

    def initialOffset(self) -> dict:
        return client_of(self.options).begins()

    def latestOffset(self) -> dict:
        return client_of(self.options).ends()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Ranges of every shard; one that has come up since is read from its first position kept."""
        fresh = client_of(self.options).begins() if set(end) - set(start) else {}
        return [Range(s, a, min(a + self.a_task, n)) for s, n in sorted(end.items()) for a in range(start.get(s, fresh.get(s, 0)), n, self.a_task)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        position, held = partition.start, []
        for raw in client_of(self.options).read(partition.shard, partition.start, partition.end):
            held.append(raw)
            if len(held) == AT_ONCE:
                yield self._batch(partition.shard, position, held)
                position, held = position + len(held), []
        if position + len(held) != partition.end:
            raise OSError(f"shard {partition.shard}: {position + len(held) - partition.start} messages for positions {partition.start} to {partition.end}")
        if held:
            yield self._batch(partition.shard, position, held)

    def _batch(self, shard: str, position: int, raw: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(raw, pa.string()), pa.array([shard] * len(raw)), pa.array(range(position, position + len(raw)), pa.int64())], ["raw", "shard", "position"])

    def commit(self, end: dict) -> None:
        client_of(self.options).acknowledge(end)


class PullSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "windrow_pull"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PullReader:
        return PullReader(self.options)
