"""Product quantisation of vectors by Lloyd's rounds with heaps.

Vectors become integers and are cut into equal parts; every part position has a codebook. Rows are packed in blocks that
stay where they are: a table bucketed by block. Beside it lies the rounds' state, bucketed alike, so that a round joins
both without a shuffle and writes the state anew, never the vectors.

For every block, part position and entry there is a heap of the rows that the entry is nearest to. A row's key is its lower
bound (the distance to the second nearest entry) less its upper bound (that to the nearest), plus the drift that the entry
had gathered when the row was put in. An entry's drift grows each round by how far it moved and by how far any other one
did, which is what the bounds can lose. Rows on top of the heap with keys up to the drift may have another nearest entry:
they are popped and scanned exactly; all others keep theirs without a look at their vectors. All arithmetic that decides a
result is that of integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.llm.common import delete, if_small, partitions, scratch, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of a block.
BLOCK = 4096
#: Rows that are scanned at once.
AT_ONCE = 1024
#: Components of at most this size have exact distances in doubles; of at most that size in 64-bit integers.
EXACT, MOST = 1 << 21, 1 << 27
#: What bounds are tightened by, so that rounding never hides a tie.
MARGIN = 1e-6


@dataclass
class Codebooks:
    """entries[part, entry, position]; drift[part, entry]: what bounds may have lost since the first round."""

    entries: np.ndarray
    drift: np.ndarray
    exact: bool
    sums: np.ndarray = field(default=None)
    counts: np.ndarray = field(default=None)

    @classmethod
    def of(cls, first: np.ndarray, largest: int) -> Codebooks:
        """From the first vectors, (rows, parts, positions)."""
        entries = first.transpose(1, 0, 2).copy()
        shape = entries.shape
        return cls(entries, np.zeros(shape[:2]), largest <= EXACT, np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))

    def moved(self, changes: np.ndarray) -> Codebooks:
        """After a round: changes[part, entry] are what the sums, and last the counts, have gained."""
        sums, counts = self.sums + changes[..., :-1], self.counts + changes[..., -1]
        means = sums // np.maximum(counts, 1)[..., None]
        entries = np.where((counts > 0)[..., None], means, self.entries)
        step = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(axis=2))
        drift = self.drift.copy()
        if step.size:
            order = np.sort(step, axis=1)
            widest, next_widest = order[:, -1:], order[:, -2:-1] if step.shape[1] > 1 else np.zeros((len(step), 1))
            drift += step + np.where(step == widest, np.where((step == widest).sum(axis=1, keepdims=True) > 1, widest, next_widest), widest)
        return Codebooks(entries, drift, self.exact, sums, counts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scan(rows: np.ndarray, entries: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, lower less upper bound) of integer rows: every entry is looked at; ties go to the lower index."""
    kind = np.float64 if exact else np.int64
    near, slack = np.empty(len(rows), np.int64), np.empty(len(rows))
    e = entries.astype(kind)
    squares = (e * e).sum(axis=1)
    for i in range(0, len(rows), AT_ONCE):
        r = rows[i : i + AT_ONCE].astype(kind)
        d = (r * r).sum(axis=1)[:, None] - 2 * (r @ e.T) + squares
        best = d.argmin(axis=1)
        at = np.arange(len(r))
        upper = np.sqrt(d[at, best].astype(np.float64))
        lower = np.full(len(r), np.inf)
        if d.shape[1] > 1:
            d[at, best] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
            lower = np.sqrt(d.min(axis=1).astype(np.float64))
        near[i : i + len(r)], slack[i : i + len(r)] = best, lower - upper
    return near, slack


@dataclass
class Heaps:
    """The heaps of one block and part position, one an entry, of (key, row)."""

    heaps: list[list[tuple[float, int]]]

    @classmethod
    def read(cls, sizes: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> Heaps:
        pairs = list(zip(keys.tolist(), rows.tolist(), strict=True))
        ends = np.cumsum(sizes).tolist()
        return cls([pairs[e - n : e] for e, n in zip(ends, sizes.tolist(), strict=True)])

    def written(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = [p for h in self.heaps for p in h]
        return np.array([len(h) for h in self.heaps], np.int32), np.array([k for k, _ in pairs], np.float32), np.array([r for _, r in pairs], np.uint16)

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, their entries so far) of what the drift may have put to another entry; they leave their heaps."""
        rows, entries = [], []
        for e, (heap, lost) in enumerate(zip(self.heaps, drift.tolist(), strict=True)):
            while heap and heap[0][0] <= lost:
                rows.append(heappop(heap)[1])
                entries.append(e)
        return np.array(rows, np.int64), np.array(entries, np.int64)

    def push(self, rows: np.ndarray, entries: np.ndarray, slack: np.ndarray, drift: np.ndarray) -> None:
        keys = np.nextafter((slack - MARGIN + drift[entries]).astype(np.float32), np.float32(-np.inf))
        for row, e, key in zip(rows.tolist(), entries.tolist(), keys.tolist(), strict=True):
            heappush(self.heaps[e], (key, row))

    def fill(self, entries: np.ndarray, slack: np.ndarray, drift: np.ndarray) -> None:
        """All rows at once, into empty heaps."""
        keys = np.nextafter((slack - MARGIN + drift[entries]).astype(np.float32), np.float32(-np.inf))
        for row, (e, key) in enumerate(zip(entries.tolist(), keys.tolist(), strict=True)):
            self.heaps[e].append((key, row))
        for heap in self.heaps:
            heapify(heap)

    def codes(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.uint8)
        for e, heap in enumerate(self.heaps):
            out[[r for _, r in heap]] = e
        return out


def advance(parts: np.ndarray, state: list[Heaps] | None, books: Codebooks, changes: np.ndarray) -> list[Heaps]:
    """Assign a block's parts (part, row, position) anew; what entries gain or lose is added to changes."""
    k = books.entries.shape[1]
    out = []
    for p, rows in enumerate(parts):
        entries, drift = books.entries[p], books.drift[p]
        if state is None:
            heaps = Heaps([[] for _ in range(k)])
            near, slack = scan(rows, entries, books.exact)
            heaps.fill(near, slack, drift)
            gain(changes[p], near, rows, 1)
        else:
            heaps = state[p]
            popped, before = heaps.pop(drift)
            near, slack = scan(rows[popped], entries, books.exact)
            heaps.push(popped, near, slack, drift)
            other = near != before
            gain(changes[p], near[other], rows[popped[other]], 1)
            gain(changes[p], before[other], rows[popped[other]], -1)
        out.append(heaps)
    return out


def gain(changes: np.ndarray, entries: np.ndarray, rows: np.ndarray, sign: int) -> None:
    np.add.at(changes[:, :-1], entries, sign * rows.astype(np.int64))
    np.add.at(changes[:, -1], entries, sign)


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def packed(rows: DataFrame, length: int, parts: int, kind: str) -> DataFrame:
    """(block, ids, labels, parts): rows (id, label, v) by BLOCK at most; parts are the integers by part, row, position."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in it:
            for i in range(0, batch.num_rows, BLOCK):
                own = batch.slice(i, BLOCK)
                v = own.column(2).flatten().to_numpy().reshape(own.num_rows, parts, length // parts)
                made = v.transpose(1, 0, 2).astype(kind).tobytes()
                one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(own.column(0)), one(own.column(1)), pa.array([made], pa.binary())], ["block", "ids", "labels", "parts"])
                number += 1

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("parts", T.BinaryType())])
    return rows.select("id", "label", "v").mapInArrow(run, schema)


@dataclass(frozen=True)
class Bucketed:
    """A table in the shared folder, bucketed by block: joins of two of them need no shuffle."""

    rows: DataFrame
    name: str
    path: str

    @classmethod
    def of(cls, df: DataFrame, buckets: int) -> Bucketed:
        spark = df.sparkSession
        path = scratch(spark, "vector-codes")
        name = f"windrow_{uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(name)
        return cls(spark.table(name), name, path)

    def drop(self) -> None:
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(spark, self.path)


STATE = "block bigint, sizes binary, keys binary, rows binary, changes array<bigint>"


def block_parts(raw: bytes, parts: int, positions: int, kind: str, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(parts, n, positions)


def read_state(sizes: bytes | None, keys: bytes, rows: bytes, parts: int, n: int) -> list[Heaps] | None:
    if sizes is None:
        return None
    s, k, r = np.frombuffer(sizes, np.int32).reshape(parts, -1), np.frombuffer(keys, np.float32).reshape(parts, n), np.frombuffer(rows, np.uint16).reshape(parts, n)
    return [Heaps.read(*x) for x in zip(s, k, r, strict=True)]


def assigned(blocks: DataFrame, state: DataFrame | None, books: Codebooks, kind: str) -> DataFrame:
    """The state after a round, STATE: heaps by block; changes once a task, on its last block."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)  # entries and sums of the codebooks: a fixed size
    parts, _, positions = books.entries.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        changes = np.zeros((*own.entries.shape[:2], positions + 1), np.int64)
        held = None
        for batch in it:
            for block, n, raw, *before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held:
                    yield row(*held, None)
                heaps = advance(block_parts(raw, parts, positions, kind, n), read_state(*before, parts, n), own, changes)
                held = block, heaps
        if held:
            yield row(*held, changes.ravel())

    def row(block: int, heaps: list[Heaps], changes: np.ndarray | None) -> pa.RecordBatch:
        s, k, r = (np.concatenate(x).tobytes() for x in zip(*(h.written() for h in heaps), strict=True))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (s, k, r)), pa.array([changes], pa.list_(pa.int64()))], ["block", "sizes", "keys", "rows", "changes"])

    return with_state(blocks, state).mapInArrow(run, STATE)


def with_state(blocks: DataFrame, state: DataFrame | None, *more: str) -> DataFrame:
    """block, n, parts, sizes, keys, rows: the state is the small side, held while the bucket's blocks pass."""
    own = blocks.select("block", F.size("ids").alias("n"), "parts", *more)
    if state is None:
        nothing = F.lit(None).cast("binary")
        return own.select("block", "n", "parts", nothing.alias("sizes"), nothing.alias("keys"), nothing.alias("rows"), *more)
    return own.join(state.select("block", "sizes", "keys", "rows").hint("shuffle_hash"), "block").select("block", "n", "parts", "sizes", "keys", "rows", *more)


def gathered(state: DataFrame, books: Codebooks) -> np.ndarray:
    """The sum of all tasks' changes: as many numbers as the codebooks have, and their counts."""
    shape = (*books.entries.shape[:2], books.entries.shape[2] + 1)
    out = np.zeros(int(np.prod(shape)), np.int64)
    each = state.where("changes IS NOT NULL").select(F.posexplode("changes").alias("at", "gain"))
    for r in each.groupBy("at").agg(F.sum("gain").alias("gain")).collect():
        out[r["at"]] = r.gain
    return out.reshape(shape)


def codes(blocks: DataFrame, state: DataFrame | None, books: Codebooks, kind: str) -> DataFrame:
    """(id, label, code, error) of every row, after a last assignment."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    parts, _, positions = books.entries.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        unused = np.zeros((*own.entries.shape[:2], positions + 1), np.int64)
        for batch in it:
            for i, (n, raw, *before) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True)):
                v = block_parts(raw, parts, positions, kind, n)
                code = np.stack([h.codes(n) for h in advance(v, read_state(*before, parts, n), own, unused)])
                error = sum(((v[p].astype(np.int64) - own.entries[p][code[p]]) ** 2).sum(axis=1) for p in range(parts))
                written = code.T.tobytes().hex()
                columns = [batch.column(6)[i].values, batch.column(7)[i].values, pa.array([written[2 * parts * k : 2 * parts * (k + 1)] for k in range(n)]), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    schema = T.StructType([T.StructField("id", blocks.schema["ids"].dataType.elementType), T.StructField("label", blocks.schema["labels"].dataType.elementType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return with_state(blocks, state, "ids", "labels").mapInArrow(run, schema)


def compressed(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """((id, label, code, error), codebooks): codes of all rows whose vector is neither null nor with null or non-finite
    components. The rows are stored in the shared folder.

    Codebooks start with the parts of the vectors of the least ids (null ids last, equal ids by their vectors); with fewer
    rows than entries the codebooks are that much smaller. Equal rows are rows of their own. Ties go to the lower index;
    entries that nothing is nearest to stay. Other columns are not read; an empty table gives no rows. Vectors must have
    one length, which the number of parts divides, and components, scaled, of at most MOST: anything else is an error,
    because squared distances must fit into 64 bits.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector))).select(F.col(id_column).alias("id"), F.col(label).alias("label"), integers(F.col(vector), scale).alias("v"))
    size = F.size("v")
    shortest, longest, largest = kept.agg(F.min(size), F.max(size), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    length, largest = longest or 0, largest or 0
    if shortest is not None and shortest != longest or length % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {shortest} to {longest}")
    if largest > MOST or largest < 0:
        raise ValueError(f"components, scaled, must not pass {MOST}")
    kind = "int16" if largest < 1 << 15 else "int32"
    first = [r.v for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]  # at most `entries` rows
    books = Codebooks.of(np.array(first, np.int64).reshape(len(first), parts, length // parts), largest)
    buckets = partitions(spark)
    blocks = Bucketed.of(packed(kept, length, parts, kind).repartition(buckets, "block"), buckets)
    before = None
    for _ in range(rounds if first else 0):
        state = Bucketed.of(assigned(blocks.rows, before.rows if before else None, books, kind), buckets)
        books = books.moved(gathered(state.rows, books))
        if before:
            before.drop()
        before = state
    found = stored(codes(blocks.rows, before.rows if before else None, books, kind), "vector-codes")
    for t in (blocks, before):
        if t:
            t.drop()
    return found, books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every usable vector of embeddings, their errors, and the errors' sums by label."""
    found, books = compressed(table(spark, sf_dir, "embeddings"))
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    by_label = stored(by_label, "label-errors")
    joined = found.join(if_small(by_label), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for small tables: every round is a full assignment in relations of (part, id, position, x)."""
    near = lambda k: f"""dist{k} AS MATERIALIZED (
    SELECT x.p, x.r, e.e, sum((x.x - e.x) * (x.x - e.x)) AS d FROM x JOIN e{k} e ON x.p = e.p AND x.i = e.i GROUP BY ALL
), near{k} AS MATERIALIZED (
    SELECT p, r, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM dist{k} GROUP BY ALL
)"""  # noqa: E731
    move = lambda k: f"""mean{k} AS (
    SELECT x.p, n.e, x.i, sum(x.x) AS s, count(*) AS c FROM x JOIN near{k} n ON x.p = n.p AND x.r = n.r GROUP BY ALL
), e{k + 1} AS MATERIALIZED (
    SELECT e.p, e.e, e.i, CAST(coalesce((m.s - ((m.s % m.c) + m.c) % m.c) // m.c, e.x) AS BIGINT) AS x FROM e{k} e LEFT JOIN mean{k} m ON e.p = m.p AND e.e = m.e AND e.i = m.i
)"""  # noqa: E731
    steps = ",\n".join(f"{near(k)}, {move(k)}" for k in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), c AS (
    SELECT r, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos, len(embedding) // {PARTS} AS w FROM kept
), x AS MATERIALIZED (
    SELECT pos // w AS p, r, pos % w AS i, CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT) AS x FROM c
), e0 AS MATERIALIZED (
    SELECT p, r AS e, i, x FROM x WHERE r < {ENTRIES}
), {steps}, {near(rounds)}, coded AS (
    SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r
), b AS (
    SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM e{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), b
"""


ORACLE = oracle()
