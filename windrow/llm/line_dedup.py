"""Lines that many documents share, found with two Bloom filters.

Every task puts the hashes of its documents' lines into a filter of what has been seen once, and those it has seen before
into one of what has been seen twice. The tasks' filters are merged segment by segment: what two of them have seen once
has been seen twice. Only lines that the second filter holds are suspected repeats; their digests alone are shuffled, and
counted exactly. Filters only let too much through, never too little, so the result does not depend on their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import common
from windrow.llm.common import batches, if_small, marked_possible, stored, table

#: Documents that a line must be found in to be a repeated one, and code points that its key must have.
LEAST_DOCUMENTS, LEAST_CHARS = 10, 1
#: Bits that a line's hash sets.
HASHES = 3
#: Bytes of text for which the filters get one bit, and the bounds of their size in bits. The upper bound is 128 MB.
BYTES_A_BIT, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Bytes of a filter that travel as one row.
SEGMENT = 1 << 17
#: Input partitions that one filter is filled from, at most.
READ_BY_ONE = 256
#: Digests that a task counts before it hands them on.
COUNTED = 100_000
#: Bytes of a line's digest.
DIGEST = 16
SPACES = " \t\n\v\f\r"

U = np.uint64


@dataclass(frozen=True)
class Lines:
    """The lines of a batch of texts: row of each, number within it, the line, its key, and whether the key counts."""

    row: np.ndarray
    number: np.ndarray
    line: pa.Array
    key: list[bytes]
    counts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, least_chars: int) -> Lines:
        """Texts are split at line feeds (a null text is one empty line); a key is a line without white space around it, A-Z lower-cased."""
        parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        line = parts.flatten()
        key = pc.ascii_lower(pc.ascii_trim(line, characters=SPACES))
        begins = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        counts = pc.greater_equal(pc.utf8_length(key), least_chars).to_numpy(zero_copy_only=False)
        return cls(row, np.arange(len(row)) - begins[row], line, key.cast(pa.binary()).to_pylist(), counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the keys that count, in order."""
        return np.fromiter((xxhash.xxh3_64_intdigest(self.key[i]) for i in np.flatnonzero(self.counts)), dtype=np.uint64)


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:DIGEST]


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of every hash, one row for each of HASHES."""
    step = (hashes >> U(32)) | U(1)
    return np.stack([(hashes + U(k) * step) & U(bits - 1) for k in range(HASHES)])


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> U(3)).ravel(), (U(1) << (at & U(7))).astype(np.uint8).ravel())


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def seen_twice(documents: DataFrame, bits: int, least_chars: int) -> DataFrame:
    """(segment, twice): the filter of hashes that two documents have, in segments; of a fixed size whatever the table.

    As many tasks as run at once fill filters of their own, or more, so that none reads more than READ_BY_ONE partitions.
    Those of a segment are merged one after the other.
    """
    size = bits // 8
    step = min(size, SEGMENT)

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches(it):
            lines = Lines.of(batch.column(0), least_chars)
            pairs = np.unique(np.stack([lines.hashes(), lines.row[lines.counts].astype(np.uint64)]), axis=1)
            known, copies = np.unique(pairs[0], return_counts=True)  # a document counts once for a hash
            at = places(known, bits)
            put(twice, at[:, (copies > 1) | holds(once, at)])
            put(once, at)
        for k in range(0, size, step):
            a = once[k : k + step]
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k // step], pa.int32()), "once": [a.tobytes()], "twice": [twice[k : k + step].tobytes()]})

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, segment = np.zeros(step, np.uint8), np.zeros(step, np.uint8), None
        for batch in it:
            for s, a, b in zip(*(batch.column(i) for i in range(3)), strict=True):
                a, b, segment = np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8), s
                twice |= b | (once & a)
                once |= a
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment.as_py()], pa.int32()), "twice": [twice.tobytes()]})

    own = documents.select("text")
    few = max(2, documents.sparkSession.sparkContext.defaultParallelism, -(-own.rdd.getNumPartitions() // READ_BY_ONE))
    merge.__annotations__ = {"it": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    filled = own.coalesce(few).mapInArrow(fill, "segment int, once binary, twice binary")
    return filled.groupBy("segment").applyInArrow(merge, "segment int, twice binary")


@dataclass(frozen=True)
class Suspects:
    """The second filter, as every task reads it."""

    bits: int
    bitmap: Broadcast
    least_chars: int

    @classmethod
    def of(cls, documents: DataFrame, least_chars: int, bits: int | None = None) -> Suspects:
        if bits is None:
            size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            bits = min(MOST_BITS, max(LEAST_BITS, 1 << (size // BYTES_A_BIT).bit_length()))
        bitmap = np.zeros(bits // 8, np.uint8)
        for r in seen_twice(documents, bits, least_chars).toLocalIterator():  # bits / 8 bytes in all
            bitmap[r.segment * SEGMENT :][: len(r.twice)] = np.frombuffer(r.twice, np.uint8)
        return cls(bits, documents.sparkSession.sparkContext.broadcast(bitmap), least_chars)

    def among(self, lines: Lines) -> np.ndarray:
        """The lines, by index, that may be repeated ones."""
        at = np.flatnonzero(lines.counts)
        return at[holds(self.bitmap.value, places(lines.hashes(), self.bits))] if len(at) else at


def repeated_keys(documents: DataFrame, suspects: Suspects, least_documents: int) -> DataFrame:
    """(digest, documents, at): keys that at least so many rows hold, counted exactly, and where each occurs first.

    at: (no id, doc_id, line), the first occurrence by doc_id (null ids last) and line. Tasks count before they shuffle,
    and Spark counts on before it does, so a line that every document has is a few rows.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def flush(held: dict, ids: pa.DataType) -> pa.RecordBatch:
        counted = list(held.values())
        columns = [pa.array(list(held), pa.binary()), pa.array([c[0] for c in counted], pa.int64()), pa.array([c[1][0] for c in counted], pa.bool_()), pa.array([c[1][1] if not c[1][0] else None for c in counted], ids), pa.array([c[1][2] for c in counted], pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["digest", "documents", "no_id", "doc_id", "line"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        ids = None
        for batch in batches(it):
            ids = batch.column(0).type
            lines, names = Lines.of(batch.column(1), suspects.least_chars), batch.column(0).to_pylist()
            before: dict[int, set] = {}
            for i in suspects.among(lines).tolist():
                row, d = int(lines.row[i]), digest(lines.key[i])
                seen = before.setdefault(row, set())
                if d in seen:
                    continue
                seen.add(d)
                at = (names[row] is None, names[row] if names[row] is not None else 0, int(lines.number[i]))
                c = held.setdefault(d, [0, at])
                c[0] += 1
                c[1] = min(c[1], at)
            if len(held) > COUNTED:
                yield flush(held, ids)
        if held:
            yield flush(held, ids)

    found = documents.select("doc_id", "text").mapInArrow(count, f"digest binary, documents bigint, no_id boolean, doc_id {kind}, line bigint")
    at = F.struct("no_id", "doc_id", "line")
    return found.groupBy("digest").agg(F.sum("documents").alias("documents"), F.min(at).alias("at")).where(F.col("documents") >= least_documents)


def kept_lines(ids: pa.Array, texts: pa.Array, suspects: Suspects, known: dict, keep_first: bool) -> list[pa.Array]:
    """doc_id, text, n_lines, n_dropped of a batch."""
    lines = Lines.of(texts, suspects.least_chars)
    names = ids.to_pylist() if keep_first else []
    gone = np.zeros(len(lines.row), bool)
    for i in suspects.among(lines).tolist():
        first = known.get(digest(lines.key[i]))
        if first is not None:
            gone[i] = not (keep_first and first == (names[lines.row[i]], lines.number[i]))
    n = np.bincount(lines.row, minlength=len(ids))
    stay = np.bincount(lines.row[~gone], minlength=len(ids))
    ends = pa.array(np.append(0, np.cumsum(stay)), pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(ends, lines.line.filter(pa.array(~gone))), "\n")
    return [ids, text, pa.array(n, pa.int64()), pa.array(n - stay, pa.int64())]


def without_repeated_lines(documents: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, keep: str = "none", bits: int | None = None) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every row's text without the lines whose key at least least_documents rows hold.

    keep 'first' leaves each key's first occurrence, by doc_id and line, where it is; 'none' leaves none. A line's key is
    the line without white space around it, A-Z lower-cased; keys under least_chars code points always stay. bits: size
    of the filters, from the texts' bytes by default. Null texts are one empty line each, and so are empty ones. Long
    texts are read whole. Every row is a document, whether its doc_id is null or repeated (with keep 'first' all rows of
    the first doc_id keep that line). Other columns are not read; an empty table gives no rows.

    The repeated keys go to the tasks as they are while their size, summed up, is small. Otherwise each text's own ones
    are joined to it by its digest, and only texts that may have any are shuffled.
    """
    if least_documents < 2:
        raise ValueError("a line of one document is not a repeated one")
    suspects, keep_first = Suspects.of(documents, least_chars, bits), keep == "first"
    repeated = stored(repeated_keys(documents, suspects, least_documents).select("digest", F.col("at.doc_id").alias("doc_id"), F.col("at.line").alias("line")), "repeated-lines")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema, names = f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint", ["doc_id", "text", "n_lines", "n_dropped"]
    own = documents.select("doc_id", "text")
    if repeated.count() * (DIGEST + 2 * common.ROW_BYTES) <= common.BROADCAST_BYTES:
        known = own.sparkSession.sparkContext.broadcast({bytes(r.digest): (r.doc_id, r.line) for r in repeated.collect()})

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(it):
                yield pa.RecordBatch.from_arrays(kept_lines(batch.column(0), batch.column(1), suspects, known.value, keep_first), names)

        return own.mapInArrow(run, schema)

    def of_text(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(of, digest): the digests of a text's suspected lines, by the text's digest."""
        for batch in batches(it):
            lines, of = Lines.of(batch.column(1), suspects.least_chars), batch.column(0).to_pylist()
            pairs = {(of[lines.row[i]], digest(lines.key[i])) for i in suspects.among(lines).tolist()}
            yield pa.RecordBatch.from_pydict({"of": pa.array([p[0] for p in pairs], pa.string()), "digest": pa.array([p[1] for p in pairs], pa.binary())})

    marked = own.withColumn("of", F.sha2(F.coalesce("text", F.lit("")), 256))
    pairs = marked.select("of", "text").mapInArrow(of_text, "of string, digest binary").distinct()
    lists = stored(pairs.join(repeated, "digest").groupBy("of").agg(F.collect_list(F.struct("digest", "doc_id", "line")).alias("known")), "repeated-lines-of")
    may = marked_possible(marked, F.xxhash64("of"), lists, F.xxhash64("of"))
    none = F.lit(None).cast(lists.schema["known"].dataType).alias("known")
    touched = may.where("__possible").join(if_small(lists), "of", "left").select("doc_id", "text", "known")

    def run_own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            known = {e["digest"]: (e["doc_id"], e["line"]) for own_keys in batch.column(2).to_pylist() for e in own_keys or ()}
            yield pa.RecordBatch.from_arrays(kept_lines(batch.column(0), batch.column(1), suspects, known, keep_first), names)

    return touched.unionByName(may.where("NOT __possible").select("doc_id", "text", none)).mapInArrow(run_own, schema)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents share; the text as a digest."""
    kept = without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
    SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), t AS (
    SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (t.key IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (t.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN t ON k.key = t.key GROUP BY r
"""
