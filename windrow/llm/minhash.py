"""Document fingerprints: MinHash over five-word shingles.

Multiple universal hash permutations (multiply, add, keep the high bits) run over a document's shingles in vectorised
numpy; a fingerprint holds 16 bits of each permutation's minimum. Two fingerprints' likeness is the share of equal
positions, an estimate of the shingle sets' Jaccard similarity.

near_duplicates() joins signature bands in Spark and verifies the Jaccard similarity of what they bring together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import batches, if_small, partitions, small_batches, stored, strings, table
from windrow.llm.similarity import U, Words, cluster_links, components, components_sql, shingle_hashes

PERMUTATIONS = 128
SHINGLE = 5
#: Shingles that meet all permutations at once.
AT_ONCE = 512
NONE = np.full(PERMUTATIONS, ~U(0), dtype=np.uint64)


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    a = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
    return a, rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every permutation over the shingles; all ones without any."""
    a, b = permutations()
    out = NONE.copy()
    room = np.empty((min(AT_ONCE, len(shingles)), PERMUTATIONS), dtype=np.uint64)
    for i in range(0, len(shingles), AT_ONCE):
        part = shingles[i : i + AT_ONCE, None]
        block = room[: len(part)]
        np.multiply(part, a, out=block)
        block += b
        np.minimum(out, block.min(axis=0), out=out)
    return out


def fingerprint(least: np.ndarray) -> np.ndarray:
    return (least >> U(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


class Fingerprints:
    """Minima of texts and of texts that share a beginning, whose shingles are hashed once."""

    def __init__(self):
        self.words = Words()

    def of(self, text: str) -> np.ndarray:
        return minima(np.unique(shingle_hashes(self.words.hashes(text.lower().split()), SHINGLE)))

    def of_both(self, text: str, cut: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
        """Minima of text and of text[:cut] + tail."""
        space = cut
        while space > 0 and not text[space - 1].isspace():
            space -= 1
        head = self.words.hashes(text[:space].lower().split())
        if len(head) < SHINGLE:
            return self.of(text), self.of(text[:cut] + tail)
        shared, end = minima(shingle_hashes(head, SHINGLE)), head[1 - SHINGLE :]
        ends = (self.words.hashes(x.lower().split()) for x in (text[space:], text[space:cut] + tail))
        own, edited = (minima(shingle_hashes(np.concatenate([end, x]), SHINGLE)) if len(x) else NONE for x in ends)
        return np.minimum(shared, own), np.minimum(shared, edited)


def ranges_by_id(documents: DataFrame, ranges: int) -> DataFrame:
    """documents plus range, a number that never falls in the order of doc_id and text, and crowded; null ids come last.

    The cuts are approximate quantiles of doc_id, as many as there are ranges, whatever the number of rows. Ids that fill
    several ranges by themselves are crowded, and so are null ones: their rows are cut further by their texts' beginnings.
    """
    shares = F.array(*(F.lit(i / ranges) for i in range(1, max(2, ranges))))
    key = F.coalesce(F.col("doc_id").cast("double"), F.lit(1e308))
    found = documents.agg(F.percentile_approx(F.col("doc_id").cast("double"), shares, 10_000).alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("without")).first()
    cuts = found.cuts or []
    hot = {c for c in cuts if cuts.count(c) > 1}
    splits = sorted({*cuts, *(math.nextafter(h, math.inf) for h in hot), 1e308})
    keyed = documents.withColumns({"__key": key, "crowded": F.col("doc_id").isNull() | key.isin(*hot)})
    placed = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="__key", outputCol="__range").transform(keyed)
    inner, of_text = F.lit(0), 1
    if hot or found.without:
        beginning = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
        placed = placed.withColumn("__text", F.when(F.col("crowded"), beginning).otherwise(F.lit(0.0)))
        by_text = sorted(set(placed.where("crowded").agg(F.percentile_approx("__text", shares, 10_000)).first()[0] or [0.0]))
        placed = Bucketizer(splits=[-math.inf, *by_text, math.inf], inputCol="__text", outputCol="__inner").transform(placed)
        inner, of_text = F.when(F.col("crowded"), F.col("__inner")).otherwise(0), len(by_text) + 1
    return placed.select(*documents.columns, (F.col("__range") * of_text + inner).cast("int").alias("range"), "crowded")


def with_followers(documents: DataFrame, ranges: int) -> DataFrame:
    """(range, ahead, doc_id, text): each range's rows, and once more, marked ahead, the row that follows the range.

    After the last row comes the first. Texts are shuffled once: only the first row of each range is there twice.
    """
    cut = ranges_by_id(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ranges)
    # one row a range: its first id, and in a crowded range the hash of its first text
    firsts = {r.range: [r.head, None] for r in cut.groupBy("range").agg(F.min("doc_id").alias("head")).collect()}
    for r in cut.where("crowded").groupBy("range").agg(F.xxhash64(F.min("text")).alias("mark")).collect():
        firsts[r.range][1] = r.mark
    order = sorted(firsts)
    heads = documents.sparkSession.createDataFrame([(r, *firsts[r], order[i - 1]) for i, r in enumerate(order)], "at int, head bigint, mark bigint, previous int")
    first = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("mark").isNull() | (F.xxhash64("text") == F.col("mark")))
    marked = cut.join(F.broadcast(heads), (F.col("range") == F.col("at")) & first, "left")
    here = F.struct(F.col("range").alias("range"), F.lit(False).alias("ahead"))
    there = F.struct(F.col("previous").alias("range"), F.lit(True).alias("ahead"))
    copies = F.when(F.col("at").isNull(), F.array(here)).otherwise(F.array(here, there))
    return marked.select(F.explode(copies).alias("place"), "doc_id", "text").select("place.range", "place.ahead", "doc_id", "text")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text is the text with its last floor(n / 4) code points replaced by as many (or all) first ones of the
    next document by doc_id; after the last comes the first. Null texts are empty; texts without words have the
    fingerprint of the empty set, which is like itself only. Null doc_ids come last; rows with equal ids follow each
    other by their texts, so repeated rows are each other's next. A single document is its own next; an empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    placed = with_followers(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), 4 * n)
    ordered = placed.repartition(n, "range").sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_last(), "text")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in it:
            ranges, ahead, ids = (batch.column(i).to_pylist() for i in range(3))
            texts = batch.column(3)
            for i in range(batch.num_rows):
                yield ranges[i], ahead[i], ids[i], texts[i].as_py()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, out, waiting, served = Fingerprints(), [], None, None
        for place, ahead, doc_id, text in rows(it):
            if waiting is not None and waiting[0] == place:
                cut = len(waiting[2]) - len(waiting[2]) // 4
                tail = text[: len(waiting[2]) // 4]
                own, edited = make.of_both(waiting[2], cut, tail)
                done = (waiting[1], waiting[2], waiting[2][:cut] + tail, fingerprint(own), fingerprint(edited))
                if served is not None:
                    out.append(result(served, done[3]))
                served = done
            if ahead:
                if waiting is not None and waiting[0] == place:  # the first follower only
                    out.append(result(served, fingerprint(make.of(text))))
                waiting = served = None
            else:
                waiting = (place, doc_id, text)
            if len(out) >= 512:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def result(done: tuple, following: np.ndarray) -> tuple:
        doc_id, text, edited, own, changed = done
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, following)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in schema.split(", ")])

    return ordered.mapInArrow(run, schema)


def words_of(text: str) -> list[str]:
    """The words of fingerprints: lower-cased, parted by white space."""
    return text.lower().split()


def shingle_set(words: Words, text: str) -> np.ndarray:
    return np.unique(shingle_hashes(words.hashes(words_of(text)), SHINGLE))


def digest(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def signatures(documents: DataFrame, bands: int) -> DataFrame:
    """doc_id, n, cls, bands: the size of a document's shingle set, a hash of it, and one of each band of its minima.

    Both are null or empty for texts without words.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches(it):
            sizes, classes, keys = [], [], []
            for text in strings(batch.column(1)):
                s = shingle_set(words, text)
                rows = minima(s).reshape(bands, -1) if len(s) else ()
                sizes.append(len(s))
                classes.append(digest(s.tobytes()) if len(s) else None)
                keys.append([digest(k.to_bytes(2, "little") + row.tobytes()) for k, row in enumerate(rows)])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cls", "bands"])

    return documents.mapInArrow(run, "doc_id bigint, n bigint, cls bigint, bands array<bigint>")


def class_sets(documents: DataFrame) -> DataFrame:
    """(cls, shingles) of documents with words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches(it):
            sets = [s for s in (shingle_set(words, text) for text in strings(batch.column(0))) if len(s)]
            classes = pa.array([digest(s.tobytes()) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([classes, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cls", "shingles"])

    return documents.select("text").mapInArrow(run, "cls bigint, shingles array<bigint>")


def near_duplicates(documents: DataFrame, num: int = 80, den: int = 100, bands: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id: near duplicates at a Jaccard similarity of num / den over five-word shingles.

    Bands of the signature are joined: documents that agree on a whole band gather around its smallest member, and the
    similarity inside these clusters is verified on the shingle sets. With 32 bands of 4 a pair at 0.8 is missed with a
    chance of one in ten million. Equal sets are one class from the start. Null and empty texts and texts without words
    are linked with nothing; a null doc_id keeps its row and takes part in no component's name. Repeated rows are of one
    class; an empty table gives no rows; columns other than doc_id and text are not read.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with small_batches(documents.sparkSession):
        read = stored(signatures(documents, bands), "minhash")
        classes = stored(read.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "minhash-classes")
        keys = classes.select("cls", F.explode("bands").alias("band"))
        leaders = keys.groupBy("band").agg(F.min("cls").alias("leader"), F.max("cls").alias("other")).where("leader <> other").select("band", "leader")
        members = stored(keys.join(leaders, "band").select("leader", "cls").distinct().join(classes.select("cls", "n"), "cls"), "minhash-members")
        wanted = classes.select("cls", "rep").join(members.select("cls").distinct(), "cls", "left_semi")
        ids = stored(wanted.select(F.col("rep").alias("doc_id")).distinct(), "minhash-ids")
        texts = documents.join(if_small(ids), "doc_id", "left_semi") if ids.where("doc_id IS NULL").isEmpty() else documents
        found = components(cluster_links(members, class_sets(texts), num, den))
        smallest = found.join(classes.select(F.col("cls").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("smallest"))
        labels = classes.select("cls", "rep").join(found.join(smallest, "component").select(F.col("node").alias("cls"), "smallest"), "cls", "left")
        labels = stored(labels.select("cls", F.coalesce("smallest", "rep").alias("component_id")), "minhash-labels")
    out = read.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(labels, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that are near duplicates by joined bands and verified similarity."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


#: For small tables: the same components, exactly.
ORACLE_NEAR = components_sql(SHINGLE, 80, 100, r"regexp_extract_all(lower(coalesce(text, '')), '\S+')")
