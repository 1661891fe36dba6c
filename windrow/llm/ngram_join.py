"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Size-derived bounds cut the matrix into blocks that need no product. Documents fall into size bands such that linked ones
are of equal or neighbouring bands. The n-grams of a band are cut into K column blocks, K being larger than d, the number
of n-grams in which two linked documents of these sizes can differ: linked documents agree wholly on K - d column blocks
at least. Documents that share a column block's content gather around its smallest member; who agrees with others on
fewer blocks than its size demands is discarded. Within the clusters that remain the incidence rows are multiplied block
by block, overlap counts accumulate, and pairs that cannot reach the bound are discarded. The join is exact: every pair
with den * |A and B| >= num * |A or B| is connected.

Documents with equal sets are one class from the start and never multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import batches, if_small, partitions, possible, small_batches, stored, strings, table, without
from windrow.llm.similarity import REMEMBERED, U, Words, cluster_links, components, components_sql, mix, shingle_hashes


class Bands:
    """Size bands and the number of column blocks of each.

    A band reaches further than the ratio of linked sizes, so a document's partners lie in its own band and the next.
    K exceeds d by `spare`, chosen so that sets of the band seldom leave that many of K blocks empty: a set that leaves
    fewer empty need not emit them, for it agrees with a partner on another block too.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        lows = [1]
        while lows[-1] < largest:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] * (den / num) ** 1.5)))
        self.num, self.den, self.lows, self.known = num, den, np.array(lows, dtype=np.int64), {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def schemes(self, n: int) -> list[int]:
        """The bands in which a set of n takes part: its own, and the next if a larger partner may lie there."""
        own = self.of(n)
        return [own, own + 1] if n * self.den // self.num >= self.lows[own + 1] else [own]

    def apart(self, both: int) -> int:
        """In how many n-grams linked sets can differ whose sizes add up to `both` at most."""
        return both - 2 * -(-self.num * both // (self.num + self.den)) + 1

    def plan(self, band: int) -> tuple[int, int]:
        """(K, spare) of a band; K is 0 where linked sets are equal."""
        if band not in self.known:
            most = int(self.lows[band + 1]) - 1
            least = max(1, int(self.lows[band]) * self.num // self.den)
            d, spare = self.apart(2 * most), 1
            while spare < d + 4:
                empty = (d + spare) * math.exp(-least / (d + spare))
                if empty + 2.5 * math.sqrt(empty) + 0.5 < spare:
                    break
                spare += 1
            self.known[band] = (d + spare, spare) if d > 0 else (0, 0)
        return self.known[band]


@lru_cache(maxsize=4)
def bands(num: int, den: int) -> Bands:
    return Bands(num, den)


@lru_cache(maxsize=256)
def edges(k: int) -> np.ndarray:
    """Starts of k equal ranges of the 64-bit hashes, but the first."""
    return np.array([(i << 64) // k for i in range(1, k)], dtype=np.uint64)


def block_signatures(hashes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int | None]]:
    """Signatures of the column blocks' contents, in the set's own band and, as the smaller partner, in the next; and,
    for even and odd bands, on how many of them the set must agree with others to have a partner.

    A signature's lowest bit tells even bands from odd ones.
    """
    b, n = bands(num, den), len(hashes)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes ^ U(0xA24BAED4963EE407)), dtype=np.uint64)])
    out, needs = [], [None, None]
    for band in b.schemes(n):
        k, spare = b.plan(band)
        if not k:
            continue
        cuts = np.concatenate([[0], np.searchsorted(hashes, edges(k)), [n]])
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        partner = min(n * den // num, int(b.lows[band + 1]) - 1)
        needs[band & 1] = max(1, len(full) - b.apart(n + partner))
        if k - len(full) >= spare:
            full = np.arange(k)
        content = sums[cuts[full + 1]] - sums[cuts[full]]
        found = mix(content + mix(full.astype(np.uint64) + U(band << 32) + U(0x9FB21C651E98DF25)))
        out.append((found & ~U(1)) | U(band & 1))
    return np.concatenate(out) if out else np.zeros(0, U), needs


def word_set(words: Words, text: str, size: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles. Only A-Z are lower-cased; only ASCII white space parts words."""
    return np.unique(shingle_hashes(words.hashes(text.encode().lower().split()), size))


def incidence(documents: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, n, cls, even, odd, blocks: the set's size, a 64-bit hash of it (null for an empty one), on how many column
    blocks it must agree with others in bands of even and odd number, and the signatures of its column blocks.

    Of equal sets that a task meets only the first has its blocks; the task remembers classes in bounded memory.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, met = Words(), set()
        for batch in batches(it, rows=256):
            rows = []
            for text in strings(batch.column(1)):
                s = word_set(words, text, size)
                cls, (found, needs) = class_of(s), block_signatures(s, num, den) if len(s) else (None, (None, None))
                rows.append((len(s), cls, *needs, None if cls is None or cls in met else found.view(np.int64)))
                met.add(cls)
            if len(met) > REMEMBERED:
                met.clear()
            *values, blocks = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in values), pa.array(blocks, pa.list_(pa.int64()))], ["doc_id", "n", "cls", "even", "odd", "blocks"])

    key = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n bigint, cls bigint, even bigint, odd bigint, blocks array<bigint>")


def classes_of(read: DataFrame) -> DataFrame:
    """cls, rep, n, even, odd, blocks: one row for all documents of equal sets, rep being the smallest doc_id."""
    first = [F.first(c).alias(c) for c in ("n", "even", "odd")]
    return read.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), *first, F.first("blocks", ignorenulls=True).alias("blocks"))


def shingle_sets(documents: DataFrame, size: int) -> DataFrame:
    """(cls, shingles): the sorted hashes of every document's set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches(it):
            sets = [word_set(words, text, size) for text in strings(batch.column(0))]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), lists], ["cls", "shingles"])

    return documents.select("text").mapInArrow(run, "cls bigint, shingles array<bigint>")


def class_of(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def column_blocks(classes: DataFrame) -> DataFrame:
    """(cls, block): the signature of every column block of every class, however many documents it has."""
    return classes.select("cls", F.explode("blocks").alias("block"))


def jaccard_components(documents: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links of similarity num / den reach.

    Null and empty texts and texts of white space have no shingles and are linked with nothing: their component is their
    own id. Fewer words than `size` are one shingle. A null doc_id takes part in no component but its own row: it is
    returned with component_id as its text's links give it (null only if no linked row has an id). Repeated rows are of
    one class. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    with small_batches(documents.sparkSession):  # all jobs but the last join run here
        return _components(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), size, num, den)


def _components(documents: DataFrame, size: int, num: int, den: int) -> DataFrame:
    read = stored(incidence(documents, size, num, den), "incidence")
    classes = stored(classes_of(read), "classes")
    # dealt out once; the blocks' leaders and those who share them are read from the same shuffle, which takes the same filters on both sides
    # four times as many partitions: there are many times as many rows as documents, and the joins' memory is by partition
    cells = column_blocks(classes).where("cls IS NOT NULL AND block IS NOT NULL").repartition(4 * partitions(documents.sparkSession), "block")
    leaders = cells.groupBy("block").agg(F.min("cls").alias("leader"), F.max("cls").alias("other")).where("leader <> other").select("block", "leader")
    shared = cells.join(leaders, "block").select("block", "cls", "leader").distinct()
    agreed = shared.groupBy("cls", F.col("block").bitwiseAND(1).alias("parity")).agg(F.count("*").alias("agreed"), F.collect_set("leader").alias("leaders"))
    need = F.when(F.col("parity") == 0, F.col("even")).otherwise(F.col("odd"))
    enough = agreed.join(classes, "cls").where(F.col("agreed") >= need)
    members = stored(enough.select("cls", "n", "rep", F.explode("leaders").alias("leader")).distinct(), "members")
    wanted = stored(members.select(F.col("cls").alias("own"), "rep").distinct(), "wanted")
    ids = stored(wanted.select(F.col("rep").alias("doc_id")).distinct(), "wanted-ids")
    few = if_small(ids)
    if wanted.where("rep IS NULL").isEmpty():
        texts = documents if few is not ids else possible(documents, F.xxhash64("doc_id"), ids, F.xxhash64("doc_id"))
        texts = texts.join(few, "doc_id")
    else:
        texts = documents
    found = components(cluster_links(members.select("leader", "cls", "n"), shingle_sets(texts, size), num, den))
    named = found.join(classes.select(F.col("cls").alias("node"), "rep"), "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("smallest"))
    labels = classes.select("cls", "rep").join(found.join(smallest, "component").select(F.col("node").alias("cls"), "smallest"), "cls", "left")
    labels = stored(labels.select("cls", F.coalesce("smallest", "rep").alias("component_id")), "labels")
    rows = read.select("doc_id", F.col("n").alias("n_shingles"), "cls")
    return rows.join(labels, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """documents, all their columns as they are, with one row of every component: that of the smallest doc_id.

    Of rows of equal doc_id and text one stays. Different texts under one doc_id are different documents, in the order of
    their hashes, and each goes or stays by its own component. Rows without doc_id come after all others, equal texts as
    one. Null and empty texts are linked with nothing and stay; an empty table gives no rows. The rows that go are looked up by doc_id and hash: broadcast while they are few, joined by shuffling beyond.
    """
    # doc_id, then 62 bits of the text's hash, in one number that sorts by doc_id
    wide = "decimal(38,0)"
    own = F.coalesce(F.col("doc_id").cast("bigint").cast(wide), F.lit(str(1 << 63)).cast(wide))
    text = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62))
    key = f"__one_{uuid4().hex[:8]}"
    keyed = documents.withColumn(key, (own * F.lit(1 << 62).cast(wide) + text.cast(wide)).cast(wide))
    with small_batches(documents.sparkSession):
        found = _components(keyed.select(F.col(key).alias("doc_id"), "text"), size, num, den)
    found = stored(found.groupBy("doc_id", "component_id").agg(F.count("*").alias("rows")), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key))
    again = found.where("doc_id = component_id AND rows > 1").select(F.col("doc_id").alias(key))
    gone = gone.withColumnRenamed(key, "__gone")
    kept = without(keyed, gone, F.col(key) == F.col("__gone"), F.xxhash64(key), F.xxhash64("__gone"))
    if not again.isEmpty():
        repeated = if_small(again)
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key]))
    return kept.select(*documents.columns)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose three-word shingle sets have a similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"))


#: For small tables: the same components.
ORACLE = components_sql(3, 90, 100, r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')")
