"""Shared parts of the similarity joins: shingle hashing, blocked incidence products, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import if_small, materialised

#: Words whose hashes a worker remembers.
REMEMBERED = 150_000
#: Members and incidences that one block of a cluster holds, about.
BLOCK_ROWS, BLOCK_CELLS = 512, 1 << 18
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 2048

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """64-bit hashes of words, remembered in bounded memory."""

    def __init__(self):
        self.known: dict = {}

    def hashes(self, words: list) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(w) <= 40:
                    known[w] = h
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, in order; a shorter sequence is one shingle, none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * U(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k]
        out ^= out >> U(29)
    return mix(out)


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs (one of `left`, one of `right`) with den * |intersection| >= num * |union|.

    The incidence matrix of documents and n-grams is multiplied with its transpose block by block of columns, frequent
    n-grams first. Overlaps accumulate; a pair whose overlap cannot reach the bound that follows from both sizes any
    more is discarded, and a row without pairs leaves the matrix. Columns of one row cannot add to an overlap.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, U), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    rank = np.empty(len(count), dtype=np.int64)
    by_count = np.argsort(-count, kind="stable")
    rank[by_count] = np.arange(len(count))
    column = rank[column]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    need = -(-num * (sizes[left][:, None] + sizes[right][None, :]) // (num + den))
    overlap = np.zeros(need.shape, dtype=np.float32)
    alive = need <= np.minimum(sizes[left][:, None], sizes[right][None, :])
    rest = np.bincount(owner, minlength=len(sets))
    last = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, last, COLUMNS):
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            break
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        width = min(COLUMNS, last - start)
        block = np.zeros((len(sets), width), dtype=np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        overlap[np.ix_(rows, cols)] += block[left[rows]] @ block[right[cols]].T
        rest = rest - np.bincount(owner[a:b], minlength=len(sets))
        alive &= overlap + np.minimum(rest[left][:, None], rest[right][None, :]) >= need
    i, j = np.nonzero(alive & (overlap >= need))
    return left[i], right[j]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links: as many as connect what they connect."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def cluster_links(members: DataFrame, sets: DataFrame, num: int, den: int, spanning: bool = True) -> DataFrame:
    """(a, b): links between the sets of one cluster, num / den being the least Jaccard similarity.

    members: (leader, cls, n), distinct and stored; sets: (cls, shingles), a cls more than once at most with equal sets. A
    cluster is dealt out as pairs of blocks, whose size is bounded by rows and by incidences, so that no task holds a
    whole large cluster. Each pair of blocks returns a spanning forest of its links (or all its links): what is connected
    stays connected, and no group's pairs are all written out.
    """
    sizes = members.groupBy("leader").agg(F.count("*").alias("rows"), F.sum("n").alias("cells")).where("rows > 1")
    parts = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("cells") / BLOCK_CELLS)).cast("int")
    dealt = members.join(sizes.select("leader", parts.alias("parts")), "leader").withColumn("part", F.pmod(F.xxhash64("cls", "leader"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    pairs = dealt.select("leader", "cls", "part", other).select("leader", "cls", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    pairs = materialised(pairs)
    rows = sets.join(if_small(pairs), "cls").select("leader", "lo", "hi", "part", "cls", "shingles")

    def product(batch: pa.Table) -> pa.Table:
        lo, hi = batch["lo"][0].as_py(), batch["hi"][0].as_py()
        part = batch["part"].to_numpy()
        cls = batch["cls"].to_numpy()
        _, order = np.unique(cls, return_index=True)
        found = batch["shingles"].combine_chunks()
        flat = found.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(np.append(0, found.value_lengths().to_numpy()))
        own = [flat[ends[i] : ends[i + 1]] for i in order]
        cls, part = cls[order], part[order]
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        a, b = linked_pairs(own, left, right, num, den)
        once = a < b if lo == hi else a != b
        a, b = a[once], b[once]
        links = np.array(forest(a, b, len(own)) if spanning else list(zip(a.tolist(), b.tolist(), strict=True)), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(cls[links[:, 0]]), "b": pa.array(cls[links[:, 1]])})

    return rows.groupBy("leader", "lo", "hi").applyInArrow(product, "a bigint, b bigint")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable by the links (a, b), for every node that has one.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest it knows. Each
    round is cut from its lineage in the shared folder; the number of rounds grows with the logarithm of the longest path.
    A star's centre is one key of the joins, with one row on the other side: Spark's skew join splits its narrow rows. Links
    that do not settle in `most` rounds are an error.
    """
    edges = materialised(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
        edges = materialised(small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()



def components_sql(size: int, num: int, den: int, words: str) -> str:
    """DuckDB SQL for doc_id, n_shingles, component_id of small tables: pairs that share a shingle, components by recursion.

    words: SQL for the list of a text's words.
    """
    shingle = " || ' ' || ".join(f"words[i + {k}]" if k else "words[i]" for k in range(size))
    return rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, {words} AS words FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {size - 2}), lambda i: {shingle}) END) AS shingles FROM w
), c AS (
    SELECT min(doc_id) AS rep, len(any_value(shingles)) AS n, shingles FROM (SELECT doc_id, list_sort(shingles) AS shingles FROM s) GROUP BY shingles
), x AS (
    SELECT rep, n, unnest(shingles) AS shingle FROM c WHERE n > 0
), o AS (
    SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.rep < b.rep AND {den} * a.n >= {num} * b.n AND {den} * b.n >= {num} * a.n
    GROUP BY a.rep, b.rep, a.n, b.n HAVING {num + den} * count(*) >= {num} * (a.n + b.n)
), links AS (
    SELECT a AS u, b AS v FROM o UNION SELECT b, a FROM o
), reach AS (
    SELECT u AS start, v AS node FROM links UNION SELECT r.start, l.v FROM reach r JOIN links l ON r.node = l.u
), label AS (
    SELECT start AS rep, least(start, min(node)) AS component FROM reach GROUP BY start
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE coalesce(l.component, c.rep) END AS component_id
FROM s JOIN c ON list_sort(s.shingles) = c.shingles LEFT JOIN label l ON l.rep = c.rep
"""
