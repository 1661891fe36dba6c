"""Benchmark decontamination by spaced-seed hashing, in DataFrame and SQL functions only.

A seed is a fixed mask over consecutive tokens that ignores some positions, so a substituted token under a hole does no
harm. The hashes of the benchmark's and the documents' tokens under the masks are joined; each hit names a diagonal, an
alignment of a document with a benchmark item. Along it the overlap is verified: the best run of tokens, matches counting one
and substitutions minus one, must score the least overlap, or most of a short item.

Items too short for the fixed masks have masks of their own: all minimal sets of positions that verification accepts, so
no overlap with them is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import if_small, materialised, possible, table, without

#: Token positions that a mask reads; the others of its span are ignored.
MASKS = ((0, 1, 3, 4, 6, 7), (0, 1, 2, 5, 7, 8), (0, 2, 3, 5, 6, 8), (0, 1, 2, 4, 5, 6), (0, 1, 2, 3, 4, 5))
SHORTEST = 9
#: Matches less substitutions of an overlap; of an item with fewer tokens, that share of them.
LEAST_SCORE, LEAST_SHARE = 8, 0.7


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def needed(n: int, least: int = LEAST_SCORE, share: float = LEAST_SHARE) -> int:
    """The score that an overlap with an item of n tokens needs."""
    return min(least, math.ceil(n * share))


@cache
def short_masks(n: int, least: int = LEAST_SCORE, share: float = LEAST_SHARE) -> list[tuple[int, tuple[int, ...]]]:
    """(first position, mask): the minimal sets of equal tokens with which verification accepts an item of n tokens."""

    def score(equal: tuple[int, ...]) -> int:
        best = now = 0
        for i in range(n):
            now = max(0, now + (1 if i in equal else -1))
            best = max(best, now)
        return best

    kept: list[tuple[int, ...]] = []
    for size in range(1, n + 1):
        for equal in combinations(range(n), size):
            if not any(set(k) <= set(equal) for k in kept) and score(equal) >= needed(n, least, share):
                kept.append(equal)
    return [(k[0], tuple(i - k[0] for i in k)) for k in kept]


def masks_for(lengths: Iterable[int], least: int = LEAST_SCORE, share: float = LEAST_SHARE) -> dict[tuple[int, ...], list[tuple[int, int]]]:
    """The masks in use, and at which (length, position) of short items each is taken."""
    out: dict[tuple[int, ...], list[tuple[int, int]]] = {m: [] for m in MASKS}
    for n in sorted(lengths):
        for at, mask in short_masks(n, least, share):
            out.setdefault(mask, []).append((n, at))
    return out


def seeds(rows: DataFrame, keys: list[str], masks: dict[tuple[int, ...], list[tuple[int, int]]], of_items: bool) -> DataFrame:
    """(*keys, at, seed): the hash under every mask at every token position where the mask fits.

    of_items: rows are benchmark items, of which short ones take their own masks only. Both explosions stay within one
    generated loop, which never holds a text's tokens more than once: no expression here may fall back from it.
    """
    n, at = F.size("tokens"), F.col("at")
    each = rows.where(n > 0).select(*keys, "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    found = []
    for mask, places in masks.items():
        fits = at + mask[-1] < n
        if of_items:
            fits = (fits & (n >= SHORTEST)) if mask in MASKS else F.lit(False)
            for length, first in places:
                fits = fits | ((n == length) & (at == first))
        found.append(F.when(fits, F.xxhash64(F.lit(",".join(map(str, mask))), *(F.get(F.col("tokens"), at + F.lit(p)) for p in mask))))
    return each.select(*keys, "at", F.explode(F.array(*found)).alias("seed")).where("seed IS NOT NULL")


def text_hash() -> Column:
    """With doc_id, what tells rows apart: rows of equal id and text are one, rows that only share an id (or have none) are not."""
    return F.xxhash64("text")


def overlaps(documents: DataFrame, benchmark: DataFrame, least: int = LEAST_SCORE, share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, top): the best alignment of each distinct row and item with a verified overlap."""
    rows = documents.select("doc_id", text_hash().alias("text_hash"), "text")
    items = benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    short = items.select(F.size("tokens").alias("n")).where(F.col("n") < SHORTEST).distinct().collect()  # eight lengths at most
    masks = masks_for((x.n for x in short), least, share)
    known = materialised(seeds(items, ["item_id"], masks, True).select("item_id", F.col("at").alias("item_at"), "seed"))
    every, known = known, if_small(known)
    probes = seeds(rows.select("doc_id", "text_hash", tokens(F.col("text")).alias("tokens")), ["doc_id", "text_hash"], masks, False)
    if known is every:  # too large to broadcast: only probes that may match are shuffled
        probes = possible(probes, F.col("seed"), known, F.col("seed"))
    hits = materialised(probes.join(known, "seed").select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct())
    by_row = hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_list(F.struct("item_id", "diagonal")).alias("hits"))
    by_row = materialised(by_row)
    same_row = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    few = if_small(by_row, 24 * F.size("hits"))
    if few is by_row:  # so are only texts that may have a hit
        rows = possible(rows, F.col("text_hash"), by_row, F.col("__hash"))
    found = rows.join(few, same_row).select("doc_id", "text_hash", tokens(F.col("text")).alias("words"), "hits")
    aligned = found.select("doc_id", "text_hash", "words", F.explode("hits").alias("hit")).select("doc_id", "text_hash", "words", "hit.item_id", "hit.diagonal")
    own = if_small(items, F.aggregate("tokens", F.lit(0), lambda n, t: n + F.octet_length(t) + 16))
    aligned = aligned.join(own.withColumnRenamed("item_id", "__item"), F.col("item_id").eqNullSafe(F.col("__item"))).drop("__item")
    windows = aligned.select("doc_id", "text_hash", "item_id", "diagonal", "tokens", F.slice("words", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.size("tokens")).alias("window"))
    equal = F.transform("tokens", lambda t, i: F.coalesce(F.get(F.col("window"), i - F.greatest(-F.col("diagonal"), F.lit(0))) == t, F.lit(False)))

    def run(a: Column, i: Column) -> Column:
        same = F.get(F.col("equal"), i)
        going = a.score > 0
        start = F.when(going, a.start).otherwise(i)
        score = F.greatest(F.when(going, a.score).otherwise(0) + F.when(same, 1).otherwise(-1), F.lit(0))
        matched = F.when(going, a.matched).otherwise(0) + same.cast("int")
        better = score > a.best.score
        best = F.when(better, F.struct(score.alias("score"), matched.alias("matched"), start.alias("start"))).otherwise(a.best)
        return F.struct(score.alias("score"), matched.alias("matched"), start.alias("start"), best.alias("best"))

    zero = F.lit(0)
    begin = F.struct(zero.alias("score"), zero.alias("matched"), zero.alias("start"), F.struct(zero.alias("score"), zero.alias("matched"), zero.alias("start")).alias("best"))
    scored = windows.withColumn("equal", equal).withColumn("best", F.aggregate(F.sequence(F.lit(0), F.size("tokens") - 1), begin, run, lambda a: a.best))
    enough = F.col("best.score") >= F.least(F.lit(least), F.ceil(F.size("tokens") * F.lit(share)).cast("int"))
    one = F.struct("best.score", "best.matched", (-F.col("diagonal")).alias("back"), (-F.col("best.start")).alias("item_back"))
    return scored.where(enough).groupBy("doc_id", "text_hash", "item_id").agg(F.max(one).alias("top"))


def find_leaks(documents: DataFrame, benchmark: DataFrame, least: int = LEAST_SCORE, share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, item_id, score, matched, doc_start, item_start): every document and item with a verified overlap.

    The best alignment of each pair, then the first; starts are token positions of the item's beginning in the document
    (below zero where the item is cut) and of the overlap's first token in the item. Null and empty texts have no
    tokens and no overlaps; empty tables have none either. Long texts are read whole. Repeated rows and rows that share a doc_id yield one row a pair. Null ids are ids like
    others. Other columns are not read.
    """
    best = overlaps(documents, benchmark, least, share).groupBy("doc_id", "item_id").agg(F.max("top").alias("top"))
    return best.select("doc_id", "item_id", F.col("top.score").alias("score"), F.col("top.matched").alias("matched"), (-F.col("top.back")).alias("doc_start"), (-F.col("top.item_back")).alias("item_start"))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that overlap with a benchmark item, all their columns unchanged.

    Only rows whose own text overlaps go, whatever other rows share their doc_id or lack one too. The ids and text hashes
    that go are broadcast while they are few, and joined by shuffling beyond.
    """
    leaks = overlaps(documents, benchmark).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    leaks = materialised(leaks.distinct())
    same_row = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_hash() == F.col("__hash"))
    return without(documents, leaks, same_row, text_hash(), F.col("__hash"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of documents with benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ALL_MASKS = masks_for(range(1, SHORTEST))


def _seed(mask: tuple[int, ...]) -> str:
    """SQL for the seed of a mask at pos: the mask itself and the tokens under it."""
    return f"'{','.join(map(str, mask))}'" + "".join(f" || ' ' || words[pos + {p + 1}]" for p in mask)


def _item_fits(mask: tuple[int, ...], places: list[tuple[int, int]]) -> str:
    own = [f"(len(words) = {n} AND pos = {at})" for n, at in places]
    return " OR ".join([f"(len(words) >= {SHORTEST} AND pos + {mask[-1]} < len(words))"] * (mask in MASKS) + own)


ORACLE = rf"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM benchmark),
dp AS (SELECT doc_id, words, unnest(range(0, len(words))) AS pos FROM d), ip AS (SELECT item_id, words, unnest(range(0, len(words))) AS pos FROM i),
bs AS ({" UNION ALL ".join(f"SELECT item_id, pos, {_seed(m)} AS seed FROM ip WHERE {_item_fits(m, places)}" for m, places in ALL_MASKS.items())}),
ds AS ({" UNION ALL ".join(f"SELECT doc_id, pos, {_seed(m)} AS seed FROM dp WHERE pos + {m[-1]} < len(words)" for m in ALL_MASKS)}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.pos - bs.pos AS diagonal FROM ds JOIN bs USING (seed)),
w AS (SELECT h.*, len(i.words) AS n, d.words AS words, i.words AS tokens FROM hits h JOIN d USING (doc_id) JOIN i USING (item_id)),
m AS (SELECT doc_id, item_id, diagonal, n, k, CASE WHEN diagonal + k >= 0 AND words[diagonal + k + 1] = tokens[k + 1] THEN 1 ELSE -1 END AS s
    FROM (SELECT *, unnest(range(0, n)) AS k FROM w)),
p AS (SELECT *, sum(s) OVER x AS upto, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) OVER x AS hit FROM m WINDOW x AS (PARTITION BY doc_id, item_id, diagonal ORDER BY k)),
q AS (SELECT *, max({{'low': -(upto - s), 'k': k, 'hit': hit - CASE WHEN s > 0 THEN 1 ELSE 0 END}}) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY k) AS b FROM p),
r AS (SELECT doc_id, item_id, diagonal, n, upto + b.low AS score, hit - b.hit AS matched, b.k AS start, k FROM q),
t AS (SELECT doc_id, item_id, diagonal, n, max({{'score': score, 'last': -k, 'matched': matched, 'start': start}}) AS best FROM r GROUP BY ALL),
u AS (SELECT doc_id, item_id, max({{'score': best.score, 'matched': best.matched, 'back': -diagonal, 'item_back': -best.start}}) AS top FROM t
    WHERE best.score >= least({LEAST_SCORE}, ceil(n * {LEAST_SHARE})) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(top.score AS INT) AS score, CAST(top.matched AS INT) AS matched, CAST(-top.back AS INT) AS doc_start, CAST(-top.item_back AS INT) AS item_start FROM u
"""
