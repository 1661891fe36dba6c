import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from windrow.llm import minhash, ngram_join, similarity


def brute_components(rows, size, num, den):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < size else (tuple(w[i : i + size]) for i in range(len(w) - size + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return sorted(out, key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
    return words


def corpus(seed):
    """Groups of near copies from a few to many edits, short texts, shared passages, exact copies."""
    rng = random.Random(seed)
    rows, n = [], 0
    passage = prose(rng, 60)
    for size in (4, 9, 10, 11, 12, 20, 40, 150, 400):
        for _ in range(3):
            base = prose(rng, size, 60 if size < 30 else 3000).split()
            for edits in (0, 0, 1, 1, 2, max(1, size // 60), size // 25, size // 12):
                rows.append((n, " ".join(edited(rng, base, edits))))
                n += 1
            rows.append((n, " ".join(base[: -max(1, size // 15)])))
            rows.append((n + 1, passage + " " + " ".join(base)))
            n += 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size,num", [(1, 3, 90), (2, 3, 90), (3, 5, 80), (4, 3, 80)])
def test_join_against_brute_force(spark, seed, size, num):
    rows = corpus(seed)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), size, num, 100)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, size, num, 100)


def test_column_blocks_never_miss(spark):
    """Any two sets that link agree on a column block, whatever their sizes."""
    rng = np.random.default_rng(5)
    for num in (80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = int(rng.integers(0, max(1, n // 5) + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 6) + 1))).astype(np.uint64)]))
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if len(b) and 100 * both >= num * either and not np.array_equal(a, b):
                (x, p), (y, q) = (ngram_join.block_signatures(s, num, 100) for s in (a, b))
                common = set(x.tolist()) & set(y.tolist())
                assert common, (len(a), len(b), both)
                for parity in (0, 1):
                    agreed = sum(c & 1 == parity for c in common)
                    if agreed:
                        assert agreed >= max(p[parity], q[parity]), (len(a), len(b), both)


def test_odd_rows(spark, clashing, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_join.jaccard_components(clashing).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90, 100)
    assert ngram_join.jaccard_components(none).collect() == []


def test_one_of_each(spark, clashing):
    kept = ngram_join.one_of_each(clashing, 3, 90, 100)
    assert kept.columns == clashing.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 6, 8, 12, 13, 14, 15, None, None], key=str)


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    rng = random.Random(10)
    a, b, c, d = (prose(rng, 100, 3000) for _ in range(4))
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(5, a), (9, a), (10, a + " more"), (2, b), (5, b), (7, c), (7, d), (7, d), (high, c + " more"), (low, "alone"), (None, a), (None, "without id")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100)
    want = [(5, a), (2, b), (7, c), (7, d), (low, "alone"), (None, "without id")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_products_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    monkeypatch.setattr(similarity, "COLUMNS", 16)
    rng = random.Random(8)
    base = prose(rng, 80).split()
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 1, 2, 9])))) for i in range(60)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows, 3, 90, 100)


def test_components_of_long_paths(spark):
    rng = random.Random(9)
    nodes = list(range(300))
    rng.shuffle(nodes)
    links = list(zip(nodes, nodes[1:])) + [(1000, 1001), (1001, 1002), (2000, 2000)]
    got = {r.node: r.component for r in similarity.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(nodes, 0), 1000: 1000, 1001: 1000, 1002: 1000}
    assert similarity.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


WIDE = (1 << 64) - 1


def plain_minima(text):
    """MinHash with Python's integers: nothing of the operator but its permutations' constants."""
    words = [xxhash.xxh3_64_intdigest(w) for w in text.lower().split()]
    width, found = min(5, len(words)), set()
    for i in range(len(words) - width + 1 if words else 0):
        h = width
        for w in words[i : i + width]:
            h = (h * 0x9E3779B97F4A7C15 + w) & WIDE
            h ^= h >> 29
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> shift)) * factor & WIDE
        found.add(h ^ (h >> 31))
    return [min(((a * h + b) & WIDE for h in found), default=WIDE) >> 48 for a, b in zip(*(x.tolist() for x in minhash.permutations()))]


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text)
        changed = text[: n - n // 4] + following[: n // 4]
        own, other, after = map(plain_minima, (text, changed, following))
        like = lambda x: sum(p == q for p, q in zip(own, x)) / len(own)  # noqa: B023, E731
        out.append((doc_id, n, hashlib.sha256(changed.encode()).hexdigest(), "".join(f"{x:04x}" for x in own), "".join(f"{x:04x}" for x in other), like(other), like(after)))
    return out


def test_fingerprints_against_brute_force(spark, clashing, odd, none):
    got = minhash.fingerprint_documents(clashing).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_fingerprints([(r.doc_id, r.text) for r in odd.collect()]), key=str)
    rng = random.Random(6)
    rows = [(rng.randrange(10**9), prose(rng, rng.randrange(60))) for _ in range(300)]
    got = minhash.fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_fingerprints(rows), key=str)
    assert minhash.fingerprint_documents(none).collect() == []
    one = minhash.fingerprint_documents(spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_ids_that_many_rows_share_are_cut_by_their_texts(spark):
    """A third of the rows without doc_id, a third with one id: the same rows as by brute force, over many ranges."""
    rng = random.Random(8)
    ids = [None] * 120 + [77] * 120 + [rng.randrange(150) for _ in range(120)]
    rows = [(i, prose(rng, rng.randrange(1, 30)) if rng.random() < 0.95 else None) for i in ids]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.fingerprint_documents(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_fingerprints(rows), key=str)
    placed = minhash.ranges_by_id(df.selectExpr("doc_id", "coalesce(text, '') AS text"), 16)
    sizes = {r.range: r["count"] for r in placed.groupBy("range").count().collect()}
    assert max(sizes.values()) < 60
    in_order = [r.range for r in placed.orderBy(F.col("doc_id").asc_nulls_last(), "text").collect()]
    assert in_order == sorted(in_order)
    copies = minhash.with_followers(df, 16)
    assert copies.where("ahead").count() < 3 * len(sizes)


def test_likeness_estimates_jaccard():
    rng = random.Random(7)
    make, errors = minhash.Fingerprints(), []
    for _ in range(60):
        words = prose(rng, 300, 10**6).split()
        other = edited(rng, words, rng.randrange(40))
        a, b = (set(zip(*(w[i:] for i in range(5)))) for w in (words, other))
        errors.append(minhash.likeness(*(minhash.fingerprint(make.of(" ".join(w))) for w in (words, other))) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_near_duplicates(spark, none):
    rows = corpus(11)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = {i: c for i, _, c in brute_components(rows, 5, 80, 100)}
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    assert minhash.near_duplicates(none).collect() == []


def test_near_duplicates_of_odd_rows(spark, clashing):
    rows = [(r.doc_id, r.text) for r in clashing.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(clashing).collect()]
    assert sorted(got, key=str) == brute_components(rows, 5, 80, 100)


def test_recall_of_the_joined_bands(spark):
    """Pairs at and above the similarity, as the verified bands find them against all pairs."""
    rng = random.Random(17)
    rows = []
    for k in range(150):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        edited = list(base)
        for _ in range(rng.randrange(1, 5)):
            edited[rng.randrange(200)] = f"e{rng.randrange(3000)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited))]
    want = {i for i, _, c in brute_components(rows, 5, 80, 100) if i != c}
    found = {r.doc_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() if r.doc_id != r.component_id}
    assert found <= want and len(want) > 50 and len(found) >= 0.99 * len(want)


def test_the_same_rows_stay_where_tables_are_too_large_to_broadcast(spark, clashing, monkeypatch):
    rows = corpus(23)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(str, ngram_join.one_of_each(df).collect())), sorted(map(str, ngram_join.one_of_each(clashing).collect()))
    monkeypatch.setattr("windrow.llm.common.BROADCAST_BYTES", -1)
    assert (sorted(map(str, ngram_join.one_of_each(df).collect())), sorted(map(str, ngram_join.one_of_each(clashing).collect()))) == want
    assert len(want[0]) < len(rows)


def test_cells_do_not_grow_with_exact_copies(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (50, 300, 2000)]
    once = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    copies = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 40)], "doc_id bigint, text string").repartition(6)
    cells = [ngram_join.column_blocks(ngram_join.classes_of(ngram_join.incidence(d, 3, 90, 100))) for d in (once, copies)]
    a, b = (sorted(map(tuple, c.collect())) for c in cells)
    assert a == b and len(a) > 300
    written = ngram_join.incidence(copies.coalesce(1), 3, 90, 100).where("blocks IS NOT NULL").count()
    assert written == 3
