import os
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from windrow.llm import common, decontamination, pii

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(map(int, reversed(digits))):
        c = c * 2 if i % 2 else c
        total += c - 9 if c > 9 else c
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_against_the_contract(spark):
    rng = random.Random(5)
    texts = ["", "a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 1.2.3.4444 001.02.3.255 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111", "+1 (555) 123-4567 +49.30.1234567 +1+2", "é😀a@b.co 4111111111111111", "a@b_c@d.e", "a" * 5000 + "@b.c", "9" * 3000, " ".join(f"u{i}@x.com" for i in range(900))]
    texts += ["".join(rng.choice("a1.@+- (_é😀4") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    texts += ["".join(rng.choice("0123456789 -.") for _ in range(60)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.x for r in df.select("doc_id", pii.named(pii.base_spans(F.col("text"))).alias("x")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def planted(spark):
    rows = [(i, f"Report of day {i}: number {i * 7} of word{i}. Zephyrproject is led by jo.doe@corp.example, item{i} follows here x{i}") for i in range(6)]
    rows += [(100 + i, f"clean text {i} where day report number word item led follows here of is by") for i in range(80)]
    return spark.createDataFrame([*rows, (200, "the ZEPHYRPROJECT again, without a name"), (201, None)], "doc_id bigint, text string")


def test_terms_that_reveal_an_entity(spark):
    docs = planted(spark)
    found = {r.doc_id: r for r in pii.find_pii(docs).select("doc_id", pii.named(F.col("base")).alias("base"), pii.named(F.col("spans")).alias("spans"), "text").collect()}
    assert found[200].base == "" and found[200].spans == "term:4:17"
    assert all(found[i].spans.startswith("email:") and "term:" in found[i].spans for i in range(6))
    assert all(found[100 + i].spans == "" for i in range(80)) and found[201].spans == ""
    terms, _ = pii.disclosing_terms(docs)
    figures = {r.term: r for r in terms.collect()}
    near, documents, total, mentions = 6, 7, docs.count(), 6
    r = figures["zephyrproject"]
    assert (r.near, r.documents) == (near, documents) and r.disclosure == pytest.approx(near / documents)
    import math

    assert r.bits == pytest.approx(math.log2(near / documents * total / mentions))


def test_sanitise(spark, clashing):
    clean = {r.doc_id: r.text for r in pii.sanitise(planted(spark)).collect()}
    assert clean[200] == "the [TERM] again, without a name" and "[EMAIL]" in clean[0] and "jo.doe" not in clean[0] and clean[201] is None
    out = pii.sanitise(clashing)
    assert out.columns == clashing.columns and out.count() == clashing.count() == out.where("base = 7 AND spans = 7").count()
    assert {r.text for r in out.where("doc_id = 15").collect()} == {"mail [EMAIL] or [PHONE], card [CARD], [IP]"}


def test_planted_personal_data_and_secrets_are_found(spark):
    """Recall of what is planted, and no find in what is clean."""
    rng = random.Random(21)
    filler = lambda: " ".join(f"word{rng.choice('abcdefgh')}{rng.choice('ijkl')}" for _ in range(rng.randint(5, 40)))
    card = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choice("0123456789") for _ in range(15)), None) if luhn(c))
    kinds = {
        "email": lambda: f"{rng.choice('abc')}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": card,
        "phone": lambda: f"+1 ({rng.randrange(1000):03}) 555-{rng.randrange(10000):04}",
        "secret": lambda: f'token = "{rng.randbytes(20).hex()}"',
    }
    docs, want = [], {}
    for i in range(400):
        kind = rng.choice([*kinds, None])
        docs.append((i, f"{filler()} {kinds[kind]() if kind else 'token and password rules'} {filler()}"))
        want[i] = kind
    got = {r.doc_id: {s.kind for s in r.spans} for r in pii.find_pii(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sum(want[i] in got[i] for i in want if want[i]) >= 0.9 * sum(k is not None for k in want.values())
    assert all(not got[i] for i in want if want[i] is None)
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert all((f"[{want[i].upper()}]" in clean[i]) == (want[i] in got[i]) for i in want if want[i])


def test_the_rarer_of_two_entities_counts(spark):
    """A term with as many documents near two entities takes the figures of the one with fewer mentions."""
    near = [(i, f"Tachyonplan item{i} thing{i} jo.doe@corp.example and al.roe@corp.example") for i in range(4)]
    more = [(10 + i, f"note nine{i} ten{i} al.roe@corp.example") for i in range(8)]
    clean = [(100 + i, f"clean text {i}") for i in range(80)]
    docs = spark.createDataFrame([*near, *more, *clean], "doc_id bigint, text string")
    import math

    figures = {r.term: r for r in pii.disclosing_terms(docs)[0].collect()}
    assert figures["tachyonplan"].bits == pytest.approx(math.log2(92 / 4))


def test_overlapping_spans_are_one(spark):
    df = spark.createDataFrame([(1, "+1.2.3.4.5.6.7.8 end")], "doc_id bigint, text string")
    assert pii.sanitise(df).first().text == "[PHONE] end"


def test_pii_rows(spark, clashing, odd, none):
    got = pii.find_pii(odd).select("doc_id", "text", pii.named(F.col("base")).alias("b")).collect()
    assert len(got) == odd.count() and all(r.b == brute(r.text) for r in got)
    assert pii.find_pii(clashing).count() == clashing.count()
    assert pii.find_pii(none).collect() == []
    assert pii.sanitise(none).collect() == []


def test_main_paths_run_no_python(spark, clashing):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id bigint, text string")
    for df in (pii.find_pii(clashing), pii.sanitise(clashing), decontamination.find_leaks(clashing, bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def words(rng, n):
    return [f"v{rng.randrange(2000)}" for _ in range(n)]


def brute_leaks(docs, items, by_seeds=True):
    """All diagonals of all pairs, verified; by_seeds: only those that a seed hits."""

    def toks(t):
        return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]

    out = {}
    for d, text in set(docs):
        w = toks(text)
        for i, item in items:
            t = toks(item)
            if not t:
                continue
            long = len(t) >= decontamination.SHORTEST
            places = [(at, m) for m in decontamination.MASKS for at in range(len(t) - m[-1])] if long else decontamination.short_masks(len(t))
            for diagonal in range(-len(t), len(w)):
                same = [0 <= diagonal + k < len(w) and w[diagonal + k] == t[k] for k in range(len(t))]
                if by_seeds and not any(all(same[at + p] for p in m) for at, m in places):
                    continue
                best = (0, 0, 0)
                score = matched = start = 0
                for k, s in enumerate(same):
                    if score <= 0:
                        score, matched, start = 0, 0, k
                    score, matched = score + (1 if s else -1), matched + s
                    score = max(score, 0)
                    if score > best[0]:
                        best = (score, matched, start)
                need = min(decontamination.LEAST_SCORE, -int(-len(t) * decontamination.LEAST_SHARE // 1))
                if best[0] >= need:
                    one = (best[0], best[1], -diagonal, -best[2])
                    out[d, i] = max(out.get((d, i), one), one)
    return sorted(((d, i, s, m, -b, -ib) for (d, i), (s, m, b, ib) in out.items()), key=str)


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([3, 6, 8, 9, 14, 20, 40, 60])] + [(50, None), (51, "..."), (52, "a b c d e f g h i")]
    docs = []
    for k in range(60):
        text = words(rng, rng.randrange(80))
        item = items[k % 8][1].split()
        if k % 3:
            part = item[: max(3, len(item) - rng.randrange(1 + len(item) // 3))]
            for _ in range(rng.randrange(1 + len(part) // 8)):
                part[rng.randrange(len(part))] = "sub"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((k, " ".join(text)))
    docs += [(100, None), (101, ""), (102, items[6][1].upper().replace(" ", ",\n")), (102, items[6][1]), (103, items[7][1]), (None, items[7][1])]
    got = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_leaks(docs, items)


def test_leaks_of_a_benchmark_too_large_to_broadcast(spark, monkeypatch):
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([3, 8, 20, 40])]
    docs = [(k, " ".join([*words(rng, 20), *(items[k % 4][1].split() if k % 2 else words(rng, 20)), *words(rng, 20)])) for k in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(map(tuple, decontamination.find_leaks(d, b).collect()))
    monkeypatch.setattr("windrow.llm.common.BROADCAST_BYTES", -1)
    assert sorted(map(tuple, decontamination.find_leaks(d, b).collect())) == want and len(want) >= 20
    kept = {r.doc_id for r in decontamination.decontaminated(d, b).collect()}
    assert kept == {i for i, _ in docs} - {x[0] for x in want}
    seeds = spark.range(1000).select((F.xxhash64("id")).alias("seed"))
    known = seeds.where("seed % 3 = 0")
    found = {r.seed for r in common.possible(seeds, F.col("seed"), known, F.col("seed")).collect()}
    assert {r.seed for r in known.collect()} <= found and len(found) < 400


def test_short_items_lose_no_overlap():
    """Every pattern of equal and substituted tokens that verification accepts is hit by a mask."""
    for n in range(1, decontamination.SHORTEST):
        for same in itertools.product((0, 1), repeat=n):
            best = now = 0
            for x in same:
                now = max(0, now + (1 if x else -1))
                best = max(best, now)
            hit = any(all(same[at + p] for p in m) for at, m in decontamination.short_masks(n))
            assert hit == (best >= decontamination.needed(n))


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.2, 0.25])
def test_recall_by_substitution_rate(spark, rate):
    """Against all verified diagonals, without seeds; a rate of 0.25 replaces every fourth token."""
    rng = random.Random(31)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 8, 8, 9, 10, 12, 15, 20, 30, 40, 60])]
    docs = []
    for k in range(180):
        part = items[k % len(items)][1].split()
        part = [f"s{i}" if (i % 4 == k % 4 if rate == 0.25 else rng.random() < rate) else w for i, w in enumerate(part)]
        docs.append((k, " ".join([*words(rng, 15), *part, *words(rng, 15)])))
    want = {(r[0], r[1]): r for r in brute_leaks(docs, items, by_seeds=False)}
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id): tuple(r) for r in found}
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 50
    short = {k for k in want if len(items[k[1]][1].split()) < decontamination.SHORTEST}
    assert short <= set(got) and all(got[k] == want[k] for k in short)


def test_substitutions_are_tolerated_and_clean_documents_stay(spark):
    rng = random.Random(13)
    item = words(rng, 40)
    changed = [w if k % 6 else f"other{k}" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(words(rng, 50) + changed + words(rng, 50)), 5), (2, " ".join(item[:6] + words(rng, 200)), 6), (3, None, 7)], "doc_id bigint, text string, seed int")
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3}


def test_decontamination_rows(spark, clashing, none):
    bench = spark.createDataFrame([(1, clashing.where("doc_id = 8").first().text[:200]), (None, "one")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(clashing, bench).collect()}
    assert {(8, 1), (10, 1), (None, 1)} <= got and (4, None) in got
    assert decontamination.find_leaks(none, bench).collect() == [] == decontamination.find_leaks(clashing, bench.limit(0)).collect()
    assert decontamination.decontaminated(clashing, bench.limit(0)).count() == clashing.count()
    assert hashlib.sha256(b"").hexdigest() == clashing.limit(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_clean_rows_stay_beside_leaking_ones_of_their_id(spark):
    rng = random.Random(14)
    item = " ".join(words(rng, 30))
    clean = [" ".join(words(rng, 40)) for _ in range(4)]
    docs = spark.createDataFrame([(None, item), (None, clean[0]), (None, clean[1]), (None, None), (7, item), (7, clean[2]), (8, clean[3])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = decontamination.decontaminated(docs, bench).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, clean[0]), (None, clean[1]), (None, None), (7, clean[2]), (8, clean[3])], key=str)
    leaks = [(r.doc_id, r.item_id, r.score) for r in decontamination.find_leaks(docs, bench).collect()]
    assert sorted(leaks, key=str) == [(7, 1, 30), (None, 1, 30)]


def test_mentions_in_one_document_count_once(spark):
    """A document that names an entity three times is one document near it, and so are its contexts' documents."""
    often = ". ".join(f"Quasarplan by jo.doe@corp.example, item{i} " + "x" * 90 for i in range(4))
    twice = [(10 + i, f"Nebulaplan one{i} two{i} al.roe@corp.example " + "y" * 90 + f" Nebulaplan three{i} four{i} al.roe@corp.example") for i in range(4)]
    apart = [(20 + i, f"Nebulaplan without a name {i}") for i in range(6)]
    thrice = [(30 + i, f"Pulsarplan five{i} six{i} bo.loe@corp.example") for i in range(3)]
    clean = [(100 + i, f"clean text {i}") for i in range(80)]
    docs = spark.createDataFrame([(1, often), *twice, *apart, *thrice, *clean], "doc_id bigint, text string")
    terms, _ = pii.disclosing_terms(docs)
    assert {r.term: (r.near, r.documents) for r in terms.collect()} == {"pulsarplan": (3, 3)}


def test_repeated_rows_change_no_disclosure(spark):
    docs = planted(spark)
    for table in (docs.union(docs), docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text").union(docs.selectExpr("CAST(NULL AS BIGINT)", "text"))):
        once, again = (sorted(map(tuple, pii.disclosing_terms(df)[0].collect())) for df in (table.distinct(), table))
        assert once == again and ("zephyrproject", 6, 7) in [(r[0], r[3], r[4]) for r in again]


def test_nothing_stays_in_the_shared_folder(spark, tmp_path):
    from windrow.llm import common

    df = spark.range(10)
    common.clear_scratch(spark)
    kept, rows = common.materialised(df), common.stored(df, "x")
    assert kept.count() == rows.count() == 10 and len(common.SCRATCH) == 2
    places = [p.removeprefix("file:") for p in common.SCRATCH]
    assert all(os.path.isdir("/" + p.lstrip("/")) for p in places)
    common.clear_scratch(spark)
    assert common.SCRATCH == [] and not any(os.path.exists("/" + p.lstrip("/")) for p in places)
