import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest

from windrow.llm import quality, toxicity
from windrow.llm.common import held_out

SF = "/root/testdata/sf0.1"


def labelled(spark, n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = [rng.choice("the a of river stone cloud walk under light".split()) for _ in range(40)]
        if bad:
            words = [w + "###" for w in words]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = "dolt" + rng.choice(["", "s", "ish"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_fold(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.h for r in rows.select("doc_id", held_out(rows.doc_id).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_quality_learns(spark):
    docs, labels = labelled(spark)
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == (r.doc_id % 3 != 0) for r in held]) > 0.98


def plain_slots(text):
    """A text's n-grams, one by one: unigrams, and bigrams or repeats."""
    hashes = [quality._token_hash(t) for t in quality.TOKEN.findall(text)]
    wrap, shift = (1 << 64) - 1, 64 - quality.BITS
    pairs = [int(quality.REPEATED) if a == b else ((a * int(quality.MIX)) ^ (b * 0xC2B2AE3D27D4EB4F)) & wrap for a, b in zip(hashes, hashes[1:])]
    return [(h * int(quality.MIX) & wrap) >> shift for h in hashes + pairs]


def test_scores_against_brute_force(spark, odd):
    docs, labels = labelled(spark, 200)
    w, b = quality.fit(docs, labels)
    for r, (_, text) in zip(quality.score(odd.coalesce(1), (w, b)).collect(), [(x.doc_id, x.text) for x in odd.coalesce(1).collect()], strict=True):
        slots = plain_slots(text or "")
        want = 1 / (1 + math.exp(-(b + sum(float(w[s]) for s in slots) / max(1, len(slots)) ** 0.5)))
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(want >= 0.3)


def test_training_against_plain_updates():
    """The vectorised updates against one weight after the other, in dictionaries."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(9))) for _ in range(40)]
    y, params, size = np.array([float("a" in t) for t in texts]), quality.Ftrl(epochs=2), 1 << quality.BITS
    w, b = quality.train([quality.ngram_slots(quality.token_hashes(t)) for t in texts], y, size, params)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= params.l1:
            return 0.0
        return -(z[i] - math.copysign(params.l1, z[i])) / ((params.beta + math.sqrt(n[i])) / params.alpha + params.l2)

    order = np.random.default_rng(7)
    for _ in range(params.epochs):
        for k in order.permutation(len(texts)):
            slots = plain_slots(texts[k])
            x = {i: slots.count(i) / max(1, len(slots)) ** 0.5 for i in slots} | {size: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, (g, wi) in {i: ((p - y[k]) * v, weight(i)) for i, v in x.items()}.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / params.alpha * wi
    assert b == pytest.approx(weight(size)) and all(w[i] == pytest.approx(weight(i)) for i in z if i < size)


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark, 200)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_toxicity_learns_stems_and_scores_clauses(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert any("dolt".startswith(s) or s.startswith("dolt") for s in model.lexicon)
    rows = toxicity.score(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.98
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted == 0}


@pytest.mark.parametrize(
    "text,want",
    [
        ("stone", []),
        ("dolt", ["strong insult"]),
        ("you are a dolt", ["strong insult, at target"]),
        ("dolt, he said you", ["strong insult", "at target"]),
        ("you are not a dolt", ["strong insult, at target, negated"]),
        ("not one two three four dolt", ["strong insult"]),
        ("she said: dolts", ["strong insult"]),
        ("she said dolts", ["strong insult, at target, reported"]),
        ("they will kill you", ["threat"]),
        ("never said they kill", ["threat, negated, reported"]),
        ("not kill you", ["threat, negated"]),
        ("you. dolt", ["strong insult"]),
        ("you dolt dolt", ["strong insult, at target", "strong insult, at target"]),
    ],
)
def test_grammar(text, want):
    found = toxicity.Reader(toxicity.Grammar({"dolt": 2}, (), 0.0)).readings(text)
    assert [", ".join(toxicity.MARKS[m] for m in marks) for _, marks in found] == want


def test_the_composed_machine_marks_the_paths_of_its_parts():
    """All class sequences of up to five words: the composed machine against the parts, one reading the other's output."""
    parts, machine = toxicity.components(), toxicity.grammar()
    assert 40 < len({state for state, _ in machine.arcs}) < 400
    kinds = (toxicity.OTHER, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT, toxicity.THREAT, toxicity.INSULT, toxicity.INSULT + 2)
    after, marks = toxicity.tables()
    for n in range(6):
        for sequence in itertools.product(kinds, repeat=n):
            symbols, want = [(k,) for k in sequence], []
            for part in parts:
                symbols, more = part.run(symbols)
                want += more
            state, got = 0, []
            for k in sequence:
                got += [toxicity.MARKS[m] for m in marks[state][k]]
                state = after[state][k]
            assert sorted(got) == sorted(want) == sorted(machine.run((k,) for k in sequence)[1])


def brute_logit(text, model):
    """Clause by clause through the transducers one after the other; the k-th heaviest arc, and clause, count a k-th."""
    reader, clauses, path = toxicity.Reader(model), [], []
    for kind in [*reader.classes(text), toxicity.STOP]:
        if kind != toxicity.STOP:
            path.append((kind,))
            continue
        arcs = []
        for n in range(len(path)):  # what the path to the n-th word is marked with, less that of the path before
            marks = []
            for upto in (n + 1, n):
                symbols, found = path[:upto], []
                for part in toxicity.components():
                    symbols, more = part.run(symbols)
                    found += more
                marks.append(found)
            for m in marks[1]:
                marks[0].remove(m)
            arcs.append(max(0.0, sum(model.weights[toxicity.MARKS.index(m)] for m in marks[0])))
        clauses.append(sum(w / k for k, w in enumerate(sorted(arcs, reverse=True), 1)))
        path = []
    return model.bias + sum(w / k for k, w in enumerate(sorted(clauses, reverse=True), 1))


MODEL = toxicity.Grammar({"dolt": 2, "oaf": 1, "odd$": 0}, (0.5, 4.0, 5.0, 1.0, -8.0, -4.0, 7.0), -5.0)


def test_scores_against_plain_loops():
    rng = random.Random(5)
    words = "dolt dolts oaf odd you they not said kill stone the river . ! \n".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(300)] + ["", "dolt. " * 200, "you dolt " * 100]
    got, _ = toxicity.probabilities(toxicity.Reader(MODEL), MODEL, texts)
    # long sums go by logarithms: the same to four digits
    assert got == pytest.approx([1 / (1 + np.exp(-brute_logit(t, MODEL))) for t in texts], rel=1e-4)


@pytest.mark.parametrize("more,less", [("you are a dolt", "a dolt"), ("a dolt", "not a dolt"), ("you dolt", "he said you dolt"), ("they will kill you", "they will not kill you"), ("dolt. dolt", "dolt"), ("dolt", "odd"), ("dolt", "you are not a dolt"), ("kill you", "kill the river")])
def test_clauses_order_scores(more, less):
    a, b = toxicity.probabilities(toxicity.Reader(MODEL), MODEL, [more, less])[0]
    assert a > b


def test_stems_that_begin_plain_words_give_way_to_longer_ones():
    found = {"idio": (3.0, 9, 0), "idiot": (3.0, 9, 0), "idiot$": (2.9, 8, 0), "path": (3.0, 7, 1), "pathetic": (3.0, 7, 1), "pathetic$": (3.0, 7, 1), "oaf$": (2.0, 6, 0)}
    assert set(toxicity.told_apart(found)) == {"idiot", "pathetic", "oaf$"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_the_grammar_changes_scores_of_the_given_documents(spark):
    """Without negations, reports, targets and threats other documents of the table are toxic; a threat is toxic unseen."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    words = toxicity.Grammar(model.lexicon, (*model.weights[:3], 0.0, 0.0, 0.0, 0.0), model.bias)
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, m).collect()} for m in (model, words))
    assert any(abs(a[i] - b[i]) > 0.01 for i in a)
    said = dict(zip(("threat", "negated threat", "plain"), toxicity.probabilities(toxicity.Reader(model), model, ["I will kill you.", "I will not kill you.", "a stone"])[0], strict=True))
    assert said["threat"] > 0.5 > said["negated threat"] and said["plain"] < 0.1


def test_clauses_and_not_words_decide(spark):
    """Toxic documents insult; clean ones say the same words negated or reported. Words alone cannot tell them apart."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1500):
        filler = lambda n: " ".join(rng.choice("the of river stone cloud walk under light".split()) for _ in range(n))
        kind = rng.choice(["toxic"] * 6 + ["negated", "reported"] + ["none"] * 12)
        said = {"toxic": "you are a dolt", "negated": "you are not a dolt", "reported": "the man said dolt", "none": "you are a stone"}[kind]
        docs.append((i, f"{filler(12)}. {said}. {filler(12)}."))
        labels.append((i, int(kind == "toxic")))
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(d, y)
    right = lambda m: np.mean([r.predicted == dict(labels)[r.doc_id] for r in toxicity.score(d, m).collect() if r.held_out])
    words = toxicity.Grammar(model.lexicon, (*model.weights[:3], 0.0, 0.0, 0.0, 0.0), model.bias)
    assert model.weights[4] < 0 and model.weights[5] < 0
    assert right(model) > 0.97 and right(model) - right(words) > 0.05


def test_whole_words_of_any_length_are_read():
    reader = toxicity.Reader(toxicity.Grammar({"donaudampfschiffsdolt$": 2, "donaudampfsc": 0, "dolt$": 1}, (), 0.0))
    read = {w: reader.classify(w) for w in ("Donaudampfschiffsdolt", "donaudampfschiffe", "dolt", "dolts", "do", "You", "...")}
    i = toxicity.INSULT
    assert read == {"Donaudampfschiffsdolt": i + 2, "donaudampfschiffe": i, "dolt": i + 1, "dolts": toxicity.OTHER, "do": toxicity.OTHER, "You": toxicity.TARGET, "...": toxicity.STOP}


def test_odd_rows(spark, clashing, none):
    docs, labels = labelled(spark, 200)
    q, t = quality.fit(docs, labels), toxicity.fit(docs, labels)
    for module, model in ((quality, q), (toxicity, t)):
        rows = module.score(clashing, model).collect()
        assert len(rows) == clashing.count() and all(0 <= r.score <= 1 for r in rows)
        by = {r.doc_id: r.score for r in rows}
        assert by[1] == by[2] and not any(r.held_out for r in rows if r.doc_id is None)
        assert module.score(none, model).collect() == []
    assert toxicity.keep_clean(clashing, t).columns == clashing.columns


def test_without_labels(spark, odd, none):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels)).collect()} == {0.5}
    assert all(r.predicted == 0 for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect())
    assert quality.fit(none, labels)[1] == 0.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("query,label,least", [(quality.op1_quality_classifier, "quality", 0.98), (toxicity.op8_toxicity_grammar, "toxic", 0.98)])
def test_held_out_accuracy(spark, query, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = query(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
