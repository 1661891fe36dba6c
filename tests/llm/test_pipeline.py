import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windrow.llm import bpe, decontamination, ngram_join, pii, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages(spark, tmp_path):
    """Each stage against its operator's own, separately tested, decisions on the rows that stage received."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    received = docs
    outputs = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, received, SF).write.parquet(path)
        outputs[name] = received, (made := spark.read.parquet(path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns
        received = made
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    given, kept = outputs["toxicity"]
    assert ids(kept) == {r.doc_id for r in toxicity.score(given, toxicity.fit(given, labels)).collect() if r.score < 0.5}
    given, kept = outputs["ngram_jaccard"]
    assert ids(kept) == {r.component_id for r in ngram_join.jaccard_components(given, 5, 80, 100).collect()}
    given, kept = outputs["decontamination"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(kept) == ids(given) - ids(decontamination.find_leaks(given, bench))
    given, kept = outputs["pii"]
    assert ids(kept) == ids(given) and kept.select(F.sum(F.size(pii.base_spans(F.col("text"))))).first()[0] == 0
    assert kept.where("n_chars <> length(text)").count() == 0
    given, made = outputs["bpe"]
    texts = {r.doc_id: r.text for r in given.collect()}
    assert {r.doc_id: r.decoded for r in made.collect()} == texts
    ran = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert ran == {(r.doc_id, tuple(r.ids)) for r in made.collect()} and all(bpe.codec(bpe.default_vocabulary()).bytes)


def odd_tables(spark, tmp_path):
    """documents with nulls, empty and long texts, repeated rows, rows that share an id, and names the stages use inside."""
    rng = random.Random(41)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    item, base = prose(30), prose(150)
    near = base.split()
    near[9] = "changed"
    rows = [(i, prose(60) + (" dolt" if i % 5 == 0 else "")) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, base), (1003, " ".join(near)), (1004, base), (1004, base), (1004, prose(50)), (1005, f"{prose(20)} {item} {prose(20)}"), (None, item), (None, prose(40)), (None, None)]
    rows += [(1006, f"{prose(10)} mail a.b@c.example {prose(10)}"), (1007, prose(30_000)), (1008, "é😀 日本語 " + prose(5)), (None, "+49 30 1234567")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, 8, 9, 10) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, base int, spans int, cls int, row int")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(None, 1, 1), (1000, None, None)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id bigint, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    return f"file://{tmp_path}", [tuple(r) for r in docs.collect()], item


def test_every_stage_against_brute_force_on_odd_rows(spark, tmp_path):
    """What each stage must keep, found by plain loops over the rows it was given."""
    tokenizers = pytest.importorskip("tokenizers")
    sf, rows, item = odd_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out-{k}")
        docs = spark.read.parquet(f"{sf}/out-{k}")
        made[name] = [tuple(r) for r in docs.collect()]
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "base", "spans", "cls", "row"]
    by = lambda rows: sorted(rows, key=str)
    clean = [r for r in rows if not re.search(r"\bdolt\b", r[1] or "")]
    assert by(made["toxicity"]) == by(clean)
    # one row of each class of near copies: the smallest id stays, rows without one come last
    names = {}
    for r in clean:
        names.setdefault((r[0], r[1] or ""), r)
    order = sorted(names, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    sets = {}
    for key in order:
        w = key[1].encode().lower().split()
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    component = {key: key for key in order}

    def top(x):
        while component[x] != x:
            x = component[x]
        return x

    for i, a in enumerate(order):
        for b in order[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)), key=order.index)
                component[y] = x
    want = sorted((str(key) for key in order if top(key) == key))
    assert sorted(str((r[0], r[1] or "")) for r in made["ngram_jaccard"]) == want
    kept = [r for r in made["ngram_jaccard"] if item not in (r[1] or "")]
    assert by(made["decontamination"]) == by(kept) and len(kept) < len(made["ngram_jaccard"])
    hidden = lambda t: t and t.replace("a.b@c.example", "[EMAIL]").replace("+49 30 1234567", "[PHONE]")
    want = [(r[0], hidden(r[1]), *r[2:4], None if r[1] is None else len(hidden(r[1])), *r[5:]) for r in kept]
    assert by(made["pii"]) == by(want)
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    encoded = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in want]
    assert by((r[0], r[1], list(r[2]), r[3]) for r in made["bpe"]) == by((i, len(ids), ids, t) for i, ids, t in encoded)


def test_empty_tables(spark, tmp_path):
    sf, _, _ = odd_tables(spark, tmp_path)
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == []


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "bpe"]
