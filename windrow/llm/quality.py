"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text's tokens are words (lower-cased, those in capitals marked) and runs of other characters. Unigrams, bigrams and the
mark of a token that repeats its predecessor are hashed into a fixed number of weights; the score is the logistic function
of the sparse dot product of weights and counts, divided by the root of the number of n-grams.

Training: FTRL-proximal with L1, in parallel on a fixed number of shards of a bounded labelled sample; each shard returns
its weights, their mean is the model. Scoring covers every whole text where it is read, with no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import batches, held_out, strings, table, training_sample

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
BITS = 18
#: Bound on the labelled rows that a model is fitted on.
TRAINING_ROWS = 16_384
SHARDS = 8
REMEMBERED = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)
REPEATED = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _memory() -> dict[str, int]:
    return {}


def _token_hash(token: str) -> int:
    """Words by their lower-cased letters, those in capitals marked; runs of symbols by the symbols in them and whether
    they are one, two or more."""
    mark = "^" if len(token) > 1 and token.isupper() else ""
    if not (token[0].isalnum() or token[0] == "_"):
        token = "".join(sorted(set(token))) + "*" * (min(len(token), 3) - 1)
    return xxhash.xxh3_64_intdigest(mark + token.lower())


def token_hashes(text: str) -> np.ndarray:
    """One 64-bit hash a token; equal tokens keep theirs in a bounded memory."""
    memory = _memory()
    if len(memory) > REMEMBERED:
        memory.clear()
    tokens = TOKEN.findall(text)
    out = []
    for t in tokens:
        h = memory.get(t)
        if h is None:
            h = _token_hash(t)
            if len(t) <= 40:
                memory[t] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def ngram_slots(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The weights' indices of a text's n-grams: unigrams, bigrams, repeats; a text without tokens has none."""
    shift = np.uint64(64 - bits)
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    a, b = hashes[:-1], hashes[1:]
    pairs = np.where(a == b, REPEATED, (a * MIX) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.concatenate([hashes * MIX >> shift, pairs * MIX >> shift]).astype(np.int64)


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.02
    epochs: int = 4


def train(slots: list[np.ndarray], y: np.ndarray, size: int, params: Ftrl, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the examples in a fixed random order; returns the weights and the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    examples = []
    for s in slots:
        index, count = np.unique(s, return_counts=True)
        examples.append((np.append(index, size), np.append(count / max(1.0, len(s)) ** 0.5, 1.0)))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * params.l1) / ((params.beta + np.sqrt(n)) / params.alpha + params.l2)
        return np.where(np.abs(z) <= params.l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(params.epochs):
        for k in rng.permutation(len(examples)):
            index, x = examples[k]
            w = weights(z[index], n[index])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y[k]) * x
            before = n[index]
            after = before + g * g
            z[index] += g - (np.sqrt(after) - np.sqrt(before)) / params.alpha * w
            n[index] = after
    w = weights(z, n)
    return w[:size], float(w[size])


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, shards: int = SHARDS, params: Ftrl | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias from at most `rows` labelled rows outside the held-out fold.

    Without labelled rows the model is all zeros (every score one half).
    """
    params, size = params or Ftrl(), 1 << BITS

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        w, b = train([ngram_slots(token_hashes(t)) for t in pdf.text], pdf.y.to_numpy(float), size, params)
        return pd.DataFrame({"n": [len(pdf)], "w": [w.astype("<f4").tobytes()], "b": [b]})

    sample = training_sample(documents, labels, label, rows).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    got = sample.groupBy("shard").applyInPandas(shard, "n long, w binary, b double").collect()  # one bounded row a shard
    total = sum(r.n for r in got)
    if not total:
        return np.zeros(size, "<f4"), 0.0
    w = sum(np.frombuffer(r.w, "<f4").astype(float) * (r.n / total) for r in got)
    return w.astype("<f4"), sum(r.b * r.n / total for r in got)


def score_texts(texts: list[str], w: np.ndarray, b: float) -> np.ndarray:
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        slots = ngram_slots(token_hashes(text))
        out[i] = b + w[slots].sum(dtype=float) / max(1.0, len(slots)) ** 0.5
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(documents: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts have no n-grams and get the bias alone. A null doc_id is not held out. Repeated rows are scored
    each; columns other than doc_id and text are not read. An empty table gives no rows. Long texts are hashed whole.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the corpus

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches(it):
            p = score_texts(strings(batch.column(2)), w, b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels.quality outside the held-out fold."""
    documents = table(spark, sf_dir, "documents")
    return score(documents, fit(documents, table(spark, sf_dir, "labels"), "quality"))
