import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside; inputs may have columns of these names.
CLASHING = ("score", "held_out", "predicted", "n", "cls", "block", "leader", "base", "spans", "seed", "at", "range", "ahead", "component_id", "tokens", "y", "row", "entity", "term", "hits", "words", "payload", "keeper", "fingerprint", "__key", "rep")


def prose(rng, words, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    near = base.split()
    near[7] = "changed"
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, long), (7, long + " more"), (8, base), (9, " ".join(near)), (10, base), (10, base), (11, base.upper()),
        (None, base), (None, "alone without id"), (None, None), (12, "x" * 50_000), (13, "日本語 テキスト é 👩‍👩‍👧"), (14, "you are an idiot. not you"), (15, "mail a.b@c.example or +49 30 1234567, card 4111 1111 1111 1111, 10.0.0.1"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id bigint, text string")


@pytest.fixture(scope="session")
def clashing(odd):
    return odd.select("*", *(F.lit(7).alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
