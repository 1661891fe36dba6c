import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from windrow.llm import common, line_dedup
from windrow.llm.line_dedup import holds, places, put, without_repeated_lines

TRIM = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in TRIM.sub("", line))


def brute(rows, least, keep="none"):
    """(doc_id, text, n_lines, n_dropped) by plain loops."""
    found, first = {}, {}
    for i, (doc_id, text) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            key = key_of(line)
            if key:
                found.setdefault(key, set()).add(i)
                at = (doc_id is None, doc_id or 0, k)
                first[key] = min(first.get(key, at), at)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(found.get(key_of(x), ())) >= least and not (keep == "first" and first[key_of(x)] == (doc_id is None, doc_id or 0, k)) for k, x in enumerate(lines)]
        out.append((doc_id, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


def lined():
    rows = odd_rows()
    rows += [(100 + i, f"Shared Line\nown {i}\n\n  shared line\t\nÄther {i % 2}\nmany {i % 3} \n") for i in range(12)]
    rows += [(200 + i, "\n".join(["ONLY", f"x{i}", "only", " only"])) for i in range(2)] + [(300, "Shared line")] * 2 + [(None, "shared line\r\n\x0b")]
    return rows + [(400, "long " * 30_000 + "\nmany 1 ")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(lined(), "doc_id bigint, text string").repartition(5).withColumns({c: F.lit(7) for c in ("digest", "known", "of", "line", "documents", "segment", "at")})


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("least", [2, 4, 10])
def test_against_plain_loops(frame, least, keep):
    assert rows_of(without_repeated_lines(frame, least, keep=keep)) == brute(lined(), least, keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_tables_too_large_to_broadcast_and_full_filters_change_nothing(frame, monkeypatch, keep):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert rows_of(without_repeated_lines(frame, 4, keep=keep)) == brute(lined(), 4, keep)
    assert rows_of(without_repeated_lines(frame, 4, keep=keep, bits=64)) == brute(lined(), 4, keep)


def test_empty_tables_and_bounds(none):
    assert without_repeated_lines(none).count() == 0
    with pytest.raises(ValueError):
        without_repeated_lines(none, 1)


def test_only_suspected_repeats_pass_the_second_filter(spark):
    rows = [(i, "\n".join(f"line {i} {k}" for k in range(50)) + "\neveryone") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    suspects = line_dedup.Suspects.of(df, 1)
    import pyarrow as pa

    lines = line_dedup.Lines.of(pa.array([t for _, t in rows]), 1)
    found = {lines.key[i] for i in suspects.among(lines)}
    assert b"everyone" in found and len(found) <= 3


def test_filters_of_parts_merge_into_one():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in range(2))
    b[:40] = a[:40]
    once = [np.zeros(1 << 13, np.uint8) for _ in range(2)]
    for bitmap, h in zip(once, (a, b), strict=True):
        put(bitmap, places(h, 1 << 16))
    assert holds(once[0] & once[1], places(a[:40], 1 << 16)).all()


def test_digest_is_of_the_key():
    assert line_dedup.digest(b"x") == hashlib.sha256(b"x").digest()[:16]
