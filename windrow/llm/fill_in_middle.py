"""Fill-in-middle transformation on ropes.

A text becomes a rope: a balanced tree over leaves of a few thousand code points, each node caching the line ends and the
code points below it. The tree is split at two unit ranks (a unit is a line with its end), and the three subtrees are
concatenated in their new order between sentinels; no text is copied on the way. The inverse reads an output's rope, finds
the sentinels and splits at their code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import batches, strings, table

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Code points of a leaf, at most.
LEAF = 4096
#: Of 100 texts, so many are transformed, and of those so many have their suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (text, no children) or an inner node. ends: line ends below; chars: code points; closed: ends with a line end."""

    ends: int
    chars: int
    closed: bool
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    @property
    def units(self) -> int:
        """Lines, the last one without an end counted too."""
        return self.ends + (self.chars > 0 and not self.closed)

    def leaves(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            if node.left is None:
                yield node.text
            else:
                waiting += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def leaf(text: str) -> Rope:
    return Rope(text.count("\n"), len(text), text.endswith("\n"), text)


NOTHING = leaf("")


def rope(text: str) -> Rope:
    """A balanced rope over the whole text."""
    level = [leaf(text[i : i + LEAF]) for i in range(0, len(text), LEAF)] or [NOTHING]
    while len(level) > 1:
        level = [concat(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def concat(*parts: Rope) -> Rope:
    """One rope of several, in order; empty ones leave no node."""
    out = NOTHING
    for p in parts:
        if p.chars:
            out = Rope(out.ends + p.ends, out.chars + p.chars, p.closed, left=out, right=p) if out.chars else p
    return out


def split_chars(node: Rope, at: int) -> tuple[Rope, Rope]:
    """The first `at` code points, and the rest."""
    if at <= 0:
        return NOTHING, node
    if at >= node.chars:
        return node, NOTHING
    if node.left is None:
        return leaf(node.text[:at]), leaf(node.text[at:])
    if at < node.left.chars:
        a, b = split_chars(node.left, at)
        return a, concat(b, node.right)
    a, b = split_chars(node.right, at - node.left.chars)
    return concat(node.left, a), b


def split_units(node: Rope, at: int) -> tuple[Rope, Rope]:
    """The first `at` units, and the rest."""
    if at <= 0:
        return NOTHING, node
    if at >= node.units:
        return node, NOTHING
    return _split_after_end(node, at)


def _split_after_end(node: Rope, at: int) -> tuple[Rope, Rope]:
    """Split behind the at-th line end, which node has."""
    if node.left is None:
        end = -1
        for _ in range(at):
            end = node.text.index("\n", end + 1)
        return split_chars(node, end + 1)
    if at <= node.left.ends:
        a, b = _split_after_end(node.left, at)
        return a, concat(b, node.right)
    a, b = _split_after_end(node.right, at - node.left.ends)
    return concat(node.left, a), b


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """h1 to h4: the first four groups of eight hexadecimal digits of sha256(seed:doc_id); a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(text: str, doc_id: object, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, Rope]:
    """(units, form, the prefix's and the middle's code points, output)."""
    whole, (h1, h2, h3, h4) = rope(text), draws(doc_id, seed)
    n = whole.units
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", None, None, whole
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    start, suffix = split_units(whole, high)
    prefix, middle = split_units(start, low)
    p, s, m = (leaf(x) for x in SENTINELS)
    if h4 % 100 < suffix_first:
        return n, "spm", prefix.chars, middle.chars, concat(s, suffix, p, prefix, m, middle)
    return n, "psm", prefix.chars, middle.chars, concat(p, prefix, s, suffix, m, middle)


def restore(output: str, form: str) -> Rope:
    """The text that transform() made `output` of. A transformed text holds no sentinel, so the first of each kind counts."""
    whole = rope(output)
    if form == "plain":
        return whole
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    begin = len(first)
    between = output.index(second, begin)
    last = output.index(MIDDLE, between + len(second))
    head, rest = split_chars(whole, last)
    middle = split_chars(rest, len(MIDDLE))[1]
    head, b = split_chars(head, between)
    a, b = split_chars(head, begin)[1], split_chars(b, len(second))[1]
    prefix, suffix = (b, a) if form == "spm" else (a, b)
    return concat(prefix, middle, suffix)


def fill_in_middle(documents: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars, output (the transformed text) for every row.

    Null texts are empty ones; empty texts, and texts that hold a sentinel, are plain: output as they are, without
    prefix_chars and middle_chars. Long texts are read whole, in their row's task. A null doc_id draws as an empty one.
    Equal rows give equal results, each its own; other columns are not read; an empty table gives no rows. No shuffle.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            made = [transform(t, i, seed, rate, suffix_first) for i, t in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True)]
            n, form, prefix, middle, out = zip(*made, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([str(r) for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(transformed: DataFrame) -> DataFrame:
    """transformed, with all its columns, plus restored: the text that `output` was made of, from output and form alone.

    A null output is an empty text; a null form is plain. An output that its form does not fit is an error.
    """
    names = transformed.columns
    output, form = names.index("output"), names.index("form")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, text="output"):
            back = [str(restore(o, f or "plain")) for o, f in zip(strings(batch.column(output)), batch.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*names, "restored"])

    return transformed.mapInArrow(run, transformed.withColumn("restored", F.lit("")).schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's transformed text and the text rebuilt from it, as digests."""
    both = restored(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (
    SELECT *, CAST(len(lines) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
    SELECT *, array_to_string(lines[1:lo], '') AS a, array_to_string(lines[lo + 1:hi], '') AS m, array_to_string(lines[hi + 1:], '') AS b FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || b || '<P>' || a || '<M>' || m ELSE '<P>' || a || '<S>' || b || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
