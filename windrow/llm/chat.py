"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string; nothing is known of its inside. Successive turn
prefixes are rendered and consecutive outputs compared: where the longer output continues the shorter one, the added part
is the new turn's span; where it does not, the template rewrites history. Inside a span the text is located by rendering
the same prefix with two probe texts: what both have before and after their difference is header and footer. For a
template that rewrites history the probes are put into the whole conversation, so the spans hold for the final output.

Rendering all prefixes writes the square of one conversation's length, as any black box must be asked anew for every
prefix; the comparisons begin where the prefix before ended. A task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import partitions, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Characters that begin a control string, and the escape itself.
CONTROL = re.compile(r"[\\<#]")
ROLE_CONTROL = re.compile(r"[\\<#:]")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"<turn>### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def marked(role: str, text: str) -> str:
    return f"<turn>### {escape(role, ROLE_CONTROL)}: {escape(text)}</turn>\n"


#: Short turns as they were marked in the prefix before.
remembered = lru_cache(maxsize=4096)(marked)


def turn_template(turns: list[Turn]) -> str:
    """The default template: marked turns; control strings inside texts and roles are escaped with a backslash."""
    return "".join([remembered(*turn) if len(turn[1]) <= 2000 else marked(*turn) for turn in turns])


def parse_turns(formatted: str) -> list[Turn]:
    """The turns that turn_template's output says; raises ValueError on anything else."""
    turns, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return turns


@dataclass
class Rendering:
    text: str
    spans: list[tuple[int, int]]
    masks: list[tuple[int, int]]  # the texts of the turns that count for the loss
    rewrites: list[int]  # turns whose coming changed what was rendered before


def shared(a: str, b: str, start: int = 0) -> int:
    """Length of what both begin with, if they are the same before `start`: slices are compared, longer ones while they
    agree and shorter ones where they do not."""
    at, step, end = start, 64, min(len(a), len(b))
    while at < end:
        stop = min(end, at + step)
        if a[at:stop] == b[at:stop]:
            at, step = stop, 2 * step
        elif stop - at == 1:
            break
        else:
            step = (stop - at) // 2
    return at


def between(a: str, b: str, known: str = "") -> tuple[int, int]:
    """Lengths of what two renderings of the same turns with different one-letter probes share before and after them.

    known: what both are likely to begin with.
    """
    head = shared(a, b, len(known) if a.startswith(known) and b.startswith(known) else 0)
    return head, shared(a[head:][::-1], b[head:][::-1])


def render(template: Template, turns: list[Turn], learnt: Callable[[str], bool] = lambda role: role == "assistant") -> Rendering:
    outputs = template([])
    spans, masks, rewrites = [], [], []
    for k, (role, _) in enumerate(turns):
        longer = template(turns[: k + 1])
        if longer.startswith(outputs):
            spans.append((len(outputs), len(longer)))
        else:
            rewrites.append(k)
            spans.append((shared(outputs, longer), len(longer)))
        if learnt(role):
            head, tail = between(template([*turns[:k], (role, "a")]), template([*turns[:k], (role, "b")]), outputs)
            masks.append((head, len(longer) - tail))
        outputs = longer
    if rewrites:
        spans, masks = [], []
        for k, (role, _) in enumerate(turns):
            head, tail = between(*(template([*turns[:k], (role, probe), *turns[k + 1 :]]) for probe in "ab"))
            spans.append((head, len(outputs) - tail))
            if learnt(role):
                masks.append(spans[-1])
    return Rendering(outputs, spans, masks, rewrites)


def conversations_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """(conv_id, turns) from rows sorted by conversation; a row without conv_id is a conversation of its own."""
    current, turns, open_ = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if open_ and (conv is None or conv != current):
                yield current, turns
                turns = []
            current, open_ = conv, True
            turns.append((role or "", text or ""))
    if open_:
        yield current, turns


def format_conversations(conversations: DataFrame, template: Template = turn_template) -> DataFrame:
    """conv_id, formatted, spans, loss_spans, rewrites: one row a conversation.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have one order; repeated rows
    are turns of their own. Null roles and texts are empty. Rows with a null conv_id belong to no conversation: each is
    one of its own. Long texts are formatted whole; a conversation is one task's work. An empty table gives no rows. Other
    columns are not read.
    """
    spark = conversations.sparkSession
    kind = conversations.schema["conv_id"].dataType.simpleString()
    pair = "array<struct<start: bigint, end: bigint>>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for conv, turns in conversations_of(it):
            r = render(template, turns)
            rows.append((conv, r.text, [{"start": a, "end": b} for a, b in r.spans], [{"start": a, "end": b} for a, b in r.masks], r.rewrites))
            held += len(r.text)
            if held > 4_000_000:
                yield batch(rows)
                rows, held = [], 0
        yield batch(rows)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = [id_type, pa.string(), spans, spans, pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "formatted", "spans", "loss_spans", "rewrites"])

    # rows without conversation are spread by their text
    ordered = (
        conversations.select("conv_id", "role", "text", "turn")
        .repartition(partitions(spark), F.col("conv_id"), F.when(F.col("conv_id").isNull(), F.xxhash64("text", "turn")))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, spans {pair}, loss_spans {pair}, rewrites array<int>")


def read_back(formatted: DataFrame, digests: bool = False) -> DataFrame:
    """What the formatted texts themselves say: turns and the text under the loss mask, or their digests.

    Only for turn_template's output. A null formatted text is an empty conversation.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    out = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint" if digests else "roles array<string>, texts array<string>, loss_text string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text, masks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or ""
                turns = parse_turns(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in masks or ())
                if digests:
                    all_turns = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                    rows.append((len(turns), all_turns, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
                else:
                    rows.append(([r for r, _ in turns], [t for _, t in turns], loss))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] if digests else [pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            names = ["conv_id", *(x.split(" ")[0] for x in out.split(", "))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, {out}")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says the control strings itself, formatted and read back."""
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_conversations(every), digests=True)


ORACLE = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length('<turn>### ') + length(regexp_replace(role, '[\\<#:]', '..', 'g')) + 2
                + length(regexp_replace(text, '[\\<#]', '..', 'g')) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
