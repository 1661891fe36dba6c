"""Type names and time layouts of a configuration, as Spark knows them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# SQL type names.
NAMES = {
    "VARCHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(), "CHAR": T.StringType(),
    "DOUBLE": T.DoubleType(), "FLOAT8": T.DoubleType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "FLOAT4": T.FloatType(),
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "HUGEINT": T.DecimalType(38, 0),
    "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMPTZ": T.TimestampType(), "BLOB": T.BinaryType(),
}
# The parts of a reference-time layout (Mon Jan 2 15:04:05 2006) and their patterns, longest first.
LAYOUT = (
    ("January", "MMMM"), ("Monday", "EEEE"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("-0700", "xx"), ("2006", "yyyy"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"),
    ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
)
_LAYOUT = re.compile("|".join(re.escape(a) for a, _ in LAYOUT) + r"|\.0+|\.9+|[A-Za-z]+")


def spark_type(name: str | None) -> T.DataType:
    """The type a column definition names; without a name, a string. Raises ValueError on an unknown one."""
    key = (name or "VARCHAR").strip().upper()
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)(?:\((\d+)(?:,\s*(\d+))?\))?", key):
        return T.DecimalType(int(m[1] or 18), int(m[2] or (0 if m[1] else 3)))
    if m := re.fullmatch(r"VARCHAR\(\d+\)", key):
        return T.StringType()
    if key not in NAMES:
        raise ValueError(f"unknown column type {name!r}")
    return NAMES[key]


def time_pattern(layout: str) -> str:
    """A reference-time layout as a datetime pattern; a pattern that is none (it has letters like yyyy) is returned as it is."""
    if not re.search(r"2006|06|15|03", layout):
        return layout
    table = dict(LAYOUT)

    def part(m: re.Match) -> str:
        x = m[0]
        if x in table:
            return table[x]
        return "[" + "." + "S" * (len(x) - 1) + "]" if x[0] == "." else f"'{x}'"

    return _LAYOUT.sub(part, layout)
