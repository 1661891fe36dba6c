"""Alert lines from a format template."""

from __future__ import annotations

import re
from collections.abc import Iterator
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts around alert lines.
HEADING = "*** {} {} WARNING(S) ***"
MISSING = "  (format error: missing field '{}')"


def alert_column(template: str, columns: list[str]) -> Column:
    """A template like "{mmsi}: {distance_nm} nm" as a string column; nulls read None.

    A template that names a missing column gives the whole row and a note instead. Fields with a conversion or a format
    specification need Python's formatting: ValueError, see alert_lines.
    """
    parts = []
    for text, name, spec, conversion in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"{{{name}}} has a format specification")
        if name not in columns:
            row = F.to_json(F.struct(*columns)) if columns else F.lit("{}")
            return F.concat(row, F.lit(MISSING.format(name)))
        parts.append(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def alerts(results: DataFrame, template: str, name: str = "alert") -> DataFrame:
    """results plus their alert lines."""
    return results.withColumn(name, alert_column(template, results.columns))


def alert_lines(results: DataFrame, template: str) -> Iterator[str]:
    """Every row's alert line, formatted where the lines are read: format specifications and conversions count too.

    Rows come to the reader partition by partition, so a batch of any size needs one partition's memory.
    """
    fields = {name for _, name, _, _ in Formatter().parse(template) if name}
    lacking = sorted(f for f in fields if re.split(r"[.\[]", f)[0] not in results.columns)
    for row in results.toLocalIterator():
        values = row.asDict()
        yield f"{values}{MISSING.format(lacking[0])}" if lacking else template.format(**values)


def print_alerts(results: DataFrame, query: str, template: str) -> int:
    """Print a batch's alert lines under a heading with their number; returns that number."""
    number = results.count()
    if number:
        print(HEADING.format(number, query.upper()))
        for line in alert_lines(results, template):
            print(f"  {line}")
    return number
