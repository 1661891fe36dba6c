"""Declarative configuration: sources (schema mapping, event time, reference tables) and windowed queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import SparkSession

from windrow.types import spark_type

WINDOW_TYPES = ("tumbling", "sliding", "session")
ANY_SOURCE = ("", "generic")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    from_field: str
    type: str = "VARCHAR"
    required: bool = False

    def __post_init__(self):
        spark_type(self.type)


@dataclass(frozen=True)
class RefTable:
    name: str
    columns: dict[str, str]
    rows: list[dict[str, Any]]

    def __post_init__(self):
        for i, row in enumerate(self.rows):
            if missing := set(self.columns) - set(row):
                raise ValueError(f"reference table {self.name}, row {i}: no value for {sorted(missing)}")


@dataclass(frozen=True)
class SourceSpec:
    name: str
    columns: dict[str, ColumnSpec]
    id_field: str = ""
    timestamp_field: str = ""
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss"
    lat_field: str = ""
    lon_field: str = ""
    csv_path: str = ""
    csv_delimiter: str = ","
    scale_factor: float = 1.0
    description: str = ""
    reference_tables: dict[str, RefTable] = field(default_factory=dict)


@dataclass(frozen=True)
class QuerySpec:
    name: str
    query: str
    window_size: int
    window_type: str = "tumbling"
    data_source: str = ""
    return_type: str = ""
    is_alert: bool = False
    alert_format: str = ""

    def __post_init__(self):
        if self.window_type not in WINDOW_TYPES:
            raise ValueError(f"query {self.name}: unsupported window type {self.window_type!r}")
        if self.window_size <= 0 and self.window_type != "session":
            raise ValueError(f"query {self.name}: window_size must be positive")
        if self.is_alert and not self.alert_format:
            raise ValueError(f"query {self.name}: an alert needs an alert_format")

    def reads(self, source: str) -> bool:
        return self.data_source in ANY_SOURCE or self.data_source == source

    def id_column(self, source: SourceSpec) -> str:
        """The column that tells the source's entities apart."""
        found = [c.name for c in source.columns.values() if c.from_field == source.id_field]
        if not found:
            raise ValueError(f"query {self.name}: source {source.name} has no column for its id_field")
        return found[0]

    def text(self, source: SourceSpec) -> str:
        """The SQL; a generic query's {id_field} and the like are filled in as quoted names of the source's columns."""
        if self.data_source != "generic":
            return self.query
        columns = {c.from_field: c.name for c in source.columns.values()}
        quoted = lambda f: "`" + columns.get(f, f).replace("`", "``") + "`"
        return self.query.format_map({k: quoted(getattr(source, k)) for k in ("id_field", "timestamp_field", "lat_field", "lon_field")})


@dataclass(frozen=True)
class Config:
    """rejected: queries that cannot run, by name, and why; the others go on without them."""

    sources: dict[str, SourceSpec]
    queries: list[QuerySpec]
    rejected: dict[str, str] = field(default_factory=dict)

    def sources_of(self, query: QuerySpec) -> list[SourceSpec]:
        return [s for s in self.sources.values() if query.reads(s.name)]


def parse_config(text: str) -> Config:
    """A configuration from YAML. Unknown keys are ignored; a source that lacks a required one raises ValueError.

    A query that lacks one (name, query, return_type), repeats a name or does not fit is rejected by itself.
    """
    raw = yaml.safe_load(text) or {}
    sources = {}
    for name, s in (raw.get("sources") or {}).items():
        columns = {c: ColumnSpec(c, d.get("from_field") or c, d.get("type") or "VARCHAR", bool(d.get("required"))) for c, d in (s.get("columns") or {}).items()}
        refs = {r: RefTable(r, dict(d["columns"]), list(d.get("rows") or [])) for r, d in (s.get("reference_tables") or {}).items()}
        plain = {k: s[k] for k in ("id_field", "timestamp_field", "timestamp_format", "lat_field", "lon_field", "csv_path", "csv_delimiter", "description") if s.get(k)}
        sources[name] = SourceSpec(name, columns, scale_factor=float(s.get("scale_factor") or 1.0), reference_tables=refs, **plain)
    queries: dict[str, QuerySpec] = {}
    rejected: dict[str, str] = {}
    for k, q in enumerate(raw.get("queries") or []):
        name = str((q or {}).get("name") or f"query {k}")
        try:
            spec = parse_query(q or {})
            if spec.name in queries:
                raise ValueError(f"query {spec.name}: the name is taken")
            if spec.data_source not in (*ANY_SOURCE, *sources):
                raise ValueError(f"query {spec.name}: unknown source {spec.data_source!r}")
            queries[spec.name] = spec
        except (KeyError, TypeError, ValueError) as e:
            rejected[name if name not in queries else f"{name} ({k})"] = f"query without {e}" if isinstance(e, KeyError) else str(e)
    return Config(sources, list(queries.values()), rejected)


def parse_query(q: dict[str, Any]) -> QuerySpec:
    return QuerySpec(
        str(q["name"]), str(q["query"]), int(q.get("window_size") or 0), q.get("window_type") or "tumbling", q.get("data_source") or "",
        str(q["return_type"]), bool(q.get("is_alert")), q.get("alert_format") or "",
    )


def load_config(spark: SparkSession, path: str) -> Config:
    """A configuration from any path that Spark can read."""
    return parse_config(spark.read.text(path, wholetext=True).first()[0])
