"""Settings: validation, migration, connections and table profiles, from YAML or mappings."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from fnmatch import fnmatch
from typing import Any

NULL_EMPTY_POLICIES = ("distinct", "null_as_empty", "empty_as_null")
_TRUE = {"1", "true", "yes", "y", "on"}


def truth(value: Any) -> bool:
    """A boolean from a boolean, a number or a word."""
    return value.strip().lower() in _TRUE if isinstance(value, str) else bool(value)


@dataclass(frozen=True)
class Connection:
    """A JDBC source or target; options go to Spark's reader and writer as they are."""

    url: str = ""
    user: str = ""
    password: str = ""
    driver: str = ""
    fetchsize: int = 10_000
    batchsize: int = 10_000

    def options(self) -> dict[str, str]:
        named = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver}
        return {k: v for k, v in named.items() if v} | {"fetchsize": str(self.fetchsize), "batchsize": str(self.batchsize)}


@dataclass(frozen=True)
class Validation:
    chunk_size: int = 10_000
    chunk_size_by_pattern: dict[str, int] = field(default_factory=dict)
    force_keyset: bool = False
    fallback_mismatches: int = 3
    null_empty_policy: str = "distinct"
    strict_rows: bool = False
    decimal_tolerance: str = "0.0001"
    tolerance_by_column: dict[str, str] = field(default_factory=dict)
    float_scale: int = 6
    sample_size: int = 10
    max_diffs_per_chunk: int = 10
    lob_sample_size: int = 1024
    lob_prefix: int = 100
    immutable_before: str | None = None
    check_keys: bool = True

    def __post_init__(self):
        if self.null_empty_policy not in NULL_EMPTY_POLICIES:
            raise ValueError(f"null_empty_policy is one of {', '.join(NULL_EMPTY_POLICIES)}")
        if self.chunk_size < 1:
            raise ValueError("chunk_size is at least 1")

    def size_for(self, table: str) -> int:
        """The chunk size of schema.table: that of the first pattern (% or * for any text) that fits."""
        for pattern, size in self.chunk_size_by_pattern.items():
            if fnmatch(table.lower(), pattern.lower().replace("%", "*")):
                return int(size)
        return self.chunk_size

    def tolerance(self, column: str) -> str:
        return str(self.tolerance_by_column.get(column.lower(), self.decimal_tolerance))


@dataclass(frozen=True)
class Migration:
    truncate_before_insert: bool = False
    batch_size: int = 1000
    target_schema: str | None = None
    create_table: bool = True


@dataclass(frozen=True)
class TableProfile:
    """What a profile says of one table; mode is None, 'all' or a mapping with the name partition_aware and its settings."""

    columns: tuple[str, ...] | None = None
    pk_columns: tuple[str, ...] | None = None
    mode: str | None = None
    partition_key: str | None = None
    immutable_before: str | None = None

    @property
    def all_columns(self) -> bool:
        return self.mode == "all" or self.columns is None


@dataclass(frozen=True)
class Settings:
    source: Connection = Connection()
    target: Connection = Connection()
    validation: Validation = Validation()
    migration: Migration = Migration()
    profiles: dict[str, dict[str, TableProfile]] = field(default_factory=dict)

    def profile(self, schema: str, table: str) -> TableProfile:
        tables = {k.lower(): v for k, v in self.profiles.items()}.get(schema.lower(), {})
        return {k.lower(): v for k, v in tables.items()}.get(table.lower(), TableProfile())


def _only(kind, values: dict | None):
    """kind from those of values that are its fields; numbers and truth words are converted."""
    known = {f.name: f for f in fields(kind)}
    out = {}
    for k, v in (values or {}).items():
        if k in known:
            default = known[k].default
            out[k] = truth(v) if isinstance(default, bool) else int(v) if isinstance(default, int) else v
    return kind(**out)


def profile_of(values: dict | None) -> TableProfile:
    values = values or {}
    mode = values.get("validation_mode")
    more: dict = mode if isinstance(mode, dict) else {}
    name = more.get("type") or more.get("mode") or next((k for k in more if k in ("all", "partition_aware")), None) if more else mode
    inner = more.get("partition_aware") if isinstance(more.get("partition_aware"), dict) else more
    listed = lambda x: tuple(c.lower() for c in x) if x else None
    return TableProfile(listed(values.get("columns")), listed(values.get("pk_columns")), name, (inner.get("partition_key") or values.get("partition_key")), _text(inner.get("immutable_before") or values.get("immutable_before")))


def _text(value) -> str | None:
    return None if value is None else str(value)


def settings_of(values: dict | None, profiles: dict | None = None) -> Settings:
    values = values or {}
    found = {s: {t: profile_of(p) for t, p in (tables or {}).items()} for s, tables in (profiles or values.get("profiles") or {}).items()}
    return Settings(_only(Connection, values.get("source")), _only(Connection, values.get("target")), _only(Validation, values.get("validation")), _only(Migration, values.get("migration")), found)


def load(path: str, profiles: str | None = None) -> Settings:
    """Settings from a YAML file; ${NAME} and ${NAME:-default} are taken from the environment."""
    import yaml

    def read(p):
        with open(p, encoding="utf-8") as f:
            text = re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), f.read())
        return yaml.safe_load(text)

    return settings_of(read(path), read(profiles) if profiles else None)
