"""What an index declares about its fields, as plain data that round-trips through JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from fnmatch import fnmatchcase

TYPES = ("STRING", "INT", "LONG", "FLOAT", "DOUBLE", "DATE", "BOOL", "VECTOR", "UNIT_VECTOR", "GEO_POINT")
NUMBERS = ("INT", "LONG", "FLOAT", "DOUBLE")


class QueryError(ValueError):
    """A request that can't be answered: unknown facets, unsortable fields, bad literals."""


@dataclass(frozen=True)
class FieldConfig:
    """One stored path: its type, the names and analyzers it is searched by, and whether it sorts and facets."""

    name: str
    type: str = "STRING"
    index_as: dict[str, str] = field(default_factory=dict)
    sort: str | None = None  # STANDARD, LOWERCASE, FOLDING, LOWERCASE_FOLDING
    facet: str | None = None  # FLAT or HIERARCHICAL
    date_format: str = "yyyy-MM-dd"
    dimension: int | None = None
    lat_key: str = "latitude"
    lon_key: str = "longitude"

    def __post_init__(self):
        if self.type not in TYPES:
            raise QueryError(f"{self.name}: unknown type {self.type}")


@dataclass(frozen=True)
class IndexConfig:
    name: str
    id_field: str
    fields: tuple[FieldConfig, ...]
    default_search: tuple[str, ...] = ()
    mappings: dict[str, tuple[str, ...]] = field(default_factory=dict)
    analyzers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ts_field: str | None = None

    def stored(self, name: str) -> FieldConfig | None:
        return next((f for f in self.fields if f.name == name), None)

    def searched(self, name: str) -> tuple[FieldConfig, str] | None:
        """The stored field and analyzer behind a search name."""
        for f in self.fields:
            if name in f.index_as:
                return f, f.index_as[name]
        f = self.stored(name)
        return (f, "keyword" if f.type == "STRING" else "") if f and not f.index_as else None

    def names(self) -> list[str]:
        return [n for f in self.fields for n in (f.index_as or {f.name: ""})]

    def expand(self, text: str) -> list[str]:
        """Comma lists, globs over declared fields only, and mapped names."""
        out: list[str] = []
        for part in (p.strip() for p in text.split(",")):
            if part in self.mappings:
                found = [y for x in self.mappings[part] for y in ([x] if x == part else self.expand(x))]
            elif "*" in part or "?" in part:
                bars = len(part) - len(part.lstrip("|")) if part.endswith("|") else 0
                core = part[bars : len(part) - bars] if bars else part
                found = ["|" * bars + n + "|" * bars for n in self.names() if fnmatchcase(n, core)]
            else:
                found = [part]
            out += [f for f in found if f not in out]
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> IndexConfig:
        d = json.loads(text)
        tuples = {k: tuple(v) for k, v in d["mappings"].items()}, {k: tuple(v) for k, v in d["analyzers"].items()}
        return IndexConfig(**d | {"fields": tuple(FieldConfig(**f) for f in d["fields"]), "default_search": tuple(d["default_search"]), "mappings": tuples[0], "analyzers": tuples[1]})

    def update(self, fields: tuple[FieldConfig, ...] = (), removed: tuple[str, ...] = (), how: str = "MERGE", **settings) -> IndexConfig:
        """MERGE puts fields in by name, REPLACE takes only those; removed names go. Other settings are replaced."""
        if how not in ("MERGE", "REPLACE"):
            raise QueryError(f"unknown update {how}")
        now = {} if how == "REPLACE" else {f.name: f for f in self.fields}
        now |= {f.name: f for f in fields}
        return replace(self, fields=tuple(f for n, f in now.items() if n not in removed), **settings)
