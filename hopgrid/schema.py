"""Declared node and edge models: types, constraints as Spark checks, and advice on queries."""

from __future__ import annotations

import difflib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import Graph

#: Accepted type names and the Spark type each stands for.
TYPES = {
    "STR": "string", "STRING": "string", "TEXT": "string", "VARCHAR": "string",
    "INT": "bigint", "INT64": "bigint", "INTEGER": "bigint", "BIGINT": "bigint",
    "FLOAT": "double", "FLOAT64": "double", "DOUBLE": "double", "REAL": "double",
    "BOOL": "boolean", "BOOLEAN": "boolean", "DATETIME": "timestamp", "TIMESTAMP": "timestamp", "DATE": "date",
    "DURATION": "interval day to second", "INTERVAL": "interval day to second", "ANY": "variant",
    "LIST": "array<string>", "ARRAY": "array<string>", "MAP": "map<string,string>", "DICT": "map<string,string>", "OBJECT": "map<string,string>",
    "TIME": "bigint", "POINT": "struct<srid:int,x:double,y:double,z:double>", "VECTOR": "array<float>",
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "STRING"
    primary_key: bool = False
    unique: bool = False
    required: bool = False
    dimensions: int | None = None

    def spark_type(self) -> T.DataType:
        text = TYPES.get(self.type.upper())
        if text is None:
            raise ValueError(f"no type {self.type!r}; there are {sorted(TYPES)}")
        return T.DataType.fromDDL(text)


@dataclass(frozen=True)
class NodeModel:
    label: str
    fields: tuple[Field, ...]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type(), not (f.required or f.primary_key)) for f in self.fields])

    def merge_keys(self) -> list[str]:
        """Primary key fields, else unique ones, else all."""
        return [f.name for f in self.fields if f.primary_key] or [f.name for f in self.fields if f.unique] or [f.name for f in self.fields]


@dataclass(frozen=True)
class EdgeModel:
    type: str
    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    directed: bool = True

    def joins(self, source: str | None, target: str | None) -> bool:
        """Whether the ends may be joined; an empty side takes any label, case doesn't count."""
        fits = lambda side, label: not side or label is None or label.lower() in {s.lower() for s in side}
        return fits(self.sources, source) and fits(self.targets, target)


@dataclass(frozen=True)
class Registry:
    nodes: tuple[NodeModel, ...] = ()
    edges: tuple[EdgeModel, ...] = ()

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "Registry":
        d = json.loads(text)
        fields = lambda x: tuple(Field(**f) for f in x)
        return cls(
            tuple(NodeModel(n["label"], fields(n["fields"])) for n in d["nodes"]),
            tuple(EdgeModel(e["type"], tuple(e["sources"]), tuple(e["targets"]), fields(e["fields"]), e["directed"]) for e in d["edges"]),
        )

    # The codes below.
    def advise(self, nodes: list[tuple[str | None, list[str]]], edges: list[tuple[str, str | None, str | None, bool]]) -> list[tuple[str, str]]:
        """Codes and messages on a query's shape: nodes (label, properties), edges (type, source, target, directed)."""
        out: list[tuple[str, str]] = []
        known, types = {n.label: n for n in self.nodes}, {e.type: e for e in self.edges}
        hint = lambda x, names: f"; did you mean {m[0]}?" if (m := difflib.get_close_matches(x, names, 1)) else ""
        for label, props in nodes:
            if label is None:
                continue
            if label not in known:
                out.append(("UNKNOWN_NODE_LABEL", f"{label}{hint(label, known)}"))
                continue
            names = [f.name for f in known[label].fields]
            out += [("UNDECLARED_PROPERTY", f"{label}.{p}{hint(p, names)}") for p in props if p not in names]
        for type_, source, target, directed in edges:
            if type_ not in types:
                out.append(("UNKNOWN_RELATIONSHIP_TYPE", f"{type_}{hint(type_, types)}"))
            elif not types[type_].joins(source, target):
                out.append(("INCOMPATIBLE_ENDPOINTS", f"{source} -{type_}-> {target}"))
            elif types[type_].directed and not directed:
                out.append(("UNDIRECTED_TRAVERSAL", type_))
        return out


#: Kinds of literals and the declared types that take them.
_TAKES = {bool: {"boolean"}, int: {"bigint", "double", "timestamp", "date"}, float: {"double"}, str: {"string", "timestamp", "date"}}


def type_mismatches(model: NodeModel, values: dict[str, object]) -> list[tuple[str, str]]:
    """PROPERTY_TYPE_MISMATCH for each literal whose kind the declared type doesn't take."""
    out = []
    for f in model.fields:
        v = values.get(f.name)
        if v is not None and TYPES.get(f.type.upper()) not in (None, "variant") and type(v) in _TAKES and TYPES[f.type.upper()] not in _TAKES[type(v)]:
            out.append(("PROPERTY_TYPE_MISMATCH", f"{model.label}.{f.name} is {f.type}, not {type(v).__name__}"))
    return out


def advise_pattern(registry: Registry, pattern) -> list[tuple[str, str]]:
    """Advice on a pattern's labels, edge types and ends, taken from its variables."""
    labels = {v: x for v, x in pattern._labels.items() if x}
    nodes = [(x, []) for x in labels.values()]
    edges = [(t, None, None, True) for _, types in pattern._edges for t in (types or "").split("|") if t]
    return registry.advise(nodes, [(t.strip(), a, b, d) for t, a, b, d in edges])


def violations(graph: Graph, model: NodeModel) -> DataFrame:
    """(constraint, field, rows): rows that break key, unique, not-null or vector-length constraints."""
    df, out = graph.nodes[model.label].df, None
    for f in model.fields:
        checks = []
        if f.primary_key or f.required:
            checks.append(("not null", df.filter(F.col(f.name).isNull()).agg(F.count("*").alias("rows"))))
        if f.primary_key or f.unique:
            twice = df.filter(F.col(f.name).isNotNull()).groupBy(f.name).count().filter("count > 1")
            checks.append(("unique", twice.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("rows"))))
        if f.dimensions is not None:
            checks.append(("dimensions", df.filter(F.size(f.name) != f.dimensions).agg(F.count("*").alias("rows"))))
        for name, rows in checks:
            row = rows.select(F.lit(name).alias("constraint"), F.lit(f.name).alias("field"), "rows")
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError(f"{model.label} declares no constraint")
    return out
