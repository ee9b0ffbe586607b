"""Property graphs as DataFrames.

A graph is a set of node tables (one per label, with a key column) and edge tables (one per type,
with source and target columns and a key that tells parallel edges apart). Tables stay ordinary
DataFrames: patterns become joins, and Catalyst prunes columns, pushes filters and picks join plans.
Graphs are values; a change gives a new graph that shares all other tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field, replace
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")


class _Table:
    """A named table; its DataFrame may be given as a function, which is called when the table is first used."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame]):
        self._df = df

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    def with_df(self, df: DataFrame):
        """The same table over other rows."""
        new = copy(self)
        new._df = df
        return new


class Nodes(_Table):
    def __init__(self, label: str, df: DataFrame | Callable[[], DataFrame], key: str, extra_labels: tuple[str, ...] = ()):
        super().__init__(df)
        self.label, self.key, self.extra_labels = label, key, extra_labels

    @property
    def labels(self) -> set[str]:
        return {self.label, *self.extra_labels}


class Edges(_Table):
    def __init__(self, type: str, df: DataFrame | Callable[[], DataFrame], src: str, dst: str, key: tuple[str, ...] = (), src_label: str | None = None, dst_label: str | None = None):
        super().__init__(df)
        self.type, self.src, self.dst, self.key, self.src_label, self.dst_label = type, src, dst, key, src_label, dst_label

    def rows(self) -> DataFrame:
        """Properties with ``_src``, ``_dst``, ``_eid`` and ``_type``."""
        key = self.key or (self.src, self.dst)
        eid = F.col(key[0]) if len(key) == 1 else F.struct(*key)
        return self.df.select(F.col(self.src).alias("_src"), F.col(self.dst).alias("_dst"), eid.alias("_eid"), F.lit(self.type).alias("_type"), "*")


@dataclass(frozen=True)
class Graph:
    name: str
    nodes: dict[str, Nodes] = field(default_factory=dict)
    edges: dict[str, Edges] = field(default_factory=dict)

    def __post_init__(self):
        if not _NAME.fullmatch(self.name):
            raise ValueError(f"{self.name!r} is no graph name: 1 to 63 letters, digits or _")

    def with_nodes(self, *tables: Nodes) -> "Graph":
        return replace(self, nodes=self.nodes | {t.label: t for t in tables})

    def with_edges(self, *tables: Edges) -> "Graph":
        return replace(self, edges=self.edges | {t.type: t for t in tables})

    def labels_for(self, expression: str | None) -> list[str]:
        """Labels whose tables satisfy a label expression such as ``A|B``, ``A&!B`` or ``%``.

        Decided from the catalog, so tables that can't match are never read.
        """
        if expression is None:
            return list(self.nodes)
        return [t.label for t in self.nodes.values() if label_test(expression, t.labels)]

    def node_rows(self, expression: str | None) -> DataFrame:
        """Rows of all matching labels: their properties, ``_key`` and ``_labels``."""
        labels = self.labels_for(expression)
        if not labels:
            raise ValueError(f"no label satisfies {expression!r}; there are {sorted(self.nodes)}")
        parts = [self.nodes[x].df.select(F.col(self.nodes[x].key).alias("_key"), F.array(*(F.lit(y) for y in sorted(self.nodes[x].labels))).alias("_labels"), "*") for x in labels]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def edge_rows(self, types: str | None, direction: str = "out") -> DataFrame:
        """Edges of ``A|B`` (None: all), oriented: ``both`` gives each edge in both directions, a self-loop once."""
        names = list(self.edges) if types is None else [t.strip() for t in types.split("|")]
        unknown = [t for t in names if t not in self.edges]
        if unknown:
            raise ValueError(f"no relationship type {unknown}; there are {sorted(self.edges)}")
        out = None
        for t in names:
            rows = self.edges[t].rows()
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        turned = lambda d: d.withColumns({"_src": F.col("_dst"), "_dst": F.col("_src")})
        if direction == "out":
            return out
        if direction == "in":
            return turned(out)
        if direction == "both":
            return out.unionByName(turned(out.filter(~F.col("_src").eqNullSafe(F.col("_dst")))))
        raise ValueError(f"direction is out, in or both, not {direction!r}")


def label_test(expression: str, labels: set[str]) -> bool:
    """Whether ``labels`` satisfy an expression of names, ``%``, ``!``, ``&``, ``|`` and parentheses.

    ``!`` binds closest, then ``&``, then ``|``; AND, OR and NOT may stand for them. What is no
    expression is taken as one name.
    """
    text = re.sub(r"\bAND\b", "&", re.sub(r"\bOR\b", "|", re.sub(r"\bNOT\b", "!", expression)))
    items = [*re.findall(r"`[^`]+`|[A-Za-z_]\w*|[!&|()%*]", text), ""]

    def either() -> bool:
        found = both()
        while items[0] == "|":
            items.pop(0)
            found = both() or found
        return found

    def both() -> bool:
        found = one()
        while items[0] == "&":
            items.pop(0)
            found = one() and found
        return found

    def one() -> bool:
        item = items.pop(0)
        if item == "!":
            return not one()
        if item == "(":
            found = either()
            if items.pop(0) != ")":
                raise ValueError(expression)
            return found
        if item in ("", "&", "|", ")"):
            raise ValueError(expression)
        return item in ("%", "*") or item.strip("`") in labels

    try:
        found = either()
        return found if items == [""] else expression in labels
    except (ValueError, IndexError):
        return expression in labels


def graph_from_tables(name: str, tables: dict[str, DataFrame], keys: dict[str, str], foreign: dict[str, list[tuple[str, str]]]) -> Graph:
    """A graph from relational declarations: keys[table] and foreign[table] = [(column, other table)].

    Every table is a label; a table with two or more foreign keys is also an edge type along its
    first two; one foreign key gives an edge type ``HAS_<this table>`` from the other table to this one.
    """
    g = Graph(name)
    for t, df in tables.items():
        if t in keys:
            g = g.with_nodes(Nodes(t, df, keys[t]))
        links = foreign.get(t, [])
        if len(links) >= 2:
            (a, x), (b, y) = links[:2]
            g = g.with_edges(Edges(t.upper(), df, a, b, (keys[t],) if t in keys else (), x, y))
        elif links:
            column, other = links[0]
            g = g.with_edges(Edges(f"HAS_{t.upper()}", df.filter(F.col(column).isNotNull()).select(column, keys[t]), column, keys[t], (keys[t],), other, t))
    return g


def tpch_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph over the bundled tables: trade, events, conversations and a cyclic nation map. Only tables that a query uses are opened."""

    @cache
    def read(t: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def of(t: str, *columns: str) -> Callable[[], DataFrame]:
        return lambda: read(t).select(*columns) if columns else read(t)

    def turns() -> DataFrame:
        return read("conversations").withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))

    def adjacent() -> DataFrame:
        n = F.col("n_nationkey")
        ways = F.array(F.struct(((n + 1) % 25).alias("b"), F.lit(1).alias("way")), F.struct(((n * 3) % 25).alias("b"), F.lit(3).alias("way")))
        return read("nation").select(n.alias("a"), F.explode(ways).alias("x")).select("a", "x.b", "x.way")

    line_key = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return (
        Graph("trade")
        .with_nodes(
            Nodes("Region", of("region"), "r_regionkey"), Nodes("Nation", of("nation"), "n_nationkey"), Nodes("Customer", of("customer"), "c_custkey", ("Party",)),
            Nodes("Supplier", of("supplier"), "s_suppkey", ("Party",)), Nodes("Part", of("part"), "p_partkey"), Nodes("Order", of("orders"), "o_orderkey"),
            Nodes("Event", of("events"), "event_id"), Nodes("Document", of("documents"), "doc_id"), Nodes("Turn", turns, "turn_id"),
        )
        .with_edges(
            Edges("PLACED", of("orders", "o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", ("o_orderkey",), "Customer", "Order"),
            Edges("CONTAINS", of("lineitem"), "l_orderkey", "l_partkey", line_key, "Order", "Part"),
            Edges("SUPPLIED_BY", of("lineitem"), "l_partkey", "l_suppkey", line_key, "Part", "Supplier"),
            Edges("IN_NATION", of("customer", "c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", ("c_custkey",), "Customer", "Nation"),
            Edges("BASED_IN", of("supplier", "s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey", ("s_suppkey",), "Supplier", "Nation"),
            Edges("IN_REGION", of("nation", "n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", ("n_nationkey",), "Nation", "Region"),
            Edges("PERFORMED", of("events", "user_id", "event_id"), "user_id", "event_id", ("event_id",), "Customer", "Event"),
            Edges("ADJACENT", adjacent, "a", "b", ("a", "way"), "Nation", "Nation"),
            Edges("NEXT", lambda: turns().select("turn_id", F.concat_ws(":", "conv_id", F.col("turn") + 1).alias("next_id")), "turn_id", "next_id", ("turn_id",), "Turn", "Turn"),
        )
    )


def key_of(var: str) -> Column:
    return F.col(f"{var}__key")


def prop(var: str, name: str) -> Column:
    """Property of a bound node or edge variable."""
    return F.col(f"{var}__{name}")
