"""Graph patterns as DataFrame joins.

A pattern's rows are one DataFrame; a bound variable ``v`` gives the columns ``v__key`` (nodes) or
``v__eid`` (edges) and ``v__<property>``. Nothing runs until an action, unused properties are pruned
and filters reach the scans. Edge variables of one ``match`` bind different edges wherever their
types overlap; a new ``match`` starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from .shared import written


OWN = {"key", "labels", "eid", "type", "src", "dst"}


def _bound(df: DataFrame, var: str) -> DataFrame:
    """Columns of a variable; a property named like one of the pattern's own columns becomes ``v__p_<name>``."""
    return df.select(*(F.col(f"`{c}`").alias(f"{var}__{'p_' if c in OWN else ''}{c.removeprefix('_')}") for c in df.columns))


class Pattern:
    """Rows of a growing pattern over a graph. Methods give new patterns."""

    def __init__(self, graph: Graph, df: DataFrame | None = None, edges: tuple[tuple[str, str | None], ...] = (), start: str | None = None, labels: dict | None = None):
        self.graph, self.df, self._edges, self._start, self._labels = graph, df, edges, start, labels or {}

    def _with(self, df: DataFrame, **k) -> "Pattern":
        return Pattern(self.graph, df, k.get("edges", self._edges), self._start, self._labels | k.get("labels", {}))

    # -- nodes and edges

    def node(self, var: str, label: str | None = None, where: Column | None = None) -> "Pattern":
        """Scan nodes; a variable that is bound already is restricted to the label, a new one makes a product."""
        rows = _bound(self.graph.node_rows(label), var)
        if where is not None:
            rows = rows.filter(where)
        if self.df is None:
            return self._with(rows, labels={var: label})
        if f"{var}__key" in self.df.columns:
            new = [c for c in rows.columns if c not in self.df.columns or c == f"{var}__key"]
            return self._with(self.df.join(rows.select(*new), f"{var}__key"), labels={var: label})
        return self._with(self.df.crossJoin(rows), labels={var: label})

    def match(self) -> "Pattern":
        """A new MATCH clause: edges bound so far may be bound again."""
        return Pattern(self.graph, self.df, (), self._start, self._labels)

    def _hop(self, types: str | None, to: str, label: str | None, direction: str, src: str | None, var: str | None, where: Column | None) -> "Pattern":
        src = src or self._last()
        var = var or f"_e{len(self._edges)}_{to}"
        e = _bound(self.graph.edge_rows(types, direction), var)
        e = e.withColumnRenamed(f"{var}__src", f"{src}__key")
        if self.df is None:  # an open start: its key is the edge's own end
            df = e.withColumnRenamed(f"{var}__dst", f"{to}__key")
        elif f"{to}__key" in self.df.columns:  # closes a ring
            df = self.df.join(e.withColumnRenamed(f"{var}__dst", f"{to}__key"), [f"{src}__key", f"{to}__key"])
        else:
            df = self.df.join(e, f"{src}__key").withColumnRenamed(f"{var}__dst", f"{to}__key")
        names = None if types is None else {t.strip() for t in types.split("|")}
        for other, theirs in self._edges:
            if names is None or theirs is None or names & {t.strip() for t in theirs.split("|")}:
                mine, its = F.col(f"{var}__eid"), F.col(f"{other}__eid")
                if df.schema[f"{var}__eid"].dataType != df.schema[f"{other}__eid"].dataType:
                    mine, its = mine.cast("string"), its.cast("string")
                df = df.filter(~((F.col(f"{var}__type") == F.col(f"{other}__type")) & (mine == its)))
        out = Pattern(self.graph, df, (*self._edges, (var, types)), self._start, self._labels)
        if label is not None:
            out = out.node(to, label)
        out._labels[to] = label
        return out.where(where) if where is not None else out

    def _last(self) -> str:
        if self._labels:
            return list(self._labels)[-1]
        return self._start

    def to(self, types: str | None, to: str, label: str | None = None, *, src: str | None = None, edge: str | None = None, where: Column | None = None) -> "Pattern":
        """One hop along edges. Without a label the target's properties aren't joined; its key is there."""
        return self._hop(types, to, label, "out", src, edge, where)

    def from_(self, types: str | None, to: str, label: str | None = None, *, src: str | None = None, edge: str | None = None, where: Column | None = None) -> "Pattern":
        """One hop against edges."""
        return self._hop(types, to, label, "in", src, edge, where)

    def edge(self, types: str | None, to: str, label: str | None = None, *, src: str | None = None, edge: str | None = None, where: Column | None = None) -> "Pattern":
        """One hop in either direction; a self-loop matches once."""
        return self._hop(types, to, label, "both", src, edge, where)

    def where(self, *conditions: Column) -> "Pattern":
        return self._with(self.df.filter(reduce(lambda a, b: a & b, conditions)))

    # -- sub-patterns, given from an open start: graph pattern ``opened(graph, "v").to(...)``

    def optional(self, sub: "Pattern", on: Column | None = None) -> "Pattern":
        """Left outer join of the whole sub-pattern with its own conditions; ``on`` may compare both sides."""
        key = f"{sub._start}__key"
        right = sub.df.withColumnRenamed(key, "_opt")
        same = F.col(key) == F.col("_opt")
        return self._with(self.df.join(right, same if on is None else same & on, "left").drop("_opt"), labels=sub._labels)

    def exists(self, sub: "Pattern", negate: bool = False) -> "Pattern":
        key = f"{sub._start}__key"
        return self._with(self.df.join(sub.df.select(key), key, "left_anti" if negate else "left_semi"))

    def flag(self, sub: "Pattern", alias: str) -> "Pattern":
        """EXISTS as a value."""
        key = f"{sub._start}__key"
        return self._with(self.df.join(sub.df.select(key).distinct().withColumn(alias, F.lit(True)), key, "left").fillna(False, [alias]))

    def count(self, sub: "Pattern", alias: str) -> "Pattern":
        """COUNT { pattern }: 0 where there is none."""
        key = f"{sub._start}__key"
        return self._with(self.df.join(sub.df.groupBy(key).agg(F.count("*").alias(alias)), key, "left").fillna(0, [alias]))

    def collect(self, sub: "Pattern", value: Column, alias: str) -> "Pattern":
        """Pattern comprehension: the values' list, empty where there is none."""
        key = f"{sub._start}__key"
        lists = sub.df.groupBy(key).agg(F.collect_list(value).alias(alias))
        df = self.df.join(lists, key, "left")
        return self._with(df.withColumn(alias, F.coalesce(alias, F.array().cast(df.schema[alias].dataType))))

    def count_less(self, sub: "Pattern", mine: Column, its: Column, alias: str) -> DataFrame:
        """One row: the number of pairs of a row and one of ``sub``'s with ``mine < its``, as a join with this
        condition would give, but no pair is made. A value's rows are counted first; then sorted ranges of values,
        and the ranges before them of the same key, tell how many of ``mine`` lie below each of ``its``.
        """
        key = f"{sub._start}__key"
        one = lambda df, value, a, b: df.select(F.col(key).alias("k"), value.alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        values = one(self.df, mine, 1, 0).union(one(sub.df, its, 0, 1)).filter("k is not null and v is not null").groupBy("k", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        parts = written(values.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()))  # written, so that a row keeps its part
        sums = parts.groupBy("k", "part").agg(F.sum("a").alias("a"))
        before = lambda by, order: F.coalesce(F.sum("a").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = parts.withColumn("near", before(["k", "part"], "v")).join(sums.select("k", "part", before(["k"], "part").alias("far")), ["k", "part"])
        return rows.agg(F.coalesce(F.sum(F.col("b") * (F.col("near") + F.col("far"))), F.lit(0)).alias(alias))

    # -- variable length

    def hops(self, types: str | None, to: str, low: int = 1, high: int | None = None, *, src: str | None = None, mode: str = "trail", direction: str = "out", path: str | None = None) -> "Pattern":
        """Paths of ``low`` to ``high`` edges. Modes: walk, trail (no edge twice), simple (no node twice but
        the first may end it), acyclic (no node twice). Without ``high`` all but walk end by themselves.

        Each length is one join; a bounded walk stays one plan, longer loops write each level to the
        shared folder. Ends are ``<to>__key``; ``<path>__length``, ``__nodes`` and ``__rels`` if asked.
        """
        if high is not None and high < low:
            raise ValueError(f"hops: {high} is less than {low}")
        if mode not in ("walk", "trail", "simple", "acyclic"):
            raise ValueError(f"no path mode {mode!r}")
        if high is None and mode == "walk":
            raise ValueError("a walk needs a bound")
        src = src or self._last()
        e = self.graph.edge_rows(types, direction).select("_src", "_dst", F.concat_ws("|", "_type", F.col("_eid").cast("string")).alias("_eid"))
        kind = e.schema["_dst"].dataType
        front = self.df.withColumns({"_at": F.col(f"{src}__key").cast(kind), "_len": F.lit(0), "_nodes": F.array(F.col(f"{src}__key").cast(kind)), "_rels": F.array().cast("array<string>"), "_closed": F.lit(False)})
        cols = front.columns
        levels, n = ([front] if low == 0 else []), 0
        while high is None or n < high:
            n += 1
            step = front.filter(~F.col("_closed")).join(e, F.col("_at") == F.col("_src"))
            seen = F.array_contains("_nodes", F.col("_dst"))
            if mode == "trail":
                step = step.filter(~F.array_contains("_rels", F.col("_eid")))
            elif mode == "acyclic":
                step = step.filter(~seen)
            elif mode == "simple":
                step = step.filter(~seen | (F.col("_nodes")[0] == F.col("_dst")))
            step = step.withColumns({"_at": F.col("_dst"), "_len": F.col("_len") + 1, "_nodes": F.concat("_nodes", F.array("_dst")), "_rels": F.concat("_rels", F.array("_eid")), "_closed": F.lit(mode == "simple") & (F.col("_nodes")[0] == F.col("_dst"))})
            front = step.select(*cols)
            if high is None or n > 3:
                front = written(front)
                if front.isEmpty():
                    break
            if n >= low:
                levels.append(front)
        out = reduce(DataFrame.union, levels) if levels else front.limit(0)
        out = out.withColumnRenamed("_at", f"{to}__key")
        if path:
            out = out.withColumns({f"{path}__length": F.col("_len"), f"{path}__nodes": F.col("_nodes"), f"{path}__rels": F.col("_rels")})
        return self._with(out.drop("_len", "_nodes", "_rels", "_closed"), labels={to: None})

    def path(self, name: str, nodes: list[str], edges: list[str]) -> "Pattern":
        """A path variable over a fixed chain: ``<name>__length``, ``__nodes`` (keys) and ``__rels`` (type and id)."""
        rels = F.array(*(F.concat_ws("|", f"{e}__type", F.col(f"{e}__eid").cast("string")) for e in edges))
        keys = F.array(*(F.col(f"{n}__key").cast("string") for n in nodes))
        return self._with(self.df.withColumns({f"{name}__length": F.lit(len(edges)), f"{name}__nodes": keys, f"{name}__rels": rels}))

    def ends(self, edge: str, start: str, end: str) -> "Pattern":
        """The nodes at an edge's ends, with their properties, as the variables ``start`` and ``end``."""
        t = self.graph.edges[self.df_type(edge)]
        source = self if f"{edge}__src" in self.df.columns else self.let(**{f"{edge}__src": F.col(f"{edge}__{t.src}")})
        both = source.let(**{f"{start}__key": F.col(f"{edge}__{t.src}"), f"{end}__key": F.col(f"{edge}__{t.dst}")})
        return both.node(start, t.src_label).node(end, t.dst_label)

    def df_type(self, edge: str) -> str:
        """The one type of an edge variable."""
        types = dict(self._edges).get(edge)
        if types is None or "|" in types:
            raise ValueError(f"{edge!r} has no single type")
        return types.strip()

    # -- looking at the plan

    def explain(self, mode: str = "formatted") -> str:
        """The plan as text; nothing runs."""
        return plan_text(self.df, mode)

    def profile(self) -> DataFrame:
        return profiled(self.df)

    # -- projections

    def with_(self, *items: Column, where: Column | None = None, order: list[Column] | None = None, skip: int = 0, limit: int | None = None, distinct: bool = False) -> "Pattern":
        """WITH: a scope barrier; items, then order, skip, limit, then where."""
        df = project(self.df, *items, distinct=distinct, order=order, skip=skip, limit=limit)
        return Pattern(self.graph, df.filter(where) if where is not None else df, (), None, {c.removesuffix("__key"): None for c in df.columns if c.endswith("__key")})

    def let(self, **values: Column) -> "Pattern":
        return self._with(self.df.withColumns(values))

    def unwind(self, values: Column, alias: str) -> "Pattern":
        """One row a list element; null and empty lists give none."""
        return self._with(self.df.withColumn(alias, F.explode(values)))

    def pipe(self, f: Callable[[DataFrame], DataFrame]) -> "Pattern":
        return self._with(f(self.df))

    def return_(self, *items: Column, by: list[Column] | None = None, distinct: bool = False, order: list[Column] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
        """RETURN. With ``by`` the items are aggregates grouped by it (an empty list: one row)."""
        if by is not None:
            df = self.df.groupBy(*by).agg(*items)
            return project(df, *(F.col(c) for c in df.columns), distinct=distinct, order=order, skip=skip, limit=limit)
        return project(self.df, *items, distinct=distinct, order=order, skip=skip, limit=limit)


def project(df: DataFrame, *items: Column, distinct: bool = False, order: list[Column] | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    if skip < 0 or (limit is not None and limit < 0):
        raise ValueError("skip and limit can't be negative")
    df = df.select(*items) if items else df
    if distinct:
        df = df.distinct()
    if order:
        df = df.orderBy(*order)
    if skip:
        df = df.offset(skip)
    return df.limit(limit) if limit is not None else df


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """EXPLAIN: Spark's plan of ``df`` (simple, extended, codegen, cost or formatted)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def profiled(df: DataFrame) -> DataFrame:
    """PROFILE: runs ``df`` and gives (step, depth, operator, rows), the executed plan's operators from the top; rows null where an operator counts none."""
    spark = df.sparkSession
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out: list[tuple] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        if name.endswith("QueryStage"):
            return walk(node.plan(), depth)
        if name not in ("InputAdapter",) and not name.startswith("WholeStageCodegen"):
            rows = node.metrics().get("numOutputRows")
            out.append((len(out), depth, name, rows.get().value() if rows.isDefined() else None))
            depth += 1
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i), depth)

    walk(execution.executedPlan(), 0)
    return spark.createDataFrame(out, "step int, depth int, operator string, rows long")


class Parameters:
    """Named values of a query: ``p("name")`` is the value as a column; a missing one is an error that names it."""

    def __init__(self, **values):
        self.values = values

    def __call__(self, name: str) -> Column:
        if name not in self.values:
            raise ValueError(f"no value for parameter ${name}; there are {sorted(self.values)}")
        value = self.values[name]
        return F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)


def mixed_order(*columns: tuple[str, Column]) -> list[Column]:
    """Sort keys that order values of several kinds in one column set: kinds in the order given (a kind is a name and
    its column, null where the value is of another kind), then within the kind; rows of no kind last."""
    kind = F.lit(len(columns))
    for i, (_, c) in reversed(list(enumerate(columns))):
        kind = F.when(c.isNotNull(), F.lit(i)).otherwise(kind)
    return [kind, *(c.asc_nulls_last() for _, c in columns)]


def asc(c: Column) -> Column:
    """Ascending; null counts as the greatest value."""
    return c.asc_nulls_last()


def desc(c: Column) -> Column:
    return c.desc_nulls_first()


def match(graph: Graph, var: str, label: str | None = None, where: Column | None = None) -> Pattern:
    return Pattern(graph).node(var, label, where)


def opened(graph: Graph, var: str) -> Pattern:
    """A sub-pattern that starts at the outer variable ``var``."""
    return Pattern(graph, start=var)
