"""Changes as new graphs: create, merge, set, remove, delete and bulk loads, by joins on keys.

Nothing is updated in place: each function gives a graph (and the change's counters where they
exist, as a one-row DataFrame that costs a job only when it is read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Edges, Graph, Nodes


def create_nodes(g: Graph, label: str, rows: DataFrame) -> Graph:
    """Append rows; absent properties are null."""
    t = g.nodes[label]
    return g.with_nodes(t.with_df(t.df.unionByName(rows, allowMissingColumns=True)))


def create_edges(g: Graph, type_: str, rows: DataFrame, src: str, dst: str, unbound: str = "drop") -> Graph:
    """Append edges between existing nodes (``src``, ``dst``: columns of ``rows`` that hold the end keys).

    A row with an end that doesn't exist vanishes, or with ``unbound="refuse"`` ends the job with an error.
    """
    t = g.edges[type_]
    for label, column in ((t.src_label, src), (t.dst_label, dst)):
        if label:
            ends = g.nodes[label].df.select(F.col(g.nodes[label].key).alias(column)).distinct()
            if unbound == "refuse":
                known = rows.join(ends.withColumn("_known", F.lit(True)), column, "left")
                missing = F.raise_error(F.concat(F.lit(f"{type_}: no {label} "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast(rows.schema[column].dataType)
                rows = known.withColumn(column, F.when(F.col("_known"), F.col(column)).otherwise(missing)).drop("_known")
            else:
                rows = rows.join(ends, column, "left_semi")
    rows = rows.withColumnsRenamed({src: t.src, dst: t.dst})
    return g.with_edges(t.with_df(t.df.unionByName(rows, allowMissingColumns=True)))


def _one_row(rows: DataFrame, on: list[str], given: list[str]) -> DataFrame:
    """One row a key, the same each time: of several the one with the least given values."""
    if not given:
        return rows.select(*on).distinct()
    return rows.groupBy(*on).agg(F.min(F.struct(*given)).alias("_row")).select(*on, *(F.col("_row").getField(c).alias(c) for c in given))


def _merged(old: DataFrame, rows: DataFrame, on: list[str], on_create: dict[str, Column] | None, on_match: dict[str, Column] | None, defaulted: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[str]]:
    """The merged rows, the joined rows with ``_had`` and ``_given`` set, and the given columns."""
    given = [c for c in rows.columns if c not in on]
    new = _one_row(rows, on, given).select(*on, F.lit(True).alias("_given"), *(F.col(c).alias(f"_new_{c}") for c in given))
    both = old.withColumn("_had", F.lit(True)).join(new, on, "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_had", "_given")})
    had, is_given = F.col("_had"), F.col("_given")
    out = []
    for c in dict.fromkeys([*old.columns, *given, *(on_create or {}), *(on_match or {})]):
        if c in on:
            out.append(F.col(c))
            continue
        value = F.col(c) if c in old.columns else F.lit(None)
        if c in given:
            value = F.when(is_given & ~had if c in defaulted else is_given, F.col(f"_new_{c}")).otherwise(value)
        if on_create and c in on_create:
            value = F.when(is_given & ~had, on_create[c]).otherwise(value)
        if on_match and c in on_match:
            value = F.when(is_given & had, on_match[c]).otherwise(value)
        out.append(value.alias(c))
    return both.select(*out), both, given


def merge_nodes(g: Graph, label: str, rows: DataFrame, on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None, defaulted: tuple[str, ...] = ()) -> tuple[Graph, DataFrame]:
    """Upsert by key. A given column overwrites (an explicit null clears), a ``defaulted`` one counts for new nodes
    only, an absent one is preserved. ``on_create`` and ``on_match`` then set their own values, of new properties
    too. Null keys are refused; of several rows with one key the one with the least values counts.

    One full outer join on the key; counters: nodes_created, nodes_matched, properties_set.
    """
    t = g.nodes[label]
    rows = rows.withColumn(t.key, F.when(F.col(t.key).isNotNull(), F.col(t.key)).otherwise(F.raise_error(F.lit(f"merge of {label}: null key")).cast(rows.schema[t.key].dataType)))
    merged, both, given = _merged(t.df, rows, [t.key], on_create, on_match, defaulted)
    sets = len([c for c in given if c not in defaulted])
    had, is_given = F.col("_had"), F.col("_given")
    counters = both.agg(
        F.count_if(is_given & ~had).alias("nodes_created"), F.count_if(is_given & had).alias("nodes_matched"),
        (F.count_if(is_given & ~had) * (len(given) + len(on_create or {})) + F.count_if(is_given & had) * (sets + len(on_match or {}))).alias("properties_set"),
    )
    return g.with_nodes(t.with_df(merged)), counters


def merge_edges(g: Graph, type_: str, rows: DataFrame, keys: tuple[str, ...] = (), on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> Graph:
    """Upsert on (source, target, ``keys``): a matched edge takes the given properties, a new one is created;
    ``on_create`` and ``on_match`` then set their own."""
    t = g.edges[type_]
    return g.with_edges(t.with_df(_merged(t.df, rows, [t.src, t.dst, *keys], on_create, on_match, ())[0]))


def set_properties(g: Graph, label: str, where: Column, **values: Column) -> Graph:
    """SET on the nodes that satisfy ``where``."""
    t = g.nodes[label]
    return g.with_nodes(t.with_df(t.df.withColumns({c: F.when(where, v).otherwise(F.col(c) if c in t.df.columns else F.lit(None)) for c, v in values.items()})))


def remove_property(g: Graph, label: str, *names: str, where: Column | None = None) -> Graph:
    t = g.nodes[label]
    where = F.lit(True) if where is None else where
    return g.with_nodes(t.with_df(t.df.withColumns({c: F.when(~F.coalesce(where, F.lit(False)), F.col(c)) for c in names})))


def remove_label(g: Graph, label: str, extra: str, where: Column | None = None) -> Graph:
    """REMOVE of a further label: from the table, or for the rows that satisfy ``where``, which move to a table without it."""
    t = g.nodes[label]
    if extra not in t.extra_labels:
        raise ValueError(f"{label} has no further label {extra!r}; there are {sorted(t.extra_labels)}")
    rest = tuple(x for x in t.extra_labels if x != extra)
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    if where is None:
        return g.with_nodes(Nodes(label, t.df, t.key, rest))
    # A second table of the same label: its name in the graph says which label it lacks.
    apart = Nodes(f"{label} without {extra}", t.df.filter(hit), t.key, (label, *rest))
    return g.with_nodes(t.with_df(t.df.filter(~hit)), apart)


def _touching(g: Graph, label: str) -> list[tuple[Edges, str]]:
    return [(t, c) for t in g.edges.values() for lab, c in ((t.src_label, t.src), (t.dst_label, t.dst)) if lab in (None, label)]


def delete_nodes(g: Graph, label: str, keys: DataFrame, detach: bool = False) -> Graph:
    """Delete nodes by key; without ``detach`` a connected one is an error (found by one job per edge table)."""
    t = g.nodes[label]
    keys = keys.select(F.col(keys.columns[0]).alias("_k")).distinct()
    for e, column in _touching(g, label):
        current = g.edges[e.type]
        hit = current.df.join(keys, current.df[column] == F.col("_k"), "left_semi")
        if detach:
            g = g.with_edges(current.with_df(current.df.join(keys, current.df[column] == F.col("_k"), "left_anti")))
        elif not hit.isEmpty():
            raise ValueError(f"{label} nodes still have {e.type} edges; detach them")
    return g.with_nodes(t.with_df(t.df.join(keys, t.df[t.key] == F.col("_k"), "left_anti")))


def delete_edges(g: Graph, type_: str, where: Column) -> Graph:
    t = g.edges[type_]
    return g.with_edges(t.with_df(t.df.filter(~F.coalesce(where, F.lit(False)))))


def counters(before: Graph, after: Graph) -> dict[str, int]:
    """Rows created and deleted, by anti-joins on the keys of each changed table."""
    out = {"nodes_created": 0, "nodes_deleted": 0, "relationships_created": 0, "relationships_deleted": 0}

    def only(a: DataFrame | None, b: DataFrame | None, key: list[str]) -> int:
        """Rows of ``a`` whose key ``b`` hasn't (counted by their number where keys repeat)."""
        if a is None:
            return 0
        per = lambda df, n: df.groupBy(*key).agg(F.count("*").alias(n))
        mine = per(a, "_a")
        if b is None:
            return mine.agg(F.coalesce(F.sum("_a"), F.lit(0))).first()[0]
        theirs = per(b, "_b").withColumnsRenamed({k: f"_b_{k}" for k in key})
        same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in key]
        return mine.join(theirs, same, "left").agg(F.coalesce(F.sum(F.greatest(F.col("_a") - F.coalesce("_b", F.lit(0)), F.lit(0))), F.lit(0))).first()[0]

    for kind, a, b in (("nodes", before.nodes, after.nodes), ("relationships", before.edges, after.edges)):
        for name in {**a, **b}:
            x, y = a.get(name), b.get(name)
            if x is y or x and y and x._df is y._df:
                continue
            t = x or y
            key = [t.key] if kind == "nodes" else list(t.key or (t.src, t.dst))
            old, new = x and x.df, y and y.df
            out[f"{kind}_created"] += only(new, old, key)
            out[f"{kind}_deleted"] += only(old, new, key)
    return out
