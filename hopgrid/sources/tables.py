"""Reading into graphs and handing results on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Edges, Graph, Nodes
from ..operators.mutate import create_edges, create_nodes, merge_nodes


def load_csv(spark: SparkSession, path: str, with_headers: bool = True, alias: str = "row", separator: str = ",") -> DataFrame:
    """LOAD CSV: one column, a map with headers, else a list; all values are strings."""
    df = spark.read.option("header", with_headers).option("inferSchema", False).option("sep", separator).csv(path)
    if with_headers:
        pairs = [x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))]
        return df.select(F.create_map(*pairs).alias(alias))
    return df.select(F.array(*df.columns).alias(alias))


def read_rows(spark: SparkSession, paths: str | list[str], form: str = "parquet", schema: str | None = None) -> DataFrame:
    """Parquet or CSV from paths, globs or lists of them on any file system Spark reads."""
    paths = [paths] if isinstance(paths, str) else paths
    r = spark.read if schema is None else spark.read.schema(schema)
    if form == "parquet":
        return r.parquet(*paths)
    if form == "csv":
        return r.csv(paths, header=True, inferSchema=schema is None)
    if form == "json":
        return r.json(paths)
    raise ValueError(f"no format {form!r}; there are parquet, csv and json")


def ingest_nodes(g: Graph, label: str, rows: DataFrame, mode: str = "create", rename: dict[str, str] | None = None) -> Graph:
    """Load rows into a label's table, creating or (``upsert``) merging by key; columns may be renamed first."""
    rows = rows.withColumnsRenamed(rename) if rename else rows
    if mode == "create":
        return create_nodes(g, label, rows)
    if mode == "upsert":
        return merge_nodes(g, label, rows)[0]
    raise ValueError(f"no mode {mode!r}; there are create and upsert")


def ingest_edges(g: Graph, type_: str, rows: DataFrame, src: str, dst: str) -> Graph:
    """Load edges between existing nodes."""
    return create_edges(g, type_, rows, src, dst)


def declare_nodes(g: Graph, label: str, df: DataFrame, key: str) -> Graph:
    return g.with_nodes(Nodes(label, df, key))


def declare_edges(g: Graph, type_: str, df: DataFrame, src: str, dst: str, key: tuple[str, ...] = (), src_label: str | None = None, dst_label: str | None = None) -> Graph:
    return g.with_edges(Edges(type_, df, src, dst, key, src_label, dst_label))


def nodes_from_rows(rows: DataFrame, var: str, key: str, label: str) -> Nodes:
    """A node table from result rows: the distinct values of the columns ``<var>__*``; ``key`` is one of them."""
    head = f"{var}__"
    columns = [c for c in rows.columns if c.startswith(head) and c.removeprefix(head) not in ("key", "labels")]
    return Nodes(label, rows.select(*(F.col(c).alias(c.removeprefix(head)) for c in columns)).distinct(), key)


def edges_from_rows(rows: DataFrame, source: str, target: str, type_: str, src_label: str | None = None, dst_label: str | None = None) -> Edges:
    """An edge table from result rows: the distinct pairs of two variables' keys."""
    pairs = rows.select(F.col(f"{source}__key").alias("src"), F.col(f"{target}__key").alias("dst")).filter("src is not null and dst is not null").distinct()
    return Edges(type_, pairs, "src", "dst", (), src_label, dst_label)


def from_frame(spark: SparkSession, data, schema=None) -> DataFrame:
    """pandas, Arrow or rows of dicts; NaN of pandas objects becomes null through Arrow."""
    return spark.createDataFrame(data, schema) if schema is not None else spark.createDataFrame(data)


def synthetic_nodes(spark: SparkSession, n: int) -> DataFrame:
    """id, label, name, age, score, active by rule."""
    i = F.col("id")
    return spark.range(n).select(i, F.lit("Person").alias("label"), F.concat(F.lit("Person_"), i).alias("name"), (20 + i % 60).alias("age"), (75.5 + i % 25).alias("score"), (i % 2 == 0).alias("active"))


def join_relational(graph_rows: DataFrame, relational: DataFrame, graph_key: str, key: str) -> DataFrame:
    """Pattern rows with a relational table, inner on a key; Catalyst picks which side leads."""
    return graph_rows.join(relational, graph_rows[graph_key] == relational[key])


_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(scheme: str, f: Callable[..., DataFrame]) -> None:
    """Make ``read_uri("scheme://...")`` call ``f(spark, uri)``."""
    _SOURCES[scheme] = f


def read_uri(spark: SparkSession, uri: str) -> DataFrame:
    scheme = uri.partition("://")[0]
    if scheme not in _SOURCES:
        raise ValueError(f"no source for {scheme!r}; registered: {sorted(_SOURCES)}")
    return _SOURCES[scheme](spark, uri)


def jdbc_rows(spark: SparkSession, url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A relational table through Spark's JDBC reader, split by (column, low, high, parts)."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, parts = partition
        r = r.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return r.load()


# -- results


def iter_batches(df: DataFrame, size: int = 10_000) -> Iterator[list[dict]]:
    """Result rows in lists of at most ``size``, one partition at a time on the driver."""
    batch: list[dict] = []
    for row in df.toLocalIterator():
        batch.append(row.asDict(recursive=True))
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def to_networkx(edges: DataFrame, src: str, dst: str, directed: bool = True):
    """A driver-side multigraph of a result that fits there (needs networkx)."""
    import networkx as nx

    g = nx.MultiDiGraph() if directed else nx.MultiGraph()
    for row in edges.toLocalIterator():
        d = row.asDict(recursive=True)
        g.add_edge(d.pop(src), d.pop(dst), **d)
    return g
