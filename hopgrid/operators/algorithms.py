"""Iterative and search operators: reachability, shortest paths, PageRank, vector and full-text search.

Loops write each level to the shared folder; per-node minima and sums are pre-aggregated, and the
frontier is joined with the edges by key, so hubs split under adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import similarity
from ..graph import Graph
from .shared import written


def reachable(graph: Graph, types: str | None, starts: DataFrame, key: str, direction: str = "out", max_hops: int | None = None) -> DataFrame:
    """(source, node, depth): every node a start reaches, at its least depth; the start itself at 0."""
    e = graph.edge_rows(types, direction).select("_src", "_dst").distinct()
    found = front = written(starts.select(F.col(key).alias("source"), F.col(key).alias("node"), F.lit(0).alias("depth")).distinct())
    depth = 0
    while max_hops is None or depth < max_hops:
        depth += 1
        step = front.join(e, F.col("node") == F.col("_src")).select("source", F.col("_dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        front = written(step.join(found.select("source", "node"), ["source", "node"], "left_anti"))
        if front.isEmpty():
            break
        found = written(found.union(front)) if depth % 8 == 0 else found.union(front)
    return found


def shortest_paths(graph: Graph, types: str | None, starts: DataFrame, key: str, direction: str = "out", max_hops: int | None = None, every: bool = True) -> DataFrame:
    """(source, node, length, path): all shortest node paths, or one of each (``every=False``: the least)."""
    e = graph.edge_rows(types, direction).select("_src", "_dst").distinct()
    start = starts.select(F.col(key).alias("source")).distinct()
    front = written(start.select("source", F.col("source").alias("node"), F.lit(0).alias("length"), F.array("source").alias("path")))
    found, n = front, 0
    while max_hops is None or n < max_hops:
        n += 1
        step = front.join(e, F.col("node") == F.col("_src")).select("source", F.col("_dst").alias("node"), F.lit(n).alias("length"), F.concat("path", F.array("_dst")).alias("path"))
        step = step.join(found.select("source", "node").distinct(), ["source", "node"], "left_anti")
        if not every:
            step = step.groupBy("source", "node", "length").agg(F.min("path").alias("path"))
        front = written(step)
        if front.isEmpty():
            break
        found = written(found.union(front)) if n % 8 == 0 else found.union(front)
    return found


def page_rank(graph: Graph, label: str | None, types: str | None, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(key, rank), summing to 1: nodes without edges out share their rank among all."""
    nodes = written(graph.node_rows(label).select(F.col("_key").alias("key")))
    e = graph.edge_rows(types).select("_src", "_dst")
    e = written(e.join(e.groupBy("_src").agg(F.count("*").alias("out")), "_src"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    outs = e.select(F.col("_src").alias("key")).distinct()
    for _ in range(iterations):
        given = ranks.join(e, F.col("key") == F.col("_src")).groupBy(F.col("_dst").alias("key")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = ranks.join(outs, "key", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        ranks = written(nodes.join(given, "key", "left").select("key", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks


def vector_search(df: DataFrame, vector: str, query: list[float], k: int = 10, metric: str = "cosine", tie: str | None = None) -> DataFrame:
    """The k rows nearest to ``query`` with their ``score``: exact, one scan and a top-k without a full sort.

    Rows whose vector is null or of another length have no score and never appear.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = df.filter(F.size(vector) == len(query)).withColumn("score", similarity(F.col(vector), q, metric)).filter("score is not null")
    return scored.orderBy(F.desc("score"), *([tie] if tie else [])).limit(k)


def fulltext_search(df: DataFrame, key: str, fields: list[str], query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) by BM25 of the query's words in the fields; ``field:word`` looks in one field only.

    The texts are read once: their lengths and the words' counts are written, statistics and scores come from those.
    """
    words = [w.lower() for w in query.split()]
    if not words:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    tokens = lambda f: F.coalesce(F.regexp_extract_all(F.lower(F.col(f)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))
    split = df.select(key, *(tokens(f).alias(f"_k{i}") for i, f in enumerate(fields)))

    def times(word: str) -> Column:
        f, colon, term = word.partition(":")
        one_field = bool(colon) and f in fields
        looked = [f"_k{fields.index(f)}"] if one_field else [f"_k{i}" for i in range(len(fields))]
        return sum(F.size(k) - F.size(F.array_remove(k, term if one_field else word)) for k in looked)

    rows = split.select(key, sum(F.size(f"_k{i}") for i in range(len(fields))).alias("_n"), *(times(w).alias(f"_t{i}") for i, w in enumerate(words)))
    counts = written(rows)
    stats = counts.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *(F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(words))))
    some = counts.filter(" or ".join(f"_t{i} > 0" for i in range(len(words)))).crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        tf, d = F.col(f"_t{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_docs") - d + 0.5) / (d + 0.5))
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))

    score = sum((part(i) for i in range(1, len(words))), part(0))
    return some.select(key, score.alias("score")).filter("score > 0")


PROCEDURES: dict[str, Callable[..., DataFrame]] = {"subgraph_nodes": reachable, "shortest_paths": shortest_paths, "page_rank": page_rank}


def register_procedure(name: str, f: Callable[..., DataFrame]) -> None:
    PROCEDURES[name] = f


def call(name: str, *args, **kwargs) -> DataFrame:
    """CALL: a registered procedure's rows."""
    if name not in PROCEDURES:
        raise ValueError(f"no procedure {name!r}; there are {sorted(PROCEDURES)}")
    return PROCEDURES[name](*args, **kwargs)
