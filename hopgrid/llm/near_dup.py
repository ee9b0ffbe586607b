"""MinHash near-duplicates with an LSH forest, confirmed on full shingle sets.

1. One scan makes each text's shingle set (distinct runs of ``k`` words, 64-bit hashes), its
   128-bit set hash and ``TREES * DEPTH`` MinHash values. Equal sets fall into one class.
2. Each tree is a sorted order of signatures: tree t starts at value t * DEPTH and goes on through
   the following values. Documents that share the first DEPTH values form a region. All members of
   a small region are candidates of one another. In a larger one the depth adapts: in the deeper
   sorted order the nearest neighbours, those with the longest common prefix, are candidates, and
   so is the region's first member for all.
3. Links are confirmed on full sets in two rounds: each document's best candidate (most trees),
   then all candidates that still lie in different components.
4. What neighbours may miss in a large region is done exactly: members outside its largest
   component meet the members of other components with which they share one of their rarest shingles.
   Whatever order counts as rarest: of two sets as similar as asked, the n - ceil(share * n) + 1 rarest
   shingles of the larger and the m - ceil(2 * share / (1 + share) * m) + 1 rarest of the smaller have
   one in common, and after the first common one both have enough left to be as similar. Boilerplate,
   which many share, comes last in the order, so texts that share no more than that don't meet.

At a similarity of 0.8 a pair shares a region with probability 1 - (1 - 0.8^4)^24, more than
0.999996. A pair that shares one is never lost: no candidate list is cut without step 4.

Defined cases: null, empty or blank text has an empty set and no link; fewer than ``k`` words
make one shingle; repeated rows are one class; rows without doc_id join a component only by an
equal set, and have none if no other row has it; rows of one doc_id with other texts are linked
through that id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folders_so_far, hashed_words, materialize, mix64, open_fs, release_since, shared_dir, shingles

TREES = 24
DEPTH = 4
VALUES = TREES * DEPTH
SMALL = 8
NEIGHBOURS = 3
COUNTERS = 1 << 20
BROADCAST_IDS = 1_000_000
_A = (np.random.RandomState(7).randint(0, 1 << 31, VALUES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = np.random.RandomState(11).randint(0, 1 << 31, VALUES).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each lower-cased text."""
    h, n = shingles(*hashed_words(column), k)
    ends = np.cumsum(n)
    return [np.unique(h[e - m : e]) for e, m in zip(ends.tolist(), n.tolist())]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """VALUES MinHash values (uint32) of each set; all sets non-empty."""
    out = np.empty((len(sets), VALUES), np.uint32)
    at, sizes = 0, np.array([len(s) for s in sets])
    while at < len(sets):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 400_000, "right")))
        x = np.concatenate(sets[at:upto])
        x = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[at : upto - 1])]).astype(np.int64)
        for v in range(VALUES):
            y = x * _A[v] + _B[v]
            y ^= y >> np.uint32(15)
            out[at:upto, v] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), starts)
        at = upto
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sets = shingle_sets(batch.column("text"), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                cid: list = [b""] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full])):
                    sig[i], cid[i] = row.tobytes(), xxhash.xxh3_128_digest(sets[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cid, pa.binary()), pa.array(sig, pa.binary())],
                    names=["doc_id", "n_shingles", "cid", "sig"],
                )

    return run


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TREES rows a class: region (hash of tree and its first DEPTH values), deeper (the next four values' high halves)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.uint64)
        node = batch.column("node").to_numpy()
        region, deeper = (np.empty((len(sig), TREES), np.uint64) for _ in range(2))
        with np.errstate(over="ignore"):
            for t in range(TREES):
                h, d = np.full(len(sig), t + 1, np.uint64), np.zeros(len(sig), np.uint64)
                for i in range(DEPTH):
                    h = mix64(h * _P + sig[:, t * DEPTH + i])
                    d = (d << np.uint64(16)) | (sig[:, (t * DEPTH + DEPTH + i) % VALUES] >> np.uint64(16))
                region[:, t], deeper[:, t] = h, d
        yield pa.RecordBatch.from_arrays([pa.array(region.ravel().view(np.int64)), pa.array(deeper.ravel().view(np.int64)), pa.array(np.repeat(node, TREES))], names=["region", "deeper", "node"])


def _neighbours(width: int):
    """Pairs of each row with the next ``width`` rows of its region, in the order the rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r0, n0 = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            region, node = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((r0, "region"), (n0, "node")))
            a, b = [], []
            for s in range(1, width + 1):
                same = np.flatnonzero(region[s:] == region[:-s])
                same = same[same + s >= len(r0)]  # else given with the last batch
                a.append(node[same])
                b.append(node[same + s])
            a, b = np.concatenate(a), np.concatenate(b)
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep])], names=["a", "b"])
            r0, n0 = region[-width:], node[-width:]

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected component, by alternating large and small stars.

    Minima are pre-aggregated before each shuffle and every round is written, so a hub costs no
    single task and no long lineage.
    """
    mark = folders_so_far()
    e = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        sym = e.union(e.select("v", "u"))
        least = materialize(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-stars")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        new = materialize(small.filter("u <> v").distinct(), "small-stars")
        n, sources = new.count(), new.select("u").distinct().count()
        if n == sources and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            out = new.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            found = materialize(out.union(out.select("comp", "comp").distinct()), "components")
            release_since(links.sparkSession, mark, found)
            return found
        release_since(links.sparkSession, mark, new)
        e = new


def _crossing(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    c = comps.select("node", "comp")
    x = pairs.join(c.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(c.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    return x.filter(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))).select("a", "b")


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold a shingle of each of COUNTERS hash groups."""
    n = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for s in b.column("set"):
            n += np.bincount((np.frombuffer(s.as_buffer(), np.uint64) >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["k", "n"])


_ORDER: dict[str, np.ndarray] = {}


def _rarest(folder: str, name: str, percent: int):
    """The rarest shingles of each set and their places in the order, as many as two similar sets can't both be without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ORDER:
            _ORDER.clear()
            fs, root = open_fs(folder)
            with fs.open_input_file(f"{root}/{name}") as f:
                _ORDER[name] = np.frombuffer(f.read(), "<i8")
        counts = _ORDER[name]
        for b in batches:
            out, sizes = [], []
            for x in b.column("set"):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                rank = np.lexsort((s, counts[(s >> np.uint64(44)).astype(np.int64)]))
                out.append(s[rank[: len(s) + 1 - -(-percent * len(s) // 100)]])
                sizes.append(len(s))
            each = np.array([len(x) for x in out])
            repeat = lambda c: pa.array(np.repeat(c, each))
            places = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            rows = [pa.array(np.concatenate(out).view(np.int64)) if out else pa.array([], pa.int64()), *(repeat(b.column(c).to_numpy()) for c in ("node", "comp")), pa.array(np.repeat(b.column("outside").to_numpy(zero_copy_only=False), each)), repeat(np.array(sizes, np.int64)), pa.array(places)]
            yield pa.RecordBatch.from_arrays(rows, names=["shingle", "node", "comp", "outside", "n", "place"])

    return run


def _rest(big: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Exact links that neighbours may have missed in large regions; None if no region holds two components."""
    rows = big.join(comps, "node", "left").select("region", "node", F.coalesce("comp", "node").alias("comp"))
    per = rows.groupBy("region", "comp").agg(F.count("*").alias("n"))
    main = per.groupBy("region").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    main = materialize(main.select("region", F.col("top.comp").alias("main")), "mixed-regions")
    if main.isEmpty():
        return None
    members = rows.join(main, "region").groupBy("node", "comp").agg(F.max((F.col("comp") != F.col("main"))).alias("outside"))
    members = materialize(members.join(sets, "node"), "mixed-members")
    folder = shared_dir(big.sparkSession, "rarest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            n[b.column("k").to_numpy()] = b.column("n").to_numpy()
        fs, root = open_fs(folder)
        with fs.open_output_stream(f"{root}/counters", compression=None) as f:
            f.write(n.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(["counters"])], names=["file"])

    # COUNTERS rows at most go to one task.
    totals = members.select("set").mapInArrow(_counters, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    name = totals.repartition(1).mapInArrow(write, "file string").first()["file"]
    rare = materialize(members.mapInArrow(_rarest(folder, name, percent), "shingle long, node long, comp long, outside boolean, n long, place long"), "rarest")
    # The larger set (of equal ones that of the larger node) looks for the smaller.
    small = rare.filter(f"place < n + 1 - ceil({2 * percent} * n / {100 + percent})").select("shingle", "outside", *(F.col(c).alias(f"r_{c}") for c in ("node", "comp", "n", "place")))
    larger = (F.col("n") > F.col("r_n")) | ((F.col("n") == F.col("r_n")) & (F.col("node") > F.col("r_node")))
    left = F.least(F.col("n") - F.col("place"), F.col("r_n") - F.col("r_place"))  # in common at most, from this shingle on
    fits = (F.lit(100) * F.col("r_n") >= F.lit(percent) * F.col("n")) & (left * (100 + percent) >= F.lit(percent) * (F.col("n") + F.col("r_n")))
    meet = lambda a, b: a.drop("outside").join(b.drop("outside"), "shingle").filter((F.col("comp") != F.col("r_comp")) & larger & fits)
    met = meet(rare.filter("outside"), small).unionByName(meet(rare.filter("not outside"), small.filter("outside")))
    pairs = materialize(met.select(F.least("node", "r_node").alias("a"), F.greatest("node", "r_node").alias("b")).distinct(), "pairs-3")
    return confirmed(pairs, members.select("node", "set"), percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    mark = folders_so_far()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(texts.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, cid binary, sig binary"), "sketches")
    classes = materialize(sketch.filter("n_shingles > 0").groupBy("cid").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.count("*").alias("n")), "classes")
    regions = classes.filter("node is not null").select("node", "sig").mapInArrow(_regions, "region long, deeper long, node long")
    shared = materialize(regions.groupBy("region").agg(F.count("*").alias("size"), F.min("node").alias("first")).filter("size > 1"), "regions")
    members = materialize(regions.join(shared, "region"), "members")
    small = members.filter(F.col("size") <= SMALL).select("region", "node").repartition("region").sortWithinPartitions("region", "node")
    big = members.filter(F.col("size") > SMALL)
    ordered = big.select("region", "deeper", "node").repartitionByRange("region", "deeper", "node").sortWithinPartitions("region", "deeper", "node")
    stars = big.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = small.mapInArrow(_neighbours(SMALL - 1), "a long, b long").union(ordered.mapInArrow(_neighbours(NEIGHBOURS), "a long, b long")).union(stars)
    pairs = materialize(found.groupBy("a", "b").agg(F.count("*").alias("trees")), "candidates")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    wanted = materialize(wanted.select(F.col("node").alias("doc_id")), "set-nodes")
    # The texts needn't be shuffled while the wanted ids are few; beyond that they are.
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = materialize(texts.join(few, "doc_id", "left_semi").mapInArrow(full_sets, "node long, set binary").filter("length(set) > 0").distinct(), "sets")

    both = pairs.select("a", "b", "trees").union(pairs.select("b", "a", "trees"))
    best = both.groupBy("a").agg(F.max(F.struct("trees", (-F.col("b")).alias("b"))).alias("x")).select("a", (-F.col("x.b")).alias("b"))
    best = materialize(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best-pairs")
    links = materialize(confirmed(best, sets, percent), "links-1")
    comps = components(links)
    others = materialize(_crossing(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), comps), "pairs-2")
    more = materialize(confirmed(others, sets, percent), "links-2")
    if not more.isEmpty():
        links = links.union(more)
        comps = components(links)
    rest = _rest(big.select("region", "node"), comps, sets, percent)
    if rest is not None:
        rest = materialize(rest, "links-3")
        if not rest.isEmpty():
            comps = components(links.union(rest))

    # Only classes of several rows and linked nodes need a lookup; both tables are written, so a hot class is split.
    several = materialize(classes.filter("n > 1").select("cid", "node"), "copy-classes")
    release_since(docs.sparkSession, mark, sketch, several, comps)
    rows = sketch.select("doc_id", "n_shingles", "cid").join(several, "cid", "left").withColumn("node", F.coalesce("node", "doc_id"))
    rows = rows.select("doc_id", "n_shingles", "node").join(comps, "node", "left")
    rows = rows.withColumn("component_id", F.coalesce("comp", "node"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with its own columns.

    Repeated rows of a kept doc_id leave one row; of rows without doc_id one stays for each text that
    no row with a doc_id has.
    """
    mark = folders_so_far()
    kept = materialize(near_duplicates(docs, shingle, percent).filter("kept").select("doc_id").distinct(), "kept-ids")
    release_since(docs.sparkSession, mark, kept)
    out = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rest = materialize(docs.filter("doc_id is null").dropDuplicates(["text"]), "without-id")
    if rest.isEmpty():
        return out
    # Only texts whose hash a row without doc_id has are compared.
    known = docs.filter("doc_id is not null").select(F.xxhash64("text").alias("_h"), F.col("text").alias("_t"))
    known = known.join(rest.select(F.xxhash64("text").alias("_h")).distinct(), "_h", "left_semi").distinct()
    return out.unionByName(rest.join(known, (F.xxhash64("text") == F.col("_h")) & F.col("text").eqNullSafe(F.col("_t")), "left_anti"))
