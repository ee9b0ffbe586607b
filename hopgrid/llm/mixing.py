"""Mixing sources to target weights, with DataFrame functions only.

Each source's words are packed, in a fixed document order, into blocks of ``block`` words. A
source's target is turned into block slots: whole passes over its blocks, then part of one more
pass, whose last slot is cut so that the words taken equal the rounded target. Which sources the
slots of an output shard come from is drawn: a shard's source counts are multinomial given how many
slots each source has in all (a free draw could pass a source's cap), drawn without replacement by
one pseudorandom permutation of all slots. The counts are written; a source's shards then take its
slots in turn, and its slots are mapped to its blocks by a permutation of its own for each pass.
Blocks are joined with the documents by index: the mix is the pieces of documents that lie in the
blocks taken, shard by shard, in a drawn order within each.

Prefix sums have two levels (chunks or ranges, then their totals), so neither a source nor the list of
sources is gathered in one task. Everything depends on the rows and the seed only; reruns agree.

Defined cases: null text has size 0; null source is a source of its own, last in order; sizes 0
take 0; repeated rows are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, conf_int, materialize

BLOCK_WORDS = 256
SHARD_SLOTS = 1024
WEIGHTS = (3, 1, 2)
CHUNK_ROWS = 512
MOST_CHUNKS = 20_000
SLOT_RUN = 2048
SHARD_RUN = 1024
ROUNDS = 3
#: A word and the white space after it; the first word of a text also has that before it.
SPACED_WORD = r"(?:^[\x20\x09-\x0D]+)?" + WORD + r"[\x20\x09-\x0D]*"


def source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, skey, size in words, tie (hash of the text)."""
    return docs.select(
        "doc_id",
        source_key().alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("tie"),
    )


def _running(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` plus ``<value>_before``: the sum of each value over the rows before, in the order given.

    Ranges of the order are summed by themselves; only one row a range is ordered in one task.
    """
    n = conf_int(df.sparkSession, "spark.sql.shuffle.partitions", 200)
    placed = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values))
    base = sums.select("_part", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(base), "_part")  # one row a range
    return out.withColumns({f"{v}_before": F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).drop("_part", *(f"_{v}" for v in values))


def targets(sizes: DataFrame, ratio: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source_size, target.

    Targets are ``min(most * size, weight * level)`` with the level that shares ``ratio`` of all
    words: the fixed point of resharing the excess by weight.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    named = _running(per, [(F.col("skey") == "").asc(), F.col("skey").asc()], ["one"])
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.col("one_before").cast("int"), F.lit(len(weights))) + 1)
    named = named.select("skey", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("r", F.col("cap") / F.col("w"))
    per = materialize(_running(named, [F.col("r").asc(), F.col("skey").asc()], ["cap", "w"]), "mix-levels")
    whole = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    own = (F.lit(whole["words"] * float(ratio)) - F.col("cap_before")) / (F.lit(float(whole["w"])) - F.col("w_before"))
    per = per.withColumn("own", own).withColumn("full", F.col("r") <= F.col("own"))
    found = per.filter(~F.col("full")).agg(F.min(F.struct("r", "skey", "own")).alias("x")).first()["x"]  # one row
    level = F.lit(found["own"] if found else 0.0)
    return per.select("skey", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def _stirred(x: Column, a: Column, b: Column, keys: list[Column], salt: str) -> Column:
    """One pass of an alternating Feistel bijection on [0, a*b); larger values stay."""

    def half(at: Column, k: Column) -> Column:
        move = lambda own, other, m: F.pmod(own + F.pmod(F.xxhash64(F.lit(salt), k, other, *keys), m), m)
        left = F.when(k % 2 == 0, move(at["l"], at["r"], a)).otherwise(at["l"])
        right = F.when(k % 2 == 1, move(at["r"], at["l"], b)).otherwise(at["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    first = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))
    inside = F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), first, half, lambda at: at["l"] * b + at["r"])
    return F.when(x < a * b, inside).otherwise(x)


def permuted(df: DataFrame, index: str, n: str, keys: list[str], out: str, seed: str) -> DataFrame:
    """Add ``out``: a pseudorandom permutation of [0, n) at ``index``, another one for each value of ``keys``.

    With a = floor(sqrt n) and b = n div a, a Feistel bijection covers the first a*b places; a
    rotation by half and a second pass reach the few others. Values outside [0, n) stay.
    """
    cols = [F.col(k) for k in keys]
    df = df.withColumn("_a", F.greatest(F.lit(1), F.floor(F.sqrt(F.col(n).cast("double")))).cast("long"))
    df = df.withColumn("_b", F.greatest(F.lit(1).cast("long"), F.expr(f"{n} div _a")))
    df = df.withColumn(out, _stirred(F.col(index), F.col("_a"), F.col("_b"), cols, f"{seed}1"))
    df = df.withColumn(out, F.when(F.col(out) < F.col(n), F.pmod(F.col(out) + F.expr(f"{n} div 2"), F.greatest(F.col(n), F.lit(1)))).otherwise(F.col(out)))
    return df.withColumn(out, _stirred(F.col(out), F.col("_a"), F.col("_b"), cols, f"{seed}2")).drop("_a", "_b")


def wanted(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Sources with a target, and their passes, blocks and slots."""
    s = sources.withColumn("take", F.round("target").cast("long")).filter("take > 0")
    s = s.withColumns({"passes": F.expr("take div source_size"), "rem": F.expr("take % source_size"), "n_full": F.expr(f"source_size div {block}"), "tail": F.col("source_size") % block})
    s = s.withColumn("n_blocks", F.col("n_full") + (F.col("tail") > 0).cast("long"))
    return s.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.expr(f"rem div {block}") + (F.col("rem") % block > 0).cast("long"))


def drawn(sources: DataFrame, seed: str = "mix") -> DataFrame:
    """The draw: (skey, shard, n), how many slots of a shard come from a source. ``sources`` as ``wanted`` gives them.

    Every slot has a ticket, its place in a permutation of all slots; tickets are dealt to shards in order.
    """
    s = _running(sources.select("skey", "n_slots"), [F.col("skey").asc()], ["n_slots"])
    every = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    s = s.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {SLOT_RUN}"))))
    tasks = conf_int(sources.sparkSession, "spark.sql.shuffle.partitions", 200)
    s = s.repartition(tasks, "skey", "run").withColumn("t", F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least(F.col("n_slots"), (F.col("run") + 1) * SLOT_RUN) - 1)))
    s = permuted(s.select("skey", (F.col("n_slots_before") + F.col("t")).cast("long").alias("ticket"), F.lit(every).cast("long").alias("every")), "ticket", "every", [], "place", f"{seed}-place")
    return s.groupBy("skey", F.expr(f"place div {SHARD_SLOTS}").alias("shard")).agg(F.count("*").alias("n"))


def slots(sources: DataFrame, block: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """One row per output slot: skey, pass, block_no, words (from the block's start), whole, shard, position."""
    b, s = F.lit(block), materialize(wanted(sources, block), "mix-wanted")
    draw = materialize(drawn(s, seed), "mix-draw").withColumn("chunk", F.expr(f"shard div {SHARD_RUN}"))
    # A source's shards take its slots in turn: sums before, by chunks of shards and within them.
    before = lambda *by: Window.partitionBy("skey", *by).orderBy("shard" if by else "chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = draw.groupBy("skey", "chunk").agg(F.sum("n").alias("sum")).withColumn("base", F.coalesce(F.sum("sum").over(before()), F.lit(0))).drop("sum")
    turn = draw.withColumn("inner", F.coalesce(F.sum("n").over(before("chunk")), F.lit(0))).join(chunks, ["skey", "chunk"]).withColumn("first", F.col("base") + F.col("inner"))
    s = turn.select("skey", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("t")).join(s, "skey")
    s = s.withColumns({"pass": F.expr("t div n_blocks"), "j": F.col("t") % F.col("n_blocks")})
    s = permuted(s, "j", "n_full", ["skey", "pass"], "block_no", f"{seed}-block")
    room = F.when(F.col("block_no") < F.col("n_full"), b).otherwise(F.col("tail"))
    words = F.when(F.col("pass") < F.col("passes"), room).otherwise(F.least(room, F.col("rem") - F.col("j") * b))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(f"{seed}-order"), "skey", "t"), "skey", "t")  # SHARD_SLOTS rows
    s = s.withColumns({"words": words, "position": (F.row_number().over(order) - 1).cast("long")})
    return s.select("skey", F.col("pass"), "block_no", "words", (F.col("words") == room).alias("whole"), "shard", "position")


def packed(sizes: DataFrame) -> DataFrame:
    """``sizes`` plus ``start``: the place of the document's first word among its source's words."""
    n = sizes.count()
    chunks = max(1, min(MOST_CHUNKS, -(-n // CHUNK_ROWS)))
    rows = sizes.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)).cast("int")).repartition("chunk")
    inside = Window.partitionBy("chunk", "skey").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    before = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy("skey", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.sum("size").alias("n"))
    base = sums.select("skey", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, ["skey", "chunk"]).withColumn("start", F.col("base") + F.col("inner")).drop("chunk", "inner", "base")


def chosen(placed: DataFrame, slots_: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The words of ``placed`` that the slots take: skey, start, block_no, pass, lo, hi, shard, position.

    One row per document, block and slot: words lo to hi (of the document, from 0, hi left out), and
    the slot's place in the output. Pieces of one slot follow each other by start.
    """
    rows = placed.filter("size > 0").select("skey", "start", "size").withColumn("block_no", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    # One row a block: it grows with the words, and its estimate (from a row a source) would have it broadcast.
    joined = rows.join(slots_.hint("merge"), ["skey", "block_no"])
    first = F.col("block_no") * block - F.col("start")
    joined = joined.withColumns({"lo": F.greatest(first, F.lit(0)), "hi": F.least(F.col("size"), first + F.col("words"))}).filter("lo < hi")
    return joined.select("skey", "start", "block_no", "pass", "lo", "hi", "shard", "position")


def by_shard(pieces: DataFrame) -> DataFrame:
    """Each shard whole in one task, in order."""
    return pieces.repartition("shard").sortWithinPartitions("shard", "position", "start")


def _mix(docs: DataFrame, block: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents at their places, sources with targets, and the mix: the pieces taken, written shard by shard in order."""
    sizes = materialize(sized(docs), "mix-sizes")
    sources = materialize(targets(sizes), "mix-targets")
    placed = materialize(packed(sizes), "mix-places")
    return placed, sources, materialize(by_shard(chosen(placed, slots(sources, block, seed), block)), "mix-pieces")


def mixed(docs: DataFrame, block: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, tie, skey, size, source_size, target, taken, and its first place in the mix: shard, position."""
    placed, sources, pieces = _mix(docs, block, seed)
    sums = pieces.groupBy("skey", "start").agg(F.sum(F.col("hi") - F.col("lo")).cast("long").alias("taken"), F.min(F.struct("shard", "position")).alias("first"))
    taken = placed.filter("size > 0").join(sums.hint("merge"), ["skey", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    rows = taken.unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")), allowMissingColumns=True)
    return rows.join(sources, "skey").select("doc_id", "tie", "skey", "size", "source_size", "target", "taken", "first.shard", "first.position")


def mix_report(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "shard", "position")


def mix_documents(docs: DataFrame, block: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """The pieces that the mix takes, each a row with the columns of its document.

    A piece is the part of one document in one block, once for each slot of the block. Its text is
    cut from the document's as it stands: a word goes with the white space after it, the first one
    also with that before it. Rows equal in doc_id, source and text are numbered. The rows come
    shard by shard, in the order of the mix.
    """
    cols = docs.columns
    key = ["_i", "_s", "_t"]
    id_ = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    number = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(by))
    placed, _, pieces = _mix(docs, block, seed)
    lists = pieces.groupBy("skey", "start").agg(F.collect_list(F.struct("lo", "hi", "shard", "position")).alias("_pieces"))
    owners = placed.filter("size > 0").select(id_("doc_id").alias("_i"), F.col("skey").alias("_s"), F.col("tie").alias("_t"), "start").withColumn("_c", number("start"))
    owned = owners.join(lists.hint("merge"), (F.col("_s") == F.col("skey")) & (owners["start"] == lists["start"])).select(*key, "_c", owners["start"].alias("_start"), "_pieces")
    keyed = docs.withColumns({"_i": id_("doc_id"), "_s": source_key(), "_t": F.xxhash64("text")}).withColumn("_c", number(F.xxhash64(*cols)))
    joined = keyed.join(owned.hint("merge"), [*key, "_c"])
    text = lambda words, x: F.array_join(F.slice(words, x["lo"].cast("int") + 1, (x["hi"] - x["lo"]).cast("int")), "")
    cut = lambda words: F.transform("_pieces", lambda x: F.struct(x["shard"].alias("shard"), x["position"].alias("position"), text(words, x).alias("text")))
    # The words are an element here so that they are found once a document, not once a piece.
    texts = F.transform(F.array(F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0))), cut)[0]
    rows = joined.select(*(F.col(c).alias(f"_d{n}") for n, c in enumerate(cols) if c != "text"), F.col("_start").alias("start"), F.explode(texts).alias("_p"))
    rows = by_shard(rows.withColumns({"shard": F.col("_p.shard"), "position": F.col("_p.position")}))
    return rows.select(*(F.col("_p.text").alias(c) if c == "text" else F.col(f"_d{n}").alias(c) for n, c in enumerate(cols)))
