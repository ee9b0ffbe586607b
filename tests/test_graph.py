import datetime

import pytest
from pyspark.sql import functions as F

from hopgrid.functions import scalar as fn
from hopgrid.graph import Edges, Graph, Nodes, graph_from_tables, label_test, prop
from hopgrid.operators import algorithms, mutate
from hopgrid.operators.pattern import match, opened
from hopgrid.schema import EdgeModel, Field, NodeModel, Registry, violations
from hopgrid.sources.tables import iter_batches, load_csv, read_rows


@pytest.fixture(scope="module")
def chain(spark):
    person = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (3, "Cid"), (4, "Dave")], "id long, name string")
    knows = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    return Graph("social_net").with_nodes(Nodes("Person", person, "id")).with_edges(Edges("knows", knows, "src", "dst", (), "Person", "Person"))


def names(df, c="name"):
    return sorted(r[c] for r in df.collect())


def test_variable_length_from_one(chain):
    p = match(chain, "a", "Person", F.col("a__name") == "Ann").hops("knows", "b", 1, 3).node("b", "Person")
    assert names(p.return_(F.col("b__name").alias("name"))) == ["Bob", "Cid", "Dave"]


def test_zero_length_binds_the_start(chain):
    p = match(chain, "a", "Person").hops("knows", "b", 0, 0)
    assert p.df.filter("a__key = b__key").count() == 4 == p.df.count()


def test_bounds_and_modes_are_checked(chain):
    for args in ({"low": 3, "high": 1}, {"mode": "jump"}, {"mode": "walk", "high": None}):
        with pytest.raises(ValueError):
            match(chain, "a", "Person").hops("knows", "b", **args)


def test_both_stored_directions_are_two_edges(spark):
    p = spark.createDataFrame([(1,), (2,)], "id long")
    k = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    g = Graph("g").with_nodes(Nodes("P", p, "id")).with_edges(Edges("K", k, "src", "dst"))
    assert match(g, "a", "P", F.col("a__key") == 1).edge("K", "b").df.count() == 2


def test_fraud_ring(spark):
    acc = spark.createDataFrame([(i,) for i in range(4)], "id long")
    sent = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    g = Graph("fraud").with_nodes(Nodes("Account", acc, "id")).with_edges(Edges("SENT", sent, "src", "dst"))
    ring = match(g, "a", "Account").to("SENT", "b").to("SENT", "c").to("SENT", "a", src="c")
    assert ring.df.count() == 3 and ring.df.filter("a__key = 0").count() == 1


def test_optional_keeps_null_starts(chain):
    p = match(chain, "a", "Person").optional(opened(chain, "a").to("knows", "b")).optional(opened(chain, "b").to("knows", "c"))
    got = {(r["a__key"], r["b__key"], r["c__key"]) for r in p.df.collect()}
    assert got == {(1, 2, 3), (2, 3, 4), (3, 4, None), (4, None, None)}


def test_label_expressions():
    assert label_test("A|B", {"B"}) and label_test("A&!B", {"A"}) and not label_test("A&!B", {"A", "B"})
    assert label_test("A|B&C", {"A"}) and label_test("(A|B)&!(C|D)", {"B"}) and not label_test("(A|B)&!(C|D)", {"B", "D"}) and label_test("odd label", {"odd label"}) and not label_test("A &", {"A"})
    assert label_test("%", set()) and label_test("!(A|B)", {"C"}) and label_test("A AND NOT B", {"A"})


def test_unknown_names_are_errors(chain):
    with pytest.raises(ValueError, match="no label"):
        match(chain, "a", "Nobody")
    with pytest.raises(ValueError, match="no relationship"):
        match(chain, "a", "Person").to("LIKES", "b")
    with pytest.raises(ValueError):
        Graph("not a name")


def test_shortest_paths_and_reach(chain):
    p = algorithms.shortest_paths(chain, "knows", chain.nodes["Person"].df.filter("id = 1"), "id")
    assert {(r["node"], r["length"]) for r in p.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert algorithms.reachable(chain, "knows", chain.nodes["Person"].df.filter("id = 1"), "id", max_hops=2).count() == 3
    with pytest.raises(ValueError, match="no procedure"):
        algorithms.call("nothing")


def test_plain_delete_of_a_connected_node_fails(chain, spark):
    with pytest.raises(ValueError, match="detach"):
        mutate.delete_nodes(chain, "Person", spark.createDataFrame([(2,)], "id long"))
    g = mutate.delete_nodes(chain, "Person", spark.createDataFrame([(2,)], "id long"), detach=True)
    assert g.nodes["Person"].df.count() == 3 and g.edges["knows"].df.count() == 1
    assert mutate.counters(chain, g) == {"nodes_created": 0, "nodes_deleted": 1, "relationships_created": 0, "relationships_deleted": 2}


def test_merge_defaults_nulls_and_null_keys(chain, spark):
    rows = spark.createDataFrame([(1, None, "x"), (9, "Zoe", "y")], "id long, name string, tag string")
    g, counters = mutate.merge_nodes(chain, "Person", rows, defaulted=("tag",))
    got = {r["id"]: (r["name"], r["tag"]) for r in g.nodes["Person"].df.collect()}
    assert got[1] == (None, None) and got[2] == ("Bob", None) and got[9] == ("Zoe", "y")
    assert counters.first().asDict() == {"nodes_created": 1, "nodes_matched": 1, "properties_set": 3}
    with pytest.raises(Exception, match="null key"):
        mutate.merge_nodes(chain, "Person", spark.createDataFrame([(None, "q")], "id long, name string"))[0].nodes["Person"].df.collect()


def test_merge_edges(chain, spark):
    rows = spark.createDataFrame([(1, 2, 5), (4, 1, 6)], "src long, dst long, w int")
    got = {(r["src"], r["dst"]): r["w"] for r in mutate.merge_edges(chain, "knows", rows).edges["knows"].df.collect()}
    assert got == {(1, 2): 5, (2, 3): None, (3, 4): None, (4, 1): 6}


def test_graph_from_tables(spark):
    t = {"a": spark.createDataFrame([(1, 2)], "id int, b int"), "b": spark.createDataFrame([(2,)], "id int"), "ab": spark.createDataFrame([(1, 2, 3)], "a int, b int, w int")}
    g = graph_from_tables("g", t, {"a": "id", "b": "id"}, {"a": [("b", "b")], "ab": [("a", "a"), ("b", "b")]})
    assert set(g.nodes) == {"a", "b"} and set(g.edges) == {"HAS_A", "AB"}
    assert match(g, "x", "a").to("AB", "y", "b").df.count() == 1
    assert match(g, "y", "b").to("HAS_A", "x", "a").df.select("y__key", "x__key").first() == (2, 1)


def test_functions_with_nulls_and_edges(spark):
    x = spark.createDataFrame([([1, 2], None, "P1Y2M10DT2H30M"), ([], 7, "nonsense"), (None, 7, None)], "l array<int>, n int, d string")
    r = x.select(
        fn.head(F.col("l")).alias("h"), fn.last(F.col("l")).alias("t"), fn.tail(F.col("l")).alias("r"), fn.size(F.col("l")).alias("s"),
        fn.range_list(5, 1).alias("e"), fn.range_list(5, 1, -2).alias("down"), fn.duration_seconds(F.col("d")).alias("d"), fn.in_list(F.col("n"), F.col("l")).alias("i"),
    ).collect()
    assert (r[0]["h"], r[0]["t"], r[0]["r"], r[0]["s"], r[0]["e"], r[0]["down"]) == (1, 2, [2], 2, [], [5, 3, 1])
    assert (r[1]["h"], r[1]["r"], r[1]["s"], r[1]["i"]) == (None, [], 0, False) and r[2]["s"] is None and r[0]["i"] is None
    assert r[0]["d"] == 365.25 * 86400 + 2 * 30.4375 * 86400 + 10 * 86400 + 9000 and r[1]["d"] is None


def test_dates_from_numbers(spark):
    r = spark.range(1).select(fn.date_from_number(F.lit(10)).alias("a"), fn.date_from_number(F.lit(86400 * 200_000)).alias("b")).first()
    assert r["a"] == datetime.date(1970, 1, 11) and r["b"] == datetime.date(1970, 1, 1) + datetime.timedelta(days=200_000)


def test_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n")
    rows = load_csv(spark, str(tmp_path / "x.csv")).collect()
    assert [r["row"]["a"] for r in rows] == ["1", "2"] and rows[1]["row"]["b"] is None
    assert load_csv(spark, str(tmp_path / "x.csv"), with_headers=False).first()["row"] == ["a", "b"]
    assert read_rows(spark, str(tmp_path / "x.csv"), "csv").schema["a"].dataType.simpleString() == "int"
    assert [len(b) for b in iter_batches(spark.range(5), 2)] == [2, 2, 1]


def test_schema(chain):
    model = NodeModel("Person", (Field("id", "INT", primary_key=True), Field("name", unique=True, required=True)))
    assert model.struct().simpleString() == "struct<id:bigint,name:string>" and model.merge_keys() == ["id"]
    assert all(r["rows"] == 0 for r in violations(chain, model).collect())
    reg = Registry((model,), (EdgeModel("knows", ("Person",), ("Person",)),))
    assert Registry.from_json(reg.to_json()) == reg
    codes = [c for c, _ in reg.advise([("Persn", []), ("Person", ["nam"])], [("knows", "Person", "Dog", True), ("know", None, None, True), ("knows", None, None, False)])]
    assert codes == ["UNKNOWN_NODE_LABEL", "UNDECLARED_PROPERTY", "INCOMPATIBLE_ENDPOINTS", "UNKNOWN_RELATIONSHIP_TYPE", "UNDIRECTED_TRAVERSAL"]


def test_event_stream(spark, sf_dir, tmp_path):
    from hopgrid.streaming.events import read_events, windowed_counts

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("event_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("event_counts").agg(F.sum("n")).first()[0] == events.count()


def test_paths_that_never_reach_the_lower_bound(chain):
    for low, high in ((6, None), (5, 8), (4, 4)):
        assert match(chain, "a", "Person").hops("knows", "b", low, high, path="p").df.count() == 0


def test_edge_types_with_spaces_overlap(spark):
    p = spark.createDataFrame([(1,), (2,)], "id long")
    k = spark.createDataFrame([(1, 2)], "src long, dst long")
    g = Graph("g").with_nodes(Nodes("P", p, "id")).with_edges(Edges("K", k, "src", "dst"), Edges("L", k, "src", "dst"))
    assert match(g, "a", "P").edge(" K | L", "b").edge("K ", "a", src="b").df.count() == 2  # over L and back over K, from either side


def test_merge_sets_new_properties_and_is_deterministic(chain, spark):
    rows = spark.createDataFrame([(1, "Z"), (1, "B"), (9, "N")], "id long, name string").repartition(3)
    g, counters = mutate.merge_nodes(chain, "Person", rows, on_create={"age": F.lit(1)}, on_match={"seen": F.lit(True)})
    got = {r["id"]: (r["name"], r["age"], r["seen"]) for r in g.nodes["Person"].df.collect()}
    assert got[1] == ("B", None, True) and got[9] == ("N", 1, None) and got[2] == ("Bob", None, None)
    assert counters.first().asDict() == {"nodes_created": 1, "nodes_matched": 1, "properties_set": 4}


def test_merge_edges_on_create_and_on_match(chain, spark):
    g = mutate.merge_edges(chain, "knows", spark.createDataFrame([(1, 2), (4, 1)], "src long, dst long"), on_create={"w": F.lit("new")}, on_match={"w": F.lit("old")})
    assert {(r["src"], r["dst"]): r["w"] for r in g.edges["knows"].df.collect()} == {(1, 2): "old", (2, 3): None, (3, 4): None, (4, 1): "new"}


def test_counters_count_both_ways(chain, spark):
    g = mutate.create_nodes(mutate.delete_nodes(chain, "Person", spark.createDataFrame([(4,)], "id long"), detach=True), "Person", spark.createDataFrame([(7,)], "id long"))
    assert mutate.counters(chain, g) == {"nodes_created": 1, "nodes_deleted": 1, "relationships_created": 0, "relationships_deleted": 1}
    assert mutate.counters(chain, chain)["nodes_created"] == 0


def test_unbound_ends(chain, spark):
    rows = spark.createDataFrame([(1, 4), (1, 99)], "a long, b long")
    assert mutate.create_edges(chain, "knows", rows, "a", "b").edges["knows"].df.count() == 4
    with pytest.raises(Exception, match="no Person 99"):
        mutate.create_edges(chain, "knows", rows, "a", "b", unbound="refuse").edges["knows"].df.collect()


def test_numbers_at_the_edges(spark):
    r = spark.range(1).select(
        fn.divide(F.lit(9007199254740993), F.lit(1), True).alias("d"), fn.divide(F.lit(-7), F.lit(2), True).alias("m"), fn.to_integer(F.lit("1e30")).alias("far"), fn.to_integer(F.lit("9007199254740993")).alias("exact"),
        fn.to_integer(F.lit(-2.7)).alias("cut"), fn.regex_full(F.lit("abc\n"), "abc").alias("nl"), fn.regex_full(F.lit("abc"), "a|abc").alias("alt"),
        fn.similarity(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("zero"),
    ).first()
    assert r.asDict() == {"d": 9007199254740993, "m": -3, "far": None, "exact": 9007199254740993, "cut": -2, "nl": False, "alt": True, "zero": None}


def test_page_rank_of_nothing(spark):
    none = spark.createDataFrame([], "id long")
    g = Graph("g").with_nodes(Nodes("P", none, "id")).with_edges(Edges("K", spark.createDataFrame([], "a long, b long"), "a", "b"))
    assert algorithms.page_rank(g, "P", "K").count() == 0


def test_durations_and_times(spark):
    r = spark.range(1).select(
        fn.plus_duration(F.lit("2024-01-31 10:00:00").cast("timestamp"), fn.duration(F.lit("P1M"))).alias("m"), fn.plus_duration(F.lit("2024-03-01 00:00:00").cast("timestamp"), fn.duration(F.lit("-P1DT1S"))).alias("b"),
        fn.duration(F.lit("soon")).alias("none"), fn.time_of_day(F.lit("10:35:00.5")).alias("t"), fn.time_of_day(F.lit("25:00")).alias("bad"), fn.datetime_from_text(F.lit("2024-02-03T04:05:06")).alias("d"), fn.datetime_from_text(F.lit("x")).alias("nd"),
    ).first()
    at = datetime.datetime
    assert (r["m"], r["b"], r["none"], r["t"], r["bad"], r["d"], r["nd"]) == (at(2024, 2, 29, 10), at(2024, 2, 28, 23, 59, 59), None, 38_100_500_000, None, at(2024, 2, 3, 4, 5, 6), None)


def test_parameters_must_be_given():
    from hopgrid.operators.pattern import Parameters

    with pytest.raises(ValueError, match="x"):
        Parameters(y=1)("x")


def test_explain_and_profile(chain):
    p = match(chain, "a", "Person").to("knows", "b", "Person")
    assert "Join" in p.explain() and "Parsed" in p.explain("extended")
    rows = p.profile().collect()
    assert any("Join" in r["operator"] for r in rows) and any(r["rows"] for r in rows) and rows[0]["step"] == 0


def test_remove_label(spark):
    t = spark.createDataFrame([(1,), (2,)], "id long")
    g = Graph("g").with_nodes(Nodes("A", t, "id", ("B",)))
    assert match(mutate.remove_label(g, "A", "B"), "v", "A&!B").df.count() == 2
    some = mutate.remove_label(g, "A", "B", F.col("id") == 1)
    assert match(some, "v", "B").df.count() == 1 and match(some, "v", "A").df.count() == 2
    with pytest.raises(ValueError, match="no further label"):
        mutate.remove_label(g, "A", "C")


def test_type_mismatches_and_pattern_advice(chain):
    from hopgrid.schema import advise_pattern, type_mismatches

    model = NodeModel("Person", (Field("id", "INT", primary_key=True), Field("name")))
    assert [c for c, _ in type_mismatches(model, {"id": "one", "name": "Ann"})] == ["PROPERTY_TYPE_MISMATCH"] and not type_mismatches(model, {"id": 1})
    reg = Registry((model,), (EdgeModel("likes"),))
    assert [c for c, _ in advise_pattern(reg, match(chain, "a", "Person").to("knows", "b"))] == ["UNKNOWN_RELATIONSHIP_TYPE"]


def test_tables_open_when_used(spark):
    opened_tables = []

    def rows(name):
        return lambda: opened_tables.append(name) or spark.range(3)

    g = Graph("g").with_nodes(Nodes("A", rows("a"), "id"), Nodes("B", rows("b"), "id"))
    assert match(g, "x", "A").df.count() == 3 and opened_tables == ["a"]


def test_registered_sources_and_frames(spark):
    import pandas as pd

    from hopgrid.sources.tables import from_frame, read_uri, register_source

    register_source("memory", lambda s, uri: s.range(int(uri.rpartition("/")[2])))
    assert read_uri(spark, "memory://x/4").count() == 4
    with pytest.raises(ValueError, match="no source"):
        read_uri(spark, "nowhere://x")
    assert from_frame(spark, pd.DataFrame({"a": [1, 2]})).count() == 2 and from_frame(spark, [{"a": 1}]).first()["a"] == 1


def test_count_less_makes_no_pairs(spark):
    def side(name, rows):
        return Nodes(name, spark.createDataFrame(rows, "id long, v double"), "id"), Edges(f"{name}_OF", spark.createDataFrame([(i, i % 2) for i, _ in rows], "src long, dst long"), "src", "dst", (), name, "G")

    values = [0.0, -0.0, 1.5, None, 2.5, float("nan"), -7.0, 1.5, 3.0, 9.0]
    a, b = ([(i, values[i * step % 10]) for i in range(60)] for step in (3, 7))
    sides = [side("A", a), side("B", b)]
    g = Graph("g").with_nodes(Nodes("G", spark.createDataFrame([(0,), (1,)], "id long"), "id"), *(n for n, _ in sides)).with_edges(*(e for _, e in sides))
    p, sub = match(g, "a", "A").to("A_OF", "g"), opened(g, "g").from_("B_OF", "b", "B")
    want = match(g, "a", "A").to("A_OF", "g").from_("B_OF", "b", "B").where(prop("a", "v") < prop("b", "v")).df.count()
    got = p.count_less(sub, prop("a", "v"), prop("b", "v"), "n")
    assert want > 100 and [r["n"] for r in got.collect()] == [want]
    assert p.where(F.lit(False)).count_less(sub, prop("a", "v"), prop("b", "v"), "n").first()["n"] == 0


def test_match_theta_makes_no_pairs(spark, tmp_path):
    from hopgrid.operators.pattern import profiled
    from hopgrid.plans.queries import QUERIES

    n = 3000
    spark.range(n).selectExpr("id c_custkey", "0 c_nationkey", "double(id) c_acctbal", "'c' c_name", "'m' c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(n).selectExpr("id s_suppkey", "0 s_nationkey", "double(id) s_acctbal", "'s' s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    df = QUERIES["match_theta"](spark, str(tmp_path))
    assert df.first()["n"] == n * (n - 1) // 2
    assert max(r["rows"] or 0 for r in profiled(df).collect()) <= 2 * n
