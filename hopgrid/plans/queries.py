"""Graph queries over the bundled tables, each beside the SQL that gives the same rows.

Every query covers its whole tables. Money is summed in whole cents, so sums don't depend on the
order of additions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..graph import Edges, Graph, Nodes, graph_from_tables, prop, tpch_graph
from ..operators import algorithms, mutate
from ..operators.pattern import Parameters, asc, desc, match, mixed_order, opened
from ..operators.shared import new_folder
from ..schema import Field, NodeModel, violations
from ..sources.tables import declare_edges, declare_nodes, edges_from_rows, ingest_edges, ingest_nodes, join_relational, load_csv, nodes_from_rows, read_rows, synthetic_nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tpch_graph(spark, sf_dir), spark, sf_dir)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


cents = lambda c: F.round(c * 100).cast("bigint")
big = lambda c: c.cast("bigint")
ADJ = "(select n_nationkey a, (n_nationkey+1)%25 b, 1 way from nation union all select n_nationkey, (n_nationkey*3)%25, 3 from nation)"

# -- hops


@query("""select n_name, sum(cast(round(l_extendedprice*100) as bigint))::bigint revenue_cents, count(*) n_items
from customer join orders on o_custkey=c_custkey join lineitem on l_orderkey=o_orderkey join part on p_partkey=l_partkey join nation on n_nationkey=c_nationkey
where p_size > 10 group by n_name""")
def hop_chain_revenue(g, spark, d):
    p = match(g, "c", "Customer").to("PLACED", "o").to("CONTAINS", "p", "Part", edge="l", where=prop("p", "p_size") > 10).to("IN_NATION", "n", "Nation", src="c")
    return p.return_(F.sum(cents(prop("l", "l_extendedprice"))).alias("revenue_cents"), F.count("*").alias("n_items"), by=[prop("n", "n_name").alias("n_name")])


@query("select c_mktsegment, count(*) n from customer join orders on o_custkey=c_custkey where o_totalprice > 100000 group by 1")
def hop_one(g, spark, d):
    p = match(g, "c", "Customer").to("PLACED", "o", "Order", where=prop("o", "o_totalprice") > 100000)
    return p.return_(F.count("*").alias("n"), by=[prop("c", "c_mktsegment").alias("c_mktsegment")])


@query("select p_brand, count(distinct l_orderkey) n_orders from part join lineitem on l_partkey=p_partkey group by 1")
def hop_incoming(g, spark, d):
    return match(g, "p", "Part").from_("CONTAINS", "o").return_(F.count_distinct("o__key").alias("n_orders"), by=[prop("p", "p_brand").alias("p_brand")])


@query(f"select x.n_name, count(*) n from nation x join (select a s, b t from {ADJ} union all select b, a from {ADJ} where a<>b) e on e.s=x.n_nationkey join nation y on y.n_nationkey=e.t group by 1")
def hop_undirected_self_loop(g, spark, d):
    return match(g, "x", "Nation").edge("ADJACENT", "y", "Nation").return_(F.count("*").alias("n"), by=[prop("x", "n_name").alias("n_name")])


@query("""select r_name, s_name, count(*) n from orders join lineitem on l_orderkey=o_orderkey join supplier on s_suppkey=l_suppkey join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey
where o_orderpriority='1-URGENT' group by 1,2""")
def hop_five_chain(g, spark, d):
    p = match(g, "o", "Order", F.col("o__o_orderpriority") == "1-URGENT").to("CONTAINS", "p", edge="l")
    p = p.let(s__key=prop("l", "l_suppkey")).node("s", "Supplier")
    return p.to("BASED_IN", "n", src="s").to("IN_REGION", "r", "Region").return_(F.count("*").alias("n"), by=[prop("r", "r_name").alias("r_name"), prop("s", "s_name").alias("s_name")])


@query("select count(*) n, count(distinct c_custkey) customers from customer join orders on o_custkey=c_custkey join nation on n_nationkey=c_nationkey where n_name < 'K'")
def match_two_patterns(g, spark, d):
    p = match(g, "c", "Customer").to("PLACED", "o").to("IN_NATION", "n", "Nation", src="c", where=prop("n", "n_name") < "K")
    return p.return_(F.count("*").alias("n"), F.count_distinct("c__key").alias("customers"), by=[])


@query("select a.r_name a, b.r_name b from region a cross join region b")
def match_product(g, spark, d):
    return match(g, "a", "Region").node("b", "Region").return_(prop("a", "r_name").alias("a"), prop("b", "r_name").alias("b"))


@query(f"select count(*) n from {ADJ} x join {ADJ} y on x.b=y.a where not (x.a=y.a and x.way=y.way)")
def match_unique_edges(g, spark, d):
    return match(g, "x", "Nation").to("ADJACENT", "y").to("ADJACENT", "z").return_(F.count("*").alias("n"), by=[])


@query(f"select count(*) n from {ADJ} x join {ADJ} y on x.b=y.a")
def match_again_rebinds(g, spark, d):
    return match(g, "x", "Nation").to("ADJACENT", "y").match().to("ADJACENT", "z", src="y").return_(F.count("*").alias("n"), by=[])


@query(f"""select x.a s, y.a t, z.a u from {ADJ} x join {ADJ} y on x.b=y.a join {ADJ} z on y.b=z.a and z.b=x.a
where not (x.a=y.a and x.way=y.way) and not (x.a=z.a and x.way=z.way) and not (y.a=z.a and y.way=z.way)""")
def match_cycle(g, spark, d):
    p = match(g, "s", "Nation").to("ADJACENT", "t").to("ADJACENT", "u").to("ADJACENT", "s", src="u")
    return p.return_(F.col("s__key").alias("s"), F.col("t__key").alias("t"), F.col("u__key").alias("u"))


@query("select count(*) n, count(c_name) customers, count(s_name) suppliers from (select c_name, null s_name from customer where c_acctbal>5000 union all select null, s_name from supplier where s_acctbal>5000)")
def match_label_disjunction(g, spark, d):
    p = match(g, "v", "Customer|Supplier").where(F.coalesce(prop("v", "c_acctbal"), prop("v", "s_acctbal")) > 5000)
    return p.return_(F.count("*").alias("n"), F.count("v__c_name").alias("customers"), F.count("v__s_name").alias("suppliers"), by=[])


@query("select count(*) n from customer")
def match_label_expression(g, spark, d):
    return match(g, "v", "Party&!Supplier").return_(F.count("*").alias("n"), by=[])


@query("""select count(*) n from customer c join nation on n_nationkey=c_nationkey join supplier s on s_nationkey=n_nationkey where c_acctbal < s_acctbal""")
def match_theta(g, spark, d):
    # Pairs grow with the square of a nation's rows: counted by order, not made.
    return match(g, "c", "Customer").to("IN_NATION", "n", "Nation").count_less(opened(g, "n").from_("BASED_IN", "s", "Supplier"), prop("c", "c_acctbal"), prop("s", "s_acctbal"), "n")


@query("""select c_custkey, count(o_orderkey) n_big, max(o_totalprice) top from customer left join orders on o_custkey=c_custkey and o_totalprice>300000 group by 1""")
def optional_inner_where(g, spark, d):
    p = match(g, "c", "Customer").optional(opened(g, "c").to("PLACED", "o", "Order", where=prop("o", "o_totalprice") > 300000))
    return p.return_(F.count("o__key").alias("n_big"), F.max("o__o_totalprice").alias("top"), by=[F.col("c__key").alias("c_custkey")])


@query("""select c_custkey, count(l_partkey) n from customer left join (orders join lineitem on l_orderkey=o_orderkey and l_quantity>45) on o_custkey=c_custkey group by 1""")
def optional_two_hops(g, spark, d):
    p = match(g, "c", "Customer").optional(opened(g, "c").to("PLACED", "o").to("CONTAINS", "p", edge="l", where=prop("l", "l_quantity") > 45))
    return p.return_(F.count("p__key").alias("n"), by=[F.col("c__key").alias("c_custkey")])


@query("select count(*) n from customer where exists (select 1 from orders where o_custkey=c_custkey and o_orderstatus='F')")
def exists_pattern(g, spark, d):
    return match(g, "c", "Customer").exists(opened(g, "c").to("PLACED", "o", "Order", where=prop("o", "o_orderstatus") == "F")).return_(F.count("*").alias("n"), by=[])


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey=c_custkey and o_totalprice > 400000)")
def exists_not(g, spark, d):
    return match(g, "c", "Customer").exists(opened(g, "c").to("PLACED", "o", "Order", where=prop("o", "o_totalprice") > 400000), negate=True).return_(F.col("c__key").alias("c_custkey"), prop("c", "c_name").alias("c_name"))


@query("select has_big, count(*) n from (select exists (select 1 from orders where o_custkey=c_custkey and o_totalprice>400000) has_big from customer) group by 1")
def exists_value(g, spark, d):
    p = match(g, "c", "Customer").flag(opened(g, "c").to("PLACED", "o", "Order", where=prop("o", "o_totalprice") > 400000), "has_big")
    return p.return_(F.count("*").alias("n"), by=[F.col("has_big")])


@query("select c_custkey, (select count(*) from orders where o_custkey=c_custkey) n from customer")
def count_subquery(g, spark, d):
    return match(g, "c", "Customer").count(opened(g, "c").to("PLACED", "o"), "n").return_(F.col("c__key").alias("c_custkey"), F.col("n"))


@query("select n_name, array_to_string(list_sort(coalesce(list(s_name) filter (where s_name is not null), [])), ',') suppliers from nation left join supplier on s_nationkey=n_nationkey group by 1")
def pattern_comprehension(g, spark, d):
    p = match(g, "n", "Nation").collect(opened(g, "n").from_("BASED_IN", "s", "Supplier"), prop("s", "s_name"), "suppliers")
    return p.return_(prop("n", "n_name").alias("n_name"), F.array_join(F.sort_array("suppliers"), ",").alias("suppliers"))


# -- variable length


def _paths(mode: str, low: int, high: int) -> str:
    keep = {"walk": "true", "trail": "not list_contains(p.rels, e.a||':'||e.way)", "acyclic": "not list_contains(p.nodes, e.b)", "simple": "(not list_contains(p.nodes, e.b) or p.nodes[1]=e.b) and (len(p.nodes)=1 or p.nodes[1]<>p.t)"}[mode]
    return f"""with recursive e as (select a, b, way from {ADJ}), p as (select n_nationkey s, n_nationkey t, 0 n, [n_nationkey] nodes, []::varchar[] rels from nation
union all select p.s, e.b, n+1, list_append(p.nodes, e.b), list_append(p.rels, e.a||':'||e.way) from p join e on e.a=p.t where n < {high} and {keep})
select s::bigint s, n::bigint length, count(*) paths, count(distinct t) ends from p where n >= {low} group by 1, 2"""


def _hops(g, mode, low, high, **k):
    p = match(g, "x", "Nation").hops("ADJACENT", "y", low, high, mode=mode, path="p", **k)
    return p.return_(F.count("*").alias("paths"), F.count_distinct("y__key").alias("ends"), by=[big(F.col("x__key")).alias("s"), fn.path_length("p").alias("length")])


@query(_paths("walk", 1, 3))
def hops_walk(g, spark, d):
    return _hops(g, "walk", 1, 3)


@query(_paths("trail", 1, 3))
def hops_trail(g, spark, d):
    return _hops(g, "trail", 1, 3)


@query(_paths("simple", 1, 4))
def hops_simple(g, spark, d):
    return _hops(g, "simple", 1, 4)


@query(_paths("acyclic", 0, 3))
def hops_acyclic_from_zero(g, spark, d):
    return _hops(g, "acyclic", 0, 3)


@query("""with recursive p as (select conv_id||':'||turn s, conv_id, turn, 0 n from conversations where turn=0
union all select p.s, c.conv_id, c.turn, n+1 from p join conversations c on c.conv_id=p.conv_id and c.turn=p.turn+1)
select n::bigint length, count(*) paths from p where n>=1 group by 1""")
def hops_unbounded_trail(g, spark, d):
    p = match(g, "x", "Turn", F.col("x__turn") == 0).hops("NEXT", "y", 1, None, path="p").node("y", "Turn")
    return p.return_(F.count("*").alias("paths"), by=[fn.path_length("p").alias("length")])


@query(f"""with recursive e as (select distinct a, b from {ADJ}), p as (select 0 t, 0 n union select e.b, n+1 from p join e on e.a=p.t where n<25)
select t::bigint node, min(n)::bigint length from p group by 1""")
def shortest_path_length(g, spark, d):
    starts = g.nodes["Nation"].df.filter("n_nationkey = 0")
    return algorithms.reachable(g, "ADJACENT", starts, "n_nationkey").select(big(F.col("node")).alias("node"), big(F.col("depth")).alias("length"))


@query(f"""with recursive e as (select distinct a, b from {ADJ}), m as (select t, min(n) n from (with recursive p as (select 0 t, 0 n union select e.b, n+1 from p join (select distinct a, b from {ADJ}) e on e.a=p.t where n<25) select * from p) group by 1),
q as (select 0 t, 0 n, '0' path union all select e.b, q.n+1, path||'>'||e.b from q join e on e.a=q.t join m on m.t=e.b and m.n=q.n+1)
select t::bigint node, n::bigint length, path from q""")
def shortest_path_all(g, spark, d):
    starts = g.nodes["Nation"].df.filter("n_nationkey = 0")
    p = algorithms.shortest_paths(g, "ADJACENT", starts, "n_nationkey")
    return p.select(big(F.col("node")).alias("node"), big(F.col("length")).alias("length"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("""with recursive p as (select conv_id||':'||turn s, conv_id, turn, 0 n from conversations where turn=0
union all select p.s, c.conv_id, c.turn, n+1 from p join conversations c on c.conv_id=p.conv_id and c.turn=p.turn+1)
select s source, conv_id||':'||turn node, n::bigint length, (n+1)::bigint nodes from p""")
def shortest_path_turns(g, spark, d):
    starts = g.nodes["Turn"].df.filter("turn = 0").select("turn_id")
    ends = g.nodes["Turn"].df.select(F.col("turn_id").alias("node"))
    p = algorithms.shortest_paths(g, "NEXT", starts, "turn_id").join(ends, "node", "left_semi")  # a last turn's edge leads nowhere
    return p.select("source", "node", big(F.col("length")).alias("length"), big(F.size("path")).alias("nodes"))


@query(f"""with recursive e as (select a, b, count(*) over (partition by a) n from {ADJ}), r as (select n_nationkey k, 0 i, 1.0::double/25 rank from nation
union all select b, i+1, 0.15/25 + 0.85*sum(rank/n) from (select b, n, i, rank from r join e on e.a=r.k where i<20) group by b, i)
select k::bigint nation, round(rank, 9) rank from r where i=20""")
def page_rank_nations(g, spark, d):
    return algorithms.call("page_rank", g, "Nation", "ADJACENT").select(big(F.col("key")).alias("nation"), F.round("rank", 9).alias("rank"))


# -- aggregates, order, scope


@query("""select o_orderstatus, o_orderpriority, count(*) n, count(distinct o_custkey) customers, sum(cast(round(o_totalprice*100) as bigint))::bigint total, min(o_totalprice) low, max(o_totalprice) high, round(avg(o_totalprice), 4) mean from orders group by 1,2""")
def aggregates(g, spark, d):
    o = lambda c: prop("o", c)
    return match(g, "o", "Order").return_(
        F.count("*").alias("n"), F.count_distinct(o("o_custkey")).alias("customers"), F.sum(cents(o("o_totalprice"))).alias("total"), F.min(o("o_totalprice")).alias("low"), F.max(o("o_totalprice")).alias("high"), F.round(F.avg(o("o_totalprice")), 4).alias("mean"),
        by=[o("o_orderstatus").alias("o_orderstatus"), o("o_orderpriority").alias("o_orderpriority")],
    )


@query("select c_custkey, count(*) n from customer join orders on o_custkey=c_custkey group by 1 having count(*) > 12")
def having(g, spark, d):
    p = match(g, "c", "Customer").to("PLACED", "o").pipe(lambda x: x.groupBy(F.col("c__key").alias("c_custkey")).agg(F.count("*").alias("n")))
    return p.with_(F.col("c_custkey"), F.col("n"), where=F.col("n") > 12).return_()


@query("select n_name, array_to_string(list_sort(list(distinct c_mktsegment)), ',') segments from customer join nation on n_nationkey=c_nationkey group by 1")
def collect_values(g, spark, d):
    p = match(g, "c", "Customer").to("IN_NATION", "n", "Nation")
    return p.return_(F.array_join(F.sort_array(F.collect_set("c__c_mktsegment")), ",").alias("segments"), by=[prop("n", "n_name").alias("n_name")])


@query("select (count(*)/60)::double + 1 x, (count(*) // 7)::bigint q from lineitem")
def aggregate_in_expression(g, spark, d):
    return match(g, "o", "Order").to("CONTAINS", "p").return_(F.count("*").alias("n"), by=[]).select((F.col("n") / 60 + 1).alias("x"), fn.divide(F.col("n"), F.lit(7), True).alias("q"))


@query("select distinct p_brand, p_size from part")
def return_distinct(g, spark, d):
    return match(g, "p", "Part").return_(prop("p", "p_brand").alias("p_brand"), prop("p", "p_size").alias("p_size"), distinct=True)


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25 offset 10")
def order_skip_limit(g, spark, d):
    return match(g, "c", "Customer").return_(F.col("c__key").alias("c_custkey"), prop("c", "c_acctbal").alias("c_acctbal"), order=[desc(prop("c", "c_acctbal")), F.col("c__key")], skip=10, limit=25)


@query("""select c_custkey, top from (select c_custkey, max(o_totalprice) top from customer left join orders on o_custkey=c_custkey and o_totalprice > 350000 group by 1) order by top asc nulls last, c_custkey limit 40""")
def order_nulls_last(g, spark, d):
    p = match(g, "c", "Customer").optional(opened(g, "c").to("PLACED", "o", "Order", where=prop("o", "o_totalprice") > 350000))
    return p.return_(F.max("o__o_totalprice").alias("top"), by=[F.col("c__key").alias("c_custkey")], order=[asc(F.col("top")), F.col("c_custkey")], limit=40)


@query("select * from (select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50) where o_orderkey % 3 = 0")
def with_limit_then_where(g, spark, d):
    p = match(g, "o", "Order").with_(F.col("o__key").alias("o_orderkey"), prop("o", "o_totalprice").alias("o_totalprice"), order=[desc(prop("o", "o_totalprice")), F.col("o__key")], limit=50, where=F.col("o_orderkey") % 3 == 0)
    return p.return_()


@query("select p_partkey, p_retailprice*1.1 taxed from part where p_retailprice*1.1 > 1000")
def let_and_filter(g, spark, d):
    return match(g, "p", "Part").let(taxed=prop("p", "p_retailprice") * 1.1).where(F.col("taxed") > 1000).return_(F.col("p__key").alias("p_partkey"), F.col("taxed"))


@query("select r_name, x::bigint x, (x*x)::bigint sq from region, unnest(generate_series(1, r_regionkey)) t(x)")
def unwind_range(g, spark, d):
    return match(g, "r", "Region").unwind(fn.range_list(1, F.col("r__key")), "x").return_(prop("r", "r_name").alias("r_name"), F.col("x"), (F.col("x") * F.col("x")).alias("sq"))


@query("select p_partkey, array_to_string(list_transform(list_filter([p_size, p_size+1, p_size+2], lambda x: x%2=0), lambda x: x*10), ',') evens from part")
def list_comprehension(g, spark, d):
    s = prop("p", "p_size")
    v = fn.comprehension(F.array(s, s + 1, s + 2), lambda x: x % 2 == 0, lambda x: x * 10)
    return match(g, "p", "Part").return_(F.col("p__key").alias("p_partkey"), F.array_join(v.cast("array<string>"), ",").alias("evens"))


@query("select case when c_acctbal<0 then 'debt' when c_acctbal<5000 then 'low' else 'high' end band, count(*) n from customer group by 1")
def case_when(g, spark, d):
    b = prop("c", "c_acctbal")
    return match(g, "c", "Customer").return_(F.count("*").alias("n"), by=[F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band")])


@query("""select count(*) n, count(*) filter (where not (quality=1)) not_good, count(*) filter (where quality is null) unknown, count(*) filter (where quality=1 or lang='en') either from documents left join labels using (doc_id)""")
def three_valued_filter(g, spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    x = match(g, "d", "Document").df.join(labels, F.col("d__key") == labels.doc_id, "left")
    q, lang = F.col("quality"), F.col("d__lang")
    return x.agg(F.count("*").alias("n"), F.count_if(~(q == 1)).alias("not_good"), F.count_if(q.isNull()).alias("unknown"), F.count_if((q == 1) | (lang == "en")).alias("either"))


@query("select count(*) filter (where p_size in (1, 5, 9)) a, count(*) filter (where p_size not in (1, null)) b, count(*) filter (where (p_size in (2, null)) is null) c from part")
def in_with_null(g, spark, d):
    s = prop("p", "p_size")
    nulls = lambda *v: F.array(*(F.lit(x).cast("int") for x in v))
    return match(g, "p", "Part").return_(F.count_if(s.isin(1, 5, 9)).alias("a"), F.count_if(~fn.in_list(s, nulls(1, None))).alias("b"), F.count_if(fn.in_list(s, nulls(2, None)).isNull()).alias("c"), by=[])


@query(r"""select count(*) filter (where contains(p_name, 'a')) has_a, count(*) filter (where starts_with(p_name, 'P')) p, count(*) filter (where ends_with(p_type, 'L')) l, count(*) filter (where regexp_full_match(p_brand, 'Brand#[1-3].*')) brand, count(*) filter (where (p_size>10) <> (p_retailprice>1200)) either from part""")
def string_predicates(g, spark, d):
    p = lambda c: prop("p", c)
    return match(g, "p", "Part").return_(
        F.count_if(p("p_name").contains("a")).alias("has_a"), F.count_if(p("p_name").startswith("P")).alias("p"), F.count_if(p("p_type").endswith("L")).alias("l"), F.count_if(fn.regex_full(p("p_brand"), "Brand#[1-3].*")).alias("brand"), F.count_if(fn.xor(p("p_size") > 10, p("p_retailprice") > 1200)).alias("either"), by=[],
    )


# -- scalar functions


@query("""select r_regionkey::bigint k, lower(r_name) lo, upper(r_name) up, substr(r_name, 2, 3) sub, left(r_name, 2) l, right(r_name, 2) r, replace(r_name, 'A', 'x') rep, reverse(r_name) rev, length(r_name)::bigint len, trim('  '||r_name||' ') tr,
array_to_string(string_split(r_name, 'A'), '|') parts from region""")
def functions_text(g, spark, d):
    n = prop("r", "r_name")
    return match(g, "r", "Region").return_(
        big(F.col("r__key")).alias("k"), F.lower(n).alias("lo"), F.upper(n).alias("up"), fn.substring(n, 1, 3).alias("sub"), F.left(n, F.lit(2)).alias("l"), F.right(n, F.lit(2)).alias("r"), F.replace(n, F.lit("A"), F.lit("x")).alias("rep"), F.reverse(n).alias("rev"),
        fn.size(n, "string").alias("len"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tr"), F.array_join(fn.split(n, "A"), "|").alias("parts"),
    )


@query("""select n_nationkey::bigint k, abs(n_nationkey-12)::bigint a, ceil(n_nationkey/7.0)::double c, floor(n_nationkey/7.0)::double f, round(n_nationkey/7.0, 3)::double r, sign(n_nationkey-12)::double s, round(sqrt(n_nationkey), 6) q, round(power(n_nationkey, 1.5), 4) p, round(exp(n_nationkey/10.0), 6) e,
round(ln(n_nationkey+1), 6) l, round(log10(n_nationkey+1), 6) t, round(sin(n_nationkey)+cos(n_nationkey)+atan2(n_nationkey, 3), 6) g, round(degrees(radians(n_nationkey)), 6) d, (n_nationkey*7 // 3)::bigint i, (-(n_nationkey+1) % 3)::bigint m from nation""")
def functions_number(g, spark, d):
    k = F.col("n__key").cast("bigint")
    return match(g, "n", "Nation").return_(
        k.alias("k"), F.abs(k - 12).alias("a"), fn.ceil(k / 7.0).alias("c"), fn.floor(k / 7.0).alias("f"), fn.round_(k / 7.0, 3).alias("r"), F.signum((k - 12).cast("double")).alias("s"), F.round(F.sqrt(k), 6).alias("q"), F.round(F.pow(k, F.lit(1.5)), 4).alias("p"), F.round(F.exp(k / 10.0), 6).alias("e"),
        F.round(fn.log(k + 1), 6).alias("l"), F.round(F.log10(k + 1), 6).alias("t"), F.round(F.sin(k) + F.cos(k) + F.atan2(k, F.lit(3)), 6).alias("g"), F.round(F.degrees(F.radians(k.cast("double"))), 6).alias("d"), fn.divide(k * 7, F.lit(3), True).alias("i"), (-(k + 1) % 3).alias("m"),
    )


@query("""select x, trunc(try_cast(x as double))::bigint i, try_cast(x as double) f, case lower(trim(x)) when 'true' then true when 'false' then false end b from (values ('2.7'), ('-2.7'), ('abc'), ('TRUE'), ('false'), ('12')) t(x)""")
def functions_convert(g, spark, d):
    x = spark.createDataFrame([(v,) for v in ("2.7", "-2.7", "abc", "TRUE", "false", "12")], "x string")
    return x.select("x", fn.to_integer(F.col("x")).alias("i"), fn.to_float(F.col("x")).alias("f"), fn.to_boolean(F.col("x")).alias("b"))


@query("""select p_partkey, list_extract(l, 1) h, list_extract(l, -1) t, array_to_string(l[2:], ',') rest, len(l)::bigint n from (select p_partkey, string_split(p_name, ' ') l from part)""")
def functions_list(g, spark, d):
    x = fn.split(prop("p", "p_name"), " ")
    return match(g, "p", "Part").return_(F.col("p__key").alias("p_partkey"), fn.head(x).alias("h"), fn.last(x).alias("t"), F.array_join(fn.tail(x), ",").alias("rest"), fn.size(x).alias("n"))


@query("""select date_trunc('month', o_orderdate)::timestamp m, count(*) n, min(datediff('second', timestamp '1990-01-01', o_orderdate))::bigint s from orders group by 1""")
def functions_time(g, spark, d):
    t = prop("o", "o_orderdate")
    return match(g, "o", "Order").return_(F.count("*").alias("n"), F.min(fn.duration_between(F.lit("1990-01-01").cast("timestamp_ntz"), t)).cast("bigint").alias("s"), by=[F.date_trunc("month", t).cast("timestamp_ntz").alias("m")])


@query("""with p as (select n_nationkey k, n_nationkey*7.0-90 x, n_nationkey*3.0-40 y from nation)
select a.k::bigint a, b.k::bigint b, round(2*6371008.8*asin(sqrt(least(1.0, pow(sin(radians(b.y-a.y)/2),2)+cos(radians(a.y))*cos(radians(b.y))*pow(sin(radians(b.x-a.x)/2),2)))), 2) metres, round(sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), 6) flat from p a join p b on b.k=(a.k+1)%25""")
def functions_distance(g, spark, d):
    p = match(g, "a", "Nation").to("ADJACENT", "b", edge="e", where=F.col("e__way") == 1)
    at = lambda v, s: fn.point(F.col(f"{v}__key") * 7.0 - 90, F.col(f"{v}__key") * 3.0 - 40, srid=s)
    return p.return_(big(F.col("a__key")).alias("a"), big(F.col("b__key")).alias("b"), F.round(fn.distance(at("a", fn.WGS84), at("b", fn.WGS84)), 2).alias("metres"), F.round(fn.distance(at("a", fn.CARTESIAN), at("b", fn.CARTESIAN)), 6).alias("flat"))


# -- search


def _vector_sql(score: str) -> str:
    return f"""with q as (select embedding v from embeddings where vec_id=0), s as (select vec_id, {score} score from embeddings, q) select vec_id::bigint vec_id, round(score, 6) score from s order by s.score desc, vec_id limit 10"""


def _vector(spark, d, metric):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.filter("vec_id = 0").first()["embedding"]
    return algorithms.vector_search(e, "embedding", q, 10, metric, "vec_id").select(big(F.col("vec_id")).alias("vec_id"), F.round("score", 6).alias("score"))


@query(_vector_sql("list_cosine_similarity(embedding::double[], v::double[])"))
def vector_cosine(g, spark, d):
    return _vector(spark, d, "cosine")


@query(_vector_sql("list_inner_product(embedding::double[], v::double[])"))
def vector_dot(g, spark, d):
    return _vector(spark, d, "dot")


@query(_vector_sql("1/(1+pow(list_distance(embedding::double[], v::double[]), 2))"))
def vector_euclidean(g, spark, d):
    return _vector(spark, d, "euclidean")


@query(r"""with w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') w from documents),
c as (select doc_id, len(w) n, len(list_filter(w, lambda x: x='the')) t0, len(list_filter(w, lambda x: x='and')) t1, len(list_filter(w, lambda x: x='with')) t2 from w),
s as (select count(*) docs, avg(n) av, count(*) filter (where t0>0) d0, count(*) filter (where t1>0) d1, count(*) filter (where t2>0) d2 from c)
select doc_id, round(ln(1+(docs-d0+0.5)/(d0+0.5))*t0*2.2/(t0+1.2*(0.25+0.75*n/av)) + ln(1+(docs-d1+0.5)/(d1+0.5))*t1*2.2/(t1+1.2*(0.25+0.75*n/av)) + ln(1+(docs-d2+0.5)/(d2+0.5))*t2*2.2/(t2+1.2*(0.25+0.75*n/av)), 6) score from c, s where t0+t1+t2 > 0""")
def fulltext_bm25(g, spark, d):
    return algorithms.fulltext_search(g.nodes["Document"].df, "doc_id", ["text"], "the and with").select("doc_id", F.round("score", 6).alias("score"))


# -- changes


def _loads(old: DataFrame, key: str, again: DataFrame, far: int) -> tuple[DataFrame, DataFrame]:
    """``old`` with the key ``id`` (load 0 and ``key``), and rows to merge: the ids of ``again``, and those of load 1
    with ``key`` moved by ``far``. Moved keys of a large table reach existing ones; the load tells them apart."""
    named = lambda load, c: F.struct(F.lit(load).alias("load"), c.alias(key)).alias("id")
    return old.withColumn("id", named(0, F.col(key))), again.select(named(0, F.col(key))).union(again.select(named(1, F.col(key) + far)))


@query("""select c_custkey, c_name, case when c_custkey%3=0 then 'MERGED' else c_mktsegment end c_mktsegment, case when c_custkey%3=0 then c_acctbal+1 else c_acctbal end c_acctbal from customer
union all select c_custkey+1000000, null, 'MERGED', 1.0 from customer where c_custkey%3=0""")
def merge_partial_rows(g, spark, d):
    c = g.nodes["Customer"].df
    old, rows = _loads(c, "c_custkey", c.filter("c_custkey % 3 = 0"), 1000000)
    g, rows = g.with_nodes(Nodes("Customer", old, "id")), rows.withColumn("c_mktsegment", F.lit("MERGED"))
    g2, _ = mutate.merge_nodes(g, "Customer", rows, on_create={"c_acctbal": F.lit(1.0)}, on_match={"c_acctbal": F.col("c_acctbal") + 1})
    return g2.nodes["Customer"].df.select("id.c_custkey", "c_name", "c_mktsegment", "c_acctbal")


@query("select count(*) filter (where c_custkey%3=0) nodes_matched, count(*) filter (where c_custkey%3=0) nodes_created, (2*count(*) filter (where c_custkey%3=0))::bigint properties_set from customer")
def merge_counters(g, spark, d):
    c = g.nodes["Customer"].df
    old, rows = _loads(c, "c_custkey", c.filter("c_custkey % 3 = 0"), 1000000)
    g, rows = g.with_nodes(Nodes("Customer", old, "id")), rows.withColumn("c_mktsegment", F.lit("MERGED"))
    return mutate.merge_nodes(g, "Customer", rows)[1]


@query("select count(*) n, sum(case when p_size>40 then 1 else p_size end)::bigint sizes, count(case when p_size>40 then null else p_brand end) brands from part")
def set_and_remove(g, spark, d):
    w = F.col("p_size") > 40
    g2 = mutate.remove_property(g, "Part", "p_brand", where=w)
    return mutate.set_properties(g2, "Part", w, p_size=F.lit(1)).nodes["Part"].df.agg(F.count("*").alias("n"), big(F.sum("p_size")).alias("sizes"), F.count("p_brand").alias("brands"))


@query("select (select count(*) from supplier where s_acctbal>=0) suppliers, (select count(*) from lineitem join supplier on s_suppkey=l_suppkey where s_acctbal>=0) supplied, (select count(*) from supplier where s_acctbal>=0) based")
def delete_detach(g, spark, d):
    gone = g.nodes["Supplier"].df.filter("s_acctbal < 0").select("s_suppkey")
    g2 = mutate.delete_nodes(g, "Supplier", gone, detach=True)
    n = lambda df, a: df.agg(F.count("*").alias(a))
    return n(g2.nodes["Supplier"].df, "suppliers").crossJoin(n(g2.edges["SUPPLIED_BY"].df, "supplied")).crossJoin(n(g2.edges["BASED_IN"].df, "based"))


@query("select count(*) n from (select o_orderkey from orders union all select o_orderkey+5000000 from orders join customer on c_custkey=o_custkey where o_orderkey%10=0)")
def bulk_edges(g, spark, d):
    rows = g.edges["PLACED"].df.filter("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 5000000).alias("dst"))
    g2 = ingest_edges(g.with_edges(Edges("PLACED", g.edges["PLACED"].df, "o_custkey", "o_orderkey", ("o_orderkey",), "Customer")), "PLACED", rows, "src", "dst")
    return g2.edges["PLACED"].df.agg(F.count("*").alias("n"))


# -- sources


@query("select i::bigint id, 'Person' \"label\", 'Person_'||i \"name\", (20+i%60)::bigint age, (75.5+i%25)::double score, i%2=0 active from range(1000) t(i)")
def synthetic(g, spark, d):
    return synthetic_nodes(spark, 1000).withColumn("score", F.col("score").cast("double"))


@query("""select event_type, count(*) n, sum(cast(round(value*100) as bigint))::bigint cents from customer join events on user_id=c_custkey join nation on n_nationkey=c_nationkey where n_regionkey=1 group by 1""")
def relational_join(g, spark, d):
    rows = match(g, "c", "Customer").to("IN_NATION", "n", "Nation", where=prop("n", "n_regionkey") == 1).return_(F.col("c__key"))
    events = spark.read.parquet(f"{d}/events.parquet")
    return join_relational(rows, events, "c__key", "user_id").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(cents(F.col("value"))).alias("cents"))


@query("""select quality::bigint quality, count(*) n from documents left join labels using (doc_id) group by 1""")
def optional_labels(g, spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    x = match(g, "d", "Document").df.join(labels, F.col("d__key") == labels.doc_id, "left")
    return x.groupBy(big(F.col("quality")).alias("quality")).agg(F.count("*").alias("n"))


@query("""with w as (select x.c_nationkey nk, x.c_custkey a, y.c_custkey b from customer x join customer y on y.c_nationkey=x.c_nationkey and x.c_custkey<>y.c_custkey where x.c_mktsegment='BUILDING' and y.c_mktsegment='MACHINERY') select nk::bigint nk, count(*) pairs from w group by 1""")
def colleagues_two_hop(g, spark, d):
    # Only their number is asked, so each side is counted by nation first; no customer is in both segments.
    of = lambda v, segment: opened(g, "n").from_("IN_NATION", v, "Customer", where=prop(v, "c_mktsegment") == segment)
    p = match(g, "n", "Nation").count(of("x", "BUILDING"), "xs").count(of("y", "MACHINERY"), "ys").let(pairs=F.col("xs") * F.col("ys")).where(F.col("pairs") > 0)
    return p.return_(big(F.col("n__key")).alias("nk"), F.col("pairs"))


# -- reading, writing and changing graphs


def _stored(df: DataFrame, form: str, folder: str) -> str:
    """``df`` as files of a format in a new shared folder; its path."""
    path = f"{new_folder(df.sparkSession)}/{folder}"
    df.write.option("header", True).format(form).save(path)
    return path


@query("select n_nationkey::varchar k, n_name from nation where n_regionkey::varchar = '1'")
def source_load_csv(g, spark, d):
    rows = load_csv(spark, _stored(g.nodes["Nation"].df, "csv", "nation"))
    v = lambda c: F.col("row")[c]
    return rows.filter(v("n_regionkey") == "1").select(v("n_nationkey").alias("k"), v("n_name").alias("n_name"))


@query("select n_regionkey::bigint r, count(*) n, min(n_name) first from nation group by 1")
def source_csv_nodes(g, spark, d):
    rows = read_rows(spark, _stored(g.nodes["Nation"].df, "csv", "nation"), "csv")
    g2 = ingest_nodes(declare_nodes(Graph("g"), "Place", rows.limit(0).withColumnsRenamed({"n_nationkey": "id"}), "id"), "Place", rows, rename={"n_nationkey": "id"})
    return match(g2, "p", "Place").return_(F.count("*").alias("n"), F.min(prop("p", "n_name")).alias("first"), by=[big(prop("p", "n_regionkey")).alias("r")])


@query("select n_name, count(*) n from customer join nation on n_nationkey=c_nationkey group by 1")
def source_parquet_graph(g, spark, d):
    g2 = declare_nodes(declare_nodes(Graph("g"), "C", read_rows(spark, f"{d}/customer.parquet"), "c_custkey"), "N", read_rows(spark, [f"{d}/nation.parquet"]), "n_nationkey")
    none = spark.createDataFrame([], "s bigint, t int")
    g2 = ingest_edges(declare_edges(g2, "LIVES", none, "s", "t", (), "C", "N"), "LIVES", read_rows(spark, f"{d}/customer.parquet").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey")
    return match(g2, "c", "C").to("LIVES", "n", "N").return_(F.count("*").alias("n"), by=[prop("n", "n_name").alias("n_name")])


@query("select count(*) n, count(c_name) named, sum(c_custkey)::bigint keys from (select c_custkey, c_name from customer union all select c_custkey+5000000, null from customer)")
def bulk_create(g, spark, d):
    rows = g.nodes["Customer"].df.select((F.col("c_custkey") + 5000000).alias("c_custkey"))
    return mutate.create_nodes(g, "Customer", rows).nodes["Customer"].df.agg(F.count("*").alias("n"), F.count("c_name").alias("named"), F.sum("c_custkey").alias("keys"))


@query("select c_custkey, case when c_custkey%2=0 then upper(c_mktsegment) else c_mktsegment end seg, case when c_custkey%2=0 then 'seen' end note from customer union all select c_custkey+5000000, 'NEW', 'made' from customer where c_custkey%2=0")
def bulk_merge(g, spark, d):
    c = g.nodes["Customer"].df
    old, rows = _loads(c, "c_custkey", c.filter("c_custkey % 2 = 0"), 5000000)
    g2, _ = mutate.merge_nodes(g.with_nodes(Nodes("Customer", old, "id")), "Customer", rows, on_create={"c_mktsegment": F.lit("NEW"), "note": F.lit("made")}, on_match={"c_mktsegment": F.upper("c_mktsegment"), "note": F.lit("seen")})
    return g2.nodes["Customer"].df.select("id.c_custkey", F.col("c_mktsegment").alias("seg"), "note")


@query("select o_orderkey, o_orderpriority, case when o_orderkey%5=0 then 'again' end mark from orders union all select o_orderkey+5000000, 'NEW', 'first' from orders where o_orderkey%5=0")
def merge_relationship(g, spark, d):
    t = g.edges["PLACED"]
    # Moved keys of a large table reach existing orders; the load tells them apart.
    g = g.with_edges(t.with_df(g.nodes["Order"].df.select("o_custkey", "o_orderkey", F.lit(0).alias("load"), "o_orderpriority")))
    some = t.df.filter("o_orderkey % 5 = 0")
    rows = some.withColumn("load", F.lit(0)).union(some.select("o_custkey", F.col("o_orderkey") + 5000000, F.lit(1)))
    g2 = mutate.merge_edges(g, "PLACED", rows, keys=("load",), on_create={"o_orderpriority": F.lit("NEW"), "mark": F.lit("first")}, on_match={"mark": F.lit("again")})
    return g2.edges["PLACED"].df.select("o_orderkey", "o_orderpriority", "mark")


@query("select 'customer' label, count(*) n from customer where c_custkey%4=0 union all select 'party', count(*) from customer where c_custkey%4<>0")
def remove_label(g, spark, d):
    g2 = mutate.remove_label(g, "Customer", "Party", F.col("c_custkey") % 4 == 0)
    count = lambda expression, name: match(g2, "v", expression).return_(F.lit(name).alias("label"), F.count("*").alias("n"), by=[]).select("label", "n")
    return count("Customer&!Party", "customer").union(count("Party&!Supplier", "party"))


@query("select (select count(*) from customer)::bigint nodes_created, (select count(*) from supplier where s_acctbal<0)::bigint nodes_deleted, 0::bigint relationships_created, (select 2*count(*) from lineitem join supplier on s_suppkey=l_suppkey where s_acctbal<0)::bigint*0 + (select count(*) from lineitem join supplier on s_suppkey=l_suppkey where s_acctbal<0)::bigint + (select count(*) from supplier where s_acctbal<0)::bigint relationships_deleted")
def change_counters(g, spark, d):
    more = g.nodes["Customer"].df.select((F.col("c_custkey") + 5000000).alias("c_custkey"))
    g2 = mutate.delete_nodes(mutate.create_nodes(g, "Customer", more), "Supplier", g.nodes["Supplier"].df.filter("s_acctbal < 0").select("s_suppkey"), detach=True)
    return spark.createDataFrame([mutate.counters(g, g2)], "nodes_created long, nodes_deleted long, relationships_created long, relationships_deleted long")


@query("select r_name, count(*) n from nation join region on r_regionkey=n_regionkey join customer on c_nationkey=n_nationkey group by 1")
def graph_from_metadata(g, spark, d):
    tables = {"region": g.nodes["Region"].df, "nation": g.nodes["Nation"].df, "customer": g.nodes["Customer"].df}
    g2 = graph_from_tables("shop", tables, {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey"}, {"nation": [("n_regionkey", "region")], "customer": [("c_nationkey", "nation")]})
    p = match(g2, "r", "region").to("HAS_NATION", "n").to("HAS_CUSTOMER", "c")
    return p.return_(F.count("*").alias("n"), by=[prop("r", "r_name").alias("r_name")])


@query("select c_mktsegment seg, count(distinct n_nationkey) n from customer join nation on n_nationkey=c_nationkey group by 1")
def nodes_from_results(g, spark, d):
    rows = match(g, "c", "Customer").to("IN_NATION", "n", "Nation").df
    g2 = Graph("found").with_nodes(nodes_from_rows(rows, "c", "c_custkey", "C"), nodes_from_rows(rows, "n", "n_nationkey", "N")).with_edges(edges_from_rows(rows, "c", "n", "IN", "C", "N"))
    return match(g2, "c", "C").to("IN", "n", "N").return_(F.count_distinct("n__key").alias("n"), by=[prop("c", "c_mktsegment").alias("seg")])


@query("""select 'unique' "constraint", 'n_name' field, (select coalesce(sum(c), 0) from (select count(*) c from nation group by n_name having count(*) > 1))::bigint "rows"
union all select 'not null', 'n_nationkey', (select count(*) from nation where n_nationkey is null) union all select 'unique', 'n_nationkey', 0 union all select 'unique', 'n_regionkey', (select sum(c) from (select count(*) c from nation group by n_regionkey having count(*) > 1))::bigint""")
def constraint_checks(g, spark, d):
    return violations(g, NodeModel("Nation", (Field("n_nationkey", "INT", primary_key=True), Field("n_name", unique=True), Field("n_regionkey", "INT", unique=True))))


# -- paths, parts of edges, parameters, plans


@query("select count(*) n, sum(len)::bigint hops, count(distinct k) paths from (select 2 len, c_custkey||'>'||o_orderkey||'>'||l_partkey k from customer join orders on o_custkey=c_custkey join lineitem on l_orderkey=o_orderkey)")
def path_variable(g, spark, d):
    p = match(g, "c", "Customer").to("PLACED", "o", edge="x").to("CONTAINS", "p", edge="y").path("way", ["c", "o", "p"], ["x", "y"])
    return p.return_(F.count("*").alias("n"), F.sum(fn.path_length("way")).alias("hops"), F.count_distinct(F.array_join(fn.path_nodes("way"), ">")).alias("paths"), by=[])


@query(f"select x.a s, count(*) n, min(x.a||','||('ADJACENT|{{'||x.a||', '||x.way||'}}')||','||x.b) least from {ADJ} x group by 1")
def path_elements(g, spark, d):
    p = match(g, "s", "Nation").hops("ADJACENT", "t", 1, 1, path="way")
    return p.return_(F.count("*").alias("n"), F.min(F.array_join(fn.elements("way"), ",")).alias("least"), by=[F.col("s__key").alias("s")])


@query("select c_mktsegment seg, count(*) n, sum(cast(round(o_totalprice*100) as bigint))::bigint cents from orders join customer on c_custkey=o_custkey group by 1")
def edge_ends(g, spark, d):
    p = opened(g, "a").to("PLACED", "b", edge="e")
    p = p.let(e__o_custkey=F.col("a__key"), e__o_orderkey=F.col("b__key")).ends("e", "c", "o")
    return p.return_(F.count("*").alias("n"), F.sum(cents(prop("o", "o_totalprice"))).alias("cents"), by=[prop("c", "c_mktsegment").alias("seg")])


@query("select 'PLACED' t, 'Customer:'||c_custkey id, count(*) n from customer join orders on o_custkey=c_custkey group by 2")
def type_and_element_id(g, spark, d):
    p = match(g, "c", "Customer").to("PLACED", "o", edge="e")
    return p.return_(F.count("*").alias("n"), by=[fn.type_of("e").alias("t"), fn.element_id("Customer", F.col("c__key")).alias("id")])


@query("select l, count(*) n from (select 'Customer,Party' l from customer union all select 'Party,Supplier' from supplier) group by 1")
def node_labels(g, spark, d):
    return match(g, "v", "Party").return_(F.count("*").alias("n"), by=[F.array_join(fn.labels("v"), ",").alias("l")])


@query("select p_partkey, case when p_size > 25 then 'p_name' else 'p_name,p_size' end ks, case when p_size > 25 then 1 else 2 end::bigint n, p_name from part")
def keys_and_properties(g, spark, d):
    small = {"p_name": prop("p", "p_name"), "p_size": F.when(prop("p", "p_size") <= 25, prop("p", "p_size"))}
    m = fn.properties(**small)
    return match(g, "p", "Part").return_(F.col("p__key").alias("p_partkey"), F.array_join(fn.keys("p_name", "p_size", of=small), ",").alias("ks"), big(F.size(m)).alias("n"), m["p_name"].alias("p_name"))


@query("select count(*) n, min(o_totalprice) low from orders where o_totalprice > 200000 and o_orderstatus in ('F', 'P')")
def parameters(g, spark, d):
    p = Parameters(least=200000.0, statuses=["F", "P"])
    found = match(g, "o", "Order").where(prop("o", "o_totalprice") > p("least"), fn.in_list(prop("o", "o_orderstatus"), p("statuses")))
    return found.return_(F.count("*").alias("n"), F.min(prop("o", "o_totalprice")).alias("low"), by=[])


@query("select x, y, row_number() over (order by case when x is not null then 0 when y is not null then 1 else 2 end, x nulls last, y nulls last)::bigint place from (select case when n_nationkey%3=0 then n_nationkey end x, case when n_nationkey%3=1 then n_name end y from nation where n_nationkey%3<2)")
def mixed_type_order(g, spark, d):
    k = F.col("n__key")
    rows = match(g, "n", "Nation").where(k % 3 < 2).return_(F.when(k % 3 == 0, k).alias("x"), F.when(k % 3 == 1, prop("n", "n_name")).alias("y"))
    return rows.withColumn("place", big(F.row_number().over(Window.orderBy(*mixed_order(("number", F.col("x")), ("text", F.col("y")))))))


@query("select count(*) n from (select distinct [p_brand, p_type] l from part)")
def distinct_lists(g, spark, d):
    p = match(g, "p", "Part").return_(F.array(prop("p", "p_brand"), prop("p", "p_type")).alias("l"), distinct=True)
    return p.agg(F.count("*").alias("n"))


@query("select a.n_nationkey::bigint k, count(*) n from nation a join nation b on b.n_regionkey=a.n_regionkey group by 1")
def call_subgraph_nodes(g, spark, d):
    """Nations that reach one another through their region: two hops in either direction."""
    two_way = Edges("IN", g.edges["IN_REGION"].df.select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.concat(F.lit("r"), "n_regionkey").alias("t")), "s", "t")
    starts = g.nodes["Nation"].df.select(F.concat(F.lit("n"), "n_nationkey").alias("k"))
    found = algorithms.call("subgraph_nodes", Graph("g").with_edges(two_way), "IN", starts, "k", direction="both", max_hops=2).filter(F.col("node").startswith("n"))
    return found.groupBy(big(F.substring("source", 2, 10).cast("int")).alias("k")).agg(F.count("*").alias("n"))


@query("""select o_orderkey, (o_orderdate + interval 14 month + interval 90061 second)::timestamp later, (hour(o_orderdate)*3600000000 + minute(o_orderdate)*60000000 + second(o_orderdate)*1000000)::bigint tod from orders""")
def functions_duration(g, spark, d):
    t = prop("o", "o_orderdate")
    later = fn.plus_duration(t, fn.duration(F.lit("P1Y2M1DT1H1M1S")))
    return match(g, "o", "Order").return_(F.col("o__key").alias("o_orderkey"), later.cast("timestamp_ntz").alias("later"), fn.time_of_day(F.date_format(t, "HH:mm:ss")).alias("tod"))


@query("""select n_nationkey::bigint k, (date '1970-01-01' + n_nationkey*100)::date::varchar d, (timestamp '1970-01-01' + to_seconds(n_nationkey*86400*3)) t, (timestamp '2024-01-01 00:00:00' + to_days(n_nationkey)) u, (n_nationkey*60000000)::bigint m from nation""")
def functions_temporal(g, spark, d):
    k = F.col("n__key").cast("bigint")
    text = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n__key").cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    clock = F.concat(F.lit("00:"), F.lpad(k.cast("string"), 2, "0"))
    utc = lambda x: x.cast("timestamp_ntz")
    return match(g, "n", "Nation").return_(k.alias("k"), fn.date_from_number(k * 100).cast("string").alias("d"), utc(fn.datetime_from_number(k * 86400 * 3)).alias("t"), utc(fn.datetime_from_text(text)).alias("u"), fn.time_of_day(clock).alias("m"))


@query("select o_orderkey, (o_custkey // 7)::bigint q, (-o_custkey // 7)::bigint m from orders")
def integer_division(g, spark, d):
    c = prop("o", "o_custkey")
    return match(g, "o", "Order").return_(F.col("o__key").alias("o_orderkey"), fn.divide(c, F.lit(7), True).alias("q"), fn.divide(-c, F.lit(7), True).alias("m"))


@query("select {'name': r_name, 'size': length(r_name)}.name nm, length(r_name)::bigint sz from region")
def map_literals(g, spark, d):
    n = prop("r", "r_name")
    m = F.struct(n.alias("name"), fn.size(n, "string").alias("size"))
    return match(g, "r", "Region").return_(m["name"].alias("nm"), fn.call("coalesce", m["size"], F.lit(0)).alias("sz"))
