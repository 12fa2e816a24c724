"""Queries beyond the library's own operators: the star schema, windows of event time, and relational forms; model and reference queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import models as M
from foliant.operators import references as R
from foliant.session import table
from foliant.sources import documents as D
from foliant.sources import views as V


def _t(s, d, *names):
    return [table(s, d, n) for n in names]


def q1(s, d):
    (l,) = _t(s, d, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


def q3(s, d):
    c, o, l = _t(s, d, "customer", "orders", "lineitem")
    joined = c.where("c_mktsegment = 'BUILDING'").join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    top = joined.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return top.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def q5(s, d):
    c, o, l, su, n, r = _t(s, d, "customer", "orders", "lineitem", "supplier", "nation", "region")
    joined = r.where("r_name = 'ASIA'").join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(su, F.col("s_nationkey") == F.col("n_nationkey")).join(l, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def q6(s, d):
    (l,) = _t(s, d, "lineitem")
    return l.where("l_discount between 0.05 and 0.07 and l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


def sliding(s, d):
    (e,) = _t(s, d, "events")
    return e.groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def session_30m(s, d):
    (e,) = _t(s, d, "events")
    return e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first")).select("user_id", "first", "n")


def rank_family(s, d):
    (o,) = _t(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.select("o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.ntile(4).over(w).cast("long").alias("tile"), F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("step"))


def asof_last_event(s, d):
    """For every order of a user the last event before an hour of the day: a union in time order carries it forward."""
    (e,) = _t(s, d, "events")
    probes = e.select("user_id", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), F.col("event_id").alias("probe"), F.lit(None).cast("long").alias("event_id"))
    both = e.select("user_id", "ts", F.lit(None).cast("long").alias("probe"), "event_id").unionByName(probes)
    w = Window.partitionBy("user_id").orderBy("ts", F.col("probe").isNotNull().cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("last", F.last("event_id", ignorenulls=True).over(w)).where("probe is not null").select("probe", "last")


def range_join(s, d):
    """How many items' prices lie in the band of each part's price: those below its high end less those below its low end.

    Items are counted by price first, and ends by the part's price, so copies fold; in each cell of prices that a band
    reaches, the items below an end are a running sum in order of price. No item meets a part.
    """
    p, l = _t(s, d, "part", "lineitem")
    cell, finite = lambda c: F.floor(c / 200), lambda c: F.abs(c) < float("inf")
    prices = l.where(finite(F.col("l_extendedprice"))).groupBy(F.col("l_extendedprice").alias("v")).agg(F.count(F.lit(1)).alias("items"))
    low = F.col("price") * 10
    bands = p.select(F.col("p_retailprice").alias("price")).where(finite(low)).distinct().withColumn("cell", F.explode(F.sequence(cell(low), cell(low + 200))))
    ends = bands.select("price", "cell", F.inline(F.array(F.struct(low.alias("v"), F.lit(-1).alias("sign")), F.struct((low + 200).alias("v"), F.lit(1).alias("sign")))))
    both = ends.withColumn("items", F.lit(0).cast("long")).unionByName(prices.withColumn("cell", cell(F.col("v"))), allowMissingColumns=True)
    w = Window.partitionBy("cell").orderBy("v", F.col("sign").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = both.withColumn("below", F.sum("items").over(w)).where("sign is not null")
    counts = below.groupBy(F.col("price").alias("p_retailprice")).agg(F.sum(F.col("sign") * F.col("below")).alias("n")).where("n > 0")
    return p.join(counts, "p_retailprice").groupBy("p_partkey").agg(F.sum("n").alias("n"))


def reference_entries(s, d):
    t = table(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return R.reference_entries(t.select("paper_id", "ord", F.concat(F.lit("["), (F.col("ord") + 1).cast("string"), F.lit("] "), "line").alias("text")))


def model_channel(s, d):
    b = V.blocks(s, d).where("type = 'p'").select("paper_id", "ord", "en")
    return M.translated(b, "en", M.stub).select("paper_id", "ord", "state", "tries", "tokens")


def guarded_edit(s, d):
    blocks = V.blocks(s, d).select("paper_id", "ord", F.col("en").alias("old"))
    new = F.when(F.col("ord") % 4 == 0, F.col("old")).when(F.col("ord") % 4 == 1, F.reverse("old")).when(F.col("ord") % 4 == 2, F.replace("old", F.lit("e"), F.lit("é"))).otherwise("")
    return blocks.select("paper_id", "ord", M.change_verdict(F.col("old"), new).alias("verdict"))


QUERIES = {
    "ext_tpch_q1": q1,
    "ext_tpch_q3": q3,
    "ext_tpch_q5": q5,
    "ext_tpch_q6": q6,
    "ext_tumbling_hour": lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n"),
    "ext_sliding": sliding,
    "ext_session_30m": session_30m,
    "ext_rollup": lambda s, d: table(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")),
    "ext_cube": lambda s, d: table(s, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n")),
    "ext_grouping_sets": lambda s, d: table(s, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")),
    "ext_rank_family": rank_family,
    "ext_set_ops": lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))).exceptAll(table(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("k"))),
    "ext_semi_anti": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"),
    "ext_range_join": range_join,
    "ext_asof_last_event": asof_last_event,
    "ext_exact_dup_docs": lambda s, d: table(s, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"),
    "ext_approx_distinct": lambda s, d: table(s, d, "events").agg(F.approx_count_distinct("user_id", 0.01).alias("users")),
    "reference_entries": reference_entries,
    "model_channel": model_channel,
    "guarded_edit": guarded_edit,
    "doc_json_round_trip": lambda s, d: D.from_json(D.to_json(V.blocks(s, d))).select("paper_id", "ord", "id", "type", "en"),
}

ORACLES = {
    "ext_tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "ext_tpch_q3": "SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "ext_tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "ext_tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "ext_tumbling_hour": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "ext_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start, event_type FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type FROM events) GROUP BY ALL",
    "ext_session_30m": "SELECT user_id, min(ts) AS first, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
    "ext_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "ext_cube": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "ext_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "ext_rank_family": "SELECT o_orderkey, row_number() OVER w AS rn, ntile(4) OVER w AS tile, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS step FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "ext_set_ops": "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3",
    "ext_semi_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "ext_range_join": "SELECT p_partkey, count(*) AS n FROM part JOIN lineitem ON l_extendedprice >= p_retailprice * 10 AND l_extendedprice < p_retailprice * 10 + 200 GROUP BY p_partkey",
    "ext_asof_last_event": "SELECT p.event_id AS probe, e.event_id AS last FROM (SELECT user_id, ts + INTERVAL 1 HOUR AS at, event_id FROM events) p ASOF JOIN events e ON e.user_id = p.user_id AND e.ts <= p.at",
    "ext_exact_dup_docs": "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "model_channel": V.with_(V.BLOCKS) + "SELECT paper_id, ord, CASE WHEN length(en) % 7 = 0 THEN 'needs_review' ELSE 'mt' END AS state, CASE WHEN length(en) % 7 = 0 THEN 3 ELSE 1 END AS tries, (length(en) // 4 + 1) * CASE WHEN length(en) % 7 = 0 THEN 3 ELSE 1 END AS tokens FROM blocks WHERE type = 'p'",
    "doc_json_round_trip": V.with_(V.BLOCKS) + "SELECT paper_id, ord, id, type, en FROM blocks",
}
