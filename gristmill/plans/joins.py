"""Join queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import joins as J
from gristmill.operators import quotes as Q
from gristmill.plans.registry import query, table

#: Documents stand for items and lines for links: an order is an item, its parts are the concepts.
COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
VEC = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@query("j01_left_dimension", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def j01(spark, d):
    dim = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(dim, "o_custkey", "left").select("o_orderkey", "c_name")


@query("j02_left_labels", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j02(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")


@query("j03_left_title", "SELECT l.l_orderkey, l.l_linenumber, p.p_name FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_linenumber = 1")
def j03(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey").join(names, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_name")


@query("j04_composite_condition", "SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_shipdate > o.o_orderdate")
def j04(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    return table(spark, d, "orders").join(lines, "o_orderkey").where("l_shipdate > o_orderdate").select("o_orderkey", "l_linenumber")


@query("j05_filter_in_on", "SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R'")
def j05(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")


@query("j06_double_lookup", "SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE l.l_quantity > 45")
def j06(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 45")
    return lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_name", "s_name")


def edges(spark, d):
    """Customer-supplier trade as a graph: customers are 1.., suppliers -1 and below; weight: number of lines."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return orders.join(lines, "o_orderkey").groupBy(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).agg(F.count("*").alias("w"))


EDGES = "(SELECT o_custkey AS src, -l_suppkey - 1 AS dst, count(*) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query("j07_other_end", f"SELECT e.src, e.dst, n.c_name FROM (SELECT src, dst, CASE WHEN src = 7 THEN dst ELSE src END AS other FROM {EDGES} WHERE src = 7 OR dst = -3) e JOIN customer n ON n.c_custkey = e.other")
def j07(spark, d):
    near = edges(spark, d).where("src = 7 or dst = -3").withColumn("other", F.when(F.col("src") == 7, F.col("dst")).otherwise(F.col("src")))
    return near.join(table(spark, d, "customer").select(F.col("c_custkey").alias("other"), "c_name"), "other").select("src", "dst", "c_name")


@query("j08_either_end", f"SELECT DISTINCT src, dst, w FROM {EDGES} WHERE src IN (1, 2, 3) OR dst IN (-1, -2)")
def j08(spark, d):
    ids = spark.createDataFrame([(1,), (2,), (3,), (-1,), (-2,)], "id bigint")
    return J.either_end(edges(spark, d), ids, "src", "dst", "id")


@query("j09_shared_attribute_pairs", "SELECT x.k AS a, y.k AS b, count(*) AS shared FROM (SELECT DISTINCT l_orderkey AS k, l_partkey AS v FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey AS k, l_partkey AS v FROM lineitem) y ON x.v = y.v AND x.k < y.k GROUP BY 1, 2")
def j09(spark, d):
    return J.shared_attribute_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("j10_cross_chunk", "SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.n_chars = y.n_chars AND x.doc_id < y.doc_id AND regexp_extract(x.source, 'src([0-9]+)', 1) <> regexp_extract(y.source, 'src([0-9]+)', 1)")
def j10(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.regexp_extract("source", "src([0-9]+)", 1).alias("chunk"))
    return rows.alias("x").join(rows.alias("y"), F.expr("x.n_chars = y.n_chars and x.doc_id < y.doc_id and x.chunk <> y.chunk")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


@query("j11_similar_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS sim FROM {VEC} a JOIN {VEC} b ON a.vec_id < b.vec_id WHERE round({COS}, 6) >= 0.4")
def j11(spark, d):
    return J.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4)


@query("j12_knn_pairs", f"SELECT DISTINCT least(q, n) AS a, greatest(q, n) AS b, sim FROM (SELECT a.vec_id AS q, b.vec_id AS n, round({COS}, 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS r FROM {VEC} a JOIN {VEC} b ON a.vec_id <> b.vec_id) WHERE r <= 4 AND sim >= 0.3")
def j12(spark, d):
    rows = table(spark, d, "embeddings")
    return J.unordered(J.knn(rows, rows, "vec_id", "embedding", 4).where("sim >= 0.3"), "q", "n", "sim")


@query("j13_knn_cross_group", f"SELECT q, n, sim, r AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS n, round({COS}, 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS r FROM {VEC} a JOIN {VEC} b ON a.vec_id <> b.vec_id AND a.label <> b.label) WHERE r <= 3")
def j13(spark, d):
    rows = table(spark, d, "embeddings")
    return J.knn(rows, rows, "vec_id", "embedding", 3, group="label").withColumn("rank", F.col("rank").cast("bigint"))


@query("j14_same_group_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 6) AS sim FROM {VEC} a JOIN {VEC} b ON a.vec_id < b.vec_id AND a.label = b.label ORDER BY sim DESC, a, b LIMIT 50")
def j14(spark, d):
    return J.best_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 50, same="label")


@query("j15_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j15(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("j16_no_edge", f"SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT src FROM {EDGES}) AND c_custkey NOT IN (SELECT dst FROM {EDGES})")
def j16(spark, d):
    return J.no_end(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), edges(spark, d), "id", "src", "dst")


@query("j17_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j18_anti_by_left_join", "SELECT p.p_partkey FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_quantity > 49 WHERE l.l_orderkey IS NULL")
def j18(spark, d):
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("j19_unlinked_pairs", f"SELECT a, b FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {EDGES} WHERE w >= 2) WHERE (a, b) NOT IN (SELECT (least(src, dst), greatest(src, dst)) FROM {EDGES} WHERE w = 2)")
def j19(spark, d):
    e = edges(spark, d)
    return e.where("w >= 2").select(*J.pair("src", "dst")).distinct().join(e.where("w = 2").select(*J.pair("src", "dst")), ["a", "b"], "left_anti")


@query("j20_full_outer_ranks", "WITH x AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS d_rank FROM customer), y AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_name DESC, c_custkey) AS l_rank FROM customer) SELECT id, d_rank, l_rank FROM (SELECT * FROM x WHERE d_rank <= 20) FULL JOIN (SELECT * FROM y WHERE l_rank <= 20) USING (id)")
def j20(spark, d):
    from gristmill.operators.topk import ranked

    c = table(spark, d, "customer")
    x = ranked(c, [F.col("c_acctbal").desc(), F.col("c_custkey")], 20, "d_rank").select(F.col("c_custkey").alias("id"), "d_rank")
    y = ranked(c, [F.col("c_name").desc(), F.col("c_custkey")], 20, "l_rank").select(F.col("c_custkey").alias("id"), "l_rank")
    return x.join(y, "id", "full_outer")


@query("j21_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def j21(spark, d):
    return J.with_count(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n")


@query("j22_count_threshold", "SELECT * FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) WHERE n >= 12")
def j22(spark, d):
    return j21(spark, d).where("n >= 12")


@query("j23_best_child", "SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o LEFT JOIN (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_quantity DESC, l_linenumber) AS r FROM lineitem) l ON l.l_orderkey = o.o_orderkey AND r = 1")
def j23(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.best_child(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", [(F.col("l_returnflag") == "R").desc(), F.col("l_quantity").desc(), F.col("l_linenumber")], ["l_linenumber", "l_quantity"])


@query("j24_bridge_lists", "SELECT o_orderkey, array_to_string(list_sort(list(p_name)), '|') AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1")
def j24(spark, d):
    names = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).join(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return table(spark, d, "orders").select("o_orderkey").join(names, "o_orderkey").groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "|").alias("parts"))


@query("j25_edges_within", f"SELECT src, dst, w FROM {EDGES} WHERE src IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND dst IN (SELECT -s_suppkey - 1 FROM supplier WHERE s_acctbal > 0)")
def j25(spark, d):
    ids = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id")).unionByName(table(spark, d, "supplier").where("s_acctbal > 0").select((-F.col("s_suppkey") - 1).alias("id")))
    return J.both_ends(edges(spark, d), ids, "src", "dst", "id")


@query("j26_siblings", "SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_name <> y.p_name AND x.p_partkey < y.p_partkey")
def j26(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return p.alias("x").join(p.alias("y"), F.expr("x.p_brand = y.p_brand and x.p_size = y.p_size and x.p_name <> y.p_name and x.p_partkey < y.p_partkey")).select(F.col("x.p_partkey").alias("a"), F.col("y.p_partkey").alias("b"))


@query("j27_semi_child", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09)")
def j27(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("j28_edges_between_nodes", f"SELECT src, dst FROM {EDGES} WHERE src IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND dst IN (SELECT -s_suppkey - 1 FROM supplier WHERE s_nationkey < 12)")
def j28(spark, d):
    nodes = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")).unionByName(table(spark, d, "supplier").where("s_nationkey < 12").select((-F.col("s_suppkey") - 1).alias("id")))
    return J.both_ends(edges(spark, d), nodes, "src", "dst", "id").select("src", "dst")


_PARTS = "(SELECT p_partkey, p_brand, 1900 + p_size AS y0, CASE WHEN p_partkey % 7 <> 0 THEN 1900 + p_size + p_partkey % 5 END AS y1 FROM part)"


@query("j29_interval_relation", f"SELECT rel, count(*) AS n FROM (SELECT CASE WHEN x.y1 IS NULL OR y.y1 IS NULL THEN 'unknown' WHEN greatest(x.y0, y.y0) - least(x.y1, y.y1) <= 5 THEN 'overlap' WHEN greatest(x.y0, y.y0) - least(x.y1, y.y1) <= 20 THEN 'near' ELSE 'far' END AS rel FROM {_PARTS} x JOIN {_PARTS} y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey) GROUP BY 1")
def j29(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") + 1900).alias("y0"), F.expr("case when p_partkey % 7 <> 0 then 1900 + p_size + p_partkey % 5 end").alias("y1"))
    relation = J.interval_relation(F.col("x.y0"), F.col("x.y1"), F.col("y.y0"), F.col("y.y1"))
    return J.pair_counts(p, "p_brand", ["y0", "y1"], relation, "p_partkey").select(F.col("verdict").alias("rel"), F.col("n").cast("bigint").alias("n"))


@query("j30_pairwise_rules", "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN x.p_type = y.p_type AND x.p_size = y.p_size THEN 'same' WHEN x.p_type = y.p_type OR abs(x.p_size - y.p_size) <= 2 THEN 'maybe' ELSE 'different' END AS verdict FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey) GROUP BY 1")
def j30(spark, d):
    verdict = F.expr("case when x.p_type = y.p_type and x.p_size = y.p_size then 'same' when x.p_type = y.p_type or abs(x.p_size - y.p_size) <= 2 then 'maybe' else 'different' end")
    return J.pair_counts(table(spark, d, "part"), "p_brand", ["p_type", "p_size"], verdict).select("verdict", F.col("n").cast("bigint").alias("n"))


@query("j31_edge_tier", f"SELECT e.src, e.dst, coalesce(t.tier, 'none') AS tier FROM {EDGES} e LEFT JOIN (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN w >= 4 THEN 'strong' WHEN w >= 3 THEN 'medium' ELSE 'weak' END AS tier FROM {EDGES} WHERE w >= 2) t ON t.a = least(e.src, e.dst) AND t.b = greatest(e.src, e.dst)")
def j31(spark, d):
    e = edges(spark, d)
    tiers = e.where("w >= 2").select(*J.pair("src", "dst"), F.when(F.col("w") >= 4, "strong").when(F.col("w") >= 3, "medium").otherwise("weak").alias("tier"))
    return e.select("src", "dst", *J.pair("src", "dst")).join(tiers, ["a", "b"], "left").select("src", "dst", F.coalesce("tier", F.lit("none")).alias("tier"))


@query("j32_new_pairs", f"SELECT DISTINCT least(a.vec_id, b.vec_id) AS a, greatest(a.vec_id, b.vec_id) AS b, round({COS}, 6) AS sim FROM {VEC} a JOIN {VEC} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND round({COS}, 6) >= 0.35")
def j32(spark, d):
    rows = table(spark, d, "embeddings")
    return J.new_pairs(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 0.35)


@query("j33_quote_located", "SELECT i.item_id, d.doc_id FROM (SELECT item_id, text AS q FROM benchmark) i JOIN documents d ON contains(d.text, i.q) QUALIFY row_number() OVER (PARTITION BY i.item_id ORDER BY length(i.q) DESC, d.doc_id) = 1")
def j33(spark, d):
    texts, quotes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return Q.located(texts, quotes).groupBy(F.col("quote_id").alias("item_id")).agg(F.min("id").alias("doc_id"))


_SPANS = "(SELECT p_partkey AS id, p_retailprice::DOUBLE AS a, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice::DOUBLE + p_size / 100 END AS b FROM part)"


@query("j29_band_join", f"SELECT x.id AS x, y.id AS y, CASE WHEN greatest(x.a, y.a) - least(x.b, y.b) <= 0.05 THEN 'overlap' ELSE 'near' END AS relation FROM {_SPANS} x JOIN {_SPANS} y ON x.id < y.id AND greatest(x.a, y.a) - least(x.b, y.b) <= 0.2 AND x.b IS NOT NULL AND y.b IS NOT NULL")
def j29_band(spark, d):
    """Price spans of parts as intervals: overlap within 0.05, near within 0.2; no equal key."""
    price = F.col("p_retailprice").cast("double")
    spans = table(spark, d, "part").select(F.col("p_partkey").alias("id"), price.alias("start"), F.when(F.col("p_partkey") % 7 != 0, price + F.col("p_size") / 100).alias("end"))
    near = J.band_pairs(spans, "id", 0.2, 0.5)
    return near.select(F.col("x.id").alias("x"), F.col("y.id").alias("y"), J.interval_relation(F.col("x.start"), F.col("x.end"), F.col("y.start"), F.col("y.end"), 0.05, 0.2).alias("relation"))


@query("j34_three_counts", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_done, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS n_large FROM customer")
def j34(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0)


@query("j35_not_processed", "SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT DISTINCT doc_id FROM labels)")
def j35(spark, d):
    return table(spark, d, "benchmark").select("item_id").join(table(spark, d, "labels").select(F.col("doc_id").alias("item_id")), "item_id", "left_anti")
