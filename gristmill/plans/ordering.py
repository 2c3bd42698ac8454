"""Window, top-k and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import joins as J
from gristmill.operators import topk as K
from gristmill.operators import windows as W
from gristmill.plans.joins import EDGES, VEC, edges
from gristmill.plans.registry import query, table

#: A fixed query vector: 64 values by rule, so that the SQL can spell it.
QUERY = [((7 * i) % 13 - 6) / 10 for i in range(64)]
QUERY_SQL = "[" + ", ".join(str(x) for x in QUERY) + "]::DOUBLE[]"
DIST = f"round(1 - list_dot_product(v, {QUERY_SQL}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({QUERY_SQL}, {QUERY_SQL}))), 6)"


@query("w01_dense_rank_list", f"SELECT vec_id, dist, row_number() OVER (ORDER BY dist, vec_id) AS rank FROM (SELECT vec_id, {DIST} AS dist FROM {VEC} ORDER BY dist, vec_id LIMIT 20)")
def w01(spark, d):
    top = K.nearest(table(spark, d, "embeddings"), "embedding", QUERY, 20, "vec_id")
    return K.ranked(top, [F.col("dist"), F.col("vec_id")], 20)


@query("w02_lexical_rank_list", "SELECT doc_id, hits, row_number() OVER (ORDER BY hits DESC, doc_id) AS rank FROM (SELECT doc_id, (length(text) - length(replace(text, ' the ', ''))) // 5 AS hits FROM documents ORDER BY hits DESC, doc_id LIMIT 20)")
def w02(spark, d):
    hits = ((F.length("text") - F.length(F.replace("text", F.lit(" the "), F.lit("")))) / 5).cast("bigint")
    return K.ranked(table(spark, d, "documents").select("doc_id", hits.alias("hits")), [F.col("hits").desc(), F.col("doc_id")], 20)


@query("w03_partition_first", "SELECT l_partkey, l_suppkey, n FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1")
def w03(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return W.keep_first(n, ["l_partkey"], [F.col("n").desc(), F.col("l_suppkey")])


@query("w04_stratified_sample", "SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) <= 6")
def w04(spark, d):
    return K.per_group(table(spark, d, "documents"), ["source", "lang"], [F.col("n_chars").desc(), F.col("doc_id")], 6).select("doc_id", "source", "lang")


@query("w05_round_robin", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) ORDER BY r, source LIMIT 50")
def w05(spark, d):
    return W.round_robin(table(spark, d, "documents"), "source", [F.col("n_chars").desc(), F.col("doc_id")], 50).select("doc_id", "source")


@query("w06_keep_latest", "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w06(spark, d):
    return W.keep_first(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "ts")


@query("w07_fold_total", "SELECT o_custkey, o_orderkey, total FROM (SELECT o_custkey, o_orderkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w07(spark, d):
    return W.fold_total(table(spark, d, "orders").withColumn("total", F.lit(1).cast("bigint")), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], "total").select("o_custkey", "o_orderkey", "total")


@query("w08_mark_duplicates", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM documents")
def w08(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return W.mark_repeats(rows, ["h"], [F.col("doc_id")], "status", F.lit("ok"), "duplicate").select("doc_id", "status")


_COSX = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query("w09_drop_near_keeper", f"SELECT a.vec_id FROM {VEC} a JOIN (SELECT * FROM {VEC} QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) b ON a.label = b.label WHERE a.vec_id = b.vec_id OR round({_COSX}, 6) <= 0.2")
def w09(spark, d):
    from gristmill.functions import vectors as V

    rows = table(spark, d, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))
    keeper = W.keep_first(rows, ["label"], [F.col("vec_id")]).select("label", F.col("vec_id").alias("k"), F.col("v").alias("kv"))
    return rows.join(keeper, "label").where((F.col("vec_id") == F.col("k")) | (F.round(V.cosine(F.col("v"), F.col("kv")), 6) <= 0.2)).select("vec_id")


@query("w10_first_seen", "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def w10(spark, d):
    return W.keep_first(table(spark, d, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("w11_trailing_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def w11(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("second", "ts").alias("ts"))
    return W.trailing_count(e, "user_id", "ts", 3600).select("event_id", "n")


@query("w12_weighted_recent", "SELECT user_id, round(least(sum(w * value) / sum(w), 40.0), 6) AS score FROM (SELECT user_id, value, CASE row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 WHEN 4 THEN 0.4 WHEN 5 THEN 0.2 END AS w FROM events) WHERE w IS NOT NULL GROUP BY 1")
def w12(spark, d):
    return W.weighted_recent(table(spark, d, "events"), "user_id", [F.col("event_id").desc()], "value", [1.0, 0.8, 0.6, 0.4, 0.2], 40.0)


@query("w13_prior_passes", "SELECT conv_id, turn, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_passes, coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS is_review FROM conversations")
def w13(spark, d):
    return W.prior(table(spark, d, "conversations"), "conv_id", [F.col("turn")], F.col("role") == "user", "prior_passes").select("conv_id", "turn", "prior_passes", (F.col("prior_passes") > 0).alias("is_review"))


@query("w14_run_delta", "SELECT user_id, day, n, n - lag(n) OVER (PARTITION BY user_id ORDER BY day) AS delta FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def w14(spark, d):
    n = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return W.delta(n, ["user_id"], [F.col("day")], "n")


@query("l01_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def l01(spark, d):
    return K.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 25, 50)


@query("l02_chosen_sort", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 30")
def l02(spark, d):
    return K.sort_by(table(spark, d, "documents").select("doc_id", "n_chars"), {"size": F.col("n_chars"), "id": F.col("doc_id")}, "size", True, "doc_id").limit(30)


@query("l03_nulls_last", "SELECT doc_id, q FROM (SELECT doc_id, nullif(lang, 'de') AS q FROM documents) ORDER BY q ASC NULLS LAST, doc_id")
@query("l03_nulls_last_whole", "SELECT doc_id, q FROM (SELECT doc_id, nullif(lang, 'de') AS q FROM documents) ORDER BY q ASC NULLS LAST, doc_id")
def l03_whole(spark, d):
    return table(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("de")).alias("q")).orderBy(F.col("q").asc_nulls_last(), "doc_id")


@query("l04_by_array_length", "SELECT o_custkey, len(list(o_orderkey))::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def l04(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("keys"))
    return lists.select("o_custkey", F.size("keys").cast("bigint").alias("n")).orderBy(F.col("n").desc(), "o_custkey").limit(20)


@query("ku_vector_topk", f"SELECT vec_id, label, {DIST} AS dist FROM {VEC} WHERE label = 3 ORDER BY dist, vec_id LIMIT 10")
def l05(spark, d):
    return K.nearest(table(spark, d, "embeddings").where("label = 3"), "embedding", QUERY, 10, "vec_id", ["label"])


@query("l06_nearest_one", f"SELECT vec_id, {DIST} AS dist FROM {VEC} ORDER BY dist, vec_id LIMIT 1")
def l06(spark, d):
    return K.nearest(table(spark, d, "embeddings"), "embedding", QUERY, 1, "vec_id")


@query("l07_filtered_knn", f"SELECT vec_id, label, {DIST} AS dist FROM {VEC} WHERE label IN (1, 2, 5) AND vec_id % 3 <> 0 ORDER BY dist, vec_id LIMIT 15")
def l07(spark, d):
    return K.nearest(table(spark, d, "embeddings").where("label in (1, 2, 5) and vec_id % 3 <> 0"), "embedding", QUERY, 15, "vec_id", ["label"])


@query("l08_near_misses", f"WITH s AS (SELECT vec_id, label, {DIST} AS dist FROM {VEC}) SELECT vec_id, label, dist, 'item' AS kind FROM s WHERE dist <= 0.7 UNION ALL SELECT vec_id, label, dist, 'near_miss' FROM s WHERE label NOT IN (SELECT label FROM s WHERE dist <= 0.7) QUALIFY row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) = 1")
def l08(spark, d):
    rows = table(spark, d, "embeddings")
    from gristmill.functions import vectors as V

    s = rows.select("vec_id", "label", F.round(1 - V.cosine(V.as_double(F.col("embedding")), V.literal(QUERY)), 6).alias("dist"))
    w = Window.partitionBy("label")
    s = s.withColumn("best", F.min("dist").over(w)).withColumn("r", F.row_number().over(w.orderBy("dist", "vec_id")))
    kind = F.when(F.col("dist") <= 0.7, "item").when((F.col("best") > 0.7) & (F.col("r") == 1), "near_miss")
    return s.withColumn("kind", kind).where("kind is not null").select("vec_id", "label", "dist", "kind")


@query("l09_capped_with_drop_count", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) - 40 AS dropped FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def l09(spark, d):
    top, dropped = K.capped(table(spark, d, "orders").where("o_totalprice > 1000"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 40)
    return top.select("o_orderkey", F.lit(dropped).cast("bigint").alias("dropped"))


@query("l10_ghost_filter_topk", f"SELECT vec_id, {DIST} AS dist FROM {VEC} WHERE vec_id IN (SELECT doc_id FROM labels) ORDER BY dist, vec_id LIMIT 10")
def l10(spark, d):
    live = table(spark, d, "embeddings").join(table(spark, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return K.nearest(live, "embedding", QUERY, 10, "vec_id")


@query("l11_never_served_first", "SELECT c.c_custkey, o.last FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey ORDER BY o.last ASC NULLS FIRST, c.c_custkey LIMIT 40")
def l11(spark, d):
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    return table(spark, d, "customer").select("c_custkey").join(last, "c_custkey", "left").orderBy(F.col("last").asc_nulls_first(), "c_custkey").limit(40)


@query("l12_degree_cap")
def l12(spark, d):
    e = edges(spark, d).withColumn("g", F.pmod(F.col("src"), F.lit(10)))
    return K.degree_capped(e, "g", "src", "dst", "w", 2)


@query("l13_first_match", "SELECT user_id, event_id, state FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'due' WHEN event_type = 'view' THEN 'fresh' WHEN event_type = 'click' THEN 'waiting' ELSE 'done' END AS state, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 ELSE 3 END AS p FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p, event_id) = 1")
def l13(spark, d):
    state = F.when(F.col("event_type") == "error", "due").when(F.col("event_type") == "view", "fresh").when(F.col("event_type") == "click", "waiting").otherwise("done")
    rows = table(spark, d, "events").select("user_id", "event_id", state.alias("state"))
    rank = F.array_position(F.array(*[F.lit(x) for x in ("due", "fresh", "waiting", "done")]), F.col("state"))
    return rows.groupBy("user_id").agg(F.min(F.struct(rank.alias("p"), "event_id", "state")).alias("x")).select("user_id", "x.event_id", "x.state")


@query("l14_review_queue", "SELECT event_id, ts + INTERVAL 3 DAY AS next_review FROM events WHERE event_type = 'view' AND ts + INTERVAL 3 DAY <= TIMESTAMP '2024-01-10 00:00:00' ORDER BY 2, 1 LIMIT 100")
def l14(spark, d):
    due = table(spark, d, "events").where("event_type = 'view'").select("event_id", (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("next_review"))
    return due.where(F.col("next_review") <= F.lit("2024-01-10").cast("timestamp_ntz")).orderBy("next_review", "event_id").limit(100)


@query("l15_best_of_lists", "SELECT id, max(score) AS score FROM (SELECT l_partkey AS id, max(l_quantity) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 UNION ALL SELECT l_partkey, max(l_quantity) FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) GROUP BY 1")
def l15(spark, d):
    lines = table(spark, d, "lineitem")
    lists = [lines.where(c).groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_quantity").alias("score")) for c in ("l_returnflag = 'R'", "l_linestatus = 'O'")]
    return lists[0].unionByName(lists[1]).groupBy("id").agg(F.max("score").alias("score"))


@query("l16_hash_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 25")
def l16(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7")).cast("binary")), "doc_id").limit(25)


@query("l17_quota_backfill", "SELECT doc_id, pri FROM (SELECT doc_id, 0 AS pri, n_chars FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT doc_id, 1, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) ORDER BY pri, n_chars DESC, doc_id LIMIT 60")
def l17(spark, d):
    flags = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(0).alias("f")).distinct()
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(flags, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("f", F.lit(1)).alias("pri"))
    return rows.orderBy("pri", F.col("n_chars").desc(), "doc_id").limit(60).select("doc_id", "pri")


@query("l18_top_concepts", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey = 5 GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 12")
def l18(spark, d):
    n = table(spark, d, "lineitem").where("l_suppkey = 5").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "l_partkey").limit(12)


@query("l19_latest_payload", "SELECT u.user_id, coalesce(arg_max(json_extract_string(e.props, '$.k'), e.event_id), '0') AS k FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = 'purchase' GROUP BY 1")
def l19(spark, d):
    e = table(spark, d, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by(F.get_json_object("props", "$.k"), "event_id").alias("k"))
    return e.select("user_id").distinct().join(last, "user_id", "left").select("user_id", F.coalesce("k", F.lit("0")).alias("k"))


@query("l20_title_fallback", "SELECT p_partkey, 1.0::DOUBLE AS score FROM part WHERE p_name ILIKE '%ring%' ORDER BY p_partkey LIMIT 20")
def l20(spark, d):
    from gristmill.operators.predicates import contains_ci

    return table(spark, d, "part").where(contains_ci("p_name", "ring")).select("p_partkey", F.lit(1.0).alias("score")).orderBy("p_partkey").limit(20)


@query("u01_union_pairs", f"SELECT DISTINCT a, b FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM {EDGES} WHERE w >= 3 UNION ALL SELECT least(src, dst), greatest(src, dst) FROM {EDGES} WHERE src < 20)")
def u01(spark, d):
    e = edges(spark, d)
    return e.where("w >= 3").select(*J.pair("src", "dst")).unionByName(e.where("src < 20").select(*J.pair("src", "dst"))).distinct()


@query("u02_difference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def u02(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti")


@query("u03_insert_ignore", "SELECT doc_id, 'base' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE n_chars > 3000 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def u03(spark, d):
    from gristmill.sources.tables import insert_ignore

    base = table(spark, d, "labels").select("doc_id", F.lit("base").alias("origin"))
    return insert_ignore(base, table(spark, d, "documents").where("n_chars > 3000").select("doc_id", F.lit("new").alias("origin")), ["doc_id"])


@query("u04_timeline", "SELECT month, kind, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, 'order' AS kind FROM orders UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), 'shipment' FROM lineitem UNION ALL SELECT strftime(ts, '%Y-%m'), 'event' FROM events) GROUP BY 1, 2")
def u04(spark, d):
    sources = {"order": ("orders", "o_orderdate"), "shipment": ("lineitem", "l_shipdate"), "event": ("events", "ts")}
    out = None
    for kind, (name, ts) in sources.items():
        one = table(spark, d, name).select(F.date_format(ts, "yyyy-MM").alias("month"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("month", "kind").agg(F.count("*").alias("n"))


_TOKENS = "(SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS t FROM benchmark)"
_TOKEN_SETS = f"SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t))::BIGINT AS common, len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) = 0 AS subset FROM {_TOKENS} a JOIN {_TOKENS} b ON a.item_id < b.item_id WHERE len(list_intersect(a.t, b.t)) > 0"


@query("u05_token_sets", _TOKEN_SETS)
def u05(spark, d):
    """Pairs with a common token: they meet by token, not each with each."""
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    held = t.select("item_id", F.size("t").alias("size"), F.explode("t").alias("w"))
    both = held.alias("x").join(held.alias("y"), F.expr("x.w = y.w and x.item_id < y.item_id"))
    n = both.groupBy(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.col("x.size").alias("size")).agg(F.count("*").alias("common"))
    return n.select("a", "b", "common", (F.col("common") == F.col("size")).alias("subset"))


@query("u05_token_sets_whole", "SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.t, b.t))::BIGINT AS common, len(list_filter(a.t, lambda x: NOT list_contains(b.t, x))) = 0 AS subset FROM (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS t FROM benchmark) a JOIN (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS t FROM benchmark) b ON a.item_id < b.item_id")
def u05_whole(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    both = t.alias("x").join(t.alias("y"), F.expr("x.item_id < y.item_id"))
    return both.select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.size(F.array_intersect("x.t", "y.t")).cast("bigint").alias("common"), (F.size(F.array_except("x.t", "y.t")) == 0).alias("subset"))


@query("u06_except", "SELECT event_type FROM (VALUES ('view'), ('refund'), ('error')) t(event_type) EXCEPT SELECT event_type FROM events")
def u06(spark, d):
    return spark.createDataFrame([("view",), ("refund",), ("error",)], "event_type string").subtract(table(spark, d, "events").select("event_type"))


@query("u07_priority_merge", f"SELECT a, b, pool FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, 1 AS pool FROM {EDGES} WHERE w >= 3 UNION ALL SELECT least(src, dst), greatest(src, dst), 2 FROM {EDGES} WHERE src < 30 UNION ALL SELECT least(src, dst), greatest(src, dst), 3 FROM {EDGES} WHERE dst > -4) WHERE a > -60 QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY pool) = 1")
def u07(spark, d):
    e = edges(spark, d)
    pools = [e.where(c).select(*J.pair("src", "dst"), F.lit(n).alias("pool")) for n, c in ((1, "w >= 3"), (2, "src < 30"), (3, "dst > -4"))]
    seeds = e.select(*J.pair("src", "dst")).where("a <= -60")
    return W.keep_first(pools[0].unionByName(pools[1]).unionByName(pools[2]).join(seeds, ["a", "b"], "left_anti"), ["a", "b"], [F.col("pool")])
