"""Aggregation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import aggregates as A
from gristmill.plans.joins import EDGES, edges
from gristmill.plans.registry import query, table


@query("a01_overview", "SELECT count(*) AS n, count(*) FILTER (WHERE n_chars > 1000) AS n_long, coalesce(sum(n_chars - 1) FILTER (WHERE lang = 'de'), 0)::BIGINT AS extra FROM documents")
def a01(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.coalesce(F.sum(F.when(F.col("lang") == "de", F.col("n_chars") - 1)), F.lit(0).cast("bigint")).alias("extra"))


@query("a02_group_count", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def a02(spark, d):
    return A.distribution(table(spark, d, "documents"), "lang").orderBy(F.col("n").desc(), "lang")


@query("a03_nested_distribution", "SELECT source, array_to_string(list_sort(list(lang || '=' || n::VARCHAR)), ',') AS grades FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def a03(spark, d):
    return A.distribution(table(spark, d, "documents"), "source", "lang").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "lang", F.col("n").cast("string")))), ",").alias("grades"))


@query("a04_null_key", "SELECT coalesce(q, 'None') AS q, count(*) AS n FROM (SELECT nullif(lang, 'es') AS q FROM documents) GROUP BY 1")
def a04(spark, d):
    return A.distribution(table(spark, d, "documents").select(F.coalesce(F.nullif("lang", F.lit("es")), F.lit("None")).alias("q")), "q")


@query("a05_pair_count", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a05(spark, d):
    return A.distribution(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("a06_pair_having", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2")
def a06(spark, d):
    return a05(spark, d).where("n >= 2")


@query("a07_duplicate_keys", "SELECT md5(text) AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a07(spark, d):
    return A.distribution(table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("k")), "k").where("n > 1")


@query("a08_top_per_cluster", "SELECT l_suppkey, l_partkey, n FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) <= 5")
def a08(spark, d):
    from gristmill.operators.topk import per_group

    return per_group(a05(spark, d), ["l_suppkey"], [F.col("n").desc(), F.col("l_partkey")], 5)


@query("a09_distinct_join", "SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def a09(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").select("o_custkey", "l_suppkey").distinct()


@query("a10_struct_lists", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey::VARCHAR || ':' || o_orderstatus)), ',') AS members, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2")
def a10(spark, d):
    out = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"))).alias("m"), F.count("*").alias("n"))
    return out.where("n >= 2").select("o_custkey", F.array_join("m", ",").alias("members"), "n")


@query("a11_first_non_null", "SELECT source, arg_min(q, doc_id) FILTER (WHERE q IS NOT NULL) AS q FROM (SELECT doc_id, source, nullif(lang, 'en') AS q FROM documents) GROUP BY 1")
def a11(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.nullif("lang", F.lit("en")).alias("q")).groupBy("source").agg(A.first_by("q", "doc_id").alias("q"))


@query("a12_latest", "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1")
def a12(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))


@query("a13_sum_or_zero", "SELECT coalesce(sum(value), 0) AS total FROM events WHERE event_type IN ('nothing')")
def a13(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("nothing")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


@query("a14_quota_counts", "SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 00:00:00') AS today, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-01 00:00:00') AS month FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1")
def a14(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    since = lambda unit: F.count_if(F.col("ts") >= F.date_trunc(unit, now).cast("timestamp_ntz"))
    return table(spark, d, "events").where(F.col("ts") <= now).groupBy("event_type").agg(since("day").alias("today"), since("month").alias("month"))


@query("a15_crash_loop", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90) GROUP BY 1 ORDER BY n DESC, user_id LIMIT 1")
def a15(spark, d):
    e = table(spark, d, "events")
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    recent = e.where((F.col("event_type") == "error") & (F.col("ts") > now - F.expr("INTERVAL 48 HOURS")) & (F.col("ts") <= now))
    held = e.where("event_type = 'signup' and value > 90").select("user_id")
    return A.distribution(recent.join(held, "user_id", "left_anti"), "user_id").orderBy(F.col("n").desc(), "user_id").limit(1)


@query("a16_failure_budget", "SELECT user_id, count(*) AS failures, count(*) >= 3 AS quarantine FROM events WHERE event_type IN ('error') AND value > 10 GROUP BY 1")
def a16(spark, d):
    return table(spark, d, "events").where("event_type = 'error' and value > 10").groupBy("user_id").agg(F.count("*").alias("failures")).withColumn("quarantine", F.col("failures") >= 3)


@query("a17_admin_counters", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM embeddings) AS vectors")
def a17(spark, d):
    names = {"documents": "documents", "events": "events", "users": "customer", "orders": "orders", "vectors": "embeddings"}
    rows = None
    for name, t in names.items():
        one = table(spark, d, t).agg(F.lit(name).alias("k"), F.count("*").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in names])


@query("a18_cast_group_filter", "SELECT TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) // 10 AS chapter, count(*) AS n FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL GROUP BY 1 HAVING count(*) < 1100")
def a18(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return A.distribution(table(spark, d, "events").select(F.floor(k / 10).cast("int").alias("chapter")).where("chapter is not null"), "chapter").where("n < 1100")


@query("a19_shares", "SELECT source, round(count(*) FILTER (WHERE lang <> 'en') / greatest(count(*), 1), 6) AS foreign_share, round(max(n_chars) / greatest(sum(n_chars), 1), 6) AS top_share FROM documents GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(A.ratio(F.count_if(F.col("lang") != "en"), F.count("*")).alias("foreign_share"), A.ratio(F.max("n_chars"), F.sum("n_chars")).alias("top_share"))


@query("a20_mode", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def a20(spark, d):
    return A.mode(table(spark, d, "events"), ["user_id"], "event_type")


@query("a21_majority_vote", "SELECT l_suppkey, l_returnflag, n, votes FROM (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_suppkey)::BIGINT AS votes FROM lineitem GROUP BY 1, 2) WHERE n * 2 > votes AND l_returnflag <> 'R'")
def a21(spark, d):
    return A.majority(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", none="R")


@query("a22_confusion", "SELECT lang, count(*) FILTER (WHERE toxic = 1 AND n_chars < 500) AS tp, count(*) FILTER (WHERE toxic <> 1 AND n_chars < 500) AS fp, count(*) FILTER (WHERE toxic = 1 AND n_chars >= 500) AS fn, count(*) FILTER (WHERE toxic <> 1 AND n_chars >= 500) AS tn, round(CASE WHEN count(*) FILTER (WHERE n_chars < 500) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE toxic = 1 AND n_chars < 500) / count(*) FILTER (WHERE n_chars < 500) END, 6) AS precision, round(CASE WHEN count(*) FILTER (WHERE toxic = 1) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE toxic = 1 AND n_chars < 500) / count(*) FILTER (WHERE toxic = 1) END, 6) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a22(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return A.confusion(both, F.col("toxic") == 1, F.col("n_chars") < 500, "lang")


@query("a23_coverage_missing", "SELECT c AS category FROM (VALUES ('view'), ('click'), ('refund'), ('chargeback')) t(c) WHERE c NOT IN (SELECT event_type FROM events)")
def a23(spark, d):
    wanted = spark.createDataFrame([("view",), ("click",), ("refund",), ("chargeback",)], "event_type string")
    return wanted.join(table(spark, d, "events").select("event_type"), "event_type", "left_anti").select(F.col("event_type").alias("category"))


_RUN = "CASE WHEN (quality = 1) = (n_chars > {n}) THEN 'right' ELSE 'wrong' END"


@query("a24_run_regression", f"SELECT before, after, count(*) AS n FROM (SELECT {_RUN.format(n=500)} AS before, {_RUN.format(n=1500)} AS after FROM documents JOIN labels USING (doc_id)) GROUP BY 1, 2")
def a24(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    run = lambda n: F.when((F.col("quality") == 1) == (F.col("n_chars") > n), "right").otherwise("wrong")
    return A.distribution(both.select(run(500).alias("before"), run(1500).alias("after")), "before", "after")


_GOLD = "(SELECT a.vec_id AS q, min(r) FILTER (WHERE same) AS rank FROM (SELECT a.vec_id, b.label = a.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) DESC, b.vec_id) AS r FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) a WHERE r <= 10 GROUP BY 1)"


def _ranked(spark, d, k):
    from gristmill.operators.joins import knn

    rows = table(spark, d, "embeddings")
    labels = rows.select("vec_id", "label")
    near = knn(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", k)
    return near.join(labels.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q").join(labels.select(F.col("vec_id").alias("n"), F.col("label").alias("nl")), "n")


@query("a25_retrieval_single", f"SELECT count(q) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN rank <= 5 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 5 THEN 1.0 / log2(rank + 1.0) ELSE 0.0 END), 6) AS ndcg FROM {_GOLD}")
def a25(spark, d):
    firsts = _ranked(spark, d, 10).groupBy("q").agg(F.min(F.when(F.col("ql") == F.col("nl"), F.col("rank"))).alias("rank"))
    return A.single_gold(firsts, "q", "rank", 5)


@query("a26_retrieval_many", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT a.vec_id AS q, b.vec_id AS n, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), rel AS (SELECT a.vec_id AS q, b.vec_id AS n FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), h AS (SELECT q, count(*) AS hits, min(r) AS first FROM r JOIN rel USING (q, n) WHERE r <= 10 GROUP BY 1) SELECT s.q, round(coalesce(hits / s.size, 0.0), 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS rr FROM (SELECT q, count(*) AS size FROM rel GROUP BY 1) s LEFT JOIN h ON h.q = s.q")
def a26(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    relevant = labels.where("vec_id % 20 = 0").alias("x").join(labels.alias("y"), F.expr("x.label = y.label and x.vec_id <> y.vec_id")).select(F.col("x.vec_id").alias("q"), F.col("y.vec_id").alias("n"))
    return A.many_gold(_ranked(spark, d, 10).select("q", "n", "rank"), relevant, "q", "n", "rank", 10)


@query("a27_latency_percentiles", "SELECT event_type, max(value) FILTER (WHERE i = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(value) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1")
def a27(spark, d):
    return A.nearest_rank(table(spark, d, "events"), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "event_type")


@query("a28_floor_threshold", "SELECT source, count(*) AS n, greatest(15, round(count(*) * 0.3))::BIGINT AS floor FROM documents GROUP BY 1")
def a28(spark, d):
    return A.distribution(table(spark, d, "documents"), "source").withColumn("floor", F.greatest(F.lit(15.0), F.round(F.col("n") * 0.3)).cast("bigint"))


@query("a29_edge_strength", "SELECT l_suppkey, l_partkey, round(least(1.0, 0.5 + 0.1 * count(*)), 6) AS strength, array_to_string((list_sort(list(l_orderkey)))[1:5], ',') AS evidence FROM lineitem GROUP BY 1, 2")
def a29(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.count("*")), 6).alias("strength"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list("l_orderkey")), 1, 5), lambda x: x.cast("string")), ",").alias("evidence"))


@query("a30_confidence_pluggable", "SELECT user_id, round(avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.6 WHEN 'view' THEN 0.4 ELSE 0.3 END), 6) AS confidence FROM events GROUP BY 1")
def a30(spark, d):
    from gristmill.functions.extension import confidence

    return confidence(table(spark, d, "events"), "user_id", "event_type", {"purchase": 1.0, "click": 0.6, "view": 0.4}, 0.3)


@query("a31_discipline_majority", "SELECT l_partkey, l_shipmode, n FROM (SELECT l_partkey, l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_shipmode) = 1")
def a31(spark, d):
    return A.mode(table(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("l_shipmode")), ["l_partkey"], "l_shipmode")


@query("a32_edge_agreement", f"WITH l AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {EDGES} WHERE w >= 2), r AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {EDGES} WHERE src % 3 = 0) SELECT count(*) FILTER (WHERE l.a IS NOT NULL AND r.a IS NOT NULL) AS both, count(*) FILTER (WHERE r.a IS NULL) AS left_only, count(*) FILTER (WHERE l.a IS NULL) AS right_only FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b")
def a32(spark, d):
    e = edges(spark, d)
    return A.agreement(e.where("w >= 2"), e.where("src % 3 = 0"), "src", "dst")


@query("a33_gate_audit", "SELECT lang, reason, count(*) AS n FROM (SELECT lang, unnest(list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN text LIKE '%$$$%' THEN 'symbols' END, CASE WHEN l.doc_id IS NULL THEN 'no_label' END], lambda x: x IS NOT NULL)) AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY 1, 2")
def a33(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.col("text").contains("$$$"), "symbols"), F.when(F.col("has").isNull(), "no_label")))
    return A.distribution(docs.select("lang", F.explode(reasons).alias("reason")), "lang", "reason")


@query("a34_field_scores", "SELECT round(avg(ok), 6) AS score FROM (SELECT CASE WHEN nullif(lang, 'es') IS NULL THEN 1 WHEN contains(lower(text), ' the ') OR contains(lower(text), ' der ') THEN 1 ELSE 0 END AS ok FROM documents)")
def a34(spark, d):
    found = F.exists(F.array(F.lit(" the "), F.lit(" der ")), lambda x: F.lower("text").contains(x))
    ok = F.when(F.nullif("lang", F.lit("es")).isNull() | found, 1).otherwise(0)
    return table(spark, d, "documents").agg(F.round(F.avg(ok), 6).alias("score"))


@query("a35_member_arrays", "SELECT source, lang, array_to_string(list_sort(list(doc_id)), ',') AS members FROM documents GROUP BY 1, 2")
def a35(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("members"))


@query("a36_position_thirds", "SELECT third, role, count(*) AS n FROM (SELECT role, CASE WHEN turn * 3 < n THEN 'first' WHEN turn * 3 < 2 * n THEN 'middle' ELSE 'last' END AS third FROM (SELECT role, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)) GROUP BY 1, 2")
def a36(spark, d):
    c = table(spark, d, "conversations").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))
    third = F.when(F.col("turn") * 3 < F.col("n"), "first").when(F.col("turn") * 3 < F.col("n") * 2, "middle").otherwise("last")
    return A.distribution(c.select("role", third.alias("third")), "third", "role")


@query("a37_gap_inputs", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, date_diff('day', max(ts)::DATE, DATE '2024-02-15') AS stale_days FROM events GROUP BY 1")
def a37(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.datediff(F.lit("2024-02-15").cast("date"), F.max("ts").cast("date")).cast("bigint").alias("stale_days"))


@query("a38_channel_totals", "SELECT channel, count(*) AS total, count(*) FILTER (WHERE n_chars > 800) AS done FROM (SELECT d.n_chars, p.channel FROM documents d JOIN (VALUES ('src1', 'ones'), ('src2', 'twos'), ('src0', 'zero')) p(prefix, channel) ON starts_with(d.source, p.prefix)) GROUP BY 1")
def a38(spark, d):
    prefixes = spark.createDataFrame([("src1", "ones"), ("src2", "twos"), ("src0", "zero")], "prefix string, channel string")
    both = table(spark, d, "documents").select("source", "n_chars").join(F.broadcast(prefixes), F.expr("startswith(source, prefix)"))
    return both.groupBy("channel").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 800).alias("done"))


@query("a39_cube", "SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE (lang, source)")
def a39(spark, d):
    return table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"))
