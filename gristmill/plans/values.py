"""Date, number, array, gate and source queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import strings as S
from gristmill.functions import values as X
from gristmill.functions import vectors as V
from gristmill.operators import gates as G
from gristmill.operators import predicates as P
from gristmill.operators import windows as W
from gristmill.plans.joins import VEC
from gristmill.plans.ordering import DIST, QUERY
from gristmill.plans.registry import query, table
from gristmill.sources import tables as T


@query("f40_month", "SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def f40(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("month"))


@query("f41_truncation", "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month FROM events")
def f41(spark, d):
    cut = lambda unit: F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd")
    return table(spark, d, "events").select("event_id", cut("day").alias("day"), cut("month").alias("month"))


@query("f42_next_interval", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE ([1, 3, 7, 14, 30, 60])[least(event_id % 9, 5)::INT + 1] END AS days FROM events")
def f42(spark, d):
    return table(spark, d, "events").select("event_id", X.next_interval(F.col("event_id") % 9, F.col("event_type") == "error").alias("days"))


@query("f43_due", "SELECT u.user_id, e.last IS NULL OR TIMESTAMP '2024-01-28 00:00:00' >= e.last + INTERVAL 24 HOUR AS due FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'signup' GROUP BY 1) e USING (user_id)")
def f43(spark, d):
    e = table(spark, d, "events")
    last = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("last"))
    users = e.select("user_id").distinct().join(last, "user_id", "left")
    return users.select("user_id", X.due(F.col("last"), F.lit("2024-01-28").cast("timestamp_ntz"), F.lit(24)).alias("due"))


@query("f44_age_buckets", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'idle' WHEN h <= 6 THEN 'fresh' WHEN h <= 24 THEN 'aging' ELSE 'stale' END AS age FROM (SELECT event_id, event_type, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31 00:00:00') / 3600 AS h FROM events)")
def f44(spark, d):
    hours = (F.unix_timestamp(F.lit("2024-01-31").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600
    return table(spark, d, "events").select("event_id", X.age_bucket(hours, F.col("event_type") != "error").alias("age"))


@query("f45_cosine", f"SELECT vec_id, {DIST} AS dist FROM {VEC}")
def f45(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(1 - V.cosine(V.as_double(F.col("embedding")), V.literal(QUERY)), 6).alias("dist"))


@query("f46_normalised", f"SELECT vec_id, round(list_dot_product(u, u), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM {VEC})")
def f46(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", V.unit(V.as_double(F.col("embedding"))).alias("u"))
    return u.select("vec_id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query("f47_similarity_tiers", f"SELECT CASE WHEN 1 - {DIST} >= 0.2 THEN 'strong' WHEN 1 - {DIST} >= 0.1 THEN 'medium' ELSE 'weak' END AS tier, count(*) AS n FROM {VEC} GROUP BY 1")
def f47(spark, d):
    return f45(spark, d).select(X.tier(1 - F.col("dist"), 0.2, 0.1).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


@query("f48_rounded", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 5) AS net FROM lineitem")
def f48(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 5).alias("net"))


@query("f50_backfill_order", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey END, 100000 + c_nationkey) AS pos FROM customer")
def f50(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.backfill_order(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")), F.col("c_nationkey")).alias("pos"))


@query("f51_append_and_count", "SELECT o_custkey, array_to_string(list_append(list_sort(list(o_orderkey)), 999999), ',') AS keys, count(*) + 1 AS n FROM orders GROUP BY 1")
def f51(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    more = X.appended(F.col("k"), F.lit(999999).cast("bigint"), "array<bigint>")
    return lists.select("o_custkey", F.array_join(F.transform(more, lambda x: x.cast("string")), ",").alias("keys"), X.length_or_zero(more).alias("n"))


@query("f52_remove_element", "SELECT o_custkey, array_to_string(list_sort(list_filter(list(o_orderstatus), lambda x: x <> 'F')), '') AS left_over FROM orders GROUP BY 1")
def f52(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderstatus")).alias("s"))
    return lists.select("o_custkey", F.array_join(X.without(F.col("s"), "F"), "").alias("left_over"))


@query("f53_exploded_distinct", "SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL")
def f53(spark, d):
    arrays = table(spark, d, "events").where("props is not null").select(F.array(F.from_json("props", "k string")).alias("a"))
    return arrays.select(F.explode("a").alias("x")).select(F.col("x.k").alias("k")).distinct()


@query("f54_array_length", "SELECT d.doc_id, coalesce(len(l.q), 0)::BIGINT AS n FROM documents d LEFT JOIN (SELECT doc_id, list(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)")
def f54(spark, d):
    lists = table(spark, d, "labels").groupBy("doc_id").agg(F.collect_list("quality").alias("q"))
    return table(spark, d, "documents").select("doc_id").join(lists, "doc_id", "left").select("doc_id", X.length_or_zero(F.col("q")).alias("n"))


@query("f55_nested_write", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'seen' AS status FROM events")
def f55(spark, d):
    maps = table(spark, d, "events").select("event_id", X.with_key(F.from_json("props", "map<string,string>"), "status", F.lit("seen")).alias("m"))
    return maps.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["status"].alias("status"))


@query("f56_alias_append", "SELECT p_brand, array_to_string(list_sort(list_distinct(list_append(list(p_type), 'ANY'))), ',') AS kinds FROM part GROUP BY 1")
def f56(spark, d):
    lists = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("t"))
    return lists.select("p_brand", F.array_join(F.array_sort(F.array_union("t", F.array(F.lit("ANY")))), ",").alias("kinds"))


@query("f57_sources_or_scalar", "SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE lang || ',' || source END AS sources FROM documents")
def f57(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.when(F.col("lang") == "en", F.array(F.lit(None).cast("string"))).otherwise(F.array("lang", "source", "lang")).alias("s"))
    return rows.select("doc_id", F.array_join(X.sources_or_scalar(F.col("s"), F.col("source")), ",").alias("sources"))


@query("f58_contributions", "SELECT lang, head, min(doc_id) AS doc_id, array_to_string(list_sort(list(doc_id))[2:], ',') AS also FROM (SELECT lang, substr(text, 1, 80) AS head, doc_id FROM documents) GROUP BY 1, 2")
def f58(spark, d):
    rows = table(spark, d, "documents").select("lang", F.substring("text", 1, 80).alias("head"), "doc_id")
    lists = rows.groupBy("lang", "head").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return lists.select("lang", "head", F.col("ids")[0].alias("doc_id"), F.array_join(F.transform(F.expr("slice(ids, 2, greatest(size(ids) - 1, 0))"), lambda x: x.cast("string")), ",").alias("also"))


@query("f60_event_verdict", "SELECT a.event_id AS a, b.event_id AS b, CASE WHEN a.event_type <> b.event_type THEN 'different' WHEN a.user_id = b.user_id AND a.ts::DATE = b.ts::DATE THEN 'same' ELSE 'maybe' END AS verdict FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.ts::DATE = b.ts::DATE")
def f60(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"))
    both = e.alias("a").join(e.alias("b"), F.expr("a.user_id = b.user_id and a.day = b.day and a.event_id < b.event_id"))
    v = X.event_verdict(F.array("a.user_id"), F.array("b.user_id"), F.lit("overlap"), F.col("a.event_type") == F.col("b.event_type"), F.lit(True))
    return both.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), v.alias("verdict"))


_GATE = "CASE WHEN len(regexp_extract_all(text, '�')) * 20 > length(text) THEN 'corrupt' WHEN source IN ('src7') THEN source WHEN NOT regexp_matches(text, '[.!?。！？]\\s*$') AND length(text) < 1000 AND regexp_matches(text, '^[a-z]') THEN 'fragment' WHEN trim(text) = '' THEN 'empty' WHEN length(text) < 500 THEN 'short' ELSE 'ok' END"


def _gated(spark, d):
    return table(spark, d, "documents").withColumn("gate", G.ingest_gate(F.col("text"), F.col("source"), ["src7"]))


@query("q01_ingest_gate", f"SELECT doc_id, {_GATE} AS gate FROM documents")
def q01(spark, d):
    return _gated(spark, d).select("doc_id", "gate")


@query("q02_audit_distribution", f"SELECT {_GATE} AS gate, count(*) AS n FROM documents GROUP BY 1")
def q02(spark, d):
    return _gated(spark, d).groupBy("gate").agg(F.count("*").alias("n"))


@query("q03_chapter_structure", "SELECT p_brand, list_sort(list_distinct(list(p_size))) = range(1, len(list(p_size)) + 1) AS contiguous FROM part GROUP BY 1")
def q03(spark, d):
    texts = table(spark, d, "part").groupBy("p_brand").agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("## Chapter "), F.col("p_size").cast("string")))).alias("t"))
    return texts.select("p_brand", G.contiguous(G.chapter_numbers(F.col("t"))).alias("contiguous"))


@query("q04_book_gate", "SELECT source, array_to_string(list_filter([CASE WHEN count(*) < 50 THEN 'few' END, CASE WHEN avg(n_chars) < 2300 THEN 'thin' END, CASE WHEN count(*) FILTER (WHERE lang <> 'en') * 2 > count(*) THEN 'foreign' END], lambda x: x IS NOT NULL), ',') AS alarms FROM documents GROUP BY 1")
def q04(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("size"), F.count_if(F.col("lang") != "en").alias("foreign"))
    return n.select("source", F.array_join(G.all_rules([("few", F.col("n") < 50), ("thin", F.col("size") < 2300), ("foreign", F.col("foreign") * 2 > F.col("n"))]), ",").alias("alarms"))


@query("q05_compact_report", "SELECT source, count(*) AS n, round(avg(n_chars), 2) AS mean, max(n_chars) AS longest FROM documents GROUP BY 1")
def q05(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean"), F.max("n_chars").alias("longest"))


@query("q06_completeness", "SELECT lang, array_to_string(list_sort(list_filter(['the', 'der', 'les', 'los'], lambda x: NOT list_contains(list(DISTINCT w), x))), ',') AS missing FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY 1")
def q06(spark, d):
    wanted = ["the", "der", "les", "los"]
    words = table(spark, d, "documents").select("lang", F.explode(F.array_intersect(F.split(F.lower("text"), " "), F.array(*[F.lit(w) for w in wanted]))).alias("w"))
    found = table(spark, d, "documents").select("lang").distinct().join(words.groupBy("lang").agg(F.collect_set("w").alias("f")), "lang", "left")
    return found.select("lang", F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce("f", F.array().cast("array<string>")))), ",").alias("missing"))


@query("q07_oversize", "SELECT doc_id, CASE WHEN n_chars > 10000 THEN 'collection' WHEN n_chars > 4000 THEN 'large' ELSE 'ok' END AS size FROM documents")
def q07(spark, d):
    return table(spark, d, "documents").select("doc_id", G.first_rule([("collection", F.col("n_chars") > 10000), ("large", F.col("n_chars") > 4000)], "ok").alias("size"))


@query("q08_bundles", "SELECT md5(text) AS h, count(*) AS parts, count(*) FILTER (WHERE n_chars > 100) >= 2 AS bundle FROM documents GROUP BY 1 HAVING count(*) > 1")
def q08(spark, d):
    n = table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("parts"), F.count_if(F.col("n_chars") > 100).alias("real"))
    return n.where("parts > 1").select("h", "parts", (F.col("real") >= 2).alias("bundle"))


@query("q09_constraints", "SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT coalesce(o_orderstatus IN ('F', 'O'), false) THEN 'status' END, CASE WHEN NOT coalesce(o_totalprice > 1500, false) THEN 'price' END], lambda x: x IS NOT NULL)) AS rule FROM orders)")
def q09(spark, d):
    return T.validated(table(spark, d, "orders"), {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 1500}).select("o_orderkey", "rule")


@query("q10_dangling", "SELECT l.doc_id FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.n_chars > 1000 WHERE d.doc_id IS NULL")
def q10(spark, d):
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").where("n_chars > 1000").select("doc_id"), "doc_id", "left_anti")


@query("q11_routing", "SELECT page_id, CASE WHEN starts_with(url, 'https') AND length(html) > 5000 THEN 'full' WHEN starts_with(url, 'https') THEN 'light' ELSE 'plain' END AS channel FROM pages")
def q11(spark, d):
    rules = [("full", F.col("url").startswith("https") & (F.length("html") > 5000)), ("light", F.col("url").startswith("https"))]
    return table(spark, d, "pages").select("page_id", G.first_rule(rules, "plain").alias("channel"))


@query("q12_purgatory", "SELECT c_custkey, CASE WHEN n > 12 THEN 'terminal' WHEN c_custkey % 2 = 0 THEN 'genuine' ELSE 'outside' END AS kind FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) WHERE n BETWEEN 1 AND 99")
def q12(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n between 1 and 99")
    held = n.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi")
    return held.select("c_custkey", G.first_rule([("terminal", F.col("n") > 12), ("genuine", F.col("c_custkey") % 2 == 0)], "outside").alias("kind"))


@query("q13_acceptance", "SELECT source, max(n_chars) * 10 < sum(n_chars) * 4 AND count(*) > 10 AS accepted FROM documents GROUP BY 1")
def q13(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.max("n_chars").alias("m"), F.sum("n_chars").alias("s"), F.count("*").alias("n"))
    return n.select("source", ((F.col("m") * 10 < F.col("s") * 4) & (F.col("n") > 10)).alias("accepted"))


@query("q14_conditional_gate", "SELECT lang, round(avg(CASE WHEN n_chars > 500 THEN quality END), 6) AS match, array_to_string(list_sort(list_filter(list(DISTINCT source), lambda x: x NOT IN ('src0', 'src1'))), ',') AS reasons FROM documents JOIN labels USING (doc_id) WHERE quality = 0 OR n_chars > 2000 GROUP BY 1")
def q14(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality = 0 or n_chars > 2000")
    out = rows.groupBy("lang").agg(F.round(F.avg(F.when(F.col("n_chars") > 500, F.col("quality"))), 6).alias("match"), F.collect_set("source").alias("s"))
    return out.select("lang", "match", F.array_join(F.array_sort(F.array_except("s", F.array(F.lit("src0"), F.lit("src1")))), ",").alias("reasons"))


@query("q15_fidelity", "SELECT doc_id, CASE WHEN b = 0 THEN 'skip' WHEN a >= b * 0.5 THEN 'good' WHEN a >= b * 0.1 THEN 'fair' ELSE 'poor' END AS fidelity FROM (SELECT doc_id, len(regexp_extract_all(text, '\\$\\$\\$')) AS a, len(regexp_extract_all(text, '[#%&*]{3}')) AS b FROM documents)")
def q15(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", G.fidelity(S.count_matches(t, r"\$\$\$"), S.count_matches(t, "[#%&*]{3}")).alias("fidelity"))


@query("q16_convertibility", "SELECT page_id, CASE WHEN NOT contains(html, '<p>') THEN 'no_text' WHEN NOT contains(html, '<h1>') THEN 'no_chapters' WHEN contains(html, '%%%') THEN 'bad_layer' ELSE 'ok' END AS state FROM pages")
def q16(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", G.first_rule([("no_text", ~h.contains("<p>")), ("no_chapters", ~h.contains("<h1>")), ("bad_layer", h.contains("%%%"))], "ok").alias("state"))


@query("s01_point_read", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 17 LIMIT 1")
def s01(spark, d):
    return T.read_one(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", 17)


@query("s02_named_arguments", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 50")
def s02(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("gristmill_orders")
    return T.select(spark, "SELECT o_orderkey, o_totalprice FROM gristmill_orders WHERE o_totalprice > :least ORDER BY o_orderkey", {"least": 200000.0}, limit=50)


@query("s04_upsert", "SELECT doc_id, q FROM (SELECT doc_id, quality AS q FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0) UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id % 3 = 0)")
def s04(spark, d):
    base = table(spark, d, "labels").select("doc_id", F.col("quality").alias("q"))
    return T.upsert(base, table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(9).alias("q")), ["doc_id"])


@query("s05_update", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def s05(spark, d):
    return T.update(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.col("s_acctbal") < 0, {"s_acctbal": F.lit(0.0)})


@query("s06_soft_delete", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at FROM orders")
def s06(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return T.soft_delete(rows, F.col("o_orderstatus") == "F", F.lit("2024-02-01").cast("timestamp_ntz")).select("o_orderkey", "deleted_at")


@query("s14_export", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'de') ORDER BY d.doc_id")
def s14(spark, d):
    rows = P.member_of(table(spark, d, "documents"), "lang", ["en", "de"]).join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "quality").orderBy("doc_id")


@query("s15_snapshot_diff", "SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)")
def s15(spark, d):
    days = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("day")))  # a row for each run


@query("s16_needs_mailbox", "SELECT lang AS topic, source AS subtopic FROM (SELECT DISTINCT lang, source FROM documents)")
def s16(spark, d):
    needs = table(spark, d, "documents").groupBy("lang").agg(F.to_json(F.struct(F.col("lang").alias("topic"), F.collect_set("source").alias("subtopics"))).alias("j"))
    parsed = needs.select(F.from_json("j", "topic string, subtopics array<string>").alias("x"))
    return parsed.select("x.topic", F.explode("x.subtopics").alias("subtopic"))


@query("s17_metrics_text", "SELECT event_type || '{user=\"' || user_id::VARCHAR || '\"} ' || count(*)::VARCHAR AS line FROM events GROUP BY event_type, user_id ORDER BY event_type, user_id LIMIT 500")
def s17(spark, d):
    series = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy("event_type", "user_id").limit(500)
    return series.select(F.concat("event_type", F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("n").cast("string")).alias("line"))


@query("s18_type_mapping", "SELECT * FROM (VALUES ('VARCHAR', 'string'), ('DOUBLE', 'double'), ('TIMESTAMP', 'timestamp_ntz'), ('VARCHAR[]', 'array<string>')) t(source_type, spark_type)")
def s18(spark, d):
    from gristmill.sources.files import spark_type

    return spark.createDataFrame([(t, spark_type(t)) for t in ("VARCHAR", "DOUBLE", "TIMESTAMP", "VARCHAR[]")], "source_type string, spark_type string")


@query("s19_coerced_migration", "SELECT c_custkey::VARCHAR AS id, TRY_CAST(c_name AS INTEGER) AS number, c_acctbal::INTEGER AS balance FROM (SELECT c_custkey, c_name, floor(c_acctbal) AS c_acctbal FROM customer)")
def s19(spark, d):
    from gristmill.sources.files import coerced

    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("number"), F.floor("c_acctbal").alias("balance"))
    return coerced(rows, {"id": "string", "number": "int", "balance": "int"})


@query("s20_recent_changes", "SELECT event_id, event_type FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 20")
def s20(spark, d):
    return table(spark, d, "events").where("user_id = 8").select("event_id", "event_type").orderBy(F.col("event_id").desc()).limit(20)
