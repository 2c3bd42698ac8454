"""Filter queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import predicates as P
from gristmill.plans.registry import query, table


@query("p01_conditional_filter", "SELECT doc_id, lang, source, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'en' AND source = 'src0' ORDER BY doc_id LIMIT 20")
def p01(spark, d):
    hits = P.where_all(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), lang="en", source="src0", n_chars=None)
    return hits.orderBy("doc_id").limit(20).crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))


@query("p02_tenant", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment = substr(sha256('BUILDING'), 1, 16)")
def p02(spark, d):
    return P.tenant(table(spark, d, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("p03_owner_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def p03(spark, d):
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return P.owned(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", owners, "o_custkey", 7)


@query("p03_owner_or_public", "SELECT doc_id, owner FROM (SELECT doc_id, nullif(source, 'src1') AS owner FROM documents) WHERE owner IS NULL OR owner = 'src0'")
def p03b(spark, d):
    return P.owned_or_public(table(spark, d, "documents").select("doc_id", F.nullif("source", F.lit("src1")).alias("owner")), "owner", "src0")


@query("p04_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%AN%'")
def p04(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").where(P.contains_ci("p_name", "AN"))


@query("p05_like_lower_needle", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%' || lower('AN') || '%'")
def p05(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").where(P.like_lower("p_name", "AN"))


@query("p06_keyword_or", "SELECT source, count(*) AS n, count(*) >= 5 AS enough FROM documents WHERE contains(text, 'license') OR contains(text, 'License') OR contains(text, 'copyright') GROUP BY source")
def p06(spark, d):
    hits = table(spark, d, "documents").where(P.any_keyword("text", ["license", "License", "copyright"]))
    return hits.groupBy("source").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 5)


@query("p07_member_of", "SELECT doc_id, lang FROM documents WHERE source IN ('src1', 'src4', 'src9')")
def p07(spark, d):
    return P.member_of(table(spark, d, "documents"), "source", ["src1", "src4", "src9"]).select("doc_id", "lang")


@query("p08_array_membership", "SELECT doc_id FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents) WHERE list_contains(words, 'the')")
def p08(spark, d):
    return table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("words")).where(P.in_array("words", "the")).select("doc_id")


@query("p09_json_containment", "SELECT o_orderkey FROM orders WHERE o_custkey = 5 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 3)")
def p09(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.struct("l_suppkey")).alias("sources"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left").withColumn("sources", F.coalesce("sources", F.expr("cast(array() as array<struct<l_suppkey:bigint>>)")))
    return orders.withColumn("hit", (F.col("o_custkey") == 5) | F.exists("sources", lambda s: s.l_suppkey == 3)).where("hit").select("o_orderkey")


@query("p10_json_path", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def p10(spark, d):
    return table(spark, d, "events").select("event_type", P.json_field("props", "k").alias("k")).where("k is not null").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("p11_case_override", "SELECT doc_id, coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE lang END, ''), CASE WHEN n_chars > 2000 THEN 'book' WHEN n_chars > 500 THEN 'article' ELSE 'note' END) AS medium FROM documents")
def p11(spark, d):
    given = F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", P.override(given, {"book": F.col("n_chars") > 2000, "article": F.col("n_chars") > 500}, "note").alias("medium"))


@query("p12_optional_parameter", "SELECT s_suppkey, s_name FROM supplier WHERE (NULL IS NULL OR s_nationkey = NULL) AND s_acctbal > 0")
def p12(spark, d):
    return P.where_all(table(spark, d, "supplier"), s_nationkey=None).where("s_acctbal > 0").select("s_suppkey", "s_name")


_VERSIONS = "(SELECT doc_id, source, lang, lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS valid_until FROM documents)"


def versions(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "documents").select("doc_id", "source", "lang").withColumn("valid_until", F.lead("doc_id").over(Window.partitionBy("source", "lang").orderBy("doc_id")))


@query("p13_current_version", f"SELECT doc_id, source, lang FROM {_VERSIONS} WHERE valid_until IS NULL")
def p13(spark, d):
    return versions(spark, d).where(P.current()).select("doc_id", "source", "lang")


@query("p14_not_quarantined", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(l.toxic = 1, false)")
def p14(spark, d):
    flags = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag"))
    return table(spark, d, "documents").select("doc_id").join(flags, "doc_id", "left").where(P.unflagged("flag")).select("doc_id")


@query("p15_soft_delete", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders) WHERE deleted_at IS NULL")
def p15(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at")).where(P.current("deleted_at")).select("o_orderkey")


@query("p16_older_than", "SELECT event_id FROM events WHERE event_type = 'view' AND props IS NOT NULL AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14 DAY")
def p16(spark, d):
    return table(spark, d, "events").where((F.col("event_type") == "view") & F.col("props").isNotNull() & P.older_than("ts", "2024-01-30 00:00:00", 14)).select("event_id")


@query("p17_unexpired", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN ts END AS revoked_at, ts + INTERVAL 7 DAY AS expires_at FROM events) WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '2024-01-20 00:00:00'")
def p17(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    return rows.where(P.unexpired("revoked_at", "expires_at", "2024-01-20 00:00:00")).select("event_id")


@query("p18_not_in_or_null", "SELECT doc_id, q FROM (SELECT doc_id, nullif(lang, 'fr') AS q FROM documents) WHERE q NOT IN ('en', 'de') OR q IS NULL")
def p18(spark, d):
    return table(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("fr")).alias("q")).where(P.not_in_or_null("q", ["en", "de"]))


@query("p19_prefix_family", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%' OR p_type LIKE 'PROMO%'")
def p19(spark, d):
    return table(spark, d, "part").where(P.any_prefix("p_type", ["S", "PROMO"])).select("p_partkey", "p_type")


@query("p20_truncated", "SELECT doc_id, substr(text, 1, 80) AS preview FROM documents")
def p20(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("preview"))


@query("p21_pruned_columns", "SELECT vec_id, label FROM embeddings")
def p21(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label")


@query("p22_scope_types", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def p22(spark, d):
    return P.scoped(table(spark, d, "events").select("event_id", "event_type"), "event_type", {"browse": ["view", "click"], "buy": ["purchase"], "system": ["error"]}, ["browse", "buy"])


@query("p22_unknown_scope", "SELECT event_id, event_type FROM events WHERE false")
def p22b(spark, d):
    return P.scoped(table(spark, d, "events").select("event_id", "event_type"), "event_type", {"browse": ["view"]}, ["nothing"])


@query("p23_saved_view", "SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'de' AND n_chars >= 1000")
def p23(spark, d):
    import json

    spec = json.loads('{"lang": "de", "min_n_chars": 1000}')  # as a stored view has it
    return P.apply_view(table(spark, d, "documents"), spec, lang="en").select("doc_id", "lang", "n_chars")


#: Preset views as filter specifications.
PRESETS = {"long": {"min_n_chars": 3000}, "short": {"max_n_chars": 300}, "english": {"lang": "en"}, "german_long": {"lang": "de", "min_n_chars": 2000}, "first_source": {"source": "src0"}}


@query("p24_preset_views", "SELECT 'long' AS view, count(*) AS n FROM documents WHERE n_chars >= 3000 UNION ALL SELECT 'short', count(*) FROM documents WHERE n_chars <= 300 UNION ALL SELECT 'english', count(*) FROM documents WHERE lang = 'en' UNION ALL SELECT 'german_long', count(*) FROM documents WHERE lang = 'de' AND n_chars >= 2000 UNION ALL SELECT 'first_source', count(*) FROM documents WHERE source = 'src0'")
def p24(spark, d):
    docs = table(spark, d, "documents")
    out = None
    for name, spec in PRESETS.items():
        one = P.apply_view(docs, spec).agg(F.lit(name).alias("view"), F.count("*").alias("n")).select("view", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("p25_exact_name", "SELECT n_nationkey, lower(n_name) AS name FROM nation WHERE lower(n_name) = lower(trim('  NATION_3 '))")
def p25(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("name")).where(P.exact_name("name", "  NATION_3 "))
