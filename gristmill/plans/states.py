"""Incremental queries over the driver's tables, in their batch form and, named ..._stream, as streams that run twice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import windows as W
from gristmill.plans.registry import ORACLES, query, table
from gristmill.sources import tables as S
from gristmill.streaming import state as T


def _events(spark, d):
    return table(spark, d, "events")


@query("t01_changefeed_append", "SELECT event_id, user_id, event_type FROM events UNION ALL SELECT doc_id + 1000000, 0, 'document' FROM documents")
def t01(spark, d):
    feed = _events(spark, d).select("event_id", "user_id", "event_type")
    return feed.unionByName(table(spark, d, "documents").select((F.col("doc_id") + 1000000).alias("event_id"), F.lit(0).cast("bigint").alias("user_id"), F.lit("document").alias("event_type")))


@query("t02_cursor_pull", "WITH w AS (SELECT event_id, event_type FROM events WHERE user_id = 8 AND event_id > 500 AND event_type IN ('view', 'click') ORDER BY event_id LIMIT 10) SELECT event_id, event_type, (SELECT count(*) FROM events WHERE user_id = 8 AND event_id > 500 AND event_type IN ('view', 'click')) > 10 AS has_more, (SELECT max(event_id) FROM w) AS latest_seq FROM w")
def t02(spark, d):
    return T.changes_since(_events(spark, d), "user_id", 8, "event_id", 500, ["view", "click"], "event_type", 10).select("event_id", "event_type", "has_more", "latest_seq")


_LIMITER = """WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
     r(user_id, i, event_id, ts, allowed, held) AS (
         SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, NULL::BOOLEAN, CAST([] AS BIGINT[]) FROM events
         UNION ALL
         SELECT user_id, i, event_id, ts, len(h) < 3, CASE WHEN len(h) < 3 THEN list_append(h, epoch_us(ts)) ELSE h END
         FROM (SELECT o.*, list_filter(r.held, lambda x: x > epoch_us(o.ts) - 21600000000) AS h FROM r JOIN o ON o.user_id IS NOT DISTINCT FROM r.user_id AND o.i = r.i + 1))
SELECT event_id, user_id, ts, allowed FROM r WHERE i > 0"""


@query("t03_limiter", _LIMITER)
def t03(spark, d):
    return T.limiter(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3, 6 * 3600)


@query("t04_abuse", "SELECT user_id, min(ts) AS blocked_at, min(ts) + INTERVAL 4 HOUR AS blocked_until FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'error')) WHERE n >= 3 GROUP BY 1")
def t04(spark, d):
    errors = _events(spark, d).where("event_type = 'error'").select("user_id", F.date_trunc("second", "ts").alias("ts"))
    return T.abusive(errors, "user_id", "ts", 86400, 3, 4).select("user_id", F.col("blocked_at").cast("timestamp_ntz").alias("blocked_at"), F.col("blocked_until").cast("timestamp_ntz").alias("blocked_until"))


@query("t05_block_ttl", "SELECT user_id, max(ts) + INTERVAL 12 HOUR > TIMESTAMP '2024-01-30 00:00:00' AS blocked, count(*) AS hits FROM events WHERE event_type = 'error' GROUP BY 1")
def t05(spark, d):
    n = _events(spark, d).where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("hits"))
    return n.select("user_id", (F.col("last") + F.expr("INTERVAL 12 HOURS") > F.lit("2024-01-30").cast("timestamp_ntz")).alias("blocked"), "hits")


@query("t06_processed_ids", "SELECT DISTINCT user_id, event_type FROM events")
def t06(spark, d):
    return _events(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


@query("t07_due_sources", "SELECT event_type FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-31 00:00:00'")
def t07(spark, d):
    from gristmill.functions.values import due

    last = _events(spark, d).groupBy("event_type").agg(F.max("ts").alias("last"))
    return last.where(due(F.col("last"), F.lit("2024-01-31").cast("timestamp_ntz"), F.lit(1))).select("event_type")


@query("t08_miss_counter", "SELECT event_id, sum(CASE WHEN v <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type, i ORDER BY event_id)::BIGINT AS miss_rounds FROM (SELECT *, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM (SELECT event_id, user_id, event_type, CASE WHEN value < 30 THEN 0 ELSE 1 END AS v FROM events))")
def t08(spark, d):
    rounds = _events(spark, d).select("event_id", "user_id", "event_type", F.when(F.col("value") < 30, 0).otherwise(1).alias("v"))
    return W.miss_rounds(rounds, ["user_id", "event_type"], [F.col("event_id")], "v").select("event_id", "miss_rounds")


@query("t09_quota", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) SELECT event_id, event_type, 'guaranteed' AS slot FROM r WHERE r <= 50 UNION ALL SELECT event_id, event_type, 'overflow' FROM (SELECT * FROM r WHERE r > 50 ORDER BY r, event_type LIMIT 50)")
def t09(spark, d):
    return T.quota(_events(spark, d).select("event_id", "event_type"), "event_type", ["event_id"], 50, 300)


@query("t10_accumulate", "SELECT user_id, round(sum(value), 4) AS total, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def t10(spark, d):
    e = _events(spark, d).select("user_id", "value", "event_type", "event_id")
    out = S.upsert_sum(e.where("event_id < 5000"), e.where("event_id >= 5000"), ["user_id"], ["value"], ["event_type"], "event_id")
    return out.select("user_id", F.round("value", 4).alias("total"), F.col("event_type").alias("last"))


@query("t11_occurrences", "SELECT event_type, coalesce(CASE WHEN user_id % 4 <> 0 THEN user_id::VARCHAR END, '') AS ref, count(*) AS n, arg_max(event_id, event_id) AS evidence FROM events GROUP BY 1, 2")
def t11(spark, d):
    ref = F.coalesce(F.when(F.col("user_id") % 4 != 0, F.col("user_id").cast("string")), F.lit(""))
    return _events(spark, d).groupBy("event_type", ref.alias("ref")).agg(F.count("*").alias("n"), F.max_by("event_id", "event_id").alias("evidence"))


@query("t12_entity_merge", "SELECT lower(trim(p_type)) AS key, count(*) AS mentions, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS sources FROM part GROUP BY 1")
def t12(spark, d):
    spelt = table(spark, d, "part").withColumn("name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.lower("p_type"))).otherwise(F.col("p_type")))
    return T.merged_entities(spelt, [], "name", "p_brand", "p_partkey").select("key", "mentions", F.array_join("sources", ",").alias("sources"))


@query("t13_relation_merge", "SELECT o_custkey, l_suppkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS kinds FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def t13(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag")
    both = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    return both.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("kinds"))


@query("t14_supersede", "SELECT o_orderkey, lead(o_orderdate) OVER w AS valid_until, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def t14(spark, d):
    return T.superseded(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "valid_until", "superseded_by")


@query("t15_reingest", "SELECT doc_id, source = 'src3' AS superseded FROM documents UNION ALL SELECT doc_id + 100000, false FROM documents WHERE source = 'src3'")
def t15(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    new = docs.where("source = 'src3'").select((F.col("doc_id") + 100000).alias("doc_id"), F.lit(False).alias("superseded"))
    return docs.select("doc_id", (F.col("source") == "src3").alias("superseded")).unionByName(new)


@query("t16_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def t16(spark, d):
    return T.latest_state(_events(spark, d), ["user_id"], ["event_id"], ["event_type"])


@query("t17_resolution_actions", "SELECT a, action FROM (SELECT doc_id AS a, CASE WHEN quality = 1 AND toxic = 0 THEN ['keep'] WHEN toxic = 1 THEN ['quarantine', 'review'] ELSE ['review'] END AS acts FROM labels), unnest(acts) t(action)")
def t17(spark, d):
    acts = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.array(F.lit("keep"))).when(F.col("toxic") == 1, F.array(F.lit("quarantine"), F.lit("review"))).otherwise(F.array(F.lit("review")))
    return table(spark, d, "labels").select(F.col("doc_id").alias("a"), F.explode(acts).alias("action"))


@query("t18_ledger_live", "WITH l AS (SELECT o_orderkey AS id, o_custkey AS a, o_custkey % 10 AS b, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END AS sup FROM orders) SELECT id, a, b FROM l WHERE id NOT IN (SELECT sup FROM l WHERE sup IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY id DESC) = 1")
def t18(spark, d):
    ledger = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), (F.col("o_custkey") % 10).alias("b"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - 1).alias("sup"))
    return T.live_decisions(ledger, "id", "sup", "a", "b", "id").select("id", "a", "b")


@query("t19_version_staleness", "SELECT max(event_id // 1000) AS version, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup')) AS newer FROM events")
def t19(spark, d):
    e = _events(spark, d)
    last = e.where("event_type = 'signup'").agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).agg(F.max(F.floor(F.col("event_id") / 1000)).alias("version"), F.count_if(F.col("ts") > F.col("last")).alias("newer"))


@query("t20_cascade_plan", "SELECT l_partkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'delete' ELSE 'keep' END AS action FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_suppkey = 4) > 0")
def t20(spark, d):
    return T.exclusive_support(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", 4)


@query("t21_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = 11)")
def t21(spark, d):
    gone = table(spark, d, "orders").where("o_custkey = 11").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("t23_growth_alarm", "SELECT day, n - lag(n) OVER (ORDER BY day) > 5 AS alarm FROM (SELECT ts::DATE AS day, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY 1)")
def t23(spark, d):
    days = _events(spark, d).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("n"))
    return days.select("day", (F.col("n") - F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("day")) > 5).alias("alarm"))  # a row for each cycle


@query("t24_insert_path", "SELECT fp, min(doc_id) AS doc_id, count(*) AS merges FROM (SELECT substr(sha256(text), 1, 32) AS fp, doc_id FROM documents) GROUP BY 1")
def t24(spark, d):
    from gristmill.functions.strings import fingerprint32

    return table(spark, d, "documents").select(fingerprint32(F.col("text")).alias("fp"), "doc_id").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("merges"))


@query("t25_persist_split", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'noise' WHEN lang NOT IN ('en', 'de', 'fr') THEN 'vocabulary' ELSE 'accepted' END AS reason FROM documents) GROUP BY 1")
def t25(spark, d):
    from gristmill.operators.gates import first_rule

    reason = first_rule([("noise", F.col("n_chars") < 100), ("vocabulary", ~F.col("lang").isin("en", "de", "fr"))], "accepted")
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("t26_first_attribute", "SELECT source, arg_min(q, doc_id) FILTER (WHERE q IS NOT NULL) AS q, CASE WHEN count(DISTINCT q) > 1 THEN array_to_string(list_sort(list(DISTINCT q)), ',') END AS conflict FROM (SELECT doc_id, source, nullif(lang, 'en') AS q FROM documents) GROUP BY 1")
def t26(spark, d):
    from gristmill.operators.aggregates import first_by

    rows = table(spark, d, "documents").select("doc_id", "source", F.nullif("lang", F.lit("en")).alias("q"))
    n = rows.groupBy("source").agg(first_by("q", "doc_id").alias("q"), F.array_sort(F.collect_set("q")).alias("all"))
    return n.select("source", "q", F.when(F.size("all") > 1, F.array_join("all", ",")).alias("conflict"))


@query("t27_feed_update", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'checked' END, c_mktsegment) AS state FROM customer")
def t27(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 2 == 0, "checked"), F.col("c_mktsegment")).alias("state"))


@query("t28_needs_merge", "SELECT topic, pos FROM (SELECT lang AS topic, 0 AS pos, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT event_type, 1, count(*) FROM events GROUP BY 1)")
def t28(spark, d):
    new = table(spark, d, "documents").groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("n")).select("topic", F.lit(0).alias("pos"))
    return new.unionByName(_events(spark, d).select(F.col("event_type").alias("topic"), F.lit(1).alias("pos")).distinct())


def _halves(df, order):
    """The rows up to the middle of the order's range, then the others."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return [df]
    middle = F.lit(low + (high - low) / 2) if order == "ts" else F.lit((low + high) // 2)
    return [df.where(F.col(order) <= middle), df.where(F.col(order) > middle)]


@query("t01_changefeed_stream", ORACLES["t01_changefeed_append"])
def t01_stream(spark, d):
    feed = t01(spark, d)
    return T.ticks([feed.where("event_type <> 'document'"), feed.where("event_type = 'document'")], lambda new: new)


@query("t03_limiter_stream", ORACLES["t03_limiter"])
def t03_stream(spark, d):
    return T.ticks(_halves(_events(spark, d).select("event_id", "user_id", "ts"), "ts"), lambda new: T.stream_limiter(new, "user_id", "ts", "event_id", 3, 6 * 3600))


@query("t06_processed_ids_stream", ORACLES["t06_processed_ids"])
def t06_stream(spark, d):
    return T.ticks(_halves(_events(spark, d).select("user_id", "event_type", "event_id"), "event_id"), lambda new: new.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@query("t08_miss_counter_stream", ORACLES["t08_miss_counter"])
def t08_stream(spark, d):
    rounds = _events(spark, d).select("event_id", "user_id", "event_type", F.when(F.col("value") < 30, 0).otherwise(1).alias("v"))
    return T.ticks(_halves(rounds, "event_id"), lambda new: T.miss_stream(new, ["user_id", "event_type"], "event_id", "v").select("event_id", "miss_rounds"))
