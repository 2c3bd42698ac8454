"""Streams with state, ledgers and several sinks over the driver's tables, each run in ticks with restarts; feeds as a source; graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import chapters as C
from gristmill.functions import strings as S
from gristmill.operators import graph as G
from gristmill.plans.graphs import strong
from gristmill.plans.registry import query, table
from gristmill.plans.states import _halves
from gristmill.sources import feeds
from gristmill.sources.files import shared_folder
from gristmill.streaming import blocks, ingest, ledger
from gristmill.streaming.state import ticks

_DAY, _BLOCK = 86_400_000, 4 * 3_600_000

#: Blocks from three errors in a day on, for four hours; an end is told once the last event of all is behind it.
_BLOCKS = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'error' AND user_id IS NOT NULL),
     o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM e),
     r(user_id, i, event_id, ms, held, until, n, outcome) AS (
         SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, CAST([] AS BIGINT[]), NULL::BIGINT, 0::BIGINT, '' FROM e
         UNION ALL
         SELECT user_id, i, event_id, ms, CASE WHEN shut THEN held ELSE h END, CASE WHEN shut THEN until WHEN len(h) >= 3 THEN ms + {_BLOCK} END, n + CASE WHEN NOT shut AND len(h) >= 3 THEN 1 ELSE 0 END, CASE WHEN shut THEN 'rejected' WHEN len(h) >= 3 THEN 'block' ELSE 'counted' END
         FROM (SELECT o.*, r.held, r.until, r.n, coalesce(o.ms < r.until, false) AS shut, list_append(list_filter(r.held, lambda x: x > o.ms - {_DAY}), o.ms)[-3:] AS h FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT user_id AS key, event_id AS event, ms, outcome, n AS n_blocks FROM r WHERE i > 0
UNION ALL SELECT user_id, NULL, until, 'expired', n FROM r WHERE outcome = 'block' AND until <= (SELECT max(ms) FROM e)"""


@query("t04_block_stream", _BLOCKS)
def t04_stream(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return ticks(_halves(errors, "ts"), lambda new: blocks.stream_blocks(new, "user_id", "ts", "event_id", 3, 86400, 4 * 3600))


_QUOTA = ledger.Quota(("first", "second", "third"), 30, 110, 250)
_DAYS = ("2024-03-30", "2024-03-30", "2024-03-31", "2024-04-01")
_BUCKET = "CASE p_partkey % 5 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'third' END"


def _ledger_sql() -> str:
    """Each tick's rows from the ticks before it: own rows by bucket and turn, as far as day and month go, then the overflow."""
    steps = ["done0 AS (SELECT NULL::VARCHAR AS topic, NULL::VARCHAR AS bucket, NULL::DATE AS day, NULL::VARCHAR AS slot, 0::BIGINT AS place, NULL::BIGINT AS tick WHERE false)"]
    for t, day in enumerate(_DAYS):
        month = f"date_trunc('month', day) = date_trunc('month', DATE '{day}')"
        steps += [
            f"w{t} AS (SELECT q.*, last, row_number() OVER (PARTITION BY b ORDER BY last NULLS FIRST, pos) AS r FROM (SELECT p_name || ' ' || p_partkey AS topic, {_BUCKET} AS bucket, p_partkey AS pos, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS b FROM part WHERE p_size % 4 <> {t}) q LEFT JOIN (SELECT topic, max(tick) AS last FROM done{t} GROUP BY 1) USING (topic))",
            f"c{t} AS (SELECT {_QUOTA.month} - count(*) AS m, {_QUOTA.day} - count(*) FILTER (WHERE day = DATE '{day}') AS d FROM done{t} WHERE {month})",
            f"o{t} AS (SELECT * FROM (SELECT w.*, row_number() OVER (ORDER BY b, r) AS k FROM w{t} w LEFT JOIN (SELECT bucket, count(*) AS n FROM done{t} WHERE day = DATE '{day}' GROUP BY 1) USING (bucket) WHERE r <= {_QUOTA.own} - coalesce(n, 0)), c{t} WHERE k <= m)",
            f"v{t} AS (SELECT * FROM (SELECT w.*, row_number() OVER (ORDER BY last NULLS FIRST, b, pos) AS k FROM w{t} w WHERE topic NOT IN (SELECT topic FROM o{t})), c{t}, (SELECT count(*) AS x FROM o{t}) WHERE k <= m - x AND k <= d - x)",
            f"done{t + 1} AS (SELECT * FROM done{t} UNION ALL SELECT topic, bucket, DATE '{day}', 'own', k, {t} FROM o{t} UNION ALL SELECT topic, bucket, DATE '{day}', 'overflow', k + x, {t} FROM v{t})",
        ]
    return f"WITH {', '.join(steps)} SELECT topic, bucket, day, slot, place, tick FROM done{len(_DAYS)}"


@query("t09_quota_ledger", _ledger_sql())
def t09_ledger(spark, d):
    """Two ticks on one day, then the next day and the next month; each queue holds three quarters of the parts."""
    parts = table(spark, d, "part")
    queue = parts.select(F.concat_ws(" ", "p_name", "p_partkey").alias("topic"), F.expr(_BUCKET).alias("bucket"), F.col("p_partkey").alias("pos"), "p_size")
    return ledger.run([queue.where(F.col("p_size") % 4 != t).drop("p_size").withColumn("day", F.lit(day).cast("date")) for t, day in enumerate(_DAYS)], _QUOTA)


_KINDS = ("en", "de", "fr")
_UNITS = f"""u AS (SELECT doc_id AS unit_id, text, lang AS kind, source AS tag, CASE WHEN doc_id % 3 = 0 THEN lang END AS discipline, substr(sha256(coalesce(text, '')), 1, 32) AS fp,
              CASE WHEN length(trim(coalesce(text, ''))) < 100 THEN 'noise' WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr') THEN 'vocabulary' ELSE 'accepted' END AS reason, CASE WHEN doc_id <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) THEN 0 ELSE 1 END AS batch FROM documents),
     g AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY batch, unit_id) = 1 AS fresh FROM u WHERE reason = 'accepted')"""


def _ingested(spark, d) -> str:
    units = table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text", F.col("lang").alias("kind"), F.col("source").alias("tag"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("discipline"))
    return ingest.run(_halves(units, "unit_id"), ingest.Rules(lambda text: F.length(F.trim(text)) < 100, _KINDS))


@query("t24_ingested_units", f"WITH {_UNITS} SELECT unit_id, fp, kind, tag, batch FROM g WHERE fresh")
def t24_units(spark, d):
    return ingest.sink(spark, _ingested(spark, d), "units")


@query("t24_ingest_audit", f"WITH {_UNITS} SELECT unit_id, NULL::VARCHAR AS old_grade, 'unverified' AS new_grade, 'ingest' AS reason FROM g WHERE fresh")
def t24_audit(spark, d):
    return ingest.sink(spark, _ingested(spark, d), "audit").drop("batch")


@query("t24_ingest_tags", f"WITH {_UNITS} SELECT tag, arg_min(discipline, (batch, unit_id)) FILTER (WHERE discipline IS NOT NULL) AS discipline, count(*) AS units FROM g WHERE fresh AND tag IS NOT NULL GROUP BY 1")
def t24_tags(spark, d):
    return ingest.tags(spark, _ingested(spark, d))


@query("t25_ingest_lessons", f"WITH {_UNITS} SELECT reason AS lesson, coalesce(kind, '') AS ref, count(*) AS occurrences, arg_min(unit_id, (batch, unit_id)) AS evidence FROM u WHERE reason = 'vocabulary' GROUP BY ALL UNION ALL SELECT 'merge', '', count(*), NULL FROM g WHERE NOT fresh UNION ALL SELECT 'noise', '', count(*), NULL FROM u WHERE reason = 'noise'")
def t25_lessons(spark, d):
    """Lessons of rejected types, with the merges and the noise of both batches beside them."""
    folder = _ingested(spark, d)
    counted = lambda name, rows: rows.agg(F.lit(name).alias("lesson"), F.lit("").alias("ref"), F.count("*").alias("occurrences"), F.lit(None).cast("bigint").alias("evidence"))
    return ingest.lessons(spark, folder).unionByName(counted("merge", ingest.sink(spark, folder, "merges"))).unionByName(counted("noise", ingest.sink(spark, folder, "rejects").where("reason = 'noise'")))


_FEEDS = (("page", "pages", "page_id", "url"), ("part", "part", "p_partkey", "p_name"), ("supplier", "supplier", "s_suppkey", "s_name"))
_FEED_ITEMS = " UNION ALL ".join(f"SELECT '{kind}' AS source_type, {key}::VARCHAR AS external_id, {title} AS title FROM {name}" for kind, name, key, title in _FEEDS)


@query("s10_feed_source", f"SELECT *, '000001' AS delivery FROM ({_FEED_ITEMS})")
def s10_source(spark, d):
    """Three feeds, delivered as files and read by the source of their own."""
    out = None
    for kind, name, key, title in _FEEDS:
        folder = shared_folder(spark)
        feeds.deliver(table(spark, d, name), folder, 1, key, title)
        one = feeds.items(spark, folder, kind)
        out = one if out is None else out.unionByName(one)
    return out


@query("s11_feed_source_stream", "SELECT 'part' AS source_type, p_partkey::VARCHAR AS external_id, p_name AS title, CASE WHEN p_size % 3 <> 0 THEN '000001' ELSE '000002' END AS delivery FROM part")
def s11_source(spark, d):
    """Two deliveries of a feed, the second with known items too; the stream goes on from its offset and drops what it has met."""
    parts, folder = table(spark, d, "part"), shared_folder(spark)
    for number, some in ((1, parts.where("p_size % 3 <> 0")), (2, parts)):
        feeds.deliver(some, f"{folder}/feed", number, "p_partkey", "p_name")
        new = feeds.item_stream(spark, f"{folder}/feed", "part").dropDuplicates(["source_type", "external_id"])
        new.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(feeds.SCHEMA).parquet(f"{folder}/out")


@query("f17_book_chapters")
def f17_books(spark, d):
    """Documents as books, each of their long lines a chapter, behind a contents page and a preface that mentions a chapter."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 100)
    listed = F.array_join(F.transform(lines, lambda _, i: F.concat(F.lit("Chapter "), (i + 1).cast("string"))), "\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("# Chapter "), (i + 1).cast("string"), F.lit(": of it\n"), x)), "\n")
    books = table(spark, d, "documents").select("doc_id", F.concat(listed, F.lit("\n\nPreface\nChapter 2 tells more.\n\n"), body).alias("book"))
    return C.chapters(books, "book", 60).select("doc_id", "number", "start", "end")


def _links(spark, d):
    return strong(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").cast("double").alias("w"))


@query("g08_leiden")
def g08_leiden(spark, d):
    return G.leiden(_links(spark, d))


@query("g06_betweenness_by_levels")
def g06_levels(spark, d):
    return G.betweenness_by_levels(strong(spark, d))
