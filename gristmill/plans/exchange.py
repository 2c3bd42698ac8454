"""Source and sink queries: what is written to files and read back, pairing of files, folder and feed scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import joins as J
from gristmill.operators import topk as K
from gristmill.plans.joins import VEC
from gristmill.plans.ordering import DIST, QUERY
from gristmill.plans.registry import query, table
from gristmill.sources import files as S
from gristmill.sources import tables as T
from gristmill.streaming.state import ticks


@query("s03_insert_returning", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def s03(spark, d):
    return T.insert_returning(table(spark, d, "supplier").where("s_acctbal > 0"), S.shared_folder(spark), ["s_suppkey"])


@query("s08_sidecars", "SELECT d.doc_id::VARCHAR AS stem, d.lang, l.doc_id::VARCHAR AS id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.doc_id % 5 <> 0")
def s08(spark, d):
    texts = table(spark, d, "documents").select(F.concat(F.lit("inbox/"), "doc_id", F.lit(".md")).alias("path"), "lang")
    name = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).otherwise("")
    notes = table(spark, d, "labels").select(F.concat(F.lit("notes/"), "doc_id", F.lit(".json")).alias("path"), name.alias("id"), "quality")
    return S.paired(texts, notes)


@query("s09_folder_scan", "SELECT url || '.html' AS path, strlen(html)::BIGINT AS length, sha256(html) AS hash FROM pages WHERE page_id % 4 <> 1 AND strlen(html) <= 4000 AND sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0 AND html IS NOT NULL)")
def s09(spark, d):
    pages = table(spark, d, "pages").where("html is not null")
    found = pages.select(F.concat("url", F.when(F.col("page_id") % 4 == 1, ".pdf").otherwise(".html")).alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    seen = pages.where("page_id % 3 = 0").select(F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
    return S.admitted(found, [".html", ".htm"], 4000, seen)


def _items(spark, d):
    feeds = (("page", "pages", "page_id", "url"), ("part", "part", "p_partkey", "p_name"), ("supplier", "supplier", "s_suppkey", "s_name"))
    out = None
    for kind, name, key, title in feeds:
        one = S.source_items(table(spark, d, name), kind, key, title)
        out = one if out is None else out.unionByName(one)
    return out


_ITEMS = "(SELECT 'page' AS source_type, page_id::VARCHAR AS external_id, url AS title FROM pages UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier)"


@query("s10_source_items", f"SELECT * FROM {_ITEMS}")
def s10(spark, d):
    return _items(spark, d)


@query("s11_feed_tick", f"SELECT * FROM {_ITEMS} WHERE NOT (source_type = 'part' AND external_id::INT % 2 = 0)")
def s11(spark, d):
    items = _items(spark, d)
    return S.new_items(items.unionByName(items), items.where("source_type = 'part' and cast(external_id as int) % 2 = 0"))


@query("s11_feed_stream", f"SELECT * FROM {_ITEMS}")
def s11_stream(spark, d):
    """Two ticks of the feeds, the second of which brings known items again."""
    items = _items(spark, d)
    return ticks([items.where("source_type <> 'part'"), items], lambda new: new.dropDuplicates(["source_type", "external_id"]))


@query("s12_gold_files", "SELECT doc_id::VARCHAR AS pair_id, CASE WHEN doc_id % 2 = 0 THEN 'later' ELSE 'label ' || quality::VARCHAR END AS label FROM labels WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0")
def s12(spark, d):
    folder, rows = S.shared_folder(spark), table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("pair_id"), "doc_id", "quality")
    first = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("label "), F.col("quality").cast("string")))
    S.export_json(rows.select("pair_id", first.alias("label")), f"{folder}/1")
    S.export_json(rows.where("doc_id % 2 = 0").select("pair_id", F.lit("later").alias("label")), f"{folder}/2")
    return S.gold(spark, f"{folder}/*/*.json")


@query("s13_export_new", "SELECT p_partkey, p_brand FROM part WHERE p_size <= 20 AND p_partkey % 4 <> 0")
def s13(spark, d):
    path = S.shared_folder(spark)
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") <= 20, "ok").otherwise("poor").alias("parse_quality"), F.when(F.col("p_partkey") % 4 == 0, True).alias("exported"))
    marked = S.export_new(parts, "exported", path, "parse_quality = 'ok'")
    S.export_new(marked, "exported", path, "parse_quality = 'ok'")  # a second run finds nothing new
    return spark.read.schema("p_partkey bigint, p_brand string").json(path)


@query("l05_nearest_of_type", f"SELECT vec_id, label, {DIST} AS dist FROM {VEC} WHERE label = 1 ORDER BY dist, vec_id LIMIT 20")
def l05(spark, d):
    return K.nearest(table(spark, d, "embeddings").where("label = 1"), "embedding", QUERY, 20, "vec_id", ["label"])


@query("f59_year_overlap", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'unknown' WHEN greatest(1900 + c_custkey % 60, 1930) - least(1904 + c_custkey % 60, 1935) <= 5 THEN 'overlap' WHEN greatest(1900 + c_custkey % 60, 1930) - least(1904 + c_custkey % 60, 1935) <= 20 THEN 'near' ELSE 'far' END AS relation FROM customer")
def f59(spark, d):
    start = (F.lit(1900) + F.col("c_custkey") % 60).cast("int")
    rows = table(spark, d, "customer").select("c_custkey", start.alias("y0"), F.when(F.col("c_custkey") % 7 != 0, start + 4).alias("y1"))
    return rows.select("c_custkey", J.interval_relation(F.col("y0"), F.col("y1"), F.lit(1930), F.lit(1935)).alias("relation"))
