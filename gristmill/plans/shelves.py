"""Queries of whole books, of readers' tools, and of folders that Spark writes and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import answers as A
from gristmill.operators import books as B
from gristmill.plans.registry import query, table
from gristmill.sources import files as S

_UNITS = """(SELECT doc_id, source AS book, (doc_id % 7)::INT AS chapter, lang AS kind, array_to_string(string_split(text, ' ')[1:2], ' ') AS title, text, CASE WHEN n_chars % 50 <> 0 THEN text END AS translated, n_chars FROM documents)"""
_KEY = r"regexp_replace(lower(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 's+$', '')"
_OUTLINE = f"(SELECT DISTINCT book, chapter, {_KEY.format('title')} AS term FROM {_UNITS} JOIN labels USING (doc_id) WHERE quality = 1 AND book IS NOT NULL AND title IS NOT NULL)"
_MISSING = f"(SELECT * FROM {_OUTLINE} o WHERE NOT EXISTS (SELECT 1 FROM {_UNITS} u WHERE u.n_chars >= 300 AND u.book = o.book AND u.chapter = o.chapter AND {_KEY.format('u.title')} = o.term))"


def _books(spark, d):
    """Sources as books: documents of 300 characters or more are their units, titles of good ones their outline."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("book"), (F.col("doc_id") % 7).cast("int").alias("chapter"), F.col("lang").alias("kind"), F.substring_index("text", " ", 2).alias("title"),
        "text", F.when(F.col("n_chars") % 50 != 0, F.col("text")).alias("translated"), "n_chars")
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    outline = docs.join(good, "doc_id", "left_semi").select("book", "chapter", F.array("title").alias("terms"))
    return docs, docs.where("n_chars >= 300"), outline


@query("q04_missing_terms", f"SELECT * FROM {_MISSING}")
def missing(spark, d):
    _, units, outline = _books(spark, d)
    return B.missing_terms(units, outline)


@query("q04_book_gate_rules", f"""WITH u AS (SELECT * FROM {_UNITS} WHERE n_chars >= 300 AND book IS NOT NULL),
m AS (SELECT book, count(*) AS units, count(*) FILTER (WHERE regexp_matches(translated, '[A-Za-z]')) AS bilingual, count(*) FILTER (WHERE regexp_matches(translated, '[#%&*]{{3}}')) AS residue,
  count(*) FILTER (WHERE length(regexp_replace(translated, '[^A-Za-z]', '', 'g')) < 200) AS shells, count(*) FILTER (WHERE length(trim(text)) < 310) AS source_shells, count(*) FILTER (WHERE NOT contains(text, chr(10))) AS shallow, count(*) FILTER (WHERE kind = 'de') AS why FROM u GROUP BY 1),
t AS (SELECT book, max(n) AS top FROM (SELECT book, kind, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT book, count(*) AS chapters, count(*) FILTER (WHERE n < 6) AS low_chapters FROM (SELECT book, chapter, count(*) AS n FROM u WHERE chapter <> 0 GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT book, count(DISTINCT chapter) AS outlined FROM {_UNITS} JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1),
g AS (SELECT book, count(DISTINCT chapter) AS incomplete, count(*) AS missing FROM {_MISSING} GROUP BY 1),
v AS (SELECT DISTINCT source AS book, true AS overview FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
r AS (SELECT b.book, coalesce(units, 0) AS units, coalesce(bilingual, 0) AS bilingual, coalesce(residue, 0) AS residue, coalesce(shells, 0) AS shells, coalesce(source_shells, 0) AS source_shells, coalesce(shallow, 0) AS shallow, coalesce(why, 0) AS why,
  coalesce(chapters, 0) AS chapters, coalesce(low_chapters, 0) AS low_chapters, coalesce(missing, 0) AS missing, coalesce(overview, false) AS overview, round_even(100.0 * coalesce(bilingual, 0) / greatest(coalesce(units, 0), 1), 0)::INT AS bilingual_share,
  CASE WHEN units > 0 THEN top / units ELSE 1.0 END AS top_share, coalesce(units, 0) / greatest(12, coalesce(chapters, 0) * 5) AS density, round_even(100.0 * (outlined - coalesce(incomplete, 0)) / outlined, 0)::INT AS complete
  FROM (SELECT DISTINCT source AS book FROM documents WHERE source IS NOT NULL) b LEFT JOIN m USING (book) LEFT JOIN t USING (book) LEFT JOIN c USING (book) LEFT JOIN o USING (book) LEFT JOIN g USING (book) LEFT JOIN v USING (book)),
x AS (SELECT *, array_to_string(list_filter([CASE WHEN complete < 100 THEN 'incomplete' END, CASE WHEN residue > 0 THEN 'residue' END, CASE WHEN shells > 0 THEN 'shells' END, CASE WHEN source_shells > 0 THEN 'source shells' END, CASE WHEN bilingual_share < 99 THEN 'not bilingual' END,
  CASE WHEN density < 0.6 THEN 'sparse' END, CASE WHEN low_chapters > 2 THEN 'low chapters' END, CASE WHEN NOT overview THEN 'no overview' END, CASE WHEN units > 0 AND why = 0 THEN 'no why' END, CASE WHEN top_share > 0.95 AND units > 20 THEN 'one kind' END], lambda a: a IS NOT NULL), ',') AS alarms,
  array_to_string(list_filter([CASE WHEN shallow > 0 THEN 'shallow' END, CASE WHEN complete IS NULL THEN 'completeness unknown' END], lambda a: a IS NOT NULL), ',') AS warnings FROM r)
SELECT * REPLACE (round(top_share, 6) AS top_share, round(density, 6) AS density), CASE WHEN alarms = '' THEN 'pass' ELSE 'alarm' END AS verdict FROM x""")
def gate(spark, d):
    """All sources; the lengths of shells and the units of a chapter are this table's, all other limits the gate's own."""
    docs, units, outline = _books(spark, d)
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    overviews = docs.join(toxic, "doc_id", "left_semi").select("book")
    limits = B.BookLimits(shell_length=200, source_shell_length=310, units_per_chapter=5)
    out = B.book_gate(docs, units, outline, overviews, "[#%&*]{3}", ~F.col("text").contains("\n"), "de", "A-Za-z", limits)
    return out.withColumns({"top_share": F.round("top_share", 6), "density": F.round("density", 6), "alarms": F.array_join("alarms", ","), "warnings": F.array_join("warnings", ",")})


@query("s20_notes_by_id", "SELECT event_id, user_id, source AS title, n_chars AS size, CASE WHEN doc_id IS NULL THEN 'Note not found' END AS error FROM events LEFT JOIN documents ON doc_id = event_id // 10 AND doc_id % 5 = user_id % 5 AND NOT n_chars < 200")
def notes(spark, d):
    """Each event asks for a document; its owner is the id modulo 5, and short documents are deleted notes."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("owner"), "source", "n_chars")
    asked = table(spark, d, "events").select("event_id", "user_id", F.expr("event_id div 10").alias("id"), (F.col("user_id") % 5).alias("owner"))
    fields = {"title": F.col("source"), "size": F.col("n_chars")}
    return A.fetched(asked, rows, "id", "owner", fields, F.col("n_chars") < 200, "Note not found").drop("id", "owner")


@query("s20_substrates_by_id", "SELECT event_id, p_name AS title, coalesce(p_size > 40, false) AS is_pinned, CASE WHEN p_partkey IS NULL THEN 'Not found' END AS error FROM events LEFT JOIN part ON p_partkey = event_id AND p_partkey % 3 = user_id % 3")
def substrates(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("owner"), "p_name", "p_size")
    asked = table(spark, d, "events").select("event_id", F.col("event_id").alias("id"), (F.col("user_id") % 3).alias("owner"))
    found = A.fetched(asked, rows, "id", "owner", {"title": F.col("p_name"), "is_pinned": F.col("p_size") > 40})
    return found.select("event_id", "title", F.coalesce("is_pinned", F.lit(False)).alias("is_pinned"), "error")


@query("s20_recent_notes", "SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS at FROM orders WHERE o_orderstatus <> 'F' AND o_custkey IS NOT NULL QUALIFY \"at\" <= 20")
def recent(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    out = A.recent(rows, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 20, F.col("o_orderstatus") == "F")
    return out.select("o_custkey", "o_orderkey", "o_orderdate", F.col("at").cast("bigint").alias("at"))


@query("s20_changes_since", "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS at FROM events WHERE user_id IS NOT NULL AND event_id > CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN user_id * 10 ELSE 0 END QUALIFY \"at\" <= 20")
def changes(spark, d):
    """Customers divisible by 3 have read up to ten times their number, the others nothing."""
    cursors = table(spark, d, "customer").where("c_custkey % 3 = 0").selectExpr("c_custkey as user_id", "c_custkey * 10 as since")
    out = A.changes_since(table(spark, d, "events").select("user_id", "event_id", "event_type"), cursors, "user_id", "event_id", 20)
    return out.withColumn("at", F.col("at").cast("bigint"))


_SHELF = r"/shelf=([^/]*)/"
_PAGES = "(SELECT page_id // 16 AS shelf, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id) AS content FROM pages WHERE page_id // 16 % 4 <> 1 GROUP BY 1)"


@query("s08_shelf_sidecars", """SELECT shelf::VARCHAR AS stem, length(text)::BIGINT AS n_chars, sha256(text) AS hash, id, good FROM (SELECT doc_id // 16 AS shelf, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS text FROM documents GROUP BY 1)
JOIN (SELECT doc_id // 16 AS shelf, 'shelf ' || (doc_id // 16)::VARCHAR AS id, sum(quality)::BIGINT AS good FROM labels GROUP BY 1, 2) USING (shelf) WHERE shelf % 5 <> 0""")
def sidecars(spark, d):
    """Documents and notes on them in files, a file for 16 ids; every fifth note names nothing."""
    folder, shelf = S.shared_folder(spark), F.expr("doc_id div 16").alias("shelf")
    S.shelved(table(spark, d, "documents").select(shelf, "doc_id", "text"), "shelf", "doc_id", "text", f"{folder}/texts")
    name = F.when(F.col("shelf") % 5 != 0, F.concat(F.lit("shelf "), F.col("shelf").cast("string"))).otherwise("")
    marks = table(spark, d, "labels").groupBy(shelf).agg(F.sum("quality").alias("good")).select("shelf", name.alias("id"), "good")
    marks.repartition("shelf").write.partitionBy("shelf").json(f"{folder}/notes")
    both = S.documents_with_sidecars(spark, folder, "id string, good bigint", "*.txt", _SHELF)
    return both.select("stem", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("hash"), "id", "good")


@query("s09_shelf_scan", f"SELECT shelf, strlen(content)::BIGINT AS length, sha256(content) AS hash FROM {_PAGES} WHERE strlen(content) <= 60000 AND sha256(content) NOT IN (SELECT sha256(content) FROM {_PAGES} WHERE shelf % 3 = 0)")
def scan(spark, d):
    """Pages in files of 16, every fourth of another kind; files of every third were seen by an earlier scan."""
    folder = S.shared_folder(spark)
    pages = table(spark, d, "pages").select(F.expr("page_id div 16").alias("shelf"), "page_id", "html")
    S.shelved(pages.where("shelf % 4 <> 1"), "shelf", "page_id", "html", f"{folder}/pages")
    pages.where("shelf % 4 = 1").repartition("shelf").write.partitionBy("shelf").json(f"{folder}/other")
    shelf = F.regexp_extract("path", _SHELF, 1).cast("bigint")
    before = S.folder_scan(spark, folder, [".txt"], 1 << 30).where(shelf % 3 == 0)
    return S.folder_scan(spark, folder, [".txt", ".md"], 60000, before).select(shelf.alias("shelf"), "length", "hash")


@query("s16_needs_files", """WITH n AS (SELECT p_name AS topic, list_sort(list(DISTINCT p_brand)) AS subtopics FROM part GROUP BY 1)
SELECT topic, 'asked' AS reason FROM n UNION ALL SELECT unnest(subtopics[1:10]), 'subtopic of ' || topic FROM n""")
def needs(spark, d):
    """Names of parts as needs, their brands as subtopics."""
    folder = S.shared_folder(spark)
    rows = table(spark, d, "part").groupBy(F.col("p_name").alias("topic")).agg(F.array_sort(F.collect_set("p_brand")).alias("subtopics"))
    S.export_json(rows.withColumn("reason", F.lit("asked")), folder)
    return S.needs(spark, folder)
