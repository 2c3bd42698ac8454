"""Quality rules: per-text statistics and cross-document line frequency, all in JVM expressions.

A line that many documents of one host share is boilerplate. Lines are normalised and hashed; per host
the number of different documents that hold the line is counted; lines above the limit are removed
from all of them but the first; a document of which too little is left is depleted and rejected. The
first document (smallest key) keeps its lines so that of a text with many copies one is left for the
removal of duplicates to choose.

Scale: one scan of the texts gives the statistics and, as two small numbers each, the lines; these facts are
written, and all else reads them. Lines are counted with map-side combining; only those above the
limit meet their documents again, by a broadcast where the measured size allows it and else with hot
lines apart from the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import found, packed, plain_words, small, text_or_empty, written

SYMBOLS = r"[#*$%&|<>]"
#: A line is boilerplate if more documents of its host hold it.
LINE_DOCS = 10
#: A document is depleted if removal leaves fewer words than MIN_WORDS or less than LEFT_SHARE of them.
MIN_WORDS = 50
LEFT_SHARE = 0.30


def repeated_window_words(words: Column, n: Column, width: int = 3) -> list[tuple[str, Column]]:
    """Column steps (name, expression) that end in n_repeat_words: words in windows that occur twice or more.

    Window hashes carry their position in the low bits, so that one primitive sort brings equal
    windows together; neighbours are then compared word by word.
    """
    def same(a: Column, b: Column) -> Column:
        mask = F.col("_mask")
        at = lambda k, j: F.get(F.col("_words"), (k.bitwiseAND(mask)).cast("int") + j)
        equal = (a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(mask)) == 0)
        for j in range(width):
            equal = equal & (at(a, j) == at(b, j))
        return F.coalesce(equal, F.lit(False))

    window = lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(width)])
    keys = F.when(
        F.col("_n") >= width,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n") - width), lambda i: window(i).bitwiseAND(F.bitwise_not(F.col("_mask"))).bitwiseOR(i.cast("long")))),
    ).otherwise(F.array().cast("array<bigint>"))
    return [
        ("_words", words),
        ("_n", n),
        ("_mask", F.expr("shiftleft(1L, length(bin(_n))) - 1L")),
        ("_keys", keys),
        ("_again", F.filter(F.col("_keys"), lambda k, i: same(k, F.get(F.col("_keys"), i + 1)) | same(F.get(F.col("_keys"), i - 1), k))),
        ("_at", F.sort_array(F.transform(F.col("_again"), lambda k: k.bitwiseAND(F.col("_mask"))))),
        ("n_repeat_words", F.aggregate(F.transform(F.col("_at"), lambda p, i: F.coalesce(F.least(F.lit(width).cast("long"), F.get(F.col("_at"), i + 1) - p), F.lit(width).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)),
    ]


def base_metrics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as empty: all counts 0, base_failed true. Repeated rows give repeated rows.
    """
    t = F.col("_text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, text_or_empty(text).alias("_text"))
    df = df.select(*keep, "_text", plain_words(t).alias("_words"), lines.alias("_lines"))
    df = df.select(*keep, "_text", "_words", "_lines", F.size("_words").alias("_n"))
    for name, col in repeated_window_words(F.col("_words"), F.col("_n"))[2:]:
        df = df.withColumn(name, col)
    n = F.col("_n").cast("long")
    out = df.select(
        *keep,
        n.alias("n_words"),
        F.char_length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def facts(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """Per row of docs: _key, _h (hash of the text), _host, _id (the document: its key, without one its text), _marks (hash and words of each line, in order; 0 words for an empty one) and base_metrics."""
    t = text_or_empty(text)
    clean = F.lower(F.regexp_replace(t, r"[\x20\x09\x0B-\x0D]+", " "))
    marks = F.transform(F.split(clean, "\n"), lambda x: F.struct(F.xxhash64(F.trim(x)).alias("h"), F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), " "))).alias("w")))
    rows = docs.select(
        F.col(key).alias("_key"), F.xxhash64(t).alias("_h"), F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("n")).alias("_host"),
        F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("t"), F.xxhash64(t).cast("string"))).alias("_id"), marks.alias("_marks"), F.col(text).alias("_body"))
    return base_metrics(rows, "_body", ("_key", "_h", "_host", "_id", "_marks"))


def frequent_lines(known: DataFrame, min_docs: int = LINE_DOCS) -> DataFrame:
    """(_host, h, line_docs, first) of the lines that more than min_docs documents of a host hold; known: written facts."""
    held = known.select("_host", "_id", "_key", F.explode(F.array_distinct(F.transform(F.filter("_marks", lambda x: x.w > 0), lambda x: x.h))).alias("h"))
    # rows that share a key are one document: by rows first, which is no less, then by documents
    maybe = written(held.groupBy("_host", "h").agg(F.count("*").alias("_n")).where(F.col("_n") > min_docs).select("_host", "h", F.lit(True).alias("_maybe")))
    some = found(held, maybe, ["_host", "h"]).where("_maybe")
    each = some.groupBy("_host", "h", "_id").agg(F.min("_key").alias("_key"))
    return each.groupBy("_host", "h").agg(F.count("*").alias("line_docs"), F.min("_key").alias("first")).where(F.col("line_docs") > min_docs)


def removals(known: DataFrame, min_docs: int = LINE_DOCS) -> DataFrame:
    """(_key, _h, _host, _cut, n_removed_words): per text of a document the places of the lines to remove, in order."""
    often = written(frequent_lines(known, min_docs))
    lines = known.select("_key", "_h", "_host", F.posexplode("_marks").alias("_at", "_l")).where("_l.w > 0").select("_key", "_h", "_host", "_at", F.col("_l.h").alias("h"), F.col("_l.w").alias("w"))
    hit = found(lines, often, ["_host", "h"]).where("line_docs is not null and not (_key <=> first)")
    # equal rows give equal places, so that a set of them is right; a document's own lines bound it
    return hit.groupBy("_key", "_h", "_host").agg(F.sort_array(F.collect_set(F.struct("_at", "w"))).alias("_c")).select("_key", "_h", "_host", F.col("_c._at").alias("_cut"), F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x.w).alias("n_removed_words"))


def _judged(known: DataFrame, min_docs: int, left_share: float) -> DataFrame:
    """The facts with _cut, n_removed_words and kept."""
    cut = removals(known, min_docs).alias("r")
    out = known.drop("_marks", "_id").alias("f").join(cut, F.expr("f._key <=> r._key and f._h = r._h and f._host = r._host"), "left").select("f.*", "r._cut", F.coalesce("r.n_removed_words", F.lit(0).cast("long")).alias("n_removed_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < MIN_WORDS) | (left < F.col("n_words") * left_share))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", min_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """base_metrics plus n_removed_words and kept, one row per row of docs.

    kept is false if base_failed or the document is depleted. A null host is a host of its own. Rows
    that share a key are one document in the counts, each judged by its own text; a row with a null key
    is the document of its text. Empty tables give no rows; columns of docs other than key, text and
    host are not read, so that clashing names do no harm.
    """
    out = _judged(written(facts(docs, text, host, key)), min_docs, left_share)
    return out.withColumnRenamed("_key", key).select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", min_docs: int = LINE_DOCS, left_share: float = LEFT_SHARE, size: str | None = None) -> DataFrame:
    """The rows of docs that are kept, without the lines above the limit; size: a column that holds the text's length, set anew where lines go.

    Defined for the same cases as judge. Texts from which nothing is removed stay as they are, nulls too.
    """
    todo = _judged(written(facts(docs, text, host, key)), min_docs, left_share).where("not kept or _cut is not null").select("_key", "_h", "_host", "_cut", "kept").distinct()
    row = F.col("_row")
    mine = packed(docs).select("_row", F.xxhash64(text_or_empty(row[text])).alias("_t"), F.coalesce(F.concat(F.lit("h"), row[host].cast("string")), F.lit("n")).alias("_of"))
    both = mine.join(small(written(todo)), row[key].eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_h")) & (F.col("_of") == F.col("_host")), "left").where(F.coalesce("kept", F.lit(True)))
    stay = F.array_join(F.filter(F.split(row[text], "\n"), lambda x, i: ~F.array_contains("_cut", i)), "\n")
    body = F.when(F.col("_cut").isNull(), row[text]).otherwise(stay)
    new = row.withField(f"`{text}`", body)
    if size:
        kind = docs.schema[size].dataType
        new = new.withField(f"`{size}`", F.when(F.col("_cut").isNull(), row[size]).otherwise(F.char_length(stay).cast(kind)))
    return both.select(new.alias("_row")).select("_row.*")
