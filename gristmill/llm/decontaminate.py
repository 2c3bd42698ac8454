"""Benchmark decontamination: a broadcast hash set of test windows, probed by every training window.

A window is `width` consecutive words of a test item (the whole item if it has fewer). Each training
position forms, for each length of the windows, the hash of three of its window's words (first, middle,
last) and probes the broadcast set; candidates fetch their document's words and are verified on all
words of the window. The hot path is one narrow stage: tokenise once, hash, explode hashes and places
only, broadcast hash join; only candidates are shuffled.

The windows are counted first: above MAX_BROADCAST the set is joined by shuffling the hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ALNUM_GAP, alnum_words, ascii_lower, packed, small, text_or_empty, written

WIDTH = 13
MAX_BROADCAST = 200_000
#: A document is contaminated if at least one word in SHARE_OF is hit.
SHARE_OF = 20


def _probe(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), F.get(words, i), F.get(words, i + n // 2), F.get(words, i + n - 1))


def test_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(len, probe, window, wid, item): the distinct windows of all items that have words and an id."""
    words = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), alnum_words(ascii_lower(text_or_empty(text))).alias("w"))
    words = words.where(F.size("w") > 0).select("item", "w", F.least(F.size("w"), F.lit(width)).alias("len"))
    win = words.select("item", "len", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1), lambda i: F.slice("w", i, F.col("len")))).alias("window"))
    at = lambda k: F.element_at("window", k.cast("int"))
    probe = F.xxhash64(F.col("len"), at(F.lit(1)), at(F.floor(F.col("len") / 2) + 1), at(F.col("len")))
    return win.select("len", probe.alias("probe"), "window", F.xxhash64("window").alias("wid"), "item").distinct()


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A document is known by its key and a hash of its text, so that null and repeated keys do no harm."""
    return docs.select(F.col(key).alias("_key"), F.xxhash64(text_or_empty(text)).alias("_h"), text_or_empty(text).alias("_text"))


def find_hits(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_key, _h, pos, len, wid): every place where a window of `windows` occurs; pos counts words from 0."""
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())
    sets = windows.select("len", "probe", "window", "wid").distinct()
    words = _identified(docs, key, text).select("_key", "_h", alnum_words(ascii_lower(F.col("_text"))).alias("_words"))
    if not lengths:
        return words.where(F.lit(False)).select("_key", "_h", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("wid"))
    probe = lambda n: F.when(F.size("_words") >= n, F.transform(F.sequence(F.lit(0), F.size("_words") - n), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), _probe(F.col("_words"), i, n).alias("probe")))).otherwise(F.array().cast("array<struct<pos:int,len:int,probe:bigint>>"))
    probes = probe(lengths[0]) if len(lengths) == 1 else F.flatten(F.array(*[probe(n) for n in lengths]))
    # the words stay behind: a row of the explosion is a few numbers
    at = words.select("_key", "_h", F.explode(probes).alias("_p")).select("_key", "_h", "_p.*")
    maybe = written(at.join(small(sets, MAX_BROADCAST), ["len", "probe"]))
    ids = small(written(maybe.select("_key", "_h").distinct()))
    own = _identified(docs, key, text).alias("w").join(ids.alias("i"), F.expr("w._key <=> i._key and w._h = i._h"), "left_semi")
    own = own.dropDuplicates(["_key", "_h"]).select("_key", "_h", alnum_words(ascii_lower(F.col("_text"))).alias("_words"))
    both = maybe.alias("m").join(own.alias("w"), F.expr("m._key <=> w._key and m._h = w._h"))
    return both.where(F.slice("w._words", F.col("m.pos") + 1, F.col("m.len")) == F.col("m.window")).select("m._key", "m._h", "m.pos", "m.len", "m.wid")


def _spans(hits: DataFrame) -> DataFrame:
    """(_key, _h, spans): a document's hits as (pos, len), sorted; at most one for each word and window length."""
    return hits.groupBy("_key", "_h").agg(F.array_sort(F.collect_set(F.struct("pos", "len"))).alias("spans"))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, share_of: int = SHARE_OF) -> DataFrame:
    """Per row of docs: key, n_words, n_hit (words inside a hit), n_items, items_sha256, contaminated.

    A null or wordless text has no words and is clean. An empty benchmark hits nothing. Items without
    id or words are ignored. Repeated rows get equal results.
    """
    windows = written(test_windows(benchmark, item, item_text, width))
    hits = written(find_hits(docs, windows, key, text))
    step = lambda a, s: F.struct(
        (a.n + F.greatest(F.lit(0), s.pos + s.len - F.greatest(a.end, s.pos))).alias("n"), F.greatest(a.end, s.pos + s.len).alias("end"))
    covered = _spans(hits).select("_key", "_h", F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a.n).cast("long").alias("n_hit"))
    items = hits.select("_key", "_h", "wid").distinct().join(small(windows.select("wid", "item").distinct(), MAX_BROADCAST), "wid")
    items = items.groupBy("_key", "_h").agg(F.array_sort(F.collect_set("item")).alias("_items")).select("_key", "_h", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    base = _identified(docs, key, text).select("_key", "_h", F.size(F.array_remove(F.split("_text", ALNUM_GAP.replace(r"\x60", r"\x40\x5B-\x60")), "")).cast("long").alias("n_words"))
    found = covered.alias("c").join(items.alias("i"), F.expr("c._key <=> i._key and c._h = i._h")).select("c.*", "i.n_items", "i.items_sha256")
    out = base.alias("b").join(found.alias("f"), F.expr("b._key <=> f._key and b._h = f._h"), "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("f.n_hit", zero)
    return out.select(
        F.col("b._key").alias(key), F.col("b._h").alias("_h"), "b.n_words", n_hit.alias("n_hit"), F.coalesce("f.n_items", zero).alias("n_items"),
        F.coalesce("f.items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share_of >= F.col("b.n_words"))).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated."""
    bad = small(written(report(docs, benchmark, key, text, **options).where("contaminated").select(F.col(key).alias("_key"), "_h").distinct()))
    marked = packed(docs).withColumn("_t", F.xxhash64(text_or_empty(F.col("_row")[text])))
    return marked.join(bad, F.col("_row")[key].eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_h")), "left_anti").select("_row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with every hit word, and the gap before it, cut out of the text."""
    windows = written(test_windows(benchmark, item, item_text, width))
    spans = _spans(find_hits(docs, windows, key, text))
    marked = packed(docs).withColumn("_t", F.xxhash64(text_or_empty(F.col("_row")[text])))
    body = F.col("_row")[text]
    word = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    pieces = F.regexp_extract_all(body, F.lit(rf"[^0-9A-Za-z\x{{80}}-\x{{10FFFF}}]*{word}+"), F.lit(0))
    tail = F.regexp_extract(body, r"[^0-9A-Za-z\x{80}-\x{10FFFF}]*$", 0)
    left = F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (i >= s.pos) & (i < s.pos + s.len)))
    joined = marked.join(spans, F.col("_row")[key].eqNullSafe(F.col("_key")) & (F.col("_t") == F.col("_h")), "left")
    cut = F.when(F.col("spans").isNull(), body).otherwise(F.concat(F.array_join(left, ""), tail))
    return joined.select(F.col("_row").withField(f"`{text}`", cut).alias("_row")).select("_row.*")
