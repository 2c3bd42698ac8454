"""Full-text search: a positional inverted index as a table, and batches of queries as users type them.

A query holds words, "quoted phrases", OR and -exclusions: words beside each other must all be there,
OR stands between alternatives, a minus excludes. A word of several tokens is a phrase. Queries are
rows, and all of a batch are answered by one join of their words with the index.

Index: a row for each term and document with the term's positions, in folders by a hash of the term, so
that a batch reads the folders of its own terms only; a common term's rows are dealt over several
files. Phrases are met at their documents first and by positions then, in arrays of one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.graph import stored
from gristmill.sources.files import shared_folder

#: A token: a run of Latin letters and digits, or one Han character, so that Han words are phrases.
TOKEN = "[a-z0-9]+|[一-鿿]"
#: Folders of the index, files of a folder, and the usual constants of BM25.
FOLDERS, FILES, K1, B = 64, 8, 1.2, 0.75
#: Words of a batch up to which they are broadcast; each row is of a bounded size as terms are cut at CUT letters.
BROADCAST_WORDS, CUT = 100_000, 64


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.substring(t, 1, CUT))


@dataclass
class Index:
    """postings: _folder, term, id, n (the document's tokens), positions; and the number of documents and their mean tokens."""

    postings: DataFrame
    documents: int
    mean: float


def build(df: DataFrame, key: str, text: str) -> Index:
    """The index of texts by a unique key; a null text is empty."""
    path = shared_folder(df.sparkSession)
    words = df.select(F.col(key).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    placed = words.select("id", F.size("_w").alias("n"), F.posexplode("_w").alias("_p", "term"))
    lists = placed.groupBy("term", "id", "n").agg(F.sort_array(F.collect_list("_p")).alias("positions"))
    rows = lists.withColumn("_folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int"))
    rows.repartition("_folder", F.pmod(F.xxhash64("id"), F.lit(FILES))).sortWithinPartitions("_folder", "term", "id").write.partitionBy("_folder").parquet(path)
    n, mean = words.agg(F.count("*"), F.coalesce(F.avg(F.size("_w")), F.lit(0.0))).first()
    return Index(df.sparkSession.read.schema(rows.schema).parquet(path), n, mean)


def parsed(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(q, alternative, item, excluded, words) of every query: an alternative's items are words or phrases."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r'-?"[^"]*"?|\S+'), F.lit(0))
    rows = queries.select(F.col(key).alias("q"), parts.alias("_parts")).select("q", "_parts", F.posexplode("_parts").alias("item", "_part"))
    is_or = lambda x: F.lower(x) == "or"
    alternative = F.size(F.filter(F.slice("_parts", F.lit(1), F.col("item")), is_or))
    items = rows.where(~is_or(F.col("_part"))).select("q", alternative.alias("alternative"), "item", F.col("_part").startswith("-").alias("excluded"), tokens(F.col("_part")).alias("words"))
    return items.where(F.size("words") > 0)


def occurrences(index: Index, items: DataFrame) -> DataFrame:
    """(q, alternative, item, excluded, id, n, starts): the places at which an item's words stand one after another."""
    asked = items.select("q", "alternative", "item", "excluded", F.size("words").alias("_k"), F.posexplode("words").alias("_at", "term"))
    asked = stored(asked.withColumn("_folder", F.pmod(F.xxhash64("term"), F.lit(FOLDERS)).cast("int")))
    folders = [r._folder for r in asked.select("_folder").distinct().collect()]  # FOLDERS at most
    side = F.broadcast(asked) if asked.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else asked
    met = index.postings.where(F.col("_folder").isin(folders)).join(side, ["_folder", "term"])
    starts = F.transform("positions", lambda p: p - F.col("_at"))
    lists = met.groupBy("q", "alternative", "item", "excluded", "_k", "id", "n").agg(F.collect_list(F.when(F.col("_k") > 1, starts).otherwise(F.col("positions"))).alias("_s"))
    common = F.aggregate(F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))), F.col("_s")[0], lambda a, x: F.array_intersect(a, x))
    return lists.where(F.size("_s") == F.col("_k")).withColumn("starts", common).where(F.size("starts") > 0).drop("_s", "_k")


def _density(items: Column) -> Column:
    """Items divided by the places of the tightest stretch with all of them; 0 for a single item. items: structs with starts."""
    events = F.array_sort(F.flatten(F.transform(items, lambda one, i: F.transform(one["starts"], lambda s: F.struct(s.cast("int").alias("p"), i.cast("int").alias("i"))))))
    start = F.struct(F.transform(items, lambda _: F.lit(None).cast("int")).alias("last"), F.lit(None).cast("int").alias("best"))

    def step(state: Column, e: Column) -> Column:
        last = F.transform(state["last"], lambda x, j: F.when(j == e["i"], e["p"]).otherwise(x))
        wide = F.when(~F.exists(last, lambda x: x.isNull()), e["p"] - F.array_min(last) + 1)
        return F.struct(last.alias("last"), F.least(state["best"], wide).alias("best"))

    tightest = F.aggregate(events, start, step, lambda s: s["best"])
    return F.when(F.size(items) > 1, F.size(items) / tightest).otherwise(F.lit(0.0))


def search(index: Index, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(q, id, score, rank): for each query its k best documents, by BM25 of the items plus how close together they stand.

    An alternative without an item that must be there finds nothing. Ties of the score go by id.
    """
    items = stored(parsed(queries, key, text))
    found = stored(occurrences(index, items))
    at = ["q", "alternative"]
    needed = items.groupBy(*at).agg(F.count_if(~F.col("excluded")).alias("_needed"))
    have = found.where(~F.col("excluded")).groupBy(*at, "item").agg(F.count("*").alias("_d"))
    tf, n = F.size("starts"), F.lit(float(index.documents))
    idf = F.log(1 + (n - F.col("_d") + 0.5) / (F.col("_d") + 0.5))
    weight = F.when(~F.col("excluded"), idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(max(index.mean, 1e-9)))))
    members = F.sort_array(F.collect_list(F.when(~F.col("excluded"), F.struct("item", "starts", weight.alias("weight")))))
    met = found.join(have, [*at, "item"], "left").groupBy(*at, "id").agg(members.alias("_m"), F.count_if("excluded").alias("_out")).join(needed, at)
    met = met.where((F.col("_out") == 0) & (F.size("_m") == F.col("_needed")) & (F.col("_needed") > 0))
    score = F.aggregate("_m", F.lit(0.0), lambda a, x: a + x["weight"]) + _density(F.col("_m"))
    best = met.groupBy("q", "id").agg(F.round(F.max(score), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def backfilled(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """(q, id, pos): for each query all dense hits by rank, then the lexical ones that dense has not; k of them. Both: q, id, rank."""
    both = dense.select("q", "id", F.col("rank").alias("_d")).join(lexical.select("q", "id", F.col("rank").alias("_l")), ["q", "id"], "full_outer")
    both = both.withColumn("pos", F.coalesce("_d", F.lit(100_000) + F.col("_l")))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("pos"))).where(F.col("_r") <= k).select("q", "id", "pos")
