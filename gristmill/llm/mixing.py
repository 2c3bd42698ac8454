"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash. A copy of a document finishes at the virtual time
(earlier copies' words + the source's words up to and with it) / the source's target. Copies are
ordered by finish time over all sources and taken until the total budget is reached, so that at each
moment every source has got its share. A source may be passed over up to MAX_EPOCHS times.

Scale: running sums use buckets of the hash inside a source, so that a source with a third of all
rows is spread over many tasks; finish times fall in ranges that hold about equal numbers of words,
and only the one range in which the budget runs out is summed row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import packed, plain_words, small, text_or_empty, written
from gristmill.llm.ordering import running

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
BUCKET_ROWS = 2_000
SPREAD = 1 << 30


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """(_src, source_size, target) from (_src, source_size): the budget shared by weight, nobody above max_epochs times its size.

    Sources that the common rate would fill beyond their cap are those with the lowest cap per weight;
    in that order a running sum tells where the capped ones end. One row per source is all that this sees.
    """
    order = Window.orderBy("_src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    s = sources.withColumn("_w", weight).withColumn("_cap", cap)
    ratio = Window.orderBy((F.col("_cap") / F.col("_w")), "_src")
    upto, after, all_rows = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    s = s.withColumn("_rate", (F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("_w").over(after))
    s = s.withColumn("_free", F.min(F.when(F.col("_rate") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("a"), "_src", "_rate"))).over(all_rows)["_rate"])
    return s.select("_src", "source_size", F.when(F.col("_free").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_free") * F.col("_w"))).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Per row of docs: key, size, source_size, target, copies, taken (size x copies), and the columns in keep.

    Sizes are plain words; a null text has 0 and is never taken. A null source is a source, the last.
    Repeated rows are documents of their own. An empty table gives no rows.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))
    sized = docs.select(F.col(key).alias("_key"), *keep, src.alias("_src"), F.size(plain_words(text_or_empty(text))).cast("long").alias("size"), F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(seed)), F.lit(SPREAD)).alias("_u"))
    sized = written(sized)
    per_source = targets(sized.groupBy("_src").agg(F.sum("size").alias("source_size")), **options)
    buckets = int(max(64, min(65_536, sized.count() // BUCKET_ROWS)))
    spread = sized.withColumn("_bucket", F.floor(F.col("_u") * buckets / SPREAD).cast("int"))
    spread = spread.withColumn("_row", F.row_number().over(Window.partitionBy("_src", "_bucket").orderBy("_u", "_key")))
    summed = running(spread, ["_src"], ["_bucket"], [F.col("_row")], {"_before": "size"})
    line = written(summed.join(small(written(per_source)), "_src"))
    budget = line.agg(F.sum("size")).first()[0] or 0
    budget = int(budget * options.get("share", 1.0))
    epochs = options.get("max_epochs", MAX_EPOCHS)
    pieces = int(max(64, min(1 << 20, budget // 50_000)))
    finish = lambda k: (F.col("_before") + F.col("size") + F.col("source_size") * k) / F.col("target")
    copies = line.where("size > 0 and target > 0").select("_src", "_bucket", "_row", "size", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), finish(k).alias("f")) for k in range(epochs)])).alias("c"))
    copies = copies.select("_src", "_bucket", "_row", "size", "c.k", "c.f", F.least(F.floor(F.col("c.f") * pieces), F.lit(8 * pieces)).cast("int").alias("_piece"))
    # The copies taken make up the budget: pieces up to the one where it runs out, then that piece's copies in order.
    per_piece = copies.groupBy("_piece").agg(F.sum("size").alias("n"))
    upto = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    last = per_piece.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") > budget).agg(F.min(F.struct("_piece", "upto", "n"))).first()[0]
    cut, left = (last["_piece"], budget - (last["upto"] - last["n"])) if last else (1 << 30, 0)
    edge = copies.where(F.col("_piece") == cut)
    inside = Window.partitionBy("_piece").orderBy("f", "_src", "_bucket", "_row", "k").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_sum", F.sum("size").over(inside)).where(F.col("_sum") <= left).groupBy("_src", "_bucket", "_row").agg(F.count("*").alias("_edge"))
    whole = sum((F.when(F.floor(finish(k) * pieces) < cut, 1).otherwise(0) for k in range(epochs)), F.lit(0))
    out = line.join(small(written(edge)), ["_src", "_bucket", "_row"], "left")
    out = out.withColumn("copies", F.when((F.col("size") > 0) & (F.col("target") > 0), whole + F.coalesce("_edge", F.lit(0).cast("long"))).otherwise(0).cast("int"))
    return out.select(F.col("_key").alias(key), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), *keep)


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    counts = mix(docs.select(F.col(key), F.col(text), F.col(source), F.xxhash64(text_or_empty(text)).alias("_h")), key, text, source, keep=("_h",), **options)
    chosen = written(counts.where("copies > 0").groupBy(F.col(key).alias("_k"), "_h").agg(F.max("copies").alias("copies")))
    marked = packed(docs).withColumn("_t", F.xxhash64(text_or_empty(F.col("_row")[text])))
    out = marked.join(chosen, F.col("_row")[key].eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_h")))
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
