"""Merkle manifest of a table: an external store of nodes by level, proofs by merge-scans of the levels, folding of proofs.

A row is a leaf: the digest of its five fields. Each source has a tree, its leaves in order of doc_id;
every FAN consecutive nodes of a level become one node of the next, until one is left. The subroots,
in order of source, are the leaves of one more tree, whose last node is the root.

Store: leaves get their coordinates (tree, place) from a range partitioning and per-range counts. Each
level is a Parquet table of runs (tree, run, the digests of its nodes), written from the level before
in one pass, a FAN-th of its size. Proofs go the other way: a level meets the next on (tree, run div
FAN), so that what stands above a run is fetched once for all its leaves, and runs are opened into
leaves at the end. No group holds more than FAN rows, no tree is in one task.

Defined results: a null field is `-`; an empty text is `0:`. Rows with a null doc_id come first in
their source; rows that share a doc_id are ordered by leaf, equal rows anyhow (their results are
equal as a bag). A null source is a tree of its own, the first. An empty table has no rows and no
root. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import ascii_lower, small, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(col: Column) -> Column:
    """A value with its UTF-8 byte count, so that no two rows write the same bytes."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, _tree, leaf, and `other`: the leaf of the row with its text in lower case where `tampered` holds, else null."""
    own = {c: docs[c] for c in FIELDS}
    columns = [own["doc_id"].alias("doc_id"), F.coalesce(F.concat(F.lit("s"), own["source"]), F.lit("n")).alias("_tree"), digest(*map(field, own.values())).alias("leaf")]
    changed = digest(*map(field, (own | {"text": ascii_lower(own["text"])}).values()))
    return docs.select(*columns, (F.when(tampered, changed) if tampered is not None else F.lit(None).cast("string")).alias("other"))


def placed(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """nodes (written) with _place, the row's place in its _tree by `order`, and _n, the tree's rows; and the largest _n."""
    ranged = written(nodes.withColumn("_r", F.rand(13)).repartitionByRange(*map(F.col, ["_tree", *order]), F.col("_r")).drop("_r").withColumn("_part", F.spark_partition_id()))
    tree = Window.partitionBy("_tree")
    counts = ranged.groupBy("_tree", "_part").agg(F.count("*").alias("_c"))
    starts = written(counts.select("_tree", "_part", F.coalesce(F.sum("_c").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_start"), F.sum("_c").over(tree).alias("_n")))
    inside = Window.partitionBy("_tree", "_part").orderBy(*order)
    out = ranged.withColumn("_in", F.row_number().over(inside) - 1).join(small(starts, 200_000), ["_tree", "_part"])
    return out.withColumn("_place", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start"), starts.agg(F.max("_n")).first()[0] or 0


def _alive(level: int) -> Column:
    """Whether the tree has more than one node at this level."""
    return F.col("_n") > FAN**level


@dataclass
class Trees:
    """levels[k]: _tree, _n, _run, digests of the nodes in the run (level 0 also rows: the leaves' own columns); tops: _tree, top."""

    levels: list[DataFrame]
    tops: DataFrame


def store(nodes: DataFrame, most: int) -> Trees:
    """All levels over placed nodes with a column leaf, each written from the one before."""
    own = [c for c in nodes.columns if c not in ("_tree", "_n", "_place", "leaf")]
    members = F.sort_array(F.collect_list(F.struct("_place", "leaf", *own)))
    first = nodes.groupBy("_tree", "_n", F.floor(F.col("_place") / FAN).alias("_run")).agg(members.alias("_m"))
    first = first.select("_tree", "_n", "_run", F.col("_m.leaf").alias("digests"), F.transform("_m", lambda m: F.struct(*[m[c].alias(c) for c in own])).alias("rows"))
    levels, tops = [written(first.sortWithinPartitions("_tree", "_run"))], []
    while True:
        k = len(levels)
        up = levels[-1].select("_tree", "_n", F.col("_run").alias("_place"), F.when(_alive(k - 1), F.sha2(F.concat_ws("", "digests"), 256)).otherwise(F.col("digests")[0]).alias("leaf"))
        tops.append(up.where(~_alive(k)).select("_tree", F.col("leaf").alias("top")))
        if most <= FAN**k:
            break
        runs = up.where(_alive(k)).groupBy("_tree", "_n", F.floor(F.col("_place") / FAN).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("_place", "leaf"))).alias("_m"))
        levels.append(written(runs.select("_tree", "_n", "_run", F.col("_m.leaf").alias("digests")).sortWithinPartitions("_tree", "_run")))
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return Trees(levels, out)


def paths(trees: Trees) -> DataFrame:
    """Level 0 with `up`: for each level above, from below, the run's place in its parent run and that run's digests."""
    above: DataFrame | None = None
    for runs in reversed(trees.levels):
        if above is None:
            runs = runs.withColumn("up", F.array().cast("array<struct<at:int,digests:array<string>>>"))
        else:
            joined = runs.withColumn("_up", F.floor(F.col("_run") / FAN)).join(above, ["_tree", "_up"], "left")
            step = F.array(F.struct(F.pmod("_run", F.lit(FAN)).cast("int").alias("at"), F.col("_digests").alias("digests")))
            runs = joined.withColumn("up", F.when(F.col("_digests").isNull(), F.array().cast("array<struct<at:int,digests:array<string>>>")).otherwise(F.concat(step, "_more"))).drop("_up", "_digests", "_more")
        above = runs.select("_tree", F.col("_run").alias("_up"), F.col("digests").alias("_digests"), F.col("up").alias("_more"))
    return runs


def _chain(at: Column, digests: Column, n: Column, up: Column) -> Column:
    return F.when(n > 1, F.concat(F.array(F.struct(at.cast("int").alias("at"), digests.alias("digests"))), up)).otherwise(up)


def siblings(chain: Column) -> Column:
    """The digests beside a node, from leaf to root, left to right."""
    return F.flatten(F.transform(chain, lambda s: F.filter(s["digests"], lambda _, i: i != s["at"])))


def folded(leaf: Column, chain: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(chain, leaf, lambda now, s: F.sha2(F.concat_ws("", F.transform(s["digests"], lambda d, i: F.when(i == s["at"], now).otherwise(d))), 256))


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, other, subroot, root, and chain, its runs up to the root as (at, digests)."""
    below = store(*placed(written(leaves(docs, tampered)), ["doc_id", "leaf"]))
    subroots = written(below.tops)
    top = store(*placed(subroots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_source"), F.col("top").alias("leaf")), ["_source"]))
    root = top.tops.select("top").first()
    sources = paths(top).select("*", F.posexplode("rows").alias("_at", "_row"))
    sources = written(sources.select(F.col("_row._source").alias("_tree"), F.col("digests")[F.col("_at")].alias("subroot"), _chain(F.col("_at"), F.col("digests"), F.col("_n"), F.col("up")).alias("_top")))
    runs = paths(below).join(small(sources, 200_000), "_tree")
    opened = runs.select("*", F.posexplode("rows").alias("_at", "_row"))
    chain = F.concat(_chain(F.col("_at"), F.col("digests"), F.col("_n"), F.col("up")), F.col("_top"))
    return opened.select(F.col("_row.doc_id").alias("doc_id"), F.col("digests")[F.col("_at")].alias("leaf"), F.col("_row.other").alias("other"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), chain.alias("chain"))


def report(docs: DataFrame, every: int = 5) -> DataFrame:
    """Every row's proof, checked on a copy in which the texts of one in `every` rows (crc32 of doc_id) are in lower case."""
    tampered = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(every)) == 0
    got = proofs(docs, tampered)
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings(F.col("chain"))), 256).alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("chain")).alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` that a proof from `old`'s manifest doesn't verify: doc_id, leaf, verified. Rows of either alone count as not verified.

    doc_id must be unique and not null in both.
    """
    known = proofs(old).select("doc_id", "chain", "root")
    now = leaves(new).select("doc_id", "leaf")
    return now.join(known, "doc_id", "full").select("doc_id", "leaf", F.coalesce(folded(F.col("leaf"), F.col("chain")) == F.col("root"), F.lit(False)).alias("verified"))
