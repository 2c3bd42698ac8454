"""Stateful operators: a batch form over a table, and a Structured Streaming form with the same results.

Event time may be late by WATERMARK; the state of a key is small and fixed in size or bounded by the limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.sources.files import shared_folder

WATERMARK = "1 hour"


def ticks(parts: Sequence[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has put out after all parts have arrived in its folder, one after the other.

    The stream is started anew after each part and works off what is new, with the state and the
    position that its checkpoint has kept, as a job does that runs by the clock.
    """
    spark = parts[0].sparkSession
    folder = shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        out = transform(spark.readStream.schema(part.schema).parquet(f"{folder}/in"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def admit(times: list[float], held: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which calls are admitted: fewer than `most` admitted ones in the trailing window; rejected calls are not recorded."""
    out = []
    for t in times:
        held = [h for h in held if h > t - seconds]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, held


def limiter(df: DataFrame, key: str, ts: str, order: str, most: int, seconds: int) -> DataFrame:
    """df with `allowed`. Each decision depends on earlier ones of the window, so that a run of calls without a gap of `seconds` is one sequential pass.

    After such a gap nothing is held any more: a key's runs are groups of their own, and in one of up to
    `most` calls all are admitted.
    """
    schema = df.withColumn("allowed", F.lit(True)).schema
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w) >= seconds * 1_000_000, F.lit(False))
    runs = df.withColumn("_gap", gap).withColumn("_run", F.sum(F.col("_gap").cast("int")).over(w)).drop("_gap")
    runs = runs.withColumn("_calls", F.count("*").over(Window.partitionBy(key, "_run")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([ts, order], kind="stable")
        return rows.assign(allowed=admit([t.timestamp() for t in rows[ts]], [], most, seconds)[0])[[f.name for f in schema]]

    few = runs.where(F.col("_calls") <= most).withColumn("allowed", F.lit(True)).select([f.name for f in schema])
    return few.unionByName(runs.where(F.col("_calls") > most).groupBy(key, "_run").applyInPandas(run, schema))


def stream_limiter(stream: DataFrame, key: str, ts: str, order: str, most: int, seconds: int) -> DataFrame:
    """The limiter on a stream; a key's state is its admitted times in the window, at most `most`."""
    schema = stream.withColumn("allowed", F.lit(True)).schema

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values([ts, order], kind="stable")
        allowed, held = admit([t.timestamp() for t in rows[ts]], held, most, seconds)
        state.update((held,))
        yield rows.assign(allowed=allowed)[[f.name for f in schema]]

    return stream.groupBy(key).applyInPandasWithState(run, schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def miss_stream(stream: DataFrame, keys: list[str], order: str, value: str, review: int = 2) -> DataFrame:
    """(keys, order, miss_rounds, needs_review): the run of zeros so far, per keys; state: one number."""
    schema = stream.select(*keys, order, F.lit(0).cast("bigint").alias("miss_rounds"), F.lit(True).alias("needs_review")).schema

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        counts = []
        for v in rows[value]:
            n = 0 if v > 0 else n + 1
            counts.append(n)
        state.update((n,))
        yield rows.assign(miss_rounds=counts, needs_review=[c >= review for c in counts])[[f.name for f in schema]]

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "n bigint", "append", GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, keys: list[str], ts: str, within: str = WATERMARK) -> DataFrame:
    """The first row of its keys in a stream; keys older than the watermark are forgotten."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str, late: str = WATERMARK) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))


def changes_since(feed: DataFrame, user: str, who: object, seq: str, since: int, types: list[str], kind: str, limit: int) -> DataFrame:
    """A cursor pull: the user's next changes of the wanted types in order, with latest_seq and has_more."""
    wanted = feed.where((F.col(user) == F.lit(who)) & (F.col(seq) > since) & F.col(kind).isin(types))
    top = wanted.orderBy(seq).limit(limit + 1)
    w = Window.partitionBy(F.lit(0))  # limit + 1 rows
    ranked = top.withColumn("_r", F.row_number().over(w.orderBy(seq))).withColumn("has_more", F.count("*").over(w) > limit).where(F.col("_r") <= limit)
    return ranked.withColumn("latest_seq", F.max(seq).over(w)).drop("_r")


def abusive(df: DataFrame, key: str, ts: str, seconds: int, threshold: int, block_hours: int) -> DataFrame:
    """(key, blocked_at, blocked_until) of the first time that the trailing window reaches the threshold."""
    from gristmill.operators.windows import trailing_count

    hit = trailing_count(df, key, ts, seconds).where(F.col("n") >= threshold)
    return hit.groupBy(key).agg(F.min(ts).alias("blocked_at")).withColumn("blocked_until", F.col("blocked_at") + F.expr(f"INTERVAL {int(block_hours)} HOURS"))


def quota(df: DataFrame, bucket: str, order: list[str], guaranteed: int, total: int) -> DataFrame:
    """df with `slot` (guaranteed, overflow or null): each bucket's first rows are guaranteed, the rest fill the total by rank and bucket."""
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    sure = ranked.where(F.col("_r") <= guaranteed).withColumn("slot", F.lit("guaranteed"))
    left = max(0, total - sure.count())
    more = ranked.where(F.col("_r") > guaranteed).orderBy("_r", bucket).limit(left).withColumn("slot", F.lit("overflow"))
    return sure.unionByName(more).drop("_r")


def superseded(df: DataFrame, keys: list[str], start: str, key: str) -> DataFrame:
    """SCD 2: valid_until and superseded_by from the next version of the same keys."""
    w = Window.partitionBy(*keys).orderBy(start, key)
    return df.withColumn("valid_until", F.lead(start).over(w)).withColumn("superseded_by", F.lead(key).over(w))


def latest_state(history: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The last history row of each key: state as a view of an event log."""
    last = history.groupBy(*keys).agg(F.max(F.struct(*order, *keep)).alias("_x"))
    return last.select(*keys, *[F.col("_x")[c].alias(c) for c in keep])


def live_decisions(ledger: DataFrame, key: str, supersedes: str, a: str, b: str, order: str) -> DataFrame:
    """Decisions that no other one supersedes, the latest of each unordered pair."""
    from gristmill.operators.windows import keep_first

    gone = ledger.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key))
    live = ledger.join(gone, key, "left_anti").withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    return keep_first(live, ["_a", "_b"], [F.col(order).desc()]).drop("_a", "_b")


def merged_entities(df: DataFrame, keys: list[str], name: str, source: str, order: str) -> DataFrame:
    """Entities by normalised name: first spelling, number of mentions, distinct sources."""
    key = F.lower(F.trim(F.col(name)))
    return df.groupBy(*keys, key.alias("key")).agg(F.min_by(name, order).alias("name"), F.count("*").alias("mentions"), F.array_sort(F.collect_set(source)).alias("sources"))


def exclusive_support(links: DataFrame, item: str, source: str, gone: object) -> DataFrame:
    """(item, action): delete if the source that goes is its only one, else keep; only items that it supports."""
    n = links.select(item, source).distinct().groupBy(item).agg(F.count("*").alias("n"), F.max((F.col(source) == F.lit(gone)).cast("int")).alias("own"))
    return n.where("own = 1").select(item, F.when(F.col("n") == 1, "delete").otherwise("keep").alias("action"))
