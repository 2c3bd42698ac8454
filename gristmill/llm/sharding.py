"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries of ranges.

Law: bytes. Equal texts are one unit and stay in one shard; only a unit that alone overfills a shard is
parted. A sample whose chance grows with a record's size gives the splitters of the key (CRC-32 and hash
of the text); each record finds its range by binary search over them; a range whose measured bytes
exceed its share is subdivided by a hash of the text. Exact byte totals of the ranges place every unit
on the global byte line, which is cut into shards. Units that are large for a shard are a bounded
number: they are dealt first, largest to the emptiest shard, and the line of the others is cut so that
it fills the shards up; shards differ by about two small units.

Scale: the sample is bounded (OVERSAMPLE x ranges), so are the large units (2 UNITS), which are
large by bytes or, such as a third of all rows with no text, by rows; ranges are sized for one task, and no window or task holds more than a range or a part of a unit.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import small, text_or_empty, written
from gristmill.llm.ordering import running

SHARDS = 24
RANGE_BYTES = 4 << 20
MAX_RANGES = 65_536
OVERSAMPLE = 4
#: A range is subdivided when it holds more than OVERFULL shares.
OVERFULL = 2
#: Up to so many splitters stand in the plan one by one.
LITERALS = 4_096
#: A unit above 1 / HEAVY of a shard is large, or above 1 / UNITS of all, by bytes; by rows above PART_ROWS or 1 / UNITS of all.
HEAVY, UNITS = 256, 65_536
#: Rows of a part of a large unit; parts of a shard that an overfull unit is cut into.
PART_ROWS, PIECES = 50_000, 4


def splitters(keyed: DataFrame, total: int, ranges: int) -> list[tuple[int, int]]:
    """Quantiles of a size-weighted sample of (_crc, _h), chosen by a hash and so the same in each run."""
    chance = F.col("size") * F.lit(float(ranges * OVERSAMPLE / max(total, 1)))
    drawn = F.pmod(F.xxhash64("_crc", "_h", "_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance
    sample = sorted(map(tuple, keyed.where(drawn).select("_crc", "_h").collect()))
    step = max(1, len(sample) // ranges)
    return sorted(set(sample[step::step]))


def range_number(cuts: list[tuple[int, int]]) -> Column:
    """How many splitters are no greater than (_crc, _h): a binary search."""
    if not cuts:
        return F.lit(0)
    crcs, hashes = (F.array(*[F.lit(c[j]).cast("long") for c in cuts]) if len(cuts) <= LITERALS else F.from_json(F.lit(str([c[j] for c in cuts])), "array<bigint>") for j in (0, 1))
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    at = lambda a, s: a + s - 1
    passed = lambda a, s: F.coalesce((F.get(crcs, at(a, s)) < F.col("_crc")) | ((F.get(crcs, at(a, s)) == F.col("_crc")) & (F.get(hashes, at(a, s)) <= F.col("_h"))), F.lit(False))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda a, s: F.when(passed(a, s), a + s).otherwise(a))


def deal(units: list[tuple[int, int, int, int]], total: int, n_shards: int) -> tuple[list[tuple], list[int], list[int]]:
    """((unit, pieces, piece, shard, first slot) of the large units (crc, h, bytes, rows), bytes and rows of each shard)."""
    pieces = []
    for u, (_, _, size, rows) in enumerate(units):
        n = min(rows, -(-size * PIECES * n_shards // max(1, total))) if size * n_shards > total and rows > 1 else 1
        edges = [-(-k * rows // n) for k in range(n + 1)]
        pieces += [(size // rows * (b - a), u, n, k, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    shards = [(0, s) for s in range(n_shards)]
    load, held, out = [0] * n_shards, [0] * n_shards, []
    for size, u, n, k, rows in sorted(pieces, key=lambda p: (-p[0], p[1], p[3])):
        _, s = heapq.heappop(shards)
        out.append((u, n, k, s, held[s]))
        load[s] += size
        held[s] += rows
        heapq.heappush(shards, (load[s], s))
    return out, load, held


def shard(docs: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, size, text_crc32, law, shard, slot, grown_shard (null: this law is not by key).

    size: UTF-8 bytes of the text plus 8; a null text has none and is the same unit as an empty one.
    Null keys sort first. Rows equal in key and text may take each other's slots. An empty table gives
    no rows; columns other than key and text are not read.
    """
    spark: SparkSession = docs.sparkSession
    body = text_or_empty(text)
    keyed = written(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 62))).alias("_id"), F.crc32(body.cast("binary")).alias("_crc"), F.xxhash64(body).alias("_h"), (F.octet_length(body) + 8).cast("long").alias("size")))
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    limit, most = total // min(UNITS, n_shards * HEAVY), max(PART_ROWS, rows // UNITS)
    large = sorted(map(tuple, keyed.groupBy("_crc", "_h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > limit) | (F.col("n") > most)).collect()))  # fewer than 2 UNITS
    dealt, load, held = deal(large, total, n_shards)
    marks = F.broadcast(spark.createDataFrame([(c, h, u, n) for u, (c, h, _, n) in enumerate(large)], "_crc long, _h long, _unit long, _n long"))
    marked = keyed.join(marks, ["_crc", "_h"], "left")
    one = F.lit(1).cast("long")

    # Large units: a row's place in its unit tells its piece.
    heavy = marked.where("_unit is not null").withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(9)), F.ceil(F.col("_n") / PART_ROWS))).withColumn("_one", one)
    heavy = running(heavy, ["_unit"], ["_part"], [F.col("_id")], {"_rank": "_one"})
    where = F.broadcast(spark.createDataFrame([(u, n, k, s, first) for u, n, k, s, first in dealt], "_unit long, _pieces long, _piece long, shard int, _first long"))
    pieces = F.broadcast(spark.createDataFrame(sorted({(u, n) for u, n, *_ in dealt}), "_unit long, _pieces long"))
    heavy = heavy.join(pieces, "_unit").withColumn("_piece", F.floor(F.col("_rank") * F.col("_pieces") / F.col("_n")))
    heavy = heavy.join(where, ["_unit", "_pieces", "_piece"]).withColumn("slot", F.col("_first") + F.col("_rank") - F.ceil(F.col("_piece") * F.col("_n") / F.col("_pieces")))

    # All others: ranges by sampled splitters, the byte line, and cuts that fill the shards up.
    light = written(marked.where("_unit is null").select("_key", "_id", "_crc", "_h", "size"))
    rest = total - sum(u[2] for u in large)
    ranges = int(min(MAX_RANGES, max(4 * n_shards, total // RANGE_BYTES)))
    ranged = light.withColumn("_range", range_number(splitters(light, rest, ranges)))
    share = max(1, rest // ranges)
    parts = written(ranged.groupBy("_range").agg(F.ceil(F.sum("size") / F.lit(float(OVERFULL * share))).cast("int").alias("_parts")))
    ranged = ranged.join(small(parts, 2 * MAX_RANGES), "_range").withColumn("_part", F.pmod(F.xxhash64("_crc", "_h", F.lit(5)), F.col("_parts")))
    line = running(ranged.withColumn("_one", one).withColumn("_all", F.lit(0)), ["_all"], ["_range", "_part"], [F.col("_crc"), F.col("_h"), F.col("_id")], {"_bytes": "size", "_rank": "_one"})
    unit = Window.partitionBy("_range", "_part", "_crc", "_h")
    line = written(line.withColumn("_middle", F.min("_bytes").over(unit) * 2 + F.sum("size").over(unit)).select("_key", "size", "_crc", "_middle", "_rank"))
    room = [max(0.0, total / n_shards - b) for b in load]
    ends = [2 * rest * sum(room[: s + 1]) / max(1e-9, sum(room)) for s in range(n_shards - 1)]
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("_middle"))) if ends else F.lit(0)
    placed = line.withColumn("shard", at.cast("int"))
    heads = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row for each shard, as below
    taken = spark.createDataFrame(list(enumerate(held)), "shard int, _held long")
    placed = placed.join(F.broadcast(heads), "shard").join(F.broadcast(taken), "shard").withColumn("slot", F.col("_rank") - F.col("_first") + F.col("_held"))

    columns = ["_key", "size", "_crc", "shard", "slot"]
    out = heavy.select(columns).unionByName(placed.select(columns))
    return out.select(F.col("_key").alias(key), "size", F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
