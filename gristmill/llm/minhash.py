"""Near duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so
that PERMUTATIONS hash passes make twice as many values; bands of ROWS values find candidates. At
similarity 0.75 a pair shares none of the bands with probability (1 - 0.75 ** 3) ** 24 = 2e-6.

Texts with equal shingle sets form a class; only its smallest doc_id, the representative, goes on.
In a band's bucket every representative is first compared with the smallest one: a star, not all
pairs. Components of the confirmed links are found; then only pairs of a bucket whose components
differ are left to compare: for STARS rounds against one member of the bucket's largest component,
then what remains in full, so that no candidate stays unseen. Pairs of small buckets are rows; a large
bucket is cut into blocks, and a task compares two blocks by a product of shingle matrices and
returns links only. All comparisons use the full
shingle sets of the texts.

Scale: one scan makes the signatures, which are written. Shuffles carry band hashes and ids; texts
travel only for documents in some pair. Components come from alternating large-star and small-star
steps over tables in the shared folder; nothing that grows with the data reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import blocks
from gristmill.llm.common import packed, small, text_or_empty, written

WIDTH = 5
PERMUTATIONS, ROWS = 36, 3
SIMILARITY = (75, 100)
STARS = 1
#: Buckets above LARGE members are compared in blocks of BLOCK.
LARGE, BLOCK = 16, 512
_SIGNATURE = "_key bigint, n_shingles bigint, fp binary, bands array<bigint>"


def _sketch(permutations: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20240229)
        a = rng.integers(1, 2**64, permutations, dtype=np.uint64) | np.uint64(1)
        b = rng.integers(0, 2**64, permutations, dtype=np.uint64)
        n_bands = 2 * permutations // rows
        for batch in batches:
            for row, data, offsets in blocks.text_blocks(batch.column("text")):
                hashes, first = blocks.shingles(data, offsets, width)
                docs = len(offsets) - 1
                sizes, fps = np.zeros(docs, np.int64), [None] * docs
                for i in np.flatnonzero(np.diff(first)):
                    own = np.sort(hashes[first[i] : first[i + 1]])
                    own = own[np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))]
                    sizes[i], fps[i] = len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                some = np.flatnonzero(sizes)
                sig = np.zeros((2 * permutations, len(some)), np.uint64)
                if len(some):
                    at = first[some]
                    for k in range(permutations):
                        x = hashes * a[k] + b[k]
                        sig[k], sig[permutations + k] = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
                bands = np.zeros((len(some), n_bands), np.uint64)
                for j in range(n_bands):
                    h = np.full(len(some), j + 1, np.uint64)
                    for r in range(rows):
                        h = blocks.mix(h * np.uint64(0x9FB21C651E98DF25) + sig[j * rows + r])
                    bands[:, j] = h
                counts = np.zeros(docs, np.int32)
                counts[some] = n_bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(row, docs), pa.array(sizes), pa.array(fps, pa.binary()), lists], ["_key", "n_shingles", "fp", "bands"])
    return run


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(_key, n_shingles, fp, bands): set size, digest of the set and band hashes of each row's text."""
    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("text")).mapInArrow(_sketch(permutations, rows, width), _SIGNATURE)


def _compare(num: int, den: int, width: int):
    def sets(texts: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in blocks.text_blocks(texts):
            hashes, first = blocks.shingles(data, offsets, width)
            for i in range(len(offsets) - 1):
                yield np.unique(hashes[first[i] : first[i + 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(sets(batch.column("ta")), sets(batch.column("tb")), strict=True):
                common = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(common > 0 and den * common >= num * (len(one) + len(two) - common))
            keep = pa.array(linked, pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)
    return run


def confirm(pairs: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(a, b) of those pairs whose texts' shingle sets reach the similarity; pairs: (a, b), distinct."""
    ids = small(written(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()))
    texts = docs.select(F.col(key).cast("long").alias("_id"), text_or_empty(text).alias("_t")).join(ids, "_id", "left_semi")
    texts = written(texts.groupBy("_id").agg(F.min("_t").alias("_t")))
    both = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_t").alias("ta")), "a").join(texts.select(F.col("_id").alias("b"), F.col("_t").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_compare(*similarity, width), "a bigint, b bigint")


def _product(num: int, den: int, width: int):
    """Links between different components of two blocks: (a, b), at most one for each two components."""
    def run(table: pa.Table) -> pa.Table:
        keys, roots, left, right = (table.column(c).to_numpy() for c in ("_key", "root", "left", "right"))
        kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        if len(np.unique(roots)) < 2:
            return kind.empty_table()
        owner, held, sizes, row = [], [], [], 0
        for chunk in table.column("_t").chunks:
            for _, data, offsets in blocks.text_blocks(chunk):
                hashes, first = blocks.shingles(data, offsets, width)
                for i in range(len(offsets) - 1):
                    own = np.unique(hashes[first[i] : first[i + 1]])
                    owner.append(np.full(len(own), row))
                    held.append(own)
                    sizes.append(len(own))
                    row += 1
        _, column, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        owner, shared = np.concatenate(owner), times[column] > 1  # a shingle of one text is in no intersection
        owner, column = owner[shared], column[shared]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((row, row), np.float32)
        at, n = 0, len(column)
        while at < n:
            stop = int(np.searchsorted(column, column[at] + 4096))
            _, local = np.unique(column[at:stop], return_inverse=True)
            dense = np.zeros((row, int(local.max()) + 1), np.float32)
            dense[owner[at:stop], local] = 1
            common += dense @ dense.T
            at = stop
        size = np.array(sizes)
        linked = (common > 0) & (den * common >= num * (size[:, None] + size[None, :] - common)) & (roots[:, None] < roots[None, :])
        linked &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
        x, y = np.nonzero(linked)
        _, one = np.unique(np.stack((roots[x], roots[y])), axis=1, return_index=True)
        return pa.Table.from_arrays([pa.array(keys[x[one]]), pa.array(keys[y[one]])], schema=kind)
    return run


def _dealt(members: DataFrame) -> DataFrame:
    """(band, _key, root, i, j, left, right): members dealt to the products of blocks that they take part in.

    Only those outside a bucket's largest component are still to be compared: their blocks, the first
    ones, meet all blocks, and a block of the largest component meets these alone.
    """
    n = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    heads = n.groupBy("band").agg(F.max(F.struct("n", F.col("root").alias("r"))).alias("h"), F.sum("n").alias("all"))
    heads = heads.select("band", "h.r", F.ceil((F.col("all") - F.col("h.n")) / BLOCK).cast("int").alias("out"), F.ceil(F.col("h.n") / BLOCK).cast("int").alias("own"))
    inner = F.col("root") == F.col("r")
    at = F.pmod(F.xxhash64("_key", "band"), F.when(inner, F.col("own")).otherwise(F.col("out"))).cast("int")
    dealt = members.join(heads, "band").withColumn("block", F.when(inner, F.col("out")).otherwise(0) + at)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("out") - 1 + F.when(inner, 0).otherwise(F.col("own")))))
    return dealt.select("band", "_key", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right"))


def _confirm_blocks(members: DataFrame, docs: DataFrame, key: str, text: str, similarity: tuple[int, int], width: int) -> DataFrame:
    """(a, b): links between components inside the buckets of members (band, _key, root), block against block."""
    dealt = _dealt(members)
    ids = small(written(members.select(F.col("_key").alias("_id")).distinct()))
    texts = docs.select(F.col(key).cast("long").alias("_id"), text_or_empty(text).alias("_t")).join(ids, "_id", "left_semi").dropDuplicates(["_id"])
    rows = dealt.join(texts, dealt["_key"] == texts["_id"]).select("band", "i", "j", "_key", "root", "left", "right", "_t")
    return rows.groupBy("band", "i", "j").applyInArrow(_product(*similarity, width), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links (a, b): root is the smallest id that can be reached. Large-star, small-star."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        next_edges = star.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(next_edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, permutations: int = PERMUTATIONS, rows: int = ROWS, width: int = WIDTH, stars: int = STARS) -> DataFrame:
    """Per row of docs: key, n_shingles, component_id (smallest key that links reach), kept (key = component_id).

    A null or empty text has no shingles and stands alone. A row with a null key stands alone, with a
    null component_id, and is kept. Rows that share a key are one document. An empty table gives no rows.
    """
    sig = written(signatures(docs, key, text, permutations, rows, width))
    ready = sig.where("n_shingles > 0 and _key is not null")
    classes = ready.groupBy("fp").agg(F.min("_key").alias("rep"))
    classes = written(classes)
    reps = ready.join(classes.select("fp", F.col("rep").alias("_key")), ["fp", "_key"], "left_semi")
    banded = reps.select("_key", "n_shingles", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.min("_key").alias("hub"), F.max("_key").alias("far")).where("hub < far").select("band", "hub")
    members = written(banded.join(crowded, "band"))
    pairs = written(members.where("_key <> hub").select(F.col("_key").alias("a"), F.col("hub").alias("b")).distinct())
    links = written(confirm(pairs, docs, key, text, similarity, width))
    seen, num, den = pairs, *similarity
    roots = written(components(links))
    for step in range(1, stars + 2):
        at = members.join(roots.withColumnRenamed("id", "_key"), "_key", "left").select("band", "_key", "n_shingles", F.coalesce("root", "_key").alias("root"))
        sizes = at.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("size")).where("r0 < r1").select("band", "size")
        open_ = written(at.join(sizes, "band"))
        if step <= stars:
            # Everyone outside a bucket's largest component against one member of it, another one each time.
            parts = open_.groupBy("band", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("_key", F.lit(step)), F.col("_key").alias("b")))["b"].alias("b"))
            heads = parts.groupBy("band").agg(F.max(F.struct("n", F.col("root").alias("r"), "b")).alias("h")).select("band", "h.r", "h.b")
            todo = open_.select("band", "_key", "root").join(heads, "band").where("root <> r").select("_key", "b")
        else:
            # What is left in full: pairs of small buckets, blocks of large ones.
            fits = f"{den} * x.n_shingles >= {num} * y.n_shingles and {den} * y.n_shingles >= {num} * x.n_shingles"
            few = open_.where(F.col("size") <= LARGE)
            todo = few.alias("x").join(few.alias("y"), F.expr(f"x.band = y.band and x.root < y.root and {fits}")).select(F.col("x._key").alias("_key"), F.col("y._key").alias("b"))
            fresh = _confirm_blocks(open_.where(F.col("size") > LARGE), docs, key, text, similarity, width)
            links = links.unionByName(written(fresh.distinct()))
        todo = written(todo.select(F.greatest("_key", "b").alias("a"), F.least("_key", "b").alias("b")).distinct().join(seen, ["a", "b"], "left_anti"))
        links = links.unionByName(written(confirm(todo, docs, key, text, similarity, width)))
        seen = seen.unionByName(todo)
        roots = written(components(links))
    final = classes.join(roots, classes["rep"] == roots["id"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = sig.join(final, "fp", "left")
    component = F.when(F.col("_key").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "_key"))
    return out.select(F.col("_key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without those whose document is not the first of its component."""
    dropped = written(near_duplicates(docs, key, text, **options).where("not kept").select(F.col(key).alias("_gone")).distinct())
    return packed(docs).join(small(dropped), F.col("_row")[key].cast("long") == F.col("_gone"), "left_anti").select("_row.*")
