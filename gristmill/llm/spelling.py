"""Spelling variants: all pairs of vocabulary words at edit distance one, by a self-join of a partitioned trie with active-node sets.

The trie is partitioned by prefixes, the words forwards and backwards. Of two near words of lengths L
and L or L + 1, let their first difference be at place p. If p >= L // 2 they share their first L // 2
letters; if not, they share their last L - L // 2. So a word goes to a partition of each kind for
each L that it can be in, and each near pair meets in just one (the other drops it by its p). A
partition holds words that agree outside of a window [a, b) of places; one of more than GROUP words
or LETTERS letters is halved, again by p, down to windows of one place, where only the alphabet is left. No partition
therefore grows with the corpus, whatever prefix a third of the words may share.

Within a partition a trie is built of the windows and walked from its root. Each node has the set of
its active nodes, those whose path is at distance one from its own; a child's set comes from its
parent's: their children by the same letter, the parent, the siblings and its own children. A
terminal node's active terminals are its near words. Counts and the most frequent near word are
reduced in the partition, so that no pair is ever shuffled.

Defined results: a null text has no words; a null doc_id is written as an empty text before the
colon. Repeated rows count again. Runs of any length are whole words. Ties of the most frequent near
word go to the first in code-point order. An empty table gives no words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ascii_lower, found, written

#: Shortest word, fewest occurrences, and how many times as frequent a form must be.
MIN_LETTERS, MIN_COUNT, RATIO = 7, 2, 10
#: One run in MISTYPED loses a letter.
MISTYPED = 31
#: Words, and letters of their windows, up to which a partition is one trie.
GROUP, LETTERS = 4096, 1 << 17
RUN = r"[A-Za-zÀ-ÿ]"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts after the typing errors, of MIN_LETTERS letters and MIN_COUNT occurrences at least."""
    runs = docs.select(docs["doc_id"].cast("string").alias("_id"), F.explode(F.regexp_extract_all(docs["text"], F.lit(RUN + f"{{{MIN_LETTERS},}}"), F.lit(0))).alias("_run"))
    runs = runs.select(ascii_lower(F.col("_run")).alias("_run"), "_id")
    h = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "_run").cast("binary"))
    typed = runs.select("_run", h.alias("_h")).select("_run", "_h", F.pmod("_h", F.length("_run")).cast("int").alias("_at"))
    word = F.when(F.pmod("_h", F.lit(MISTYPED)) == 0, F.concat(F.expr("substring(_run, 1, _at)"), F.expr("substring(_run, _at + 2)"))).otherwise(F.col("_run"))
    return typed.select(word.alias("word")).where(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _keyed(members: DataFrame) -> DataFrame:
    """members (word, n, _l, _a, _b) with the hash of what the words of a partition share."""
    return members.withColumn("_g", F.xxhash64("_l", "_a", "_b", F.expr("substring(word, 1, _a)"), F.expr("substring(word, length(word) - (_l - _b) + 1)")))


def _window(l: Column, a: Column, b: Column) -> Column:
    return F.struct(l.cast("int").alias("_l"), a.cast("int").alias("_a"), b.cast("int").alias("_b"))


def partitions(words: DataFrame) -> list[DataFrame]:
    """Every word in each of its partitions; one over GROUP or LETTERS has windows of a single place."""
    size = F.length("word")
    halves = [w for l in (size, size - 1) for w in (_window(l, F.floor(l / 2), l), _window(l, F.lit(0), F.floor(l / 2)))]
    at = F.explode(F.when(size > MIN_LETTERS, F.array(*halves)).otherwise(F.array(*halves[:2]))).alias("_w")
    members, out = _keyed(words.select("word", "n", at).select("word", "n", "_w.*")), []
    while True:
        large = written(members.groupBy("_g").agg(F.count("*").alias("_c"), F.max(F.col("_b") - F.col("_a")).alias("_wide"), F.sum(F.col("_b") - F.col("_a") + 1).alias("_letters")).where(((F.col("_c") > GROUP) | (F.col("_letters") > LETTERS)) & (F.col("_wide") > 1)).select("_g", F.lit(True).alias("_large")))
        if large.isEmpty():
            return [*out, members]
        marked = found(members, large, ["_g"])
        out.append(marked.where(F.col("_large").isNull()).drop("_large"))
        middle = F.floor((F.col("_a") + F.col("_b")) / 2)
        both = F.explode(F.array(_window(F.col("_l"), middle, F.col("_b")), _window(F.col("_l"), F.col("_a"), middle))).alias("_w")
        members = _keyed(written(marked.where("_large").select("word", "n", both).select("word", "n", "_w.*")))


def near(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """Of distinct words, the places of each with the places of those at distance one; one trie, walked from its root."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        node = 0
        for letter in word:
            below = children[node]
            if letter not in below:
                below[letter] = len(children)
                children.append({})
                ends.append(-1)
            node = below[letter]
        ends[node] = i
    stack: list[tuple[int, set[int]]] = [(0, set(children[0].values()))]
    while stack:
        node, active = stack.pop()
        if ends[node] >= 0:
            hits = [ends[v] for v in active if ends[v] >= 0]
            if hits:
                yield ends[node], hits
        kin = children[node]
        for letter, child in kin.items():
            mine = {below[letter] for v in active if letter in (below := children[v])}
            mine.update(kin.values(), children[child].values())
            mine.discard(child)
            mine.add(node)
            stack.append((child, mine))


def _partials(rows: list[tuple[str, int, int, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, the most frequent one's n, it) within one hash; what the words share is compared here."""
    exact: dict[tuple, list[tuple[str, int]]] = {}
    for word, n, l, a, b in rows:
        exact.setdefault((l, a, b, word[:a], word[len(word) - (l - b) :]), []).append((word, n))
    for (l, a, b, _, _), members in exact.items():
        if len(members) < 2:
            continue
        windows = [word[a : len(word) - (l - b)] for word, _ in members]
        for i, hits in near(windows):
            own, size = windows[i], len(members[i][0])
            best, count = None, 0
            for j in hits:
                other, n = members[j]
                if size > l and len(other) > l:
                    continue  # both are the longer: they meet where l is their length
                if b < l and size != len(other) and (own.startswith(windows[j]) or windows[j].startswith(own)):
                    continue  # they first differ behind the window
                count += 1
                if best is None or (-n, other) < best:
                    best = (-n, other)
            if best:
                yield members[i][0], count, -best[0], best[1]


_OUT = "word string, n_near long, best_n long, best string"


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions come sorted by their hash; one may go on in the next batch."""
    held: list[tuple] = []
    last = None

    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        g = batch.column("_g").to_numpy()
        if not len(g):
            continue
        cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        out: list[tuple] = []
        columns = [batch.column(c) for c in ("word", "n", "_l", "_a", "_b")]
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if g[start] != last:
                if len(held) > 1:
                    out += _partials(held)
                held, last = [], g[start]
            elif not held:
                raise RuntimeError("a partition's rows are not together")
            if end - start > 1 or held or end == len(g):
                held += zip(*[c.slice(start, end - start).to_pylist() for c in columns], strict=True)
            else:
                held = [()]  # alone
        yield made(out)
    if len(held) > 1:
        yield made(list(_partials(held)))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n, n_near, form and form_n of every word of a written vocabulary."""
    parts = partitions(words)
    members = parts[0]
    for more in parts[1:]:
        members = members.unionByName(more)
    some = members.repartition("_g").sortWithinPartitions("_g").mapInArrow(_walk, _OUT)
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    every = own.unionByName(some.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))).alias("_best")
    got = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    better = -F.col("_best.m") >= RATIO * F.col("n")
    return got.select("word", "n", "n_near", F.when(better, F.col("_best.w")).alias("form"), F.when(better, -F.col("_best.m")).alias("form_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """forms (written) with root: where following forms ends. Each round doubles the steps taken; n grows tenfold a step, so rounds are few."""
    root = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(root.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        root = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    return forms.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary."""
    return rooted(written(neighbours(written(vocabulary(docs))))).select("word", "form", "root", "n", "n_near", "form_n")


def respelled(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, word, root, n: how often a document writes a word that has another root, for its repair. groups: of variants()."""
    runs = docs.select(docs["doc_id"].alias("doc_id"), F.explode(F.regexp_extract_all(docs["text"], F.lit(RUN + "+"), F.lit(0))).alias("word"))
    used = runs.select("doc_id", ascii_lower(F.col("word")).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return used.join(groups.where("root <> word").select("word", "root"), "word").select("doc_id", "word", "root", "n")
