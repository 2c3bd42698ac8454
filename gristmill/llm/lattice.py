"""Language-model scores: the marginal probability of a text over all its subword segmentations.

The pieces and their scores come from an existing vocabulary file. Scores there fall with the rank,
so a piece's prior weight is 1 / (rank + OFFSET). The training documents adapt the weights once:
expected piece counts over all segmentations (forward-backward on the training words) are added to
PRIOR times the prior. Segmentations never cross words, so a text's log probability is the sum over
its words of the forward recursion's result, plus its end. The recursion runs in log space, for all
different words of a block at once; lengths that few words have are walked edge by edge, so that a
word of megabytes costs in proportion to its length. Every byte is a piece, so that every text has a
probability.

Beside it stands the base score, a word unigram with add-one smoothing.

Scale: word counts are combined per block before the shuffle. Up to FREQUENT of the commonest words,
found by a histogram of the counts, go to the workers as a table of counts; all other words of a document are joined with the
whole count table by shuffling. The count table and the scored rows are written, so that no scan
is made twice for one purpose.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import blocks
from gristmill.llm.common import written

VOCABULARY = "piece_bpe_32k.model"
#: At most so many of the commonest words are known to every worker.
FREQUENT = 131_072
#: Up to so many words of one length are walked edge by edge.
FEW = 4
OFFSET, PRIOR = 10.0, 10_000.0
FOLDS, HELD_OUT = 7, 2
BLOCK = 2 << 20
#: Cells of words times places that a worker looks at together.
CELLS = 1 << 18


class Pieces:
    """Pieces as byte strings with log weights, found by hash. A word's leading space is the pieces' word mark."""

    def __init__(self, texts: list[bytes], weights: np.ndarray):
        self.weights = weights.astype(float)
        self.longest = max(map(len, texts))
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        hashes = blocks.span_hash(blocks.prefix_hash(data), ends - sizes, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.bits = np.zeros(1 << 20, bool)
        self.bits[hashes >> np.uint64(44)] = True
        self.lengths = sorted(set(sizes.tolist()))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        out = np.full(hashes.shape, -1, np.int32)
        maybe = self.bits[hashes >> np.uint64(44)]
        some = hashes[maybe]
        at = np.minimum(np.searchsorted(self.hashes, some), len(self.hashes) - 1)
        out[maybe] = np.where(self.hashes[at] == some, self.ids[at], -1)
        return out


def read_pieces(path: str | None = None, offset: float = OFFSET) -> tuple[list[bytes], np.ndarray]:
    """Byte strings and prior weights (they sum to 1) of a vocabulary file, read by the driver; its control pieces are left out."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or str(public_tokenizers.path(VOCABULARY)))
    best: dict[bytes, float] = {bytes([b]): float(model.get_piece_size()) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            best[piece] = min(best.get(piece, np.inf), -model.get_score(i))
    weights = np.array([1.0 / (rank + offset) for rank in best.values()])
    return list(best), weights / weights.sum()


def _lattices(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]]:
    """Words of equal length together: (which words, piece of each (length, start), forward log sums)."""
    log = np.concatenate((np.log(np.maximum(pieces.weights, 1e-300)), [-np.inf]))  # the last stands for "no piece"
    sizes = ends - starts
    for size in np.unique(sizes):
        every = np.flatnonzero(sizes == size)
        step = max(1, CELLS // (int(size) + 1))
        for low in range(0, len(every), step):
            some = every[low : low + step]
            width = int(size) + 1
            grid = np.full((len(some), width), 32, np.uint8)
            grid[:, 1:] = data[starts[some][:, None] + np.arange(int(size))]
            prefix = blocks.prefix_hash(grid.reshape(-1))
            first = np.arange(len(some))[:, None] * width
            found = {}
            for n in pieces.lengths:
                if n <= width:
                    at = first + np.arange(width - n + 1)
                    found[n] = pieces.find(blocks.span_hash(prefix, at, at + n))
            if len(some) <= FEW:
                alpha = np.array([_walk({n: piece[i] for n, piece in found.items()}, log, width) for i in range(len(some))])
            else:
                alpha = np.full((len(some), width + 1), -np.inf)
                alpha[:, 0] = 0
                for j in range(1, width + 1):
                    own = [n for n in found if n <= j]
                    alpha[:, j] = _log_sum([alpha[:, j - n] + log[found[n][:, j - n]] for n in own])
            yield some, found, alpha


def _walk(found: dict[int, np.ndarray], log: np.ndarray, width: int, back: bool = False) -> list[float]:
    """Forward (or backward) log sums of one word over the pieces that are in it: a long word costs in proportion to its length."""
    starts = [np.flatnonzero(piece >= 0) for piece in found.values()]
    ends = np.concatenate([at + n for n, at in zip(found, starts, strict=True)])
    value = np.concatenate([log[piece[at]] for piece, at in zip(found.values(), starts, strict=True)])
    source, target = (width - ends, width - np.concatenate(starts)) if back else (np.concatenate(starts), ends)
    order = np.argsort(target, kind="stable")
    bounds = np.searchsorted(target[order], np.arange(width + 2)).tolist()
    source, value = source[order].tolist(), value[order].tolist()
    out = [0.0] * (width + 1)
    for j in range(1, width + 1):
        terms = [out[source[i]] + value[i] for i in range(bounds[j], bounds[j + 1])]
        top = max(terms)
        out[j] = top if len(terms) == 1 else top + math.log(sum([math.exp(t - top) for t in terms]))
    return out[::-1] if back else out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    stack = np.stack(terms)
    top = stack.max(0)
    return top + np.log(np.exp(stack - top).sum(0))


def word_log10(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 of each word's marginal probability."""
    out = np.zeros(len(starts))
    for some, _, alpha in _lattices(pieces, data, starts, ends):
        out[some] = alpha[:, -1] / np.log(10)
    return out


def expected_pieces(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of the words, each `counts` times there."""
    log = np.concatenate((np.log(np.maximum(pieces.weights, 1e-300)), [-np.inf]))
    out = np.zeros(len(pieces.weights))
    for some, found, alpha in _lattices(pieces, data, starts, ends):
        width = alpha.shape[1] - 1
        if len(some) <= FEW:
            beta = np.array([_walk({n: piece[i] for n, piece in found.items()}, log, width, True) for i in range(len(some))])
        else:
            beta = np.full(alpha.shape, -np.inf)
            beta[:, width] = 0
            for j in range(width - 1, -1, -1):
                beta[:, j] = _log_sum([beta[:, j + n] + log[found[n][:, j]] for n in found if j + n <= width])
        for n, piece in found.items():
            row, at = np.nonzero(piece >= 0)
            ids = piece[row, at]
            use = np.exp(alpha[row, at] + log[ids] + beta[row, at + n] - alpha[row, width]) * counts[some[row]]
            out += np.bincount(ids, use, len(out))
    return out


def _different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first, number of each, group of every one) of equal hashes."""
    _, first, group, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    return first, n, group


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])] if len(sizes) else data[:0]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat)))


def _hashed(data: np.ndarray, offsets: np.ndarray):
    data = blocks.lower(data)
    starts, ends, first = blocks.plain_words(data, offsets)
    return data, starts, ends, first, blocks.span_hash(blocks.prefix_hash(data), starts, ends)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in blocks.text_blocks(batch.column("text"), BLOCK):
            data, starts, ends, _, hashes = _hashed(data, offsets)
            first, n, _ = _different(hashes)
            yield pa.RecordBatch.from_arrays([_strings(data, starts[first], ends[first]), pa.array(n.astype(np.int64))], ["word", "n"])


def held_out(key: str, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, fold: int = HELD_OUT) -> DataFrame:
    """(word, n) over the training documents."""
    train = docs.where(~held_out(key, folds, fold)).select(F.col(text).cast("string").alias("text"))
    return train.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def adapt(counts: DataFrame, n_docs: int, texts: list[bytes], prior: np.ndarray, strength: float = PRIOR) -> tuple[np.ndarray, float]:
    """(weights, weight of the end): the prior plus the expected counts over the training words, normalised."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, total = Pieces(texts, prior), np.zeros(len(prior))
        for batch in batches:
            n = batch.column("n").to_numpy()
            for row, data, offsets in blocks.text_blocks(batch.column("word"), 1 << 19):
                total += expected_pieces(pieces, data, offsets[:-1], offsets[1:], n[row : row + len(offsets) - 1])
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["piece", "n"])

    expected = np.zeros(len(prior))
    for piece, n in counts.mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n")).collect():  # no more rows than pieces
        expected[piece] = n
    whole = expected.sum() + n_docs + strength + 1
    return (expected + strength * prior) / whole, (n_docs + 1) / whole


_SCORED = "_key bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, rare array<string>, rare_n array<int>"


def _score(texts: list[bytes], weights: np.ndarray, end: float, hashes: np.ndarray, base: np.ndarray, end_base: float, end_known: int):
    """hashes, base: sorted hashes of the frequent words and their base log10."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(texts, weights)
        common = np.full(len(hashes), np.nan)  # log10 by lattice of the frequent words, filled as they occur
        for batch in batches:
            for row, data, offsets in blocks.text_blocks(batch.column("text"), BLOCK):
                data, starts, ends, first, own = _hashed(data, offsets)
                docs = len(offsets) - 1
                at, n, group = _different(own)
                word = own[at]
                place = np.minimum(np.searchsorted(hashes, word), max(len(hashes) - 1, 0)) if len(hashes) else np.zeros(len(word), np.int64)
                often = (hashes[place] == word) if len(hashes) else np.zeros(len(word), bool)
                value = np.where(often, common[place], np.nan) if len(hashes) else np.full(len(word), np.nan)
                need = np.flatnonzero(np.isnan(value))
                value[need] = word_log10(pieces, data, starts[at[need]], ends[at[need]])
                if len(hashes):
                    common[place[often]] = value[often]
                doc = np.repeat(np.arange(docs), np.diff(first))
                total = np.bincount(doc, value[group], docs) + np.log10(end)
                plain = np.where(often, base[place], 0.0) if len(hashes) else np.zeros(len(word))
                part = np.bincount(doc, plain[group], docs) + end_base
                known = np.bincount(doc, often[group], docs).astype(np.int64) + end_known
                scarce = np.flatnonzero(~often[group])
                pair, copies = np.unique(doc[scarce] * len(at) + group[scarce], return_counts=True)
                which = at[pair % max(len(at), 1)]
                bounds = pa.array(np.searchsorted(pair // max(len(at), 1), np.arange(docs + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").slice(row, docs), batch.column("held_out").slice(row, docs), pa.array(np.diff(first) + 1), pa.array(known), pa.array(part), pa.array(total),
                     pa.ListArray.from_arrays(bounds, _strings(data, starts[which], ends[which])), pa.ListArray.from_arrays(bounds, pa.array(copies.astype(np.int32)))],
                    ["_key", "held_out", "n_tokens", "known", "base", "score", "rare", "rare_n"])
    return run


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[list[str], np.ndarray]:
    """(words, counts) of the commonest words: as many whole classes of like counts as hold no more than `most` words."""
    scale = F.floor(F.log2(F.col("n")) * 16).cast("int")
    classes = sorted(map(tuple, counts.groupBy(scale.alias("c")).count().collect()), reverse=True)  # about a thousand at most
    held, least = 0, None
    for c, words in classes:
        held += words
        if held > most:
            break
        least = c
    rows = counts.where(scale >= least).collect() if least is not None else []
    return [r["word"] for r in rows], np.array([r["n"] for r in rows], np.float64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, frequent: int = FREQUENT, folds: int = FOLDS, fold: int = HELD_OUT) -> DataFrame:
    """Per row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null text is empty: its end is its only token. A null key counts as the empty string in the
    choice of the fold. Repeated rows are scored and learned from each time. No training documents:
    no known tokens, scores from the vocabulary's own weights. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    counts = written(word_counts(docs, key, text, folds, fold))
    n_docs = docs.where(~held_out(key, folds, fold)).count()
    words, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, kinds = (words or 0) + n_docs, kinds + (n_docs > 0)
    log = lambda c: np.log10((c + 1) / (tokens + kinds + 1))
    texts, prior = read_pieces(vocabulary)
    weights, end = adapt(counts, n_docs, texts, prior)
    common, often = frequent_words(counts, frequent)
    sizes = np.array([len(w.encode()) for w in common], np.int64)
    ends = np.cumsum(sizes)
    buffer = np.frombuffer("".join(common).encode(), np.uint8)
    hashes = blocks.span_hash(blocks.prefix_hash(buffer), ends - sizes, ends) if len(sizes) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    base = log(often[order]) if len(sizes) else np.zeros(0)
    rows = docs.select(F.col(key).cast("long").alias("_key"), held_out(key, folds, fold).alias("held_out"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(_score(texts, weights, end, hashes[order], base, float(log(n_docs)), int(n_docs > 0)), _SCORED)
    scored = written(scored.withColumn("_id", F.monotonically_increasing_id()))
    rare = scored.select("_id", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select("_id", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k"))
    joined = rare.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    more = joined.groupBy("_id").agg(F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10((F.col("n") + 1) / F.lit(float(tokens + kinds + 1)))).alias("more_base"))
    out = scored.drop("rare", "rare_n").join(more, "_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("_key").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")
