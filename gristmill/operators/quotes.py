"""Where quoted texts stand: one scan of the texts for many quotes, without meeting every text with every quote.

A quote with words in its inside is looked up by the rarest of them: a word between two separators of
the quote is a whole word of any text that holds the quote. Quotes without one (a word or two) are
found by automatons of bounded size, which read each text once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.graph import stored

#: ASCII that parts words; letters of the quotes in one automaton.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = 2_000_000


def _inner(text: Column) -> Column:
    """The words of a quote without the first and the last, which may go on outside."""
    parts = F.split(text, GAP)
    return F.array_distinct(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != ""))


def _by_word(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    words = stored(texts.where("text is not null").select("id", F.explode(F.array_distinct(F.split("text", GAP))).alias("word")).join(quotes.select(F.explode("_inner").alias("word")).distinct(), "word", "left_semi"))
    n = words.groupBy("word").agg(F.count("*").alias("n"))
    rarest = quotes.select("quote_id", F.explode("_inner").alias("word")).join(n, "word").groupBy("quote_id").agg(F.min(F.struct("n", "word"))["word"].alias("word"))
    met = stored(words.join(rarest, "word").select("id", "quote_id").join(quotes.select("quote_id", "quote"), "quote_id"))
    return texts.join(met, "id").where(F.col("text").contains(F.col("quote"))).select("quote_id", "id")


def _by_automaton(texts: DataFrame, quotes: DataFrame) -> DataFrame | None:
    """Quotes are read part by part, LETTERS of them at most, and each part goes over the texts once."""
    total = quotes.agg(F.coalesce(F.sum(F.length("quote") + 1), F.lit(0))).first()[0]
    parts, out = -(-total // LETTERS), None
    kind = texts.schema["id"].dataType.simpleString()
    for part in range(parts):
        held = texts.sparkSession.sparkContext.broadcast([r.quote for r in quotes.where(F.pmod(F.xxhash64("quote"), F.lit(parts)) == part).select("quote").distinct().collect()])

        def scan(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for q in held.value:
                machine.add_word(q, q)
            machine.make_automaton()
            for batch in batches:
                ids, found = [], []
                for at, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    hits = {q for _, q in machine.iter(text)}
                    ids += [at] * len(hits)
                    found += sorted(hits)
                yield pa.record_batch([pa.array([i.as_py() for i in ids], batch.column(0).type), pa.array(found, pa.string())], names=["id", "quote"])

        some = texts.where("text is not null").select("id", "text").mapInArrow(scan, f"id {kind}, quote string").join(quotes.select("quote", "quote_id"), "quote").select("quote_id", "id")
        out = some if out is None else out.unionByName(some)
    return out


def located(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, id) of every text that holds a quote; texts: id, text, ids unique; quotes: quote_id, quote.

    Null and empty quotes are nowhere.
    """
    asked = stored(quotes.where("quote is not null").select("quote_id", "quote", _inner(F.col("quote")).alias("_inner")))
    long = asked.where(F.size("_inner") > 0)
    out = _by_word(texts, long)
    short = _by_automaton(texts, asked.where((F.size("_inner") == 0) & (F.col("quote") != "")))
    return out if short is None else out.unionByName(short)
