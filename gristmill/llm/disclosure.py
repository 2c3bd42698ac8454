"""Personal data: patterns of fixed kinds, and terms that disclose them by the corpus's own statistics.

Protected entities are the values that the patterns find (an address, a number). A context is a block
of BLOCK words with an entity and the blocks beside it. Over all documents, n(c) hold the entity c,
n(t) the term t, n(c, t) t in a context of c. Then IC(c) = log2(N / n(c)) is what must stay hidden and
PMI(c; t) = log2(N n(c, t) / (n(c) n(t))) is how much of it t gives away. A term discloses c if
PMI(c; t) >= MIN_BITS and IC(c) - PMI(c; t) = log2(n(t) / n(c, t)) <= LEFT_BITS, i.e. if hardly any
doubt about c is left; with SUPPORT independent texts as evidence. Copies and near copies of a text,
which share its least shingle hash, are one piece of evidence. Such a term is a span wherever it
stands, also where no entity does. `sanitised` puts the kind in an entity's place, generalises a
disclosing term to the class of its form and removes one that leaves no more than GONE_BITS.

Scale: one scan finds entities and writes the contexts, at most three times the words of blocks with
an entity. Entities seen in fewer than SUPPORT texts go before pairs are made, so that pairs grow with
the occurrences of the others; pairs are distinct per document and aggregated by (entity, term, text)
before (entity, term). Terms that the contexts alone show to be too common go; one JVM scan counts the
others. The last scan marks spans; terms come
by broadcast if measured to fit, else by a shuffle to the texts that hold them.

Defined results: a null text is empty and has no spans; null and repeated doc_ids are rows like others,
and each row is a document of its own in the counts. An empty table gives no rows. `sanitised` keeps
all columns, whatever their names; `report` reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import blocks
from gristmill.llm.common import alnum_words, ascii_lower, fits, packed, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words of a block, independent texts, bits of a disclosure, bits that may be left, bits up to which a term is removed.
BLOCK, SUPPORT, MIN_BITS, LEFT_BITS, GONE_BITS = 100, 3, 3.0, 1.0, 0.1
#: The patterns of the kinds. Each starts only where a longest match can, so that long runs cost no more than their length.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def entities(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind and start; of each kind leftmost, not overlapping, failing matches dropped."""
    out: list[Span] = [(0, *s) for s in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_only_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _value(text: str, span: Span) -> str:
    """What makes two spans the same entity."""
    kind, start, end = span
    own = text[start:end]
    return f"{KINDS[kind]}:{own.lower() if kind == 0 else '.'.join(p.lstrip('0') or '0' for p in own.split('.')) if kind == 1 else _only_digits(own)}"


def _terms(text: str, spans: list[Span]) -> list[re.Match]:
    """Words outside of the spans, A-Z in lower case."""
    own = text.encode().lower().decode()
    if spans:
        parts, at = [], 0
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            start = max(start, at)
            if end > start:
                parts += [own[at:start], " " * (end - start)]
                at = end
        own = "".join([*parts, own[at:]])
    return list(_WORD.finditer(own))


def contexts(text: str) -> Iterator[tuple[bool, list[str], list[str], list[str]]]:
    """(whether it is the text's first, entities, those not met in an earlier block, terms) of each block of a text with an entity."""
    spans = entities(text)
    if not spans:
        return
    words = _terms(text, spans)
    starts, at, seen = [m.start() for m in words], {}, set()
    for span in spans:
        at.setdefault(bisect_left(starts, span[1]) // BLOCK, set()).add(_value(text, span))
    for block in sorted(at):
        own = at[block]
        yield not seen, sorted(own), sorted(own - seen), sorted({m.group() for m in words[max(0, (block - 1) * BLOCK) : (block + 2) * BLOCK]})
        seen |= own


def _least_shingle(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    hashes, _ = blocks.shingles(data, np.array([0, len(data)]))
    return int(hashes.min().view(np.int64)) if len(hashes) else 0


def _collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 36
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(0).to_pylist():
            number += 1
            found = list(contexts(text)) if text else []
            if found:
                sign = _least_shingle(text)
                rows += [(number, sign, *block) for block in found]
        names = pa.list_(pa.string())
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), names, names, names))], names=["doc", "sign", "first", "entities", "fresh", "terms"])


def disclosing(docs: DataFrame) -> DataFrame:
    """term, left_bits (the least over its entities) and bits (the most): terms of the corpus over the thresholds."""
    met = written(docs.select(docs["text"].alias("text")).mapInArrow(_collect, "doc long, sign long, first boolean, entities array<string>, fresh array<string>, terms array<string>"))
    by_text = met.select("sign", F.explode("fresh").alias("entity")).groupBy("entity", "sign").agg(F.count("*").alias("n"))
    known = written(by_text.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("n").alias("n_c")).where(F.col("texts") >= SUPPORT).select("entity", "n_c"))
    blank = docs.sparkSession.createDataFrame([], "term string, left_bits double, bits double")
    if known.isEmpty():
        return blank
    side = F.broadcast(known) if fits(known) else known
    pairs = met.select("doc", "sign", "terms", F.explode("entities").alias("entity")).join(side.select("entity"), "entity", "left_semi").select("doc", "sign", "entity", F.explode("terms").alias("term")).distinct()
    joint = pairs.groupBy("entity", "term", "sign").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("n_ct"))
    joint = written(joint.where(F.col("texts") >= SUPPORT).join(side, "entity"))
    # one context a document bounds n(t) from below, so that common words need no count over all texts
    seen = met.where("first").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_seen"))
    most = joint.groupBy("term").agg((F.max("n_ct") * 2**LEFT_BITS).alias("most"))
    asked = written(most.join(seen, "term", "left").where(F.coalesce("n_seen", F.lit(0)) <= F.col("most")).select("term"))
    words = docs.select(F.explode(F.array_distinct(alnum_words(ascii_lower(text_or_empty(docs["text"]))))).alias("term"))
    counted = (words.join(F.broadcast(asked), "term", "left_semi").groupBy("term") if fits(asked) else words.groupBy("term")).agg(F.count("*").alias("n_t"))
    n = docs.count()
    # an entity's own digits or name may stand in spans, so n(t) is at least n(c, t)
    left = F.log2(F.greatest(F.col("n_t"), F.col("n_ct")) / F.col("n_ct"))
    scored = joint.join(counted, "term").select("term", left.alias("left_bits"), (F.log2(F.lit(n) / F.col("n_c")) - left).alias("bits"))
    return scored.where((F.col("left_bits") <= LEFT_BITS) & (F.col("bits") >= MIN_BITS)).groupBy("term").agg(F.min("left_bits").alias("left_bits"), F.max("bits").alias("bits"))


def _spans(text: str, terms: dict[str, bool] | frozenset[str]) -> tuple[list[Span], list[tuple[int, int, str]]]:
    """The entities of a text, and its disclosing terms as (start, end, term)."""
    base = entities(text)
    if not terms or not any(w in terms for w in set(_WORD.findall(text.encode().lower().decode()))):
        return base, []
    return base, [(m.start(), m.end(), m.group()) for m in _terms(text, base) if m.group() in terms]


def _marked(docs: DataFrame, terms: DataFrame, make: Callable[[str, tuple], tuple], schema: str, types: list[pa.DataType]) -> DataFrame:
    """docs (columns _row, _text) as _row and what make gives of a text and its spans; terms (written): term, gone."""
    names = [p.split()[0] for p in schema.split(", ")]
    kind = docs.schema["_row"].dataType.simpleString()

    def rows(batch: pa.RecordBatch, of: Callable[[int], dict[str, bool]]) -> pa.RecordBatch:
        made = [make(text or "", (*_spans(text or "", own), own)) for i, text in enumerate(batch.column(1).to_pylist()) for own in (of(i),)]
        return pa.record_batch([batch.column(0), *[pa.array([m[k] for m in made], t) for k, t in enumerate(types)]], names=["_row", *names])

    if fits(terms):
        held = docs.sparkSession.sparkContext.broadcast({r.term: r.gone for r in terms.collect()})

        def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch, lambda _: held.value)

        return docs.mapInArrow(mark, f"_row {kind}, {schema}")

    key = F.xxhash64("_text")  # equal keys of different texts share a list, which changes nothing: each word on it is disclosing anywhere
    uses = docs.where(F.col("_text").isNotNull()).select(key.alias("_key"), F.explode(F.array_distinct(alnum_words(ascii_lower(F.col("_text"))))).alias("term"))
    lists = uses.join(terms, "term").select("_key", F.struct("term", "gone").alias("_t")).groupBy("_key").agg(F.collect_set("_t").alias("_terms"))
    joined = docs.withColumn("_key", key).join(lists, "_key", "left").select("_row", "_text", "_terms")

    def mark_own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_pylist()
            yield rows(batch, lambda i, own=own: {t["term"]: t["gone"] for t in own[i] or ()})

    return joined.mapInArrow(mark_own, f"_row {kind}, {schema}")


def _digest(text: str, found: tuple) -> tuple:
    base, terms, _ = found
    written_base = [f"{KINDS[k]}:{s}:{e}" for k, s, e in base]
    counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
    return (*counts, hashlib.sha256(",".join(written_base).encode()).hexdigest(), ",".join([*written_base, *[f"{TERM}:{s}:{e}" for s, e, _ in terms]]))


def _general(word: str) -> str:
    """The class of a term's form: what is left of it when it is generalised."""
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[TERM]"


def _clean(text: str, found: tuple) -> tuple:
    base, terms, gone = found
    cuts = sorted([(s, e, f"[{KINDS[k].upper()}]") for k, s, e in base] + [(s, e, "" if gone[w] else _general(text[s:e])) for s, e, w in terms])
    out, at = [], 0
    for start, end, put in cuts:
        if start >= at:
            out += [text[at:start], put]
        at = max(at, end)
    return ("".join([*out, text[at:]]),)


def _listed(docs: DataFrame) -> DataFrame:
    return written(disclosing(docs).select("term", (F.col("left_bits") <= GONE_BITS).alias("gone")))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts by kind, the digest of the patterns' spans, and all spans as kind:start:end."""
    types = [*[pa.int64()] * 4, pa.string(), pa.string()]
    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return _marked(docs.select(docs["doc_id"].alias("_row"), docs["text"].alias("_text")), _listed(docs), _digest, schema, types).withColumnRenamed("_row", "doc_id")


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with entities replaced by their kinds and disclosing terms generalised or removed; a null text stays null."""
    rows = packed(docs).select("_row", F.col("_row.text").alias("_text"))
    got = _marked(rows, _listed(docs), _clean, "_clean string", [pa.string()])
    return got.select(*[(F.when(F.col("_row.text").isNotNull(), F.col("_clean")) if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
