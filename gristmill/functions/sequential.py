"""Text functions that carry state along a text: Arrow-batched Python, returning arrays to explode."""

from __future__ import annotations

import html
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the alphabet of Crockford's base 32.
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def chunks(c: Column, least: int = 80, most: int = 1200) -> Column:
    """Sections by headings of level 2 and 3; short ones join the next, long ones split at blank lines."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            parts = [p.strip() for p in re.split(r"(?m)^(?=#{2,3} )", text or "") if p.strip()]
            merged: list[str] = []
            carry = ""
            for p in parts:
                carry = f"{carry}\n\n{p}" if carry else p
                if len(carry) >= least:
                    merged.append(carry)
                    carry = ""
            if carry:
                merged.append(carry)
            out: list[str] = []
            for p in merged:
                piece = ""
                for para in p.split("\n\n") if len(p) > most else [p]:
                    if piece and len(piece) + len(para) + 2 > most:
                        out.append(piece)
                        piece = para
                    else:
                        piece = f"{piece}\n\n{para}" if piece else para
                if piece:
                    out.append(piece)
            return out
        return texts.map(one)

    return run(c)


def sentence_chunks(c: Column, words: int = 400, chars: int = 1400) -> Column:
    """Whole sentences up to so many words and characters; a longer sentence stands alone."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            out: list[str] = []
            held: list[str] = []
            n = size = 0
            for s in re.split(r"(?<=[.!?。！？])\s+", (text or "").strip()):
                w = len(s.split())
                if held and (n + w > words or size + len(s) + 1 > chars):
                    out.append(" ".join(held))
                    held, n, size = [], 0, 0
                if s:
                    held.append(s)
                    n, size = n + w, size + len(s) + 1
            return out + ([" ".join(held)] if held else [])
        return texts.map(one)

    return run(c)


def chapter_spans(c: Column) -> Column:
    """(chapter, start, stop) by chapter headings in English or Chinese, the first of each number."""
    @F.pandas_udf("array<struct<chapter:int,start:int,stop:int>>")
    def run(texts: pd.Series) -> pd.Series:
        han = {x: i for i, x in enumerate("一二三四五六七八九十", 1)}
        def one(text: str | None) -> list[dict]:
            found: dict[int, int] = {}
            for m in re.finditer(r"(?m)^#{0,3} ?(?:Chapter (\d+)|第([一二三四五六七八九十]|\d+)章)", text or ""):
                n = int(m[1]) if m[1] else han.get(m[2]) or int(m[2])
                found.setdefault(n, m.start())
            marks = sorted((at, n) for n, at in found.items())
            return [{"chapter": n, "start": at, "stop": marks[i + 1][0] if i + 1 < len(marks) else len(text)} for i, (at, n) in enumerate(marks)]
        return texts.map(one)

    return run(c)


def ulid_of(c: Column) -> Column:
    """A 26-character id in Crockford's base 32: the first 130 bits of the SHA-256 of the text and the suffix `|ulid`; null for null."""
    digest = F.sha2(F.concat(c, F.lit("|ulid")), 256)
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(33)), lambda i: F.lpad(F.conv(F.substr(digest, i, F.lit(1)), 16, 2), 4, "0")), "")
    letter = lambda i: F.substr(F.lit(_CROCKFORD), F.conv(F.substr(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.when(c.isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), letter), ""))


def unescaped(c: Column) -> Column:
    """Character references decoded."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else html.unescape(x))

    return run(c)


def signal_edges(c: Column, phrases: list[str], signals: list[str], reach: int = 55, negations: tuple[str, ...] = ("not", "never", "no")) -> Column:
    """(src, dst, signal): the nearest phrase before and after each signal within reach, unless the stretch is negated."""
    @F.pandas_udf("array<struct<src:string,dst:string,signal:string>>")
    def run(texts: pd.Series) -> pd.Series:
        known = re.compile("|".join(rf"\b{re.escape(p)}\b" for p in sorted(phrases, key=len, reverse=True)))
        signal = re.compile("|".join(rf"\b{re.escape(s)}\b" for s in sorted(signals, key=len, reverse=True)))
        no = re.compile("|".join(rf"\b{n}\b" for n in negations))
        def one(text: str | None) -> list[dict]:
            out = []
            for sentence in re.split(r"(?<=[.!?])\s+", (text or "").lower()):
                for m in signal.finditer(sentence):
                    before = list(known.finditer(sentence, max(0, m.start() - reach), m.start()))
                    after = known.search(sentence, m.end(), m.end() + reach)
                    if before and after and before[-1][0] != after[0] and not no.search(sentence, before[-1].end(), after.start()):
                        out.append({"src": before[-1][0], "dst": after[0], "signal": m[0]})
            return out
        return texts.map(one)

    return run(c)


def relation_edges(c: Column, phrases: list[str], relations: Mapping[str, str], negation: str, backwards: tuple[str, ...] = ("prerequisite",), reach: int = 55, guard: int = 30) -> Column:
    """(src, dst, relation) of each signal with a phrase within reach on both sides of it in its sentence.

    The phrase that ends last before the signal points to the one that begins first after it, the other
    way round for relations in `backwards`; of several there the last and the first by name. Phrases
    are lower case and may stand in the plural. A signal right after a negation, looked for in the
    `guard` characters before it, and a phrase with itself give nothing. The work of a signal doesn't
    grow with the number of phrases: stretches of the text are looked up in a table.
    """
    known = {p + end: p for end in ("es", "s", "") for p in phrases}
    longest = max(map(len, known), default=0)

    @F.pandas_udf("array<struct<src:string,dst:string,relation:string>>")
    def run(texts: pd.Series) -> pd.Series:
        signals = [(name, re.compile(p, re.I)) for name, p in relations.items()]
        no = re.compile(negation, re.I)

        def letter_at(s: str, i: int) -> bool:
            """Whether a letter stands at i."""
            return "a" <= s[i : i + 1] <= "z"

        def one(text: str | None) -> list[dict]:
            out = []
            for sentence in re.split(r"(?<=[.!?])\s+", text or ""):
                s = "".join(x.lower() if x.isascii() else x for x in sentence)
                for name, signal in signals:
                    for m in signal.finditer(sentence):
                        if no.search(sentence[max(0, m.start() - guard) : m.start()]):
                            continue
                        a = b = None
                        for end in range(m.start(), max(-1, m.start() - reach - 1), -1):
                            if not letter_at(s, end):
                                a = max((known[s[i:end]] for i in range(max(0, end - longest), end) if s[i:end] in known and not (i and letter_at(s, i - 1))), default=None)
                            if a:
                                break
                        for at in range(m.end(), min(len(s), m.end() + reach + 1)) if a else ():
                            if not (at and letter_at(s, at - 1)):
                                b = min((known[s[at:i]] for i in range(at + 1, min(len(s), at + longest) + 1) if s[at:i] in known and not letter_at(s, i)), default=None)
                            if b:
                                break
                        if a and b and a != b:
                            out.append({"src": b, "dst": a, "relation": name} if name in backwards else {"src": a, "dst": b, "relation": name})
            return out
        return texts.map(one)

    return run(c)


def bold_terms(c: Column,stop: tuple[str, ...] = ("note", "example")) -> Column:
    """Terms in double asterisks in order, each once, without the stop list."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1)), lambda x: F.lower(F.trim(x))))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop]))


def covered(term: Column, text: Column) -> Column:
    """Whether the text holds the term: as it is, all its words, or (Han) two thirds of its character pairs."""
    @F.pandas_udf("boolean")
    def run(terms: pd.Series, texts: pd.Series) -> pd.Series:
        def one(t: str | None, x: str | None) -> bool:
            if not t or not x:
                return False
            t, x = t.lower(), x.lower()
            if t in x or all(w in x for w in t.split()):
                return True
            pairs = [t[i : i + 2] for i in range(len(t) - 1)] if re.search("[一-鿿]", t) else []
            return bool(pairs) and 3 * sum(p in x for p in pairs) >= 2 * len(pairs)
        return pd.Series([one(a, b) for a, b in zip(terms, texts, strict=True)])

    return run(term, text)


def wiki_sections(c: Column) -> Column:
    """(section, paragraph) of wiki text, templates, references and link marks removed."""
    @F.pandas_udf("array<struct<section:string,paragraph:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            text = re.sub(r"(?s)<ref[^>]*?(?:/>|>.*?</ref>)|<!--.*?-->", "", text or "")
            while (less := re.sub(r"\{\{[^{}]*\}\}", "", text)) != text:
                text = less
            text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text).replace("'''", "").replace("''", "")
            out, section = [], ""
            for para in re.split(r"\n\s*\n|\n(?==)|(?<==)\n", text):
                if m := re.fullmatch(r"\s*=+\s*(.*?)\s*=+\s*", para):
                    section = m[1]
                elif para.strip():
                    out.append({"section": section, "paragraph": " ".join(para.split())})
            return out
        return texts.map(one)

    return run(c)
