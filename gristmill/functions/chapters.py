"""Chapters of a book's text as a table function: headings, contents pages and passing mentions told apart.

A heading is a line that begins with `Chapter 3` or 第三章, with or without marks of a heading. A contents
page is a run of headings whose numbers rise by one at distances that no chapter has; its entries, and
lone entries with dots or a page number, are none. A number's heading is the first one behind the
chapter before it, so that a mention in a preface doesn't count. Without any, numbered sections (1.1)
show where chapters begin. The last chapter ends before an index or glossary.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that lie between the headings of real chapters at least.
NEAR = 1500
_HEAD = re.compile(r"^#{0,6}[ \t]*(?:chapter[ \t]+(\d{1,4})\b|第([一二三四五六七八九十百零0-9]+)章)", re.I | re.M)
_ENTRY = re.compile(r"…|\.{4}|[ \t]\d+[ \t]*$", re.M)
_SECTION = re.compile(r"^#{1,6}[ \t]+\**(\d{1,2})\.(\d+)\b", re.M)
_BARE_SECTION = re.compile(r"(?<=\n\n)(\d{1,2})\.(\d+)[ \t]+[A-Z][\w ,'-]{3,80}$", re.M)
_BACK = re.compile(r"^#{1,3}[ \t]*\**[ \t]*(?:glossary|index)\b", re.I | re.M)
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")}


def han_number(s: str) -> int:
    """第…章 up to 999; 0 for what is no number."""
    if s.isascii():
        return int(s)
    hundreds, _, rest = s.rpartition("百")
    tens, ten, ones = rest.partition("十")
    if not ten:
        tens, ones = "零", rest.lstrip("零")
    parts = [hundreds or "零", tens or "一", ones or "零"]
    return sum(_DIGITS[p] * w for p, w in zip(parts, (100, 10, 1), strict=True)) if all(p in _DIGITS for p in parts) else 0


def _headings(text: str, near: int) -> dict[int, list[int]]:
    """The places of each number's headings outside of contents pages."""
    found = [(m.start(), int(m[1]) if m[1] else han_number(m[2]), m.end()) for m in _HEAD.finditer(text)]
    follows = [b[1] == a[1] + 1 and b[0] - a[0] < near for a, b in zip(found, found[1:], strict=False)]
    out: dict[int, list[int]] = {}
    for i, (at, number, behind) in enumerate(found):
        listed = (i > 0 and follows[i - 1]) or (i < len(follows) and follows[i])
        rest = text[behind : at + 60].partition("\n")[0]
        if number and not listed and not _ENTRY.search(rest):
            out.setdefault(number, []).append(at)
    return out


def _sections(text: str) -> dict[int, list[int]]:
    first: dict[int, tuple[int, int]] = {}
    for m in list(_SECTION.finditer(text)) or _BARE_SECTION.finditer(text):
        own = (int(m[2]), m.start())
        first[int(m[1])] = min(own, first.get(int(m[1]), own))
    return {n: [at] for n, (_, at) in first.items()}


def spans(text: str | None, near: int = NEAR) -> list[tuple[int, int, int]]:
    """(number, start, end) of the chapters in order; characters from 0, end exclusive."""
    if not text:
        return []
    places, last, chosen = _headings(text, near) or _sections(text), -1, []
    for number in sorted(places):
        later = bisect_right(places[number], last)
        if later < len(places[number]):
            last = places[number][later]
            chosen.append((number, last))
    if not chosen:
        return []
    ends = [at for _, at in chosen[1:]] + [len(text)]
    if (back := _BACK.search(text, chosen[-1][1])):
        ends[-1] = back.start()
    return [(number, at, end) for (number, at), end in zip(chosen, ends, strict=True)]


@F.udtf(returnType="number int, start int, end int")
class Chapters:
    """A row for each chapter of a text."""

    def eval(self, text: str, near: int) -> Iterator[tuple[int, int, int]]:
        yield from spans(text, near)


def chapters(df: DataFrame, text: str, near: int = NEAR) -> DataFrame:
    """df's rows with number, start and end of each of their chapters; rows without one are left out."""
    return df.lateralJoin(Chapters(F.col(text).outer(), F.lit(near)))
