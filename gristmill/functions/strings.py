"""Text functions on columns, all evaluated in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def equality_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def bare_name(c: Column) -> Column:
    """Lower case without white space, underscores and hyphens."""
    return F.regexp_replace(F.lower(c), r"[\s_-]+", "")


def head_noun(c: Column) -> Column:
    """The last run of a-z in lower case, or null."""
    return F.try_element_at(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), F.lit(-1))


def tokens_without(c: Column, stop: list[str]) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(w) for w in stop]))


def derived_title(c: Column, least: int = 4, most: int = 120) -> Column:
    """The first heading's text, else the first line of at least `least` characters, cut to `most`."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    heading = F.try_element_at(F.filter(lines, lambda x: x.rlike("^#+ +[^ ]")), F.lit(1))
    first = F.try_element_at(F.filter(lines, lambda x: F.length(x) >= least), F.lit(1))
    return F.substring(F.coalesce(F.regexp_replace(heading, "^#+ +", ""), first), 1, most)


def snippet(c: Column, most: int = 400) -> Column:
    """Without markup signs, white space collapsed, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"[#*_`>\[\]()|]", " "), r"\s+", " ")), 1, most)


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, "(?s)<title[^>]*>(.*?)</title>", 1))


def html_words(c: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(c, "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return F.size(F.array_remove(F.split(plain, r"\s+"), ""))


def basic_references(c: Column) -> Column:
    """The references that HTML itself needs (lt, gt, quot, apostrophes, amp), decoded where a semicolon ends them; amp last, so that nothing is decoded twice."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def guessed_language(c: Column, head: int = 20_000) -> Column:
    """zh if more than a tenth of the first characters is Han, else en."""
    start = F.substring(c, 1, head)
    han = F.length(F.regexp_replace(start, "[^一-鿿]", ""))
    return F.when(han * 10 > F.greatest(F.length(start), F.lit(1)), "zh").otherwise("en")


def file_identity(c: Column) -> Column:
    """A file name without folder, extension, trailing ids, download notes and punctuation."""
    name = F.regexp_replace(F.lower(c), r"^.*/", "")
    name = F.regexp_replace(name, r"\.(pdf|epub|md|txt|html)$", "")
    name = F.regexp_replace(name, r"[-_ ]*\(?[0-9a-f]{8,}\)?$", "")
    name = F.regexp_replace(name, r"\(?(z-lib|libgen|copy|download)[^)]*\)?", "")
    return F.trim(F.regexp_replace(name, r"[^a-z0-9]+", " "))


def short_id(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 10)


def hash16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def fingerprint32(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 32)


def tenant_hash(c: Column) -> Column:
    return hash16(c)


def stripped_title(c: Column) -> Column:
    """Without download tags in brackets."""
    return F.trim(F.regexp_replace(c, r"\s*[\(\[][^\)\]]*(www|http|lib|download)[^\)\]]*[\)\]]", ""))


def without_lines(c: Column, word: str, also: str) -> Column:
    """The text without lines that hold both words."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~(F.lower(x).contains(word) & F.lower(x).contains(also))), "\n")


def noise_reason(c: Column) -> Column:
    """Why a line is structure and not content, or null; the first rule that holds wins."""
    return (
        F.when(F.trim(c) == "", "empty")
        .when(c.rlike(r"^\s*[0-9]{1,4}\s*$"), "page_number")
        .when(c.rlike(r"\.{4,}\s*[0-9]+\s*$"), "contents")
        .when(F.lower(c).rlike(r"^\s*(contents|index|bibliography|references|acknowledg)"), "heading")
        .when((F.length(F.trim(c)) < 4), "short")
    )


def section_number(c: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(c, "::"), -1), r"(\d+)\.(\d+)", 0)


def wikilinks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]|]+)"), F.lit(1))


def symbol_density(c: Column, pattern: str) -> Column:
    return F.round(F.regexp_count(c, F.lit(pattern)) / F.greatest(F.length(c), F.lit(1)), 6)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def facets(c: Column, what: str, why: str, how: str) -> Column:
    """full, partial or bare by how many of the three patterns and what length a text has."""
    n = c.rlike(what).cast("int") + c.rlike(why).cast("int") + c.rlike(how).cast("int")
    return F.when((n == 3) & (F.length(c) >= 400), "full").when((n >= 2) | (F.length(c) >= 1500), "partial").otherwise("bare")


def intent(c: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, words in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in words]), name).otherwise(out)
    return out


def canonical(c: Column, synonyms: dict[str, str]) -> Column:
    key = equality_key(c)
    out = key
    for name, value in reversed(list(synonyms.items())):
        out = F.when(key == name, value).otherwise(out)
    return out


def redacted(c: Column) -> Column:
    """Private references replaced."""
    return F.regexp_replace(c, r"\[\[private:[^\]]*\]\]|[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "[redacted]")


def glued_ratio(c: Column) -> Column:
    """Share of lines with at least 20 letters that hold a run of 12 or more small letters."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 20)
    bad = F.filter(lines, lambda x: x.rlike("[a-z]{12,}"))
    return F.round(F.size(bad) / F.greatest(F.size(lines), F.lit(1)), 6)


def table_rows(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$")))


def balanced_dollars(c: Column) -> Column:
    """Whether dollar signs come in pairs."""
    return (F.length(c) - F.length(F.replace(c, F.lit("$"), F.lit("")))) % 2 == 0
