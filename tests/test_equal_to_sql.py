"""Queries on small odd tables that must equal their SQL."""

import html

import duckdb
import pytest

from gristmill.plans.every import ORACLES, QUERIES
from tests.test_queries import plain


@pytest.fixture
def same(spark, tmp_path):
    """Writes tables (schema, rows), runs a query over them, compares it with its SQL and returns its rows."""

    def run(name, **tables):
        duck = duckdb.connect()
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
            duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        got = df.select(*sorted(df.columns)).collect()
        if name in ORACLES:
            rel = duck.sql(ORACLES[name])
            at = [rel.columns.index(c) for c in sorted(df.columns)]
            assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
        return got

    return run


PAGES = [(1, "<title>a &amp</title> b"), (2, "<TITLE>x</TITLE>"), (3, "<title>&amp;lt; &lt;b&gt; &#39;q&#x27; &quot; &amp;amp;</title>"), (4, "<title>&eacute;&nbsp;&#228; &copy</title>"), (5, None), (6, "")]


def test_titles_decode_as_sql_does(same):
    got = {r.page_id: r.title for r in same("f07_html_words", pages=("page_id long, html string", PAGES))}
    assert got[1] == "a &amp" and got[3] == "&lt; <b> 'q' \" &amp;"


def test_titles_decoded_in_full(same):
    got = {r.page_id: r.title for r in same("f07_html_titles_decoded", pages=("page_id long, html string", PAGES))}
    assert got == {1: "a &", 2: "", 3: "&lt; <b> 'q' \" &amp;", 4: html.unescape("&eacute;&nbsp;&#228; &copy"), 5: None, 6: ""}


ITEMS = [(1, "and.\nHa Fox  or"), (2, "学习机器 \n x"), (3, "a b"), (4, None), (5, "a"), (6, "not here")]
TEXTS = [(1, "The fox and. a Ha", None), (2, "我学习机", None), (3, None, None), (4, "x", None), (5, "", None), (6, "HERE it is", None)]


def test_coverage_as_sql_has_it(same):
    got = {(r.item_id, r.term): r.covered for r in same("f34_coverage", benchmark=("item_id long, text string", ITEMS), documents=("doc_id long, text string, lang string", TEXTS))}
    assert got[1, "and.\nHa"] is False and got[1, "Fox"] is True and got[2, "学习机器"] is False and got[3, "a"] is False


def test_coverage_by_parts(same):
    got = {(r.item_id, r.term): r.covered for r in same("f34_coverage_by_parts", benchmark=("item_id long, text string", ITEMS), documents=("doc_id long, text string, lang string", TEXTS))}
    assert got[1, "and.\nHa"] and got[2, "学习机器"] and not got[1, "or"] and not got[3, "a"] and not got[5, "a"] and got[6, "here"] and not got[6, "not"]


def test_books_as_sql_has_them(same):
    """A share on a tie of the first decimal (37 of 2,000), short lines that look like chapters, running heads, odd line ends."""
    long, tie = "x" * 20, "\n".join(["b"] * 980 + ["bb", "y" * 22])
    texts = [tie, f"# Chapter 1: a\n{long}", f"{long}\n# Chapter 2: b", "\n".join([long + "C H A P T E R 1"] * 5), None, "", "\n", f"{long}\r\n{long}\u2028# Chapter 9: z\n", "é🙂" * 10]
    got = {r.doc_id: r for r in same("q13_book_acceptance", documents=("doc_id long, text string", list(enumerate(texts))))}
    assert got[0].chapters == 1 and got[0].largest == 1.9 and got[2].chapters == 1 and got[3].accepted


def test_interval_relations_are_counted_without_pairs(same):
    """Null years, a null start, repeated and null keys, a null brand; the join is over years, not over parts."""
    rows = [(k % 60, f"Brand#{k % 3}", k * 7 % 50) for k in range(90)] + [(None, "Brand#1", 3), (200, None, 3), (201, "Brand#1", None), (202, "Brand#2", 5), (202, "Brand#2", 5)]
    assert {r.rel for r in same("j29_interval_relation", part=("p_partkey long, p_brand string, p_size int", rows))} == {"overlap", "near", "far", "unknown"}


def test_interval_relations_of_a_large_brand(spark, tmp_path):
    """100,000 parts of one brand are 5 billion pairs."""
    n = 100_000
    spark.range(n).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "cast(id % 50 as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    assert sum(r.n for r in QUERIES["j29_interval_relation"](spark, str(tmp_path)).collect()) == n * (n - 1) // 2


def test_neighbours_of_other_groups(same):
    """A vector without a group is in no other group than any."""
    rows = [(i, [float(i % 5), 1.0 + i % 3], None if i % 4 == 0 else i % 2) for i in range(20)]
    assert {r.q for r in same("j13_knn_cross_group", embeddings=("vec_id long, embedding array<float>, label int", rows))} == {i for i in range(20) if i % 4}
