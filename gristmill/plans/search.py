"""Search queries: typed query strings against a positional index, hybrid retrieval, and vector joins by an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import fusion as R
from gristmill.operators import ivf as V
from gristmill.operators import joins as J
from gristmill.operators import search as S
from gristmill.plans.joins import COS, VEC
from gristmill.plans.registry import query, table

#: The query set: benchmark items whose id is divisible by 20 ask for `"w1 w2" OR w3 w4 -w5`, made of their first words.
_TOKENS = "regexp_extract_all(lower({t}), '[a-z0-9]+|[一-鿿]')"
_ITEMS = f"""
     bq AS (SELECT item_id AS q, {_TOKENS.format(t="text")} AS w FROM benchmark WHERE item_id % 20 = 0),
     items AS (SELECT q, 0 AS alt, 0 AS item, false AS neg, w[1:2] AS words FROM bq WHERE len(w) >= 5 UNION ALL SELECT q, 1, 2, false, w[3:3] FROM bq WHERE len(w) >= 5
               UNION ALL SELECT q, 1, 3, false, w[4:4] FROM bq WHERE len(w) >= 5 UNION ALL SELECT q, 1, 4, true, w[5:5] FROM bq WHERE len(w) >= 5),
     tok AS (SELECT doc_id AS id, {_TOKENS.format(t="coalesce(text, '')")} AS w FROM documents),
     pos AS (SELECT id, n, unnest(w) AS term, unnest(range(n)) AS p FROM (SELECT id, w, len(w) AS n FROM tok)),
     occ AS (SELECT q, alt, item, neg, a.id, a.n, a.p FROM items JOIN pos a ON a.term = words[1] WHERE len(words) = 1
             UNION ALL SELECT q, alt, item, neg, a.id, a.n, a.p FROM items JOIN pos a ON a.term = words[1] JOIN pos b ON b.id = a.id AND b.p = a.p + 1 AND b.term = words[2] WHERE len(words) = 2),
     stat AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(w)) AS mean FROM tok),
     tf AS (SELECT q, alt, item, neg, id, n, count(*) AS tf FROM occ GROUP BY ALL),
     df AS (SELECT q, alt, item, count(*) AS d FROM tf GROUP BY ALL),
     w AS (SELECT tf.*, ln(1 + (n_docs - d + 0.5) / (d + 0.5)) * tf * ({S.K1} + 1) / (tf + {S.K1} * (1 - {S.B} + {S.B} * n / mean)) AS weight FROM tf JOIN df USING (q, alt, item), stat),
     need AS (SELECT q, alt, count(*) FILTER (WHERE NOT neg) AS needed FROM items GROUP BY ALL),
     met AS (SELECT q, alt, id, sum(weight) FILTER (WHERE NOT neg) AS bm25, max(needed) AS m FROM w JOIN need USING (q, alt) GROUP BY q, alt, id HAVING count(*) FILTER (WHERE neg) = 0 AND count(*) FILTER (WHERE NOT neg) = max(needed)),
     ends AS (SELECT m.q, m.alt, m.id, m.bm25, m.m, o.p, max(b.p) AS last FROM met m JOIN occ o ON o.q = m.q AND o.alt = m.alt AND o.id = m.id JOIN occ b ON b.q = m.q AND b.alt = m.alt AND b.id = m.id AND b.p <= o.p WHERE m.m > 1 GROUP BY m.q, m.alt, m.id, m.bm25, m.m, o.p, b.item),
     cover AS (SELECT q, alt, id, min(wide) AS wide FROM (SELECT q, alt, id, p, p - min(last) + 1 AS wide FROM ends GROUP BY q, alt, id, p, m HAVING count(*) = m) GROUP BY ALL),
     score AS (SELECT q, id, round(max(bm25 + coalesce(m / wide, 0.0)), 6) AS score FROM met LEFT JOIN cover USING (q, alt, id) GROUP BY ALL)"""
_FOUND = "SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM score QUALIFY rank <= 40"
_NEAR = f"SELECT a.vec_id AS q, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id) AS rank FROM (SELECT * FROM {VEC} WHERE vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)) a JOIN {VEC} b ON a.vec_id <> b.vec_id QUALIFY rank <= 40"


def _typed(spark, d):
    w = S.tokens(F.col("text"))
    typed = F.format_string('"%s %s" OR %s %s -%s', *[F.col("w")[i] for i in range(5)])
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select("item_id", w.alias("w")).where(F.size("w") >= 5).select("item_id", typed.alias("typed"))


def _lexical(spark, d):
    index = S.build(table(spark, d, "documents"), "doc_id", "text")
    return S.search(index, _typed(spark, d), "item_id", "typed", 40)


def _dense(spark, d):
    rows = table(spark, d, "embeddings")
    asked = table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("vec_id"))
    return J.knn(rows.join(asked, "vec_id", "left_semi"), rows, "vec_id", "embedding", 40).select("q", F.col("n").alias("id"), F.col("rank").cast("bigint").alias("rank"))


@query("g25_typed_queries", f"WITH {_ITEMS} {_FOUND}")
def g25_typed(spark, d):
    return _lexical(spark, d)


@query("g26_hybrid_search", f"WITH {_ITEMS}, l AS ({_FOUND}), v AS ({_NEAR}) SELECT q, id, coalesce(v.rank, 100000 + l.rank) AS pos FROM v FULL JOIN l USING (q, id) QUALIFY row_number() OVER (PARTITION BY q ORDER BY pos) <= 60")
def g26_hybrid(spark, d):
    return S.backfilled(_dense(spark, d), _lexical(spark, d), 60)


@query("f49_rrf_search", f"WITH {_ITEMS}, l AS ({_FOUND}), v AS ({_NEAR}) SELECT q, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT q, id, rank FROM l UNION ALL SELECT q, id, rank FROM v) GROUP BY ALL")
def f49_search(spark, d):
    lists = [df.select(F.struct("q", "id").alias("key"), (F.col("rank") - 1).alias("r")) for df in (_dense(spark, d), _lexical(spark, d))]
    return R.rrf(lists, "key", "r").select("key.q", "key.id", "score")


def _lists(spark, d):
    return V.build(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query("j11_similar_pairs_indexed")
def j11_indexed(spark, d):
    lists = _lists(spark, d)
    return V.similar_pairs(lists, 0.4, V.probes_for(lists, least=0.4, recall=0.8))  # either end may find a pair


@query("j12_knn_indexed")
def j12_indexed(spark, d):
    lists = _lists(spark, d)
    return V.knn(lists, table(spark, d, "embeddings"), 4, V.probes_for(lists, 4))


@query("j13_cross_group_indexed")
def j13_indexed(spark, d):
    lists = _lists(spark, d)
    return V.knn(lists, table(spark, d, "embeddings"), 3, V.probes_for(lists, 3, group="label"), "label")
