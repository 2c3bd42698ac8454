"""Graph and retrieval queries over the driver's tables; the graph is customer-supplier trade."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import fusion as R
from gristmill.operators import graph as G
from gristmill.operators import joins as J
from gristmill.operators import spectrum as P
from gristmill.operators import topk as K
from gristmill.plans.joins import COS, EDGES, VEC, edges
from gristmill.plans.ordering import DIST, QUERY
from gristmill.plans.registry import query, table

#: Sparse links: pairs with at least three common lines.
STRONG = f"(SELECT src, dst, w FROM {EDGES} WHERE w >= 2)"
BOTH = f"(SELECT src AS a, dst AS b FROM {STRONG} UNION SELECT dst, src FROM {STRONG})"


def strong(spark, d):
    return edges(spark, d).where("w >= 2")


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


_BFS = "WITH RECURSIVE r(id, hop) AS (SELECT 7::BIGINT, 0 UNION SELECT e.b, hop + 1 FROM r JOIN {e} e ON e.a = r.id WHERE hop < {h}) SELECT id, min(hop) AS hop FROM r GROUP BY 1"


@query("g01_bfs_undirected", _BFS.format(e=BOTH, h=3))
def g01(spark, d):
    return G.bfs(strong(spark, d), _seeds(spark, 7), 3)


@query("g02_bfs_directed", _BFS.format(e=f"(SELECT src AS a, dst AS b FROM {STRONG})", h=2))
def g02(spark, d):
    return G.bfs(strong(spark, d), _seeds(spark, 7), 2, directed=True)


@query("g03_seed_expand_documents", f"SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey IN (SELECT a FROM {BOTH} WHERE b IN (SELECT b FROM {BOTH} WHERE a = 7)) OR o_custkey = 7")
def g03(spark, d):
    near = G.bfs(strong(spark, d), _seeds(spark, 7), 2).select(F.col("id").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(near, "o_custkey", "left_semi").select("o_orderkey")


@query("g04_one_hop", f"SELECT DISTINCT b AS id FROM {BOTH} WHERE a IN (1, 2, 3)")
def g04(spark, d):
    return G.bfs(strong(spark, d), _seeds(spark, 1, 2, 3), 1).where("hop = 1").select("id").unionByName(_seeds(spark, 1, 2, 3).limit(0))


@query("g05_degrees", f"WITH g AS (SELECT a AS id, count(*) AS degree FROM {BOTH} GROUP BY 1) SELECT g.id, coalesce(i.n, 0) AS in_degree, degree, round(degree / greatest((SELECT count(*) FROM g) - 1, 1), 6) AS centrality FROM g LEFT JOIN (SELECT dst AS id, count(*) AS n FROM {STRONG} GROUP BY 1) i ON i.id = g.id")
def g05(spark, d):
    return G.degrees(strong(spark, d))


@query("g06_betweenness")
def g06(spark, d):
    return G.betweenness(strong(spark, d))


@query("g07_cross_discipline", f"SELECT e.src AS id, count(DISTINCT s_nationkey) >= 2 AS crossing FROM {STRONG} e JOIN supplier ON -s_suppkey - 1 = e.dst GROUP BY 1")
def g07(spark, d):
    kinds = table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("dst"), "s_nationkey")
    n = strong(spark, d).join(kinds, "dst").groupBy(F.col("src").alias("id")).agg(F.countDistinct("s_nationkey").alias("n"))
    return n.select("id", (F.col("n") >= 2).alias("crossing"))


@query("g08_communities")
def g08(spark, d):
    return G.communities(strong(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").cast("double").alias("w")))


@query("g09_modular_communities")
def g09(spark, d):
    return G.modular_communities(strong(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), min_size=3)


@query("g10_components", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 + p_size AS b FROM part), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b) SELECT id, min(root) AS root FROM r GROUP BY 1")
@query("g10_components_whole", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 + p_size AS b FROM part), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b) SELECT id, min(root) AS root FROM r GROUP BY 1")
def g10_whole(spark, d):
    return G.components(table(spark, d, "part").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1 + F.col("p_size")).alias("dst")))


def _similar(spark, d):
    rows = table(spark, d, "embeddings")
    labels = rows.select("vec_id", "label")
    pairs = J.similar_pairs(rows, "vec_id", "embedding", 0.42)
    return pairs.join(labels.select(F.col("vec_id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("vec_id").alias("b"), F.col("label").alias("lb")), "b")


_SIMILAR = f"(SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb FROM {VEC} a JOIN {VEC} b ON a.vec_id < b.vec_id WHERE round({COS}, 6) >= 0.42)"
_ROOTS = "WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {e}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id WHERE r.root < u.b) SELECT id, min(root) AS root FROM r GROUP BY 1"


@query("g11_components_same_group", _ROOTS.format(e=f"{_SIMILAR} WHERE la = lb"))
def g11(spark, d):
    return G.components(_similar(spark, d).where("la = lb").select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("g12_components_held_apart", _ROOTS.format(e=f"{_SIMILAR} WHERE (a, b) NOT IN ((1, 2), (3, 4))"))
def g12(spark, d):
    held = spark.createDataFrame([(1, 2), (3, 4)], "a bigint, b bigint")
    pairs = _similar(spark, d).join(held, ["a", "b"], "left_anti")
    return G.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("g13_canonical_pick", "SELECT p_brand AS root, p_partkey AS keeper FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, length(p_name), p_partkey) = 1")
def g13(spark, d):
    members = table(spark, d, "part").select(F.col("p_brand").alias("root"), F.col("p_partkey").alias("id"), "p_size", "p_name")
    return G.canonical(members, "p_size", "p_name")


def _keepers(spark, d):
    members = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    keep = members.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("keeper"))
    return members.join(keep, ["c_nationkey", "c_mktsegment"]).select(F.col("c_custkey").alias("id"), "keeper")


_KEEP = "(SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS keeper FROM customer)"


@query("g14_merge_rewrite", f"SELECT keeper, count(DISTINCT o_orderkey) AS links FROM {_KEEP} JOIN orders ON o_custkey = id GROUP BY 1")
def g14(spark, d):
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return links.join(_keepers(spark, d), "id").groupBy("keeper").agg(F.countDistinct("o_orderkey").alias("links"))


@query("g15_edge_repoint", f"SELECT DISTINCT coalesce(k.keeper, e.src) AS src, e.dst FROM {STRONG} e LEFT JOIN {_KEEP} k ON k.id = e.src")
def g15(spark, d):
    return G.repointed(strong(spark, d), _keepers(spark, d))


@query("g16_keep_longest", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS superseded_by FROM documents QUALIFY first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) <> doc_id")
def g16(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "documents").select("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("h"))
    w = Window.partitionBy("h").orderBy(F.col("n_chars").desc(), "doc_id")
    return rows.withColumn("superseded_by", F.first("doc_id").over(w)).where("superseded_by <> doc_id").select("doc_id", "superseded_by")


_ADJ = f"(SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(x) AS w FROM (SELECT src, dst, w::DOUBLE AS x FROM {STRONG} UNION ALL SELECT src, dst, 2.0 FROM {STRONG} WHERE w >= 3) GROUP BY 1, 2)"


def _adjacency(spark, d):
    e = strong(spark, d)
    return G.weighted(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), e.where("w >= 3"))


@query("g17_weighted_adjacency", f"SELECT a, b, w FROM {_ADJ}")
def g17(spark, d):
    return _adjacency(spark, d)


@query("g18_fiedler")
def g18(spark, d):
    value, sides = G.fiedler(_adjacency(spark, d))
    return spark.createDataFrame(sides).withColumn("lambda2", F.lit(round(value, 6)))


@query("g18_spectral_communities")
def g18_communities(spark, d):
    """Eight communities of the largest component, with the sides of its weakest cut, computed by joins."""
    values, placed = P.spectral_communities(_adjacency(spark, d), 8, tolerance=1e-3)
    return placed.withColumn("lambda2", F.lit(round(values[1], 6) if len(values) > 1 else None).cast("double"))


@query("g19_hubs", f"SELECT id, sum(w) AS w FROM (SELECT a AS id, w FROM {_ADJ} UNION ALL SELECT b, w FROM {_ADJ}) GROUP BY 1 ORDER BY w DESC, id LIMIT 10")
def g19(spark, d):
    return G.hubs(_adjacency(spark, d), 10)


@query("g20_chains", "SELECT array_to_string([a.x, a.y, b.y], '>') AS path FROM (SELECT DISTINCT c_nationkey AS x, 100 + (c_custkey % 7) AS y FROM customer) a JOIN (SELECT DISTINCT 100 + (c_custkey % 7) AS x, 1000 + c_custkey % 5 AS y FROM customer) b ON a.y = b.x")
def g20(spark, d):
    c = table(spark, d, "customer")
    one = c.select(F.col("c_nationkey").cast("bigint").alias("src"), (F.col("c_custkey") % 7 + 100).alias("dst"))
    two = c.select((F.col("c_custkey") % 7 + 100).alias("src"), (F.col("c_custkey") % 5 + 1000).alias("dst"))
    return G.chains(one.unionByName(two)).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("g21_prerequisites", f"SELECT src, array_to_string(list_sort(list(dst)), ',') AS needs FROM {STRONG} GROUP BY 1")
def g21(spark, d):
    return strong(spark, d).groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("needs"))


@query("g22_cooccurrence", "SELECT tier, count(*) AS n, sum(shared)::BIGINT AS shared FROM (SELECT count(*) AS shared, CASE WHEN count(*) >= 3 THEN 'strong' WHEN count(*) >= 2 THEN 'medium' ELSE 'weak' END AS tier FROM (SELECT DISTINCT l_orderkey AS k, l_partkey AS v FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey AS k, l_partkey AS v FROM lineitem) y ON x.v = y.v AND x.k < y.k GROUP BY x.k, y.k) GROUP BY 1")
def g22(spark, d):
    pairs = J.shared_attribute_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    tier = F.when(F.col("shared") >= 3, "strong").when(F.col("shared") >= 2, "medium").otherwise("weak")
    return pairs.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.sum("shared").alias("shared"))


@query("g23_blocking_evaluation", f"SELECT count(*) AS kept, round(1 - count(*) / greatest(1, any_value(n) * (any_value(n) - 1) // 2), 6) AS reduction, round(avg((la = lb)::INT::DOUBLE), 6) AS same_share FROM {_SIMILAR}, (SELECT count(*) AS n FROM embeddings)")
def g23(spark, d):
    pairs = _similar(spark, d)
    n = table(spark, d, "embeddings").count()
    return pairs.agg(F.count("*").alias("kept"), F.round(1 - F.count("*") / F.lit(max(1, n * (n - 1) // 2)), 6).alias("reduction"), F.round(F.avg((F.col("la") == F.col("lb")).cast("double")), 6).alias("same_share"))


_TERMS = ["the", "thing", "with"]


def _dense(spark, d):
    top = K.nearest(table(spark, d, "embeddings"), "embedding", QUERY, 20, "vec_id").select(F.col("vec_id").alias("id"), "dist")
    return K.ranked(top, [F.col("dist"), F.col("id")], 20, "d_rank")


def _lexical(spark, d):
    return R.lexical(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text", _TERMS, 20)


_WORDS = "(SELECT doc_id AS id, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM documents)"
_TF = f"(SELECT id, {', '.join(f'len(list_filter(w, lambda x: x = {chr(39)}{t}{chr(39)})) AS t{i}' for i, t in enumerate(_TERMS))} FROM {_WORDS})"
_LEX = f"(SELECT id, round({' + '.join(f'CASE WHEN t{i} > 0 THEN (1 + ln(t{i})) * ln(1 + n / d{i}) ELSE 0 END' for i in range(3))}, 6) AS score FROM {_TF}, (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE t{i} > 0) AS d{i}' for i in range(3))} FROM {_TF}))"
_LRANK = f"(SELECT id, row_number() OVER (ORDER BY score DESC, id) AS l_rank FROM (SELECT id, score FROM {_LEX} WHERE score > 0 ORDER BY score DESC, id LIMIT 20))"
_DRANK = f"(SELECT vec_id AS id, row_number() OVER (ORDER BY dist, vec_id) AS d_rank FROM (SELECT vec_id, {DIST} AS dist FROM {VEC} ORDER BY dist, vec_id LIMIT 20))"


@query("g24_dense_channel", f"SELECT id, d_rank FROM {_DRANK}")
def g24(spark, d):
    return _dense(spark, d).select("id", "d_rank")


@query("g25_lexical_channel", f"SELECT id, l_rank FROM {_LRANK}")
def g25(spark, d):
    return _lexical(spark, d).select("id", "l_rank")


@query("g26_hybrid_backfill", f"SELECT id, coalesce(d_rank, 100000 + l_rank) AS pos FROM (SELECT * FROM {_DRANK}) FULL JOIN (SELECT * FROM {_LRANK}) USING (id) ORDER BY pos LIMIT 30")
def g26(spark, d):
    return R.backfill(_dense(spark, d), _lexical(spark, d), "id", 30).select("id", "pos")


@query("f49_rrf", f"SELECT id, round(sum(1.0 / (60 + r)) * max(CASE WHEN id < 100 THEN 1.5 ELSE 1.0 END), 6) AS score FROM (SELECT id, d_rank AS r FROM {_DRANK} UNION ALL SELECT id, l_rank FROM {_LRANK}) GROUP BY 1")
def f49(spark, d):
    lists = [_dense(spark, d).select("id", (F.col("d_rank") - 1).alias("r")), _lexical(spark, d).select("id", (F.col("l_rank") - 1).alias("r"))]
    return R.rrf(lists, "id", "r", pinned=table(spark, d, "documents").where("doc_id < 100").select(F.col("doc_id").alias("id")))


@query("g27_rerank", "SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders ORDER BY o_orderkey LIMIT 10)")
def g27(spark, d):
    hits = K.ranked(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 10, "position").withColumn("position", F.col("position") - 1)
    verdicts = spark.createDataFrame([(5, 0), (2, 1), (5, 2), (99, 3)], "position bigint, judged int")
    return R.reranked(hits, verdicts).select("o_orderkey", "position")


@query("g28_score_rerank", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3")
def g28(spark, d):
    hits = K.ranked(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 3, "position").withColumn("position", F.col("position") - 1)
    return R.rescored(hits, [0.1, 0.9], 3).select("o_orderkey")


@query("g29_no_knowledge", f"SELECT min({DIST}) > 0.75 AS none FROM {VEC}")
def g29(spark, d):
    best = K.nearest(table(spark, d, "embeddings"), "embedding", QUERY, 1, "vec_id")
    return best.agg((F.min("dist") > 0.75).alias("none"))


@query("g30_alignment_sort", f"SELECT p_partkey, coalesce(1 - dist, 0.0) AS score FROM part LEFT JOIN (SELECT vec_id, {DIST} AS dist FROM {VEC}) ON vec_id = p_partkey ORDER BY score DESC, p_partkey LIMIT 30")
def g30(spark, d):
    score = K.nearest(table(spark, d, "embeddings"), "embedding", QUERY, 1 << 30, "vec_id").select(F.col("vec_id").alias("p_partkey"), (1 - F.col("dist")).alias("score"))
    out = table(spark, d, "part").select("p_partkey").join(score, "p_partkey", "left").select("p_partkey", F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.orderBy(F.col("score").desc(), "p_partkey").limit(30)


@query("g31_recommendation_inputs", "SELECT * FROM (SELECT event_id AS id, 'viewed' AS kind FROM events WHERE user_id = 8 AND event_type = 'view' ORDER BY event_id DESC LIMIT 50) UNION ALL SELECT * FROM (SELECT event_id, 'bought' FROM events WHERE user_id = 8 AND event_type = 'purchase') UNION ALL SELECT * FROM (SELECT doc_id, 'new' FROM documents ORDER BY doc_id DESC LIMIT 100)")
def g31(spark, d):
    own = table(spark, d, "events").where("user_id = 8")
    viewed = own.where("event_type = 'view'").orderBy(F.col("event_id").desc()).limit(50).select(F.col("event_id").alias("id"), F.lit("viewed").alias("kind"))
    bought = own.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.lit("bought").alias("kind"))
    new = table(spark, d, "documents").orderBy(F.col("doc_id").desc()).limit(100).select(F.col("doc_id").alias("id"), F.lit("new").alias("kind"))
    return viewed.unionByName(bought).unionByName(new)


@query("g32_gap_detection", "SELECT source, count(*) FILTER (WHERE contains(text, 'license') OR contains(text, 'License')) AS a, count(*) FILTER (WHERE contains(text, ' of ')) AS b FROM documents GROUP BY 1 HAVING count(*) FILTER (WHERE contains(text, 'license') OR contains(text, 'License')) < 3")
def g32(spark, d):
    from gristmill.operators.predicates import any_keyword

    n = table(spark, d, "documents").groupBy("source").agg(F.count_if(any_keyword("text", ["license", "License"])).alias("a"), F.count_if(any_keyword("text", [" of "])).alias("b"))
    return n.where("a < 3")
