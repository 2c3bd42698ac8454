"""The queries opN_<name> over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontaminate, disclosure, html, lattice, licenses, merkle, minhash, mixing, pipeline, quality, sharding, spelling, substrings, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_h")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.report(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_shard": op3_shard,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_score": op5_lm_score,
    "op6_warc": op6_warc,
    "op7_html_text": op7_html_text,
    "op8_license_scan": op8_license_scan,
    "op9_mix": op9_mix,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling": op11_spelling,
    "op12_disclosure": op12_disclosure,
    "op13_merkle": op13_merkle,
    "pipeline": pipeline.run,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_PLAIN = "list_filter(string_split_regex({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

_DECONTAMINATE = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
     win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item, w, least(len(w), {decontaminate.WIDTH}) AS n, unnest(range(1, len(w) - least(len(w), {decontaminate.WIDTH}) + 2)) AS i FROM b WHERE len(w) > 0)),
     d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
     sizes AS (SELECT DISTINCT n FROM win),
     pos AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
     hit AS (SELECT pos.doc_id, pos.n, i, item FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n),
     cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
     items AS (SELECT doc_id, count(*) AS n_items, sha256(array_to_string(list_sort(list(item)), ',')) AS h FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND coalesce(n_hit, 0) * {decontaminate.SHARE_OF} >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN items USING (doc_id)"""

_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format(t=_LOWER)} AS w FROM documents),
     sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {minhash.WIDTH - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {minhash.WIDTH - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
     link AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
     both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
     reach(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.id WHERE r.root < e.b),
     best AS (SELECT id, min(root) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept FROM d JOIN best ON best.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_NORM = "lower(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g')))"

_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce('h' || source, 'n') AS host, coalesce(text, '') AS t, {_PLAIN.format(t="coalesce(text, '')")} AS w FROM documents),
     tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
     rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY 1),
     lines AS (SELECT doc_id, host, {_NORM} AS x FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d)),
     ln AS (SELECT doc_id, host, x, len(string_split(x, ' ')) AS n FROM lines WHERE x <> ''),
     often AS (SELECT host, x, min(doc_id) AS first FROM ln GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > {quality.LINE_DOCS}),
     cut AS (SELECT ln.doc_id, sum(n)::BIGINT AS removed FROM ln JOIN often o ON o.host = ln.host AND o.x = ln.x AND o.first <> ln.doc_id GROUP BY 1),
     base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                     (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
                     coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS n_removed_words
              FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {quality.MIN_WORDS} OR n_words - n_removed_words < n_words * {quality.LEFT_SHARE})) AS kept, n_removed_words
FROM base"""

_NOTICES = ", ".join(f"('{label}', {sorted(set(licenses._words(t)))}, {g or 'CAST([] AS VARCHAR[][])'}, {-int(-len(licenses._words(t)) / licenses.THRESHOLD // 1)})" for (label, t), g in zip(licenses.TEMPLATES, licenses.guards(), strict=True))

_LICENSES = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t, {_ALNUM} AS w FROM documents),
     ph AS (SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), (VALUES {", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES)}) p(words, label) WHERE w[i] = words[1] AND w[i : i + len(words) - 1] = words),
     base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS l FROM ph GROUP BY 1),
     n(label, words, guards, width) AS (VALUES {_NOTICES}),
     ln AS (SELECT doc_id, list_filter(string_split_regex(x, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda y: y <> '') AS s FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)),
     near AS (SELECT d.doc_id, w, n.* FROM d, n WHERE len(list_intersect(w, words)) >= ceil({licenses.THRESHOLD} * len(words))),
     bl AS (SELECT doc_id, s, n.* FROM ln, n UNION ALL SELECT doc_id, w[i : i + width - 1], label, words, guards, width FROM (SELECT *, unnest(range(1, greatest(len(w) - width + 1, 1) + 1)) AS i FROM near)),
     hit AS (SELECT doc_id, label, len(list_intersect(s, words)) / len(words) AS c FROM bl WHERE len(list_intersect(s, words)) >= ceil({licenses.THRESHOLD} * len(words)) AND len(list_filter(guards, lambda g: list_has_all(s, g))) = 0),
     more AS (SELECT doc_id, list(DISTINCT label) AS l, max(c) AS best FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(more.l, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN greatest(coalesce(best, 0.0), {licenses.PHRASE_SCORE}) ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""

#: crc32 by its polynomial over a list of bytes: entry b of the table, then one step a byte.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))))"


def _crc(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_UTF8 = "flatten(list_transform(string_split({x}, ''), lambda y: CASE WHEN unicode(y) < 128 THEN [unicode(y)::BIGINT] ELSE [192 | (unicode(y) >> 6), 128 | (unicode(y) & 63)]::BIGINT[] END))"

_SPELLING = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
     runs AS (SELECT id, x, count(*) AS m FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents) WHERE length(x) >= {spelling.MIN_LETTERS} GROUP BY 1, 2),
     hashed AS (SELECT x, m, {_crc(_UTF8.format(x="id || ':' || x"))} AS h FROM runs, crc),
     words AS (SELECT w, sum(m)::BIGINT AS n FROM (SELECT CASE WHEN h % {spelling.MISTYPED} = 0 THEN x[1 : h % length(x)] || x[h % length(x) + 2 :] ELSE x END AS w, m FROM hashed) WHERE length(w) >= {spelling.MIN_LETTERS} GROUP BY 1 HAVING sum(m) >= {spelling.MIN_COUNT}),
     less AS (SELECT w, n, i, w[1 : i - 1] || w[i + 1 :] AS d FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
     half AS (SELECT DISTINCT a.w AS a, b.w AS b FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.w <> b.w AND length(a.w) = length(b.w) UNION SELECT l.w, v.w FROM less l JOIN words v ON v.w = l.d UNION SELECT v.w, l.w FROM less l JOIN words v ON v.w = l.d),
     near AS (SELECT a, b, v.n FROM half JOIN words v ON v.w = b),
     best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM near GROUP BY 1),
     f AS (SELECT w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {spelling.RATIO} * words.n THEN form END AS form, CASE WHEN form_n >= {spelling.RATIO} * words.n THEN form_n END AS form_n FROM words LEFT JOIN best ON a = w),
     walk(w, pos) AS (SELECT w, w FROM f UNION ALL SELECT walk.w, f.form FROM walk JOIN f ON f.w = walk.pos WHERE f.form IS NOT NULL),
     ends AS (SELECT walk.w, pos FROM walk JOIN f ON f.w = pos WHERE f.form IS NULL)
SELECT f.w AS word, form, pos AS root, n, n_near, form_n FROM f JOIN ends ON ends.w = f.w"""

_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"


def _merkle(deep: int = 7) -> str:
    """Trees of up to FAN ** deep leaves, level by level."""
    fan = merkle.FAN
    head = " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))
    steps = [f"""crc AS (SELECT {_CRC_TABLE} AS t),
     lf AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (SELECT doc_id, coalesce('s' || source, 'n') AS k, sha256({head} || {_FIELD.format(c="text")}) AS leaf,
            CASE WHEN {_crc(_UTF8.format(x="doc_id::VARCHAR"))} % 5 = 0 THEN sha256({head} || {_FIELD.format(c=_LOWER.replace("coalesce(text, '')", "text"))}) END AS other FROM documents, crc))"""]

    def tree(p: str, first: str, ids: str) -> None:
        steps.append(f"{p}0 AS ({first})")
        for j in range(deep):
            steps.append(f"{p}r{j} AS (SELECT k, pos // {fan} AS run, list(h ORDER BY pos) AS hs FROM {p}{j} WHERE m > 1 GROUP BY 1, 2)")
            steps.append(f"{p}{j + 1} AS (SELECT k, run AS pos, sha256(array_to_string(hs, '')) AS h, count(*) OVER (PARTITION BY k) AS m FROM {p}r{j} UNION ALL SELECT * FROM {p}{j} WHERE m = 1)")
        steps.append(f"{p}f0 AS ({ids})")
        for j in range(deep):
            own = f"(f.pos // {fan**j}) % {fan} + 1"
            steps.append(f"{p}f{j + 1} AS (SELECT f.* REPLACE (CASE WHEN hs IS NULL THEN now ELSE sha256(array_to_string(list_transform(hs, lambda x, i: CASE WHEN i = {own} THEN now ELSE x END), '')) END AS now, CASE WHEN hs IS NULL THEN beside ELSE beside || array_to_string(list_filter(hs, lambda x, i: i <> {own}), '') END AS beside) FROM {p}f{j} f LEFT JOIN {p}r{j} r ON r.k = f.k AND r.run = f.pos // {fan ** (j + 1)})")

    tree("s", "SELECT k, pos, leaf AS h, count(*) OVER (PARTITION BY k) AS m FROM lf", "SELECT *, coalesce(other, leaf) AS now, '' AS beside FROM lf")
    steps.append(f"tops AS (SELECT k AS source, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, '' AS k FROM s{deep})")
    tree("t", "SELECT k, pos, subroot AS h, count(*) OVER () AS m FROM tops", f"SELECT doc_id, leaf, subroot, now, beside, t.pos, t.k FROM sf{deep} s JOIN tops t ON t.source = s.k")
    return f"WITH {', '.join(steps)}\nSELECT doc_id, leaf, subroot, t{deep}.h AS root, sha256(beside) AS proof_sha256, now AS folded_root, now = t{deep}.h AS verified FROM tf{deep}, t{deep}"


#: The others have no SQL: hash orders, lattices, archives, page trees and byte strings are tested against plain Python.
ORACLES: dict[str, str] = {"op1_decontaminate": _DECONTAMINATE, "op2_minhash_dedup": _NEAR, "op4_quality_rules": _QUALITY, "op8_license_scan": _LICENSES, "op11_spelling": _SPELLING, "op13_merkle": _merkle()}
