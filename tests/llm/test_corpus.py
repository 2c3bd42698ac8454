"""Corpus operators against plain Python: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gristmill.llm import decontaminate, html, lattice, licenses, minhash, mixing, quality, sharding, substrings, warc
from gristmill.llm import blocks, common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, size string, text_crc32 string"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Émile", "ÉCOLE", "straße", "中文", "😀x"]
    long = " ".join(rng.choice(words) for _ in range(6000))
    base = " ".join(rng.choice(words) for _ in range(120)).split()
    texts = [None, "", " \n\t", "one two", long, long, " ".join(base), " ".join(base), "Licensed under the MIT License.\nApache License\nreleased under the mit license"]
    for i in range(12):
        near = list(base)
        for _ in range(i):
            near[rng.randrange(120)] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    texts += ["\n".join(["shared line of boilerplate here"] + [" ".join(rng.choice(words) for _ in range(3))] * 2) for _ in range(10)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", 1, "k", "9", "c") for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "null key text with some words in it " * 9, "en", "s1", 1, "k", "9", "c")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


@pytest.mark.parametrize("fits", [True, False])
def test_decontamination(spark, docs, rows, empty, monkeypatch, fits):
    if not fits:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    item = " ".join(rows[6][1].split()[10:40])
    bench = [(1, item), (2, "one two"), (3, None), (4, "!!"), (None, "w1 w2"), (12, item)]
    table = spark.createDataFrame(bench, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in bench:
        w = word.findall(ascii_lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    want = collections.Counter()
    for r in rows:
        w = word.findall(ascii_lower(r[1]))
        hit, items = set(), set()
        for win, ids in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= ids
        want[(r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    out = decontaminate.report(docs, table).drop("_h")
    assert collections.Counter(map(tuple, out.collect())) == want
    clean = decontaminate.remove_documents(docs, table)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[5])
    spans = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, table).collect()}
    assert spans[3] == "" and spans[0] is None and item.split()[0] not in spans[6].split()[10:11]
    assert decontaminate.report(empty, table).count() == 0 and not decontaminate.report(docs, table.limit(0)).where("n_hit > 0").count()


def test_near_duplicates(docs, rows, empty):
    sets = {}
    for r in rows:
        w = ascii_lower(r[1]).split()
        sets[r[0]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    ids = sorted(k for k in sets if k is not None)
    root = {k: k for k in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = root.get(r.doc_id)
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want, r.doc_id is None or want == r.doc_id)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in ids if root[k] == k} | {None}
    assert minhash.near_duplicates(empty).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A family of near copies, of which many are linked only through others, in blocks of a few texts."""
    monkeypatch.setattr(minhash, "LARGE", 3)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"n{rng.randrange(40)}"
        texts.append((i, " ".join(w)))
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for _, t in texts]
    root = list(range(60))
    for a in range(60):
        for b in range(a + 1, 60):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if v == y else v for v in root]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(60)] == root


def test_sharding(docs, rows, empty):
    got = sharding.shard(docs, 5).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = collections.defaultdict(list)
    load = collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 2 * max(len((r[1] or "").encode()) + 8 for r in rows)
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("literals", [4096, 3])
def test_cuts_against_plain_python(spark, monkeypatch, literals):
    """Every row's shard: large units dealt first, the byte line of the others cut; one text overfills shards."""
    monkeypatch.setattr(sharding, "OVERFULL", 10**9)
    monkeypatch.setattr(sharding, "LITERALS", literals)
    monkeypatch.setattr(sharding, "HEAVY", 20)
    monkeypatch.setattr(sharding, "PART_ROWS", 100)
    rng = random.Random(3)
    texts = [("t%d " % rng.randrange(400)) * rng.randrange(1, 6) for _ in range(3000)] + ["copy " * 40] * 900 + ["few " * 30] * 60 + [None, ""]
    rows = list(enumerate(texts))
    n = 7
    units = collections.defaultdict(list)
    for i, t in rows:
        b = (t or "").encode()
        h = xxhash.xxh64_intdigest(b, 42)
        units[zlib.crc32(b), h - (1 << 64) if h >= 1 << 63 else h].append((i, len(b) + 8))
    total = sum(z for v in units.values() for _, z in v)
    large = {k: v for k, v in units.items() if sum(z for _, z in v) > total // (n * 20)}
    load, want = [0] * n, {}
    pieces = []
    for k, v in large.items():
        size = sum(z for _, z in v)
        parts = -(-size * 4 * n // total) if size * n > total and len(v) > 1 else 1
        pieces += [(k, v, sum(1 for j in range(len(v)) if j * parts // len(v) == p) * v[0][1]) for p in range(parts)]
    pieces.sort(key=lambda p: -p[2])
    for k, v, size in pieces:
        s = load.index(min(load))
        load[s] += size
    line, room = 0, [max(0.0, total / n - b) for b in load]
    rest = total - sum(z for v in large.values() for _, z in v)
    for k in sorted(set(units) - set(large)):
        size = sum(z for _, z in units[k])
        middle = line + size / 2
        s = sum(1 for q in range(n - 1) if rest * sum(room[: q + 1]) / sum(room) <= middle)
        want.update({i: s for i, _ in units[k]})
        load[s] += size
        line += size
    got = {r.doc_id: r for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n).collect()}
    assert {i: got[i].shard for i in want} == want
    sums = collections.Counter()
    for r in got.values():
        sums[r.shard] += r.size
    assert [sums[s] for s in range(n)] == load
    copies = [got[i].shard for k, v in large.items() if len(v) == 900 for i, _ in v]
    assert len(set(copies)) > 1 and all(len({got[i].shard for i, _ in v}) == 1 for v in units.values() if len(v) != 900)
    assert sorted((r.shard, r.slot) for r in got.values()) == [(s, k) for s in range(n) for k in range(sum(r.shard == s for r in got.values()))]


def quality_of(rows, limit):
    """(n_removed_words, kept, text) of each row (id, text, host) by plain Python: distinct documents per host, all but the first cut."""
    squeeze = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    held = collections.defaultdict(set)
    for i, t, host in rows:
        for x in (t or "").split("\n"):
            if squeeze(x):
                held[host, squeeze(x)].add(("t", t) if i is None else i)
    out = []
    for i, t, host in rows:
        lines = (t or "").split("\n")
        first = lambda ids: min((k for k in ids if isinstance(k, int)), default=None)
        gone = [bool(squeeze(x)) and len(held[host, squeeze(x)]) > limit and (i is None or first(held[host, squeeze(x)]) != i) for x in lines]
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        removed = sum(len(squeeze(x).split(" ")) for x, g in zip(lines, gone, strict=True) if g)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w) or removed > 0 and (len(w) - removed < 50 or len(w) - removed < 0.3 * len(w))
        out.append((removed, not bad, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if any(gone) else t))
    return out


def test_quality(docs, rows, empty, spark):
    for r in quality.judge(docs).collect():
        text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns


@pytest.mark.parametrize("fits", [True, False])
def test_frequent_lines(spark, monkeypatch, fits):
    """A line of many documents of a large host but under a tenth of them, copies, null and repeated keys, by broadcast and by shuffle."""
    if not fits:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    notice = " ".join(f"notice{j}" for j in range(60))
    own = lambda i, n: " ".join(f"d{i}w{j}" for j in range(n))
    rows = [(i, f"{notice}\n{own(i, 5 if i < 5 else 100)}", "h") for i in range(3, 33)]
    rows += [(i, own(i, 60), "h") for i in range(100, 500)]  # the notice is in 30 of 430 documents
    rows += [(i, f"{own('copy', 70)}\n \n{own('copy', 9)}", "g") for i in range(600, 640)]  # copies: one is left
    rows += [(i, f"  NOTICE0\t{notice[8:]}\n\n{own(i, 60)}\n{notice}", None) for i in range(700, 711)] + [(700, "x\n" + own(1, 70), None), (711, None, None), (712, "", "h")]
    rows += [(None, f"{notice}\n{own('n', 70)}", None)] * 3 + [rows[0], (800, notice, "rare"), *[(900, notice, "rare")] * 20]
    table = spark.createDataFrame([(*r, "k", 3) for r in rows], "doc_id long, text string, source string, _key string, n_chars int").repartition(3)
    want = quality_of(rows, quality.LINE_DOCS)
    got = quality.judge(table).collect()
    assert sorted((r.doc_id or -1, r.n_removed_words, r.kept) for r in got) == sorted((r[0] or -1, w[0], w[1]) for r, w in zip(rows, want, strict=True))
    assert any(w[0] and w[1] for w in want) and any(not w[1] and w[0] == 60 for w in want) and sum(w[1] for r, w in zip(rows, want, strict=True) if r[2] == "g") == 1
    left = quality.keep_good(table, size="n_chars")
    assert left.columns == table.columns
    assert sorted(((r.doc_id or -1, r.text, r.n_chars) for r in left.collect()), key=str) == sorted(((r[0] or -1, w[2], 3 if w[2] == r[1] else len(w[2])) for r, w in zip(rows, want, strict=True) if w[1]), key=str)


def test_language_model(docs, rows, empty):
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts = collections.Counter()
    for r in rows:
        if not held(r[0]):
            counts.update([*(r[1] or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    got = lattice.score(docs, frequent=50).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens = [*(next(x[1] for x in rows if x[0] == r.doc_id) or "").encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[t] > 0 for t in tokens), total, held(r.doc_id))
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens), rel_tol=1e-9) and r.score < 0
    assert lattice.score(empty).count() == 0


def test_lattice_sums_all_segmentations():
    texts, weights = lattice.read_pieces()
    pieces, known = lattice.Pieces(texts, weights), dict(zip(texts, weights, strict=True))
    for word in (b"the", b"thenation", b"x", "éÿ中".encode(), b"a" * 70):
        s = b" " + word
        sums = [1.0] + [0.0] * len(s)
        for j in range(1, len(s) + 1):
            sums[j] = sum(sums[i] * known.get(s[i:j], 0.0) for i in range(j))
        data = np.frombuffer(word, np.uint8)
        assert math.isclose(lattice.word_log10(pieces, data, np.array([0]), np.array([len(word)]))[0], math.log10(sums[-1]), rel_tol=1e-9)
        uses = lattice.expected_pieces(pieces, data, np.array([0]), np.array([len(word)]), np.array([2]))
        assert math.isclose(sum(n * len(t) for n, t in zip(uses, texts, strict=True)), 2 * len(s), rel_tol=1e-9)


def test_long_words_cost_in_proportion():
    """Words that few others are as long as are walked edge by edge, with the same sums as in blocks."""
    texts, weights = lattice.read_pieces()
    pieces = lattice.Pieces(texts, weights)
    rng = random.Random(8)
    word = bytes(rng.choice(b"etaoinshrdlu") for _ in range(60))
    data = np.frombuffer(word * 9, np.uint8)
    many = lattice.word_log10(pieces, data, np.arange(9) * 60, np.arange(9) * 60 + 60)
    assert np.allclose(many, lattice.word_log10(pieces, data, np.array([0]), np.array([60])), rtol=1e-12)
    one = lattice.expected_pieces(pieces, data, np.array([0]), np.array([60]), np.array([9]))
    assert np.allclose(one, lattice.expected_pieces(pieces, data, np.arange(9) * 60, np.arange(9) * 60 + 60, np.ones(9)), rtol=1e-9)
    long = np.frombuffer(bytes(rng.choice(b"abcdefghij+/=") for _ in range(300_000)), np.uint8)
    began = time.perf_counter()
    assert np.isfinite(lattice.word_log10(pieces, long, np.array([0]), np.array([len(long)]))).all()
    assert time.perf_counter() - began < 30


def test_archives(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(i, "u", "x" * (i * 37 % 900) + inner * (i % 5) + "WARC/1." + "y" * (i % 7)) for i in range(150)] + [(None, None, None), (1000, None, None), (1001, "a\r\nb", ""), (1002, "c", "x")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        to = first[h or ""] if i is not None and first[h or ""] != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("split", "long", "count"), [("300", 200, 8), ("40000", 70_000, 12), ("100000000", 70_000, 12)])
def test_archives_with_the_magic_in_urls(spark, tmp_path, split, long, count):
    """Headers that their URL cuts into several pieces or makes longer than 64 KiB, inside a split and over splits."""
    urls = [("http://x/WARC/1.1/", "http://x/" + "u" * long, "http://x/WARC/1.\u00e9WARC/1.0/" + "WARC/1." * 60, "http://x/plain")[i % 4] + str(i) for i in range(count)]
    pages = [(i, u, "z" * (i * 37 % 500) + "WARC/1.1\r\n" * (i % 3)) for i, u in enumerate(urls)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = str(tmp_path / "archive")
        warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
        got = {r.uri: bytes(r.payload).decode() for r in warc.read_archive(spark, path).collect()}
        assert got == {u: h for _, u, h in pages}
        (part,) = (tmp_path / "archive").glob("part-*")
        (tmp_path / "cut").mkdir()
        (tmp_path / "cut" / "x.txt").write_bytes(part.read_bytes()[:-9])
        with pytest.raises(Exception, match="no whole record"):
            warc.read_archive(spark, str(tmp_path / "cut")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_archives_with_repeated_ids_and_one_hot_payload(spark, monkeypatch):
    """Payloads of rows that share an id stay apart; a payload of most rows; tables of splits that are joined by shuffling."""
    pages = [(1, "u", "A"), (2, "u", "A"), (2, "u", "B"), (3, "u", "B"), (3, "u", "B"), (2, "v", "B"), (1, "u", "A")] + [(i, "u", "hot" if i % 3 else f"p{i}") for i in range(10, 300)]
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h, i)
    want = sorted((i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if first[h] != i else "response", first[h] if first[h] != i else None) for i, _, h in pages)
    table = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        for rows in (None, 0):
            if rows is not None:
                monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
            assert sorted(map(tuple, warc.round_trip(table).collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_main_text(spark):
    page = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header class="site"><p>Site header</p></header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="sidebar"><p>Side, note, here.</p></div><article><h1>A &amp; B</h1><p>First, long paragraph of the article; it has marks,  and   words.<p>Second one, with <b>bold</b>&nbsp;text, too.
    <ul><li>item one, ok<li>item two</ul><form><p>Your mail, please</p></form></article><div id="comments"><p>Great, really great, article!</p></div><footer>&copy; me</footer></body></html>"""
    want = "A & B\nFirst, long paragraph of the article; it has marks, and words.\nSecond one, with bold text, too.\nitem one, ok\nitem two"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>x < y, \"quoted' </p"), (5, "z", "<div" * 3000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(rows).collect()}
    assert got[1].text == want and got[1].n_chars == len(want) and (got[2].text, got[3].text) == ("", "") and got[None].text
    assert html.extract(rows.limit(0)).count() == 0


LONG = "A long paragraph of the text, with commas, stops and many words; it goes on for a while, as such paragraphs do. " * 4


@pytest.mark.parametrize(("page", "want"), [
    (f"<article><h1>Title</h1><div class=body><p>{LONG}<p>{LONG}</div></article>", ["Title", LONG, LONG]),
    (f"<div class=post><header><h1>Title</h1></header><div class=entry-content><p>{LONG}<p>{LONG}</div></div>", ["Title", LONG, LONG]),
    (f"<div id=page><header><p>My site</p></header><div class=post><h1>Title</h1><div class=entry-content><p>{LONG}<p>{LONG}</div></div><div class=sidebar><p>Aside</div></div>", ["Title", LONG, LONG]),
    (f"<h1>Title</h1><div class=body><p>{LONG}<p>{LONG}</div><footer>me</footer>", ["Title", LONG, LONG]),
    (f"<div><section><h2>One</h2><p>{LONG}<p>{LONG}</section><section><h2>Two</h2><p>Short.</section></div><nav>Menu</nav>", ["One", LONG, LONG, "Two", "Short."]),
    (f"<article><p>{LONG}<p>{LONG}<h2>Further reading</h2><ul><li><a href=a>Book one</a><li><a href=b>Book two</a></ul></article>", [LONG, LONG, "Further reading", "Book one", "Book two"]),
    (f"<div class='with-sidebar'><article><h1>Title</h1><p>{LONG}</article><div class=sidebar><p>Aside</div></div>", ["Title", LONG]),
    (f"<div class='has-ads'><main><p>{LONG}</main></div><div class=comments><p>{LONG}<p>{LONG}</div>", [LONG]),
    (f"<form id=aspnetForm><div class='no-sidebar'><h1>Title</h1><p>{LONG}</div></form><nav>Menu</nav>", ["Title", LONG]),
    (f"<article><p>{LONG}</article><div id=comments><p>{LONG}<p>{LONG}</div>", [LONG]),
])
def test_main_text_keeps_the_whole_article(page, want):
    assert html.main_text(f"<html><body>{page}</body></html>").split("\n") == [" ".join(w.split()) for w in want]


def test_path_ratios_against_plain_python():
    """Each run's weight is made of its path's mean text and punctuation, smoothed over its neighbours."""
    page = f"<html><body><nav><p>Menu, menu</p></nav><div><h1>Title</h1><p>{LONG}</p><p>Short, one.</p><ul><li><a href=x>Linked, item</a></li><li>Plain item.</li></ul></div><div><p>More; of it!</p></div></body></html>"
    found = html.runs(page)
    paths = ["/".join(p.tag for p in reversed(list(part.line()))) for _, part, _ in found]
    assert paths == ["/html/body/nav/p", "/html/body/div/h1", "/html/body/div/p", "/html/body/div/p", "/html/body/div/ul/li", "/html/body/div/ul/li", "/html/body/div/p"]
    mean = []
    for path in paths:
        of = [(len(text) - 2 * linked, sum(c in ",.;:!?" for c in text)) for (text, _, linked), p in zip(found, paths, strict=True) if p == path]
        mean.append((0, 0) if "nav" in path else (sum(max(0, n) for n, _ in of) / len(of), sum(c for _, c in of) / len(of)))
    for i, (w, path) in enumerate(zip(html.weights(found), paths, strict=True)):
        near = [mean[max(i - 1, 0)], mean[i], mean[i], mean[min(i + 1, len(mean) - 1)]]
        assert w == pytest.approx(0 if "nav" in path else sum(n for n, _ in near) / 4 * (1 + sum(c for _, c in near) / 4))


def test_main_text_with_opaque_names_and_deep_nesting():
    long = " ".join(LONG.split())
    page = f"<div class=x1>We use cookies.</div><div class=x2><h1>Title</h1><p>{LONG}<p>{LONG}</div><div class=x3><div class=x4>Nice post, thanks.</div><div class=x4>First!</div></div>"
    assert html.main_text(page) == f"Title\n{long}\n{long}"
    for name in ("content left-side", "share-price report", "story notice"):
        assert html.main_text(f"<nav>Menu</nav><div class='{name}'><h1>Title</h1><p>{LONG}</div><footer>me</footer>") == f"Title\n{long}"
    start = time.perf_counter()
    assert html.main_text("<div class=a>" * 40000 + f"<p>{LONG}" * 3 + "</div>" * 40000) == "\n".join([long] * 3)
    assert html.main_text("<b><div>" * 20000 + f"<p>{LONG}" + "</b>" * 20000) == long
    assert time.perf_counter() - start < 30


def other_license(label, whole, block):
    """Whether the block holds a notice of another label that has all words of this one."""
    return any(name != label and whole < set(licenses._words(t)) and set(licenses._words(t)) - whole <= set(block) for name, t in licenses.TEMPLATES)


def test_the_stricter_license_wins(spark):
    texts = ["Licensed under CC BY-NC 4.0", "Licensed under\nCC BY-NC\n4.0", "Licensed under CC BY 4.0", "Licensed under CC BY 4.0. " + "x " * 9 + "Licensed under CC BY-SA 4.0", "Licensed under CC BY 4.0\n" + "x " * 9 + "\nLicensed under CC BY-NC 4.0"]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "cc-by,cc-by-nc-4.0", 1: "cc-by,cc-by-nc-4.0", 2: "cc-by,cc-by-4.0", 3: "cc-by,cc-by-4.0,cc-by-sa-4.0", 4: "cc-by,cc-by-4.0,cc-by-nc-4.0"}


def test_licenses(docs, rows, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.scan(docs).collect():
        text = ascii_lower(next(x[1] for x in rows if x[0] == r.doc_id))
        w, places, base, more, best = word.findall(text), [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    base.add(label)
        for line in text.split("\n"):
            for label, t in licenses.TEMPLATES:
                whole = set(licenses._words(t))
                share = len(whole & set(word.findall(line))) / len(whole)
                if share >= licenses.THRESHOLD and not other_license(label, whole, word.findall(line)):
                    more.add(label)
                    best = max(best, share)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels, r.score) == (",".join(sorted(base)), ",".join(sorted(base | more)), max(best, licenses.PHRASE_SCORE) if places else best)
    assert licenses.scan(empty).count() == 0


def test_wrapped_licenses(spark):
    """Notices over several lines, behind comment signs, with a word more or less, against all runs of words."""
    wrap = lambda t, n, sign="": "\n".join(sign + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    texts = [wrap(t, n, sign) for _, t in licenses.TEMPLATES for n, sign in ((2, ""), (11, " * "), (5, "# "))]
    mit = licenses.TEMPLATES[6][1]
    texts += ["word " * 90 + "\n" + wrap(mit, 12) + "\n" + "word " * 90, wrap(mit.replace("charge", ""), 12), wrap(mit.replace(" and ", " x y z q v u t s r p o n and "), 12), "Released\nunder the a b c MIT\nLicense", "x", None]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        text, more, best = ascii_lower(text), set(), 0.0
        for label, t in licenses.TEMPLATES:
            whole, w = set(licenses._words(t)), word.findall(text)
            n = math.ceil(len(licenses._words(t)) / licenses.THRESHOLD)
            for block in [word.findall(line) for line in text.split("\n")] + [w[k : k + n] for k in range(max(len(w) - n + 1, 1))]:
                share = len(whole & set(block)) / len(whole)
                if share >= licenses.THRESHOLD and not other_license(label, whole, block):
                    more.add(label)
                    best = max(best, share)
        assert set(got[i].labels.split(",")) - {""} == more | set(got[i].base_labels.split(",")) - {""}
        assert got[i].score == max(best, licenses.PHRASE_SCORE if got[i].n_base else 0.0)
    assert all(licenses.TEMPLATES[i // 3][0] in got[i].labels.split(",") and got[i].score == 1 for i in range(30)) and got[30].labels == "mit" and got[33].score == licenses.PHRASE_SCORE


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert got and sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, mixing.mix(docs.repartition(2)).collect())))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: rate * weight[s] for s in free}
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    most = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= 2 * most for s in names)
    assert mixing.take(docs).columns == docs.columns and mixing.mix(empty).count() == 0


def cut_by_hand(rows):
    """(n_bytes, n_removed, n_spans, sha256, bytes) of each row (id, text): strings of smaller ids, any row of theirs."""
    least = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49 if k is not None else 0):
            least[b[i : i + 50]] = min(k, least.get(b[i : i + 50], k))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49 if k is not None else 0):
            if least[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone[:-1], strict=True)) if b else 0, hashlib.sha256(left).hexdigest(), left))
    return out


def test_repeated_substrings(docs, rows, empty):
    want = cut_by_hand([(r[0], r[1]) for r in rows])
    got = substrings.report(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *w[:4])) for r, w in zip(rows, want, strict=True))
    kept = substrings.remove_repeats(docs)
    assert kept.columns == [*docs.columns, "kept_bytes"]
    assert sorted((str(r.doc_id), bytes(r.kept_bytes)) for r in kept.collect()) == sorted((str(r[0]), w[4]) for r, w in zip(rows, want, strict=True))
    assert substrings.report(empty).count() == 0


@pytest.mark.parametrize("case", ["plain", "hot", "collisions", "shuffled"])
def test_repeated_ids_and_a_phrase_in_many_documents(spark, monkeypatch, case):
    """Ids with several texts, a phrase in one document of ten with other surroundings each time, hot keys, hashes that lie."""
    if case == "hot":
        monkeypatch.setattr(substrings, "HOT_ROWS", 8)
        monkeypatch.setattr(substrings, "HOT_KEYS", 100_000)
        monkeypatch.setattr(substrings, "SAMPLE", 1)
    if case == "collisions":  # settled by a hash of few bits: the comparison of bytes must find it out
        real = blocks.mix
        monkeypatch.setattr(substrings.blocks, "mix", lambda x: real(x) & np.uint64(0xFFFFFFFFFF00000F))
        monkeypatch.setattr(substrings, "_narrow", lambda x, size, f=substrings._narrow: f(x & np.uint64(1) if size == 5 else x, size))
    if case == "shuffled":
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, other = noise(90), noise(60)
    rows = [(i, noise(rng.randrange(0, 300)) + (phrase if i % 10 == 0 else "") + noise(rng.randrange(0, 40)) + (other[: 40 + i % 21] if i % 4 == 0 else "")) for i in range(300)]
    rows += [(7, noise(200) + phrase), (7, noise(90)), (7, rows[3][1]), (0, noise(60) + phrase), (0, noise(10)), (300, rows[20][1]), (300, rows[20][1]), (-4, phrase[5:] + "x"), (None, phrase), (301, None), (302, noise(49)), (1 << 60, rows[11][1] + rows[12][1])]
    rows += [(k, t[:-1] + "z") for k, t in ((400, rows[20][1]), (401, rows[30][1]), (402, rows[30][1]))]
    want = cut_by_hand(rows)
    got = substrings.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *w[:4])) for r, w in zip(rows, want, strict=True))


def test_suffix_order_equals_sorting():
    rng = random.Random(4)
    data = np.array([rng.randrange(97, 99) for _ in range(4000)], np.uint8)
    starts = np.array(sorted(rng.sample(range(3900), 700)))
    sizes = np.array([rng.randrange(1, 60) for _ in starts])
    segment = np.sort(np.array([rng.randrange(0, 40) for _ in starts]))
    order, common = substrings.suffix_order(data, starts, sizes, segment)
    text = data.tobytes()
    key = lambda i: (segment[i], text[starts[i] : starts[i] + sizes[i]])
    assert [key(i) for i in order] == sorted(map(key, range(len(starts))))
    for p, i in enumerate(order[1:], 1):
        a, b = key(order[p - 1]), key(i)
        n = 0
        while a[0] == b[0] and n < min(len(a[1]), len(b[1])) and a[1][n] == b[1][n]:
            n += 1
        assert common[p] == n


def test_every_repeated_window_has_an_anchor():
    rng = random.Random(6)
    data = np.array([rng.randrange(97, 100) for _ in range(3000)], np.uint8)
    places, _, _ = substrings.anchors(data, np.array([0, 1000, 1030, 3000]))
    for start, end in ((0, 1000), (1030, 3000)):
        for s in range(start, end - 49):
            assert ((places >= s) & (places <= s + 18)).any()
    assert blocks.plain_words(np.frombuffer(b"a bc", np.uint8), np.array([0, 0, 1, 4]))[2].tolist() == [0, 0, 1, 2]


def test_anchors_of_pieces_are_those_of_the_block(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (700, 0, 20, 49, 50, 51, 0, 333, 1400)] + ["a" * 300, "ab" * 120, ""]
    for chosen in (texts, ["", ""], [], ["a" * 49], ["", "b" * 50]):
        data = np.frombuffer("".join(chosen).encode(), np.uint8)
        offsets = np.cumsum([0, *map(len, chosen)])
        places, doc, prefix = substrings.anchors(data, offsets)
        first, last = np.maximum(offsets[doc], places - 18), np.minimum(offsets[doc + 1], places + 50)
        want = [places, doc, blocks.span_hash(prefix, places, places + 32), first, last, blocks.span_hash(prefix, first, last)]
        for piece in (1, 31, 64, 1000, 1 << 18):
            monkeypatch.setattr(substrings, "PIECE", piece)
            assert [x.tolist() for x in substrings.marked(data, offsets)] == [x.tolist() for x in want]
            mixed = np.array(rng.sample(places.tolist(), len(places)), np.int64)
            assert (substrings._key_hashes(data, mixed, 32) == blocks.span_hash(prefix, mixed, mixed + 32)).all()


@pytest.mark.parametrize("texts", [1000, 1])
def test_memory_of_a_block_is_bounded(texts):
    """Two blocks of many texts, or one text of two blocks' size."""
    rng = np.random.default_rng(5)
    each = 2 * blocks.BLOCK_BYTES // texts
    batch = pa.RecordBatch.from_arrays([pa.array(range(texts)), pa.array(range(texts)), pa.array([rng.integers(97, 123, each, np.uint8).tobytes().decode() for _ in range(texts)])], ["_id", "_own", "text"])
    blocks.powers(1), blocks.powers(1, True)  # kept for all blocks
    for kernel in (substrings._pack(20, 50, 32, False, np.zeros(0, np.uint64)), substrings._keys(50, 32)):
        tracemalloc.start()
        for _ in kernel(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30 * batch.nbytes


def test_open_anchors_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(substrings, "ROWS", 5)
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrases = [noise(70) for _ in range(4)]
    rows = [(i, noise(rng.randrange(0, 80)) + phrases[i % 4][: 50 + i % 21] + noise(rng.randrange(0, 80)) + phrases[i % 3] + noise(i % 9)) for i in range(120)]
    want = cut_by_hand(rows)
    got = substrings.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r[0], *w[:4])) for r, w in zip(rows, want, strict=True))


def test_pipeline_against_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = docs.columns
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == kinds
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert 0 < docs.select("doc_id").distinct().count() < n and last.count() == docs.count()


PARA = "A long paragraph, with words and commas, that goes on. " * 5


@pytest.mark.parametrize(("page", "kept", "lost"), [
    ("<nav>m</nav><article><h1>T</h1>{a}<section class='related-work'><h2>Related work</h2><p>Also, {p}</p></section></article>", ["Related work", "Also, "], ["m"]),
    ("<div class=c><h1>T</h1>{a}<div class='side-by-side'><p>Also, {p}</p></div></div>", ["T", "Also, "], []),
    ("<div class=c><h1>T</h1>{a}<p class='search-results'>Also, {p}</p></div>", ["T", "Also, "], []),
    ("<div class='hero banner'><h1>Headline</h1></div><div class=c>{a}</div>", ["Headline"], []),
    ("<article><p>Let <math><mi>x</mi></math> be it, {p}</p>{a}</article>", ["Let x be it"], []),
    ("<article>{a}<div class='ad-slot'><p>Buy it, now!</p></div></article>", [], ["Buy it"]),
    ("<article>{a}</article><div class='related'><p>Also, {p}</p></div>", [], ["Also, "]),
    ("<article>{a}</article><div class='cookie-banner'><p>Also, {p}</p></div>", [], ["Also, "]),
    ("<article>{a}<div class='comment-list'><p>Also, {p}{p}{p}</p></div></article>", [], ["Also, "]),
    ("<header class=banner><h1>Site</h1></header><article><h1>Art</h1>{a}</article>", ["Art"], ["Site"]),
])
def test_ratios_decide_doubtful_names(page, kept, lost):
    """Names made of an ambiguous mark and another word leave it to the ratios; plain marks hold; no article text is lost."""
    got = html.main_text(page.format(a=f"<p>{PARA}</p>" * 3, p=PARA)).split("\n")
    assert sum(x == PARA.strip() for x in got) == 3
    assert all(any(x.startswith(k) for x in got) for k in kept) and not any(x.startswith(k) for x in got for k in lost)


def test_pages_with_clashing_columns_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{PARA}</p>", "t", 3, "k")] * 2, "page_id long, url string, html string, text string, n_chars int, _key string")
    assert [(r.page_id, r.text) for r in html.extract(rows).collect()] == [(1, PARA.strip())] * 2


def test_one_outsider_deals_a_large_bucket_once(spark, monkeypatch):
    """A bucket of 1,500 members of one component and one outsider: each member is dealt to one block, the outsider to all."""
    monkeypatch.setattr(minhash, "BLOCK", 100)
    members = spark.createDataFrame([(1, i, 0) for i in range(1500)] + [(1, 5000, 5000)], "band long, _key long, root long")
    rows = minhash._dealt(members).collect()
    assert len(rows) == 1500 + 1 + 15 and sum(r._key == 5000 for r in rows) == 16
    three = spark.createDataFrame([(1, i, i % 3) for i in range(30)], "band long, _key long, root long")
    monkeypatch.setattr(minhash, "BLOCK", 4)
    met = collections.defaultdict(list)
    for r in minhash._dealt(three).collect():
        met[r.i, r.j].append(r)
    pairs = collections.Counter(frozenset((x._key, y._key)) for own in met.values() for x in own for y in own if x._key < y._key and x.root != y.root and (x.left and y.right or x.right and y.left))
    assert pairs == {frozenset((a, b)): 1 for a in range(30) for b in range(a) if a % 3 != b % 3}


def test_rows_without_text_are_a_large_unit(spark, monkeypatch):
    """10,000 empty and null texts, few bytes of all, are parted by rows; shards stay even and slots gapless."""
    monkeypatch.setattr(sharding, "PART_ROWS", 500)
    rows = [(i, None if i % 2 else "", "x") for i in range(10_000)] + [(20_000 + i, f"text {i} " * 4000, "x") for i in range(300)]
    seen = []
    plain = sharding.running

    def running(df, within, ranges, *rest):
        seen.append((within, df.groupBy(*within, *ranges).count().agg({"count": "max"}).first()[0] or 0))
        return plain(df, within, ranges, *rest)

    monkeypatch.setattr(sharding, "running", running)
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string"), 6).collect()
    assert len(got) == len(rows) and all(n <= 800 for within, n in seen if within == ["_unit"]) and max(n for _, n in seen) <= 800
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(load.values()) - min(load.values()) < 3 * 40_000
