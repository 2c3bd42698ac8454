"""Spelling variants, disclosure and Merkle proofs against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from gristmill.llm import common, disclosure, merkle, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, _tree string, leaf string, entity string"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


def table(spark, rows):
    """(doc_id, text, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "w", "t", "l", "e") for i, t, s in rows], SCHEMA).repartition(3)


# Spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def plain_variants(rows):
    count = collections.Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def word_rows():
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(250)] + ["a" * k for k in range(7, 40)] + ["Ab×c÷def" * 300 + x for x in ("", "d", "de", "e")]
    rows = [(i if i else None, "-".join([*rng.choices(words, k=60), *words[-60:]]), "s") for i in range(20)]
    chain = [(100 + i, "wordone " * 400 + "wordtwo " * 2, "s") for i in range(3)] + [(200 + i, "wordtwone wordtwonne " * 1, "s") for i in range(2)]
    return [*rows, *chain, rows[3], (300, None, "s"), (301, "", None), (None, "x \U0001f600 y", "s")]


@pytest.mark.parametrize("group", [4096, 4])
def test_spelling(spark, monkeypatch, group):
    """Also with partitions of a few words, which are halved down to single places."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rows = word_rows()
    got = spelling.variants(table(spark, rows)).collect()
    assert {tuple(r) for r in got} == plain_variants(rows) and len(got) == len({r.word for r in got})


def test_no_partition_of_a_common_prefix_is_large(spark, monkeypatch):
    """Every word has one long prefix; no trie holds more than GROUP words unless its windows are single places."""
    monkeypatch.setattr(spelling, "GROUP", 50)
    rng = random.Random(4)
    words = {"prefix" * 5 + "".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(3000)}
    df = common.written(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    sizes = [(r["count"], r.w) for part in spelling.partitions(df) for r in part.groupBy("_g", (part["_b"] - part["_a"]).alias("w")).count().collect()]
    assert max(n for n, w in sizes if w > 1) <= 50


def test_trie_walk():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))) for _ in range(60)})
    got = dict(spelling.near(words))
    assert {i: sorted(v) for i, v in got.items()} == {i: want for i, w in enumerate(words) if (want := [j for j, v in enumerate(words) if one_edit(v, w)])}


def test_spelling_repair_and_empty(spark):
    docs = table(spark, [(i, "wordone " * 12, None) for i in range(3)] + [(9, "Wordonne, wordonne. ok", None)])
    assert [tuple(r) for r in spelling.respelled(docs, spelling.variants(docs)).collect()] == [(9, "wordonne", "wordone", 2)]
    assert spelling.variants(docs.limit(0)).count() == 0


# Disclosure

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_entities(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t or ""):
            d = [int(c) for c in m.group() if "0" <= c <= "9"]
            luhn = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_entities_like_the_plain_patterns():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1.2@+- ()5%é,") for _ in range(rng.randrange(150))) for _ in range(6000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "0001.2.3.255 1.2.3.256 1.2.3.4.5.6.7.8", "a@b.c@d.e x@y..z", "9" * 5000 + ".1.1.1", "😀 é@b.c a.é@b.c x@b.cé"]
    for t in texts[:-2] + texts[-1:]:
        assert [f"{disclosure.KINDS[k]}:{s}:{e}" for k, s, e in disclosure.entities(t)] == plain_entities(t)
    assert disclosure.entities(texts[-2]) == []


def private_rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        t = [rng.choice(words) for _ in range(80)]
        if i < 6:
            t.insert(20 + i, "Write Zorvak at zorvak.q@mail.example.com")
        if i == 6:
            t.insert(3, "zorvak")
        if i % 3 == 0:
            t.insert(9, "info@corp.example.com office")
        rows.append((i, " ".join(t), None))
    near = [*rows[7][1].split(), "hapax", "lone@mail.example.com"]
    return [*rows, *[(400, " ".join(near), None)] * 5, (None, None, None), (7, "", None)]


@pytest.mark.parametrize("fits", [True, False])
def test_terms_that_disclose(spark, monkeypatch, fits):
    """zorvak gives its address away, also alone; no word does for an address that a third of all hold, nor for copies of one text."""
    if not fits:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = private_rows()
    docs = table(spark, rows)
    terms = {r.term: r for r in disclosure.disclosing(docs).collect()}
    assert set(terms) == {"zorvak", "write", "at"} and abs(terms["zorvak"].left_bits - 0.22239) < 1e-4 and terms["at"].left_bits == 0
    got = disclosure.report(docs).collect()
    assert len(got) == len(rows) and collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in rows)
    texts = {(i, t) for i, t, _ in rows}
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        base = [s for s in spans if not s.startswith("term:")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and r.n_email == len(base) and r.n_ip == r.n_card == r.n_phone == 0
        own = [t for i, t in texts if i == r.doc_id and plain_entities(t) == base and all(lower(t[int(s.split(":")[1]) : int(s.split(":")[2])]) in terms for s in spans[len(base) :])]
        assert own and len(spans) - len(base) == max(sum(lower(w) in terms for w in (t or "").split()) for t in own)
    clean = {r.doc_id: r for r in disclosure.sanitised(docs).collect() if r.doc_id is not None and r.doc_id < 7}
    assert "[NAME]  [EMAIL]" in clean[1].text and "[TERM]" in clean[6].text and clean[1].entity == "e" and disclosure.sanitised(docs).columns == docs.columns
    assert disclosure.report(docs.limit(0)).count() == 0 and disclosure.sanitised(docs.where("text is null")).first().text is None


# Merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def climb(levels, i, now):
    beside = []
    for nodes in levels[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        beside += run[: i % 16] + run[i % 16 + 1 :]
        now = sha("".join([*run[: i % 16], now, *run[i % 16 + 1 :]]))
        i //= 16
    return beside, now


def plain_proofs(docs):
    by = collections.defaultdict(list)
    for r in docs:
        leaf = [sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, t)))) for t in (r.text, r.text and lower(r.text))]
        bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf[0], leaf[bad], r.doc_id))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = collections.Counter()
    for j, s in enumerate(sources):
        for i, (_, _, leaf, now, doc_id) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            low, now = climb(trees[s], i, now)
            high, now = climb(top, j, now)
            out[(doc_id, leaf, trees[s][-1][0], top[-1][0], sha("".join(low + high)), now, now == top[-1][0])] += 1
    return out


def test_merkle(spark):
    """A hot source over three levels, sources of one row, 20 sources, nulls, repeated rows and ids."""
    rows = [(i if i % 50 else None, f"Text {i}" if i % 7 else None, "hot") for i in range(700)] + [(i, f"É{i}", f"é{i % 19}") for i in range(60)] + [(7, "", "solo"), (8, "A", None)] + [(5, "Dup", "hot")] * 40
    docs = table(spark, rows)
    got = collections.Counter(map(tuple, merkle.report(docs).collect()))
    assert got == plain_proofs(docs.collect())
    assert merkle.report(docs.limit(0)).count() == 0 and merkle.report(docs.where("source = 'solo'")).first().verified


def test_merkle_finds_changed_rows(spark):
    old = table(spark, [(i, f"text {i}", f"s{i % 3}") for i in range(90)])
    new = table(spark, [(i, f"text {i}" if i != 17 else "other", f"s{i % 3}") for i in range(1, 91)])
    assert {r.doc_id: r.verified for r in merkle.changed(old, new).where("not verified").collect()} == {0: False, 17: False, 90: False}
