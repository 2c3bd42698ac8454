"""The mix and the whole pipeline against plain Python, row by row."""

import collections
import random
import re
import zlib

import pytest
import xxhash

import corpus_pipeline
from gristmill.llm import mixing, quality, sharding
from tests.llm.test_corpus import ascii_lower, corpus, quality_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def shuffled(key, text, seed=11):
    h = 42
    for part in (None if key is None else key.to_bytes(8, "little", signed=True), None if text is None else text.encode(), seed.to_bytes(4, "little")):
        h = h if part is None else xxhash.xxh64_intdigest(part, h)
    return h % mixing.SPREAD  # a power of two: the sign does not matter


def mixed(rows):
    """Copies of each row (id, text, source): targets by repeated capping, copies by finish time until the budget is used."""
    size = [len(SPACES.findall(r[1] or "")) for r in rows]
    whole = collections.Counter()
    for r, n in zip(rows, size, strict=True):
        whole[r[2]] += n
    names = sorted((s for s in whole if s is not None), key=lambda s: s.encode()) + [None] * (None in whole)
    weight = {s: float(mixing.WEIGHTS[i % 3]) for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size))
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 3 * whole[s]}
        if not over:
            target |= {s: rate * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * whole[s]
            left -= target[s]
        free -= over
    before, copies = collections.Counter(), []
    mark = [shuffled(r[0], r[1]) for r in rows]
    for i in sorted(range(len(rows)), key=lambda i: (mark[i], rows[i][0] is not None, rows[i][0] or 0)):
        s = rows[i][2]
        if size[i] and target[s] > 0:
            copies += [((before[s] + size[i] + whole[s] * k) / target[s], s is None, s or "", mark[i], i, k) for k in range(mixing.MAX_EPOCHS)]
        before[s] += size[i]
    taken, budget = [0] * len(rows), sum(size)
    for *_, i, _k in sorted(copies):
        if size[i] > budget:
            break
        budget -= size[i]
        taken[i] += 1
    return taken


def near_groups(rows):
    """The smallest id of each id's group of near duplicates."""
    sets = {}
    for i, t in ((r[0], r[1]) for r in rows if r[0] is not None):
        w = SPACES.findall(ascii_lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def contaminated(text, bench):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    w, hit = find(text), set()
    for item in bench:
        v = find(item)
        n = min(13, len(v))
        for win in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == win:
                    hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def documents():
    """(rows, benchmark texts): corpus() without its extra columns, a frequent line, passages of test items, short and empty texts."""
    rng = random.Random(17)
    own = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    rows = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in corpus()]
    item = own(40)
    notice = "this line stands in very many documents of one host"
    for i in range(200, 230):
        rows.append((i, f"{own(70)}\n{notice}\n{own(10)}" if i % 2 else f"{notice}\n{own(80)}", "en", "host", 0))
    for i in range(230, 242):
        part = " ".join(item.split()[3 : 3 + 13 + i % 5])
        rows.append((i, f"{own(60 if i % 3 else 900)} {part} {own(5)}", "en", f"s{i % 4}", 0))
    near = own(120).split()
    for i in range(300, 306):
        near = [*near]
        near[i % 7 * 10] = f"other{i}"
        rows.append((i, " ".join(near), "en", "s1", 0))
    rows += [(400, None, None, None, None), (401, "", "", "", 0), (402, own(5000), "en", "long", 1)]
    return rows, [item, own(5), "", None]


@pytest.mark.parametrize("partitions", [1, 5])
def test_mix_against_plain_python(spark, partitions):
    rows = [(r[0], r[1], r[3]) for r in documents()[0]]
    want = collections.Counter((str(r[0]), n, len(SPACES.findall(r[1] or ""))) for r, n in zip(rows, mixed(rows), strict=True))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)).collect()
    assert collections.Counter((str(r.doc_id), r.copies, r.size) for r in got) == want
    assert len({n for _, n, _ in want}) >= 3 and all(r.taken == r.size * r.copies for r in got)


def test_pipeline_against_plain_python(spark, tmp_path):
    rows, bench = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    judged = quality_of([(r[0], r[1], r[3]) for r in rows], quality.LINE_DOCS)
    good = [(r[0], text, r[3]) for r, (_, kept, text) in zip(rows, judged, strict=True) if kept]
    root = near_groups(good)
    first = [r for r in good if r[0] is None or root[r[0]] == r[0]]
    clean = [r for r in first if not contaminated(r[1], bench)]
    assert len(rows) > len(good) > len(first) > len(clean) > 0 and any(n and kept for n, kept, _ in judged)
    want = collections.Counter()
    for r, n in zip(clean, mixed(clean), strict=True):
        if n:
            b = (r[1] or "").encode()
            want[str(r[0]), len(b) + 8, zlib.crc32(b)] += n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    one_row = max(r.size for r in got)
    load = [sum(r.size for r in got if r.shard == s) for s in range(24)]
    assert max(load) - min(load) <= 2 * max(one_row, max(n * size for (_, size, _), n in want.items()))


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_with_clashing_names(spark, tmp_path):
    """Columns named like the operators' own go along to the stage before the last."""
    rows, bench = documents()
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = ["_key", "_h", "_row", "size", "kept", "copies", "shard", "item_id", "_src", "h"]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + "".join(f", {c} string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *extra], name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.where(" and ".join(f"{c} = '{c}'" for c in extra)).count() == docs.count() > 0, name
    assert sharding.shard(docs).count() == docs.count()
