"""Suffix-array deduplication of repeated byte strings across documents.

A byte is removed if a string of LENGTH bytes that covers it also starts in a document with a
smaller id. All suffixes of a large corpus can't be sorted in bounded disk (each would travel with its
LENGTH bytes, 50 times the input), so the suffix array is built where repeats can be:

1. Anchors. Every LENGTH-byte string holds the least hash of its KEY-byte strings (winnowing), and
   equal strings hold it at the same place; these places are the anchors, one in ten bytes.
2. Anchors meet by their KEY-byte hash. Where the whole neighbourhood (all strings that hold the
   anchor) has the hash of one in a smaller document, both neighbourhoods' bytes are compared: inside
   a block at once, over blocks as spans, for which neighbouring anchors with one source join. Equal
   spans are removed; the keys of others are left to step 4.
3. Where neighbourhoods differ, their texts are fetched, and suffix arrays of what follows and of
   what precedes the anchor are built by mergesort. Two suffixes are compared by their common
   extension, which binary search over prefix polynomial hashes finds; equal neighbours are verified
   byte by byte. The arrays' common-prefix groups tell for each of the LENGTH - KEY + 1 strings at an
   anchor the smallest document that has it.
4. Keys of more than HOT_ROWS neighbourhoods, which a sample of the documents finds, would fill a task. Their
   strings, and those of keys whose hashes collide, are grouped as they are: the smallest document per block and string, then over blocks.

Whole copies of a text are found by SHA-256 beforehand and removed entirely.

Scale: anchors travel as packed columns per block of documents and bucket of hashes, about 23 bytes
each; in a block equal neighbourhoods are settled before the shuffle, so that a group of near copies
sends one row per block, not one per copy. Buckets and blocks have a fixed size; their number grows
with the data. Texts travel only for documents with hits. The driver collects the hot keys, no more
than HOT_KEYS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import blocks
from gristmill.llm.common import found, lookup, packed, salted, small, text_or_empty, written

LENGTH, KEY = 50, 32
BUCKET_BYTES = 6 << 20
#: A key is hot if it has more neighbourhoods than HOT_ROWS, and than one in HOT_KEYS of all, as one document in SAMPLE tells.
HOT_ROWS, HOT_KEYS, SAMPLE = 200_000, 1_000_000, 64
#: Bytes that are hashed, and rows that are listed or sorted, at a time: hashes take many times their text's memory.
PIECE, ROWS = 1 << 18, 1 << 15


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of x[i : i + width] for each i."""
    f = np.minimum if least else np.maximum
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[:-step], x[step:])
        done += step
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, document of each, prefix hashes): where the least key hash of some `length`-byte window of one document is."""
    prefix = blocks.prefix_hash(data)
    window = length - key + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), prefix
    at = np.arange(len(data) - key + 1)
    hashes = blocks.span_hash(prefix, at, at + key)
    low = _slide(hashes, window, True)  # of the window that starts at i
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = doc[: len(low)] == doc[length - 1 : length - 1 + len(low)]
    low = np.where(inside, low, np.uint64(0))
    pad = np.zeros(window - 1, np.uint64)
    high = _slide(np.concatenate((pad, low, pad)), window, False)[: len(hashes)]
    places = np.flatnonzero((hashes == high) & (high > 0))
    return places, doc[places], prefix


def _neighbourhood(places: np.ndarray, doc: np.ndarray, offsets: np.ndarray, length: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the union of all `length`-byte strings of the document that hold the anchor."""
    return np.maximum(offsets[doc], places - (length - key)), np.minimum(offsets[doc + 1], places + length)


def marked(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """(places, document of each, key hashes, neighbourhoods' first bytes, ends and hashes) of all anchors, PIECE bytes of data at a time."""
    out = []
    for begin in range(0, max(1, len(data)), PIECE):
        end = begin + PIECE
        # the strings that hold a place reach this far; they alone tell whether it is an anchor
        low, high = max(0, begin - (length - key)), min(len(data), end + length - 1)
        one, two = int(np.searchsorted(offsets, low, "right")) - 1, int(np.searchsorted(offsets, high))
        part = np.clip(offsets[one : two + 1], low, high) - low
        places, doc, prefix = anchors(data[low:high], part, length, key)
        mine = (places >= begin - low) & (places < end - low)
        places, doc = places[mine], doc[mine]
        first, last = _neighbourhood(places, doc, part, length, key)
        out.append((places + low, doc + one, blocks.span_hash(prefix, places, places + key), first + low, last + low, blocks.span_hash(prefix, first, last)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _key_hashes(data: np.ndarray, places: np.ndarray, key: int) -> np.ndarray:
    """Hash of the key at each place, PIECE bytes of data at a time."""
    out, order = np.zeros(len(places), np.uint64), np.argsort(places, kind="stable")
    for begin in range(0, len(data), PIECE):
        a, b = np.searchsorted(places, (begin, begin + PIECE), sorter=order)
        if a < b:
            at = places[order[a:b]] - begin
            out[order[a:b]] = blocks.span_hash(blocks.prefix_hash(data[begin : begin + PIECE + key]), at, at + key)
    return out


def _among(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which hashes are hot (hot: sorted)."""
    if not len(hot):
        return np.zeros(len(hashes), bool)
    return hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes


_PACKED = "bucket int, key binary, around binary, doc binary, own binary, place binary, done_own binary, done_place binary"


def _narrow(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _wide(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.view("<u8").reshape(-1)


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes at a equal those at b."""
    same = np.ones(len(a), bool)
    for k in range(int(size.max(initial=0))):
        use = np.flatnonzero(same & (size > k))
        same[use] = data[a[use] + k] == data[b[use] + k]
    return same


def _pack(buckets: int, length: int, key: int, twins: bool, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owns = batch.column("_id").to_numpy(), batch.column("_own").to_numpy()
            for row, data, offsets in blocks.text_blocks(batch.column("text")):
                places, doc, hashes, first, last, spans = marked(data, offsets, length, key)
                if len(hot):
                    cold = ~_among(hashes, hot)
                    places, doc, hashes, first, last, spans = (x[cold] for x in (places, doc, hashes, first, last, spans))
                if not len(places):
                    continue
                owner, self_ = ids[row + doc], owns[row + doc]
                around = blocks.mix(spans + (places - first).astype(np.uint64))
                place = (places - offsets[doc]).astype(np.uint32)
                # of equal neighbourhoods in this block only the smallest document's goes on; the others are settled
                order = np.lexsort((place, owner, around, hashes))
                h, a, o = hashes[order], around[order], owner[order]
                new = np.concatenate(([True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])))
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                done = o > o[head]
                maybe = np.flatnonzero(done)
                one, two = order[maybe], order[head[maybe]]
                size = last[one] - first[one]
                done[maybe] = (size == last[two] - first[two]) & _equal_bytes(data, first[one], first[two], np.minimum(size, last[two] - first[two]))
                bucket = (h >> np.uint64(40)) % np.uint64(buckets)
                sort = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[sort], np.arange(buckets + 1, dtype=np.uint64))
                rows = []
                for b in np.unique(bucket).astype(np.int64).tolist():
                    mine = sort[bounds[b] : bounds[b + 1]]
                    go, settled = mine[~done[mine]], mine[done[mine]]
                    # within one document equal neighbourhoods stay together: each place is kept
                    own = self_[order[go]].astype("<i8").tobytes() if twins else b""
                    rows.append((b, _narrow(h[go], 6), _narrow(a[go], 5), o[go].astype("<i8").tobytes(), own, place[order[go]].astype("<u4").tobytes(), self_[order[settled]].astype("<i8").tobytes(), place[order[settled]].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 8)]], ["bucket", "key", "around", "doc", "own", "place", "done_own", "done_place"])
    return run


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_MET = pa.schema([("_own", pa.int64()), ("settled", _INTS), ("src", _LONGS), ("at", _INTS), ("done", _INTS), ("open", _INTS)])


def _meet(table: pa.Table) -> pa.Table:
    """Of one bucket, per document: anchors settled by hash with their source's anchor, those settled in their block, and those that share their key with a different neighbourhood."""
    key, around = _wide(_joined(table, "key", "u1"), 6), _wide(_joined(table, "around", "u1"), 5)
    doc, own, place = _joined(table, "doc", "<i8"), _joined(table, "own", "<i8"), _joined(table, "place", "<u4")
    own = own if len(own) else doc
    order = np.lexsort((place, own, doc, around, key))
    key, around, doc, own, place = key[order], around[order], doc[order], own[order], place[order]
    n = len(key)
    new_key = np.concatenate((np.ones(min(n, 1), bool), key[1:] != key[:-1]))
    new = new_key | np.concatenate((np.ones(min(n, 1), bool), around[1:] != around[:-1]))
    kinds, group = np.flatnonzero(new_key), np.cumsum(new_key) - 1
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
    settled = doc > doc[head]
    mixed = np.add.reduceat(new.astype(np.int64), kinds)[group] > 1 if n else new
    if n:  # one document alone can't repeat another
        mixed &= (np.minimum.reduceat(doc, kinds) < np.maximum.reduceat(doc, kinds))[group]
    todo = mixed & ~settled
    done_own, done_place = _joined(table, "done_own", "<i8"), _joined(table, "done_place", "<u4")
    owners = (own[settled], done_own, own[todo])
    places = (place[settled], done_place, place[todo])
    ids = np.concatenate(owners)
    kind = np.repeat(np.arange(3), [len(x) for x in owners])
    order = np.argsort(ids, kind="stable")
    ids, kind, spot = ids[order], kind[order], np.concatenate(places).astype(np.int32)[order]
    extra = np.concatenate((own[head[settled]], np.zeros(len(done_own) + int(todo.sum()), np.int64)))[order]
    where = np.concatenate((place[head[settled]], np.zeros(len(done_own) + int(todo.sum()), np.uint32))).astype(np.int32)[order]
    some, starts = np.unique(ids, return_index=True)

    def lists(k: int, values: np.ndarray) -> pa.Array:
        count = np.concatenate(([0], np.cumsum(kind == k)))
        return pa.ListArray.from_arrays(pa.array(count[np.append(starts, len(ids))].astype(np.int32)), pa.array(values[kind == k]))

    return pa.Table.from_arrays([pa.array(some), lists(0, spot), lists(0, extra), lists(0, where), lists(1, spot), lists(2, spot)], schema=_MET)


_SPANS = pa.schema([("_own", pa.int64()), ("begin", pa.int32()), ("stop", pa.int32()), ("src", pa.int64()), ("other", pa.int32()), ("places", _INTS)])


def _spans(length: int, key: int):
    """Neighbourhoods of a document's settled anchors, joined where they touch and have one source at one distance; those settled in their block have none."""
    def joined(own: int, place: np.ndarray, src: np.ndarray, at: np.ndarray, known: bool) -> list[tuple]:
        shift = at - place
        order = np.lexsort((place, shift, src))
        place, src, shift = place[order], src[order], shift[order]
        cut = np.flatnonzero((src[1:] != src[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] - (length - key) > place[:-1] + length)) + 1
        out = []
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
            begin = max(0, int(place[a]) - (length - key))
            out.append((own, begin, int(place[b - 1]) + length, None if known else int(src[a]), None if known else begin + int(shift[a]), [] if known else place[a:b].tolist()))
        return out

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SPANS)], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for own, parts in zip(batch.column("_own").to_pylist(), batch.column("parts"), strict=True):
                parts = parts.values
                flat = lambda c: parts.field(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731,B023
                place, done = flat("settled"), flat("done")
                if len(place):
                    rows += joined(own, place, flat("src"), flat("at"), False)
                if len(done):
                    rows += joined(own, done, np.zeros_like(done), done, True)
                held += len(place) + len(done)
                if held >= ROWS:
                    yield listed(rows)
                    rows, held = [], 0
            yield listed(rows)
    return run


def suffix_order(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes data[start : start + size] sorted inside each segment, and the common prefix with the one before.

    Bottom-up mergesort of all segments at once: in each round every suffix finds its rank in its
    run's partner by binary search, and each comparison finds the common extension by binary search
    over prefix hashes. Equal hashes of neighbours are verified on the bytes at the end; segments
    must be sorted numbers.
    """
    prefix = blocks.prefix_hash(data)
    inverse = blocks.powers(len(data) + 1, True)
    padded = np.append(data, np.uint8(0))

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.minimum(sizes[x], sizes[y])
        while len(x) and (low < high).any():
            mid = (low + high + 1) // 2
            sx, sy = starts[x], starts[y]
            same = (prefix[sx + mid] - prefix[sx]) * inverse[sx] == (prefix[sy + mid] - prefix[sy]) * inverse[sy]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        n = common(x, y)
        ex, ey = n >= sizes[x], n >= sizes[y]
        bx, by = padded[np.minimum(starts[x] + n, len(data))], padded[np.minimum(starts[y] + n, len(data))]
        return np.where(ex & ey, ties, np.where(ex, True, np.where(ey, False, bx < by)))

    total = len(starts)
    order = np.arange(total)
    if not total:
        return order, np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    head = np.repeat(heads, np.diff(np.append(heads, total)))
    size = np.repeat(np.diff(np.append(heads, total)), np.diff(np.append(heads, total)))
    run = 1
    while run < size.max():
        at = np.flatnonzero(size > run)
        local = at - head[at]
        mine = local // run
        left = mine % 2 == 0
        partner = (mine ^ 1) * run
        low = head[at] + np.minimum(partner, size[at])
        high = head[at] + np.minimum(partner + run, size[at])
        first = low.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            # how many of the partner's stand before this one; the left run goes first among equals
            less = before(order[mid], order[at[open_]], ~left[open_])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        target = head[at] + (mine // 2) * 2 * run + (local - mine * run) + (low - first)
        merged = order.copy()
        merged[target] = order[at]
        order, run = merged, run * 2
    lcp = np.zeros(total, np.int64)
    inner = np.flatnonzero(np.concatenate(([False], segment[1:] == segment[:-1])))
    lcp[inner] = common(order[inner - 1], order[inner])
    longest = int(lcp.max(initial=0))
    for k in range(longest):  # collision verification
        use = inner[lcp[inner] > k]
        wrong = use[data[starts[order[use]] + k] != data[starts[order[use - 1]] + k]]
        lcp[wrong] = k
    return order, lcp


_CONTEXT = "bucket int, key bigint, _id bigint, _own bigint, place int, head binary, tail binary"


def _fetch(buckets: int, length: int, key: int):
    """Open anchors' surroundings: the anchor and what follows, and what precedes it, reversed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owns, opens = batch.column("_id").to_numpy(), batch.column("_own").to_numpy(), batch.column("open")
            for row, data, offsets in blocks.text_blocks(batch.column("text")):
                docs = len(offsets) - 1
                lists = opens.slice(row, docs)
                sizes = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(docs), sizes)
                places = lists.flatten().to_numpy() + offsets[doc]
                hashes = _key_hashes(data, places, key)
                first, last = _neighbourhood(places, doc, offsets, length, key)
                whole, back = data.tobytes(), data[::-1].tobytes()
                n = len(data)
                for a in range(0, len(places), ROWS):
                    h, p, d, f, e = (x[a : a + ROWS] for x in (hashes, places, doc, first, last))
                    heads = [back[n - i : n - j] for j, i in zip(f.tolist(), p.tolist(), strict=True)]
                    tails = [whole[i:j] for i, j in zip(p.tolist(), e.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(ids[row + d]), pa.array(owns[row + d]), pa.array((p - offsets[d]).astype(np.int32)), pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], ["bucket", "key", "_id", "_own", "place", "head", "tail"])
    return run


_HITS = pa.schema([("_own", pa.int64()), ("starts", _INTS)])


def _groups(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """Number of the group of suffixes that agree in their first `depth` bytes, for each suffix."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def _resolve(length: int, key: int):
    def run(table: pa.Table) -> pa.Table:
        """Whole keys, about ROWS anchors at a time."""
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] - 1))
        cuts = heads[np.unique(heads // ROWS, return_index=True)[1]]
        return pa.concat_tables([_HITS.empty_table(), *(some(table.take(order[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True))])

    def some(table: pa.Table) -> pa.Table:
        segment, ids, owns, place = (table.column(c).to_numpy() for c in ("key", "_id", "_own", "place"))
        sides = []
        for name in ("head", "tail"):
            column = table.column(name)
            sizes = pc.binary_length(column).to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(x.as_py() for x in column), np.uint8)
            sides.append((*suffix_order(data, np.cumsum(sizes) - sizes, sizes, segment), sizes))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        (h_order, h_lcp, h_size), (t_order, t_lcp, t_size) = sides
        for before in range(length - key + 1):
            fits = np.flatnonzero((h_size >= before) & (t_size >= length - before))
            if not len(fits):
                continue
            # A suffix group of a lower common prefix than `depth` is a new one even for shorter suffixes, which don't fit.
            a, b = _groups(h_order, h_lcp, before)[fits], _groups(t_order, t_lcp, length - before)[fits]
            if before == 0:
                a = np.unique(segment, return_inverse=True)[1][fits]
            order = np.lexsort((ids[fits], b, a))
            a, b, mine = a[order], b[order], fits[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            least = ids[mine[np.flatnonzero(new)]][np.cumsum(new) - 1]
            hit = mine[ids[mine] > least]
            hits.append((owns[hit], place[hit] - before))
        doc = np.concatenate([f[0] for f in hits]) if hits else np.zeros(0, np.int64)
        at = np.concatenate([f[1] for f in hits]) if hits else np.zeros(0, np.int32)
        order = np.argsort(doc, kind="stable")
        some, first = np.unique(doc[order], return_index=True)
        return pa.Table.from_arrays([pa.array(some), pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(at[order].astype(np.int32)))], schema=_HITS)
    return run


def _keys(length: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in blocks.text_blocks(batch.column("text")):
                _, _, hashes, _, _, spans = marked(data, offsets, length, key)
                pairs = np.stack((hashes, spans), axis=1)
                kinds, n = np.unique(np.unique(pairs, axis=0)[:, 0], return_counts=True)  # equal neighbourhoods of a block travel once
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["key", "n"])
    return run


def _keys_at(key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                hashes = _key_hashes(np.frombuffer(text.as_buffer(), np.uint8), places.values.to_numpy().astype(np.int64), key)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["key"])
    return run


def _hot_strings(length: int, key: int, hot: np.ndarray):
    """Per block and different string at a hot anchor: the smallest document that has it, and all places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owns = batch.column("_id").to_numpy(), batch.column("_own").to_numpy()
            for row, data, offsets in blocks.text_blocks(batch.column("text")):
                places, doc, hashes, *_ = marked(data, offsets, length, key)
                use = np.flatnonzero(_among(hashes, hot))
                whole, strings = data.tobytes(), {}
                for p, d in zip(places[use].tolist(), doc[use].tolist(), strict=True):
                    for start in range(max(int(offsets[d]), p - (length - key)), min(p, int(offsets[d + 1]) - length) + 1):
                        strings.setdefault(whole[start : start + length], []).append((int(ids[row + d]), int(owns[row + d]), start - int(offsets[d])))
                rows = [(t, min(v)[0], *map(list, zip(*v, strict=True))) for t, v in strings.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), _LONGS, _LONGS, _INTS))], ["string", "least", "ids", "owns", "starts"])
    return run


def _cut(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column("text"), batch.column("parts"), strict=True):
                data, parts = np.frombuffer(text.as_buffer(), np.uint8), parts.values
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, parts.field("begin").flatten().to_numpy(zero_copy_only=False), 1)
                np.add.at(edge, np.minimum(len(data), parts.field("stop").flatten().to_numpy(zero_copy_only=False)), -1)
                mask = np.cumsum(edge) > 0
                left = data[~mask[:-1]].tobytes()
                rows.append((int(mask.sum()), int((mask[:-1] & ~np.concatenate(([False], mask[:-2]))).sum()) if len(data) else 0, left if texts else hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("_own"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary() if texts else pa.string())], ["_own", "n_removed", "n_spans", "kept"])
    return run


def hot_keys(rest: DataFrame, length: int = LENGTH, key: int = KEY) -> np.ndarray:
    """Sorted hashes of the keys that would fill a task, by a sample of the documents; all rows of theirs are handled."""
    sample = rest.where(F.pmod(F.xxhash64("_own", F.lit(17)), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_keys(length, key), "key bigint, n bigint")
    counts = written(sample.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * SAMPLE > HOT_ROWS))
    total = rest.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = [r["key"] for r in counts.where(F.col("n") * SAMPLE > total * 2 // (length - key + 2) // HOT_KEYS).collect()]  # fewer than about HOT_KEYS
    return np.sort(np.array(keys, np.int64).view(np.uint64))


def unequal(spans: DataFrame, rest: DataFrame) -> DataFrame:
    """(_own, begin, src, other) of those spans (_own, begin, stop, src, other) whose bytes are not their source's."""
    size = F.col("stop") - F.col("begin")
    name = ["_own", "begin", "src", "other"]
    sides = spans.select(*name, F.col("_own").alias("_who"), F.col("begin").alias("_from"), size.alias("_n")).unionByName(spans.select(*name, F.col("src").alias("_who"), F.col("other").alias("_from"), size.alias("_n")))
    ids = small(written(spans.select(F.explode(F.array("_own", "src")).alias("_who")).distinct()))
    texts = rest.select(F.col("_own").alias("_who"), "text").join(ids, "_who", "left_semi").dropDuplicates(["_who"])
    slices = salted(sides, texts, "_who").select(*name, F.substring(F.col("text").cast("binary"), F.col("_from") + 1, F.col("_n")).alias("_s"))
    return slices.groupBy(*name).agg(F.min("_s").alias("_a"), F.max("_s").alias("_b")).where("_a <> _b").select(*name)


def find_repeats(rest: DataFrame, twins: bool, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(_own, begin, stop): ranges to remove of the texts of rest (_own, _id, text); twins: whether _own ever differs from _id."""
    hot = hot_keys(rest, length, key)
    total = rest.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, total * 17 // (key // 3) // BUCKET_BYTES))
    packed_ = rest.select("_id", "_own", "text").mapInArrow(_pack(buckets, length, key, twins, hot), _PACKED)
    met = written(packed_.groupBy("bucket").applyInArrow(_meet, "_own bigint, settled array<int>, src array<bigint>, at array<int>, done array<int>, open array<int>"))
    of_doc = met.where((F.size("settled") > 0) | (F.size("done") > 0)).groupBy("_own").agg(F.collect_list(F.struct("settled", "src", "at", "done")).alias("parts"))
    spans = written(of_doc.mapInArrow(_spans(length, key), "_own bigint, begin int, stop int, src bigint, other int, places array<int>"))
    by_hash = spans.where("src is not null").drop("places")
    bad = written(unequal(by_hash, rest))
    sure, exact = spans.select("_own", "begin", "stop"), hot
    if bad.limit(1).count():  # two hashes agree and the bytes don't: all strings at these keys are grouped as they are
        name = ["_own", "begin", "src", "other"]
        sure = sure.join(bad, ["_own", "begin"], "left_anti").unionByName(spans.join(bad.select("_own", "begin").distinct(), ["_own", "begin"], "left_semi").join(bad, name, "left_anti").select("_own", "begin", "stop"))
        wrong = spans.join(bad, name, "left_semi").select("_own", "places").join(rest.dropDuplicates(["_own"]), "_own").select("text", "places")
        keys = [r["key"] for r in wrong.mapInArrow(_keys_at(key), "key bigint").distinct().collect()]  # none unless 88 bits of hash collide
        exact = np.union1d(hot, np.array(keys, np.int64).view(np.uint64))
    opens = written(met.where(F.size("open") > 0).groupBy("_own").agg(F.flatten(F.collect_list("open")).alias("open")))
    texts = rest.join(small(opens.select("_own")), "_own", "left_semi").dropDuplicates(["_own"])
    context = opens.join(texts, "_own").select("_id", "_own", "open", "text").mapInArrow(_fetch(buckets, length, key), _CONTEXT)
    more = context.groupBy("bucket").applyInArrow(_resolve(length, key), "_own bigint, starts array<int>").select("_own", F.explode("starts").alias("begin"))
    if len(exact):
        strings = written(rest.select("_id", "_own", "text").mapInArrow(_hot_strings(length, key, exact), "string binary, least bigint, ids array<bigint>, owns array<bigint>, starts array<int>"))
        first = written(strings.groupBy("string").agg(F.min("least").alias("_first")))
        each = found(strings.select("string", "ids", "owns", "starts"), first, ["string"]).select("_first", F.explode(F.arrays_zip("ids", "owns", "starts")).alias("_e"))
        more = more.unionByName(each.where("_e.ids > _first").select(F.col("_e.owns").alias("_own"), F.col("_e.starts").alias("begin")))
    return written(sure.unionByName(more.select("_own", "begin", (F.col("begin") + length).alias("stop"))))


def known_texts(docs: DataFrame, key: str, text: str, length: int) -> tuple[DataFrame, DataFrame, bool]:
    """(per row _id, _sha, _own, n_bytes, copy; rows _own, _id, text that may hold repeats; whether ids have several texts).

    A document is known by _own: its id, or where rows with different texts share one, a hash of both.
    """
    body = text_or_empty(text)
    facts = written(docs.select(F.col(key).cast("long").alias("_id"), F.sha2(body.cast("binary"), 256).alias("_sha"), F.octet_length(body).cast("long").alias("n_bytes")))
    twin = written(facts.where("_id is not null").groupBy("_id").agg(F.min("_sha").alias("a"), F.max("_sha").alias("b")).where("a < b").select("_id", F.lit(True).alias("_twin")))
    twins = twin.limit(1).count() > 0
    rows = docs.select(F.col(key).cast("long").alias("_id"), body.alias("text")).where("_id is not null").where(F.octet_length("text") >= length)
    if twins:
        own = lambda sha: F.when(F.coalesce("_twin", F.lit(False)), F.xxhash64("_id", sha)).otherwise(F.col("_id"))
        facts = facts.join(small(twin), "_id", "left").withColumn("_own", own(F.col("_sha"))).drop("_twin")
        rows = rows.join(small(twin), "_id", "left").withColumn("_own", own(F.sha2(F.col("text").cast("binary"), 256))).drop("_twin")
    else:
        facts, rows = facts.withColumn("_own", F.col("_id")), rows.withColumn("_own", F.col("_id"))
    first = written(facts.where((F.col("n_bytes") >= length) & F.col("_id").isNotNull()).groupBy("_sha").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).where("_least < _most").select("_sha", "_least"))
    facts = written(lookup(facts, first, ["_sha"]).select("_id", "_sha", "_own", "n_bytes", F.coalesce(F.col("_id") > F.col("_least"), F.lit(False)).alias("copy")))
    rest = rows.join(small(written(facts.where("copy").select("_own").distinct())), "_own", "left_anti")
    return facts, rest, twins


def _cut_texts(rest: DataFrame, hits: DataFrame, texts: bool) -> DataFrame:
    of_doc = written(hits.groupBy("_own").agg(F.collect_list(F.struct(F.array("begin").alias("begin"), F.array("stop").alias("stop"))).alias("parts")))
    mine = rest.join(small(of_doc.select("_own")), "_own", "left_semi").dropDuplicates(["_own"])
    return mine.join(of_doc, "_own").select("_own", "text", "parts").mapInArrow(_cut(texts), f"_own bigint, n_removed bigint, n_spans bigint, kept {'binary' if texts else 'string'}")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. A row with a null key is neither a source nor cut. Rows that share a key are
    one document as a source, and each text of theirs is cut by itself; equal rows get equal results.
    An empty table gives no rows; columns other than key and text are not read.
    """
    facts, rest, twins = known_texts(docs, key, text, length)
    cut = _cut_texts(rest, find_repeats(rest, twins, length), False)
    out = facts.join(cut, "_own", "left")
    copy, zero = F.col("copy"), F.lit(0).cast("long")
    return out.select(
        F.col("_id").alias(key), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"), F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "_sha")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs with a column kept_bytes: the text's bytes that stay. Cuts may fall inside a character. Defined for the same cases as report."""
    facts, rest, twins = known_texts(docs, key, text, length)
    cut = _cut_texts(rest, find_repeats(rest, twins, length), True).select("_own", "kept", F.lit(False).alias("_gone"))
    gone = facts.where("copy").select("_own").distinct().select("_own", F.lit(None).cast("binary").alias("kept"), F.lit(True).alias("_gone"))
    change = facts.select("_id", "_own", "_sha").distinct().join(cut.unionByName(gone), "_own").select("_id", "_sha", "kept", "_gone")
    own = F.col("_row")[key].cast("long")
    rows = packed(docs).withColumn("_t", F.sha2(text_or_empty(F.col("_row")[text]).cast("binary"), 256))
    out = rows.join(change, (own == F.col("_id")) & (F.col("_t") == F.col("_sha")), "left")
    body = F.when(F.coalesce("_gone", F.lit(False)), F.lit(b"")).otherwise(F.coalesce("kept", text_or_empty(F.col("_row")[text]).cast("binary")))
    return out.select("_row.*", body.alias("kept_bytes"))
