"""WARC archives: written as records, and read back by verifying chains of record boundaries.

Writing: one row is one record, and the end of a record is the text sink's line separator, so that
Spark's committer protects the files. Of records with equal payloads the one with the smallest id is
a response, the others are revisits without payload.

Reading: the text source splits files at every occurrence of the magic "WARC/1.", wherever it stands.
Each occurrence is a candidate; a task knows the offset of its candidates (sums of piece lengths per
split come first) and the offset of the record that would follow each, from its header. A header may
hold the magic itself (in its URL) and so go on over pieces and splits. Inside a
split chains are followed at once to the first offset beyond it; between splits pointer jumping,
doubling each round, finds the candidates that are reachable from the file's start. All others are
magic inside payloads or headers. A chain that stops before its file's end is an error. A second pass cuts the records; those that cross splits are put together.

Scale: work is per split. Tables about splits have one row per split; nothing about them is collected,
and they are joined to the pieces by broadcast only where their measured size allows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import fits, lookup, shared_folder, small, written

MAGIC = b"WARC/1."
ENTRY = "<urn:gristmill:record:"
#: Shortest payload for which revisits are written.
MIN_BYTES = 0
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.I)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: five hex digits make four characters of it."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(rows: DataFrame) -> DataFrame:
    """(id, digest, refers_to) of the records (id, digest, bytes) whose payload a record with a smaller id has."""
    rows = written(rows.where("id is not null").distinct())
    first = rows.where(F.col("bytes") >= MIN_BYTES).groupBy("digest", "bytes").agg(F.min("id").alias("refers_to"), F.max("id").alias("_last")).where("refers_to < _last").select("digest", "bytes", "refers_to")
    return lookup(rows, first, ["digest", "bytes"]).where("id > refers_to").select("id", "digest", "refers_to")


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row to files in path. A null body is an empty payload; a row without key is a response with an empty id."""
    body_col = F.coalesce(F.col(body).cast("string"), F.lit(""))
    digest = base32_sha1(body_col.cast("binary"))
    twice = small(written(revisits(pages.select(F.col(key).cast("long").alias("id"), digest.alias("digest"), F.octet_length(body_col).alias("bytes")))), 200_000)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]", "").alias("_url"), body_col.alias("_body"), digest.alias("digest")).join(twice, ["id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("_body")))
    name = lambda c: F.concat(F.lit(ENTRY), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("_url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    meta = "_metadata"
    return spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col(f"{meta}.file_path").alias("file"), F.col(f"{meta}.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def _fields(piece: bytes) -> tuple[int | None, int]:
    """(content length or None, place of the header's end or -1) that a header which is open at the piece's start finds in it.

    Neither a length's line nor the end holds the magic, so each stands within one piece.
    """
    end = piece.find(b"\r\n\r\n")
    m = _LENGTH.search(piece, 0, end + 2 if end >= 0 else len(piece))
    return int(m[1]) if m else None, end


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split its bytes, and the length and the header's end (from its start) for headers that earlier splits leave open."""
    found: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, split, piece in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("piece"), strict=True):
            piece = piece.as_py()
            own = found.setdefault((file, split), [0, None, None])
            if own[2] is None:
                length, end = _fields(piece)
                own[1] = length if own[1] is None else own[1]
                own[2] = own[0] + end if end >= 0 else None
            own[0] += len(piece) + len(MAGIC)
    if found:
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k else pa.string()) for k in range(5)], ["file", "split", "n", "length", "stop"])


_PLACE = ("start", "ahead_length", "ahead_end", "entry", "bytes")


class Split:
    """What a task knows of a split: its first offset, (length, end) for headers that it leaves open, where chains enter it, its file's size."""

    __slots__ = ("file", "split", "at", "ahead", "entry", "bytes")

    def __init__(self, file: str, split: int, start: int, length: int | None, end: int | None, entry: int | None, size: int):
        self.file, self.split, self.at, self.ahead, self.entry, self.bytes = file, split, start, (length, end), entry, size


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, int | None, bytes]]:
    """(split, offset of the magic, piece); None before the file's first magic. A split's pieces come in order."""
    known: dict[tuple[str, int], Split] = {}
    for batch in batches:
        for file, split, piece, *place in zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), batch.column("piece"), *[batch.column(c).to_pylist() for c in _PLACE], strict=True):
            own = known.get((file, split))
            if own is None:
                own = known[file, split] = Split(file, split, *place)
            at, piece = own.at, piece.as_py()
            own.at = at + len(piece) + len(MAGIC)
            yield own, at - len(MAGIC) if at else None, piece


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate's offset and the first offset beyond its split that the chain from it comes to."""
    links: dict[Split, dict[int, int]] = {}
    heads: dict[Split, tuple[list, list]] = {}  # open headers: offsets, and (offset, length) once a length is known
    for own, offset, piece in _walk(batches):
        if offset is None:
            continue
        bare, sized = heads.setdefault(own, ([], []))
        if piece[1:3] == b"\r\n":
            bare.append(offset)
        if not bare and not sized:
            continue
        length, end = _fields(piece)
        if length is not None:
            sized += [(o, length) for o in bare]
            bare.clear()
        if end >= 0:
            links.setdefault(own, {}).update((o, offset + len(MAGIC) + end + 4 + n + 4) for o, n in sized)
            bare.clear()
            sized.clear()
    for own, (bare, sized) in heads.items():
        length, end = own.ahead
        if end is not None:
            sized += [(o, length) for o in bare if length is not None]
            links.setdefault(own, {}).update((o, end + 4 + n + 4) for o, n in sized)
    for own, steps in links.items():
        for offset in sorted(steps, reverse=True):
            steps[offset] = steps.get(steps[offset], steps[offset])
        at = sorted(steps)
        yield pa.RecordBatch.from_arrays([pa.array([own.file] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array([steps[o] for o in at], pa.int64())], ["file", "offset", "leave"])


def _cut(parts: bool):
    """Whole records, or (parts) the pieces of records that cross splits, by the offset where their record ends.

    A chain that stops before its file's end is an error.
    """
    names = ["file", "offset", "record"] if not parts else ["file", "stop", "offset", "record"]
    kinds = [pa.string(), pa.int64(), pa.binary()] if not parts else [pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def broken(file: str, offset: int) -> ValueError:
        return ValueError(f"{file}: no whole record begins at byte {offset}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        state: dict[Split, list] = {}
        for own, offset, piece in _walk(batches):
            file, now = own.file, state.get(own)
            if now is None:
                if own.entry is None:
                    raise broken(file, offset or 0)
                now = state[own] = [own.entry, None, None, None, [], 0]
            now[5] = len(piece) if offset is None else offset + len(MAGIC) + len(piece)
            if offset is None:
                continue
            wanted, begun, length, stop, held, after = now  # the next record's offset; the open record's offset, length, end and bytes; the next magic's offset
            if begun is None:
                if offset < wanted:
                    if parts:
                        rows.append((file, wanted, offset, MAGIC + piece))
                    continue
                if offset > wanted or piece[1:3] != b"\r\n":
                    raise broken(file, wanted)
                begun = offset
            held.append(MAGIC + piece)
            if stop is None:
                found, end = _fields(piece)
                length = found if length is None else length
                if end >= 0:
                    if length is None:
                        raise broken(file, begun)
                    wanted = stop = offset + len(MAGIC) + end + 4 + length + 4
            now[:4] = wanted, begun, length, stop
            if stop is not None and after >= stop - 4:
                if not parts:
                    rows.append((file, begun, b"".join(held)[: stop - begun]))
                    size += len(rows[-1][2])
                now[1:5] = None, None, None, []
            if size > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
                rows, size = [], 0
        for own, (wanted, begun, length, stop, held, after) in state.items():
            if begun is None:
                if wanted < after:
                    raise broken(own.file, wanted)
                continue
            if stop is None:
                more, end = own.ahead
                length = more if length is None else length
                if end is None or length is None:
                    raise broken(own.file, begun)
                stop = end + 4 + length + 4
            if stop - 4 > own.bytes:
                raise broken(own.file, begun)
            if parts:
                rows.append((own.file, stop, begun, b"".join(held)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
    return run


def _join_parts(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("offset")
    offset, stop = table.column("offset")[0].as_py(), key[1].as_py()
    whole = b"".join(x.as_py() for x in table.column("record"))
    return pa.table({"file": [key[0].as_py()], "offset": [offset], "record": [whole[: stop - offset] if stop >= 0 else whole]}, schema=pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record", pa.binary())]))


def splits_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, start, ahead_length, ahead_end, bytes, several): one row per split; several: its file has others."""
    leads = written(_pieces(spark, path).mapInArrow(_leads, "file string, split bigint, n bigint, length bigint, stop bigint"))
    file = Window.partitionBy("file")
    before = file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    later = file.orderBy(F.col("split").desc()).rowsBetween(Window.unboundedPreceding, -1)
    at = leads.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    at = at.withColumn("_l", F.last(F.when(F.col("length").isNotNull(), F.struct("split", F.col("length").alias("v"))), True).over(later))
    at = at.withColumn("_e", F.last(F.when(F.col("stop").isNotNull(), F.struct("split", (F.col("start") + F.col("stop")).alias("v"))), True).over(later))
    return written(at.select("file", "split", "start", F.when(F.col("_l.split") <= F.coalesce("_e.split", "_l.split"), F.col("_l.v")).alias("ahead_length"), F.col("_e.v").alias("ahead_end"), (F.sum("n").over(file) - len(MAGIC)).alias("bytes"), (F.count("*").over(file) > 1).alias("several")))


def _placed(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """The pieces with what is known of their split, in their order."""
    one = splits.select("file", "split", *_PLACE)
    pieces = _pieces(spark, path)
    if fits(one):
        return pieces.join(F.broadcast(one), ["file", "split"])
    pieces = pieces.withColumn("_i", F.monotonically_increasing_id()).repartition("file", "split")
    return pieces.join(one.hint("merge"), ["file", "split"]).sortWithinPartitions("file", "split", "_i").drop("_i")


def entered(spark: SparkSession, path: str, splits: DataFrame) -> DataFrame:
    """splits with entry: where the file's verified chain enters the split, or first goes on beyond it."""
    if not splits.where("several").limit(1).count():
        return splits.withColumn("entry", F.lit(0).cast("long"))
    hop = written(_placed(spark, path, splits.withColumn("entry", F.lit(0).cast("long"))).mapInArrow(_chain, "file string, offset bigint, leave bigint"))
    seen = written(hop.where("offset = 0").select("file", "offset"))
    known = seen.count()
    while True:
        onward = seen.join(hop, ["file", "offset"]).select("file", F.col("leave").alias("offset"))
        seen = written(seen.unionByName(onward).distinct())
        if (now := seen.count()) == known:
            break
        known = now
        hop = written(hop.alias("a").join(hop.alias("b"), F.expr("a.file = b.file and a.leave = b.offset"), "left").select("a.file", "a.offset", F.coalesce("b.leave", "a.leave").alias("leave")))
    # a split's first magic stands just before its start; both tables have about one row per split
    first = F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(F.col("start") - len(MAGIC))
    line = splits.select("file", first.alias("_at"), "split").unionByName(seen.select("file", F.col("offset").alias("_at"), F.lit(None).cast("long").alias("split")))
    after = Window.partitionBy("file").orderBy(F.col("_at").desc(), F.col("split").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("entry", F.min(F.when(F.col("split").isNull(), F.col("_at"))).over(after)).where("split is not null").select("file", "split", "entry")
    return written(splits.join(line, ["file", "split"]))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, type, record_id, uri, refers_to, payload_digest, payload) of every record that the chains reach.

    payload is the record's block after its HTTP header, if it has one. A header may hold the magic and
    may have any length. Records with equal ids are all read. Empty files give no rows.
    """
    splits = entered(spark, path, splits_of(spark, path))
    schema = "file string, offset bigint, record binary"
    records = _placed(spark, path, splits).mapInArrow(_cut(False), schema)
    if splits.where("several").limit(1).count():
        crossing = _placed(spark, path, splits).mapInArrow(_cut(True), "file string, stop bigint, offset bigint, record binary")
        records = records.unionByName(crossing.where("stop >= 0").groupBy("file", "stop").applyInArrow(_join_parts, schema))
    return records.mapInArrow(_parse, "file string, offset bigint, type string, record_id string, uri string, refers_to string, payload_digest string, payload binary")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ("warc-type", "warc-record-id", "warc-target-uri", "warc-refers-to", "warc-payload-digest")
    for batch in batches:
        columns: list[list] = [[] for _ in fields]
        payloads = []
        for record in batch.column("record"):
            record = record.as_py()
            end = record.index(b"\r\n\r\n")
            named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in record[:end].decode("utf-8", "replace").split("\r\n")[1:])}
            for column, f in zip(columns, fields, strict=True):
                column.append(named.get(f))
            block = record[end + 4 : end + 4 + int(named["content-length"])]
            payloads.append(block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("offset"), *[pa.array(c, pa.string()) for c in columns], pa.array(payloads, pa.binary())], ["file", "offset", "type", "record_id", "uri", "refers_to", "payload_digest", "payload"])


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Writes pages to an archive in the shared folder and reads it: key, payload_bytes, payload_digest, record_type, refers_to.

    Digest and size are taken from the payload that was read; for a revisit from that of its response.
    A null body is empty. A row without key is a response, and nothing refers to it. Rows that share a
    key are records of their own: each revisits the smallest smaller key that has its payload, and equal
    rows of the smallest key are all responses. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/archive"
    write_archive(pages, path, key, url, body)
    number = lambda c: F.regexp_extract(c, rf"{ENTRY}(-?\d*)>", 1)
    number = lambda c, f=number: F.when(f(c) != "", f(c).cast("long"))
    read = read_archive(spark, path).select(number(F.col("record_id")).alias("id"), "type", number(F.col("refers_to")).alias("refers_to"), F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"), "payload_digest")
    read = written(read)
    # a revisit's response has the id that it refers to and the payload that its own digest names
    source = read.where("type = 'response' and id is not null").select(F.col("id").alias("refers_to"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), F.col("bytes").alias("b"), F.col("digest").alias("d")).dropDuplicates(["refers_to", "payload_digest"])
    again = lookup(read.where("type = 'revisit'"), source, ["refers_to", "payload_digest"])
    kinds = lambda bytes_, digest: (F.col("id").alias(key), F.col(bytes_).alias("payload_bytes"), F.col(digest).alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return read.where("type <> 'revisit'").select(*kinds("bytes", "digest")).unionByName(again.select(*kinds("b", "d")))
