"""Files as sources and sinks, all through Spark's readers and writers, so that any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of the old schema and what they are here.
TYPES = {
    "VARCHAR": "string", "TEXT": "string", "UUID": "string", "INTEGER": "int", "BIGINT": "bigint", "BIGSERIAL": "bigint", "BOOLEAN": "boolean",
    "DOUBLE": "double", "REAL": "float", "TIMESTAMP": "timestamp_ntz", "TIMESTAMPTZ": "timestamp", "DATE": "date", "JSON": "string", "JSONB": "string", "BLOB": "binary",
}


def spark_type(name: str) -> str:
    """The Spark type of a column type, arrays included; text for an unknown one."""
    name = name.strip().upper()
    return f"array<{spark_type(name[:-2])}>" if name.endswith("[]") else TYPES.get(name.split("(")[0], "string")


def coerced(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """The named columns with their types; what can't be cast is null."""
    return df.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()])


def shared_folder(spark: SparkSession) -> str:
    """A new path in the checkpoint folder, which driver and executors share; a folder is made only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
        base = context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/files/{uuid.uuid4().hex}"


def _stem(c):
    return F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", "")


def paired(texts: DataFrame, notes: DataFrame, path: str = "path", stem: str | None = None) -> DataFrame:
    """(stem, the columns of both): texts and notes whose paths have one stem; both must be there and the note's id not empty.

    A stem is the file's name without its extension, or what the first group of the pattern `stem` matches in the path.
    """
    key = _stem(F.col(path)) if stem is None else F.regexp_extract(path, stem, 1)
    named = lambda df: df.select(key.alias("stem"), *[c for c in df.columns if c != path])
    return named(texts).join(named(notes).where("id is not null and id <> ''"), "stem")


def admitted(files: DataFrame, suffixes: Sequence[str], most_bytes: int, seen: DataFrame | None = None) -> DataFrame:
    """(path, length, hash) of files (path, length, content) with one of the suffixes, not too large, whose content isn't among the seen hashes."""
    fits = F.lit(False)
    for suffix in suffixes:
        fits = fits | F.lower("path").endswith(suffix.lower())
    hashed = files.where(fits & (F.col("length") <= most_bytes)).select("path", "length", F.sha2("content", 256).alias("hash"))
    return hashed if seen is None else hashed.join(seen.select("hash"), "hash", "left_anti").select("path", "length", "hash")


def documents_with_sidecars(spark: SparkSession, folder: str, schema: str = "id string, title string, medium string", kind: str = "*.md", stem: str | None = None) -> DataFrame:
    """Text files of a kind and their JSON sidecars anywhere below a folder, as paired() joins them."""
    path = F.col("_metadata.file_path").alias("path")
    below = spark.read.option("recursiveFileLookup", True)
    texts = below.option("pathGlobFilter", kind).text(folder, wholetext=True).select(path, F.col("value").alias("text"))
    notes = spark.read.option("recursiveFileLookup", True).schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).select(path, "*")
    return paired(texts, notes, stem=stem)


def shelved(df: DataFrame, shelf: str, order: str, text: str, folder: str) -> None:
    """Writes the texts as lines of one file a shelf, `<folder>/<shelf>=<value>/...txt`, in order; a null text is an empty line.

    A shelf is written by one task: it must be small, as a range of ids is.
    """
    df.repartition(shelf).sortWithinPartitions(shelf, order).select(shelf, F.col(text).alias("value")).write.partitionBy(shelf).text(folder)


def needs(spark: SparkSession, folder: str, most: int = 10) -> DataFrame:
    """(topic, reason): the needs in JSON files (topic, reason, subtopics), each with its first subtopics as needs of their own; blank ones are left out."""
    rows = spark.read.schema("topic string, reason string, subtopics array<string>").json(folder)
    topic = F.coalesce("topic", F.lit(""))
    subs = F.transform(F.slice(F.coalesce("subtopics", F.array().cast("array<string>")), 1, most), lambda x: F.struct(F.trim(x).alias("topic"), F.concat(F.lit("subtopic of "), topic).alias("reason")))
    every = F.concat(F.array(F.struct(F.trim(topic).alias("topic"), F.col("reason").alias("reason"))), subs)
    return rows.select(F.explode(every).alias("x")).select("x.topic", "x.reason").where("topic <> ''")


def folder_scan(spark: SparkSession, folder: str, suffixes: Sequence[str], most_bytes: int, seen: DataFrame | None = None) -> DataFrame:
    """The admitted() files below folder."""
    return admitted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), suffixes, most_bytes, seen)


def source_items(df: DataFrame, source_type: str, external_id: str, title: str) -> DataFrame:
    """Any feed as (source_type, external_id, title)."""
    return df.select(F.lit(source_type).alias("source_type"), F.col(external_id).cast("string").alias("external_id"), F.col(title).alias("title"))


def new_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """One tick of a feed: items (source_type, external_id, ...) that were not seen; of an item that stands there twice one."""
    key = ["source_type", "external_id"]
    return items.join(seen.select(*key), key, "left_anti").dropDuplicates(key)


def gold(spark: SparkSession, glob: str, schema: str = "pair_id string, label string") -> DataFrame:
    """JSON lines of several files; blank and unlabelled rows are left out, of equal pairs the last file's stays."""
    rows = spark.read.schema(schema).json(glob).withColumn("_f", F.col("_metadata.file_path")).where("pair_id is not null and label is not null")
    columns = [c for c in rows.columns if c not in ("pair_id", "_f")]
    return rows.groupBy("pair_id").agg(F.max(F.struct("_f", *columns)).alias("x")).select("pair_id", *[f"x.{c}" for c in columns])


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_new(df: DataFrame, flag: str, path: str, when: str = "true") -> DataFrame:
    """Writes the rows whose flag is null and for which `when` holds; returns all rows, theirs with the flag set."""
    due = F.col(flag).isNull() & F.coalesce(F.expr(when), F.lit(False))
    df.where(due).drop(flag).write.mode("append").json(path)
    return df.withColumn(flag, F.when(due, F.lit(True)).otherwise(F.col(flag)))
