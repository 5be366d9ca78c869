"""Files in and out: catalogues, front matter, JSON content, uploads, logs, CSV and parquet sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed
from quire.functions import text as T
from quire.session import scratch  # noqa: F401

USAGE_SCHEMA = ("at timestamp, feature string, connection string, kind string, model string, ms double, "
                "ok boolean, tokensIn bigint, tokensOut bigint, error string")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with one list of sources."""
    return spark.read.json(path, multiLine=True).select(F.explode("sources").alias("s")).select("s.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def source_catalogue(catalogue: DataFrame, front: DataFrame) -> DataFrame:
    """The catalogue's own fields, and the file's front matter where it has none."""
    c, f = catalogue.alias("c"), front.alias("f")
    pick = lambda name: F.coalesce(F.col(f"c.{name}"), F.col(f"f.{name}")).alias(name)
    return c.join(f, "id", "left").select(
        "id", "c.short", "c.kind", pick("title"), pick("publisher"), pick("url"),
        F.substring(F.coalesce("c.updated", "f.updated"), 1, 10).alias("updated"),
        F.concat(F.lit("/reference/"), "id", F.lit("/")).alias("route"))


def front_matter(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(document, key, value) of the header between --- lines; the last of a repeated key counts."""
    head = F.split(F.regexp_extract(text, r"^---\n([\s\S]*?)\n---\n", 1), "\n")
    pair = F.transform(F.filter(head, lambda l: F.instr(l, ":") > 1), lambda l: F.struct(
        T.strip(F.substring_index(l, ":", 1)).alias("key"),
        T.strip(F.substring(l, F.instr(l, ":") + 1, F.length(l))).alias("value")))
    rows = docs.select(doc, pair.alias("p"))
    last = F.filter("p", lambda e, i: F.size(F.filter(F.slice("p", i + 2, F.size("p")), lambda o: o.key == e.key)) == 0)
    return rows.select(doc, F.inline(last))


def body_text(text: Column) -> Column:
    return F.regexp_replace(text, r"^---\n[\s\S]*?\n---\n", "")


def checklist_items(lists: DataFrame) -> DataFrame:
    """Checklists nested as groups of items, one row per item."""
    groups = lists.select(F.col("id").alias("list"), F.explode("groups").alias("g"))
    return groups.select("list", F.col("g.title").alias("group"), F.inline("g.items"))


def question_options(flow: DataFrame) -> DataFrame:
    """A map of questions to their options, one row per option."""
    q = flow.select(F.explode("questions").alias("question", "q"))
    return q.select("question", F.inline("q.options"))


# File endings taken and the type of each.
ACCEPTED = {".docx": "docx", ".pptx": "pptx", ".md": "md", ".markdown": "md", ".txt": "txt"}


def admission(uploads: DataFrame, max_bytes: int = fixed.MAX_BYTES, min_chars: int = fixed.MIN_CHARS,
              max_chars: int = fixed.MAX_CHARS) -> DataFrame:
    """Adds the type and the verdict on each upload (name, bytes, characters); the first reason wins."""
    ext = F.lower(F.regexp_extract(T.clean_name(F.col("name")), r"\.[A-Za-z0-9]+$", 0))
    kind = F.coalesce(*[F.when(ext == e, t) for e, t in ACCEPTED.items()])
    verdict = (
        F.when(F.col("bytes") == 0, "empty").when(F.col("bytes") > max_bytes, "too big")
        .when(kind.isNull(), "wrong type").when(F.col("characters") < min_chars, "too short")
        .when(F.col("characters") > max_chars, "too long").otherwise("accepted"))
    return uploads.withColumn("type", F.coalesce(kind, F.lit(""))).withColumn("verdict", verdict)


def decode_text(data: Column) -> Column:
    """Bytes to text: UTF-16 by its mark, else UTF-8, else the Western European code page."""
    first = F.hex(F.substring(data, 1, 2))
    rest = F.substring(data, 3, F.length(data))
    plain = data.cast("string")
    control = "".join(map(chr, range(0x80, 0xA0)))
    western = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))
    return (
        F.when(first == "FFFE", F.decode(rest, "UTF-16LE"))
        .when(first == "FEFF", F.decode(rest, "UTF-16BE"))
        .when(F.is_valid_utf8(plain), F.regexp_replace(plain, "^﻿", ""))
        .otherwise(F.translate(F.decode(data, "ISO-8859-1"), control, western))
    )


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USAGE_SCHEMA).json(path)


def stream_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(USAGE_SCHEMA).json(path)


def append_usage(entries: DataFrame, path: str) -> None:
    """Call records as JSON lines."""
    entries.write.mode("append").json(path)


def write_timetable_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """RFC 4180: header, CRLF, quotes only where needed and doubled inside."""
    rows.write.csv(path, compression=compression, header=True, lineSep="\r\n", escape='"', emptyValue="", nullValue="")


def write_milestone_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Every field quoted."""
    rows.write.csv(path, compression=compression, header=True, lineSep="\r\n", escape='"', quoteAll=True)


def write_corpus(chunks: DataFrame, path: str, by: str = "kind") -> DataFrame:
    """Chunks as parquet, one folder per kind; returns the rows per kind."""
    chunks.write.partitionBy(by).parquet(path)
    return chunks.sparkSession.read.parquet(path).groupBy(by).agg(F.count("*").alias("chunks"))


def write_reports(results: DataFrame, path: str, run: str = "run") -> None:
    results.write.partitionBy(run).json(path)


def snapshot_diff(new: DataFrame, old: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, change) between two copies; only hashes of the text are shuffled."""
    a = new.select(key, T.sha256(F.col(text)).alias("new"))
    b = old.select(key, T.sha256(F.col(text)).alias("old"))
    change = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
              .when(F.col("old") == F.col("new"), "same").otherwise("updated"))
    return a.join(b, key, "full").select(key, change.alias("change"))
