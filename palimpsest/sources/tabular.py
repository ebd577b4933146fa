"""Sources and sinks: tables of unknown columns, declared datasets, extraction from markup, interchange documents, change logs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"bool": T.BooleanType(), "i64": T.LongType(), "f64": T.DoubleType(), "text": T.StringType(), "bytes": T.BinaryType(), "timestamp": T.TimestampType(), "json": T.StringType()}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header names, every column a nullable string (quoted line breaks allowed), plus ``__row`` numbered from 0 in file order."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return numbered(df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Keys of all objects as nullable strings, nested values as JSON text, plus ``__row``."""
    df = spark.read.json(path, multiLine=True)
    text = lambda f: F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`").cast("string")
    return numbered(df.select(*(text(f).alias(f.name) for f in df.schema.fields)))


def numbered(df: DataFrame) -> DataFrame:
    """Consecutive ``__row`` from 0: places inside partitions plus offsets from one small count per partition."""
    parts = df.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    sizes = parts.groupBy("_p").agg(F.count("*").alias("n"), F.min("_k").alias("low"))
    starts = sizes.select("_p", "low", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("start"))  # one row per partition
    return parts.join(F.broadcast(starts), "_p").withColumn("__row", F.col("start") + F.col("_k") - F.col("low")).drop("_p", "_k", "low", "start")


def dataset_schema(columns: list[tuple[str, str, bool]]) -> T.StructType:
    """A declared schema from (name, type, nullable); names must already be fit identifiers."""
    for name, kind, _ in columns:
        if not re.fullmatch(r"[a-z0-9_]{1,63}", name):
            raise ValueError(f"{name!r} is no fit column name")
        if kind not in TYPES:
            raise ValueError(f"{kind!r} is none of {', '.join(TYPES)}")
    return T.StructType([T.StructField(n, TYPES[k], null) for n, k, null in columns])


def validated(rows: DataFrame, schema: T.StructType, column: str = "row") -> DataFrame:
    """Parse JSON rows against a schema: the columns, and ``violations``: what is unknown, missing or null where it may not be."""
    names = [f.name for f in schema.fields]
    keys = F.map_keys(F.from_json(column, "map<string,string>"))
    parsed = F.from_json(column, T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]))
    unknown = F.transform(F.array_except(keys, F.array(*(F.lit(n) for n in names))), lambda k: F.concat(F.lit("unknown "), k))
    needed = [F.when(F.col("_r").isNull() | F.col(f"_r.{f.name}").isNull(), F.lit(f"missing {f.name}")) for f in schema.fields if not f.nullable]
    broken = F.when(keys.isNull(), F.array(F.lit("no object"))).otherwise(F.concat(F.coalesce(unknown, F.array().cast("array<string>")), F.filter(F.array(*needed), lambda x: x.isNotNull()) if needed else F.array().cast("array<string>")))
    return rows.withColumn("_r", parsed).withColumn("violations", broken).select(*(F.col(f"_r.{n}").alias(n) for n in names), "violations")


def query_dataset(spark: SparkSession, df: DataFrame, where: str, args: dict, limit: int = 1000) -> DataFrame:
    """Rows of a dataset that fit a caller's condition with bound parameters, at most 1000."""
    return spark.sql(f"SELECT * FROM {{data}} WHERE {where} LIMIT {min(limit, 1000)}", args=args, data=df)


def row_key(*columns: str):
    """Canonical JSON of a composite key, for link tables."""
    return F.to_json(F.struct(*columns))


def detect_format(name: str | None, content: str) -> str:
    """By the file name's ending, else by the look of the content."""
    ends = {"md": "markdown", "markdown": "markdown", "json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "html": "html", "htm": "html", "pdf": "pdf", "txt": "text"}
    ends |= {e: "code" for e in "py rs ts js go java c cpp h rb sh sql toml yaml yml".split()}
    if name and "." in name and name.rsplit(".", 1)[1].lower() in ends:
        return ends[name.rsplit(".", 1)[1].lower()]
    head = content.lstrip()[:400]
    if head.startswith(("{", "[")):
        try:
            json.loads(content)
            return "json"
        except ValueError:
            pass
    if re.match(r"(?i)<!doctype html|<html|<(?:head|body|div|p|h1)\b", head):
        return "html"
    if head.startswith("%PDF"):
        return "pdf"
    if re.search(r"(?m)^(#{1,6} |[-*] |```|> )", head):
        return "markdown"
    lines = [x for x in head.splitlines() if x][:4]
    if len(lines) > 1 and len({x.count(",") for x in lines}) == 1 and lines[0].count(",") > 0:
        return "csv"
    return "text"


def markdown_parts(text):
    """Columns (headings, links, plain) of a Markdown column, by expressions."""
    headings = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6} +(.+?) *$"), F.lit(1))
    links = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?m)^#{1,6} +", ""), r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_]{1,3}([^*_\n]+)[*_]{1,3}", "$1"), r"(?m)^\s*[-*+] +", "")
    return headings, links, plain


class _Html(HTMLParser):
    SKIP, BLOCK = {"script", "style", "head"}, {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.headings, self.text, self.open, self.skip = "", [], [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "title" or re.fullmatch("h[1-6]", tag):
            self.open = (tag, [])
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BLOCK:
            self.text.append("\n")

    def handle_endtag(self, tag):
        if self.open and tag == self.open[0]:
            words = " ".join("".join(self.open[1]).split())
            if tag == "title":
                self.title = words
            elif words:
                self.headings.append(words)
            self.open = None
        if tag in self.SKIP and self.skip:
            self.skip -= 1
        if tag in self.BLOCK:
            self.text.append("\n")

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)
        if not self.skip:
            self.text.append(data)


def html_parts(html: str | None) -> tuple[str, list[str], str]:
    """(title, headings, text): scripts and styles left out, entities resolved, blank lines folded; the first heading stands in for a title."""
    p = _Html()
    p.feed(html or "")
    lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
    return p.title or (p.headings[0] if p.headings else ""), p.headings, "\n".join(x for x in lines if x)


def extract_html(pages: DataFrame, key: str, column: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [html_parts(h) for h in b[column]]
            yield pd.DataFrame({key: b[key], "title": [x[0] for x in parts], "headings": [x[1] for x in parts], "body": [x[2] for x in parts]})

    return pages.select(key, column).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, title string, headings array<string>, body string")


def flatten_json(text: str | None) -> list[str]:
    """``key.path: value`` lines of a JSON text at any depth; a text that is no JSON gives none."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return []
    out: list[str] = []
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{path}.{k}" if path else str(k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{path}[{k}]", x) for k, x in reversed(list(enumerate(v)))]
        else:
            out.append(f"{path}: {'' if v is None else v if isinstance(v, str) else json.dumps(v)}")
    return out


def flattened(documents: DataFrame, key: str, column: str) -> DataFrame:
    """Rows ``(key, line_no, line)`` of every JSON document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, line) for k, t in zip(b[key], b[column]) for n, line in enumerate(flatten_json(t))]
            yield pd.DataFrame(rows, columns=[key, "line_no", "line"])

    return documents.select(key, column).mapInPandas(run, f"{key} {documents.schema[key].dataType.simpleString()}, line_no int, line string")


def scan_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modified, sha256, extension)`` of the files under a folder; contents are hashed where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return f.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"))


INTERCHANGE = "id string, user_id string, content string, type string, importance double, created_at string, tags array<string>, entities array<struct<text:string,type:string>>, related array<string>"


def export_interchange(memories: DataFrame) -> DataFrame:
    """One JSON document ``document`` per memory in the interchange form; nulls are left out of it."""
    entities = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type")))
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = F.struct("id", "user_id", "content", F.col("experience_type").alias("type"), F.col("importance").cast("double").alias("importance"), stamp.alias("created_at"), "tags", entities.alias("entities"), F.col("relations.related_memories").alias("related"))
    return memories.select("id", F.to_json(fields).alias("document"))


def import_interchange(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Parsed documents whose content is not yet ``known`` (by SHA-256), each content once (the smallest id); unreadable ones are left out."""
    d = documents.select(F.from_json("document", INTERCHANGE).alias("d")).select("d.*").where("id is not null")
    d = d.withColumn("content_hash", F.sha2("content", 256)).withColumn("created_at", F.try_to_timestamp("created_at"))
    # The smallest id of each content is found by an aggregation; documents without content have no copies.
    first = d.where("content is not null").groupBy("content_hash").agg(F.min("id").alias("id"))
    d = d.where("content is not null").join(first, ["content_hash", "id"], "left_semi").dropDuplicates(["content_hash"]).unionByName(d.where("content is null"))
    return d.join(known.select(F.sha2("content", 256).alias("content_hash")).where("content_hash is not null").distinct(), "content_hash", "left_anti")


def import_foreign(rows: DataFrame, kind: str, column: str = "document") -> DataFrame:
    """Rows of another store's export as ``(content, user_id, created_at, tags)``: 'flat' JSON records, or 'generic' ones with other key names."""
    pick = lambda *keys: F.coalesce(*(F.get_json_object(column, f"$.{k}") for k in keys))
    keys = {"flat": (("memory",), ("user_id",), ("created_at",)), "generic": (("content", "text", "body", "note"), ("user_id", "user", "owner"), ("created_at", "timestamp", "date"))}[kind]
    tags = F.coalesce(F.from_json(F.get_json_object(column, "$.tags"), "array<string>"), F.from_json(F.get_json_object(column, "$.categories"), "array<string>"))
    return rows.select(pick(*keys[0]).alias("content"), pick(*keys[1]).alias("user_id"), F.try_to_timestamp(pick(*keys[2])).alias("created_at"), tags.alias("tags")).where("content is not null")


def latest_of_log(log: DataFrame, key: str, lsn: str, upto: int | None = None) -> DataFrame:
    """Replay of an append-only log: each key's last record up to a log number; keys whose last record is a removal are gone."""
    kept = log if upto is None else log.where(F.col(lsn) <= upto)
    rest = [c for c in log.columns if c != key]
    last = kept.groupBy(key).agg(F.max_by(F.struct(*rest), lsn).alias("r"))
    return last.select(key, *(F.col(f"r.{c}") for c in rest)).where("op <> 'forget'")


def snapshot(df: DataFrame, path: str) -> str:
    """Write a table and return a checksum of its rows that does not depend on their order."""
    df.write.mode("overwrite").parquet(path)
    return fingerprint(df.sparkSession.read.parquet(path))


def fingerprint(df: DataFrame) -> str:
    row = F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns))
    got = df.agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1_000_003))).alias("s")).first()
    return f"{got['n']}-{got['x'] or 0}-{got['s'] or 0}"


def restore(spark: SparkSession, path: str, checksum: str) -> DataFrame:
    df = spark.read.parquet(path)
    if fingerprint(df) != checksum:
        raise ValueError(f"{path} does not have the checksum {checksum}")
    return df
