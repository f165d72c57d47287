"""Loading documents from files, text payloads and streams of events; bad input is an error row, never an exception."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.functions.text import line_count

# File types by suffix; fixed values.
TYPES = {
    ".txt": "plaintext", ".md": "markdown", ".markdown": "markdown", ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".log": "log", ".xml": "xml", ".html": "html", ".htm": "html",
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".sql": "sql",
}
ENCODINGS = ["utf-8", "gbk", "gb2312", "latin-1"]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), suffix(path))


def decoded(content: Column) -> Column:
    """STRUCT<text, encoding>: by the first encoding that fits; the last one always does."""

    @F.pandas_udf("text string, encoding string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch:
                row = (None, None)
                for e in ENCODINGS if b is not None else []:
                    try:
                        row = (bytes(b).decode(e), e)
                        break
                    except UnicodeDecodeError:
                        continue
                rows.append(row)
            yield pd.DataFrame(rows, columns=["text", "encoding"])

    return decode(content)


def load_documents(spark: SparkSession, path: str, max_chars: int = 500_000) -> DataFrame:
    """path, content, char_count, line_count, file_type, encoding_used, file_size_bytes, extension, error.

    Files of another suffix, of more than 4 * max_chars bytes or max_chars characters, or holding a zero character
    have an error and no content. A leading byte-order mark is taken off.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    kind = file_type(F.col("path"))
    early = F.when(kind.isNull(), "unsupported file type").when(F.col("length") > 4 * max_chars, "file too large")
    rows = files.withColumn("__error", early).withColumn("__d", decoded(F.when(F.col("__error").isNull(), F.col("content"))))
    text = F.regexp_replace("__d.text", r"^\x{feff}", "")
    late = F.coalesce(
        "__error", F.when(F.length(text) > max_chars, "too many characters").when(F.contains(text, F.lit("\x00")), "not a text file")
    )
    rows = rows.select("path", "length", "__d", text.alias("__text"), late.alias("error"))
    kept = F.when(F.col("error").isNull(), F.col("__text"))
    return rows.select(
        "path", kept.alias("content"), F.length(kept).alias("char_count"), line_count(kept).alias("line_count"),
        file_type(F.col("path")).alias("file_type"), F.when(F.col("error").isNull(), F.col("__d.encoding")).alias("encoding_used"),
        F.col("length").alias("file_size_bytes"), suffix(F.col("path")).alias("extension"), "error",
    )


def jsonp_body(payload: Column) -> Column:
    """What a JSONP callback wraps, or null."""
    return F.nullif(F.regexp_extract(payload, r"(?s)^\s*[\w.$]+\s*\((.*)\)\s*;?\s*$", 1), F.lit(""))


def html_links(html: Column) -> Column:
    """ARRAY<STRUCT<href, label>> of the links in headings and text."""
    hrefs = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    return F.zip_with(hrefs, labels, lambda h, t: F.struct(h.alias("href"), F.trim(F.regexp_replace(t, "<[^>]+>", "")).alias("label")))


def quote_fields(payload: Column) -> Column:
    """ARRAY<STRUCT<code, fields>> of payloads like: var name_code="a,b,...";"""
    codes = F.regexp_extract_all(payload, F.lit(r'var [\w]*?_([0-9a-zA-Z]+)="[^"]*"'), F.lit(1))
    values = F.regexp_extract_all(payload, F.lit(r'var [\w]*?_[0-9a-zA-Z]+="([^"]*)"'), F.lit(1))
    return F.zip_with(codes, values, lambda c, v: F.struct(c.alias("code"), F.split(v, ",").alias("fields")))


def sse_events(body: Column) -> Column:
    """ARRAY<STRUCT<id, event, data>> of a server-sent event stream; an event without a name is a message."""
    blocks = F.filter(F.split(F.regexp_replace(body, r"\r\n?", "\n"), r"\n\n+"), lambda b: F.length(F.trim(b)) > 0)

    def field(block: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(block, rf"(?m)^{name}: ?(.*)$", 1), F.lit(""))

    return F.transform(
        blocks,
        lambda b: F.struct(
            field(b, "id").alias("id"), F.coalesce(field(b, "event"), F.lit("message")).alias("event"),
            F.array_join(F.regexp_extract_all(b, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), "\n").alias("data"),
        ),
    )


def key_value_pairs(text: Column) -> Column:
    """MAP of ``name：value`` pairs of free text, names of one to six characters; of a repeated name the first counts."""
    names = F.regexp_extract_all(text, F.lit(r"([\p{IsHan}A-Za-z]{1,6})[:：]\s*[^\s,，;；。]+"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"[\p{IsHan}A-Za-z]{1,6}[:：]\s*([^\s,，;；。]+)"), F.lit(1))
    firsts = F.array_distinct(names)
    return F.map_from_arrays(firsts, F.transform(firsts, lambda n: F.get(values, (F.array_position(names, n) - 1).cast("int"))))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Rows added to a parquet table, of one directory per value of the partition columns."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """A table with the wanted columns and types; columns that its files don't have yet are null."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def log_records(df: DataFrame, level: str, event: str, message: str, context: list[str], data: list[str]) -> DataFrame:
    """One JSON text per row: level, event, message, context and data."""
    return df.select(
        F.to_json(
            F.struct(
                F.lit(level).alias("level"), F.lit(event).alias("event"), F.col(message).cast("string").alias("message"),
                F.struct(*context).alias("context"), F.struct(*data).alias("data"),
            )
        ).alias("record")
    )
