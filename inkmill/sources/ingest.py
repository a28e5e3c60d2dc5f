"""Inputs: kinds of paths and URLs, readers, names; Parquet and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.text import unix_newlines

_ARXIV = r"(\\d{4}\\.\\d{4,5})(v\\d+)?"


def path_kind(path: str) -> str:
    """SQL: pdf, html or markdown by the path's suffix; null for others."""
    s = f"lower(regexp_extract({path}, '(\\\\.[^./]+)$', 1))"
    return f"case when {s} = '.pdf' then 'pdf' when {s} in ('.html', '.htm') then 'html' when {s} in ('.md', '.markdown') then 'markdown' end"


def url_parts(url: str) -> tuple[str, str]:
    """SQL for the host (with port) and the path of a URL; both empty without a scheme."""
    rest = f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', {{}})"
    return rest.format(1), rest.format(2)


def classify_urls(urls: DataFrame, column: str = "url") -> DataFrame:
    """Adds kind (arxiv, pdf, html, or null without a scheme), arxiv_id and candidates to fetch, in order."""
    host, path = url_parts(column)
    arxiv = f"nullif(regexp_extract({column}, '{_ARXIV}', 1), '')"
    rows = urls.withColumn("arxiv_id", F.expr(f"case when contains(lower({host}), 'arxiv.org') then {arxiv} end"))
    kind = f"case when {host} = '' then null when arxiv_id is not null then 'arxiv' when endswith(lower({path}), '.pdf') then 'pdf' else 'html' end"
    tries = f"""case when arxiv_id is not null then array(concat('https://arxiv.org/html/', arxiv_id), concat('https://ar5iv.labs.arxiv.org/html/', arxiv_id), concat('https://arxiv.org/pdf/', arxiv_id, '.pdf'))
      when {host} <> '' then array({column}) else cast(array() as array<string>) end"""
    return rows.withColumn("kind", F.expr(kind)).withColumn("candidates", F.expr(tries))


def sanitize_filename(sql: str) -> str:
    return f"coalesce(nullif(trim(both '_' from regexp_replace({sql}, '[^\\\\p{{L}}\\\\p{{N}}_.\\\\-]+', '_')), ''), 'download')"


def url_stem(url: str) -> str:
    """SQL: the stem of the last path part, else the host with underscores, else ``paper``."""
    host, path = url_parts(url)
    name = f"regexp_extract({path}, '([^/]+)/*$', 1)"
    stem = f"regexp_replace({name}, '(?<=[^.])\\\\.[^.]+$', '')"
    return f"coalesce(nullif({stem}, ''), nullif(replace({host}, '.', '_'), ''), 'paper')"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """uri, md: one row per file, with line ends as ``\\n``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("md"))
    return files.withColumn("md", F.expr(unix_newlines("md")))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """uri, kind, content: for converters that are plugged in."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), "content")
    return files.withColumn("kind", F.expr(path_kind("uri")))


def write_stage(df: DataFrame, folder: str, name: str) -> None:
    """One stage as Parquet; the commit makes it visible as a whole."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_json(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").json(f"{folder}/{name}.json")
