"""Page chunks of long documents: planning, progress, resume and execution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import nonblank, strip

FALLBACK_ENGINES = ("pymupdf", "skip", "failed")
#: Fixed value: a line that heads the references of a paged text.
REFERENCES_LINE = r"(?dimU)^\\s*(?:(?:\\d+[\\.\\s]+)?references|(?:\\d+[\\.\\s]+)?bibliography|参考文献)\\s*$"


def body_end(pages: DataFrame) -> DataFrame:
    """doc_id, total_pages, body_end, used_pages from (doc_id, page_no, text).

    References are looked for from 35 % of the pages on; at page 1 they don't cut.
    """
    sized = pages.groupBy("doc_id").agg(F.max("page_no").cast("int").alias("total_pages"))
    heads = pages.select("doc_id", "page_no", "text").join(sized, "doc_id").filter(f"page_no >= greatest(1, cast(floor(total_pages * 0.35) as int)) and rlike(text, '{REFERENCES_LINE}')")
    first = heads.groupBy("doc_id").agg(F.min("page_no").cast("int").alias("at"))
    ended = sized.join(first, "doc_id", "left").withColumn("body_end", F.expr("case when at > 1 then at - 1 end"))
    return ended.selectExpr("doc_id", "total_pages", "body_end", "case when body_end < total_pages then body_end else total_pages end as used_pages")


def plan(docs: DataFrame, chunk_pages: int = 4) -> DataFrame:
    """doc_id, chunk_id, start_page, end_page from (doc_id, total_pages)."""
    starts = docs.filter("total_pages >= 1").select("doc_id", "total_pages", F.posexplode(F.expr(f"sequence(1, total_pages, {chunk_pages})")).alias("k", "start_page"))
    ended = starts.withColumn("end_page", F.expr(f"least(start_page + {chunk_pages} - 1, total_pages)"))
    return ended.selectExpr("doc_id", "format_string('chunk_%03d_p%03d-p%03d', k + 1, start_page, end_page) as chunk_id", "start_page", "end_page")


def choose_engine(pages: str, engine: str = "auto", large: int = 8) -> str:
    """SQL: how a document of so many pages is converted."""
    return f"'{engine}'" if engine != "auto" else f"case when {pages} > {large} then 'marker-chunked' else 'marker' end"


def progress(planned: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their state, and totals per document.

    ``status``: doc_id, chunk_id, state, engine, error, source_md_size. Output on
    disk means completed, whatever the state says.
    """
    done = "coalesce(source_md_size, 0) > 0"
    rows = planned.join(status, ["doc_id", "chunk_id"], "left").selectExpr(
        "doc_id", "chunk_id", "start_page", "end_page", f"case when {done} then 'completed' else coalesce(nullif(state, ''), 'pending') end as state", f"coalesce(nullif(engine, ''), case when {done} then 'marker' end) as engine", "error"
    )
    known = "('completed', 'failed', 'running')"
    totals = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in ("completed", "failed", "running")], F.count_if(F.expr(f"state not in {known}")).alias("pending"))
    return rows, totals


def summarize(totals: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, summary: one line of totals and up to five running chunks."""
    active = rows.filter("state = 'running'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.expr("concat(chunk_id, ':', coalesce(engine, '-'))"))).alias("a"))
    more = "case when size(a) > 0 then concat(' active=', array_join(slice(a, 1, 5), ','), case when size(a) > 5 then concat(' active_more=', size(a) - 5) else '' end) else '' end"
    return totals.join(active, "doc_id", "left").selectExpr("doc_id", f"concat('total=', total, ' completed=', completed, ' running=', running, ' pending=', pending, ' failed=', failed, {more}) as summary")


def valid_plans(planned: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, valid: ranges in order and inside, and every page covered (overlaps are fine)."""
    known = planned.join(docs.select("doc_id", "total_pages"), "doc_id")
    inside = "chunk_id is not null and 1 <= start_page and start_page <= end_page and end_page <= total_pages"
    ok = known.groupBy("doc_id").agg(F.expr(f"every(coalesce({inside}, false))").alias("inside"), F.max("total_pages").alias("total_pages"))
    pages = known.filter(inside).select("doc_id", F.explode(F.sequence("start_page", "end_page")).alias("p")).groupBy("doc_id").agg(F.countDistinct("p").alias("covered"))
    return ok.join(pages, "doc_id", "left").selectExpr("doc_id", "inside and coalesce(covered, 0) = total_pages as valid")


def todo(planned: DataFrame, status: DataFrame, retry_fallback: bool = False) -> DataFrame:
    """Chunks still to run: those without output, and with ``retry_fallback`` those a fallback made."""
    again = f"engine in ({', '.join(repr(e) for e in FALLBACK_ENGINES)})" if retry_fallback else "false"
    settled = status.filter(f"coalesce(source_md_size, 0) > 0 and not coalesce({again}, false)")
    return planned.join(settled.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")


def execute(chunks: DataFrame, convert: Callable[[dict], str], fallback: Callable[[dict], str] | None = None, on_error: str = "fallback") -> DataFrame:
    """Run ``convert`` on each chunk row: doc_id, chunk_id, state, engine, error, md.

    A failure goes to ``fallback``, or gives empty output (``skip``) or a failed
    row (``fail``); Spark repeats a lost task.
    """
    if on_error not in ("fallback", "skip", "fail"):
        raise ValueError(f"unknown error mode: {on_error}")

    def one(row: dict) -> tuple:
        try:
            md = convert(row)
            if not md or not md.strip():
                raise ValueError("empty output")
            return "completed", "marker", None, md
        except Exception as e:  # noqa: BLE001  a converter may fail in any way
            if on_error == "skip":
                return "completed", "skip", str(e), ""
            if on_error == "fallback" and fallback is not None:
                try:
                    return "completed", "pymupdf", str(e), fallback(row)
                except Exception as f:  # noqa: BLE001
                    return "failed", "failed", f"{e}; {f}", None
            return "failed", "failed", str(e), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([one(r) for r in batch.to_dict("records")], columns=["state", "engine", "error", "md"])
            yield pd.concat([batch[["doc_id", "chunk_id"]].reset_index(drop=True), out], axis=1)

    return chunks.mapInPandas(run, "doc_id long, chunk_id string, state string, engine string, error string, md string")


def captions(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, caption: each page's first line that looks like a table's caption."""
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")).alias("k", "line")).withColumn("line", F.expr(strip("line")))
    heads = lines.filter("rlike(line, '(?iU)^(Table|表)\\\\s*\\\\d+[.:：]')")
    return heads.groupBy("doc_id", "page_no").agg(F.expr("left(min_by(line, k), 200)").alias("caption"))


def table_boxes(boxes: DataFrame, page_offset: int = 0, min_width: float = 30, min_height: float = 15, folder: str = "assets/tables") -> DataFrame:
    """Drop slivers, number the rest by page and name their pictures. ``boxes``: doc_id, page, k, bbox."""
    from pyspark.sql import Window as W

    kept = boxes.filter(f"bbox[2] - bbox[0] >= {min_width} and bbox[3] - bbox[1] >= {min_height}").withColumn("page", F.col("page") + page_offset)
    numbered = kept.withColumn("idx", F.row_number().over(W.partitionBy("doc_id", "page").orderBy("k")))
    return numbered.selectExpr("doc_id", "page", "idx", f"concat('{folder}/', format_string('table_p%03d_%02d.png', page, idx)) as rel_path", "bbox")


def pages_with_text(pages: DataFrame) -> DataFrame:
    return pages.filter(nonblank("text"))
