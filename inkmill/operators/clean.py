"""Text cleaning: string expressions and in-row array functions, without a shuffle.

A document is one row; its lines are an array inside it. Repeats within a
document are found by sorting its short lines, so nothing crosses rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import strip

#: CJK characters, and half-width marks with their full-width forms.
CJK = r"\\x{4e00}-\\x{9fff}"
FULL_WIDTH = {",": "，", ";": "；", ":": "：", "?": "？", "!": "！"}
TABLE_REMOVED = "<!-- table removed: rendered as image -->\n\n"
TABLES_BELOW = "<!-- tables rendered as images below -->"


def dehyphenate(sql: str) -> str:
    """Join words cut by a hyphen at a line end; drop blanks at line ends."""
    joined = f"regexp_replace({sql}, '([\\\\p{{L}}\\\\p{{N}}_])-\\\\n([\\\\p{{L}}\\\\p{{N}}_])', '$1$2')"
    return f"regexp_replace({joined}, '[ \\\\t]+\\\\n', '\\n')"


def _header_like(line: str) -> str:
    """A trimmed line that may be a running header."""
    return f"(length({line}) between 1 and 60 and not rlike({line}, '[.。!?？！:：]$') and not startswith({line}, '#') and not rlike({line}, '(?U)^\\\\d+\\\\.\\\\s'))"


def strip_repeating_headers(docs: DataFrame, column: str = "md") -> DataFrame:
    """Remove lines that, trimmed, are short, header-like and occur three times or more."""
    lines = docs.withColumn("__lines", F.expr(f"split({column}, '\\n')"))
    trimmed = lines.withColumn("__trimmed", F.expr(f"transform(__lines, l -> {strip('l')})"))
    often = trimmed.withColumn(
        "__often",
        F.expr(f"array_distinct(transform(array(sort_array(filter(__trimmed, l -> {_header_like('l')}))), s -> filter(s, (l, i) -> l = get(s, i - 1) and l = get(s, i - 2)))[0])"),
    )
    kept = F.expr(f"case when size(__often) = 0 then {column} else array_join(filter(__lines, (l, i) -> not array_contains(__often, __trimmed[i])), '\\n') end")
    return often.withColumn(column, kept).drop("__lines", "__trimmed", "__often")


def clean_text(docs: DataFrame, column: str = "md") -> DataFrame:
    """Dehyphenate, drop running headers, trim, end with a newline."""
    joined = docs.withColumn(column, F.expr(dehyphenate(column)))
    return strip_repeating_headers(joined, column).withColumn(column, F.expr(f"concat({strip(column)}, '\\n')"))


def compact_blank_lines(sql: str) -> str:
    return f"regexp_replace({sql}, '\\n{{3,}}', '\\n\\n')"


def _outside_fences(sql: str, change: str) -> str:
    """Apply ``change`` (SQL over ``l``) to lines outside fences that aren't table rows."""
    fence = f"startswith({strip('l')}, '```')"
    # places of fences, in pairs: what lies between is inside; the last pair ends the text
    places = f"filter(transform(ls, (l, i) -> case when {fence} then i end), i -> i is not null)"
    pairs = "transform(filter(fs, (f, k) -> k % 2 = 0), (f, k) -> struct(f as a, coalesce(get(fs, 2 * k + 1), size(ls)) as b))"
    spans = f"transform(array({places}), fs -> concat({pairs}, array(struct(size(ls) as a, size(ls) as b))))[0]"
    outside = f"transform(slice(ls, p + 1, greatest(0, s.a - p)), l -> case when rlike(l, '(?U)^\\\\s*\\\\|') then l else {change.replace('{l}', 'l')} end)"
    piece = f"transform(array(coalesce(get(ss, k - 1).b + 1, 0)), p -> concat({outside}, slice(ls, s.a + 1, s.b - s.a + 1)))[0]"
    return f"array_join(transform(array(split({sql}, '\\n')), ls -> transform(array({spans}), ss -> flatten(transform(ss, (s, k) -> {piece})))[0])[0], '\\n')"


def full_width_punctuation(sql: str) -> str:
    """Half-width marks after CJK become full-width before CJK, a space or the line's end."""
    change = "{l}"
    for half, full in FULL_WIDTH.items():
        mark = half if half in ",;:!" else f"\\\\{half}"
        change = f"regexp_replace({change}, '([{CJK}]){mark}(?=[{CJK} ])', '$1{full}')"
        change = f"regexp_replace({change}, '([{CJK}]){mark}\\\\z', '$1{full}')"
    change = f"regexp_replace({change}, '(?U)([{CJK}])\\\\.(?=\\\\s|\\\\z)', '$1。')"
    return _outside_fences(sql, change)


def space_cjk_alnum(sql: str) -> str:
    """A space between CJK characters and ASCII letters or digits."""
    change = f"regexp_replace(regexp_replace({{l}}, '([{CJK}])([A-Za-z0-9])', '$1 $2'), '([A-Za-z0-9])([{CJK}])', '$1 $2')"
    return _outside_fences(sql, change)


def rewrite_image_links(sql: str, prefix: str = "assets") -> str:
    """Put ``prefix/`` before bare or ``./`` image targets; leave the rest."""
    image = r"!\\[([^\\]]*)\\]\\((?U:\\s*)(?!https?:|data:|/|#|(?:\\./)?" + prefix + r"[/\\\\])(?:\\./)?([^)]*[^)\\s])(?U:\\s*)\\)"
    return f"regexp_replace({sql}, '{image}', '![$1]({prefix}/$2)')"


def prefix_chunk_links(sql: str, chunk: str) -> str:
    """Image targets of one chunk move below ``assets/<chunk>/``; ``chunk`` is SQL."""
    image = r"!\\[([^\\]]*)\\]\\((?U:\\s*)(?!https?:|data:|/)(?:\\./)?(?:assets/)?([^)]*[^)\\s])(?U:\\s*)\\)"
    return f"regexp_replace({sql}, '{image}', concat('![$1](assets/', {chunk}, '/$2)'))"


def table_block(caption: str, page: str, idx: str, path: str) -> str:
    """Markdown for a table's picture; arguments are SQL."""
    alt = strip(f"translate(coalesce(nullif({caption}, ''), concat('Table p', {page}, '-', {idx})), ']\\n', ') ')")
    return f"concat('\\n\\n![', {alt}, '](', {path}, ')\\n\\n')"


def inject_table_images(docs: DataFrame, tables: DataFrame, strip_tables) -> DataFrame:
    """Append pictures of tables by (page, idx); documents without any stay as they are.

    ``docs``: doc_id, md. ``tables``: doc_id, page, idx, rel_path, caption.
    ``strip_tables`` is a column function that removes Markdown tables, or None.
    """
    blocks = tables.select("doc_id", F.struct("page", "idx", F.expr(table_block("caption", "page", "idx", "rel_path")).alias("b")).alias("t"))
    per_doc = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    base = strip_tables(F.col("md")) if strip_tables else F.col("md")
    joined = docs.join(per_doc, "doc_id", "left").withColumn("base", base)
    text = F.expr(f"concat(regexp_replace(base, '(?U)\\\\s+$', ''), '\\n', '\\n\\n{TABLES_BELOW}', array_join(transform(ts, t -> t.b), ''), '\\n')")
    return joined.select("doc_id", F.when(F.col("ts").isNull(), F.col("md")).otherwise(text).alias("md"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk texts (doc_id, chunk_id, start_page, end_page, md) as one cleaned document."""
    block = f"concat('<!-- PDF_CHUNK ', chunk_id, ' pages=', start_page, '-', end_page, ' -->\\n\\n', {strip('md')})"
    parts = chunks.select("doc_id", F.struct("start_page", "chunk_id", F.expr(block).alias("b")).alias("c"))
    merged = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    return clean_text(merged.select("doc_id", F.expr("array_join(transform(cs, c -> c.b), '\\n\\n')").alias("md")))
