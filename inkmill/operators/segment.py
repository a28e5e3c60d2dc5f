"""Sections, paragraphs and packed segments, as arrays inside the document's row.

Nothing here shuffles: splitting, the sticky cutoff and the greedy fold are
array functions over one document; ``explode`` comes last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import nonblank, strip, strip_newlines

MIN_CHARS = 6000
MAX_CHARS = 10_000

#: Lines end at \\n and nowhere else (flag d). A heading of level 1 or 2 begins a section; deeper ones stay in its body.
_SECTION_START = r"(?dm)(?=^#{1,2}(?![#])(?U:\\s)(?<!\\n)[^\\n])"
_HEADING = r"^(#{1,2})(?U:\\s)+?([^\\n]+)"
#: Fixed value: a heading in a body at which references begin.
CUTOFF = r"(?dimU)^#{1,6}\\s*(references\\b.*|bibliography\\b.*|参考文献.*)\\s*$"


def split_sections(column: str = "md") -> str:
    """SQL: array of (section_idx, heading_level, heading_text, body)."""
    parts = f"split({column}, '{_SECTION_START}')"
    body = "case when i < size(p) - 1 then substr(x, 1, length(x) - 1) else x end"
    return f"""transform(array({parts}), p -> transform(p, (x, i) -> struct(
      i as section_idx, length(regexp_extract(x, '{_HEADING}', 1)) as heading_level,
      {strip(f"regexp_extract(x, '{_HEADING}', 2)")} as heading_text, {body} as body)))[0]"""


def is_references(heading: str) -> str:
    h = f"lower({strip(heading)})"
    return f"({h} = '参考文献' or startswith({h}, 'references') or startswith({h}, 'bibliography'))"


def paragraphs(body: str) -> str:
    """SQL: non-blank paragraphs, split at blank lines."""
    return f"filter(transform(split({body}, '\\n{{2,}}'), p -> {strip_newlines('p')}), p -> {nonblank('p')})"


def pack(array: str, low: int = MIN_CHARS, high: int = MAX_CHARS) -> str:
    """SQL: greedy fold of paragraphs into chunks.

    State: finished chunks, open chunk (null if empty), its counted length. A
    paragraph that begins a chunk after a full one counts without separator.
    """
    done = "case when a.buf is null then a.out else array_append(a.out, a.buf) end"
    step = f"""case
      when length(p) >= {high} then named_struct('out', array_append({done}, p), 'buf', cast(null as string), 'n', 0)
      when a.n + length(p) + 2 > {high} and a.n >= {low} then named_struct('out', {done}, 'buf', p, 'n', length(p))
      else named_struct('out', a.out, 'buf', case when a.buf is null then p else concat(a.buf, '\\n\\n', p) end, 'n', a.n + length(p) + 2) end"""
    start = "named_struct('out', cast(array() as array<string>), 'buf', cast(null as string), 'n', 0)"
    return f"aggregate({array}, {start}, (a, p) -> {step}, a -> {done})"


def segments(docs: DataFrame, column: str = "masked", low: int = MIN_CHARS, high: int = MAX_CHARS) -> DataFrame:
    """Adds ``segments``: array of (id, section_heading, section_level, text, is_reference, char_len)."""
    cut = f"nullif(regexp_extract(s.body, '{CUTOFF}', 0), '')"
    found = docs.withColumn("__s", F.expr(split_sections(column)))
    # the first place at which references begin: by a section's heading, or inside a body
    found = found.withColumn("__s", F.expr(f"transform(__s, s -> struct(s.section_idx as section_idx, s.heading_level as heading_level, s.heading_text as heading_text, s.body as body, {is_references('s.heading_text')} as by_heading, {cut} as cut))"))
    found = found.withColumn("__from", F.expr("coalesce(array_min(transform(filter(__s, s -> s.by_heading or s.cut is not null), s -> s.section_idx)), size(__s))"))
    seg = "named_struct('section_heading', {}, 'section_level', s.heading_level, 'text', {}, 'is_reference', {}, 'char_len', {})"
    sum_len = "aggregate({0}, 0, (n, p) -> n + length(p))"

    def reference(paras: str, heading: str) -> str:
        return f"case when size({paras}) > 0 then array({seg.format(heading, f'''array_join({paras}, '\\n\\n')''', 'true', sum_len.format(paras))}) else array() end"

    def translatable(paras: str) -> str:
        return f"transform({pack(paras, low, high)}, c -> {seg.format('s.heading_text', 'c', 'false', 'length(c)')})"

    place = f"regexp_instr(s.body, '{CUTOFF}')"
    before, after = strip_newlines(f"substr(s.body, 1, {place} - 1)"), strip_newlines(f"substr(s.body, {place})")
    heading = strip(f"regexp_replace({strip('s.cut')}, '(?U)^#{{1,6}}\\\\s*', '')")
    whole = paragraphs("s.body")
    per_section = f"""case
      when s.section_idx < __from then {translatable(whole)}
      when s.section_idx = __from and not s.by_heading then concat({translatable(paragraphs(before))}, {reference(paragraphs(after), heading)})
      else {reference(whole, 's.heading_text')} end"""
    flat = f"filter(flatten(transform(__s, s -> {per_section})), g -> g.text is not null)"
    numbered = f"transform({flat}, (g, i) -> named_struct('id', format_string('seg_%04d', i + 1), 'section_heading', g.section_heading, 'section_level', g.section_level, 'text', g.text, 'is_reference', g.is_reference, 'char_len', g.char_len))"
    return found.withColumn("segments", F.expr(numbered)).drop("__s", "__from")
