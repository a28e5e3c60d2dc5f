"""Derived inputs for the registered queries: Markdown papers, translations, pages, chunks.

Each is one SQL expression over a test table that both dialects read, so that a
query and its SQL start from the same rows. ``{S}`` is the dialect's text type.
"""

from __future__ import annotations

PAPER = """concat('# Paper ', cast(doc_id as {S}), chr(10),chr(10), 'Preprint under review', chr(10),chr(10),
 '## Introduction', chr(10),chr(10), replace(text, chr(10), concat(chr(10),chr(10))), chr(10),chr(10),
 '## Method', chr(10),chr(10), 'Preprint under review', chr(10),chr(10),
 'We cite [1], [2, 3] and (Smith et al., 2023). Inline $x_i+y$ holds for attention and token.', chr(10),chr(10),
 case when doc_id % 5 = 0 then '$$a$$' else concat('$$',chr(10),'E = mc^2',chr(10),'$$') end, chr(10),chr(10),
 concat('```py',chr(10),'print(1)',chr(10),'```'), chr(10),chr(10),
 '![Fig](assets/f', cast(doc_id as {S}), '.png)', chr(10),chr(10),
 concat('| a | b |',chr(10),'|---|---|',chr(10),'| 1 | 2 |'), chr(10),chr(10),
 '### Details', chr(10),chr(10), 'Preprint under review', chr(10),chr(10), text, chr(10),chr(10),
 case when doc_id % 4 = 0 then concat('## Introduction',chr(10),chr(10),text,chr(10),chr(10)) else '' end,
 case when doc_id % 3 <> 0
   then concat('## References',chr(10),chr(10),'[1] Ref one.',chr(10),chr(10),'## Appendix',chr(10),chr(10),'Tail text.',chr(10))
   else concat('## Conclusion',chr(10),chr(10),'Done.',chr(10)) end)"""

ZH_LEAD = "使用Transformer架构,效果好."
#: A translation of ``text``, by document: missing, too short, unchanged, or led by a Chinese sentence.
ZH = f"""case when doc_id % 11 = 0 then null when doc_id % 5 = 0 then substr(text, 1, cast(floor(length(text) / 10) as int))
 when doc_id % 7 = 0 then text else concat('{ZH_LEAD}', chr(10), text) end"""

#: A document's pages hold ``PAGE_CHARS`` characters of its text each.
PAGE_CHARS = 600
PAGES_OF = f"1 + cast(floor(length(coalesce(text, '')) / {PAGE_CHARS}) as int)"
#: Every third document names its references on the page after two thirds of it.
PAGE_TEXT = f"""concat(case when doc_id % 3 = 0 and page_no = 1 + cast(floor(total_pages * 2 / 3) as int) then concat('x', chr(10), '7. References', chr(10), 'y')
 else concat('Table ', cast(page_no as {{S}}), ': caption ', cast(doc_id as {{S}}), chr(10), 'see references') end, chr(10), substr(coalesce(text, ''), {PAGE_CHARS} * (page_no - 1) + 1, {PAGE_CHARS}))"""
#: A text with CJK characters beside letters and marks, a table row, and for odd documents a fence around its second line.
CJK_TEXT = """concat(case when doc_id % 2 = 1 then replace(translate(text, 'aeio', '的是了在'), chr(10), concat(chr(10), '```', chr(10), '好,x好', chr(10), '  ```', chr(10))) else translate(text, 'aeio', '的是了在') end,
 chr(10), '| 表,格 |', chr(10), '好! 吗?x中:文;', chr(10), '使用Transformer架构,效果好.')"""
#: Headings behind other separators than line feeds begin no section.
ODD_LINES = "replace(replace(replace(md, 'We cite', concat('We', '\u2028', '# cite')), 'Done.', concat('Done', chr(13), '## No')), 'Inline', concat('In', '\u0085', '# line'))"
#: Some URLs are papers, some have no scheme, some name a PDF.
URLS = "case when page_id % 4 = 0 then concat('https://arxiv.org/abs/24', lpad(cast(page_id % 12 as {S}), 2, '0'), '.', lpad(cast(page_id as {S}), 5, '0'), 'v2') when page_id % 4 = 1 then replace(url, '://', ':') when page_id % 4 = 2 then concat(url, '.PDF?x=.html') else url end"


def paper_md(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", PAPER.format(S="string") + " as md")


def unit_zh(units):
    """Simulated translations of exploded units: doc_id, unit_id, zh."""
    return units.selectExpr("doc_id", "id as unit_id", f"{ZH} as zh")


def paged(spark, sf_dir):
    """doc_id, total_pages, page_no, text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", f"{PAGES_OF} as total_pages")
    return docs.selectExpr("*", "explode(sequence(1, total_pages)) as page_no").selectExpr("doc_id", "total_pages", "page_no", PAGE_TEXT.format(S="string") + " as text")


DUCK_PAPER = f"paper as (select doc_id, {PAPER.format(S='varchar')} as md from documents)"
DUCK_SIZES = f"sizes as (select doc_id, text, ({PAGES_OF})::int as total_pages from documents)"
DUCK_PAGES = f"{DUCK_SIZES}, paged as (select doc_id, total_pages, page_no, {PAGE_TEXT.format(S='varchar')} as text from (select doc_id, text, total_pages, unnest(range(1, total_pages + 1))::int as page_no from sizes))"
