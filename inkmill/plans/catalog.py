"""All queries of the document engine by name, and their SQL in the other dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmill.functions.text import literal
from inkmill.operators import assemble, chunks, clean, glossary, mask, qa, segment, units
from inkmill.plans import fixtures, pipeline, stage
from inkmill.sources import html, ingest

#: Terms of the registered glossary queries.
TERMS = (("attention", "注意力"), ("token", "词元"), ("the", "该"), ("review", "评审"), ("transformer", "Transformer"))


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def _segmented(spark, d):
    return segment.segments(fixtures.paper_md(spark, d), "md")


def _unit_rows(spark, d, mode="hybrid"):
    return units.explode_units(units.assign_waves(units.build_units(_segmented(spark, d), mode)))


def _glossary(spark):
    return spark.createDataFrame([(t, z, i) for i, (t, z) in enumerate(TERMS)], "term string, translation string, pos int")


def _prepared(spark, d, mode="hybrid"):
    return pipeline.prepare(fixtures.paper_md(spark, d), pipeline.PipelineConfig(unit_mode=mode))


def _finalized(spark, d):
    prepared = stage.written(_prepared(spark, d))
    zh = fixtures.unit_zh(units.explode_units(prepared))
    return pipeline.finalize(prepared, zh)


def _status(spark, d):
    """Chunk states by a rule on (doc_id, start_page)."""
    planned = chunks.plan(_docs(spark, d).selectExpr("doc_id", f"{fixtures.PAGES_OF} as total_pages"))
    k = "((doc_id + start_page) % 6)"
    return planned, planned.filter(f"{k} < 5").selectExpr(
        "doc_id", "chunk_id", f"case {k} when 1 then 'failed' when 2 then 'running' when 3 then 'completed' when 4 then '' else 'completed' end as state",
        f"case {k} when 0 then 'pymupdf' else null end as engine", "cast(null as string) as error", f"case when {k} in (0, 4) then 10L else 0L end as source_md_size",
    )


def queries():
    q = {}
    q["s1_path_kind"] = lambda s, d: _pages(s, d).selectExpr("page_id", f"{ingest.path_kind('url')} as kind")
    q["s2_classify_urls"] = lambda s, d: ingest.classify_urls(_pages(s, d).selectExpr("page_id", fixtures.URLS.format(S="string") + " as url")).selectExpr("page_id", "kind", "arxiv_id", "array_join(candidates, ' ') as candidates")
    q["s4_sanitize_filename"] = lambda s, d: _pages(s, d).selectExpr("page_id", f"{ingest.sanitize_filename('url')} as name")
    q["s6_url_stem"] = lambda s, d: _pages(s, d).selectExpr("page_id", f"{ingest.url_stem('url')} as stem")
    q["s8_html_to_markdown"] = lambda s, d: html.html_to_markdown(_pages(s, d)).select("page_id", "md")
    q["s12_captions"] = lambda s, d: chunks.captions(fixtures.paged(s, d))
    q["s15_bilingual"] = lambda s, d: assemble.bilingual(u := _unit_rows(s, d), fixtures.unit_zh(u))
    q["c1_dehyphenate"] = lambda s, d: _docs(s, d).selectExpr("doc_id", clean.dehyphenate("replace(replace(text, ' th', concat('-', chr(10), 'th')), ', ', concat('²-', chr(10), 'é'))") + " as md")
    q["c8_inject_tables"] = lambda s, d: clean.inject_table_images(fixtures.paper_md(s, d), fixtures.paged(s, d).filter("page_no <= 3 and doc_id % 2 = 0").selectExpr("doc_id", "page_no as page", "1 as idx", "concat('assets/tables/', page_no, '.png') as rel_path", "cast(null as string) as caption"), mask.strip_tables)
    q["s11_table_boxes"] = lambda s, d: chunks.table_boxes(fixtures.paged(s, d).selectExpr("doc_id", "page_no as page", "explode(sequence(1, 4)) as k").selectExpr("doc_id", "page", "k", "array(0D, 0D, 10D * (k + doc_id % 3), 5D * (k + page % 2)) as bbox"), 2).drop("bbox")
    q["g1_glossary"] = lambda s, d: glossary.merge(glossary.builtin(s), _glossary(s))
    q["c2_strip_repeating_headers"] = lambda s, d: clean.strip_repeating_headers(fixtures.paper_md(s, d))
    q["c3_clean_text"] = lambda s, d: clean.clean_text(fixtures.paper_md(s, d))
    q["c4_rewrite_image_links"] = lambda s, d: fixtures.paper_md(s, d).selectExpr("doc_id", clean.rewrite_image_links("replace(md, 'assets/f', './f')") + " as md")
    q["c5_prefix_chunk_links"] = lambda s, d: fixtures.paper_md(s, d).selectExpr("doc_id", clean.prefix_chunk_links("md", "'chunk_001'") + " as md")
    q["c6_strip_tables"] = lambda s, d: fixtures.paper_md(s, d).select("doc_id", mask.strip_tables("md").alias("md"))
    q["c7_table_block"] = lambda s, d: fixtures.paged(s, d).selectExpr("doc_id", "page_no", clean.table_block("case when page_no % 2 = 0 then concat('a]b', chr(10), 'c') end", "page_no", "1", "concat('assets/tables/', page_no)") + " as block")
    q["c9_merge_chunks"] = lambda s, d: clean.merge_chunks(fixtures.paged(s, d).selectExpr("doc_id", "format_string('chunk_%03d', page_no) as chunk_id", "page_no as start_page", "page_no as end_page", "text as md"))
    q["c10_compact_blank_lines"] = lambda s, d: fixtures.paper_md(s, d).selectExpr("doc_id", clean.compact_blank_lines("replace(md, chr(10), concat(chr(10), chr(10)))") + " as md")
    zh_text = fixtures.CJK_TEXT
    q["c11_full_width_punctuation"] = lambda s, d: _docs(s, d).selectExpr("doc_id", clean.full_width_punctuation(zh_text) + " as md")
    q["c12_space_cjk_alnum"] = lambda s, d: _docs(s, d).selectExpr("doc_id", clean.space_cjk_alnum(zh_text) + " as md")
    q["m1_mask_locked_blocks"] = lambda s, d: fixtures.paper_md(s, d).select("doc_id", mask.mask_locked_blocks()("md").alias("m")).select("doc_id", F.explode_outer("m.blocks").alias("b")).filter("b is not null").select("doc_id", "b.*")
    q["m4_split_sections"] = lambda s, d: fixtures.paper_md(s, d).select("doc_id", F.explode_outer(F.expr(segment.split_sections("md"))).alias("x")).filter("x is not null").selectExpr("doc_id", "x.section_idx", "x.heading_level", "x.heading_text", "length(x.body) as body_chars")
    q["m4_line_ends"] = lambda s, d: fixtures.paper_md(s, d).selectExpr("doc_id", f"{fixtures.ODD_LINES} as md").select("doc_id", F.explode_outer(F.expr(segment.split_sections("md"))).alias("x")).filter("x is not null").selectExpr("doc_id", "x.section_idx", "x.heading_level", "x.heading_text", "x.body")
    q["m8_paragraphs"] = lambda s, d: fixtures.paper_md(s, d).select("doc_id", F.posexplode_outer(F.expr(segment.paragraphs("md"))).alias("k", "p")).filter("p is not null")
    q["m9_pack_paragraphs"] = lambda s, d: fixtures.paper_md(s, d).select("doc_id", F.posexplode_outer(F.expr(segment.pack(segment.paragraphs("md")))).alias("chunk_idx", "p")).filter("p is not null").selectExpr("doc_id", "chunk_idx", "length(p) as chunk_chars", "md5(p) as digest")
    q["m10_segments"] = lambda s, d: _segmented(s, d).select("doc_id", F.explode_outer("segments").alias("g")).filter("g is not null").select("doc_id", "g.*")
    for mode in units.MODES:
        q[f"u_units_{mode}"] = lambda s, d, mode=mode: _unit_rows(s, d, mode).withColumn("segment_ids", F.array_join("segment_ids", ","))
    q["u6_assign_waves"] = lambda s, d: _unit_rows(s, d, "segment").select("doc_id", "id", "wave")
    q["u7_windows"] = lambda s, d: units.windows(units.assign_waves(units.build_units(_segmented(s, d)))).selectExpr("doc_id", "id", "previous_id", "previous_source", "next_source")
    q["u9_wave_histogram"] = lambda s, d: _unit_rows(s, d, "segment").filter("wave >= 0").groupBy("doc_id", "wave").agg(F.count(F.lit(1)).alias("units"))
    q["u10_wave_plan"] = lambda s, d: units.wave_plan(units.assign_waves(units.build_units(_segmented(s, d), "hybrid"))).withColumn("waves", F.expr("array_join(transform(array_sort(transform(map_entries(waves), e -> struct(cast(e.key as int) as w, e.value as ids))), e -> concat(e.w, ':', array_join(e.ids, ','))), ';')"))
    q["u11_index_rows"] = lambda s, d: units.index_rows(u := _unit_rows(s, d), fixtures.unit_zh(u))
    q["g2_glossary_matches"] = lambda s, d: glossary.matches(_docs(s, d).select("doc_id", "text"), _glossary(s), "text").selectExpr("doc_id", "array_join(glossary, '; ') as terms")
    q["g4_prompts"] = lambda s, d: pipeline.make_prompts(p := _prepared(s, d), None, fixtures.unit_zh(units.explode_units(p)))
    q["a1_collect"] = lambda s, d: assemble.collect(u := _unit_rows(s, d, "segment"), fixtures.unit_zh(u))
    q["a4_postprocess"] = lambda s, d: _finalized(s, d)[0]
    q["a6_missing_images"] = lambda s, d: assemble.missing_images(fixtures.paper_md(s, d), _docs(s, d).filter("doc_id % 2 = 0").selectExpr("doc_id", "concat('assets/f', doc_id, '.png') as path"), "md")
    q["q0_count_elements"] = lambda s, d: fixtures.paper_md(s, d).select("doc_id", mask.count_elements("md").alias("c")).select("doc_id", "c.*")
    q["b7_unit_ratios"] = lambda s, d: qa.unit_ratios(u := _unit_rows(s, d, "segment"), fixtures.unit_zh(u)).selectExpr("doc_id", "id", "en", "zh_len", "status", "untranslated")
    q["q1_audit"] = lambda s, d: _finalized(s, d)[1].selectExpr("doc_id", "src_paragraphs", "tgt_paragraphs", "locked_blocks", "excluded_segments", "array_join(transform(blockers, b -> b.id), ',') as blockers", "passed")
    q["q3_fix_prompts"] = lambda s, d: qa.fix_prompts(_finalized(s, d)[1])
    q["q4_report"] = lambda s, d: qa.render_report(_finalized(s, d)[1])
    q["w4_mostly_english"] = lambda s, d: _docs(s, d).selectExpr("doc_id", f"{qa.mostly_english('text')} as untranslated")
    q["p1_body_end"] = lambda s, d: chunks.body_end(fixtures.paged(s, d))
    q["p3_chunk_plan"] = lambda s, d: chunks.plan(_docs(s, d).selectExpr("doc_id", f"{fixtures.PAGES_OF} as total_pages"))
    q["p4_choose_engine"] = lambda s, d: _docs(s, d).selectExpr("doc_id", f"{fixtures.PAGES_OF} as pages").selectExpr("doc_id", f"{chunks.choose_engine('pages')} as engine")
    q["p5_progress"] = lambda s, d: chunks.progress(*_status(s, d))[1]
    q["p6_valid_plans"] = lambda s, d: chunks.valid_plans(_status(s, d)[1].join(_status(s, d)[0].select("chunk_id", "doc_id", "start_page", "end_page"), ["doc_id", "chunk_id"]), _docs(s, d).selectExpr("doc_id", f"{fixtures.PAGES_OF} as total_pages"))
    q["p8_todo"] = lambda s, d: chunks.todo(*_status(s, d), retry_fallback=True)
    return q


# --- SQL ---------------------------------------------------------------------

_P = fixtures.DUCK_PAPER
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = f"""{_P}, lines as (select doc_id, md, unnest(range(0, len(l))) as k, unnest(l) as line from (select doc_id, md, string_split(md, chr(10)) as l from paper)),
trimmed as (select *, {_TRIM.format('line')} as t from lines)"""
_SECTIONS = f"""{_P}, lines as (select doc_id, unnest(range(0, len(l))) as k, unnest(l) as line from (select doc_id, string_split(md, chr(10)) as l from paper)),
heads as (select *, regexp_matches(line, '^#{{1,2}}\\s+.+$') as h from lines),
numbered as (select *, sum(h::int) over (partition by doc_id order by k) as sec from heads),
sections as (select doc_id, (sec - 1)::int as section_idx, first(length(regexp_extract(line, '^(#+)', 1)) order by k)::int as heading_level,
  first(trim(regexp_replace(line, '^#+', '')) order by k) as heading_text, string_agg(line, chr(10) order by k) as body from numbered group by doc_id, sec)"""
_PARAS = "unnest(list_filter(list_transform(regexp_split_to_array({0}, '\\n{{2,}}'), lambda p: trim(p, chr(10))), lambda p: regexp_matches(p, '\\S')))"
#: Segments of the papers: sections before the references are folded, later ones are whole.
_SEGMENTS = f"""{_SECTIONS},
ref as (select doc_id, min(section_idx) as cut_at from sections where regexp_matches(lower(heading_text), '^(references|bibliography)') group by doc_id),
para as (select doc_id, section_idx, heading_level, heading_text, is_ref, row_number() over (partition by doc_id, section_idx order by o) as k, p from
  (select s.doc_id, section_idx, heading_level, heading_text, coalesce(section_idx >= cut_at, false) as is_ref, generate_subscripts(ps, 1) as o, unnest(ps) as p from
    (select *, list_filter(list_transform(regexp_split_to_array(body, '\\n{{2,}}'), lambda p: trim(p, chr(10))), lambda p: regexp_matches(p, '\\S')) as ps from sections) s left join ref on ref.doc_id = s.doc_id)),
fold as (
  select doc_id, section_idx, k, 1 as chunk, case when length(p) >= 10000 then 0 else length(p) + 2 end as n, length(p) >= 10000 as alone from para where k = 1
  union all
  select q.doc_id, q.section_idx, q.k,
    f.chunk + case when length(q.p) >= 10000 or f.alone or (f.n + length(q.p) + 2 > 10000 and f.n >= 6000) then 1 else 0 end,
    case when length(q.p) >= 10000 then 0 when f.n + length(q.p) + 2 > 10000 and f.n >= 6000 then length(q.p) else f.n + length(q.p) + 2 end,
    length(q.p) >= 10000
  from fold f join para q on q.doc_id = f.doc_id and q.section_idx = f.section_idx and q.k = f.k + 1),
chunked as (select p.*, case when is_ref then 1 else chunk end as chunk from para p join fold f using (doc_id, section_idx, k)),
seg as (select doc_id, section_idx, chunk, any_value(heading_text) as section_heading, any_value(heading_level) as section_level, string_agg(p, chr(10) || chr(10) order by k) as text,
  any_value(is_ref) as is_reference, case when any_value(is_ref) then sum(length(p)) else length(string_agg(p, chr(10) || chr(10) order by k)) end::int as char_len from chunked group by doc_id, section_idx, chunk),
segs as (select doc_id, 'seg_' || lpad((row_number() over (partition by doc_id order by section_idx, chunk))::varchar, 4, '0') as id, row_number() over (partition by doc_id order by section_idx, chunk) - 1 as unit_idx,
  section_heading, section_level, text, is_reference, char_len from seg),
waved as (select *, case when is_reference then -1 else row_number() over (partition by doc_id, section_heading, is_reference order by unit_idx) - 1 end::int as wave from segs),
zh as (select doc_id, id as unit_id, {fixtures.ZH} as zh from segs)"""


def _units_sql(limit: int) -> str:
    """Units of sections, parted where the next segment would exceed ``limit``."""
    return f"""{_SEGMENTS},
placed as (
  select doc_id, unit_idx, section_heading, section_level, 1 as section, 1 as part, char_len + 2 as used from segs where unit_idx = 0
  union all
  select s.doc_id, s.unit_idx, s.section_heading, s.section_level,
    p.section + case when s.section_heading <> p.section_heading or s.section_level <> p.section_level then 1 else 0 end,
    case when s.section_heading <> p.section_heading or s.section_level <> p.section_level then 1 when p.used + s.char_len + 2 > {limit} then p.part + 1 else p.part end,
    case when s.section_heading <> p.section_heading or s.section_level <> p.section_level or p.used + s.char_len + 2 > {limit} then 0 else p.used end + s.char_len + 2
  from placed p join segs s on s.doc_id = p.doc_id and s.unit_idx = p.unit_idx + 1),
united as (select s.doc_id, section, part, case when part = 1 then format('sec_{{:04d}}', section) else format('sec_{{:04d}}_part_{{:03d}}', section, part) end as id, case when count(*) > 1 then 'section' else 'segment' end as kind,
  string_agg(s.id, ',' order by s.unit_idx) as segment_ids, any_value(s.section_heading) as section_heading, any_value(s.section_level) as section_level, string_agg(text, chr(10) || chr(10) order by s.unit_idx) as text, bool_and(is_reference) as is_reference
  from placed p join segs s on s.doc_id = p.doc_id and s.unit_idx = p.unit_idx group by s.doc_id, section, part),
numbered_units as (select *, (row_number() over (partition by doc_id order by section, part) - 1)::int as unit_idx, length(text)::int as char_len from united),
scheduled as (select *, case when is_reference then -1 else row_number() over (partition by doc_id, section_heading, is_reference order by unit_idx) - 1 end::int as wave from numbered_units),
unit_zh as (select *, {fixtures.ZH} as zh from scheduled)"""


#: Typography, line by line outside fences and table rows; two passes stand for a look ahead.
_CJK = r"[\x{4e00}-\x{9fff}]"


def _typography_sql(change: str) -> str:
    return f"""with src as (select doc_id, {fixtures.CJK_TEXT} as t from documents),
    ls as (select doc_id, unnest(range(0, len(l))) as k, unnest(l) as line from (select doc_id, string_split(t, chr(10)) as l from src)),
    fs as (select *, starts_with({_TRIM.format('line')}, '```') as f from ls), ps as (select *, sum(f::int) over (partition by doc_id order by k) % 2 = 1 as inside from fs)
    select doc_id, string_agg(case when f or inside or regexp_matches(line, '^\\s*\\|') then line else {change} end, chr(10) order by k) as md from ps group by doc_id"""


def _punctuation_sql() -> str:
    out = "line"
    for half, full in clean.FULL_WIDTH.items():
        mark = f"\\{half}" if half == "?" else half
        for _ in range(2):
            out = f"regexp_replace({out}, '({_CJK}){mark}({_CJK}| )', '\\1{full}\\2', 'g')"
        out = f"regexp_replace({out}, '({_CJK}){mark}$', '\\1{full}')"
    return f"regexp_replace({out}, '({_CJK})\\.(\\s|$)', '\\1。\\2', 'g')"


def _spacing_sql() -> str:
    out = "line"
    for _ in range(1):
        out = f"regexp_replace({out}, '({_CJK})([A-Za-z0-9])', '\\1 \\2', 'g')"
    return f"regexp_replace({out}, '([A-Za-z0-9])({_CJK})', '\\1 \\2', 'g')"


def _cleaned_sql(source: str) -> str:
    """Rows (doc_id, md) of the CTE ``source``, dehyphenated, without running headers, trimmed."""
    joined = r"regexp_replace(regexp_replace(md, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g')"
    return rf"""cl as (select doc_id, unnest(range(0, len(l))) as k, unnest(l) as line from (select doc_id, string_split({joined}, chr(10)) as l from {source})),
      ct as (select *, {_TRIM.format('line')} as t from cl),
      co as (select doc_id, t from ct where length(t) between 1 and 60 and not regexp_matches(t, '[.。!?？！:：]$') and t not like '#%' and not regexp_matches(t, '^\d+\.\s') group by doc_id, t having count(*) >= 3),
      kept as (select x.doc_id, {_TRIM.format("string_agg(x.line, chr(10) order by x.k)")} || chr(10) as md from ct x left join co o on o.doc_id = x.doc_id and o.t = x.t where o.t is null group by x.doc_id)"""


_TABLE = r"(?m)(?:^\|[^\n]*\|\s*\n)+^\|[ :\-|]+\|\s*\n(?:^\|[^\n]*\|\s*\n?)+"
_ASCII = "length(regexp_replace({0}, '[^A-Za-z]', '', 'g')) / length(regexp_replace({0}, '\\P{{L}}', '', 'g')) > 0.7"
_CHUNKS = f"""{fixtures.DUCK_SIZES}, plan as (select doc_id, total_pages, format('chunk_{{:03d}}_p{{:03d}}-p{{:03d}}', (a - 1) // 4 + 1, a, least(a + 3, total_pages)) as chunk_id, a as start_page, least(a + 3, total_pages)::int as end_page
  from (select doc_id, total_pages, unnest(range(1, total_pages + 1, 4))::int as a from sizes)),
st as (select *, (doc_id + start_page) % 6 as k from plan)"""
_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 2)"
_MARK = r"[^\p{L}\p{N}_]"


def oracle_sql():
    q = {}
    q["s1_path_kind"] = r"select page_id, case when regexp_matches(lower(url), '\.pdf$') then 'pdf' when regexp_matches(lower(url), '\.html?$') then 'html' when regexp_matches(lower(url), '\.(md|markdown)$') then 'markdown' end as kind from pages"
    q["s2_classify_urls"] = rf"""with u as (select page_id, {fixtures.URLS.format(S='varchar')} as url from pages), p as (select *, {_HOST} as host, {_PATH} as path from u),
      k as (select *, case when lower(host) like '%arxiv.org%' then nullif(regexp_extract(url, '(\d{{4}}\.\d{{4,5}})(v\d+)?', 1), '') end as a from p)
      select page_id, case when host = '' then null when a is not null then 'arxiv' when lower(path) like '%.pdf' then 'pdf' else 'html' end as kind, a as arxiv_id,
      case when a is not null then 'https://arxiv.org/html/' || a || ' https://ar5iv.labs.arxiv.org/html/' || a || ' https://arxiv.org/pdf/' || a || '.pdf' when host <> '' then url else '' end as candidates from k"""
    q["s4_sanitize_filename"] = r"select page_id, coalesce(nullif(trim(regexp_replace(url, '[^\p{L}\p{N}_.\-]+', '_', 'g'), '_'), ''), 'download') as name from pages"
    q["s6_url_stem"] = rf"select page_id, coalesce(nullif(regexp_replace(regexp_extract({_PATH}, '([^/]+)/*$', 1), '([^.])\.[^.]+$', '\1'), ''), nullif(replace({_HOST}, '.', '_'), ''), 'paper') as stem from pages"
    q["s12_captions"] = f"with {fixtures.DUCK_PAGES} select doc_id, page_no, string_split(text, chr(10))[1] as caption from paged where text like 'Table%'"
    q["c1_dehyphenate"] = r"select doc_id, regexp_replace(regexp_replace(replace(replace(text, ' th', '-' || chr(10) || 'th'), ', ', '²-' || chr(10) || 'é'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+\n', chr(10), 'g') as md from documents"
    q["c2_strip_repeating_headers"] = rf"""with {_LINES},
      often as (select doc_id, t from trimmed where length(t) between 1 and 60 and not regexp_matches(t, '[.。!?？！:：]$') and t not like '#%' and not regexp_matches(t, '^\d+\.\s') group by doc_id, t having count(*) >= 3)
      select x.doc_id, coalesce(string_agg(x.line, chr(10) order by x.k), '') as md from trimmed x left join often o on o.doc_id = x.doc_id and o.t = x.t where o.t is null group by x.doc_id"""
    q["c4_rewrite_image_links"] = rf"with {_P} select doc_id, regexp_replace(replace(md, 'assets/f', './f'), '!\[([^\]]*)\]\(\./([^)]*)\)', '![\1](assets/\2)', 'g') as md from paper"
    q["c5_prefix_chunk_links"] = rf"with {_P} select doc_id, regexp_replace(md, '!\[([^\]]*)\]\(assets/([^)]*)\)', '![\1](assets/chunk_001/\2)', 'g') as md from paper"
    q["c6_strip_tables"] = f"with {_P} select doc_id, regexp_replace(md, '{_TABLE}', '{clean.TABLE_REMOVED.strip()}' || chr(10) || chr(10), 'g') as md from paper"
    q["c8_inject_tables"] = rf"""with {fixtures.DUCK_PAGES}, {_P}, t as (select doc_id, string_agg(chr(10) || chr(10) || '![Table p' || page_no || '-1](assets/tables/' || page_no || '.png)' || chr(10) || chr(10), '' order by page_no) as b from paged where page_no <= 3 and doc_id % 2 = 0 group by doc_id)
      select p.doc_id, case when b is null then md else regexp_replace(regexp_replace(md, '{_TABLE}', '{clean.TABLE_REMOVED.strip()}' || chr(10) || chr(10), 'g'), '\s+$', '') || chr(10) || chr(10) || chr(10) || '{clean.TABLES_BELOW}' || b || chr(10) end as md from paper p left join t on t.doc_id = p.doc_id"""
    q["s11_table_boxes"] = f"""with {fixtures.DUCK_PAGES}, b as (select doc_id, page_no + 2 as page, unnest([1, 2, 3, 4]) as k from paged), kept as (select * from b where 10 * (k + doc_id % 3) >= 30 and 5 * (k + page % 2) >= 15)
      select doc_id, page, idx, format('assets/tables/table_p{{:03d}}_{{:02d}}.png', page, idx) as rel_path from (select doc_id, page, (row_number() over (partition by doc_id, page order by k))::int as idx from kept)"""
    q["g1_glossary"] = "with b(term, translation, pos) as (values " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', '{z.replace(chr(39), chr(39) * 2)}', {k})" for k, (t, z) in enumerate(glossary.BUILTIN)) + "), u(term, tr, p) as (values " + ", ".join(f"('{t}', '{z}', {k})" for k, (t, z) in enumerate(TERMS)) + "), m as (select max(pos) + 1 as n from b) select coalesce(b.term, u.term) as term, coalesce(tr, translation) as translation, coalesce(pos, n + p)::int as pos from b full join u on u.term = b.term cross join m"
    q["c7_table_block"] = f"with {fixtures.DUCK_PAGES} select doc_id, page_no, chr(10) || chr(10) || '![' || case when page_no % 2 = 0 then 'a)b c' else 'Table p' || page_no || '-1' end || '](assets/tables/' || page_no || ')' || chr(10) || chr(10) as block from paged"
    q["c10_compact_blank_lines"] = rf"with {_P} select doc_id, regexp_replace(replace(md, chr(10), chr(10) || chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') as md from paper"
    tail = "chr(10) || text || chr(10) || '| 表,格 |' || chr(10) ||"
    q["c11_full_width_punctuation"] = _typography_sql(_punctuation_sql())
    q["c12_space_cjk_alnum"] = _typography_sql(_spacing_sql())
    q["c3_clean_text"] = f"with {_P}, {_cleaned_sql('paper')} select doc_id, md from kept"
    q["c9_merge_chunks"] = f"with {fixtures.DUCK_PAGES}, merged as (select doc_id, string_agg('<!-- PDF_CHUNK chunk_' || lpad(page_no::varchar, 3, '0') || ' pages=' || page_no || '-' || page_no || ' -->' || chr(10) || chr(10) || {_TRIM.format('text')}, chr(10) || chr(10) order by page_no) as md from paged group by doc_id), {_cleaned_sql('merged')} select doc_id, md from kept"
    q["m4_line_ends"] = f"with {_SECTIONS.replace('string_split(md, chr(10)) as l from paper', f'string_split({fixtures.ODD_LINES}, chr(10)) as l from paper')} select doc_id, section_idx, heading_level, heading_text, body from sections"
    q["m9_pack_paragraphs"] = f"""with recursive {_P}, ps as (select doc_id, list_filter(list_transform(regexp_split_to_array(md, '\\n{{2,}}'), lambda p: trim(p, chr(10))), lambda p: regexp_matches(p, '\\S')) as l from paper),
      para as (select doc_id, generate_subscripts(l, 1) as k, unnest(l) as p from ps),
      fold as (select doc_id, k, 1 as chunk, case when length(p) >= 10000 then 0 else length(p) + 2 end as n, length(p) >= 10000 as alone from para where k = 1 union all
        select q.doc_id, q.k, f.chunk + case when length(q.p) >= 10000 or f.alone or (f.n + length(q.p) + 2 > 10000 and f.n >= 6000) then 1 else 0 end,
          case when length(q.p) >= 10000 then 0 when f.n + length(q.p) + 2 > 10000 and f.n >= 6000 then length(q.p) else f.n + length(q.p) + 2 end, length(q.p) >= 10000 from fold f join para q on q.doc_id = f.doc_id and q.k = f.k + 1)
      select doc_id, (chunk - 1)::int as chunk_idx, length(c) as chunk_chars, md5(c) as digest from (select f.doc_id, chunk, string_agg(p, chr(10) || chr(10) order by f.k) as c from fold f join para a on a.doc_id = f.doc_id and a.k = f.k group by f.doc_id, chunk)"""
    for mode, limit in (("section", 1 << 40), ("hybrid", units.HYBRID_MAX_CHARS)):
        q[f"u_units_{mode}"] = f"with recursive {_units_sql(limit)} select doc_id, unit_idx, id, kind, segment_ids, section_heading, section_level, text, is_reference, char_len, wave from scheduled"
    hybrid = _units_sql(units.HYBRID_MAX_CHARS)
    q["u10_wave_plan"] = f"with recursive {hybrid}, w as (select doc_id, wave, count(*) as n, string_agg(id, ',' order by unit_idx) as ids from scheduled where not is_reference group by all) select doc_id, sum(n)::int as total_units, count(*)::int as num_waves, max(n)::int as max_parallel, string_agg(wave || ':' || ids, ';' order by wave) as waves from w group by doc_id"
    q["u11_index_rows"] = f"with recursive {hybrid} select doc_id, unit_idx, id, case when wave < 0 then '-' else wave::varchar end as wave, replace(segment_ids, ',', ', ') as segments, section_heading, char_len, is_reference, case when is_reference then 'excluded' when regexp_matches(coalesce(zh, ''), '\\S') then 'done' else 'pending' end as status from unit_zh"
    q["s15_bilingual"] = f"with recursive {hybrid} select doc_id, string_agg('<!-- ' || id || ' EN -->' || chr(10) || text || chr(10) || chr(10) || '<!-- ' || id || ' ZH -->' || chr(10) || coalesce({_TRIM.format('zh')}, '') || chr(10) || chr(10) || '---' || chr(10), chr(10) order by unit_idx) as bilingual from unit_zh where not is_reference group by doc_id"
    q["m4_split_sections"] = f"with {_SECTIONS} select doc_id, section_idx, heading_level, heading_text, length(body) as body_chars from sections"
    q["m8_paragraphs"] = f"with {_P} select doc_id, row_number() over (partition by doc_id order by o) - 1 as k, p from (select doc_id, generate_subscripts(ps, 1) as o, unnest(ps) as p from (select doc_id, list_filter(list_transform(regexp_split_to_array(md, '\\n{{2,}}'), lambda p: trim(p, chr(10))), lambda p: regexp_matches(p, '\\S')) as ps from paper))"
    q["m10_segments"] = f"with recursive {_SEGMENTS} select doc_id, id, section_heading, section_level, text, is_reference, char_len from segs"
    q["u_units_segment"] = f"with recursive {_SEGMENTS} select doc_id, unit_idx, id, 'segment' as kind, id as segment_ids, section_heading, section_level, text, is_reference, char_len, wave from waved"
    q["u6_assign_waves"] = f"with recursive {_SEGMENTS} select doc_id, id, wave from waved"
    q["u7_windows"] = f"""with recursive {_SEGMENTS}, w as (select *, lag(id) over d as pid, lag(section_heading) over d as ph, lag(is_reference) over d as pr, lag(text) over d as pt from waved window d as (partition by doc_id order by unit_idx)),
      runs as (select *, sum((section_heading is distinct from ph or is_reference is distinct from pr)::int) over (partition by doc_id order by unit_idx) as run from w),
      ahead as (select a.doc_id, a.unit_idx, b.unit_idx as j, b.text, coalesce(sum(length(b.text)) over (partition by a.doc_id, a.unit_idx order by b.unit_idx rows between unbounded preceding and 1 preceding), 0) as used
        from runs a join runs b on b.doc_id = a.doc_id and b.run = a.run and b.unit_idx > a.unit_idx and not b.is_reference),
      nxt as (select doc_id, unit_idx, {_TRIM.format("string_agg(substr(text, 1, (3200 - used)::bigint), chr(10) || chr(10) order by j)")} as n from ahead where used < 3200 group by all)
      select r.doc_id, id, case when section_heading = ph and not pr then pid end as previous_id, case when section_heading = ph and not pr then right(pt, 3200) else '' end as previous_source, coalesce(n, '') as next_source
      from runs r left join nxt on nxt.doc_id = r.doc_id and nxt.unit_idx = r.unit_idx"""
    q["u9_wave_histogram"] = f"with recursive {_SEGMENTS} select doc_id, wave, count(*) as units from waved where wave >= 0 group by all"
    q["g2_glossary_matches"] = "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(lower(text), '(^|{_MARK}){t}($|{_MARK})') then '{t} -> {z}' end" for t, z in TERMS) + "], lambda x: x is not null), '; ') as terms from documents"
    q["a1_collect"] = rf"""with recursive {_SEGMENTS} select s.doc_id, {_TRIM.format("string_agg(case when regexp_matches(coalesce(zh, ''), '\\S') then regexp_replace(zh, '\\s+$', '') else chr(10) || '[!MISSING TRANSLATION: ' || id || ']' || chr(10) || chr(10) || text end, chr(10) || chr(10) order by unit_idx)").replace(chr(92) * 2, chr(92))} || chr(10) as translated
      from segs s join zh on zh.doc_id = s.doc_id and zh.unit_id = s.id where not is_reference group by s.doc_id"""
    q["a6_missing_images"] = rf"with {_P}, i as (select doc_id, unnest(regexp_extract_all(md, '!\[[^\]\n]*\]\(([^)\n]+)\)', 1)) as path from paper) select i.doc_id, path, count(*) as n from i left join documents d on d.doc_id = i.doc_id and d.doc_id % 2 = 0 and path = 'assets/f' || d.doc_id || '.png' where d.doc_id is null group by all"
    q["b7_unit_ratios"] = f"""with recursive {_SEGMENTS}, r as (select s.doc_id, id, greatest(char_len, 1) as en, {_TRIM.format('zh')} as z from segs s join zh on zh.doc_id = s.doc_id and zh.unit_id = s.id where not is_reference and zh is not null)
      select doc_id, id, en, length(z) as zh_len, case when length(z) = 0 then 'EMPTY' when length(z) / en not between 0.3 and 2.5 then 'BAD' else 'OK' end as status, length(z) > 0 and length(regexp_replace(z, '\\P{{L}}', '', 'g')) > 0 and {_ASCII.format('z')} as untranslated from r"""
    q["w4_mostly_english"] = f"select doc_id, length(regexp_replace(text, '\\P{{L}}', '', 'g')) > 0 and {_ASCII.format('text')} as untranslated from documents"
    q["p1_body_end"] = rf"""with {fixtures.DUCK_PAGES}, f as (select doc_id, min(page_no) as cut_at from paged where page_no >= greatest(1, floor(total_pages * 0.35)) and regexp_matches(text, '(?im)^\s*((\d+[.\s]+)?(references|bibliography)|参考文献)\s*$') group by doc_id)
      select s.doc_id, total_pages, case when cut_at > 1 then cut_at - 1 end as body_end, case when cut_at > 1 and cut_at - 1 < total_pages then cut_at - 1 else total_pages end as used_pages from sizes s left join f on f.doc_id = s.doc_id"""
    q["p3_chunk_plan"] = f"with {_CHUNKS} select doc_id, chunk_id, start_page, end_page from plan"
    q["p4_choose_engine"] = f"with {fixtures.DUCK_SIZES} select doc_id, case when total_pages > 8 then 'marker-chunked' else 'marker' end as engine from sizes"
    q["p5_progress"] = f"with {_CHUNKS} select doc_id, count(*) as total, count_if(k in (0, 3, 4)) as completed, count_if(k = 1) as failed, count_if(k = 2) as running, count_if(k = 5) as pending from st group by doc_id"
    q["p6_valid_plans"] = f"with {_CHUNKS} select doc_id, not bool_or(k = 5) as valid from st group by doc_id having bool_or(k < 5)"
    q["p8_todo"] = f"with {_CHUNKS} select doc_id, chunk_id, start_page, end_page from st where k <> 4"
    return q
