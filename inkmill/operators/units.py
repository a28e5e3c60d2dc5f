"""Translation units, context windows and waves, in the document's row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.text import let, nonblank, strip

HYBRID_MAX_CHARS = 12_000
WINDOW_CHARS = 3200
MODES = ("segment", "section", "hybrid")
_UNIT = "struct<id:string,kind:string,segment_ids:array<string>,section_heading:string,section_level:int,text:string,is_reference:boolean,char_len:int>"


def build_units(docs: DataFrame, mode: str = "segment", max_chars: int = HYBRID_MAX_CHARS) -> DataFrame:
    """Adds ``units``, folded from ``segments``.

    Neighbouring segments of one (heading, level) form a group, numbered through
    the document; ``hybrid`` parts a group where the next segment would exceed
    ``max_chars``, each segment counting two more than its length.
    """
    if mode not in MODES:
        raise ValueError(f"unknown unit mode: {mode}")
    if mode == "segment":
        one = "named_struct('id', s.id, 'kind', 'segment', 'segment_ids', array(s.id), 'section_heading', s.section_heading, 'section_level', s.section_level, 'text', s.text, 'is_reference', s.is_reference, 'char_len', s.char_len)"
        return docs.withColumn("units", F.expr(f"transform(segments, s -> {one})"))
    unit_id = "case when b.part = 1 then format_string('sec_%04d', b.section) else format_string('sec_%04d_part_%03d', b.section, b.part) end"
    text = "array_join(transform(b.segs, s -> s.text), '\\n\\n')"
    unit = f"""named_struct('id', {unit_id}, 'kind', case when size(b.segs) > 1 then 'section' else 'segment' end,
      'segment_ids', transform(b.segs, s -> s.id), 'section_heading', b.segs[0].section_heading, 'section_level', b.segs[0].section_level,
      'text', {text}, 'is_reference', forall(b.segs, s -> s.is_reference), 'char_len', length({text}))"""
    # islands of (heading, level), then parts: a running (section, part, used) per segment
    new = "i = 0 or ss[i - 1].section_heading <> s.section_heading or ss[i - 1].section_level <> s.section_level"
    keys = f"transform(ss, (s, i) -> struct(s.char_len + 2 as n, {new} as new))"
    full = f"a.used + k.n > {max_chars}" if mode == "hybrid" else "false"
    place = f"case when k.new then struct(a.section + 1 as section, 1 as part, k.n as used) when {full} then struct(a.section as section, a.part + 1 as part, k.n as used) else struct(a.section as section, a.part as part, a.used + k.n as used) end"
    step = let("p", place, "struct(p.section as section, p.part as part, p.used as used, array_append(a.places, struct(p.section as section, p.part as part)) as places)")
    start = "struct(0 as section, 0 as part, 0 as used, cast(array() as array<struct<section:int,part:int>>) as places)"
    places = f"aggregate({keys}, {start}, (a, k) -> {step}, a -> a.places)"
    # a unit's segments are neighbours: from one new (section, part) to the next
    firsts = "filter(sequence(0, size(ps)), i -> i = 0 or i = size(ps) or ps[i] <> ps[i - 1])"
    buckets = "transform(slice(fs, 1, greatest(0, size(fs) - 1)), (f, k) -> struct(ps[f].section as section, ps[f].part as part, slice(ss, f + 1, fs[k + 1] - f) as segs))"
    made = let("ss", "segments", let("ps", places, let("fs", firsts, f"transform({buckets}, b -> {unit})")))
    return docs.withColumn("units", F.expr(made))


def assign_waves(docs: DataFrame) -> DataFrame:
    """Adds ``wave`` to each unit: its ordinal among the heading's translatable units; -1 for references.

    Units are sorted by heading and counted in one fold, then put back in order.
    """
    keys = "array_sort(transform(units, (u, i) -> struct(u.is_reference as r, u.section_heading as h, i as i)))"
    step = "struct(k.r as r, k.h as h, case when k.h <=> a.h and k.r <=> a.r then a.n + 1 else 0 end as n, array_append(a.out, struct(k.i as i, case when k.r then -1 when k.h <=> a.h and k.r <=> a.r then a.n + 1 else 0 end as w)) as out)"
    start = "struct(cast(null as boolean) as r, cast(null as string) as h, -1 as n, cast(array() as array<struct<i:int,w:int>>) as out)"
    waves = f"array_sort(aggregate({keys.replace('units', 'us')}, {start}, (a, k) -> {step}, a -> a.out))"
    fields = ", ".join(f"u.{c} as {c}" for c in ("id", "kind", "segment_ids", "section_heading", "section_level", "text", "is_reference", "char_len"))
    return docs.withColumn("units", F.expr(let("us", "units", let("ws", waves, f"transform(us, (u, i) -> struct({fields}, ws[i].w as wave))"))))


def wave_plan(docs: DataFrame) -> DataFrame:
    """doc_id, total_units, num_waves, max_parallel, waves: the schedule of each document."""
    live = docs.withColumn("__u", F.expr("filter(units, u -> not u.is_reference)"))
    waves = live.withColumn("__w", F.expr("transform(array_sort(array_distinct(transform(__u, u -> u.wave))), w -> struct(cast(w as string) as wave, transform(filter(__u, u -> u.wave = w), u -> u.id) as ids))"))
    return waves.selectExpr("doc_id", "size(__u) as total_units", "size(__w) as num_waves", "coalesce(array_max(transform(__w, w -> size(w.ids))), 0) as max_parallel", "map_from_entries(__w) as waves")


def explode_units(docs: DataFrame) -> DataFrame:
    """One row per unit.

    An inner explode would infer a filter on the array's size and push its whole
    expression below the projections that build it; an outer one doesn't.
    """
    return docs.select("doc_id", F.posexplode_outer("units").alias("unit_idx", "u")).filter("u is not null").select("doc_id", "unit_idx", "u.*")


def windows(docs: DataFrame) -> DataFrame:
    """One row per unit with previous_id, previous_source, next_source.

    A neighbour counts if it has the same heading and isn't a reference. What
    follows is cut at ``WINDOW_CHARS`` characters, separators not counted.

    Each unit has a place: the characters before it, plus a gap wider than the
    window before each run of neighbours. Places and the window's ends behind
    them, sorted together, tell how far each window reaches, so a document of n
    units takes n log n steps.
    """
    same = "us[i - 1].section_heading = u.section_heading and not us[i - 1].is_reference"
    near = f"transform(us, (u, i) -> i > 0 and {same})"
    # a reference follows nothing
    gap = f"case when near[i] and not u.is_reference then 0 else {WINDOW_CHARS + 1} end"
    sizes = f"transform(us, (u, i) -> struct({gap} as gap, length(u.text) as n))"
    step = "struct(a.n + k.gap + k.n as n, array_append(a.out, a.n + k.gap) as out)"
    places = f"aggregate({sizes}, struct(0L as n, cast(array() as array<bigint>) as out), (a, k) -> {step}, a -> a.out)"
    # an end sorts before a unit at the same place: it isn't reached
    events = f"array_sort(concat(transform(ps, (x, i) -> struct(x as x, 1 as kind, i as i)), transform(ps, (x, i) -> struct(x + {WINDOW_CHARS} as x, 0 as kind, i as i))))"
    count = "struct(a.n + e.kind as n, case when e.kind = 0 then array_append(a.out, struct(e.i as i, a.n as n)) else a.out end as out)"
    reach = f"array_sort(aggregate({events}, struct(0 as n, cast(array() as array<struct<i:int,n:int>>) as out), (a, e) -> {count}, a -> a.out))"
    pieces = f"transform(slice(us, i + 2, reach[i + 1].n - i - 1), (v, k) -> left(v.text, cast({WINDOW_CHARS} - (ps[i + 1 + k] - ps[i + 1]) as int)))"
    after = f"case when get(near, i + 1) and not get(us, i + 1).is_reference then {strip(f"array_join({pieces}, '\\n\\n')")} else '' end"
    before = f"case when near[i] then struct(us[i - 1].id as id, right(us[i - 1].text, {WINDOW_CHARS}) as text) end"
    context = f"transform(us, (u, i) -> struct(u as u, i as unit_idx, {before} as p, {after} as next_source))"
    rows = docs.withColumn("__c", F.expr(let("us", "units", let("near", near, let("ps", places, let("reach", reach, context))))))
    return rows.select("doc_id", F.explode_outer("__c").alias("c")).filter("c is not null").selectExpr("doc_id", "c.unit_idx", "c.u.*", "c.p.id as previous_id", "coalesce(c.p.text, '') as previous_source", "c.next_source")


def with_previous_zh(rows: DataFrame, zh: DataFrame) -> DataFrame:
    """Adds previous_zh, the tail of the previous unit's translation. ``zh``: doc_id, unit_id, zh."""
    known = zh.selectExpr("doc_id as z_doc", "unit_id as z_unit", f"right({strip('zh')}, {WINDOW_CHARS}) as previous_zh")
    joined = rows.join(known, (F.col("doc_id") == F.col("z_doc")) & (F.col("previous_id") == F.col("z_unit")), "left")
    return joined.drop("z_doc", "z_unit").withColumn("previous_zh", F.coalesce("previous_zh", F.lit("")))


def index_rows(units: DataFrame, zh: DataFrame) -> DataFrame:
    """The index of a document: one row per unit with its status."""
    known = zh.select("doc_id", F.col("unit_id").alias("id"), "zh")
    status = f"case when is_reference then 'excluded' when {nonblank('zh')} then 'done' else 'pending' end"
    return units.join(known, ["doc_id", "id"], "left").selectExpr("doc_id", "unit_idx", "id", "case when wave < 0 then '-' else cast(wave as string) end as wave", "array_join(segment_ids, ', ') as segments", "section_heading", "char_len", "is_reference", f"{status} as status")
