"""Glossary lookup and prompt rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.text import literal
from inkmill.operators.terms import BUILTIN

#: A glossary is broadcast; above this many terms look terms up by word first.
MAX_TERMS = 100_000


def merge(builtin: DataFrame, user: DataFrame | None) -> DataFrame:
    """term, translation, pos: user entries replace values and keep the place; new ones follow."""
    base = builtin.filter("not startswith(term, '_')")
    if user is None:
        return base
    extra = user.filter("not startswith(term, '_')").selectExpr("term", "translation as u_tr", "pos as u_pos")
    shift = base.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("shift"))
    both = base.join(extra, "term", "full_outer").join(F.broadcast(shift))  # one row
    return both.selectExpr("term", "coalesce(u_tr, translation) as translation", "coalesce(pos, shift + u_pos) as pos")


def builtin(spark: SparkSession) -> DataFrame:
    """term, translation, pos of the built-in glossary."""
    return spark.createDataFrame([(t, z, i) for i, (t, z) in enumerate(BUILTIN)], "term string, translation string, pos int")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """term, translation, pos from a JSON object of terms; keys that begin with ``_`` are notes."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.posexplode(F.expr("map_entries(from_json(value, 'map<string,string>'))")).alias("pos", "e"))
    return entries.selectExpr("e.key as term", "e.value as translation", "pos").filter("not startswith(term, '_')")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class TermFinder:
    """All terms in one pass over a text, at word boundaries, letter case ignored."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.lines = [line for _, line in entries]
        places: dict[str, list[int]] = {}
        for k, (key, _) in enumerate(entries):
            places.setdefault(key, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for key, at in places.items():
            if key:
                self.automaton.add_word(key, (key, at))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[str]:
        low, found = (text or "").lower(), set()
        for last, (key, at) in self.automaton.iter(low) if len(self.automaton) else ():
            if at[0] in found:
                continue
            first = last - len(key) + 1
            before = first > 0 and _is_word(low[first - 1])
            after = last + 1 < len(low) and _is_word(low[last + 1])
            if before != _is_word(key[0]) and after != _is_word(key[-1]):
                found.update(at)
        return [self.lines[k] for k in sorted(found)]


def matches(rows: DataFrame, glossary: DataFrame, text: str) -> DataFrame:
    """Adds ``glossary``: 'term -> translation' lines, in order, of the terms in ``text`` (SQL).

    The terms (checked against ``MAX_TERMS``) are broadcast and become one
    automaton per task, so a text is read once, however many terms there are.
    """
    terms = glossary.orderBy("pos", "term").limit(MAX_TERMS + 1).collect()
    if len(terms) > MAX_TERMS:
        raise ValueError(f"the glossary has over {MAX_TERMS} terms")
    shared = rows.sparkSession.sparkContext.broadcast([(t["term"].lower(), f"{t['term']} -> {t['translation']}") for t in terms])

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = TermFinder(shared.value)
        for texts in batches:
            yield pd.Series([finder(t) for t in texts], dtype=object)

    return rows.withColumn("glossary", find(F.expr(text)))


SYSTEM = """你是人工智能与机器学习论文的专业译者，把英文论文译成中文。遵守下列规则。

【忠实】逐段逐句翻译，一段对一段；用第三人称的学术书面语，译文通顺；不省略、不概括、不补充原文没有的内容。

【结构】
- 标题层级、列表、引用块等 Markdown 结构逐一保留。
- ⟦CODE_0001⟧、⟦FORMULA_0003⟧、⟦TABLE_0002⟧、⟦IMAGE_0005⟧、⟦INLINE_FORMULA_0004⟧ 一类占位符代表锁定的内容，原样留在对应的位置，不改、不译。
- 没有换成占位符的 Markdown 表格，行数、列数、分隔线、数字、单位和变量符号都不变，只译单元格里的自然语言。
- [12]、[Author, 2024]、(Smith et al., 2023) 一类引用编号原样保留。

【术语】
- 以 <glossary> 的译法为准，同一术语全文统一。
- 术语首次出现写“中文（English）”，以后只写中文。
- 模型、机构、人物和数据集的名称保留英文。
- 缩写首次出现写“中文全称（英文缩写）”，以后只写缩写。

【上下文】<previous_zh_context> 是前一单元的译文，用来延续术语、语气和指代；<previous_source_fallback> 和 <next_source_context> 只供理解，不译。只译 <current_source>。

【数字】数字、单位、年份和日期保持原来的写法，单位不译。

【输出】只输出译文，没有前言、后语、解释或 XML 标签。中文与英文之间空一格，中文用全角标点，英文用半角标点。"""
CLOSING = "请把 <current_source> 译成中文，只输出译文。"
#: ``{source}`` is the file of the previous unit's translation.
CHECK = "开始前先检查：如果 {source} 已有内容，就读取它，代替 <previous_zh_context> 里的说明；它只用来延续术语、语气和指代，不要重译。"
#: Texts that stand where a part is empty.
NO_PREVIOUS_ZH = "（前一单元还没有译文）"
NO_PREVIOUS = "（本单元位于文档或章节开头）"
NO_NEXT = "（本单元位于文档或章节末尾）"
NO_TERMS = "（没有需要注意的术语）"
NO_SOURCE = "（同一章节没有前一单元）"


def prompts(rows: DataFrame) -> DataFrame:
    """doc_id, unit_id, wave, prompt. ``rows``: windows with previous_zh and glossary; references go."""

    def part(sql: str, empty: str) -> str:
        return f"coalesce(nullif({sql}, ''), {literal(empty)})"

    source = f"case when previous_id is null then {literal(NO_SOURCE)} else concat('zh_per_segment/', previous_id, '.zh.md') end"
    text = f"""concat('<!-- wave=', wave, ' unit_id=', id, ' -->\\n\\n# SYSTEM\\n\\n', {literal(SYSTEM)}, '\\n\\n---\\n\\n# USER\\n\\n',
      '<previous_zh_context source="', {source}, '">\\n', {part('previous_zh', NO_PREVIOUS_ZH)}, '\\n</previous_zh_context>\\n\\n',
      '<previous_source_fallback>\\n', {part('previous_source', NO_PREVIOUS)}, '\\n</previous_source_fallback>\\n\\n',
      '<current_source id="', id, '" segments="', array_join(segment_ids, ', '), '">\\n', text, '\\n</current_source>\\n\\n',
      '<next_source_context>\\n', {part('next_source', NO_NEXT)}, '\\n</next_source_context>\\n\\n',
      '<glossary>\\n', {part("array_join(glossary, '\\n')", NO_TERMS)}, '\\n</glossary>\\n\\n', {literal(CLOSING)}, '\\n\\n', replace({literal(CHECK)}, '{{source}}', {source}), '\\n')"""
    return rows.filter("not is_reference").selectExpr("doc_id", "id as unit_id", "wave", f"{text} as prompt")
