"""Quality rules, native: line-first cleaning, then a verdict on the document.

Each line is judged by punctuation, navigation and boilerplate rules; failing
lines and repeats of earlier lines are removed; a document that loses more than
``MAX_LOST`` of its word characters is rejected. The base rules (too few words,
too many repeated 3-word windows) are counted on the whole text.

Everything is one projection without a shuffle: the scan's own partitioning
holds at any size, and neither a hot source nor a group of copies concentrates
work. Within a document, repeats are found by sorting (window hash, position)
pairs, so a very long text costs n log n.

Defined results: a null text counts as empty (no words, ``base_failed``, not
kept). Repeated rows are judged row by row. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import load

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST = 0.5
#: A line of at least this many words needs some sentence punctuation.
LONG_LINE_WORDS = 30
NAV_SEPARATORS = 3
#: Lower-case phrases of page furniture in English, German, French and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "we use cookies",
    "accept cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our",
    "click here to",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "allgemeine geschäftsbedingungen",
    "datenschutzerklärung",
    "wir verwenden cookies",
    "cookies akzeptieren",
    "javascript aktivieren",
    "newsletter abonnieren",
    "tous droits réservés",
    "conditions générales",
    "politique de confidentialité",
    "nous utilisons des cookies",
    "accepter les cookies",
    "activer javascript",
    "abonnez-vous à notre",
    "todos los derechos reservados",
    "términos y condiciones",
    "política de privacidad",
    "utilizamos cookies",
    "aceptar cookies",
    "activar javascript",
    "suscríbete a nuestro",
)

_SPACE = r"[\\x20\\x09-\\x0D]+"
_WORD = r"[^\\x20\\x09-\\x0D]"

#: SQL over one line ``l``: true if the line is removed.
_FURNITURE = " or ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
_BARE = f"regexp_replace(l, '{_SPACE}', '')"
_MARKS = r"[#*$%&|<>{}=_~^\\[\\]]"
_SEPARATORS = "[|»›•]"
#: Each rule begins with its cheapest test, which nearly all lines of prose decide.
_LINE_FAILS = {
    "punctuation": f"(not rlike(l, '[.!?;:,。！？]') and size(split(trim(l), '{_SPACE}')) >= {LONG_LINE_WORDS})",
    "navigation": f"(rlike(l, '{_SEPARATORS}') and size(split(l, '{_SEPARATORS}')) > {NAV_SEPARATORS} and 4 * (size(split(l, '{_SEPARATORS}')) - 1) >= size(split(trim(l), '{_SPACE}')))",
    "symbols": f"(rlike(l, '{_MARKS}') and 10 * (length(l) - length(regexp_replace(l, '{_MARKS}', ''))) > 3 * length({_BARE}))",
    "no letters": r"(not rlike(l, '\\p{L}'))",
    "boilerplate": f"(furniture and ({_FURNITURE}))",
}


#: Words in 3-word windows found twice or more, over the words ``w``. Inner lambdas
#: see arrays as variables, so that each is built once. With few repeated windows
#: their positions come from a search in a short list, else from sorted pairs.
_COVERED = "aggregate({}, struct(-3 as last, 0 as total), (a, p) -> struct(p as last, a.total + least(3, p - a.last) as total), a -> a.total)"
_BY_LIST = _COVERED.format("filter(transform(h, (x, i) -> case when array_contains(r, x) then i end), p -> p is not null)")
_BY_SORT = f"""transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as p)))), s -> {_COVERED.format(
    "sort_array(filter(transform(s, (x, i) -> case when x.h = get(s, i - 1).h or x.h = get(s, i + 1).h then x.p end), p -> p is not null))")})[0]"""
_REPEATED = f"""case when size(w) < 4 then 0 else
  transform(array(transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))), h ->
    case when size(array_distinct(h)) = size(h) then 0 else
      transform(array(array_distinct(transform(array(sort_array(h)), s -> filter(s, (x, i) -> x = get(s, i - 1)))[0])), r ->
        case when size(r) <= 32 then {_BY_LIST} else {_BY_SORT} end)[0] end)[0] end"""


def line_rules() -> dict[str, str]:
    """The line rules as SQL, by name, over a line ``l`` and ``furniture``.

    ``furniture`` tells whether the document has any of the phrases, so that
    lines are only searched for them where it does.
    """
    return dict(_LINE_FAILS)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, base rules and the cleaned text's verdict, one row per document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, lost_chars, clean_text.
    """
    text = docs.selectExpr("doc_id", "coalesce(cast(text as string), '') as t").selectExpr("*", "lower(t) as lower_t")
    furniture = " or ".join(f"contains(lower_t, '{p}')" for p in BOILERPLATE)
    parts = text.selectExpr(
        "doc_id",
        "t",
        f"array_remove(split(t, '{_SPACE}'), '') as w",
        f"filter(split(t, '\\n'), l -> rlike(l, '{_WORD}')) as ls",
        f"({furniture}) as furniture",
    )
    no_symbols = "t"
    for c in "#*$%&|<>":
        no_symbols = f"replace({no_symbols}, '{c}')"
    fails = " or ".join(_LINE_FAILS.values())
    counted = parts.selectExpr(
        "doc_id",
        "furniture",
        "cast(size(w) as long) as n_words",
        "cast(length(array_join(w, '')) as long) as word_chars",
        f"cast(length(t) - length({no_symbols}) as long) as n_symbols",
        "array_distinct(ls) as d",
        "cast(size(ls) as long) as n_lines",
        f"cast({_REPEATED} as long) as n_repeat_words",
    )
    cleaned = counted.selectExpr("*", f"filter(d, l -> not ({fails})) as good")
    judged = cleaned.selectExpr(
        "*",
        "n_lines - size(d) as n_dup_lines",
        f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed",
        f"case when size(good) = n_lines then 0 else word_chars - length(regexp_replace(array_join(good, '\\n'), '{_SPACE}', '')) end as lost_chars",
    )
    return judged.selectExpr(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "cast(n_dup_lines as long) as n_dup_lines",
        "n_repeat_words",
        "base_failed",
        f"not base_failed and lost_chars <= {MAX_LOST} * word_chars as kept",
        "cast(lost_chars as long) as lost_chars",
        "array_join(good, '\\n') as clean_text",
    )


def op4_quality_rules(spark, sf_dir):
    return quality_rules(load(spark, sf_dir, "documents")).drop("clean_text")


def _duck(rule: str) -> str:
    """A line rule in the other dialect: arrays and patterns are spelled differently."""
    for call in (_BARE, f"regexp_replace(l, '{_MARKS}', '')"):
        rule = rule.replace(call, call[:-1] + ", 'g')")
    return (
        rule.replace("size(split(", "len(regexp_split_to_array(")
        .replace("rlike(", "regexp_matches(")
        .replace("\\\\", "\\")
    )


OP4_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
      from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 4)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1),
n as (select doc_id, count(distinct k)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as k from r) group by doc_id),
l as (select doc_id, unnest(list_distinct(ls)) as l, true as furniture from w),
good as (select doc_id, sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')))::bigint as chars from l
         where not ({" or ".join(_duck(x) for x in _LINE_FAILS.values())}) group by doc_id),
c as (select w.doc_id, len(w)::bigint as n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(chars, 0) as chars
      from w left join n on w.doc_id = n.doc_id left join good on w.doc_id = good.doc_id),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, word_chars - chars as lost_chars from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and lost_chars <= {MAX_LOST} * word_chars as kept, lost_chars::bigint as lost_chars from b
"""
