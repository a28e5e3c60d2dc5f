"""Chat formatting, native: tool calls linked to results, as canonical JSON.

Turns are rows (conv_id, turn, role, text). A turn whose text is a JSON object
may carry calls, ``{"tool_calls": [{"id", "name", "arguments": {...}}], ...}``,
or be a result, role ``tool`` with ``{"tool_call_id", "content"}``. Calls and
results are hash-joined on (conv_id, identifier). Messages are then put in
topological order: a result comes after the call that it answers, whatever turn
it was recorded at, and otherwise turns keep their order. Arguments are held
against the schema of their tool. Each message is one canonical JSON text: keys
sorted at every level, no white space.

Texts are parsed once and written as message rows. Lookups by identifier deal
each identifier over ``SALTS`` cells, so one that a third of all messages names
isn't gathered in one task. Positions come from one range partitioning by
(conversation, order), whose bounds fall inside a conversation where that is
long: rows are numbered within a partition, and a conversation's rows in earlier
partitions are added from a table with at most a row per partition and
conversation.

Defined results: null conv_id, turn, role or text are kept, as JSON nulls; null
turns sort first; messages of one place are ordered by kind (results last), by
recorded turn and by the digest of their JSON. Repeated rows are messages of
their own. Invalid JSON is plain text. A result without a call is reported in
``status``; a message's calls without a result, of a tool without a schema and of
a repeated identifier are counted in ``n_unanswered``, ``n_no_schema`` and
``n_repeated``. A call is answered if any result of its conversation has its
identifier, so one without an identifier never is. All calls of an identifier
that a conversation has more than once count as repeated (repeated messages
repeat their calls); results link to the first. An empty table gives no rows;
other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm.common import cut_lineage, load

#: Cells over which one key of a lookup is dealt.
SALTS = 8

#: Argument types by name, as Spark's variant type names them.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DOUBLE|DECIMAL.*",
    "boolean": "BOOLEAN",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
}

#: Example schemas of the registered query.
QUERY_SCHEMAS: Mapping[str, Mapping] = {
    "search": {"properties": {"query": "string", "limit": "integer"}, "required": ["query"]},
    "calculate": {"properties": {"expression": "string"}, "required": ["expression"]},
}


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def arguments_error(schemas: Mapping[str, Mapping], name: str = "name", args: str = "args") -> str:
    """SQL over the columns ``name`` and ``args`` (a variant): null, or what is wrong with a call."""
    cases = [f"when {args} is null then 'arguments are not JSON'", f"when not (schema_of_variant({args}) like 'OBJECT%') then 'arguments are not an object'"]
    for tool, schema in sorted(schemas.items()):
        checks = []
        for field in schema.get("required", ()):
            path = _quoted(f"$['{field}']")
            checks.append(f"when try_variant_get({args}, {path}, 'variant') is null then {_quoted(f'missing {field}')}")
        for field, kind in sorted(schema.get("properties", {}).items()):
            path = _quoted(f"$['{field}']")
            checks.append(f"when not rlike(schema_of_variant(try_variant_get({args}, {path}, 'variant')), '^({TYPES[kind]})$') then {_quoted(f'{field} is not {kind}')}")
        if not schema.get("additional", True):
            names = ", ".join(_quoted(f) for f in sorted(schema.get("properties", {}))) or "''"
            checks.append(f"when exists(json_object_keys(to_json({args})), k -> k not in ({names})) then 'unknown argument'")
        if checks:
            cases.append(f"when {name} = {_quoted(tool)} then case {' '.join(checks)} end")
        else:
            cases.append(f"when {name} = {_quoted(tool)} then cast(null as string)")
    return f"case {' '.join(cases)} else 'no schema' end"


def _text_json(column: str) -> str:
    return f"case when {column} like '{{%' then try_parse_json({column}) end"


def _json_string(column: str) -> str:
    """SQL for a string column as a JSON literal: the only value of a written struct."""
    written = f"to_json(struct({column} as x))"
    return f"case when {column} is null then 'null' else substr({written}, 6, length({written}) - 6) end"


def _json_object(fields: Mapping[str, str]) -> str:
    """SQL for one message: content is JSON already, a null name is left out."""
    return (
        f"concat('{{\"content\":', {fields['content']}, case when {fields['name']} is null then '' else concat(',\"name\":', {_json_string(fields['name'])}) end,"
        f" ',\"role\":', {_json_string(fields['role'])}, ',\"turn\":', coalesce(cast({fields['turn']} as string), 'null'), '}}')"
    )


def messages(conversations: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """conv_id, turn, role, body (canonical JSON), digest, result_of, calls: one row per input row."""
    rows = conversations.selectExpr("conv_id", "cast(turn as long) as turn", "cast(role as string) as role", "cast(text as string) as text").withColumn("j", F.expr(_text_json("ltrim(text)")))
    parsed = "transform(try_variant_get(j, '$.tool_calls', 'array<variant>'), c -> named_struct('id', try_variant_get(c, '$.id', 'string'), 'name', try_variant_get(c, '$.name', 'string'), 'args', try_variant_get(c, '$.arguments', 'variant')))"
    known = f"x.name in ({', '.join(map(_quoted, sorted(schemas)))})" if schemas else "false"
    calls = f"transform({parsed}, x -> named_struct('id', x.id, 'name', x.name, 'error', {arguments_error(schemas, 'x.name', 'x.args')}, 'no_schema', not coalesce({known}, false)))"
    body = f"case when j is not null then to_json(j) else {_json_string('text')} end"
    result_of = "case when role = 'tool' then try_variant_get(j, '$.tool_call_id', 'string') end"
    return rows.selectExpr("conv_id", "turn", "role", f"{body} as body", f"{result_of} as result_of", f"case when j is not null then nullif({calls}, array()) end as calls").withColumn("digest", F.expr("case when calls is not null then md5(concat(coalesce(concat('r', role), ''), '|', body)) end"))


def _lookup(rows: DataFrame, table: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Left hash join by ``keys`` (column of rows to column of table); each key is dealt over ``SALTS`` cells."""
    dealt = rows.withColumn("__s", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = table.withColumn("__t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    same = F.col("__s") == F.col("__t")
    for mine, theirs in keys.items():
        same &= F.col(mine).eqNullSafe(F.col(theirs))
    return dealt.join(copies.hint("shuffle_hash"), same, "left").drop("__s", "__t", *keys.values())


def link_calls(msgs: DataFrame) -> DataFrame:
    """i_conv, i_id, first, times, answered: the identifiers of calls, hash-joined with results by identifier."""
    calls = msgs.filter("calls is not null").selectExpr("conv_id", "turn", "posexplode(calls) as (at, c)").filter("c.id is not null")
    known = calls.groupBy("conv_id", F.col("c.id").alias("id")).agg(F.min(F.struct("turn", "at", "c.name")).alias("first"), F.count(F.lit(1)).alias("times"))
    results = msgs.filter("result_of is not null").groupBy(F.col("conv_id").alias("r_conv"), F.col("result_of").alias("r_id")).agg(F.lit(1).alias("found"))
    met = F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("id") == F.col("r_id"))
    return known.join(results.hint("shuffle_hash"), met, "left").selectExpr("conv_id as i_conv", "id as i_id", "first", "times", "found is not null as answered")


def format_chat(conversations: DataFrame, schemas: Mapping[str, Mapping] = QUERY_SCHEMAS) -> DataFrame:
    """conv_id, turn, position, role, n_calls, n_invalid, n_unanswered, n_no_schema, n_repeated, status, json: one row per input row."""
    msgs = cut_lineage(messages(conversations, schemas))
    ids = cut_lineage(link_calls(msgs))
    # what is known of a message's calls, by its digest: no text moves
    calls = msgs.filter("calls is not null").selectExpr("conv_id", "turn", "digest", "explode(calls) as c").selectExpr("conv_id", "turn", "digest", "c.id as call_id")
    # each distinct message's calls once
    named = _lookup(calls.groupBy("conv_id", "turn", "digest", "call_id").agg(F.count(F.lit(1)).alias("n")), ids.drop("first"), {"conv_id": "i_conv", "call_id": "i_id"})
    of_row = msgs.filter("calls is not null").groupBy(F.col("conv_id").alias("m_conv"), F.col("turn").alias("m_turn"), F.col("digest").alias("m_digest")).agg(F.count(F.lit(1)).alias("copies"))
    sums = named.groupBy("conv_id", "turn", "digest").agg(F.sum(F.expr("case when answered then 0 else n end")).alias("u"), F.sum(F.expr("case when times > 1 then n else 0 end")).alias("r"))
    same = F.col("conv_id").eqNullSafe(F.col("m_conv")) & F.col("turn").eqNullSafe(F.col("m_turn")) & (F.col("digest") == F.col("m_digest"))
    states = sums.join(of_row, same).selectExpr("m_conv", "m_turn", "m_digest", "u div copies as n_unanswered", "r div copies as n_repeated")
    counted = _lookup(msgs.filter("calls is not null"), states, {"conv_id": "m_conv", "turn": "m_turn", "digest": "m_digest"}).withColumn("first", F.lit(None).cast(ids.schema["first"].dataType))
    linked = _lookup(msgs.filter("calls is null and result_of is not null"), ids.select("i_conv", "i_id", "first"), {"conv_id": "i_conv", "result_of": "i_id"})
    plain = msgs.filter("calls is null and result_of is null")
    full = counted.unionByName(linked, allowMissingColumns=True).unionByName(plain, allowMissingColumns=True)
    full = full.selectExpr(
        "conv_id",
        "turn",
        "role",
        # a result's place is its own turn, or its call's if that is later
        "case when first is null then turn else greatest(turn, first.turn) end as at",
        "case when role = 'tool' then 2 else 1 end as kind",
        "cast(coalesce(size(calls), 0) as int) as n_calls",
        "cast(coalesce(size(filter(calls, c -> c.error is not null)), 0) as int) as n_invalid",
        "cast(coalesce(n_unanswered, 0) as int) as n_unanswered",
        "cast(coalesce(size(filter(calls, c -> c.no_schema)), 0) as int) as n_no_schema",
        "cast(coalesce(n_repeated, 0) as int) as n_repeated",
        "case when role = 'tool' and first is not null then 'result' when role = 'tool' then 'orphan result' when calls is not null then 'calls' else 'text' end as status",
        _json_object({"content": "body", "name": "first.name", "role": "role", "turn": "turn"}) + " as json",
    )
    return _numbered(full)


def _numbered(rows: DataFrame) -> DataFrame:
    """Positions from 0 within each conversation."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("at").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "tie", "uid"]
    keyed = rows.withColumn("tie", F.md5("json")).withColumn("uid", F.monotonically_increasing_id())
    dealt = cut_lineage(keyed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    # only a conversation that begins in an earlier partition has rows there; at most one such row per partition
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ahead = held.withColumn("ahead", F.sum("n").over(earlier)).filter("ahead > 0").selectExpr("conv_id as a_conv", "part as a_part", "ahead")
    within = W.partitionBy("part", "conv_id").orderBy(*order[1:])
    placed = dealt.withColumn("k", F.row_number().over(within) - 1)
    both = (F.col("part") == F.col("a_part")) & F.col("conv_id").eqNullSafe(F.col("a_conv"))
    return placed.join(F.broadcast(ahead), both, "left").selectExpr("conv_id", "turn", "k + coalesce(ahead, 0) as position", "role", "n_calls", "n_invalid", "n_unanswered", "n_no_schema", "n_repeated", "status", "json")


#: The registered table holds plain turns. The registered query first turns some of
#: them into calls and results, by this rule. Every text is kept whole; k is (conv_id + turn) mod 5.
#: Assistants: k 0 a valid call; k 1 an invalid one and one without an identifier; k 2 one
#: of an unknown tool, whose identifier the conversation may repeat. Later turns of users: k 1
#: answers the turn before; k 3 the repeated identifier; k 4 the next turn's call, which is
#: recorded after its result; k 2 a call that doesn't exist.
_K = "((coalesce(conv_id, 0) + coalesce(turn, 0)) % 5)"
QUERY_ROLE = f"case when role = 'user' and turn > 0 and {_K} between 1 and 4 then 'tool' else role end"


def query_text(q: str, s: str) -> str:
    """The rule above as SQL: ``q`` is the text as a JSON string, ``s`` the dialect's text type."""
    return f"""case
 when text is null or turn is null then text
 when role = 'assistant' and {_K} = 0 then concat('{{"tool_calls":[{{"name":"search","id":"c', cast(turn as {s}), '","arguments":{{"query":', {q}, ',"limit":', cast(turn as {s}), '}}}}]}}')
 when role = 'assistant' and {_K} = 1 then concat('{{"tool_calls":[{{"id":"c', cast(turn as {s}), '","name":"search","arguments":{{"limit":"all"}}}},{{"name":"calculate","arguments":{{"expression":', {q}, '}}}}]}}')
 when role = 'assistant' and {_K} = 2 then concat('{{"tool_calls":[{{"id":"same","name":"lookup","arguments":{{"text":', {q}, '}}}}]}}')
 when role = 'user' and turn > 0 and {_K} = 1 then concat('{{"tool_call_id":"c', cast(turn - 1 as {s}), '","content":', {q}, '}}')
 when role = 'user' and turn > 0 and {_K} in (2, 4) then concat('{{"tool_call_id":"c', cast(turn + 1 as {s}), '","content":', {q}, '}}')
 when role = 'user' and turn > 0 and {_K} = 3 then concat('{{"tool_call_id":"same","content":', {q}, '}}')
 else text end"""


def with_tools(conversations: DataFrame) -> DataFrame:
    """The input of the registered query."""
    text = query_text(_json_string("text"), "string")
    return conversations.selectExpr("conv_id", "turn", f"{QUERY_ROLE} as role", f"{text} as text")


def op5_chat_formatting(spark, sf_dir):
    return format_chat(with_tools(load(spark, sf_dir, "conversations")))


#: With the schemas of ``QUERY_SCHEMAS``; arguments are the only objects in calls.
OP5_SQL = rf"""
with d as (select conv_id, turn, {QUERY_ROLE} as role, {query_text("to_json(text)", "varchar")} as text from conversations),
m as (select row_number() over () as k, *, case when ltrim(text) like '{{%' and json_valid(text) then text::json end as j from d),
p as (select *, case when j is not null then json_extract(j, '$.tool_calls[*]') end as calls, case when role = 'tool' then json_extract_string(j, '$.tool_call_id') end as result_of from m),
c as (select k, conv_id, turn, pos, json_extract_string(c, '$.id') as id, json_extract_string(c, '$.name') as name, json_extract(c, '$.arguments') as args
      from (select k, conv_id, turn, unnest(calls) as c, generate_subscripts(calls, 1) as pos from p where len(calls) > 0)),
ids as (select conv_id, id, count(*) as times, first(turn order by turn, pos) as call_turn, first(name order by turn, pos) as name from c where id is not null group by all),
ans as (select distinct conv_id, result_of from p where result_of is not null),
checked as (select c.*, coalesce(i.times > 1, false) as repeated, a.result_of is null as unanswered, coalesce(c.name not in ('search', 'calculate'), true) as no_schema,
    case c.name when 'search' then coalesce(json_type(args, '$.query'), '') = 'VARCHAR' and coalesce(json_type(args, '$.limit'), 'UBIGINT') in ('UBIGINT', 'BIGINT')
                when 'calculate' then coalesce(json_type(args, '$.expression'), '') = 'VARCHAR' else false end as valid,
    '{{' || array_to_string(list_transform(list_sort(json_keys(args)), lambda x: to_json(x)::varchar || ':' || json_extract(args, '$."' || x || '"')::varchar), ',') || '}}' as canonical
  from c left join ids i on i.conv_id = c.conv_id and i.id = c.id left join ans a on a.conv_id = c.conv_id and a.result_of = c.id),
s as (select k, count(*) as n_calls, count_if(not valid) as n_invalid, count_if(unanswered) as n_unanswered, count_if(no_schema) as n_no_schema, count_if(repeated) as n_repeated,
    '{{"tool_calls":[' || string_agg('{{"arguments":' || canonical || case when id is null then '' else ',"id":' || to_json(id)::varchar end || ',"name":' || to_json(name)::varchar || '}}', ',' order by pos) || ']}}' as body from checked group by k),
f as (select p.k, p.conv_id, p.turn, p.role, case when i.id is null then p.turn else greatest(p.turn, call_turn) end as pos, case when p.role = 'tool' then 2 else 1 end as kind,
    coalesce(n_calls, 0)::int as n_calls, coalesce(n_invalid, 0)::int as n_invalid, coalesce(n_unanswered, 0)::int as n_unanswered, coalesce(n_no_schema, 0)::int as n_no_schema, coalesce(n_repeated, 0)::int as n_repeated,
    case when p.role = 'tool' and i.id is not null then 'result' when p.role = 'tool' then 'orphan result' when n_calls > 0 then 'calls' else 'text' end as status,
    '{{"content":' || coalesce(s.body, case when result_of is not null then '{{"content":' || json_extract(j, '$.content')::varchar || ',"tool_call_id":' || to_json(result_of)::varchar || '}}' end, to_json(text)::varchar, 'null')
      || case when i.id is null then '' else ',"name":' || to_json(i.name)::varchar end || ',"role":' || coalesce(to_json(p.role)::varchar, 'null') || ',"turn":' || coalesce(p.turn::varchar, 'null') || '}}' as json
  from p left join s on s.k = p.k left join ids i on i.conv_id = p.conv_id and i.id = p.result_of)
select conv_id, turn, row_number() over (partition by conv_id order by pos nulls first, kind, turn nulls first, md5(json)) - 1 as position,
  role, n_calls, n_invalid, n_unanswered, n_no_schema, n_repeated, status, json from f
"""
