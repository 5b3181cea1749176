"""Chat formatting: tool calls linked to their results, in DataFrame expressions only.

Messages hold calls and results as JSON text:

* a system message ``{"tools": [{"name", "parameters": {"properties": {p: {"type"}}, "required": [p]}}]}``
  declares the schemas of its conversation;
* an assistant message ``{"content"?, "tool_calls": [{"id", "name", "arguments": {...}}]}`` makes calls; an
  argument ``{"$ref": id}`` stands for another call's result;
* a message of role ``tool``, ``{"tool_call_id", "content"}``, is a result.

Anything else is plain text.  Every message, and within it every call, becomes a row.  Results are hash-joined to
calls by conversation and id and follow their call; calls follow the calls they refer to (levels are peeled
off the reference graph, one join a level; what can't be peeled is a cycle).  Rows are never
gathered by conversation, so a conversation may be of any length.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored

CALL = "struct<id:string,name:string,arguments:variant>"
TYPES = {"string": "^STRING", "integer": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\\([0-9]+,0\\))", "number": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}


def parsed(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Messages with what their text holds: tools, calls, or a result."""
    df = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    df = df.withColumn("_v", F.when(F.col("role").isin("system", "assistant", "tool") & F.ltrim("text", F.lit(" \t\r\n")).startswith("{"), F.expr("try_parse_json(text)")))
    return df.withColumns({
        "_tools": F.when(F.col("role") == "system", F.expr("try_variant_get(_v, '$.tools', 'array<struct<name:string,parameters:variant>>')")),
        "_calls": F.when(F.col("role") == "assistant", F.expr(f"try_variant_get(_v, '$.tool_calls', 'array<{CALL}>')")),
        "_result": F.when(F.col("role") == "tool", F.expr("try_variant_get(_v, '$.tool_call_id', 'string')")),
    })


#: Keywords of a schema that constrain nothing.
NOTES = ["title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"]


def wrong_arguments(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """``conv_id, call_id, problems, unread``: where a call's arguments don't suit its tool, and the keywords of the schema that aren't judged.

    Judged are ``required``, ``additionalProperties`` true or false (false if absent) and each argument's ``type`` (one or a
    list), ``enum`` and ``const``; nested properties, items, ranges, patterns and whatever else are not.
    """
    listed = lambda *more: "array(" + ", ".join(f"'{k}'" for k in (*NOTES, *more)) + ")"
    keywords = "filter(map_keys({}), k -> NOT array_contains({}, k))"
    values = "try_variant_get(p.value, '$', 'map<string,variant>')"
    properties = f"""transform(map_entries(coalesce(try_variant_get(t.parameters, '$.properties', 'map<string,variant>'), map())), p -> struct(p.key AS key,
        filter(coalesce(try_variant_get(p.value, '$.type', 'array<string>'), array(try_variant_get(p.value, '$.type', 'string'))), x -> x IS NOT NULL) AS types,
        transform(try_variant_get(p.value, '$.enum', 'array<variant>'), x -> coalesce(to_json(x), 'null')) AS enum, to_json(try_variant_get(p.value, '$.const', 'variant')) AS const,
        coalesce({keywords.format(values, listed("type", "enum", "const"))}, array('schema')) AS others))"""
    declared = "coalesce(try_variant_get(t.parameters, '$', 'map<string,variant>'), map())"
    schema = tools.select("conv_id", F.explode("_tools").alias("t")).select(
        "conv_id", F.col("t.name").alias("name"), F.expr("coalesce(try_variant_get(t.parameters, '$.required', 'array<string>'), array())").alias("required"), F.expr(properties).alias("properties"),
        F.expr(keywords.format(declared, listed("type", "properties", "required", "additionalProperties"))).alias("others"),
        F.expr("to_json(try_variant_get(t.parameters, '$.additionalProperties', 'variant'))").alias("further"),
    ).groupBy("conv_id", "name").agg(F.max_by(F.struct("required", "properties", "others", "further"), F.struct(F.size("properties"), F.array_join("required", ","))).alias("s"))
    known = calls.where("_args IS NOT NULL").join(schema, ["conv_id", "name"], "left")
    given = known.select("conv_id", "call_id", "name", "s", F.expr("try_variant_get(_args, '$', 'map<string,variant>')").alias("given"))
    given = given.withColumn("_patterns", F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]))
    missing = "filter(s.required, k -> NOT map_contains_key(given, k))"
    value = "try_element_at(given, p.key)"
    judged = f"filter(s.properties, p -> map_contains_key(given, p.key) AND try_variant_get({value}, '$[\"$ref\"]', 'string') IS NULL)"
    known_types = "size(p.types) > 0 AND forall(p.types, x -> map_contains_key(_patterns, x))"
    kind = f"transform(filter({judged}, p -> {known_types} AND NOT exists(p.types, x -> schema_of_variant({value}) rlike try_element_at(_patterns, x))), p -> 'type of ' || p.key)"
    other = f"transform(filter({judged}, p -> NOT coalesce(array_contains(p.enum, coalesce(to_json({value}), 'null')), true) OR NOT coalesce(p.const = coalesce(to_json({value}), 'null'), true)), p -> 'value of ' || p.key)"
    extra = "filter(map_keys(given), k -> NOT exists(s.properties, p -> p.key = k))"
    unread = f"""concat(s.others, flatten(transform({judged}, p -> transform(concat(p.others, transform(filter(p.types, x -> NOT map_contains_key(_patterns, x)), x -> 'type')), k -> k || ' of ' || p.key))),
        CASE WHEN coalesce(s.further, 'false') NOT IN ('true', 'false') THEN transform({extra}, k -> 'additionalProperties of ' || k) ELSE array() END)"""
    return given.select(
        "conv_id", "call_id",
        F.expr(f"""CASE WHEN s IS NULL THEN array('undeclared tool') WHEN given IS NULL THEN array('arguments are no object')
            ELSE array_sort(concat(transform({missing}, k -> 'missing ' || k), {kind}, {other},
                CASE WHEN coalesce(s.further, 'false') = 'false' THEN transform({extra}, k -> 'unknown ' || k) ELSE array() END)) END""").alias("problems"),
        F.expr(f"CASE WHEN given IS NOT NULL AND s IS NOT NULL THEN {unread} ELSE array() END").alias("unread"),
    )


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 without references, else one above the highest; null within or behind a cycle."""
    refs = calls.where("_args IS NOT NULL").select("conv_id", "call_id", F.explode(F.expr("regexp_extract_all(to_json(_args), '\"\\\\$ref\":(\"(?:[^\"\\\\\\\\]|\\\\\\\\.)*\")', 1)")).alias("q"))
    refs = refs.select("conv_id", "call_id", F.expr("try_variant_get(try_parse_json(q), '$', 'string')").alias("ref")).distinct()
    refs = stored(refs.join(calls.select("conv_id", F.col("call_id").alias("ref")).distinct(), ["conv_id", "ref"], "left_semi"), "call-refs")
    every = calls.select("conv_id", "call_id").distinct()
    if refs.isEmpty():
        return every.withColumn("level", F.lit(0))
    every = stored(every, "calls")
    new = stored(every.join(refs, ["conv_id", "call_id"], "left_anti"), "call-levels")
    done = []
    for k in count():
        if new.isEmpty():
            break
        done.append(new.withColumn("level", F.lit(k)))
        left = stored(refs.join(new.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_anti"), "call-refs")
        ready = refs.select("conv_id", "call_id").distinct().join(left, ["conv_id", "call_id"], "left_anti")
        new, refs = stored(ready, "call-levels"), left  # only the references that are still open go on
    levelled = reduce(DataFrame.unionByName, done) if done else every.limit(0).withColumn("level", F.lit(0))
    return every.join(levelled, ["conv_id", "call_id"], "left")


def quoted(name: str) -> Column:
    """A string column as a JSON string, or ``null``."""
    listed = F.to_json(F.array(name))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def chat_format(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each message, call and result.

    ``conv_id, turn, role, kind`` (message, call, result), ``call_id, at_turn, level, part`` (sorting a conversation
    by ``at_turn, level, part, turn, json`` is a topological order: a result stands behind its call, whatever its own turn),
    ``status`` and ``json``, the canonical form: keys sorted, no white space.  Status is ``ok``; for calls
    ``unanswered``, ``duplicate id``, ``cyclic``, ``invalid: ...`` or ``not validated: ...`` (keywords of the schema that aren't judged); for results ``no call`` or ``repeated``.

    Broken JSON is plain text.  Nulls stay null: a null text is a message without content, a null
    turn sorts first, and null conversation or call ids are never linked.  Repeated rows stay repeated.
    Texts may be of any length.  Further columns aren't read; an empty table gives an empty result.
    """
    messages = parsed(conversations, conv_col, turn_col, role_col, text_col)
    calls = messages.where("size(_calls) > 0").select("conv_id", "turn", "role", F.posexplode("_calls").alias("part", "c"))
    calls = calls.select("conv_id", "turn", "role", "part", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.expr("CASE WHEN is_variant_null(c.arguments) THEN NULL ELSE c.arguments END").alias("_args"))
    text = F.struct("role", F.expr("CASE WHEN _calls IS NULL THEN text ELSE try_variant_get(_v, '$.content', 'string') END").alias("content"))
    plain = messages.where("_result IS NULL AND (coalesce(size(_calls), 0) <= 0 OR try_variant_get(_v, '$.content', 'string') IS NOT NULL)").select(
        "conv_id", "turn", "role", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("at_turn"), F.lit(0).alias("level"), F.lit(-1).alias("part"), F.lit("ok").alias("status"),
        F.to_json(F.struct(text["content"].alias("content"), text["role"].alias("role")), {"ignoreNullFields": "false"}).alias("json"),
    )
    tools = messages.where("size(_tools) > 0").select("conv_id", "_tools")
    results = messages.where("_result IS NOT NULL").select("conv_id", "turn", "role", F.col("_result").alias("call_id"), F.expr("try_variant_get(_v, '$.content', 'variant')").alias("content"))

    counted = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("_same"), F.min(F.struct("turn", "part")).alias("_at"))
    answers = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("_answers"), F.min("turn").alias("_first"))
    problems = wrong_arguments(calls, tools).groupBy("conv_id", "call_id").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("problems", "unread")])
    ranked = levels(calls)
    key = ["conv_id", "call_id"]
    linked = counted.join(answers, key, "left").join(problems, key, "left").join(ranked, key, "left")
    own = calls.withColumn("json", F.concat(F.lit('{"arguments":'), F.coalesce(F.expr("to_json(_args)"), F.lit("{}")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"role":"assistant"}')))
    made = own.join(linked, key, "left").select(
        "conv_id", "turn", "role", F.lit("call").alias("kind"), "call_id", F.col("turn").alias("at_turn"), F.coalesce("level", F.lit(0)).alias("level"), "part",
        F.expr("""CASE WHEN call_id IS NULL THEN 'no id' WHEN _same > 1 THEN 'duplicate id' WHEN level IS NULL THEN 'cyclic'
            WHEN size(problems) > 0 THEN 'invalid: ' || array_join(problems, '; ') WHEN size(unread) > 0 THEN 'not validated: ' || array_join(unread, '; ') WHEN _answers IS NULL THEN 'unanswered' ELSE 'ok' END""").alias("status"), "json",
    )
    back = results.join(counted, key, "left").join(answers, key, "left").join(ranked, key, "left").select(
        "conv_id", "turn", "role", F.lit("result").alias("kind"), "call_id", F.coalesce("_at.turn", "turn").alias("at_turn"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("_at.part", F.lit(0)).alias("part"),
        F.expr("CASE WHEN _at IS NULL THEN 'no call' WHEN turn > _first THEN 'repeated' ELSE 'ok' END").alias("status"),
        F.concat(F.lit('{"content":'), F.coalesce(F.expr("to_json(content)"), F.lit("null")), F.lit(',"role":"tool","tool_call_id":'), quoted("call_id"), F.lit("}")).alias("json"),
    )
    return plain.unionByName(made).unionByName(back)
