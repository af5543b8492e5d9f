"""Chat formatting: tool calls and results linked by identifier, ordered, validated and written as canonical JSON.

link() takes a table of messages with the columns conv_id, turn, role, kind
(message, call or result), call_id, parent_id (the call that must come before),
name, arguments (JSON) and content. Calls meet results, and calls meet the calls
they follow, in joins on (conv_id, call_id). The topological level of a call is
its distance from a call that follows none, found by pointer jumping: each round
doubles the distance looked over, so a chain of n calls takes log2(n) rounds of
written tables. Nothing is gathered by conversation; (level, turn) orders a
conversation's rows. All of it is DataFrame operations.

Defined results: a result whose call is missing and a call without a result are
not linked; a parent that is missing counts as none; calls that follow each other
in a circle have no level and the error "cycle"; a call_id used by several calls
of a conversation has the error "duplicate id" at each; null conv_id, turn or
call_id links with nothing; null or broken arguments have the error "arguments:
not an object"; null content is JSON null; repeated rows each get a row; an empty
table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, staged

KEY = ["conv_id", "call_id"]
#: What a user's turn asks for, as a call with these arguments: field -> type, whether required, limit.
RESPOND = {"respond": {"prompt": {"type": "string", "required": True, "max_length": 1500}, "turn": {"type": "integer", "required": True, "minimum": 0}}}
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def quoted(column: Column) -> Column:
    """A string as JSON, null as null."""
    text = F.to_json(F.array(column))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def canonical(column: Column) -> Column:
    """JSON text with sorted keys and no spaces; null where it is no JSON."""
    return F.to_json(F.try_parse_json(column))


def argument_errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """The sorted array of what is wrong with a call's arguments."""
    value = F.try_parse_json(arguments)
    whole = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    by_name = F.when(~whole, F.array(F.lit("arguments: not an object")))
    for tool, fields in schemas.items():
        found = [F.transform(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, fields))), lambda k: F.concat(k, F.lit(": unknown")))]
        for field, rule in fields.items():
            own = F.try_variant_get(value, f"$.{field}", "variant")
            kind = F.schema_of_variant(own)
            there = own.isNotNull() & (kind != "VOID")
            right = F.lit(False)
            for t in TYPES[rule["type"]]:
                right = right | kind.startswith(t)
            says = F.when(~F.coalesce(there, F.lit(False)), F.lit(f"{field}: missing" if rule.get("required") else None).cast("string")).when(~right, F.lit(f"{field}: not {rule['type']}"))
            if "max_length" in rule:
                says = says.when(F.length(F.try_variant_get(own, "$", "string")) > rule["max_length"], F.lit(f"{field}: longer than {rule['max_length']}"))
            if "minimum" in rule:
                says = says.when(F.try_variant_get(own, "$", "double") < rule["minimum"], F.lit(f"{field}: less than {rule['minimum']}"))
            found.append(F.array(says))
        by_name = by_name.when(name == tool, F.array_sort(F.array_compact(F.concat(*found))))
    return by_name.otherwise(F.array(F.lit("name: unknown")))


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of each call (conv_id, call_id, parent_id); null within circles."""
    there = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("there"))
    state = calls.join(there, ["conv_id", "parent_id"], "left").select(*KEY, F.when(F.col("there"), F.col("parent_id")).alias("next"), F.when(F.col("there"), 1).otherwise(0).alias("level"))
    state = staged(state, "call-levels")
    for _ in range(math.ceil(math.log2(state.count() + 2)) + 1):
        if state.filter("next is not null").isEmpty():
            break
        ahead = state.select("conv_id", F.col("call_id").alias("next"), F.col("next").alias("further"), F.col("level").alias("more"))
        step = state.join(ahead, ["conv_id", "next"], "left").select(*KEY, F.col("further").alias("next"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        state = staged(step, "call-levels")
    return state.select(*KEY, F.when(F.col("next").isNull(), F.col("level")).alias("level"))


def link(messages: DataFrame, schemas: dict) -> DataFrame:
    """conv_id, turn, kind, call_id, linked, level, valid, errors, json for each row of messages."""
    rows = only(messages, "conv_id", "turn", "role", "kind", "call_id", "parent_id", "name", "arguments", "content")
    named = rows.filter("conv_id is not null and call_id is not null")
    calls = named.filter("kind = 'call'").groupBy(*KEY).agg(F.count(F.lit(1)).alias("calls"), F.min("parent_id").alias("parent_id"))
    results = named.filter("kind = 'result'").groupBy(*KEY).agg(F.count(F.lit(1)).alias("results"))
    known = calls.join(levels(calls.select(*KEY, "parent_id")), KEY).join(results, KEY, "left").select(*KEY, "calls", "results", "level")
    joined = rows.join(known, KEY, "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    nothing = F.array().cast("array<string>")
    errors = F.array_sort(
        F.concat(
            F.when(call, argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(nothing),
            F.when(call & F.col("calls").isNotNull() & F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(nothing),
            F.when(call & (F.col("calls") > 1), F.array(F.lit("duplicate id"))).otherwise(nothing),
        )
    )
    shown = F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments")))
    text = (
        F.when(call, F.concat(F.lit('{"arguments":'), shown, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"type":"call"}')))
        .when(result, F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"type":"result"}')))
        .otherwise(F.concat(F.lit('{"content":'), quoted(F.col("content")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"message"}')))
    )
    linked = F.when(call, F.coalesce(F.col("results") > 0, F.lit(False))).when(result, F.col("calls").isNotNull()).otherwise(F.lit(False))
    level = F.when(call, F.col("level") * 2).when(result, F.col("level") * 2 + 1)
    return joined.select("conv_id", "turn", "kind", "call_id", linked.alias("linked"), level.cast("long").alias("level"), (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"), text.alias("json"))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of plain turns: a user's turn calls `respond`, after the user's turn two before; an assistant's turn is the result of the turn before."""
    turns = only(conversations, "conv_id", "turn", "role", "text")
    ident = lambda back: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - back).cast("string"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return turns.select(
        "conv_id", "turn", "role",
        F.when(user, "call").when(assistant, "result").otherwise("message").alias("kind"),
        F.when(user, ident(0)).when(assistant, ident(1)).alias("call_id"),
        F.when(user, ident(2)).alias("parent_id"),
        F.when(user, F.lit("respond")).alias("name"),
        F.when(user, F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt")))).alias("arguments"),
        F.col("text").alias("content"),
    )
