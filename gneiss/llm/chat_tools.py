"""Chat formatting: tool calls linked to their results. DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch

#: Type names of JSON schemas and what ``schema_of_variant`` calls such values.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT)", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>", "null": "VOID"}


def json_events(messages: DataFrame) -> DataFrame:
    """Events of ``messages(conv_id, turn, role, text)`` whose texts carry tool JSON.

    An assistant's ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}`` is an event of
    kind ``call`` each; a tool's ``{"tool_call_id", "content"}`` is a ``result``; any other
    text, null included, is a ``message``.
    """
    calls = F.from_json(F.get_json_object("text", "$.tool_calls"), "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>")
    calls = F.when(F.col("role") == "assistant", calls)
    answered = F.when(F.col("role") == "tool", F.get_json_object("text", "$.tool_call_id"))
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", calls.alias("calls"), answered.alias("answered"))
    base = base.select("*", F.posexplode_outer("calls").alias("seq", "c"))
    kind = F.when(F.col("c").isNotNull(), "call").when(F.col("answered").isNotNull(), "result").otherwise("message")
    return base.select(
        "conv_id", "turn", F.coalesce("seq", F.lit(0)).alias("seq"), "role", kind.alias("kind"), F.coalesce("c.id", "answered").alias("call_id"), F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"),
        F.when(kind == "result", F.get_json_object("text", "$.content")).when(kind == "message", F.col("text")).alias("content"),
    )


def turn_events(conversations: DataFrame, name: str = "reply") -> DataFrame:
    """Plain conversations as tool traffic: a user's turn calls ``name``, the assistant's next turn is the result.

    The identifier is ``conv_id:turn`` of the call, and a call depends on the one two
    turns before if the conversation has it. System turns, and turns without
    conversation or number, are messages.
    """
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    kind = F.when(known & (F.col("role") == "user"), "call").when(known & (F.col("role") == "assistant"), "result").otherwise("message")
    identifier = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), F.col("turn").alias("turn")))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(0).alias("seq"), "role", kind.alias("kind"),
        F.when(kind == "call", identifier(0)).when(kind == "result", identifier(1)).alias("call_id"), F.when(kind == "call", name).alias("name"),
        F.when(kind == "call", arguments).alias("arguments"),
        F.when((kind == "call") & (F.col("turn") >= 2), F.array(identifier(2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        F.when(kind != "call", F.col("text")).alias("content"),
    )


def accepts(value: Column, schema: dict) -> Column:
    """Whether a variant has the ``type``, one of the ``enum``, and the ``properties`` or ``items`` of a JSON schema.

    Objects have no properties but those named, and all that are ``required``; the rest may be missing but not of another
    form. A null JSON value has the type ``null`` only.
    """
    ok = F.lit(True)
    if "type" in schema:
        ok &= F.schema_of_variant(value).rlike(f"^{TYPES[schema['type']]}$")
    if "enum" in schema:
        ok &= F.to_json(value).isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in schema["enum"]])
    if "properties" in schema:
        known = F.array(*map(F.lit, schema["properties"])).cast("array<string>")
        ok &= F.size(F.array_except(F.json_object_keys(F.to_json(value)), known)) == 0
        for key, rule in schema["properties"].items():
            part = F.try_variant_get(value, f"$['{key}']", "variant")
            ok &= F.when(part.isNull(), F.lit(key not in schema.get("required", ()))).otherwise(accepts(part, rule))
    if "items" in schema:
        ok &= F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: accepts(x, schema["items"]))
    return F.coalesce(ok, F.lit(False))


def valid_arguments(schemas: dict[str, dict]) -> Column:
    """Whether ``arguments`` of ``name`` is an object that its schema accepts, see :func:`accepts`.

    Unknown names and texts that are no JSON object are invalid.
    """
    value = F.try_parse_json("arguments")
    valid = F.lit(False)
    for name, schema in schemas.items():
        valid = F.when(F.col("name") == name, accepts(value, {"type": "object"} | schema)).otherwise(valid)
    return valid


def _after(place: Column) -> Column:
    return F.struct(place.turn.alias("turn"), place.seq.alias("seq"), (place.hops + 1).alias("hops"))


def places(events: DataFrame, scratch: Scratch) -> DataFrame:
    """``(conv_id, call_id, called, answered, at, done, cyclic)`` of every identifier: where its call and result go.

    A place is (turn, seq, hops). A call's is its own, or the one after the result (the call, if there is none) of
    what it depends on, if that is later; a result's is its own, or the one after its call. So places are a topological order
    that moves nothing that stands in order already. They are found by rounds of joins over
    dependencies that are not kept yet; mostly there is none. Calls that depend on themselves, directly or not,
    would go on for ever: one that moved further than its conversation has moved calls is ``cyclic`` and stays.
    """
    here = F.struct("turn", "seq", F.lit(0).alias("hops"))
    state = events.where("conv_id is not null and call_id is not null and kind <> 'message'").groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", here)).alias("called"), F.min(F.when(F.col("kind") == "result", here)).alias("answered")
    )
    later = lambda done, at: F.when(F.col(done).isNotNull(), F.when(F.col(at).isNull(), F.col(done)).otherwise(F.greatest(F.col(done), _after(F.col(at)))))
    state = state.withColumn("at", F.col("called")).withColumn("done", later("answered", "called")).withColumn("moved", F.lit(False)).withColumn("cyclic", F.lit(False))
    state = scratch.cut(state)
    need = events.where("kind = 'call' and call_id is not null and size(depends_on) > 0").select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("dep")).distinct()
    while True:
        ready = state.select("conv_id", F.col("call_id").alias("dep"), _after(F.coalesce("done", "at")).alias("wait")).where("wait.turn is not null")
        late = need.join(ready, ["conv_id", "dep"]).groupBy("conv_id", "call_id").agg(F.max("wait").alias("wait"))
        late = scratch.cut(late.join(state, ["conv_id", "call_id"]).where("not cyclic and wait > at").select("conv_id", "call_id", "wait"))
        if late.isEmpty():
            return state.drop("moved")
        after = state.join(late, ["conv_id", "call_id"], "left").withColumn("moved", F.col("moved") | F.col("wait").isNotNull()).withColumn("at", F.coalesce("wait", "at")).drop("wait")
        after = after.withColumn("done", later("done", "at"))
        n = after.where("moved").groupBy("conv_id").agg(F.count("*").alias("n"))
        after = after.join(n, "conv_id", "left").withColumn("cyclic", F.col("cyclic") | F.coalesce(F.col("at.hops") >= 2 * F.col("n") + 2, F.lit(False))).drop("n")
        state = scratch.cut(after)


def link(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every event once, with its link, its check, its place and its canonical JSON.

    ``linked``: a call has a result (a result has a call) of its ``call_id`` in the same
    conversation; null for messages. ``valid``: see :func:`valid_arguments`; null but
    for calls. ``ordered``: all calls it depends on exist and are answered before it;
    null but for calls. ``place_turn``, ``place_seq`` and ``place_hops`` (ties by turn and seq) order a
    conversation so that calls come after the results they depend on and results after their
    call, see :func:`places`; ``cyclic`` marks calls that no order can serve, null but for calls.

    Both joins meet one pre-aggregated row per identifier, so repeated identifiers or
    rows multiply nothing and each event has one row. A null call_id links with
    nothing. JSON has sorted keys, no spaces and no null members; arguments are
    re-serialised with sorted keys, or kept as a string if they are not JSON.
    """
    sides = places(events, Scratch(events.sparkSession, "chats"))
    out = events.join(sides, ["conv_id", "call_id"], "left")
    need = events.where("kind = 'call' and size(depends_on) > 0").select("conv_id", "turn", "seq", F.explode(F.array_distinct("depends_on")).alias("call_id")).distinct()
    here = F.struct("turn", "seq", F.lit(0).alias("hops"))
    met = need.join(sides, ["conv_id", "call_id"], "left").groupBy("conv_id", "turn", "seq").agg(
        F.bool_and(F.coalesce(F.col("called").isNotNull() & (F.col("answered") < here), F.lit(False))).alias("met")
    )
    out = out.join(met, ["conv_id", "turn", "seq"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    linked = F.when(call, F.coalesce(F.col("answered").isNotNull(), F.lit(False))).when(result, F.col("called").isNotNull())
    quoted = F.regexp_replace(F.to_json(F.array("arguments")), r"^\[|\]$", "")
    variant = F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(quoted))
    body = F.to_json(F.struct(
        F.when(call, variant).alias("arguments"),
        F.when(call, F.lit(None).cast("string")).otherwise(F.coalesce("content", F.lit(""))).alias("content"),
        F.when(call, F.col("call_id")).alias("id"), F.when(call, F.col("name")).alias("name"), "role",
        F.when(result, F.col("call_id")).alias("tool_call_id"),
    ))
    after_call = F.when(F.col("at").isNotNull(), _after(F.col("at")))
    place = F.when(call, F.greatest(here, F.col("at"))).when(result, F.greatest(here, after_call)).otherwise(here)
    return out.withColumn("place", place).select(
        "conv_id", "turn", "seq", "role", "kind", "call_id", linked.alias("linked"), F.when(call, valid_arguments(schemas)).alias("valid"),
        F.when(call, F.coalesce("met", F.size("depends_on") == 0)).alias("ordered"), F.when(call, F.coalesce("cyclic", F.lit(False))).alias("cyclic"),
        F.col("place.turn").alias("place_turn"), F.col("place.seq").alias("place_seq"), F.col("place.hops").alias("place_hops"), body.alias("json"),
    )


REPLY = {"reply": {"properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"]}}


def format_chats(conversations: DataFrame) -> DataFrame:
    """:func:`link` over plain conversations."""
    return link(turn_events(conversations), REPLY)


def format_conversations(conversations: DataFrame, schemas: dict[str, dict] = REPLY) -> DataFrame:
    """:func:`link` over texts with tool JSON as :func:`json_events`, and all others as :func:`turn_events`."""
    text = F.when(F.col("text").startswith("{"), F.col("text"))
    tools = (F.col("role") == "assistant") & F.get_json_object(text, "$.tool_calls").isNotNull() | (F.col("role") == "tool") & F.get_json_object(text, "$.tool_call_id").isNotNull()
    tools = F.coalesce(tools, F.lit(False))
    return link(turn_events(conversations.where(~tools)).unionByName(json_events(conversations.where(tools))), schemas)
