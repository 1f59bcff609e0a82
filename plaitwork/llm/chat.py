"""Chat formatting with tool-call linking, in DataFrame functions only.

A conversation is a table of events: messages, calls and results (EVENT).  Calls meet their results by a hash join on
(conversation, call id); arguments are parsed and checked against the schema of the tool; events are put into an order
in which a result stands after its call and a call after the calls it needs; each event is written as canonical JSON
(keys sorted at every level, no white space, absent fields left out).

Order: if every need of a conversation points to an earlier turn, (turn, kind, call id) is such an order already.  Only
conversations in which some need points to a later turn go through rounds that take away what depends on nothing that is left;
events on a cycle get no level, come last and are marked cyclic.

Defined results: the first result (by turn, then content) of a call id counts, others are orphans, as are results without a call;
of calls that repeat an id in a conversation the first by turn is linked and the others are marked repeated; null text
is an absent field; null or unreadable arguments are invalid and written as null; an unknown tool is invalid.  A null
conversation id is a conversation of its own.  Extra columns of the input are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.llm.common import dropped, written

EVENT = ["conv_id", "turn", "kind", "role", "call_id", "tool", "arguments", "content", "needs"]

#: kind of a JSON value, as schema_of_variant names it
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def valid_arguments(tool: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """True if the arguments are an object with all required fields, right types and no other field."""
    value = F.try_parse_json(arguments)
    out = F.lit(False)
    for name, fields in schemas.items():
        right = F.schema_of_variant(value).startswith("OBJECT")
        for field, (kind, required) in fields.items():
            have = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            kinds = F.regexp_extract(have, "^[A-Z]+", 0).isin(TYPES[kind])
            right &= F.coalesce(kinds, F.lit(False)) if required else F.coalesce(kinds, F.lit(True))
        right &= F.size(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(f) for f in fields]))) == 0
        out = F.when(tool == name, right).otherwise(out)
    return F.coalesce(out, F.lit(False))


def canonical(arguments: Column) -> Column:
    """JSON with the keys of every object in order and no white space; null if it can't be read."""
    return F.to_json(F.try_parse_json(arguments))


def linked(events: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """events with call-result links and checks: columns linked, repeated, valid."""
    events = events.select(*EVENT)
    messages = events.where("kind = 'message'").withColumn("repeated", F.lit(False))
    in_order = Window.partitionBy("conv_id", "kind", "call_id").orderBy("turn", F.col("content").asc_nulls_last(), F.col("arguments").asc_nulls_last())
    ranked = events.where("kind <> 'message'").withColumn("repeated", F.row_number().over(in_order) > 1)
    calls, results = ranked.where("kind = 'call'"), ranked.where("kind = 'result'")
    key = lambda side: side.where("not repeated and call_id is not null").select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.lit(True).alias("met"))
    meets = lambda one, other: one.join(key(other).hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")) & ~F.col("repeated"), "left").drop("c", "i").withColumn("linked", F.coalesce("met", F.lit(False))).drop("met")
    both = meets(calls, results).withColumn("valid", valid_arguments(F.col("tool"), F.col("arguments"), schemas)).unionByName(meets(results, calls).withColumn("valid", F.col("linked")))
    return both.unionByName(messages.withColumn("linked", F.lit(False)).withColumn("valid", F.col("content").isNotNull()))


def _by(one: DataFrame, other: DataFrame, how: str, *keys: str) -> DataFrame:
    """one joined with other on the conversation, where null equals null, and on keys; the columns of one, and what other adds."""
    names = ["conv_id", *keys]
    other = other.select(*[F.col(n).alias(f"_{n}") for n in names], *[c for c in other.columns if c not in names])
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    return one.join(other, same, how).drop(*[f"_{n}" for n in names])


#: Rounds whose levels are put together in one table.
_ROUNDS = 8


def levels(needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) from rows (conv_id, call_id, need), by rounds; calls on or behind a cycle have none."""
    left, found, level = written(needs.distinct(), "needs"), [], 0
    while True:
        waiting = left.where("need is not null").select("conv_id", "call_id").distinct()
        free = _by(left.where("need is null").select("conv_id", "call_id"), waiting, "left_anti", "call_id").distinct()
        free = written(free.withColumn("level", F.lit(level)), "level")
        if free.isEmpty():
            found.append(free)
            return reduce(DataFrame.unionByName, found)
        found.append(free)
        rest = _by(left, free.select("conv_id", "call_id"), "left_anti", "call_id")
        gone = free.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("done"))
        met = _by(rest, gone, "left", "need")
        before, left = left, written(met.select("conv_id", "call_id", F.when(F.col("done").isNull(), F.col("need")).alias("need")).distinct(), "needs")
        dropped(before)
        if len(found) > _ROUNDS:  # so that the plan doesn't grow with the longest chain
            before, found = found, [written(reduce(DataFrame.unionByName, found), "levels")]
            dropped(*before)
        level += 1


#: Turns of a conversation that are numbered in one task.
TURNS = 1024


def placed(events: DataFrame, order: list) -> DataFrame:
    """events with their position in the conversation by level, turn and `order`; long conversations are numbered by stretches of turns."""
    events = events.withColumn("_part", F.floor(F.col("turn") / TURNS))
    parts = events.groupBy("conv_id", "level", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("level", "_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", F.col("level").alias("_level"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("conv_id", "level", "_part").orderBy("turn", *order)
    counted = events.withColumn("_own", F.row_number().over(own) - 1)
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("level") == F.col("_level")) & F.col("_part").eqNullSafe(F.col("_p"))
    met = counted.join(parts.withColumnRenamed("conv_id", "_c"), same)
    return met.withColumn("position", (F.col("_first") + F.col("_own")).cast("int")).drop("_c", "_level", "_p", "_part", "_own", "_first")


def ordered(events: DataFrame) -> DataFrame:
    """events (with links) and their position in a topological order of the conversation, from 0, and cyclic."""
    calls = events.where("kind = 'call' and not repeated and call_id is not null")
    wants = calls.select("conv_id", "call_id", "turn", F.explode("needs").alias("need"))
    there = calls.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"))
    known = _by(wants, there.hint("shuffle_hash"), "inner", "need")
    results = events.where("kind = 'result' and linked").select("conv_id", "call_id", F.col("turn").alias("t"))
    late = _by(calls.select("conv_id", "call_id", "turn"), results.hint("shuffle_hash"), "inner", "call_id").where("t < turn").select("conv_id")
    tangled = written(known.where("need_turn >= turn").select("conv_id").unionByName(late).distinct(), "tangled")
    step = F.when(F.col("kind") == "result", 1).otherwise(0)
    if tangled.isEmpty():
        events = events.withColumn("level", F.lit(0)).withColumn("cyclic", F.lit(False))
    else:
        hard = _by(calls.select("conv_id", "call_id"), tangled, "left_semi")
        edges = _by(known.select("conv_id", "call_id", "need"), tangled, "left_semi").unionByName(hard.withColumn("need", F.lit(None).cast("string")))
        events = _by(events, tangled.withColumn("hard", F.lit(True)), "left")
        events = _by(events, levels(edges).withColumnRenamed("level", "lv"), "left", "call_id")
        events = events.withColumn("cyclic", F.coalesce("hard", F.lit(False)) & ((F.col("kind") == "call") | F.col("linked")) & F.col("lv").isNull() & F.col("call_id").isNotNull() & ~F.col("repeated"))
        events = events.withColumn("level", F.when(F.coalesce("hard", F.lit(False)) & (F.col("kind") != "message"), F.coalesce(2 * F.col("lv") + step, F.lit((1 << 31) - 1))).otherwise(0)).drop("hard", "lv")
    return placed(events, [step, F.col("call_id").asc_nulls_first(), F.col("content").asc_nulls_first()]).drop("level")


def formatted(events: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per event: conv_id, position, turn, kind, call_id, linked, repeated, valid, cyclic, json."""
    done = ordered(written(linked(events, schemas), "linked"))
    text = lambda name, column: F.when(column.isNotNull(), F.concat(F.lit(f'"{name}":'), F.substring(F.to_json(F.array(column)), 2, 1 << 30)))
    # to_json of a one-element array, without its brackets, is the JSON of a string
    part = lambda name, column: F.regexp_replace(text(name, column), r"\]\z", "")
    arguments = F.when(F.col("kind") == "call", F.concat(F.lit('"arguments":'), F.coalesce(canonical(F.col("arguments")), F.lit("null"))))
    fields = [arguments, part("content", F.col("content")), part("id", F.col("call_id")), part("kind", F.col("kind")), part("role", F.col("role")), part("tool", F.col("tool"))]
    json = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return done.select("conv_id", "position", "turn", "kind", "call_id", "linked", "repeated", "valid", "cyclic", json.alias("json"))


def events_of(conversations: DataFrame) -> DataFrame:
    """Plain conversations as events: a user turn calls the tool `respond`, an assistant turn is the result of the last call."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    call = F.when(F.col("role") == "user", F.concat_ws(":", "conv_id", "turn"))
    named = conversations.select("conv_id", "turn", "role", "text", call.alias("own")).withColumn("last", F.last("own", True).over(before))
    kind = F.when(F.col("role") == "user", "call").when((F.col("role") == "assistant") & F.col("last").isNotNull(), "result").otherwise("message")
    named = named.withColumn("kind", kind)
    is_call = F.col("kind") == "call"
    return named.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "kind", "role",
        F.when(is_call, F.col("own")).when(F.col("kind") == "result", F.col("last")).alias("call_id"),
        F.when(is_call, F.lit("respond")).alias("tool"),
        F.when(is_call, F.to_json(F.struct("turn", "text"))).alias("arguments"),
        F.when(~is_call, F.col("text")).alias("content"),
        F.when(is_call & F.col("last").isNotNull(), F.array("last")).otherwise(F.array().cast("array<string>")).alias("needs"),
    )


RESPOND = {"respond": {"text": ("string", True), "turn": ("integer", True)}}
