"""Chat formatting: links tool calls with their results and writes canonical JSON, in DataFrame functions only.

Input are messages (conv_id, turn, role, text). A message may carry blocks

    <tool_call>{"id": "c1", "name": "f", "arguments": {...}, "depends_on": ["c0"]}</tool_call>
    <tool_response>{"id": "c1", "content": ...}</tool_response>

and a transcript without blocks is read as exchanges: a `user` turn is a call of ``reply`` whose
identifier is its turn and whose arguments are its text, and the `assistant` turn right after it is that
call's result, whatever blocks it holds. Exchanges and blocks are name spaces of their own: an identifier means the one only among
exchanges, the other only among blocks. Calls and results are hash-joined by (conv_id, space, identifier). Arguments are checked against
a table of schemas. Calls are put in topological order: a call comes after the message that makes it,
after the calls it depends on, and before its result.

Order keys instead of positions: ``order_turn`` is the latest turn among a call and all it depends on,
``order_level`` the longest chain of dependencies that reaches it from there. Sorting by (order_turn,
order_level, call_turn, call_id) is a topological order of a conversation. No step gathers a conversation:
every join and aggregate is by (conv_id, space, identifier), so one that holds a third of all rows is spread.

Canonical JSON has sorted keys, no white space and unescaped non-ASCII characters.

Defined cases: messages with null text carry nothing, as exchanges they are the empty text; null conv_id
or turn are ignored; repeated rows count once; of several calls or results with one identifier the
first by (turn, text) counts and ``n_results`` tells how many there were; a result without a call is an
`orphan`, a call without a result `unanswered`; a block without an identifier gets one made from its turn,
its place in the message and its hash, so such calls are each their own and such results orphans; malformed JSON makes a call with null name and
``args_valid`` false, and a result with null content; a start tag without an end tag before the next one is text; calls in or behind a cycle have null order keys; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEY = ["conv_id", "space", "call_id"]
#: More levels than any chain has; edges in a cycle, which have no end, are counted up to here.
MOST_LEVELS = 1 << 40
#: The schema of exchanges: (tool, argument, JSON type, required).
REPLY_SCHEMA = (("reply", "role", "string", True), ("reply", "text", "string", True), ("reply", "turn", "integer", True))


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it is malformed."""
    return F.to_json(F.try_parse_json(json))


def quoted(text: Column) -> Column:
    """The JSON literal of a string, `null` of null."""
    whole = F.to_json(F.create_map(F.lit("k"), text))
    return F.when(text.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def _blocks(messages: DataFrame, tag: str) -> DataFrame:
    """The bodies of a message's blocks, in one pass over its text: what stands between a start tag and the next end tag."""
    begin, end = f"<{tag}>", f"</{tag}>"
    after = F.split("text", begin)
    pieces = messages.where(F.col("text").contains(begin)).select("conv_id", "turn", F.posexplode(F.slice(after, 2, F.size(after))).alias("place", "_piece"))
    body = F.btrim(F.substring_index("_piece", end, 1), F.lit(" \t\n\x0b\f\r"))
    return pieces.where(F.col("_piece").contains(end)).select("conv_id", F.lit("block").alias("space"), "turn", "place", body.alias("body"))


def _field(name: str) -> Column:
    return F.try_variant_get(F.try_parse_json("body"), f"$.{name}", "string")


def _identifier(kind: str) -> Column:
    made = F.concat(F.lit(f"?{kind}."), F.col("turn").cast("string"), F.lit("."), F.col("place").cast("string"), F.lit("."), F.sha2("body", 256))
    return F.coalesce(_field("id"), made).alias("call_id")


def block_calls(messages: DataFrame) -> DataFrame:
    """Calls in tool blocks: conv_id, space, call_id, call_turn, name, args (JSON), depends_on."""
    args = F.try_variant_get(F.try_parse_json("body"), "$.arguments", "variant")
    wanted = F.try_variant_get(F.try_parse_json("body"), "$.depends_on", "array<string>")
    return _blocks(messages, "tool_call").select("conv_id", "space", _identifier("call"), F.col("turn").alias("call_turn"), _field("name").alias("name"), F.to_json(args).alias("args"), F.coalesce(wanted, F.array().cast("array<string>")).alias("depends_on"))


def block_results(messages: DataFrame) -> DataFrame:
    """Results in tool blocks: conv_id, space, call_id, result_turn, content."""
    content = F.to_json(F.try_variant_get(F.try_parse_json("body"), "$.content", "variant"))
    return _blocks(messages, "tool_response").select("conv_id", "space", _identifier("result"), F.col("turn").alias("result_turn"), content.alias("content"))


def exchange_calls(messages: DataFrame) -> DataFrame:
    """User turns as calls of `reply`."""
    args = F.to_json(F.struct(F.col("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn")))
    return messages.where("role = 'user'").select("conv_id", F.lit("exchange").alias("space"), F.col("turn").cast("string").alias("call_id"), F.col("turn").alias("call_turn"), F.lit("reply").alias("name"), args.alias("args"), F.array().cast("array<string>").alias("depends_on"))


def exchange_results(messages: DataFrame) -> DataFrame:
    """Assistant turns as results of the user turn right before."""
    return messages.where("role = 'assistant'").select("conv_id", F.lit("exchange").alias("space"), (F.col("turn") - 1).cast("string").alias("call_id"), F.col("turn").alias("result_turn"), quoted(F.coalesce("text", F.lit(""))).alias("content"))


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """One row per identifier, the first by the given columns, and in _n how many different ones there were."""
    return rows.distinct().groupBy(*KEY).agg(F.min(F.struct(*by)).alias("_f"), F.count(F.lit(1)).alias("_n")).select(*KEY, "_f.*", "_n")


def _json_type(shape: Column) -> Column:
    """The JSON type of a variant from its schema text."""
    return (
        F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "BIGINT", "integer").when(shape == "VOID", "null")
        .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("number")
    )


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with args_valid: the tool known, every argument known and of its type, every required one there."""
    known = schemas.groupBy(F.col("tool").alias("name")).agg(F.map_from_entries(F.collect_set(F.struct("arg", "type"))).alias("_types"), F.collect_set(F.when(F.col("required"), F.col("arg"))).alias("_required"))
    given = F.transform_values(F.from_json("args", "map<string,variant>"), lambda k, v: _json_type(F.schema_of_variant(v)))
    j = calls.withColumn("_given", given).join(known, "name", "left")
    fits = F.forall(F.map_keys("_given"), lambda k: F.coalesce((F.col("_types")[k] == F.col("_given")[k]) | ((F.col("_types")[k] == "number") & (F.col("_given")[k] == "integer")), F.lit(False)))
    ok = fits & (F.size(F.array_except("_required", F.map_keys("_given"))) == 0)
    return j.withColumn("args_valid", F.coalesce(ok, F.lit(False))).drop("_given", "_types", "_required")


def order_keys(calls: DataFrame) -> DataFrame:
    """(conv_id, space, call_id, order_turn, order_level) of all calls that are neither in nor behind a cycle.

    A call's key is the greatest of (own turn, 0) and of its dependencies' keys, each with one level more.
    Each round settles the calls that wait for none, takes their keys over to those that wait for them, and
    lets every edge to a call that waits for one other lead on to that one, with the levels between them
    added: so chains halve in a round, and only nested forks need a round each. Edges never grow in number,
    settled calls leave, and a round that settles none ends it, as what is left waits for a cycle.
    Without dependencies there is no round. An unknown dependency asks for nothing.
    """
    free = calls.select(*KEY, F.col("call_turn").alias("order_turn"), F.lit(0).cast("long").alias("order_level"))
    pairs = calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("dep"))
    if pairs.isEmpty():
        return free
    to = ["conv_id", "space", "dep"]
    names = calls.select("conv_id", "space", F.col("call_id").alias("dep"))
    edges = common.materialize(pairs.join(names, to, "left_semi").withColumn("levels", F.lit(1).cast("long")), "edges")
    #: (key, least key so far) of the calls that wait
    waiting = common.materialize(free.join(edges, KEY, "left_semi").select(*KEY, F.struct("order_turn", "order_level").alias("best")), "waiting")
    settled = [common.materialize(free.join(edges, KEY, "left_anti"), "ordered")]
    while not settled[-1].isEmpty():
        known = settled[-1].select("conv_id", "space", F.col("call_id").alias("dep"), "order_turn", "order_level")
        rest = common.materialize(edges.join(known, to, "left_anti"), "edges")
        taken = edges.join(known, to).select(*KEY, F.struct("order_turn", (F.col("order_level") + F.col("levels")).alias("order_level")).alias("best"))
        # a call that waits for one other, where edges to it lead instead, and what it adds itself on the way
        single = rest.groupBy(*KEY).agg(F.min("dep").alias("_next"), F.min("levels").alias("_more"), F.count(F.lit(1)).alias("_n")).where("_n = 1 and call_id <> _next")
        raised = common.materialize(waiting.unionByName(taken).groupBy(*KEY).agg(F.max("best").alias("best")), "waiting")
        one = common.materialize(single.join(raised, KEY).select("conv_id", "space", F.col("call_id").alias("dep"), "_next", "_more", F.col("best").alias("_best")), "single")
        led = common.materialize(rest.join(one, to, "left"), "edges")
        shorter = led.select(*KEY, F.coalesce("_next", "dep").alias("dep"), F.least(F.col("levels") + F.coalesce("_more", F.lit(0)), F.lit(MOST_LEVELS)).alias("levels"))
        on_way = led.where("_next is not null").select(*KEY, F.struct(F.col("_best.order_turn").alias("order_turn"), (F.col("_best.order_level") + F.col("levels")).alias("order_level")).alias("best"))
        fewer = common.materialize(shorter.groupBy(*KEY, "dep").agg(F.max("levels").alias("levels")), "edges")
        ready = raised.join(rest, KEY, "left_anti")
        settled.append(common.materialize(ready.select(*KEY, "best.order_turn", "best.order_level"), "ordered"))
        left = common.materialize(raised.join(rest, KEY, "left_semi").unionByName(on_way).groupBy(*KEY).agg(F.max("best").alias("best")), "waiting")
        common.discard(edges, waiting, rest, raised, one, led)
        edges, waiting = fewer, left
    common.discard(edges, waiting)
    return functools.reduce(DataFrame.unionByName, settled)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without a call, with its order keys and canonical record."""
    calls = calls.where("conv_id is not null and call_turn is not null and call_id is not null")
    results = results.where("conv_id is not null and result_turn is not null and call_id is not null")
    one = _first(calls, "call_turn", "name", "args", "depends_on").drop("_n")
    got = _first(results, "result_turn", "content").withColumnRenamed("_n", "n_results")
    joined = validate(one, schemas).hint("shuffle_hash").join(got, KEY, "full")
    keys = order_keys(one)
    joined = joined.join(keys, KEY, "left")
    called, answered = F.col("call_turn").isNotNull(), F.col("result_turn").isNotNull()
    record = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("args")), F.lit("null")),
        F.lit(',"call_id":'), quoted(F.col("call_id")),
        F.lit(',"conv_id":'), F.col("conv_id").cast("string"),
        F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), F.coalesce("content", F.lit("null")),
        F.lit(',"result_turn":'), F.coalesce(F.col("result_turn").cast("string"), F.lit("null")),
        F.lit(',"turn":'), F.coalesce(F.col("call_turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    status = F.when(called & answered, "linked").when(called, "unanswered").otherwise("orphan")
    return joined.select("conv_id", "call_id", "name", "call_turn", "result_turn", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), status.alias("status"), F.coalesce("args_valid", F.lit(False)).alias("args_valid"), "order_turn", "order_level", record.alias("record"))


def format_chats(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """All calls and results of ``messages``, by blocks and by exchanges, and the other turns as plain messages."""
    spark = messages.sparkSession
    m = common.pick(messages, "conv_id", "turn", "role", "text").withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("tool", "arg", "type", "required"), strict=True)]) for r in REPLY_SCHEMA]
    reply = spark.range(1).select(F.inline(F.array(*rows)))
    schemas = reply if schemas is None else reply.unionByName(schemas)
    linked = link(exchange_calls(m).unionByName(block_calls(m)), exchange_results(m).unionByName(block_results(m)), schemas)
    others = m.where("conv_id is not null and turn is not null and coalesce(role, '') not in ('user', 'assistant')").distinct()
    record = F.concat(F.lit('{"conv_id":'), F.col("conv_id").cast("string"), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"text":'), quoted(F.coalesce("text", F.lit(""))), F.lit(',"turn":'), F.col("turn").cast("string"), F.lit("}"))
    none = F.lit(None)
    plain = others.select(
        "conv_id", none.cast("string").alias("call_id"), none.cast("string").alias("name"), F.col("turn").alias("call_turn"), none.cast("long").alias("result_turn"), F.lit(0).cast("long").alias("n_results"),
        F.lit("message").alias("status"), F.lit(False).alias("args_valid"), F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_level"), record.alias("record"),
    )
    return linked.unionByName(plain)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every conversation as linked calls, results and messages in canonical JSON."""
    return format_chats(common.table(spark, sf_dir, "conversations"))


SQL = """
WITH m AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, min(text) AS text FROM m WHERE role = 'user' GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM m WHERE role = 'assistant' GROUP BY conv_id, turn),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn - 1) AS id, c.turn AS t, c.text AS ct, r.turn AS rt, r.text AS x, coalesce(r.n, 0) AS n
  FROM c FULL JOIN r ON r.conv_id = c.conv_id AND r.turn - 1 = c.turn)
SELECT conv_id, CAST(id AS VARCHAR) AS call_id, CASE WHEN t IS NOT NULL THEN 'reply' END AS name, CAST(t AS BIGINT) AS call_turn, CAST(rt AS BIGINT) AS result_turn,
       CAST(n AS BIGINT) AS n_results, CASE WHEN t IS NULL THEN 'orphan' WHEN rt IS NULL THEN 'unanswered' ELSE 'linked' END AS status, t IS NOT NULL AS args_valid,
       CAST(t AS BIGINT) AS order_turn, CASE WHEN t IS NOT NULL THEN CAST(0 AS BIGINT) END AS order_level,
       '{"arguments":' || CASE WHEN t IS NULL THEN 'null' ELSE '{"role":"user","text":' || CAST(to_json(ct) AS VARCHAR) || ',"turn":' || t || '}' END
       || ',"call_id":"' || id || '","conv_id":' || conv_id || ',"name":' || CASE WHEN t IS NULL THEN 'null' ELSE '"reply"' END
       || ',"result":' || CASE WHEN rt IS NULL THEN 'null' ELSE CAST(to_json(x) AS VARCHAR) END
       || ',"result_turn":' || coalesce(CAST(rt AS VARCHAR), 'null') || ',"turn":' || coalesce(CAST(t AS VARCHAR), 'null') || '}' AS record
FROM j
UNION ALL
SELECT conv_id, NULL, NULL, CAST(turn AS BIGINT), NULL, 0, 'message', false, CAST(turn AS BIGINT), 0,
       '{"conv_id":' || conv_id || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '}'
FROM m WHERE coalesce(role, '') NOT IN ('user', 'assistant')
"""
