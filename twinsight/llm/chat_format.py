"""Tool-call linking for chat data: join calls with results, order them, validate arguments, write canonical JSON.

A conversation is rows (conv_id, turn, role, text). An assistant text may be a JSON object with `tool_calls`, a list of
{id, name, arguments}; a text with role `tool` may be one with `tool_call_id` and `content`. Arguments may name an
earlier result as {"$result": id}. In plain conversations each user turn is the call of REPLY, answered by the next
assistant turn, so that these go through the same steps.

Calls and results meet by a hash join on (conversation, identifier). A node's level is the longest way to it from a
node that waits for nothing: a result waits for its call, a call for results that its arguments name. Levels are found
by repeated joins, one round for each call on the longest chain of waiting calls, and rows stay apart, so that no
conversation has to fit in one task; order rows by (level, turn, part).

Defined results: null conversation, turn, role or text are kept as plain messages of their own; a result without call,
a call without result and a cycle are marked in `link`; nodes of a cycle have a null level, as have those that wait for
one, which keep their `link`; of repeated identifiers in a conversation the first call and the first result by turn are
linked, the others are marked `repeated`; text that isn't valid JSON (NaN and numbers beyond a double are not), or is
nested too deeply to be written again, counts as plain text, and so does an empty list of calls; content beside calls is a
message node after them; lone surrogates are written as escapes; other columns are left out; an empty table gives an
empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import strongly_connected
from ._shared import arrow_map, by_pieces, materialise

REPLY = "reply"
#: Schemas of known tools: JSON Schema with type, properties, required, enum, items and additionalProperties.
SCHEMAS = {REPLY: {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}}, "required": ["prompt"], "additionalProperties": False}}

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


_SURROGATE = re.compile("[\ud800-\udfff]")


def printable(text: str) -> str:
    """The text with lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, and non-ASCII characters as they are; ValueError for what JSON cannot hold."""
    return printable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _refuse(constant: str) -> None:
    raise ValueError(f"{constant} is not JSON")


def parsed(text: str) -> object:
    return json.loads(text, parse_constant=_refuse)


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema, in order; empty if it doesn't."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{at}: too short")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            found += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                found += violations(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{k}]")
    return found


def named_results(value: object) -> list[str]:
    """Identifiers of results that arguments name."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [x for k in sorted(value) for x in named_results(value[k])]
    return [x for v in value for x in named_results(v)] if isinstance(value, list) else []


def _loads(text: str | None, key: str) -> dict | None:
    if not text or key not in text:
        return None
    try:
        value = parsed(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) and key in value else None


def _tool_nodes(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """The nodes of a message with calls or a result; none if it has neither."""
    calls = role == "assistant" and _loads(text, "tool_calls")
    if calls and isinstance(calls["tool_calls"], list) and all(isinstance(c, dict) for c in calls["tool_calls"]):
        out = []
        for part, c in enumerate(calls["tool_calls"]):
            name, arguments = printable(str(c.get("name"))), c.get("arguments")
            if isinstance(arguments, str):
                try:
                    arguments = parsed(arguments)
                except (ValueError, RecursionError):
                    pass
            wrong = violations(arguments, schemas[name]) if name in schemas else [f"no schema for {name}"]
            waits = [printable(x) for x in named_results(arguments)]
            out.append((part, "call", None if c.get("id") is None else printable(str(c["id"])), name, not wrong, waits, canonical({"arguments": arguments, "id": c.get("id"), "name": name, "role": role, "violations": wrong})))
        if out and calls.get("content") is not None:
            out.append((len(out), "message", None, None, None, [], canonical({"content": calls["content"], "role": role})))
        return out
    result = role == "tool" and _loads(text, "tool_call_id")
    if result:
        return [(0, "result", printable(str(result["tool_call_id"])), None, None, [], canonical({"content": result.get("content"), "role": role, "tool_call_id": result["tool_call_id"]}))]
    return []


def _nodes(turn: int | None, role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(part, kind, call_id, name, valid, waits, body) of one message, one node at least."""
    try:
        found = _tool_nodes(role, text, schemas)
    except (ValueError, RecursionError):
        found = []
    if found:
        return found
    if role == "user" and turn is not None:
        wrong = violations({"prompt": text or ""}, schemas[REPLY]) if REPLY in schemas else []
        return [(0, "call", f"turn-{turn}", REPLY, not wrong, [], canonical({"content": text, "role": role}))]
    if role == "assistant" and turn is not None:
        return [(0, "result", f"turn-{turn - 1}", None, None, [], canonical({"content": text, "role": role}))]
    return [(0, "message", None, None, None, [], canonical({"content": text, "role": role}))]


def nodes(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """The calls, results and plain messages of all rows."""
    names = ["conv_id", "turn", "part", "kind", "call_id", "name", "valid", "waits", "body"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_pieces(batches, "text"):
            rows = [(conv, turn, *n) for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n in _nodes(turn, role, text, schemas)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    plain = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string").alias("text"))
    return arrow_map(plain, run, "conv_id long, turn long, part int, kind string, call_id string, name string, valid boolean, waits array<string>, body string")


def call_levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, level) of the calls that wait, null if they never end to, and (node, cyclic) of those on a cycle.

    edges: from, to: a call waits for the result of another one; from is null if that result has no call.
    """
    spark = edges.sparkSession
    below = edges.where("from is not null")
    # A result without a call is at level 0, so who waits for it is at 1; one with a call is a level above that.
    told = edges.where("from is null").select(F.col("to").alias("node"), F.lit(1).alias("level"))
    left = below
    while not left.isEmpty():
        # Peel the calls that wait for no other one left.
        ready = left.select(F.col("from").alias("node")).distinct().join(left.select(F.col("to").alias("node")), "node", "left_anti")
        ready = materialise(ready.join(told, "node", "left").groupBy("node").agg(F.coalesce(F.max("level"), F.lit(0)).alias("level")), "chat-ready")
        if ready.isEmpty():
            break
        step = left.join(ready.withColumnRenamed("node", "from"), "from").select(F.col("to").alias("node"), (F.col("level") + 2).alias("level"))
        told = materialise(told.unionByName(step).groupBy("node").agg(F.max("level").alias("level")), "chat-told")
        left = materialise(left.join(ready.select(F.col("node").alias("from")), "from", "left_anti"), "chat-left")
    stuck = left.select(F.col("to").alias("node")).distinct().withColumn("stuck", F.lit(True))
    levels = told.groupBy("node").agg(F.max("level").alias("level")).join(stuck, "node", "full").select("node", F.when(F.col("stuck").isNull(), F.col("level")).alias("level"))
    if left.isEmpty():
        return levels, spark.createDataFrame([], "node long, cyclic boolean")
    # Calls that nothing left waits for only follow a cycle; between cycles, mutual reachability tells.
    ring = left
    while True:
        inner = materialise(ring.join(ring.select(F.col("from").alias("to")).distinct(), "to", "left_semi").select("from", "to"), "chat-ring")
        if inner.count() == ring.count():
            break
        ring = inner
    loops = ring.where("from = to").select(F.col("from").alias("node"))
    rings = strongly_connected(ring.select(F.col("from").alias("src"), F.col("to").alias("dst"))).select("node")
    return levels, rings.unionByName(loops).distinct().withColumn("cyclic", F.lit(True))


def link_calls(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, part, kind, call_id, name, valid, link, level, body for each node."""
    found = materialise(nodes(messages, schemas).withColumn("node", F.monotonically_increasing_id()), "chat-nodes")
    light = found.where("conv_id is not null and call_id is not null")
    # The first of each identifier: a minimum that is combined before rows are dealt, not a sorted group.
    ends = light.groupBy("conv_id", "call_id", "kind").agg(F.min(F.struct("turn", "part", "node")).alias("first")).select("conv_id", "call_id", "kind", F.col("first.node").alias("node"))
    calls = ends.where("kind = 'call'").select("conv_id", "call_id", F.col("node").alias("call_node"))
    results = ends.where("kind = 'result'").select("conv_id", "call_id", F.col("node").alias("result_node"))
    pairs = materialise(calls.join(results, ["conv_id", "call_id"], "full"), "chat-pairs")
    waits = light.where("kind = 'call' and size(waits) > 0").select("conv_id", F.col("node").alias("to"), F.explode("waits").alias("call_id"))
    edges = materialise(waits.join(pairs.where("result_node is not null"), ["conv_id", "call_id"]).select(F.col("call_node").alias("from"), "to").distinct(), "chat-edges")
    levels, cyclic = call_levels(edges)
    # A result is on a cycle if its call is.
    answers = pairs.where("call_node is not null and result_node is not null").select(F.col("result_node").alias("node"), "call_node")
    levels = levels.unionByName(answers.join(levels.withColumnRenamed("node", "call_node"), "call_node").select("node", (F.col("level") + 1).alias("level")))
    cyclic = cyclic.unionByName(answers.join(cyclic.withColumnRenamed("node", "call_node"), "call_node").select("node", "cyclic"))
    # Without an entry: a result of a call that waits for nothing has level 1, any other node 0.
    direct = answers.select("node", F.lit(1).alias("direct"))
    out = found.drop("waits").join(levels.withColumn("waited", F.lit(True)), "node", "left").join(direct, "node", "left").join(cyclic, "node", "left")
    out = out.withColumn("level", F.when(F.col("waited"), F.col("level")).otherwise(F.coalesce("direct", F.lit(0))))
    known = pairs.select(F.explode(F.array(F.struct(F.col("call_node").alias("node"), F.col("result_node").isNotNull().alias("met")), F.struct(F.col("result_node").alias("node"), F.col("call_node").isNotNull().alias("met")))).alias("x")).select("x.*").where("node is not null")
    link = F.when(F.col("kind") == "message", "none").when(F.col("cyclic"), "cycle").when(F.col("met").isNull(), F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unnamed").otherwise("repeated"))
    link = link.when(F.col("met"), "linked").when(F.col("kind") == "call", "no result").otherwise("no call")
    out = out.join(known, "node", "left").withColumn("link", link)
    return out.select("conv_id", "turn", "part", "kind", "call_id", "name", "valid", "link", "level", "body")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = """
WITH m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
n AS (SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'turn-' || turn WHEN 'assistant' THEN 'turn-' || (turn - 1) END AS call_id FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id, kind ORDER BY turn, rid) AS k FROM n),
j AS (SELECT f.*, o.rid AS other FROM f LEFT JOIN f o ON f.conv_id = o.conv_id AND f.call_id = o.call_id AND f.kind <> o.kind AND f.kind <> 'message' AND o.k = 1)
SELECT conv_id, turn, 0::INTEGER AS part, kind, call_id, CASE WHEN kind = 'call' THEN 'reply' END AS name,
    CASE WHEN kind = 'call' THEN length(coalesce(text, '')) > 0 END AS valid,
    CASE WHEN kind = 'message' THEN 'none' WHEN k > 1 THEN 'repeated' WHEN other IS NOT NULL THEN 'linked' WHEN kind = 'call' THEN 'no result' ELSE 'no call' END AS link,
    CASE WHEN kind = 'result' AND k = 1 AND other IS NOT NULL THEN 1 ELSE 0 END::INTEGER AS level,
    '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS body
FROM j
"""
