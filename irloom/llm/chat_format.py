"""Chat formatting: calls and results linked by identifier, ordered, validated and written as canonical JSON.

A message whose text is a JSON object may state calls, ``{"tool_calls": [{"id", "name", "arguments", "depends_on": [ids]}]}``, or
a result, ``{"tool_call_id", "content"}``. Any other message is an exchange of its conversation: a user message is a call of
``respond`` with id ``<turn>`` and arguments ``{"text", "turn"}`` that depends on the call two turns before it, where there is one;
an assistant message is the result for id ``<turn - 1>``; a system message stands by itself.

* Linking is a hash join of calls with the first result of each identifier (conversation, id); results are reduced to one row for
  each identifier before they are joined, so a repeated identifier multiplies nothing. A result without a call is an orphan, a
  call without a result is unanswered.
* Order: a call's level is the least that is over the level of each call it needs that stands later, and not under the level of
  those that stand earlier; so (level, turn, number in the message) is a topological order. Almost every call needs earlier ones
  only and stays at 0; rounds run over conversations where one waits for a later one. Levels beyond the number of such waits show
  a cycle: calls on or behind it get level -1 and status ``cycle``.
* Validation: arguments are compared with the schema of their name: required fields and their types. Unknown names are invalid.
* Canonical JSON: fields in code point order, no blanks, arguments rebuilt from their parsed form.

Rows stay messages or calls: no conversation is gathered in one place.

Defined cases: a null or empty text is an ordinary message with text null or ""; null roles are ``other``; JSON that doesn't parse
is ordinary text; a message with null conv_id or null turn is written but links nothing (its calls are unanswered, its results
orphans); repeated rows link alike; an empty table gives an empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from irloom.llm.common import materialise, table

#: Name, field, type (string, number, boolean, object, array), required, fewest characters.
SCHEMAS = [("respond", "text", "string", True, 1), ("respond", "turn", "number", True, 0)]
_CALL = "array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>"


def _kind(v: Column) -> Column:
    """JSON type of a variant."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("BIGINT") | s.startswith("DECIMAL") | s.startswith("DOUBLE"), "number")
        .otherwise("null")
    )


def parse(messages: DataFrame) -> DataFrame:
    """One row for each call, result or other message: conv_id, turn, role, text, number, kind, id, name, arguments, needs."""
    role = F.coalesce("role", F.lit("other"))
    stated = F.from_json(F.get_json_object("text", "$.tool_calls"), _CALL)
    looks = F.col("text").startswith("{")
    m = messages.select("conv_id", "turn", role.alias("role"), "text").withColumns({
        "__calls": F.when(looks, stated),
        "__for": F.when(looks, F.get_json_object("text", "$.tool_call_id")),
    })
    plain = F.col("__calls").isNull() & F.col("__for").isNull()
    own = F.struct(
        F.col("turn").cast("string").alias("id"), F.lit("respond").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.when(F.col("turn") >= 2, F.array((F.col("turn") - 2).cast("string"))).alias("depends_on"),
    )
    calls = F.when(F.col("__calls").isNotNull(), F.col("__calls")).when(plain & (F.col("role") == "user"), F.array(own))
    rows = m.withColumn("__plain", plain).select("*", F.posexplode_outer(calls).alias("number", "c"))
    kind = F.when(F.col("c").isNotNull(), "call").when(F.col("__for").isNotNull() | (F.col("__plain") & (F.col("role") == "assistant")), "result").otherwise("other")
    return rows.select(
        "conv_id", "turn", "role", "text", F.coalesce("number", F.lit(0)).alias("number"), kind.alias("kind"),
        F.when(kind == "call", F.col("c.id")).when(kind == "result", F.coalesce("__for", (F.col("turn") - 1).cast("string"))).alias("id"),
        F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("needs"), F.col("__plain").alias("plain"),
    )


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id, level of the calls over level 0 (-1: on or behind a cycle).

    calls has conv_id, id, turn, number, needs; an id counts once, by its first call."""
    first = calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "number")).alias("at"))
    wants = calls.where(F.size("needs") > 0).select("conv_id", F.col("id").alias("a"), F.explode("needs").alias("b")).distinct()
    placed = wants.join(first.select("conv_id", F.col("id").alias("a"), F.col("at").alias("at_a")), ["conv_id", "a"]).join(first.select("conv_id", F.col("id").alias("b"), F.col("at").alias("at_b")), ["conv_id", "b"])
    placed = placed.select("conv_id", "a", "b", (F.col("at_b") >= F.col("at_a")).cast("int").alias("late"))
    bound = placed.where("late = 1").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("most"))
    edges = materialise(placed.join(bound, "conv_id"), "chat-edges")  # of conversations with a call that waits for a later one
    level = edges.where("late = 1").select("conv_id", F.col("a").alias("id"), F.lit(1).alias("level"), "most").distinct()
    if edges.isEmpty():
        return level.drop("most")
    before = None
    while True:
        grown = edges.join(level.select("conv_id", F.col("id").alias("b"), "level"), ["conv_id", "b"]).select("conv_id", F.col("a").alias("id"), F.least(F.col("level") + F.col("late"), F.col("most") + 1).alias("level"), "most")
        level = materialise(level.union(grown).groupBy("conv_id", "id").agg(F.max("level").alias("level"), F.max("most").alias("most")), "chat-levels")
        now = level.agg(F.count(F.lit(1)), F.sum("level")).first()
        if now == before:
            return level.select("conv_id", "id", F.when(F.col("level") > F.col("most"), -1).otherwise(F.col("level")).alias("level"))
        before = now


def _problems(schemas) -> Column:
    """Names of the fields that offend their schema, in order; null for a name without schema."""
    found = None
    for name in sorted({s[0] for s in schemas}):
        checks = []
        for _, field, kind, required, fewest in sorted(s for s in schemas if s[0] == name):
            v = F.try_variant_get("__args", f"$.{field}", "variant")
            there = v.isNotNull() & (_kind(v) != "null")
            bad = ~there if required else F.lit(False)
            wrong = there & (_kind(v) != kind)
            short = there & (F.coalesce(F.length(F.try_variant_get("__args", f"$.{field}", "string")), F.lit(0)) < fewest) if kind == "string" and fewest else F.lit(False)
            checks.append(F.when(bad | wrong | short, F.lit(field)))
        problems = F.array_join(F.array_compact(F.array(*checks)), ",")
        found = F.when(F.col("name") == name, problems) if found is None else found.when(F.col("name") == name, problems)
    return found


def format_chat(messages: DataFrame, schemas=None) -> DataFrame:
    """A row for each call, orphan or linked result and other message; see the module."""
    rows = parse(messages)
    results = rows.where(F.col("kind") == "result").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "number", "text")).alias("r"), F.count(F.lit(1)).alias("results"))
    calls = rows.where(F.col("kind") == "call")
    late = levels(calls)
    plain_args = F.to_variant_object(F.struct("text", "turn"))
    linked = (
        calls.join(results, ["conv_id", "id"], "left")
        .join(late, ["conv_id", "id"], "left")
        .withColumn("level", F.coalesce("level", F.lit(0)))
        .withColumn("__args", F.when(F.col("plain"), plain_args).otherwise(F.try_parse_json("arguments")))
        .withColumn("problems", _problems(schemas or SCHEMAS))
    )
    linked = linked.withColumn("status", F.when(F.col("level") < 0, "cycle").when(F.col("r").isNull(), "unanswered").otherwise("linked"))
    kept = ["conv_id", "turn", "number", "role", "kind", "id", "level", "result_turn", "status", "valid", "problems", "json"]
    lines = linked.select(
        "conv_id", "turn", "number", "role", "kind", "id", "level", F.col("r.turn").alias("result_turn"), "status",
        (F.coalesce("problems", F.lit("name")) == "").alias("valid"), F.coalesce("problems", F.lit("name")).alias("problems"),
        F.to_json(F.struct(F.col("__args").alias("arguments"), "conv_id", "id", "name", F.col("r.text").alias("result"), "turn")).alias("json"),
    )
    known = calls.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"))
    rest = rows.where(F.col("kind") != "call").join(known, ["conv_id", "id"], "left")
    status = F.when(F.col("kind") == "other", "alone").when(F.col("call_turn").isNull(), "orphan").otherwise("linked")
    others = rest.select(
        "conv_id", "turn", "number", "role", "kind", "id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("result_turn"), status.alias("status"),
        F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("problems"),
        F.to_json(F.struct(F.col("text").alias("content"), "conv_id", "id", "role", "turn")).alias("json"),
    )
    return lines.select(*kept).unionByName(others.select(*kept))


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of the conversations, linked, ordered, checked and written; see the module."""
    return format_chat(table(spark, sf_dir, "conversations"))


#: The SQL covers conversations without messages in JSON; those with them are tested against brute force.
ORACLE_SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'other') AS role, text FROM conversations),
c AS (SELECT *, CAST(turn AS VARCHAR) AS id FROM m WHERE role = 'user'),
r AS (SELECT conv_id, CAST(turn - 1 AS VARCHAR) AS id, min(turn) AS result_turn, arg_min(text, turn) AS result FROM m WHERE role = 'assistant' GROUP BY 1, 2)
SELECT c.conv_id, c.turn, 0 AS number, c.role, 'call' AS kind, c.id, 0 AS level, r.result_turn, CASE WHEN r.id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  coalesce(text, '') <> '' AND turn IS NOT NULL AS valid, concat_ws(',', CASE WHEN coalesce(text, '') = '' THEN 'text' END, CASE WHEN turn IS NULL THEN 'turn' END) AS problems,
  '{"arguments":{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || '},"conv_id":' || c.conv_id || ',"id":"' || c.id || '","name":"respond"' || coalesce(',"result":' || to_json(r.result)::VARCHAR, '') || ',"turn":' || turn || '}' AS json
FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.id = c.id
UNION ALL
SELECT m.conv_id, m.turn, 0, m.role, 'result', CAST(m.turn - 1 AS VARCHAR), NULL, NULL, CASE WHEN k.conv_id IS NULL THEN 'orphan' ELSE 'linked' END, NULL, NULL,
  '{"content":' || to_json(text)::VARCHAR || ',"conv_id":' || m.conv_id || ',"id":"' || (m.turn - 1) || '","role":"assistant","turn":' || m.turn || '}'
FROM m LEFT JOIN (SELECT DISTINCT conv_id, turn FROM c) k ON k.conv_id = m.conv_id AND k.turn = m.turn - 1 WHERE m.role = 'assistant'
UNION ALL
SELECT conv_id, turn, 0, role, 'other', NULL, NULL, NULL, 'alone', NULL, NULL,
  '{"content":' || to_json(text)::VARCHAR || ',"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}'
FROM m WHERE role NOT IN ('user', 'assistant')
"""

QUERIES = {"op1_tool_call_linking": op1_tool_call_linking}
ORACLE = {"op1_tool_call_linking": ORACLE_SQL}
