"""Tool calls linked to their results, ordered, validated and written as canonical JSON. DataFrame functions only.

Messages are (conv_id, turn, role, text). An assistant's text may be JSON with calls,

    {"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "...", "limit": 3}}, ...]}

and a text of role ``tool`` a result, {"call_id": "a", "content": ...}. A string argument "$result:ID" uses
the result of another call of the conversation. Texts that are no such JSON are plain messages and give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.llm.common import query, settle, table

REFERENCE = r"\$result:([A-Za-z0-9_.-]+)"


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, idx, call_id, name, arguments) and results (conv_id, turn, call_id, content)."""
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.lower("role").alias("role"), F.try_parse_json(F.col("text").cast("string")).alias("v"))
    calls = base.where("role = 'assistant' and v is not null").select(
        "conv_id", "turn", F.posexplode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("idx", "c"))
    calls = calls.select("conv_id", "turn", "idx", F.try_variant_get("c", "$.id", "string").alias("call_id"),
                         F.try_variant_get("c", "$.name", "string").alias("name"), F.try_variant_get("c", "$.arguments", "variant").alias("arguments"))
    results = base.where("role = 'tool' and v is not null").select(
        "conv_id", "turn", F.try_variant_get("v", "$.call_id", "string").alias("call_id"), F.to_json(F.try_variant_get("v", "$.content", "variant")).alias("content"))
    return calls, results


def json_type(value: Column) -> Column:
    """The JSON Schema type of a variant."""
    t = F.schema_of_variant(value)
    return (F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
            .when(t == "VOID", "null").when(t.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | t.endswith(",0)"), "integer").otherwise("number"))


def levels(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls with dependencies, edges being (conv_id, call_id, dep, dep_waits).

    Rounds of Kahn's order on the whole table: a call is placed one level below the deepest of its
    dependencies once all are placed. ``dep_waits`` tells whether the dependency has dependencies itself. As many rounds as
    the longest chain of references; what is left lies on a cycle or behind one and has no row.
    """
    open_edges = settle(edges.select("conv_id", "call_id", "dep", F.when(~F.col("dep_waits"), F.lit(0)).alias("at")), "edges")
    done = None
    while True:
        ready = open_edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("at").alias("k"), (F.max("at") + 1).alias("level"))
        ready = settle(ready.where("n = k").select("conv_id", "call_id", "level"), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        left = open_edges.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        placed = ready.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("now"))
        open_edges = settle(left.join(placed, ["conv_id", "dep"], "left").select("conv_id", "call_id", "dep", F.coalesce("at", "now").alias("at")), "edges")
    return edges.select("conv_id", "call_id", F.lit(None).cast("int").alias("level")).limit(0) if done is None else done


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, turn, idx, call_id, name, level, n_results, errors, valid, json.

    ``schemas`` is (tool, param, type, required BOOLEAN). A call is linked to the first result of its id (by turn,
    then content) in its conversation. (level, turn, idx) is a topological order. errors is a sorted list of: no_id (null or empty id, or null
    conv_id: never linked), duplicate_id (all but the first call of an id, by turn, idx, name; equal rows in any
    order), no_result, unknown_tool, arguments_not_object, missing:P, unexpected:P,
    type:P, unknown_reference:ID, unresolved (on a cycle or behind one). json has sorted keys.
    """
    calls, results = parse(messages)
    args = F.try_variant_get("arguments", "$", "map<string,variant>")
    text = F.to_json("arguments")
    calls = calls.withColumn("named", F.coalesce((F.col("call_id") != "") & F.col("conv_id").isNotNull(), F.lit(False)))
    # Calls without an id are spread by their own hash: they need no common window.
    spread = F.when(F.col("named"), F.lit(0)).otherwise(F.xxhash64("turn", "idx", "name", text))
    one_id = Window.partitionBy("conv_id", "call_id", "spread").orderBy("turn", "idx", "name", text)
    calls = calls.withColumn("spread", spread).withColumn("nth", F.row_number().over(one_id))
    entries = F.transform(F.map_entries(args), lambda e: F.struct(e["key"].alias("param"), json_type(e["value"]).alias("type")))
    refs = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))))
    calls = settle(calls.select("conv_id", "turn", "idx", "call_id", "name", text.alias("arguments"), "named", "nth",
                                F.when(args.isNotNull(), entries).alias("given"), F.coalesce(refs, F.array().cast("array<string>")).alias("refs")), "calls")
    nodes = calls.where("named and nth = 1")

    deps = nodes.select("conv_id", "call_id", F.explode("refs").alias("dep"))
    known = nodes.select("conv_id", F.col("call_id").alias("dep"), (F.size("refs") > 0).alias("dep_waits"))
    deps = settle(deps.join(known, ["conv_id", "dep"], "left"), "deps")
    # A call whose references are all unknown waits for nothing.
    real = deps.where("dep_waits is not null")
    waits = real.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("w")).distinct()
    real = real.join(waits, ["conv_id", "dep"], "left").select("conv_id", "call_id", "dep", F.coalesce("w", F.lit(False)).alias("dep_waits"))
    placed = levels(real)
    unknown = deps.where("dep_waits is null").groupBy("conv_id", "call_id").agg(F.collect_set(F.concat(F.lit("unknown_reference:"), "dep")).alias("unknown"))
    bound = real.select("conv_id", "call_id").distinct().join(placed, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "level", F.lit(True).alias("waits"))

    got = results.where("call_id <> '' and conv_id is not null").groupBy("conv_id", "call_id").agg(
        F.count("*").alias("n_results"), F.min(F.struct("turn", "content"))["content"].alias("content"))
    shape = schemas.groupBy("tool").agg(F.collect_set(F.struct("param", "type", "required")).alias("params"))
    linked = nodes.select("conv_id", "call_id").join(got, ["conv_id", "call_id"]).join(bound, ["conv_id", "call_id"], "full").join(unknown, ["conv_id", "call_id"], "full")
    linked = linked.withColumns({"named": F.lit(True), "nth": F.lit(1)})
    out = calls.join(linked, ["conv_id", "call_id", "named", "nth"], "left").join(shape, calls["name"] == shape["tool"], "left")
    one = F.col("named") & (F.col("nth") == 1)
    empty = F.array().cast("array<string>")

    def when(condition: Column, name: str) -> Column:
        return F.when(condition, F.array(F.lit(name))).otherwise(empty)

    given, params = F.coalesce(F.col("given"), F.array().cast("array<struct<param:string,type:string>>")), F.col("params")
    names = F.transform(given, lambda g: g["param"])
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.array_contains(names, p["param"])), lambda p: F.concat(F.lit("missing:"), p["param"]))
    unexpected = F.transform(F.filter(given, lambda g: ~F.exists(params, lambda p: p["param"] == g["param"])), lambda g: F.concat(F.lit("unexpected:"), g["param"]))
    fits = lambda p, g: (p["type"] == g["type"]) | ((p["type"] == "number") & (g["type"] == "integer"))
    wrong = F.transform(F.filter(given, lambda g: F.exists(params, lambda p: (p["param"] == g["param"]) & ~fits(p, g))), lambda g: F.concat(F.lit("type:"), g["param"]))
    checked = F.when(F.col("given").isNull(), F.array(F.lit("arguments_not_object"))).when(params.isNull(), empty).otherwise(F.concat(missing, unexpected, wrong))
    errors = F.array_sort(F.concat(
        when(~F.col("named"), "no_id"), when(F.col("named") & (F.col("nth") > 1), "duplicate_id"), when(one & F.col("n_results").isNull(), "no_result"),
        when(params.isNull(), "unknown_tool"), checked, F.coalesce("unknown", empty), when(F.coalesce("waits", F.lit(False)) & F.col("level").isNull(), "unresolved")))
    level = F.when(one, F.when(F.col("waits"), F.col("level")).otherwise(F.lit(0)))
    out = out.select("conv_id", "turn", "idx", "call_id", "name", level.cast("long").alias("level"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
                     errors.alias("errors"), (F.size(errors) == 0).alias("valid"), "arguments", "content")
    quote = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    line = F.concat(F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), quote("call_id"), F.lit(',"name":'), quote("name"),
                    F.lit(',"result":'), F.coalesce("content", F.lit("null")), F.lit("}"))
    return out.withColumn("json", line).drop("arguments", "content")


TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", True), ("summarise", "text", "string", True),
         ("summarise", "max_words", "integer", True), ("reply", "text", "string", True), ("reply", "after", "string", False)]


def staged_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool messages: an assistant's turn becomes a call made of its text, a user's turn the result of the turn before.

    Every text of the table is carried whole. Call names, missing or mistyped arguments and
    references follow from the length of the text and the turn.
    """
    n, t = F.coalesce(F.length("text"), F.lit(0)), F.col("turn")
    search = F.when(n % 5 == 0, F.to_json(F.struct(F.col("text").alias("query")))).otherwise(F.to_json(F.struct(F.col("text").alias("query"), (n % 7).alias("limit"))))
    summary = F.when(n % 4 == 0, F.to_json(F.struct(F.col("text"), n.cast("string").alias("max_words")))).otherwise(F.to_json(F.struct(F.col("text"), n.alias("max_words"))))
    reply = F.to_json(F.struct(F.col("text"), F.concat(F.lit("$result:call_"), F.floor(t / 2).cast("string")).alias("after")))
    name = F.when(n % 3 == 0, "search").when(n % 3 == 1, "summarise").otherwise("reply")
    args = F.when(n % 3 == 0, search).when(n % 3 == 1, summary).otherwise(reply)
    call = F.concat(F.lit('{"tool_calls":[{"id":"call_'), t.cast("string"), F.lit('","name":"'), name, F.lit('","arguments":'), args, F.lit("}]}"))
    result = F.concat(F.lit('{"call_id":"call_'), (t - 1).cast("string"), F.lit('","content":'), F.to_json(F.struct(F.col("text"))), F.lit("}"))
    return conversations.select("conv_id", "turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"),
                                F.when(F.col("role") == "assistant", call).when(F.col("role") == "user", result).otherwise(F.col("text")).alias("text"))


ORACLE = r"""
with recursive base as (select conv_id, turn, role, text, coalesce(length(text), 0) n from conversations),
raw as (
  select conv_id, turn, 'call_' || turn call_id, n, text,
    case n % 3 when 0 then 'search' when 1 then 'summarise' else 'reply' end as "name",
    case n % 3 when 0 then case when n % 5 = 0 then '{"query":' || to_json(text) || '}' else '{"limit":' || (n % 7) || ',"query":' || to_json(text) || '}' end
      when 1 then case when n % 4 = 0 then '{"max_words":"' || n || '","text":' || to_json(text) || '}' else '{"max_words":' || n || ',"text":' || to_json(text) || '}' end
      else '{"after":"$result:call_' || (turn // 2) || '","text":' || to_json(text) || '}' end args
  from base where role = 'assistant' and text is not null),
numbered as (select *, row_number() over (partition by conv_id, turn order by "name", args) nth,
    case when n % 3 = 2 then 'call_' || (turn // 2) end dep from raw),
nodes as (select * from numbered where nth = 1),
deps as (select a.conv_id, a.call_id, a.dep, b.call_id is not null known from nodes a left join nodes b on a.conv_id = b.conv_id and a.dep = b.call_id where a.dep is not null),
placed(conv_id, call_id, level) as (
  select conv_id, call_id, 0 from nodes where not exists (select 1 from deps d where d.known and d.conv_id = nodes.conv_id and d.call_id = nodes.call_id)
  union all
  select d.conv_id, d.call_id, p.level + 1 from placed p join deps d on d.known and d.conv_id = p.conv_id and d.dep = p.call_id),
got as (select conv_id, 'call_' || (turn - 1) call_id, count(*) n_results, arg_min('{"text":' || to_json(text) || '}', (turn, text)) content
  from base where role = 'user' and text is not null group by all),
joined as (
  select m.*, p.level, g.n_results, g.content, d.known,
    list_sort(list_filter([
      case when m.nth > 1 then 'duplicate_id' end,
      case when m.nth = 1 and g.n_results is null then 'no_result' end,
      case when m.n % 3 = 0 and m.n % 5 = 0 then 'missing:limit' end,
      case when m.n % 3 = 1 and m.n % 4 = 0 then 'type:max_words' end,
      case when m.nth = 1 and d.known = false then 'unknown_reference:' || m.dep end,
      case when m.nth = 1 and d.known and p.level is null then 'unresolved' end], lambda x: x is not null)) errors
  from numbered m
  left join placed p on m.nth = 1 and p.conv_id = m.conv_id and p.call_id = m.call_id
  left join got g on m.nth = 1 and g.conv_id = m.conv_id and g.call_id = m.call_id
  left join deps d on m.nth = 1 and d.conv_id = m.conv_id and d.call_id = m.call_id)
select conv_id, turn, call_id, "name", level::bigint as level, coalesce(n_results, 0) n_results, array_to_string(errors, ' ') errors, len(errors) = 0 as valid,
  '{"arguments":' || args || ',"id":"' || call_id || '","name":"' || "name" || '","result":' || coalesce(content, 'null') || '}' json
from joined"""


@query("op5_tool_calls", ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    schemas = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean")
    linked = link(staged_messages(table(spark, sf_dir, "conversations")), schemas)
    return linked.select("conv_id", "turn", "call_id", "name", "level", "n_results", F.array_join("errors", " ").alias("errors"), "valid", "json")
