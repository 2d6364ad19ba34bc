"""Queries that write and read files of every format, and those of steps, validators, generators and filters."""

from __future__ import annotations

import json
import os
import sqlite3

from pyspark.sql import functions as F

from .functions import codecs
from .operators import dedup, validate
from .operators.generate import FakeModel
from .plans import storage
from .plans.dialect import run_sql
from .plans.pipeline import Pipeline
from .queries import pipe, query, read

_NATION = "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation"


def _nations(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("r"))


def _dataset(p: Pipeline):
    return p.datasets["d"].select(F.col("k").cast("long").alias("k"), "name", F.col("r").cast("long").alias("r"))


def _local(spark, name: str) -> str:
    """A path of the driver's own file, for sources that a library opens on the driver."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="millrace-")
    storage.atexit.register(storage._remove_late, spark, f"file://{folder}")
    return os.path.join(folder, name)


# sources


@query(_NATION)
def source_csv(spark, sf):
    path = storage.work_dir(spark, "csv")
    _nations(spark, sf).write.option("sep", ";").option("header", True).csv(path)
    return _dataset(Pipeline("q", spark=spark).with_csv_dataset("d", path, ";"))


@query(_NATION + " WHERE n_regionkey > 1")
def source_csv_without_header(spark, sf):
    path = storage.work_dir(spark, "csv")
    _nations(spark, sf).write.csv(path)
    return _dataset(Pipeline("q", spark=spark).with_csv_dataset("d", path, has_header=False, sql="select column_1 as k, column_2 as name, column_3 as r from d where column_3 > 1"))


@query(_NATION)
def source_jsonl(spark, sf):
    path = storage.work_dir(spark, "jsonl")
    _nations(spark, sf).write.json(path)
    return _dataset(Pipeline("q", spark=spark).with_jsonl_dataset("d", path))


@query(_NATION)
def source_json_array(spark, sf):
    path = storage.work_dir(spark, "json")
    rows = _nations(spark, sf).select(F.to_json(F.collect_list(F.struct("k", "name", "r"))).alias("value"))  # one small array
    rows.write.text(path)
    return _dataset(Pipeline("q", spark=spark).with_json_dataset("d", path))


@query(_NATION)
def source_dicts(spark, sf):
    rows = [r.asDict() for r in _nations(spark, sf).collect()]  # 25 rows
    return _dataset(Pipeline("q", spark=spark).with_dicts_dataset("d", rows))


@query(_NATION)
def source_by_extension(spark, sf):
    path = storage.work_dir(spark, "auto") + ".parquet"
    _nations(spark, sf).write.parquet(path)
    return _dataset(Pipeline("q", spark=spark).with_polars_dataset("d", path, "select * from d"))


@query(_NATION)
def source_arrow(spark, sf):
    return _dataset(Pipeline("q", spark=spark).with_arrow_dataset("d", _nations(spark, sf).toArrow().to_reader()))


@query(_NATION + " WHERE n_regionkey = 2")
def source_database(spark, sf):
    path = _local(spark, "d.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table n (k integer, name text, r integer)")
        db.executemany("insert into n values (?, ?, ?)", [tuple(r) for r in _nations(spark, sf).collect()])  # 25 rows
    return _dataset(Pipeline("q", spark=spark).with_db_dataset("d", f"sqlite://{path}", "select * from n where r = 2"))


@query("SELECT * FROM (VALUES ('find_place', 'Finds a place', 'id,kind'), ('make_place', 'Adds a place', 'name')) t(name, description, fields)")
def source_openapi(spark, sf):
    path = _local(spark, "api.json")
    body = {"content": {"application/json": {"schema": {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}}}}
    number, text = {"type": "integer"}, {"type": "string"}
    get = {"operationId": "find_place", "summary": "Finds a place", "parameters": [{"name": "id", "required": True, "schema": number}, {"name": "kind", "schema": text}]}
    with open(path, "w") as f:
        json.dump({"paths": {"/places": {"get": get, "post": {"operationId": "make_place", "summary": "Adds a place", "requestBody": body}}}}, f)
    d = Pipeline("q", spark=spark).with_openapi_dataset("d", path).datasets["d"]
    names = F.array_sort(F.map_keys(F.from_json(F.col("parameters.properties"), "map<string,string>")))
    return d.select("name", "description", F.array_join(names, ",").alias("fields"))


@query("SELECT * FROM (VALUES ('Place', 'height,name')) t(name, fields)")
def source_pydantic(spark, sf):
    from pydantic import BaseModel

    class Place(BaseModel):
        name: str
        height: int | None = None

    d = Pipeline("q", spark=spark).with_pydantic_models_dataset("d", [Place]).datasets["d"]
    column = next(c for c in ("schema", "parameters") if c in d.columns)
    props = F.get_json_object(F.to_json(column) if dict(d.dtypes)[column] != "string" else F.col(column), "$.properties")
    return d.select("name", F.array_join(F.array_sort(F.json_object_keys(props)), ",").alias("fields"))


# sinks, read back


@query("SELECT '{\"id\": ' || n_nationkey || ', \"name\": \"' || n_name || '\"}' AS line FROM nation")
def sink_jsonl(spark, sf):
    path = storage.work_dir(spark, "out")
    pipe(spark, sf, "nation").with_template("t", '{"id": {{nation.n_nationkey}}, "name": {{nation.n_name|jstr}}}').iter_dataset("nation").write_jsonl(path, template="t").run()
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT '\"' || n_name || '\";' || n_regionkey || ';' || n_nationkey AS line FROM nation")
def sink_csv(spark, sf):
    path = storage.work_dir(spark, "out")
    r = pipe(spark, sf, "nation").iter_dataset("nation").add_column("a", "nation.n_name").add_column("b", "nation.n_regionkey").add_column("c", "nation.n_nationkey")
    r.write_csv(path, ["a", "b", "c"], ";").run()
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT n_name AS name, CAST(n_nationkey * 10 AS BIGINT) AS tens FROM nation")
def sink_parquet(spark, sf):
    path = storage.work_dir(spark, "out")
    pipe(spark, sf, "nation").iter_dataset("nation").add_column("name", "nation.n_name").add_column("tens", "nation.n_nationkey * 10").write_parquet(path).run()
    return spark.read.parquet(path).select("name", F.col("tens").cast("long").alias("tens"))


# steps of Python functions


@query("SELECT p_partkey AS k, upper(p_name) AS loud FROM part")
def mutate_lambda(spark, sf):
    r = pipe(spark, sf, "part").iter_dataset("part").add_column("k", "part.p_partkey").add_column("loud", "part.p_name")
    return r.mutate("loud", lambda v: v.upper(), returns="string").dataframe().select("k", "loud")


@query("SELECT s_suppkey AS k, s_suppkey * 3 + length(s_name) AS v FROM supplier")
def map_context(spark, sf):
    def change(context: dict) -> dict:
        s = context["data"]["supplier"]
        return {**context, "data": {"k": s["s_suppkey"], "v": s["s_suppkey"] * 3 + len(s["s_name"])}}

    return pipe(spark, sf, "supplier").iter_dataset("supplier").map(change, returns="k long, v long").dataframe().select("k", "v")


class Tagged:
    """A step that adds a key."""

    def process(self, context: dict) -> dict:
        s = context["data"]["supplier"]
        context["data"] = {"k": s["s_suppkey"], "tag": f"{s['s_nationkey']}:{s['s_name']}"}
        return context


@query("SELECT s_suppkey AS k, s_nationkey || ':' || s_name AS tag FROM supplier")
def custom_step(spark, sf):
    return pipe(spark, sf, "supplier").iter_dataset("supplier").step(Tagged(), returns="k long, tag string").dataframe().select("k", "tag")


@query("SELECT c_custkey AS k FROM customer WHERE length(c_name) % 2 = 0 OR c_nationkey > 10")
def validate_lambda(spark, sf):
    r = pipe(spark, sf, "customer").iter_dataset("customer").add_column("k", "customer.c_custkey")
    return r.validate(lambda c: len(c["data"]["customer"]["c_name"]) % 2 == 0 or c["data"]["customer"]["c_nationkey"] > 10).dataframe().select("k")


# validators


def _tool(d: dict) -> str:
    """Of each part a tool, well formed but for every third and fourth kind of key."""
    k, kinds = d["part"]["p_partkey"], {"type": "object", "properties": {"size": {"type": "integer"}}, "required": ["size"]}
    tool = {"name": f"part_{k}", "description": "d", "parameters": kinds}
    if k % 3 == 0:
        tool["name"] = "no good name!"
    if k % 4 == 0:
        kinds["required"] = ["weight"]
    return json.dumps([tool])


@query("SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0")
def validate_tools_rules(spark, sf):
    r = pipe(spark, sf, "part").iter_dataset("part").add_column("k", "part.p_partkey").add_column("tools", _tool, returns="string")
    return r.validate_tools("tools").dataframe().select("k")


def _talk(d: dict) -> str:
    """Of each part a conversation, with calls that are wrong for some keys."""
    k = d["part"]["p_partkey"]
    tool = {"name": "weigh", "description": "d", "parameters": {"type": "object", "properties": {"id": {"type": "integer"}}, "required": ["id"]}}
    call = {"role": "assistant", "tool_calls": [{"function": {"name": "weigh" if k % 3 else "lift", "arguments": {"id": k if k % 4 else "x"}}}]}
    end = {"role": "assistant" if k % 5 else "nobody", "content": "It is heavy."}
    return json.dumps({"messages": [{"role": "user", "content": "How heavy?"}, call, {"role": "tool", "content": '{"kg": 1}'}, end], "tools": [tool]})


@query("SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 <> 0")
def validate_conversation_rules(spark, sf):
    r = pipe(spark, sf, "part").iter_dataset("part").add_column("k", "part.p_partkey").add_column("c", _talk, returns="string")
    return r.validate_conversation("c").dataframe().select("k")


def _old_talk(k: int) -> str:
    says = {"speaker": "human", "message": "q", "action": None, "details": None}
    call = {"speaker": "assistant", "message": None, "action": "function-call", "details": {"name": "f", "arguments": {}}}
    return json.dumps({"conversation": [says, call] if k % 2 else [{"speaker": "human"}]})


@query("SELECT r_regionkey AS k, r_regionkey % 2 = 1 AS good FROM region")
def validate_legacy(spark, sf):
    good = F.udf(lambda k: validate.conversation_valid(json.loads(_old_talk(k))), "boolean")
    return read(spark, sf, "region").select(F.col("r_regionkey").alias("k"), good("r_regionkey").alias("good"))  # five rows


# generators


def _answer(messages: list, schema) -> str:
    asked = messages[-1]["content"] if isinstance(messages[-1], dict) else str(messages[-1])
    return json.dumps({"a": asked.split()[-1], "n": len(asked)}) if schema else f"answer to {asked}"


@query("SELECT n_nationkey AS k, n_name AS a, length('Describe ' || n_name) AS n FROM nation")
def generate_json_fields(spark, sf):
    p = pipe(spark, sf, "nation").with_llm("m", FakeModel(_answer)).with_template("ask", "Describe {{nation.n_name}}")
    p.with_template("schema", '{"properties": {"a": {"type": "string"}, "n": {"type": "integer"}}, "required": ["a", "n"]}')
    r = p.iter_dataset("nation").add_column("k", "nation.n_nationkey").generate_json("ask", "m", "j", schema_template="schema").dataframe()
    words = F.element_at(F.split("name", " "), -1)
    out = r.select("k", F.col("nation.n_name").alias("name"), F.get_json_object("j", "$.a").alias("last"), F.get_json_object("j", "$.n").cast("long").alias("n"))
    return out.where(F.col("last") == words).select("k", F.col("name").alias("a"), "n")


@query("SELECT n_nationkey AS k, 'answer to Describe ' || n_name AS a FROM nation")
def generate_text_content(spark, sf):
    p = pipe(spark, sf, "nation").with_llm("m", FakeModel(_answer)).with_template("ask", "Describe {{nation.n_name}}")
    return p.iter_dataset("nation").add_column("k", "nation.n_nationkey").generate_text("ask", "m", "a").dataframe().select("k", "a")


# filters


@query("""SELECT n_nationkey AS k, '"' || n_name || '"' AS quoted, '{"a":' || n_nationkey || ',"b":"' || n_name || '"}' AS whole, '{"a":' || n_nationkey || ',"b":"' || n_name || '"}' AS again, '[["a",' || n_nationkey || '],["b","' || n_name || '"]]' AS items, n_name || '' AS value FROM nation""")
def template_filters(spark, sf):
    p = pipe(spark, sf, "nation").with_template("q", "{{name|jstr}}").with_template("w", "{{doc|tojson}}").with_template("a", "{{text|deserialize}}").with_template("i", "{{doc|dict2items}}").with_template("v", "{{(said|extract_json).b}}")
    r = p.iter_dataset("nation").add_column("k", "nation.n_nationkey").add_column("name", "nation.n_name")
    r = r.add_column("text", lambda d: json.dumps({"a": d["k"], "b": d["name"]}), returns="string").add_column("doc", lambda d: {"a": d["k"], "b": d["name"]})
    r = r.add_column("said", lambda d: "It is this: ```json\n" + d["text"] + "\n```", returns="string")
    return r.render("q", "quoted").render("w", "whole").render("a", "again").render("i", "items").render("v", "value").dataframe().select("k", "quoted", "whole", "again", "items", "value")


@query("SELECT vec_id, CAST(len(embedding) * 4 AS INTEGER) AS n_bytes, CAST(embedding AS DOUBLE[]) AS back FROM embeddings")
def vector_blobs(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", codecs.to_blob_column(F.col("embedding")).alias("blob"))
    return e.select("vec_id", F.length("blob").alias("n_bytes"), codecs.from_blob_column(F.col("blob")).alias("back"))


# more SQL


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sql_order_limit_offset(spark, sf):
    pipe(spark, sf, "orders")
    return run_sql(spark, "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def sql_left_join(spark, sf):
    pipe(spark, sf, "customer", "orders")
    return run_sql(spark, "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT -c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
def sql_semi_anti_join(spark, sf):
    pipe(spark, sf, "customer", "orders")
    return run_sql(spark, "select c_custkey from customer anti join orders on o_custkey = c_custkey union all select -c_custkey from customer semi join orders on o_custkey = c_custkey")


@query("SELECT r_name, n_name FROM (SELECT * FROM region WHERE r_regionkey < 3) r FULL JOIN (SELECT * FROM nation WHERE n_regionkey > 1) n ON n_regionkey = r_regionkey")
def sql_full_join(spark, sf):
    pipe(spark, sf, "region", "nation")
    return run_sql(spark, "select r_name, n_name from (select * from region where r_regionkey < 3) r full join (select * from nation where n_regionkey > 1) n on n_regionkey = r_regionkey")


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, min(o_orderdate) AS first FROM orders GROUP BY ALL")
def sql_temporal(spark, sf):
    pipe(spark, sf, "orders")
    return run_sql(spark, "select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n, min(o_orderdate) as first from orders group by all")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 30 THEN 'many' WHEN l_quantity > 10 THEN 'some' ELSE 'few' END AS size, coalesce(nullif(l_returnflag, 'N'), '-') AS flag, greatest(l_discount, l_tax) AS top FROM lineitem")
def sql_conditional(spark, sf):
    pipe(spark, sf, "lineitem")
    return run_sql(spark, "select l_orderkey, l_linenumber, case when l_quantity > 30 then 'many' when l_quantity > 10 then 'some' else 'few' end as size, coalesce(nullif(l_returnflag, 'N'), '-') as flag, greatest(l_discount, l_tax) as top from lineitem")


@query("SELECT DISTINCT n_regionkey AS r, n_name AS first FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) WHERE k = 1")
def deduplicate_in_memory(spark, sf):
    """`deduplicate_texts` of each region's number, repeated for each of its nations: the first nation of each stays."""
    rows = read(spark, sf, "nation").select("n_regionkey", "n_name", "n_nationkey").orderBy("n_nationkey").collect()  # 25 rows
    names = ["first words of all", "quite another text here", "a third one stands there", "the fourth is unlike them", "and so the fifth one ends"]
    kept = dedup.deduplicate_texts([names[r.n_regionkey] for r in rows], 3)
    firsts = [next(r for r in rows if names[r.n_regionkey] == t) for t in kept]
    return spark.createDataFrame([(r.n_regionkey, r.n_name) for r in firsts], "r long, first string")
