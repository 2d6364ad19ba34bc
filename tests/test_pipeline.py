import json
import random
import sqlite3

import pyarrow as pa
import pytest

from millrace import CHATML, Chain, ChatTemplateBuilder, InternalDatasetType, IterBy, JudgeType, Metadata, Pipeline, StepError
from millrace.operators.generate import FakeModel, HashEmbedder

SHOP = [
    {"name": n, "description": f"a {n}", "price": p, "size": s}
    for n, p, s in zip(["pen", "ink", "cup", "jar", "hat", "bag", "map", "box", "rug", "mug"], [1.5, 0.5, 3.0, 0.75, 2.0, 4.5, 1.0, 2.5, 0.25, 1.2], ["S", "M", "L", "S", "M", "L", "S", "M", "L", "S"])
]


@pytest.fixture
def shop(spark):
    return pa.Table.from_pylist(SHOP)


def pipe(spark, **kw):
    return Pipeline("test", spark=spark, **kw)


def rows(runner):
    return [r.asDict(recursive=True) for r in runner.dataframe().orderBy("index").collect()]


def test_sql_filter_on_source(spark, tmp_path, shop):
    spark.createDataFrame(shop).write.parquet(str(tmp_path / "p"))
    p = pipe(spark).with_parquet_dataset("items", str(tmp_path / "p"), sql="select * from items where price > 1.0")
    assert p.datasets["items"].count() == 6
    assert sorted(r["index"] for r in rows(p.iter_dataset("items"))) == list(range(6))


def test_pushdown_reaches_the_scan(spark, tmp_path, shop):
    spark.createDataFrame(shop).write.parquet(str(tmp_path / "p"))
    p = pipe(spark).with_parquet_dataset("items", str(tmp_path / "p"), sql="select name from items where price > 1.0")
    plan = p.datasets["items"]._jdf.queryExecution().toString()
    assert "GreaterThan(price,1.0)" in plan and "ReadSchema: struct<name:string,price:double>" in plan


@pytest.mark.parametrize("sep", [",", ";"])
@pytest.mark.parametrize("header", [True, False])
def test_csv(spark, tmp_path, sep, header):
    f = tmp_path / "x.csv"
    f.write_text((f"name{sep}description\n" if header else "") + f"a{sep}b\nc{sep}d\n")
    df = pipe(spark).with_csv_dataset("t", str(f), sep, header).datasets["t"]
    assert df.columns == (["name", "description"] if header else ["column_1", "column_2"]) and df.count() == 2


def test_json_sources_and_mixed(spark, tmp_path, lines):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "f1", "description": "x"}, {"name": "f2", "description": "y"}]))
    (tmp_path / "b.jsonl").write_text('{"name": "p1"}\n{"name": "p2"}\n')
    p = pipe(spark).with_json_dataset("functions", str(tmp_path / "a.json")).with_jsonl_dataset("personas", str(tmp_path / "b.jsonl")).with_mixed_dataset("mixed", ["functions", "personas"])
    got = rows(p.iter_dataset("mixed"))
    assert [(r["mixed"]["functions"]["name"], r["mixed"]["personas"]["name"]) for r in got] == [("f1", "p1"), ("f1", "p2"), ("f2", "p1"), ("f2", "p2")]


def test_dicts_arrow_db_auto_internal(spark, tmp_path, shop):
    db = tmp_path / "x.db"
    with sqlite3.connect(db) as c:
        c.execute("create table functions (id integer primary key, name text, description text)")
        c.executemany("insert into functions (name, description) values (?, ?)", [("a", "b"), ("c", "d")])
    (tmp_path / "a.ndjson").write_text('{"x": 1}\n')
    p = pipe(spark).with_db_dataset("db", f"sqlite://{db}", "select * from functions").with_dicts_dataset("d", SHOP).with_arrow_dataset("a", shop).with_polars_dataset("auto", str(tmp_path / "a.ndjson"), "select x + 1 as y from auto")
    p.with_internal_dataset(InternalDatasetType.Openings)
    assert [p.datasets[k].count() for k in ("db", "d", "a", "auto", "openings::question", "openings::ask", "openings::neutral")] == [2, 10, 10, 1, 13, 44, 10]
    with pytest.raises(ValueError):
        p.with_arrow_dataset("bad", [1])
    with pytest.raises(ValueError):
        p.with_polars_dataset("bad", "x.doc")


def test_ranges(spark):
    p = pipe(spark)
    assert [r["index"] for r in rows(p.iter_range(2, 8, 3))] == [2, 5]
    assert len(rows(p.iter(IterBy.Range(0, 4)))) == 4
    assert rows(p.iter_range(5, 1)) == []
    with pytest.raises(ValueError):
        p.iter_range(0, 5, 0)
    with pytest.raises(ValueError):
        p.iter("x")


def test_expressions(spark):
    r = pipe(spark).iter_range(10).add_column("a", "1 + 1", is_json=False).add_column("b", "a + 1", is_json=False).add_column("c", lambda data: {"val": 4, "val2": {"subval": 5}}).add_column("d", "c.val2.subval").add_column("e", "10").mutate("e", "e / 2", is_json=False).mutate("e", "e - 5", is_json=False)
    got = rows(r)
    assert all(x["b"] == 3 and json.loads(x["d"]) == 5 and x["e"] == 0 for x in got)
    with pytest.raises(StepError):
        r.add_column("a", "2")


def test_native_steps_use_no_python(spark):
    r = pipe(spark).iter_range(10).add_column("a", "index % 3").filter("a == 1 or a == 2").add_column("t", "'n' ~ a")
    assert "Python" not in r.df._jdf.queryExecution().toString()
    assert [x["t"] for x in rows(r)][:2] == ["n1", "n2"]


def test_filters(spark):
    r = pipe(spark).iter_range(10).add_column("n", lambda d: d["index"]).filter(lambda d: d["n"] % 2 == 0).filter("n > 2").filter("'maybe'")
    assert [json.loads(x["n"]) for x in rows(r)] == [4, 6, 8]
    r = pipe(spark).iter_range(3).filter(lambda d: 1 / d["index"] > 0)
    assert [x["index"] for x in rows(r)] == [1, 2]
    assert r.rejected().collect()[0]["count"] == 1


def test_lambda_failure_drops_row(spark):
    r = pipe(spark).iter_range(3).add_column("x", lambda d: 1 // d["index"], returns="long").mutate("x", lambda v: v + 1, returns="long")
    assert [x["x"] for x in rows(r)] == [2, 1]


def test_map_and_step(spark):
    class Custom:
        def process(self, context):
            context["data"]["hello"] = "world"
            del context["data"]["gone"]
            return context

    r = pipe(spark).with_template("out", "{{hello}} {{index}}").iter_range(2).add_column("gone", "1").step(Custom()).render("out", "text")
    assert [x["text"] for x in rows(r)] == ["world 0", "world 1"]
    r = pipe(spark).iter_range(2).map(lambda c: {**c, "data": {"y": c["data"]["index"] * 2}}, returns="y long")
    assert [x["y"] for x in rows(r)] == [0, 2]


def test_sample_read_into_list(spark, shop):
    p = pipe(spark).with_arrow_dataset("items", shop)
    got = rows(p.iter_range(10).sample("items", 3, "s").read("items", "all").add_column("n", "s|length").into_list(["index", "n"], "l"))
    assert all(len({i["name"] for i in x["s"]}) == 3 and [i["name"] for i in x["all"]] == [i["name"] for i in SHOP] and x["n"] == 3 for x in got)
    assert len({tuple(i["name"] for i in x["s"]) for x in got}) > 3
    with pytest.raises(StepError):
        p.iter_range(1).sample("items", 11, "s")


def test_ifelse(spark):
    r = pipe(spark).iter_range(6).ifelse("index % 2 == 0", Chain().add_column("v", "index * 10"), Chain().filter("index > 1").add_column("v", lambda d: "odd"))
    assert [(x["index"], json.loads(x["v"])) for x in rows(r)] == [(0, 0), (2, 20), (3, "odd"), (4, 40), (5, "odd")]
    r = pipe(spark).iter_range(4).ifelse(lambda d: d["index"] > 1, Chain().ifelse("index == 3", Chain().add_column("w", "1")))
    assert [x["w"] for x in rows(r)] == [None, None, None, 1]


def test_writers(spark, tmp_path, lines, shop):
    out = str(tmp_path / "o")
    pipe(spark).with_template("t", '{"n": {{items.name|jstr}}, "i": {{index}}}').with_arrow_dataset("items", shop).iter_dataset("items").add_column("name", "items.name").write_jsonl(out, template="t").write_csv(str(tmp_path / "c"), ["name", "index", "none"], ";").write_jsonl(str(tmp_path / "one.jsonl"), value="items", single_file=True).run()
    assert sorted(x["n"] for x in lines(out)) == sorted(s["name"] for s in SHOP)
    assert sorted(lines(str(tmp_path / "c"), str))[0] == '"bag";5'
    assert len(lines(str(tmp_path / "one.jsonl"))) == 10


def test_render_and_random(spark):
    got = rows(pipe(spark).with_template("t", "{% for i in [1,2] %}{{i}}-{% endfor %}{{ r }}").iter_range(20).add_random("r", 3, 5).render("t", "x"))
    assert {x["r"] for x in got} == {3, 4} and all(x["x"] == f"1-2-{x['r']}" for x in got)


def test_chunk(spark):
    text = "One two three. Four five six.\n\nSeven eight nine ten. Eleven twelve."
    got = rows(pipe(spark).iter_range(1).add_column("t", lambda d: text, returns="string").chunk((5, 20), "t", "c"))[0]["c"]
    assert "".join(got) == text and all(len(c) <= 20 for c in got) and len(got) > 2


def conversation(spark):
    r = pipe(spark).iter_range(1)
    for k, v in {"system": "You help.", "question": "Who won?", "call1": '{ "name": "get_who_won", "arguments": { "year": 2020 } }', "response": '{"winner": "LA", "year": 2020}', "answer": "LA won.", "thinking": "look it up"}.items():
        r = r.add_column(k, lambda d, v=v: v)
    return r


def test_conversation(spark):
    r = conversation(spark).render_sft("\n@s:system\n@u:question\n@a:tool_calls([call1])\n@t:response\n@a:think(thinking)\n@a:answer\n", "c", separator="\n")
    m = json.loads(rows(r)[0]["c"])["messages"]
    assert [x["role"] for x in m] == ["system", "user", "assistant", "tool", "assistant", "assistant"]
    assert m[2]["tool_calls"] == [{"function": {"name": "get_who_won", "arguments": {"year": 2020}}}]
    assert m[4] == {"role": "assistant", "reasoning_content": "look it up"} and m[5]["content"] == "LA won."
    with pytest.raises(ValueError):
        conversation(spark).render_conversation("@x:system", "c")
    with pytest.raises(StepError):
        conversation(spark).render_conversation("@u:nothing", "c")


def test_dpo_grpo(spark):
    r = conversation(spark).add_column("a", lambda d: {"name": "get_who_won", "arguments": {"year": 2020}}).add_column("b", lambda d: {"name": "get_who_won", "arguments": {"year": 2021}})
    got = rows(r.render_dpo("@s:system|@u:question", "d", chosen="a", rejected="b").render_grpo("@s:system|@u:question", "g", solution="a", validator_id="tool_use"))[0]
    d, g = json.loads(got["d"]), json.loads(got["g"])
    assert d["chosen"] == '<tool_call>{"name":"get_who_won","arguments":{"year":2020}}</tool_call>' and "2021" in d["rejected"]
    assert g["solution"] == '{"arguments": {"year": 2020}, "name": "get_who_won"}' and g["validator_id"] == "tool_use"


def test_tools(spark):
    def get_who_won(year: int) -> dict:
        """Who won in a year"""
        return {"winner": "LA"}

    r = pipe(spark).with_tools_dataset("tools", [get_who_won]).iter_range(2).sample_tools("tools", 1, "tools").add_column("args", lambda d: '{"year": 2020}').render_tool_call("args", "call", tool="tools[0].name")
    r = r.add_column("q", lambda d: "Who?").render_conversation("@u:q|@a:tool_calls([call])", "c", tools="tools")
    got = json.loads(rows(r)[0]["c"])
    assert got["messages"][1]["tool_calls"][0]["function"]["arguments"] == {"year": 2020}
    assert got["tools"][0]["parameters"]["properties"] == {"year": {"type": "integer"}}


def test_language(spark):
    langs = ["english", "polish", "french", "german", "spanish"]
    r = pipe(spark).iter_range(1).add_column("q", lambda d: "Hello, who won the world series in 2020?").check_language("q", "english", 0.8, langs)
    assert len(rows(r)) == 1
    r = pipe(spark).iter_range(1).add_column("q", lambda d: "Kto wygrał światową serię w 2020 roku?").check_language("q", "polish", 0.9, langs)
    assert len(rows(r)) == 1
    r = pipe(spark).iter_range(1).add_column("q", lambda d: "Der Hund ist nicht in dem Haus").check_language("q", "english", 0.8, langs)
    assert rows(r) == []


def test_generation(spark):
    p = pipe(spark).with_llm("m", FakeModel()).with_template("ask", "Say {{index}}").with_template("schema", '{"properties": {"a": {"type": "string"}}, "required": ["a"]}')
    got = rows(p.iter_range(3).generate_text("ask", "m", "t").generate_json("ask", "m", "j", schema_template="schema"))
    assert len({x["t"] for x in got}) == 3 and all("a" in json.loads(x["j"]) for x in got)
    broken = FakeModel(lambda messages, schema: 1 / 0)
    assert rows(pipe(spark).with_llm("m", broken).with_template("ask", "x").iter_range(2).generate_text("ask", "m", "t")) == []


def test_judge(spark):
    r = conversation(spark).render_sft("@s:system|@u:question|@a:answer", "c")
    r.with_llm("m", FakeModel())
    got = rows(r.judge_conversation("c", "m", "j", judge_type=JudgeType.Conversation, attach_to_conversation=True))[0]
    assert 1 <= json.loads(got["j"])["accuracy"] <= 5 and "judge" in json.loads(got["c"])
    with pytest.raises(StepError):
        r.judge_conversation("c", "m", "j2", judge_type=JudgeType.Custom)


QUESTIONS = ["What is the best pen for drawing maps at sea?", "How heavy is a box of twelve red mugs?", "Which hat keeps the rain off a tall person?", "Where can one buy a rug made of wool?", "Does this jar close well enough for soup?"]


def test_gates_and_state(spark, tmp_path):
    texts = [*QUESTIONS, QUESTIONS[0], QUESTIONS[1].upper()]

    def go():
        r = pipe(spark, metadata=Metadata(str(tmp_path / "state"))).iter_range(len(texts)).add_column("q", lambda d: texts[d["index"]], returns="string").check_hash("q").check_simhash("q", 1)
        r.run()
        return [x["index"] for x in rows(r)]

    assert go() == [0, 1, 2, 3, 4]
    assert go() == []


def test_embedding_gate(spark):
    texts = ["a red pen", "a red pen", "a blue map of the sea", "A RED PEN"]
    r = pipe(spark).with_embeddings("e", HashEmbedder()).iter_range(4).add_column("q", lambda d: texts[d["index"]], returns="string").check_embedding("q", "e", 0.05, similarity_output="near")
    assert [x["index"] for x in rows(r)] == [0, 2]


def test_validators(spark):
    p = pipe(spark)
    r = p.iter_range(2).add_column("s", lambda d: {"properties": '{"a": {"type": "integer"}}', "required": ["a"]}).add_column("v", lambda d: {"a": 1} if d["index"] else {"a": "x"}).validate_json("s", "v")
    assert [x["index"] for x in rows(r)] == [1]
    r = p.iter_range(2).validate(lambda c: c["data"]["index"] == 0)
    assert [x["index"] for x in rows(r)] == [0]
    with pytest.raises(Exception):
        rows(p.iter_range(2).validate(lambda c: 1 / 0))


def test_chat_template(tmp_path, spark):
    def search(q: str) -> str:
        """Search"""

    messages = [{"role": "user", "content": "Hi"}, {"role": "assistant", "tool_calls": [{"function": {"name": "tip", "arguments": {"total_bill": 250, "number_of_people": 5}}}]}, {"role": "tool", "content": "{}"}, {"role": "assistant", "content": "50"}]
    t = ChatTemplateBuilder(template=CHATML).with_tools([search]).build()
    assert '<tool_call>{"name": "tip", "arguments": {"number_of_people":5,"total_bill":250}}</tool_call>' in t.render(messages)
    (tmp_path / "m.jsonl").write_text(json.dumps({"messages": messages}) + "\n")
    assert t.render_jsonl(str(tmp_path / "m.jsonl"), spark).first().text == t.render(messages)


def test_random_lambda_is_kept_through_gates(spark):
    r = pipe(spark).iter_range(20).add_column("x", lambda d: random.randint(0, 5)).check_hash("x")
    got = [x["x"] for x in rows(r)]
    assert len(got) == len(set(got))


def test_describe(spark):
    text = pipe(spark).iter_range(1).add_column("a", "1").filter("a == 1").describe()
    assert text.startswith("graph TD") and "ADD_COLUMN--0" in text


def test_from_yaml(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"x": 1}\n')
    (tmp_path / "c.json").write_text(json.dumps({"datasets": {"d": {"type": "jsonl", "path": str(tmp_path / "d.jsonl"), "sql": "select x + 1 as y from d"}}, "templates": {"t": "{{d.y}}"}, "seed": 7}))
    p = pipe(spark).from_yaml(str(tmp_path / "c.json"))
    assert rows(p.iter_dataset("d").render("t", "o"))[0]["o"] == "2" and p.seed == 7


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    from pyspark.sql import functions as F

    from millrace.functions.text import count_tokens_column

    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    assert [r.n for r in df.select(count_tokens_column(F.col("t"), public.path("byte_bpe_50k.json")).alias("n")).collect()] == [2, None, 0]
