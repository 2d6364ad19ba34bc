import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions import filters, jinja, json_schema, text
from millrace.operators import conversation, validate
from millrace.plans import dialect
from millrace.sources import scan, tools


@pytest.mark.parametrize(
    "template, data, want",
    [
        ("{{ 1 + 2 * 3 }}", {}, "7"), ("{{ 7 // 2 }} {{ 7 / 2 }} {{ 7 % 2 }}", {}, "3 3.5 1"), ("{{ a.b[0] }}", {"a": {"b": [5]}}, "5"),
        ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"),
        ("{% set y = x ~ '!' %}{{ y | upper }}", {"x": "hi"}, "HI!"), ("{{ 'a' if x > 1 else 'b' }}", {"x": 1}, "b"), ("{{ xs[1:] }}", {"xs": [1, 2, 3]}, "[2, 3]"),
        ("{{ d }}", {"d": {"b": 1, "a": [True, None]}}, '{"a": [true, null], "b": 1}'), ("{{ d | tojson }}", {"d": {"b": "<", "a": 1}}, '{"a":1,"b":"\\u003c"}'),
        ("{{ x | jstr }}", {"x": 'a"b\n'}, '"a\\"b\\n"'), ("a  {{- 1 -}}  b", {}, "a1b"), ("{# note #}x\n", {}, "x"), ("{{ none_here }}", {}, ""), ("{{ 2 in [1, 2] and 'b' not in 'abc' }}", {}, "false"),
        ("{{ x is defined }} {{ x | default('d') }}", {}, "false d"), ("{{ m.items() | length }}", {"m": {"a": 1}}, "1"), ("{% for k, v in m | items %}{{ k }}={{ v }}{% else %}none{% endfor %}", {"m": {}}, "none"),
    ],
)
def test_templates(template, data, want):
    assert jinja.render(template, data) == want


def test_template_errors():
    for bad in ("{% if %}", "{{ 1 + }}", "{% for x in y %}", "{% what %}", "{{ a b }}"):
        with pytest.raises(jinja.TemplateError):
            jinja.parse_template(bad)


def test_filters():
    assert [format(filters.murmur3_32(s.encode()), "x") for s in ("", "a", "abc", "hello world")] == ["0", "3c2569b2", "b3dd93fa", "5e928f0f"]
    assert filters.tool_call('{"a": 1}') == '"<tool_call>{\\"a\\": 1}</tool_call>"'
    assert sorted(json.loads(filters.shuffle("[1, 2, 3]"))) == [1, 2, 3] and filters.shuffle("x") == "x"
    assert 3 <= filters.random_range("3,5") < 5 and filters.random_range("x") == "x"
    assert filters.deserialize('{"b": 1, "a": 2}') == '{"a":2,"b":1}' and filters.deserialize("{") == "{"
    assert json.loads(filters.dict2items('{"a": 1}')) == [["a", 1]]
    assert filters.extract_json('x ```json\n{"a": {"b": 1}}\n```') == {"a": {"b": 1}} == filters.extract_json('so {"a": {"b": 1}} it is')
    assert filters.extract_json("nothing") is None and filters.json_path({"a": {"b": 1}}, "a.b") == 1 and filters.json_path({"a": 1}, "a.b") is None


@given(st.dictionaries(st.text(max_size=5), st.integers() | st.text(max_size=5), max_size=5))
def test_canonical_json_ignores_order(d):
    assert filters.dumps(d) == filters.dumps(dict(reversed(list(d.items()))))


@given(st.text(alphabet="ab. \n", max_size=300), st.integers(1, 10), st.integers(11, 60))
def test_chunks_are_the_text(t, least, most):
    got = text.chunk(t, least, most)
    assert "".join(got) == t and all(len(c) <= most for c in got) and all(len(c) >= least for c in got[:-1])


def test_text():
    assert text.normalize("  ＨELLO \n Wörld ") == "hello wörld"
    assert text.simhash("a b c") == text.simhash("c b a") and text.simhash(None) is None
    kept = []
    for t in ["Hello World", "hello   world", "Completely different", "HELLO world"]:
        h = text.simhash(text.normalize(t))
        if h not in kept:
            kept.append(h)
    assert len(kept) == 2


def test_schema():
    s = json_schema.closed({"properties": '{"a": {"type": "integer", "minimum": 1}, "b": {"type": ["string", "null"]}}', "required": ["a"]})
    assert [json_schema.is_valid(v, s) for v in ({"a": 1}, {"a": 0}, {"a": "1"}, {"a": 1, "b": None}, {"a": 1, "c": 2}, {})] == [True, False, False, True, False, False]
    assert json_schema.is_valid([1, 2], {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}) and not json_schema.is_valid("x", {"anyOf": [{"type": "number"}, {"pattern": "^y"}]})
    assert json_schema.is_valid({"x": {"y": 1}}, {"$defs": {"p": {"type": "object", "required": ["y"]}}, "properties": {"x": {"$ref": "#/$defs/p"}}})


GOOD = {"name": "find_it", "description": "d", "parameters": {"type": "object", "properties": {"a": {"type": "string", "enum": ["x"]}}, "required": ["a"]}}


@pytest.mark.parametrize(
    "change, ok",
    [({}, True), ({"name": "bad name!"}, False), ({"description": None}, False), ({"parameters": []}, False), ({"parameters": {**GOOD["parameters"], "required": ["b"]}}, False), ({"parameters": {**GOOD["parameters"], "required": None}}, True)]
    + [({"parameters": {"type": "object", "properties": {"a": {"type": t, "enum": e}}}}, ok) for t, e, ok in (("string", ["x"], True), ("string", [1], False), ("integer", [1], True), ("integer", [1.5], False), ("number", [1, 1.5], True), ("null", [None], True), ("odd", ["x"], False))],
)
def test_tool_rules(change, ok):
    assert validate.tools_valid({**GOOD, **change}) is ok
    assert validate.tools_valid(json.dumps([{**GOOD, **change}])) is ok


def test_normalize_tools():
    got = validate.normalize_tools([{"type": "function", "name": "n", "description": "d", "parameters": '{"type": "object", "properties": "{\\"a\\": {}, \\"required\\": [\\"a\\"]}"}'}, {"name": "m", "parameters": {}}])
    assert got == [{"name": "n", "description": "d", "parameters": {"type": "object", "properties": {"a": {}}, "required": ["a"]}}, {"name": "m", "parameters": {"required": []}}]


def test_conversation_rules():
    call = {"role": "assistant", "tool_calls": [{"function": {"name": "find_it", "arguments": {"a": "x"}}}]}
    good = {"messages": [{"role": "user", "content": "q"}, call, {"role": "tool", "content": '{"r": 1}'}, {"role": "assistant", "content": "a"}], "tools": [GOOD]}
    assert validate.conversation_valid(good) and validate.conversation_valid(json.dumps(good))
    for bad in ({"role": "user"}, {"role": "what", "content": "x"}, {"role": "tool", "content": "[1]"}, {"role": "assistant"}, {"role": "assistant", "tool_calls": [{"function": {"name": "other", "arguments": {}}}]}, {"role": "assistant", "tool_calls": [{"function": {"name": "find_it", "arguments": {"b": 1}}}]}):
        assert not validate.conversation_valid({**good, "messages": [bad]})
    legacy = {"conversation": [{"speaker": "human", "message": "q", "action": None, "details": None}, {"speaker": "assistant", "message": None, "action": "function-call", "details": {"name": "f", "arguments": {}}}, {"speaker": "system", "message": None, "action": "function-response", "details": {"f": 1}}]}
    assert validate.conversation_valid(legacy) and not validate.conversation_valid({"conversation": [{"speaker": "human"}]}) and not validate.conversation_valid({})
    assert [m["role"] for m in validate.legacy_to_messages(legacy)["messages"]] == ["user", "assistant", "tool"]


def test_conversation_language():
    assert conversation.parse("@system:s| @u:q\n|@a:tool_calls([a, b])|@a:think(t)") == [("system", "content", ["s"]), ("user", "content", ["q"]), ("assistant", "tool_calls", ["a", "b"]), ("assistant", "think", ["t"])]
    assert conversation.as_call("name") == {"function": {"name": "name"}} and conversation.choice({"content": "x"}) == '{"content":"x"}'


def test_tool_schemas():
    from pydantic import BaseModel, Field

    class Answer(BaseModel):
        id: int = Field(..., description="identifier")
        name: str | None = None

    def tool(x: int, y: float | None = None) -> Answer:
        """Gives an answer"""
        return Answer(id=x)

    s = tools.function_to_schema(tool, include_response=True)
    assert s["name"] == "tool" and s["parameters"]["required"] == ["x"] and json.loads(s["parameters"]["properties"])["y"]["type"] == ["number", "null"]
    assert s["response"]["name"] == "Answer" and json.loads(s["response"]["schema"])["properties"]["id"]["type"] == "integer"
    run = tools.Tools([tool])
    assert run('<tool_call>{"name": "tool", "arguments": {"x": 3}}</tool_call>')[0].id == 3 and len(run.messages) == 2
    rows = tools.python_functions_to_schemas('def f(a: int, b: str = "x"):\n    "doc"\n')
    assert rows[0]["parameters"]["required"] == ["a"] and rows[0]["description"] == "doc"


def test_openapi():
    item = {"type": "object", "title": "Item", "properties": {"name": {"type": "string", "title": "N"}}, "required": ["name"]}
    doc = {"paths": {"/items/{id}": {"get": {"operationId": "read", "summary": "Read", "parameters": [{"name": "id", "required": True, "schema": {"type": "integer"}}]}, "put": {"summary": "Put"}, "delete": {}}, "/items/": {"post": {"operationId": "make", "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Item"}}}}}}}, "components": {"schemas": {"Item": item}}}
    got = tools.openapi_functions(doc)
    assert [g["name"] for g in got] == ["read", "put_items_id", "delete_items_id", "make"] and got[3]["parameters"]["required"] == ["name"]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("WHO", "me")
    f = tmp_path / "t.yaml"
    f.write_text("templates:\n  input: hello ${WHO}\n  output: |\n    a\n    b\n")
    assert scan.simple_yaml(f.read_text())["templates"]["output"] == "a\nb\n"
    assert scan.read_config(str(f))["templates"]["input"] == "hello me"
    f.write_text("x: ${NOT_SET_ANYWHERE}")
    with pytest.raises(KeyError):
        scan.read_config(str(f))


def test_dialect():
    assert dialect.rewrite("select * exclude (a) from t where b ~ '^x ~ y'") == "select * EXCEPT (a) from t where b RLIKE '^x ~ y'"
    assert dialect.rewrite("select strftime(t, '%Y-%m') from x") == "select date_format(t, 'yyyy-MM') from x"
    assert "__w1" in dialect.rewrite("select a, b from t qualify row_number() over (partition by a order by b) = 1 order by a")


def test_dialect_runs(spark):
    spark.range(6).selectExpr("id", "id % 2 as k", "cast(id as double) as x", "timestamp'2024-03-05 01:02:03' as t").createOrReplaceTempView("t6")
    assert dialect.run_sql(spark, "select quantile_cont(x, 0.5) as q, cosd(0) as c from t6").first().q == 2.5
    assert dialect.run_sql(spark, "select strftime(t, '%Y/%m') as s from t6 limit 1").first().s == "2024/03"
    assert dialect.run_sql(spark, 'select "id" from t6 qualify row_number() over (partition by k order by id desc) = 1 order by id').collect()[0].id == 4
    assert dialect.run_sql(spark, "select unnest(string_to_array('a.b', '.')) as v").count() == 2
