"""Chat templates over messages."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jinja
from ..sources.tools import function_to_schema

#: ChatML with tools.
CHATML = """{{- bos_token }}
{%- if tools %}
{{- "<|im_start|>system\\n" }}
{%- if messages and messages[0].role == "system" %}
{{- messages[0].content ~ "\\n\\n" }}
{%- endif %}
{{- "You may call these functions. Answer with a JSON object between <tool_call> tags.\\n<tools>\\n" }}
{%- for tool in tools %}
{{- tool | tojson }}{{ "\\n" }}
{%- endfor %}
{{- "</tools><|im_end|>\\n" }}
{%- endif %}
{%- for message in messages %}
{%- if message.role == "system" and (tools and loop.first) %}
{%- elif message.role in ["system", "user"] %}
{{- "<|im_start|>" ~ message.role ~ "\\n" ~ message.content ~ "<|im_end|>\\n" }}
{%- elif message.role == "assistant" %}
{{- "<|im_start|>assistant\\n" }}
{%- if message.reasoning_content is defined and message.reasoning_content %}{{ "<think>" ~ message.reasoning_content ~ "</think>\\n" }}{% endif %}
{%- if message.content is defined and message.content %}{{ message.content }}{% endif %}
{%- if message.tool_calls is defined and message.tool_calls %}
{%- for call in message.tool_calls %}
{{- '<tool_call>{"name": "' ~ call.function.name ~ '", "arguments": ' }}{{ call.function.arguments | tojson }}{{ "}</tool_call>" }}{% if not loop.last %}{{ "\\n" }}{% endif %}
{%- endfor %}
{%- endif %}
{{- "<|im_end|>\\n" }}
{%- elif message.role == "tool" %}
{%- if loop.first or loop.previtem.role != "tool" %}{{ "<|im_start|>user\\n" }}{% endif %}
{{- "<tool_response>" ~ message.content ~ "</tool_response>\\n" }}
{%- if loop.last or loop.nextitem.role != "tool" %}{{ "<|im_end|>\\n" }}{% endif %}
{%- else %}
{{- raise_exception("unknown role " ~ message.role) }}
{%- endif %}
{%- endfor %}
"""


class ChatTemplate:
    def __init__(self, template: str, tools: list[dict] | None, bos_token: str, tokenizer: Any = None):
        jinja.parse_template(template)
        self.template, self.tools, self.bos_token, self.tokenizer = template, tools, bos_token, tokenizer

    def render(self, messages: Sequence[dict], tokenize: bool = False) -> Any:
        text = jinja.render(self.template, {"messages": list(messages), "tools": self.tools, "bos_token": self.bos_token})
        return self.tokenizer.encode(text) if tokenize and self.tokenizer is not None else text

    def render_column(self, messages):
        """Text of a column of messages (JSON text: an array, or an object with `messages`)."""
        template, tools, bos = self.template, self.tools, self.bos_token

        @F.arrow_udf("string")
        def run(column: pa.Array) -> pa.Array:
            out = []
            for t in column.to_pylist():
                value = json.loads(t) if t else None
                value = value.get("messages", value) if isinstance(value, dict) else value
                out.append(None if value is None else jinja.render(template, {"messages": value, "tools": tools, "bos_token": bos}))
            return pa.array(out, type=pa.string())

        return run(messages)

    def render_jsonl(self, path: str, spark: SparkSession | None = None) -> DataFrame:
        """DataFrame (text) of a file with one conversation a line."""
        from ..session import get_spark

        spark = spark or get_spark()
        return spark.read.text(path).where("trim(value) <> ''").select(self.render_column(F.col("value")).alias("text"))


class ChatTemplateBuilder:
    def __init__(self, path: str | None = None, template: str | None = None):
        if (path is None) == (template is None):
            raise ValueError("a path or a template is needed")
        if path is not None:
            with open(path) as f:
                template = f.read()
        self.template, self.tools, self.bos, self.tokenizer = template, None, "<s>", None

    def with_tools(self, functions: Sequence[Callable]) -> ChatTemplateBuilder:
        rows = [function_to_schema(f) for f in functions]
        self.tools = [{**r, "parameters": {**r["parameters"], "properties": json.loads(r["parameters"]["properties"])}} for r in rows]
        return self

    def with_tools_json(self, text: str) -> ChatTemplateBuilder:
        self.tools = json.loads(text)
        return self

    def with_bos_token(self, token: str) -> ChatTemplateBuilder:
        self.bos = token
        return self

    def with_tokenizer(self, tokenizer: Any) -> ChatTemplateBuilder:
        self.tokenizer = tokenizer
        return self

    def build(self) -> ChatTemplate:
        return ChatTemplate(self.template, self.tools, self.bos, self.tokenizer)
