"""The fluent pipeline: named resources, a source, and steps that lower to one DataFrame.

A row's context is a set of columns. What expressions and templates compute becomes Spark columns where it can;
what Python computes (lambdas, custom steps, the template interpreter) runs in Arrow UDFs and gives JSON text, of
which the plan keeps track ("dynamic" columns). After `map` or `step`, which may add or delete any key, the whole
context is one JSON column, unless the step declares what it returns.

A row that fails a step is filtered out, as with `filter`; `rejected()` shows which step dropped how many rows.
Gates (`check_hash`, `check_simhash`, `check_embedding`) look at all rows before them, and with metadata enabled
also at those that earlier runs kept.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterable, Sequence
from enum import Enum
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jinja
from ..functions.compile import Compiler, NotNative
from ..functions.filters import dumps
from ..functions.json_schema import closed, is_valid
from ..functions.text import chunk as chunk_text
from ..functions.text import hash_exact, language_scores, simhash_nfkc_column
from ..operators import conversation as conv
from ..operators import dedup, generate, validate
from ..session import get_spark
from ..sources import scan
from . import storage
from .state import State


class InternalDatasetType(Enum):
    Openings = "openings"


class JudgeType(Enum):
    Conversation = "conversation"
    ConversationLite = "conversation_lite"
    ToolsCalling = "tools_calling"
    ToolsCallingLite = "tools_calling_lite"
    Custom = "custom"


class Metadata:
    """Where gate state is kept across runs; off unless asked for."""

    def __init__(self, path: str = "", enabled: bool = True):
        self.path, self.enabled = path, enabled


class IterBy:
    class Range:
        def __init__(self, start: int, stop: int, step: int = 1):
            self.start, self.stop, self.step = start, stop, step

    class Dataset:
        def __init__(self, name: str):
            self.name = name


class StepError(RuntimeError):
    """A run error: a validator or condition that raised, or a step that can't be planned."""


class Pipeline:
    """Resources of a pipeline; `iter_range` and `iter_dataset` give the runner that takes steps."""

    def __init__(self, name: str = "pipeline", metadata: Metadata | None = None, spark: SparkSession | None = None):
        self.name, self.metadata = name, metadata or Metadata(enabled=False)
        self.spark = spark or get_spark(name)
        self.datasets: dict[str, DataFrame] = {}
        self.templates: dict[str, str] = {}
        self.llms: dict[str, Any] = {}
        self.embedders: dict[str, Any] = {}
        self.workers, self.seed = 0, 42

    # sources

    def with_dataset(self, name: str, df: DataFrame, sql: str | None = None) -> Pipeline:
        """Any DataFrame as a dataset."""
        self.datasets[name] = scan.with_sql(self.spark, name, df, sql)
        return self

    def with_parquet_dataset(self, name: str, path: str, sql: str | None = None) -> Pipeline:
        return self.with_dataset(name, scan.parquet(self.spark, path), sql)

    def with_csv_dataset(self, name: str, path: str, delimiter: str = ",", has_header: bool = True, sql: str | None = None) -> Pipeline:
        return self.with_dataset(name, scan.csv(self.spark, path, delimiter, has_header), sql)

    def with_jsonl_dataset(self, name: str, path: str, sql: str | None = None) -> Pipeline:
        return self.with_dataset(name, scan.jsonl(self.spark, path), sql)

    def with_json_dataset(self, name: str, path: str, sql: str | None = None) -> Pipeline:
        return self.with_dataset(name, scan.json_array(self.spark, path), sql)

    def with_dicts_dataset(self, name: str, dicts: Sequence[dict], sql: str | None = None) -> Pipeline:
        return self.with_dataset(name, scan.dicts(self.spark, dicts), sql)

    def with_polars_dataset(self, name: str, path: str, sql: str | None = None) -> Pipeline:
        return self.with_dataset(name, scan.auto(self.spark, path), sql)

    with_auto_dataset = with_polars_dataset

    def with_arrow_dataset(self, name: str, dataset: Any, sql: str | None = None) -> Pipeline:
        return self.with_dataset(name, scan.arrow(self.spark, dataset), sql)

    def with_hf_dataset(self, name: str, dataset_path: str, dataset_name: str | None = None, dataset_split: str = "train", sql: str | None = None) -> Pipeline:
        return self.with_dataset(name, scan.hugging_face(self.spark, dataset_path, dataset_name, dataset_split), sql)

    def with_db_dataset(self, name: str, conn: str, query: str) -> Pipeline:
        return self.with_dataset(name, scan.database(self.spark, conn, query))

    def with_tools_dataset(self, name: str, tools: Sequence[Callable]) -> Pipeline:
        return self.with_dataset(name, scan.python_tools(self.spark, tools))

    def with_pydantic_models_dataset(self, name: str, models: Sequence[type]) -> Pipeline:
        return self.with_dataset(name, scan.pydantic_models(self.spark, models))

    def with_openapi_dataset(self, name: str, path_or_url: str) -> Pipeline:
        return self.with_dataset(name, scan.openapi(self.spark, path_or_url))

    def with_internal_dataset(self, kind: InternalDatasetType) -> Pipeline:
        for name in scan.phrases.PHRASES:
            if name.startswith(kind.value):
                self.datasets[name] = scan.internal(self.spark, name)
        return self

    def with_mixed_dataset(self, name: str, datasets: Sequence[str]) -> Pipeline:
        return self.with_dataset(name, scan.mixed({d: self.datasets[d] for d in datasets}))

    def from_yaml(self, path: str) -> Pipeline:
        """Resources from a JSON or YAML file: `datasets` and `llms` (name: {type, …arguments}), `templates` (name: text), `workers`, `seed`."""
        config = scan.read_config(path)
        for section, prefix, suffix in (("datasets", "with_", "_dataset"), ("llms", "with_llm_", "")):
            for name, options in (config.get(section) or {}).items():
                options = dict(options)
                getattr(self, f"{prefix}{options.pop('type')}{suffix}")(name, **options)
        for name, template in (config.get("templates") or {}).items():
            self.with_template(name, template)
        self.workers, self.seed = int(config.get("workers", self.workers)), int(config.get("seed", self.seed))
        return self

    # templates

    def with_template(self, name: str, template: str) -> Pipeline:
        jinja.parse_template(template)
        self.templates[name] = template
        return self

    def with_j2_template(self, name: str, path: str, op_config: str | None = None) -> Pipeline:
        return self.with_template(name, storage.read_text(self.spark, path))

    def with_templates(self, path: str, op_config: str | None = None) -> Pipeline:
        for file in storage.names(self.spark, path):
            if file.endswith((".j2", ".jinja")):
                self.with_j2_template(file, f"{path.rstrip('/')}/{file}")
        return self

    def with_j2_templates(self, path: str, op_config: str | None = None) -> Pipeline:
        for name, template in scan.read_config(path)["templates"].items():
            self.with_template(name, template)
        return self

    # models

    def with_llm(self, name: str, llm: Any) -> Pipeline:
        """Any object with process(messages, schema, max_tokens, temperature)."""
        self.llms[name] = llm
        return self

    def with_llm_api(self, name: str, base_url: str, api_key: str, model: str, max_tokens: int = 1024, temperature: float = 0.1) -> Pipeline:
        return self.with_llm(name, generate.api_model(base_url, api_key, model, max_tokens=max_tokens, temperature=temperature))

    def with_llm_openai(self, name: str, api_key: str, model: str, max_tokens: int = 1024, temperature: float = 0.1) -> Pipeline:
        return self.with_llm(name, generate.openai_model(api_key, model, max_tokens=max_tokens, temperature=temperature))

    def with_llm_azure_openai(self, name: str, api_key: str, endpoint: str, deployment_name: str, api_version: str, max_tokens: int = 1024, temperature: float = 0.1) -> Pipeline:
        return self.with_llm(name, generate.azure_model(api_key, endpoint, deployment_name, api_version, max_tokens=max_tokens, temperature=temperature))

    def with_llm_unsloth(self, name: str, make: Callable[[], Any]) -> Pipeline:
        return self.with_llm(name, generate.LocalModel(make))

    with_llm_mistralrs = with_llm_unsloth

    def with_embeddings(self, name: str, embedder: Any) -> Pipeline:
        """Any object with embed(texts) -> vectors."""
        self.embedders[name] = embedder
        return self

    def with_embeddings_e5(self, name: str, model_repo: str) -> Pipeline:
        return self.with_embeddings(name, generate.E5Embedder(model_repo))

    def with_embeddings_api(self, name: str, base_url: str, api_key: str, model: str) -> Pipeline:
        return self.with_embeddings(name, generate.HTTPEmbedder(base_url, api_key, model))

    with_embedings, with_embedings_e5, with_embedings_api = with_embeddings, with_embeddings_e5, with_embeddings_api

    def with_workers(self, n: int) -> Pipeline:
        """Least partitions of steps that call models; other steps follow Spark's own partitioning."""
        self.workers = n
        return self

    def with_seed(self, seed: int) -> Pipeline:
        self.seed = seed
        return self

    # iteration

    def iter(self, by: Any) -> PipelineRunner:
        if isinstance(by, IterBy.Range):
            return self.iter_range(by.start, by.stop, by.step)
        if isinstance(by, IterBy.Dataset):
            return self.iter_dataset(by.name)
        raise ValueError("IterBy.Range or IterBy.Dataset is expected")

    def iter_range(self, *args: int, start: int = 0, stop: int | None = None, step: int = 1) -> PipelineRunner:
        if args:
            start, stop, step = (0, args[0], 1) if len(args) == 1 else (*args, 1)[:3]
        if stop is None or step == 0:
            raise ValueError("a stop and a step that isn't 0 are needed")
        return PipelineRunner(self, self.spark.range(start, stop, step).withColumnRenamed("id", "index"))

    def iter_dataset(self, name: str) -> PipelineRunner:
        rows = self.datasets[name]
        if "__ordinal" in rows.columns:
            return PipelineRunner(self, rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "__ordinal"]).alias(name), F.col("__ordinal").alias("index")))
        return PipelineRunner(self, scan.with_index(rows.select(F.struct("*").alias(name))))


class _Steps:
    """Steps on a context; the base of the runner and of branch chains."""

    def __init__(self, pipeline: Pipeline, df: DataFrame, dynamic: set[str] | None = None, opaque: bool = False):
        self.pipeline, self.df, self.dynamic, self.opaque = pipeline, df, set(dynamic or ()), opaque
        self.sinks: list[tuple[str, Callable[[], Any]]] = []
        self.dropped: list[tuple[str, DataFrame, DataFrame]] = []
        self.pending: list[tuple[str, DataFrame]] = []
        self.graph: list[tuple[str, str]] = []

    # plumbing

    @property
    def keys(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def _note(self, kind: str, detail: str = "") -> str:
        name = f"{kind}--{len(self.graph)}"
        self.graph.append((name, detail))
        return name

    def _filter(self, step: str, condition: Column) -> None:
        before = self.df
        self.df = before.where(F.coalesce(condition, F.lit(False)))
        self.dropped.append((step, before, self.df))

    def _set(self, name: str, value: Column, dynamic: bool = False) -> None:
        self.df = self.df.withColumn(name, value)
        (self.dynamic.add if dynamic else self.dynamic.discard)(name)

    def _context(self, only: Iterable[str] | None = None) -> list[Column]:
        """Arguments of a UDF: native columns as one JSON text, dynamic ones each, then the opaque context."""
        names = [k for k in self.keys if only is None or k in only]
        native = [k for k in names if k not in self.dynamic]
        first = F.to_json(F.struct(*[F.col(f"`{k}`") for k in native]), {"ignoreNullFields": "false"}) if native else F.lit("{}")
        return [first, *[F.col(f"`{k}`") for k in names if k in self.dynamic], *([F.col("__ctx")] if self.opaque else [])]

    def _python(self, f: Callable[[dict], Any], only: Iterable[str] | None = None, returns: str = "string", strict: bool = False) -> Column:
        """f(context) per row in an Arrow UDF; an exception gives null, with strict it fails the job."""
        dynamic = [k for k in self.keys if (only is None or k in only) and k in self.dynamic]
        opaque = self.opaque
        kind = T._parse_datatype_string(returns) if returns != "string" else T.StringType()
        from pyspark.sql.pandas.types import to_arrow_type

        arrow_type = to_arrow_type(kind)

        def run(*columns: pa.Array) -> pa.Array:
            out = []
            for row in zip(*[c.to_pylist() for c in columns]):
                data = json.loads(row[-1]) if opaque and row[-1] else {}
                data.update(json.loads(row[0]))
                for k, v in zip(dynamic, row[1:]):
                    data[k] = None if v is None else json.loads(v)
                try:
                    out.append(f(data))
                except Exception:
                    if strict:
                        raise
                    out.append(None)
            return pa.array(out, type=arrow_type)

        return F.arrow_udf(run, returnType=kind).asNondeterministic()(*self._context(only))

    def _compiler(self) -> Compiler:
        return Compiler(self.df, self.dynamic)

    def _needs(self, node: Any) -> set[str] | None:
        return None if self.opaque else jinja.names(node)

    def _native(self, expression: str) -> Column | None:
        try:
            return self._compiler().expression(expression)
        except NotNative:
            return None

    def _value(self, expression: str) -> tuple[Column, bool]:
        """(column, whether it is JSON text) of an expression."""
        text = expression.strip()
        if text.startswith("{{") and text.endswith("}}"):
            text = text[2:-2]
        c = self._native(text)
        if c is not None:
            return c, False
        node = jinja.parse_expression(text)
        name = node[1] if node[0] == "name" else None
        if name in self.dynamic:
            return F.col(f"`{name}`"), True

        def run(data: dict) -> str | None:
            v = jinja.evaluate(node, data)
            return None if v is jinja.UNDEFINED else dumps(v)

        return self._python(run, self._needs(node)), True

    def _json(self, name_or_expression: str) -> Column:
        """A value as JSON text."""
        c, dynamic = self._value(name_or_expression)
        if dynamic:
            return c
        kind = self._compiler().type_of(c)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(c, {"ignoreNullFields": "false"})
        return F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', 1)

    def _text(self, template: str) -> Column:
        """A rendered template; a failure gives null."""
        try:
            return self._compiler().template(template)
        except NotNative:
            pass
        statements = jinja.parse_template(template)
        return self._python(lambda data: jinja.render(template, data), self._needs(statements))

    def _string(self, name: str) -> Column:
        """A text input of a gate: the string itself, null for other values."""
        c, dynamic = self._value(name)
        if not dynamic:
            return c.cast("string") if not isinstance(self._compiler().type_of(c), (T.StructType, T.ArrayType, T.MapType)) else F.to_json(c)
        return F.when(F.startswith(c, F.lit('"')), F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x"))

    # projections

    def add_column(self, output: str, func: Callable | str, is_json: bool = True, returns: str | None = None) -> _Steps:
        """A column from fn(data), with `returns` as DDL if its type is known, or from an expression; an expression's column must be new."""
        step = self._note("ADD_COLUMN", output)
        if not callable(func) and output in self.keys:
            raise StepError(f"column {output!r} is there already")
        return self._put(step, output, func, is_json, returns)

    def _put(self, step: str, output: str, func: Callable | str, is_json: bool, returns: str | None) -> _Steps:
        if not callable(func):
            c, dynamic = self._value(func)
            self._set(output, c, dynamic)
            return self
        if returns:
            self._set(output, self._python(func, returns=returns))
        else:
            self._set(output, self._python(lambda data: json.dumps(func(data), ensure_ascii=False, default=str)), dynamic=True)
        self._filter(step, F.col(f"`{output}`").isNotNull())
        return self

    def add_columns(self, columns: dict[str, Callable | str], is_json: bool = True) -> _Steps:
        for name, func in columns.items():
            self.add_column(name, func, is_json)
        return self

    def add_random(self, output: str, start: int, stop: int) -> _Steps:
        self._note("ADD_RANDOM", output)
        seed = self.pipeline.seed * 1000 + len(self.graph)
        self._set(output, (F.floor(F.rand(seed) * (stop - start)) + start).cast("long"))
        return self

    def mutate(self, output: str, func: Callable | str, is_json: bool = True, returns: str | None = None) -> _Steps:
        """A column changed by fn(value), or made or replaced by an expression."""
        step = self._note("MUTATE", output)
        if callable(func):
            if output not in self.keys and not self.opaque:
                raise StepError(f"no column {output!r}")
            return self._put(step, output, lambda data: func(data[output]), is_json, returns)
        return self._put(step, output, func, is_json, returns)

    def map(self, func: Callable[[dict], dict], returns: str | None = None) -> _Steps:
        """fn(context) -> context, where context has id, status and data; with `returns` (DDL of data) columns stay native."""
        step = self._note("MAP")

        def run(data: dict) -> str | None:
            got = func({"id": str(data.get("index")), "status": "running", "data": data})
            if str(got.get("status", "running")).lower() in ("failed", "stepstatus.failed"):
                return None
            return json.dumps(got["data"], ensure_ascii=False, default=str)

        new = self.df.select(self._python(run).alias("__ctx"), *([F.col("index")] if "index" in self.df.columns else []))
        self.df, self.dynamic, self.opaque = new, set(), True
        self._filter(step, F.col("__ctx").isNotNull())
        if returns:
            parsed = self.df.withColumn("__p", F.from_json("__ctx", returns))
            names = [f.name for f in T._parse_datatype_string(returns).fields]
            self.df, self.opaque = parsed.select(*[F.col(f"__p.`{n}`").alias(n) for n in names], *([F.col("index")] if "index" in parsed.columns and "index" not in names else [])), False
        return self

    def step(self, step: Any, returns: str | None = None) -> _Steps:
        """An object with process(context)."""
        return self.map(step.process, returns)

    def into_list(self, inputs: Sequence[str], output: str) -> _Steps:
        self._note("INTO_LIST", output)
        values = [self._value(i) for i in inputs]
        kinds = {self._compiler().type_of(c).simpleString() for c, d in values if not d}
        if not any(d for _, d in values) and len(kinds) == 1:
            self._set(output, F.array(*[c for c, _ in values]))
        else:
            parts = [x for i in inputs for x in (F.lit(","), F.coalesce(self._json(i), F.lit("null")))][1:]
            self._set(output, F.concat(F.lit("["), *parts, F.lit("]")), dynamic=True)
        return self

    def render(self, template: str, output: str) -> _Steps:
        step = self._note("RENDER", template)
        self._set(output, self._text(self.pipeline.templates[template]))
        self._filter(step, F.col(f"`{output}`").isNotNull())
        return self

    def chunk(self, capacity: tuple[int, int], input: str, output: str) -> _Steps:
        """Pieces of a text, of capacity[0] to capacity[1] characters, as an array."""
        step = self._note("CHUNK", input)
        least, most = capacity

        @F.arrow_udf("array<string>")
        def run(text: pa.Array) -> pa.Array:
            return pa.array([chunk_text(t, least, most) for t in text.to_pylist()], type=pa.list_(pa.string()))

        self._set(output, run(self._string(input)))
        self._filter(step, F.col(f"`{output}`").isNotNull())
        return self

    # filters and branches

    def filter(self, condition: Callable | str) -> _Steps:
        """Rows for which fn(data) is truthy, or the expression isn't false: what can't be read as a truth value passes."""
        step = self._note("FILTER")
        if callable(condition):
            self._filter(step, self._python(lambda data: bool(condition(data)), returns="boolean"))
            return self
        c = self._native(condition)
        if c is not None:
            native = isinstance(self._compiler().type_of(c), T.BooleanType)
            self._filter(step, c if native else F.coalesce(c.cast("string").try_cast("boolean"), F.lit(True)))
            return self
        node = jinja.parse_expression(condition)
        self._filter(step, self._python(lambda data: jinja.text_of(jinja.evaluate(node, data)).strip().lower() != "false", self._needs(node), "boolean"))
        return self

    def ifelse(self, condition: Callable | str, then_chain: Chain, else_chain: Chain | None = None) -> _Steps:
        """Rows where the condition is true take one chain, the others the other or none."""
        self._note("IFELSE")
        if callable(condition):
            p = self._python(lambda data: bool(condition(data)), returns="boolean", strict=True)
        else:
            p = self._native(condition)
            if p is None or not isinstance(self._compiler().type_of(p), T.BooleanType):
                node = jinja.parse_expression(condition)

                def truth(data: dict) -> bool:
                    text = jinja.text_of(jinja.evaluate(node, data)).strip().lower()
                    if text not in ("true", "false"):
                        raise StepError(f"{condition!r} is neither true nor false")
                    return text == "true"

                p = self._python(truth, self._needs(node), "boolean", strict=True)
        flagged = self.df.withColumn("__if", F.coalesce(p, F.lit(False)))
        sides = []
        for wanted, chain in ((True, then_chain), (False, else_chain)):
            side = _Steps(self.pipeline, flagged.where(F.col("__if") == F.lit(wanted)).drop("__if"), self.dynamic, self.opaque)
            side.graph = self.graph
            for name, args, kwargs in chain.calls if chain else ():
                getattr(side, name)(*args, **kwargs)
            sides.append(side)
        a, b = sides
        if a.opaque != b.opaque:
            for s in sides:
                if not s.opaque:
                    s.df = s.df.select(s._python(lambda data: json.dumps(data, ensure_ascii=False)).alias("__ctx"), "index")
                    s.dynamic, s.opaque = set(), True
        for k in set(a.keys) & set(b.keys):
            same = a.df.schema[k].dataType == b.df.schema[k].dataType
            if (k in a.dynamic) != (k in b.dynamic) or not same:
                for s in sides:
                    if k not in s.dynamic:
                        s._set(k, s._json(k), dynamic=True)
        self.df = a.df.unionByName(b.df, allowMissingColumns=True)
        self.dynamic, self.opaque = a.dynamic | b.dynamic, a.opaque
        for s in sides:
            self.sinks += s.sinks
            self.dropped += s.dropped
            self.pending += s.pending
        return self

    # sampling

    def sample(self, dataset: str, size: int, output: str) -> _Steps:
        """`size` rows of a dataset, without replacement, by a seeded order of each row's own; too few rows are an error.

        Row k's sample is drawn by ranks: `size` distinct ordinals per row from a keyed permutation, then an equi-join on the ordinal,
        so that neither side is multiplied with the other.
        """
        self._note("SAMPLE", dataset)
        source = scan.with_index(self.pipeline.datasets[dataset].select(F.struct("*").alias("__row")), "__rid")
        n = source.count()
        if size > n:
            raise StepError(f"{dataset!r} has {n} rows, not {size}")
        seed = self.pipeline.seed * 1000 + len(self.graph)

        @F.arrow_udf("array<long>")
        def draw(index: pa.Array) -> pa.Array:
            import random

            return pa.array([random.Random(f"{seed}:{i}").sample(range(n), size) for i in index.to_pylist()], type=pa.list_(pa.int64()))

        self.df = storage.stash(self.df, "sample")
        picked = self.df.select("index", F.posexplode(draw(F.col("index"))).alias("__pos", "__rid")).join(source, "__rid")
        lists = picked.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__row"))), lambda x: x["__row"]).alias(output))
        self.df = self.df.drop(output).join(lists, "index") if size else self.df.withColumn(output, F.array())
        self.dynamic.discard(output)
        return self

    def read(self, dataset: str, output: str) -> _Steps:
        """All rows of a dataset, in order, as an array on every row. The array is part of each row: it is for small datasets by its meaning."""
        self._note("READ", dataset)
        source = scan.with_index(self.pipeline.datasets[dataset].select(F.struct("*").alias("__row")), "__rid")
        rows = source.agg(F.transform(F.array_sort(F.collect_list(F.struct("__rid", "__row"))), lambda x: x["__row"]).alias(output))
        self.df = self.df.drop(output).crossJoin(rows)  # one row
        self.dynamic.discard(output)
        return self

    def sample_tools(self, dataset: str, size: int, output: str) -> _Steps:
        return self.sample(dataset, size, output).normalize_tools(output, output).validate_tools(output)

    # validation and gates

    def validate_json(self, schema: str, instance: str) -> _Steps:
        """Rows whose instance fits the closed object schema; both are expressions."""
        step = self._note("VALIDATE_JSON")
        s, i = jinja.parse_expression(schema), jinja.parse_expression(instance)
        only = None if self.opaque else jinja.names(s) | jinja.names(i)
        self._filter(step, self._python(lambda data: validate.json_valid(jinja.evaluate(i, data), jinja.evaluate(s, data)), only, "boolean", strict=True))
        return self

    def validate_tools(self, instances: str) -> _Steps:
        step = self._note("VALIDATE_TOOLS", instances)
        node = jinja.parse_expression(instances)
        self._filter(step, self._python(lambda data: validate.tools_valid(jinja.evaluate(node, data)), self._needs(node), "boolean"))
        return self

    def validate_conversation(self, instances: str) -> _Steps:
        step = self._note("VALIDATE_CONVERSATION", instances)
        node = jinja.parse_expression(instances)
        self._filter(step, self._python(lambda data: validate.conversation_valid(jinja.evaluate(node, data)), self._needs(node), "boolean"))
        return self

    def normalize_tools(self, instances: str, output: str) -> _Steps:
        step = self._note("NORMALIZE_TOOLS", instances)
        node = jinja.parse_expression(instances)
        self._set(output, self._python(lambda data: dumps(validate.normalize_tools(jinja.evaluate(node, data))), self._needs(node)), dynamic=True)
        self._filter(step, F.col(f"`{output}`").isNotNull())
        return self

    def validate(self, func: Callable[[dict], bool]) -> _Steps:
        """Rows for which fn(context) is true; an exception or another value fails the run."""
        step = self._note("VALIDATE")

        def run(data: dict) -> bool:
            got = func({"id": str(data.get("index")), "status": "running", "data": data})
            if not isinstance(got, bool):
                raise StepError("a validator must return a truth value")
            return got

        self._filter(step, self._python(run, returns="boolean", strict=True))
        return self

    def check_language(self, input: str, language: str, precision: float, detect_languages: Sequence[str]) -> _Steps:
        """Rows whose text is in the language with at least that confidence among the candidates; unknown candidates are left out."""
        step = self._note("CHECK_LANGUAGE", language)
        names, wanted = list(detect_languages), language.lower()
        if wanted not in language_scores("", [*names, wanted]):
            raise StepError(f"unknown language {language!r}")

        @F.arrow_udf("double")
        def run(text: pa.Array) -> pa.Array:
            return pa.array([None if t is None else language_scores(t, [*names, wanted])[wanted] for t in text.to_pylist()], type=pa.float64())

        self._filter(step, run(self._string(input)) >= precision)
        return self

    def _state(self) -> State | None:
        m = self.pipeline.metadata
        return State(self.pipeline.spark, m.path or f".millrace/{self.pipeline.name}") if m.enabled else None

    def _gate(self, step: str, kept: DataFrame, table: str, value: str, key: str) -> None:
        before, kept = self.df, storage.stash(kept, table)
        if self._state():
            self.pending.append((table, kept.select(F.lit(key).alias("key"), F.col(value).alias("value"), F.col("index").alias("item"))))
        self.df = kept.drop(value)
        self.dropped.append((step, before, self.df))

    def check_hash(self, input: str, order: str | None = None) -> _Steps:
        """The first row of each value that no earlier run kept; objects are compared by canonical JSON. First by `order`, nulls last, then by source order."""
        step = self._note("CHECK_HASH", input)
        c, dynamic = self._value(input)
        kind = None if dynamic else self._compiler().type_of(c)
        text = self._string(input) if kind is not None and isinstance(kind, T.StringType) else F.coalesce(F.to_json(F.try_parse_json(self._json(input))), self._json(input))
        state = self._state()
        known = state.read("hashes", input) if state else None
        by = ["index"] if order is None else [self._value(order)[0].asc_nulls_last(), "index"]
        kept = dedup.keep_first(self.df, hash_exact(text), by, None if known is None else known.select(F.col("value").alias("key")))
        self._gate(step, kept.withColumnRenamed("__key", "__value"), "hashes", "__value", input)
        return self

    def check_simhash(self, input: str, threshold: int = 3, treshold: int | None = None, greedy: bool = True) -> _Steps:
        """Rows whose SimHash is farther than the threshold from that of every kept earlier row (greedy) or of every earlier row."""
        step = self._note("CHECK_SIMHASH", input)
        threshold = threshold if treshold is None else treshold
        rows = storage.stash(self.df.withColumn("__value", simhash_nfkc_column(self._string(input))), "simhash").where("__value is not null")  # filtered once written, else Spark hashes twice
        prints = dedup.keep_first(rows.select(F.col("index").alias("id"), F.col("__value").alias("print")), F.col("print"), "id").drop("__key")
        state = self._state()
        known = state.read("simhashes", input) if state else None
        if known is not None:
            near = dedup.simhash_pairs(prints, threshold, known.select(F.col("item").alias("id"), F.col("value").alias("print")))
            prints = prints.join(near.select(F.col("i").alias("id")).distinct(), "id", "left_anti")
        prints = storage.stash(prints, "prints")
        pick = dedup.independent if greedy else dedup.any_earlier
        ids = pick(prints.select("id"), dedup.simhash_pairs(prints, threshold, spare=dedup.spare_blocks(prints.count())))
        self._gate(step, rows.join(ids.withColumnRenamed("id", "index"), "index", "left_semi"), "simhashes", "__value", input)
        return self

    def check_embedding(self, input: str, embedding: str | None = None, threshold: float = 0.05, treshold: float | None = None, similarity_output: str | None = None) -> _Steps:
        """Rows whose embedding is at least the threshold (1 - cosine) from that of every kept earlier row.

        Without a model the input is a column of vectors. similarity_output: the distance to the nearest earlier
        row within the threshold among all; 0.0 where there is none.
        """
        step = self._note("CHECK_EMBEDDING", input)
        threshold = threshold if treshold is None else treshold
        if embedding is None:
            c, dynamic = self._value(input)
            vector = dedup.unit(F.from_json(c, "array<double>") if dynamic else c)
        else:
            model = self.pipeline.embedders[embedding]

            def run(text: pa.Array) -> pa.Array:
                texts = text.to_pylist()
                found = [None if t is None else v for t, v in zip(texts, model.embed([t or "" for t in texts]))]
                lengths = [None if v is None else math.sqrt(sum(x * x for x in v)) for v in found]
                return pa.array([None if not n else [x / n for x in v] for v, n in zip(found, lengths)], type=pa.list_(pa.float64()))

            vector = F.arrow_udf(run, returnType="array<double>")(self._string(input))
        rows = storage.stash(self.df.withColumn("__value", vector), "embedding").where("__value is not null")
        first = rows.select(F.size("__value").alias("w")).first()
        width = first.w if first else 1
        vectors = rows.select(F.col("index").alias("id"), F.col("__value").alias("v"))
        state = self._state()
        known = state.read("embeddings", input) if state else None
        if known is not None:
            near = dedup.embedding_pairs(vectors, threshold, width, known.select(F.col("item").alias("id"), F.col("value").alias("v")))
            vectors = vectors.join(near.select(F.col("i").alias("id")).distinct(), "id", "left_anti")
        if threshold > 1e-9:  # copies go with the first of them, whatever becomes of it; vectors with a NaN are near none
            vectors = storage.stash(vectors.groupBy("v", F.when(F.exists("v", F.isnan), F.col("id"))).agg(F.min("id").alias("id")).select("id", "v"), "vectors")
        pairs = storage.stash(dedup.embedding_pairs(vectors, threshold, width), "pairs")
        kept = rows.join(dedup.independent(vectors.select("id"), pairs).withColumnRenamed("id", "index"), "index", "left_semi")
        if similarity_output:
            nearest = pairs.groupBy(F.col("j").alias("index")).agg(F.min("distance").alias(similarity_output))
            kept = kept.drop(similarity_output).join(nearest, "index", "left").fillna({similarity_output: 0.0})
            self.dynamic.discard(similarity_output)
        self._gate(step, kept, "embeddings", "__value", input)
        return self

    # generation

    def _generate(self, step: str, template: Column, llm: str, output: str, system: Column | None, schema: dict | None, path: str | None, as_json: bool, max_tokens: int | None, temperature: float | None) -> None:
        model = self.pipeline.llms[llm]

        def run(prompt: pa.Array, first: pa.Array) -> pa.Array:
            prompts = [None if p is None else [*([{"role": "system", "content": s}] if s else []), {"role": "user", "content": p}] for p, s in zip(prompt.to_pylist(), first.to_pylist())]
            got = generate.answers(model, prompts, schema, max_tokens, temperature)
            if as_json:
                values = [generate.json_answer(t, path) for t in got]
                got = [None if v is None else dumps(v) for v in values]
            return pa.array(got, type=pa.string())

        if self.pipeline.workers and self.df.sparkSession.sparkContext.defaultParallelism < self.pipeline.workers:
            self.df = self.df.repartition(self.pipeline.workers)
        self._set(output, F.arrow_udf(run, returnType="string").asNondeterministic()(template, system if system is not None else F.lit("")), dynamic=as_json)
        self.df = storage.stash(self.df, "answers")  # so that no call is made twice
        self._filter(step, F.col(f"`{output}`").isNotNull())

    def _system(self, name: str | None) -> Column | None:
        return None if name is None else self._text(self.pipeline.templates[name])

    def generate_text(self, template: str, llm: str, output: str, system_template: str | None = None, max_tokens: int | None = 1024, temperature: float | None = 0.1) -> _Steps:
        self._generate(self._note("GENERATE_TEXT", llm), self._text(self.pipeline.templates[template]), llm, output, self._system(system_template), None, None, False, max_tokens, temperature)
        return self

    def generate_json(self, template: str, llm: str, output: str, json_path: str | None = None, system_template: str | None = None, response_format: Any = None, schema_template: str | None = None, max_tokens: int | None = 1024, temperature: float | None = 0.1) -> _Steps:
        """A JSON answer; with a schema (a model class, a dict, or a template's name or text) answers that don't fit it fail."""
        step = self._note("GENERATE_JSON", llm)
        schema = None
        if response_format is not None:
            schema = response_format.model_json_schema() if hasattr(response_format, "model_json_schema") else response_format
        elif schema_template is not None:
            schema = json.loads(self.pipeline.templates.get(schema_template, schema_template))
        self._generate(step, self._text(self.pipeline.templates[template]), llm, output, self._system(system_template), schema, json_path, True, max_tokens, temperature)
        if schema_template is not None:
            rules = closed(schema)
            self._filter(step, self._python(lambda data: is_valid(data[output], rules), [output], "boolean"))
        return self

    def generate_structured(self, template: str, llm: str, output: str, response_format: Any, **kwargs: Any) -> _Steps:
        return self.generate_json(template, llm, output, response_format=response_format, **kwargs)

    def judge_conversation(self, input: str, llm: str, output: str, language: str = "en", judge_type: JudgeType = JudgeType.Conversation, attach_to_conversation: bool = False, custom_template: str | None = None, custom_json_schema: dict | None = None, max_tokens: int | None = 1024, temperature: float | None = 0.1) -> _Steps:
        """A judge's JSON verdict on {messages, tools?}; custom needs a template's name or text, with conversation_messages and conversation_tools."""
        step = self._note("JUDGE", llm)
        if judge_type is JudgeType.Custom and custom_template is None:
            raise StepError("a custom judge needs a template")
        node, kind = jinja.parse_expression(input), judge_type.value
        template = None if custom_template is None else self.pipeline.templates.get(custom_template, custom_template)

        def prompt(data: dict) -> str:
            value = validate._decoded(jinja.evaluate(node, data))
            messages, tools = value["messages"], value.get("tools")
            if tools is None and kind.startswith("tools_calling"):
                raise StepError("tools are needed")
            if template is not None:
                return jinja.render(template, {**data, "conversation_messages": messages, "conversation_tools": tools})
            return generate.judge_prompt(kind, language, messages, tools)

        schema = custom_json_schema or (generate.judge_schema(kind) if judge_type is not JudgeType.Custom else None)
        self._generate(step, self._python(prompt, self._needs(node)), llm, output, None, schema, None, True, max_tokens, temperature)
        if attach_to_conversation:
            self._set(input, self._python(lambda data: dumps({**validate._decoded(data[input]), "judge": data[output]}), [input, output]), dynamic=True)
        return self

    # conversations

    def _conversation(self, step: str, text: str, output: str, tools: str | None, separator: str, make: Callable[[dict, dict], Any]) -> _Steps:
        turns = conv.parse(text, separator)
        needed = {k for _, _, keys in turns for k in keys}
        if not self.opaque and (missing := needed - set(self.keys)):
            raise StepError(f"no columns {sorted(missing)}")
        node = jinja.parse_expression(tools) if tools else None

        def run(data: dict) -> str | None:
            value = {"messages": conv.build(turns, data), "id": str(data.get("index"))}
            if node is not None:
                value["tools"] = conv.decode_tools(jinja.evaluate(node, data))
            if validate.messages_error(value) is not None:
                return None
            return dumps(make(value, data))

        self._set(output, self._python(run, strict=True), dynamic=True)
        self._filter(step, F.col(f"`{output}`").isNotNull())
        return self

    def render_conversation(self, conversation: str, output: str, tools: str | None = None, separator: str = "|") -> _Steps:
        return self._conversation(self._note("RENDER_CONVERSATION"), conversation, output, tools, separator, lambda value, data: value)

    render_sft = render_conversation

    def render_dpo(self, conversation: str, output: str, chosen: str, rejected: str, tools: str | None = None, separator: str = "|") -> _Steps:
        a, b = jinja.parse_expression(chosen), jinja.parse_expression(rejected)

        def make(value: dict, data: dict) -> dict:
            out = {"messages": value["messages"], "chosen": conv.choice(jinja.evaluate(a, data)), "rejected": conv.choice(jinja.evaluate(b, data))}
            return out | ({"tools": value["tools"]} if "tools" in value else {})

        return self._conversation(self._note("RENDER_DPO"), conversation, output, tools, separator, make)

    def render_grpo(self, conversation: str, output: str, solution: str, validator_id: str, tools: str | None = None, separator: str = "|") -> _Steps:
        s = jinja.parse_expression(solution)

        def make(value: dict, data: dict) -> dict:
            out = {"messages": value["messages"], "solution": jinja.text_of(jinja.evaluate(s, data)), "validator_id": validator_id}
            return out | ({"tools": value["tools"]} if "tools" in value else {})

        return self._conversation(self._note("RENDER_GRPO"), conversation, output, tools, separator, make)

    def render_tool_call(self, arguments: str, output: str, tool: str | None = None, tool_name: str | None = None, additional_template: str | None = None) -> _Steps:
        step = self._note("RENDER_TOOL_CALL")
        if (tool is None) == (tool_name is None):
            raise StepError("either tool or tool_name is needed")
        name, args = jinja.parse_expression(tool) if tool else None, jinja.parse_expression(arguments)
        template = self.pipeline.templates.get(additional_template, additional_template) if additional_template else None

        def run(data: dict) -> str:
            call = conv.tool_call(tool_name if name is None else jinja.evaluate(name, data), jinja.evaluate(args, data))
            return dumps(call if template is None else jinja.render(template, {**data, output: call}))

        self._set(output, self._python(run, strict=True), dynamic=True)
        self._filter(step, F.col(f"`{output}`").isNotNull())
        return self

    # sinks

    def _lines(self, step: str, template: str | None, value: str) -> DataFrame:
        if template is not None:
            line = self._text(self.pipeline.templates.get(template, template))
        else:
            c, dynamic = self._value(value)
            kind = None if dynamic else self._compiler().type_of(c)
            line = F.coalesce(self._string(value), c) if dynamic else c if isinstance(kind, T.StringType) else self._json(value)
        return self.df.select(F.replace(line, F.lit("\n"), F.lit("\\n")).alias("value")).where("value is not null")

    def _write(self, lines: DataFrame, path: str, single_file: bool) -> None:
        if not single_file:
            lines.write.mode("append").text(path)
            return
        with open(path, "a") as f:
            for row in lines.toLocalIterator():
                f.write(row.value + "\n")

    def write_jsonl(self, path: str, template: str | None = None, value: str = "output", single_file: bool = False) -> _Steps:
        """Lines appended to a folder, or to one local file through the driver."""
        lines = self._lines(self._note("WRITE_JSONL", path), template, value)
        self.sinks.append((path, lambda: self._write(lines, path, single_file)))
        return self

    def write_csv(self, path: str, columns: Sequence[str], delimiter: str = ",", delimeter: str | None = None, single_file: bool = False) -> _Steps:
        """Lines of JSON values without a header; columns that aren't there are left out."""
        self._note("WRITE_CSV", path)
        parts = [F.coalesce(self._json(c), F.lit("null")) for c in columns if c in self.keys or self.opaque]
        lines = self.df.select(F.concat_ws(delimeter or delimiter, *parts).alias("value"))
        self.sinks.append((path, lambda: self._write(lines, path, single_file)))
        return self

    def write_parquet(self, path: str, mode: str = "append") -> _Steps:
        """The context's columns as they are."""
        self._note("WRITE_PARQUET", path)
        rows = self.df
        self.sinks.append((path, lambda: rows.write.mode(mode).parquet(path)))
        return self

    def print(self, *args: Any, template: str | None = None, columns: Sequence[str] | None = None, limit: int = 20) -> _Steps:
        """The first rows, printed when the pipeline runs."""
        step = self._note("PRINT")
        columns = columns or (args[0] if args and not isinstance(args[0], str) else list(args)) or None
        if template is not None:
            lines = self._lines(step, template, "")
        elif columns:
            lines = self.df.select(F.concat_ws(" | ", *[F.coalesce(self._string(c), self._json(c)) for c in columns]).alias("value"))
        else:
            lines = self.df.select(self._python(lambda data: dumps(data)).alias("value"))
        self.sinks.append(("", lambda: [print(r.value) for r in lines.limit(limit).collect()]))
        return self


class Chain:
    """Steps of a branch, recorded until the branch is planned; every step of the runner can be used, branches too."""

    def __init__(self) -> None:
        self.calls: list[tuple[str, tuple, dict]] = []

    def __getattr__(self, name: str) -> Callable:
        if name.startswith("_") or not hasattr(_Steps, name):
            raise AttributeError(name)

        def record(*args: Any, **kwargs: Any) -> Chain:
            self.calls.append((name, args, kwargs))
            return self

        return record


class PipelineRunner(_Steps):
    """A pipeline with its source; resources can still be registered."""

    def __getattr__(self, name: str) -> Any:
        if name.startswith("with_"):

            def register(*args: Any, **kwargs: Any) -> PipelineRunner:
                getattr(self.pipeline, name)(*args, **kwargs)
                return self

            return register
        raise AttributeError(name)

    def dataframe(self) -> DataFrame:
        """The rows so far; dynamic columns are JSON text."""
        return self.df.select(*[F.col(f"`{k}`") for k in self.keys], *([F.col("__ctx").alias("context")] if self.opaque else []))

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def describe(self) -> str:
        """The steps as a Mermaid graph."""
        names = [f'    n{k}["{name}{": " + detail if detail else ""}"]' for k, (name, detail) in enumerate(self.graph)]
        return "\n".join(["graph TD", *names, *[f"    n{k} --> n{k + 1}" for k in range(len(self.graph) - 1)]])

    ui = describe

    def rejected(self) -> DataFrame:
        """(step, count) of rows that each step dropped, most first."""
        spark, out = self.pipeline.spark, None
        for step, before, after in self.dropped:
            n = before.select(F.lit(step).alias("step"), F.lit(1).alias("n")).unionAll(after.select(F.lit(step), F.lit(-1)))
            out = n if out is None else out.unionAll(n)
        if out is None:
            return spark.createDataFrame([], "step string, count long")
        return out.groupBy("step").agg(F.sum("n").alias("count")).where("count > 0").orderBy(F.desc("count"), "step")

    def log(self, level: str = "info", path: str | None = None) -> PipelineRunner:
        import logging

        logging.basicConfig(level=level.upper(), filename=path)
        return self

    def debug(self) -> PipelineRunner:
        return self.log("debug")

    def stop(self) -> None:
        self.pipeline.spark.sparkContext.cancelJobGroup(self.pipeline.name)

    def run(self, progress: Callable[[dict], None] | None = None) -> None:
        """Write all sinks, then what the gates kept; a failed run leaves no state."""
        run_id, started = uuid.uuid4().hex, time.time()
        spark = self.pipeline.spark
        spark.sparkContext.setJobGroup(self.pipeline.name, f"pipeline {self.pipeline.name}")
        state = self._state()
        try:
            for k, (path, write) in enumerate(self.sinks):
                write()
                if progress:
                    progress({"event": "progress", "sink": path, "index": k, "total": len(self.sinks)})
            if not self.sinks:
                self.df.write.format("noop").mode("overwrite").save()
            if state:
                for table, rows in self.pending:
                    state.append(table, run_id, rows)
                state.append_run(run_id, "completed", started, self.df.select(F.col("index")) if "index" in self.df.columns else None)
        except Exception:
            if state:
                state.append_run(run_id, "failed", started, None)
            raise
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        if progress:
            progress({"event": "finished", "seconds": time.time() - started})
