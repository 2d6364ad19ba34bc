"""Sources as DataFrames; nothing is read until an action, and pushdown reaches the files."""

from __future__ import annotations

import json
import os
import re
import sqlite3
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import run_sql
from ..plans.storage import stash
from . import phrases, tools


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def csv(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True) -> DataFrame:
    df = spark.read.option("sep", delimiter[:1]).option("header", has_header).option("inferSchema", True).csv(path)
    return df if has_header else df.toDF(*[f"column_{k + 1}" for k in range(len(df.columns))])


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def auto(spark: SparkSession, path: str) -> DataFrame:
    end = os.path.splitext(path)[1].lower()
    if end in (".jsonl", ".ndjson"):
        return jsonl(spark, path)
    if end == ".csv":
        return csv(spark, path)
    if end in (".parquet", ".pq"):
        return parquet(spark, path)
    raise ValueError(f"unknown file extension {end!r}")


def dicts(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Rows of the driver's memory, by JSON inference."""
    rows = list(rows)
    if not rows:
        return spark.createDataFrame([], "value string").limit(0)
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(r, default=str) for r in rows]))


def arrow(spark: SparkSession, data: Any) -> DataFrame:
    """A table, a record batch reader, or a dataset that wraps a table."""
    import pyarrow as pa

    if isinstance(data, pa.RecordBatchReader):
        data = data.read_all()
    if hasattr(data, "data") and hasattr(data.data, "table"):
        data = data.data.table
    if not isinstance(data, pa.Table):
        raise ValueError("an Arrow table, a record batch reader or a dataset is expected")
    return spark.createDataFrame(data)


def hugging_face(spark: SparkSession, path: str, name: str | None = None, split: str = "train") -> DataFrame:
    try:
        from datasets import load_dataset
    except ImportError as e:
        raise ImportError("the datasets package is needed for this source") from e
    return arrow(spark, load_dataset(path, name, split=split))


def database(spark: SparkSession, conn: str, query: str) -> DataFrame:
    """JDBC; sqlite:// and a path is read by Python on the driver."""
    m = re.match(r"sqlite:(?://)?(.*)", conn)
    if m:
        path = m[1]
        with sqlite3.connect(path) as c:
            cursor = c.execute(query)
            names = [d[0] for d in cursor.description]
            rows = [dict(zip(names, r)) for r in cursor.fetchall()]  # a file database on the driver's disk
        return spark.createDataFrame(rows) if rows else spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    url = conn if conn.startswith("jdbc:") else "jdbc:" + conn
    return spark.read.format("jdbc").option("url", url).option("query", query).load()


def functions(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Tool rows (see tools.function_to_schema)."""
    ddl = "type string, name string, description string, parameters struct<type: string, properties: string, required: array<string>, additionalProperties: boolean>, strict boolean"
    if any("response" in r for r in rows):
        ddl += ", response struct<type: string, name: string, schema: string, strict: boolean>"
        rows = [{**r, "response": r.get("response")} for r in rows]
    return spark.createDataFrame(list(rows), ddl)


def python_tools(spark: SparkSession, tools_: Sequence) -> DataFrame:
    return functions(spark, [tools.function_to_schema(f, include_response=True) for f in tools_])


def pydantic_models(spark: SparkSession, models: Sequence[type]) -> DataFrame:
    return spark.createDataFrame([tools.class_to_schema(m) for m in models], "type string, name string, schema string, strict boolean")


def openapi(spark: SparkSession, path_or_url: str) -> DataFrame:
    return functions(spark, tools.openapi_functions(read_config(path_or_url)))


def internal(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in phrases.PHRASES[name]], "value string")


def read_config(path_or_url: str) -> Any:
    """JSON or YAML of a file or URL, with ${VAR} taken from the environment (an error where it is unset)."""
    if re.match(r"https?://", path_or_url):
        import urllib.request

        with urllib.request.urlopen(path_or_url) as f:
            text = f.read().decode()
    else:
        with open(path_or_url) as f:
            text = f.read()

    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise KeyError(f"environment variable {m[1]} is not set")
        return os.environ[m[1]]

    text = re.sub(r"\$\{(\w+)\}", value, text)
    if path_or_url.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError:
            return simple_yaml(text)
        return yaml.safe_load(text)
    return json.loads(text)


def simple_yaml(text: str) -> dict:
    """Nested mappings of plain scalars and block texts: enough for template files where no YAML package is there."""
    root: dict = {}
    stack = [(-1, root)]
    lines, k = text.splitlines(), 0
    while k < len(lines):
        line = lines[k]
        k += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        key, _, rest = line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        rest = rest.strip()
        if rest[:1] in "|>" and rest:
            block = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > depth):
                block.append(lines[k])
                k += 1
            inset = min((len(x) - len(x.lstrip()) for x in block if x.strip()), default=0)
            stack[-1][1][key] = ("\n" if rest[0] == "|" else " ").join(x[inset:] for x in block).rstrip() + ("\n" if rest in ("|", ">") else "")
        elif rest:
            stack[-1][1][key] = rest[1:-1] if rest[0] in "\"'" and rest[-1] == rest[0] else rest
        else:
            stack[-1][1][key] = {}
            stack.append((depth, stack[-1][1][key]))
    return root


def mixed(frames: dict[str, DataFrame]) -> DataFrame:
    """The Cartesian product of named datasets, each as a struct, and __ordinal: the first is the outermost.

    A product is this operator's meaning, and it is the only one in the library besides one-row sides.
    """
    out = None
    for name, df in frames.items():
        packed = with_index(df.select(F.struct("*").alias(name)), f"__i_{name}")
        if out is None:
            out = packed.withColumnRenamed(f"__i_{name}", "__ordinal")
        else:
            out = out.crossJoin(packed).withColumn("__ordinal", F.col("__ordinal") * df.count() + F.col(f"__i_{name}")).drop(f"__i_{name}")
    return out


def with_sql(spark: SparkSession, name: str, df: DataFrame, sql: str | None) -> DataFrame:
    """df registered as a view and, with sql, what the statement selects (all registered datasets are views)."""
    df.createOrReplaceTempView(name)
    if sql is None:
        return df
    out = run_sql(spark, sql)
    out.createOrReplaceTempView(name)
    return out


def with_index(df: DataFrame, name: str = "index") -> DataFrame:
    """df with dense ordinals in source order: one count per split gives each split's first ordinal; rows don't move.

    Spark deals files to partitions by size. Rows of one scan are numbered by file name and place in it, others by partition.
    """
    spark = df.sparkSession
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # a shuffle may deal rows otherwise when it runs again
        df = stash(df, "ordinals")
    scan = df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    file, block = (F.input_file_name(), F.input_file_block_start()) if scan else (F.lit(""), F.lit(-1).cast("long"))
    numbered = df.withColumns({"__mid": F.monotonically_increasing_id(), "__file": file, "__block": block})
    split = [F.shiftright("__mid", 33).alias("__p"), F.col("__file").alias("__f"), F.col("__block").alias("__b")]
    counts = numbered.groupBy(*split).agg(F.count("*").alias("n"), F.min("__mid").alias("first")).orderBy("__f", "__b", "__p").collect()  # one row per split
    starts, total = [], 0
    for r in counts:
        starts.append((r["__p"], r["__f"], r["__b"], total - r.first))
        total += r.n
    offsets = spark.createDataFrame(starts, "__p long, __f string, __b long, __start long")
    joined = numbered.join(F.broadcast(offsets), (F.shiftright("__mid", 33) == F.col("__p")) & (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + F.col("__mid")).alias(name))
