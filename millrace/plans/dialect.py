"""SQL of other dialects that Spark rejects, as SQL functions and clause rewrites."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = {
    "array_get(a ARRAY<STRING>, i INT)": ("STRING", "try_element_at(a, i)"), "array_lower(a ARRAY<STRING>)": ("INT", "1"), "array_reverse(a ARRAY<STRING>)": ("ARRAY<STRING>", "reverse(a)"),
    "array_unique(a ARRAY<STRING>)": ("ARRAY<STRING>", "array_distinct(a)"), "array_length(a ARRAY<STRING>)": ("INT", "size(a)"), "array_to_string(a ARRAY<STRING>, s STRING)": ("STRING", "array_join(a, s)"),
    "array_sum(a ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(a, 0D, (x, y) -> x + y)"), "array_mean(a ARRAY<DOUBLE>)": ("DOUBLE", "aggregate(a, 0D, (x, y) -> x + y) / size(a)"),
    "cosd(x DOUBLE)": ("DOUBLE", "cos(radians(x))"), "sind(x DOUBLE)": ("DOUBLE", "sin(radians(x))"), "tand(x DOUBLE)": ("DOUBLE", "tan(radians(x))"),
    "starts_with(s STRING, p STRING)": ("BOOLEAN", "startswith(s, p)"), "ends_with(s STRING, p STRING)": ("BOOLEAN", "endswith(s, p)"), "strpos(s STRING, p STRING)": ("INT", "instr(s, p)"),
}
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss"}
_installed: set[str] = set()


def install(spark: SparkSession) -> None:
    """The functions, once per session."""
    key = f"{spark.sparkContext.applicationId}/{id(spark)}"
    if key not in _installed:
        for head, (kind, body) in FUNCTIONS.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
        _installed.add(key)


def rewrite(sql: str) -> str:
    """Clauses and calls that need another form; text in quotes stays."""
    parts = re.split(r"('(?:[^']|'')*')", sql)

    def outside(pattern: str, to) -> None:
        for k in range(0, len(parts), 2):
            parts[k] = re.sub(pattern, to, parts[k], flags=re.I)

    outside(r"\*\s+EXCLUDE\b", "* EXCEPT")
    outside(r"\bquantile_cont\s*\(", "percentile(")
    outside(r"\bunnest\s*\(", "explode(")
    sql = "".join(parts)
    sql = re.sub(r"(?i)\bstring_to_array\s*\(\s*((?:[^(),']|\([^()]*\)|'(?:[^']|'')*')+?)\s*,\s*'((?:[^']|'')*)'\s*\)", lambda m: f"split({m[1]}, '{_literal(m[2])}')", sql)
    parts = re.split(r"('(?:[^']|'')*')", sql)
    outside(r"([\w.]+)\s*//\s*([\w.]+)", r"floor(\1 / \2)")
    outside(r"(?<![<>!=])\s~\s(?!=)", " RLIKE ")
    for k in range(1, len(parts), 2):
        before = parts[k - 1]
        if re.search(r"\b(strftime|strptime)\s*\([^()]*,\s*$", before, re.I):
            for a, b in _FORMATS.items():
                parts[k] = parts[k].replace(a, b)
    outside(r"\bstrftime\s*\(", "date_format(")
    outside(r"\bstrptime\s*\(", "to_timestamp(")
    sql = "".join(parts)
    top = _outermost(sql)
    q = re.search(r"(?i)\bqualify\b", top)
    if q and re.match(r"(?i)\s*select\b", top):
        rest = re.search(r"(?i)\border\s+by\b|\blimit\b", top[q.end() :])
        end = q.end() + rest.start() if rest else len(sql)
        sql = _qualify(sql[: q.start()], sql[q.end() : end], sql[end:])
    m = re.fullmatch(r"(?is)\s*select\s+distinct\s+on\s*\(([^)]*)\)\s*(.*?)\s+from\s+(.*?)(?:\border\s+by\s+(.*))?", sql)
    if m:
        order = m[4] or m[1]
        sql = f"SELECT * EXCEPT (__first) FROM (SELECT {m[2]}, row_number() OVER (PARTITION BY {m[1]} ORDER BY {order}) AS __first FROM {m[3]}) WHERE __first = 1"
    return sql


def _literal(text: str) -> str:
    """A delimiter as a pattern in a SQL string."""
    return "".join(c if c.isalnum() or c in " ,;:_'" else "[\\\\" + c + "]" if c in "\\]^" else f"[{c}]" for c in text)


def _outermost(sql: str) -> str:
    """The statement with everything in parentheses or quotes blanked, of the same length."""
    out, depth, quote = [], 0, ""
    for c in sql:
        if quote:
            out.append(" ")
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
            out.append(" ")
        else:
            depth -= c == ")"
            out.append(c if depth == 0 and c not in "()" else " ")
            depth += c == "("
    return "".join(out)


def _qualify(select: str, condition: str, rest: str) -> str:
    """The windows of a QUALIFY condition as columns of a subquery."""
    windows: list[str] = []

    def name(m: re.Match) -> str:
        windows.append(m[0])
        return f"__w{len(windows)}"

    condition = re.sub(r"\w+\s*\((?:[^()]|\([^()]*\))*\)\s*over\s*\((?:[^()]|\([^()]*\))*\)", name, condition, flags=re.I)
    m = re.fullmatch(r"(?is)(\s*select\s+)(.*?)(\s+from\s.*)", select)
    extra = "".join(f", {w} AS __w{k + 1}" for k, w in enumerate(windows))
    drop = f" EXCEPT ({', '.join(f'__w{k + 1}' for k in range(len(windows)))})" if windows else ""
    return f"SELECT *{drop} FROM ({m[1]}{m[2]}{extra}{m[3]}) WHERE {condition} {rest}"


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The statement in Spark, after UNION BY NAME and the rewrites; double quotes name columns."""
    install(spark)
    parts = re.split(r"(?i)\bunion\s+(all\s+)?by\s+name\b", sql)
    if len(parts) > 1:
        out = run_sql(spark, parts[0])
        for k in range(1, len(parts), 2):
            out = out.unionByName(run_sql(spark, parts[k + 1]), allowMissingColumns=True)
            if not parts[k]:
                out = out.distinct()
        return out
    old = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers", "false")
    spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    try:
        return spark.sql(rewrite(sql))
    finally:
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", old)
