"""Template filters in Python, and the same as Spark expressions where there are any."""

from __future__ import annotations

import json
import random
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jinja import UNDEFINED, text_of

_HTML = str.maketrans({"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "'": "\\u0027"})


def dumps(value: Any, indent: int | None = None) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(None if value is UNDEFINED else value, ensure_ascii=False, sort_keys=True, separators=(",", ":") if indent is None else (",", ": "), indent=indent, default=text_of)


def tojson(value: Any, indent: int | None = None) -> str:
    return dumps(value, indent).translate(_HTML)


def jstr(value: Any) -> str:
    """The JSON string of a value's text."""
    return json.dumps(text_of(value), ensure_ascii=False)


def tool_call(value: Any) -> str:
    return f'"<tool_call>{jstr(value)[1:-1]}</tool_call>"'


def tool_call_args(value: Any) -> str:
    return jstr(value)[1:-1]


def shuffle(value: Any) -> Any:
    """A JSON array text with its items in random order; other texts stay."""
    try:
        items = json.loads(text_of(value))
    except ValueError:
        return value
    if not isinstance(items, list):
        return value
    random.shuffle(items)
    return dumps(items)


def random_range(value: Any) -> Any:
    """"a,b" gives an integer of [a, b); other texts stay."""
    try:
        lo, hi = (int(x) for x in text_of(value).split(","))
        return random.randrange(lo, hi)
    except ValueError:
        return value


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32."""
    h, n = seed, len(data)
    for i in range(0, n - n % 4, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & 0xFFFFFFFF
    if n % 4:
        k = int.from_bytes(data[n - n % 4 :], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def deserialize(value: Any) -> Any:
    """JSON text written again in one form; other texts stay."""
    try:
        return dumps(json.loads(text_of(value)))
    except ValueError:
        return value


def dict2items(value: Any) -> str:
    got = json.loads(value) if isinstance(value, str) else value
    return dumps([[k, v] for k, v in got.items()])


def extract_json(text: str | None) -> Any:
    """The JSON value in a model's answer: the whole text, a fenced block, or the first balanced object; None without one."""
    if text is None:
        return None
    text = text.replace("<|im_end|>", "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for candidate in (text, fenced[1] if fenced else None):
        if candidate:
            try:
                return json.loads(candidate)
            except ValueError:
                pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def json_path(value: Any, path: str) -> Any:
    """Value at a dotted path of objects, None where it is missing."""
    for key in path.split(".") if path else []:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _default(value: Any, other: Any = "", boolean: bool = False) -> Any:
    return other if value is UNDEFINED or (boolean and not value) else value


FILTERS = {
    "jstr": jstr, "tojson": tojson, "tool_call": tool_call, "tool_call_args": tool_call_args, "shuffle": shuffle, "random_range": random_range,
    "hash": lambda v: format(murmur3_32(text_of(v).encode()), "x"), "deserialize": deserialize, "dict2items": dict2items,
    "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(), "trim": lambda v: text_of(v).strip(), "length": len, "count": len,
    "title": lambda v: text_of(v).title(), "capitalize": lambda v: text_of(v).capitalize(), "replace": lambda v, a, b: text_of(v).replace(a, b),
    "default": _default, "d": _default, "join": lambda v, sep="", attribute=None: sep.join(text_of(x[attribute] if attribute else x) for x in v),
    "first": lambda v: v[0] if v else UNDEFINED, "last": lambda v: v[-1] if v else UNDEFINED, "int": lambda v, default=0: _number(int, v, default), "float": lambda v, default=0.0: _number(float, v, default),
    "string": text_of, "list": list, "sort": lambda v, reverse=False: sorted(v, reverse=reverse), "unique": lambda v: list(dict.fromkeys(v)), "reverse": lambda v: v[::-1],
    "round": lambda v, precision=0: round(v, precision), "abs": abs, "min": min, "max": max, "sum": sum, "items": lambda v: [list(x) for x in v.items()], "safe": lambda v: v, "escape": lambda v: v,
    "split": lambda v, sep=None: text_of(v).split(sep), "lines": lambda v: text_of(v).splitlines(), "map": lambda v, attribute=None: [x.get(attribute) if isinstance(x, dict) else x for x in v],
    "keys": lambda v: list(v), "values": lambda v: list(v.values()), "extract_json": lambda v: extract_json(text_of(v)),
}


def _number(kind, value: Any, default: Any) -> Any:
    try:
        return kind(float(value)) if kind is int and isinstance(value, str) else kind(value)
    except (TypeError, ValueError):
        return default


def jstr_column(text: Column) -> Column:
    """`jstr` of a string column, in the JVM."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def extract_json_column(text: Column) -> Column:
    """`extract_json` for whole texts and fenced blocks, as VARIANT, in the JVM."""
    clean = F.trim(F.replace(text, F.lit("<|im_end|>"), F.lit("")))
    fenced = F.regexp_extract(clean, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(clean), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(braces, F.lit(""))))


def canonical_json(text: Column) -> Column:
    """JSON text in one form (sorted keys, no spaces); texts that aren't JSON stay."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)
