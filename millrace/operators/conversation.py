"""Conversations from the `@role:key` language, tool calls, and DPO / GRPO records."""

from __future__ import annotations

import json
import re
from typing import Any

from ..functions.filters import dumps
from ..functions.jinja import text_of
from .validate import _decoded

ROLES = {"s": "system", "u": "user", "a": "assistant", "t": "tool", "system": "system", "user": "user", "assistant": "assistant", "tool": "tool"}
_TURN = re.compile(r"@(\w+):(?:(tool_calls)\(\[([^\]]*)\]\)|(think)\(([^)]*)\)|([\w.\[\]]+))\Z")


def parse(text: str, separator: str = "|") -> list[tuple[str, str, list[str]]]:
    """Turns (role, "content" | "tool_calls" | "think", keys); errors come at plan time."""
    if separator != "\n":
        text = text.replace("\n", "")
    turns = []
    for part in text.split(separator):
        part = part.strip()
        if not part:
            continue
        m = _TURN.match(part)
        if m is None:
            raise ValueError(f"bad turn {part!r}")
        if m[1] not in ROLES:
            raise ValueError(f"unknown role {m[1]!r}")
        if m[2]:
            turns.append((ROLES[m[1]], "tool_calls", [k.strip() for k in m[3].split(",") if k.strip()]))
        elif m[4]:
            turns.append((ROLES[m[1]], "think", [m[5].strip()]))
        else:
            turns.append((ROLES[m[1]], "content", [m[6]]))
    return turns


def as_call(value: Any) -> dict:
    """A tool call from text or an object."""
    value = _decoded(value)
    if isinstance(value, dict):
        if "function" in value:
            return {"function": value["function"]}
        if "name" in value:
            return {"function": value}
    return {"function": {"name": value}}


def build(turns: list[tuple[str, str, list[str]]], data: dict) -> list[dict]:
    """Messages of a row; a missing key is an error."""
    out = []
    for role, kind, keys in turns:
        values = [data[k] for k in keys]
        if kind == "tool_calls":
            out.append({"role": role, "tool_calls": [as_call(v) for v in values]})
        elif kind == "think":
            out.append({"role": role, "reasoning_content": text_of(values[0])})
        else:
            v = values[0]
            out.append({"role": role, "content": v if isinstance(v, str) else dumps(v)})
    return out


def decode_tools(tools: Any) -> Any:
    """Tools with their properties as objects."""
    tools = _decoded(tools)
    out = []
    for t in tools if isinstance(tools, list) else [tools]:
        p = t.get("parameters") if isinstance(t, dict) else None
        if isinstance(p, dict) and isinstance(p.get("properties"), str):
            t = {**t, "parameters": {**p, "properties": _decoded(p["properties"])}}
        out.append(t)
    return out


def choice(value: Any) -> str:
    """A DPO answer: a call in tags, other values as JSON text, texts as they are."""
    decoded = _decoded(value)
    if isinstance(decoded, dict) and "name" in decoded:
        return f'<tool_call>{{"name":{json.dumps(decoded["name"], ensure_ascii=False)},"arguments":{dumps(decoded.get("arguments"))}}}</tool_call>'
    return value if isinstance(value, str) else dumps(value)


def tool_call(name: Any, arguments: Any) -> dict:
    if isinstance(arguments, str):
        arguments = json.loads(arguments)
    return {"function": {"name": name, "arguments": arguments}}
