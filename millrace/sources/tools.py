"""Schemas from Python functions, Pydantic models and OpenAPI documents, and running tool calls. All on the driver: inputs are code, not data."""

from __future__ import annotations

import ast
import inspect
import json
import re
import types
import typing
from collections.abc import Callable, Iterable
from typing import Any

_JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object", tuple: "array", set: "array", type(None): "null"}


def _schema_of(annotation: Any) -> dict:
    """JSON Schema of a type annotation."""
    if annotation in (inspect.Parameter.empty, Any):
        return {}
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin is typing.Annotated:
        out = _schema_of(args[0])
        for extra in args[1:]:
            if getattr(extra, "description", None):
                out["description"] = extra.description
            for m in getattr(extra, "metadata", ()):
                for name, key in (("ge", "minimum"), ("le", "maximum"), ("gt", "exclusiveMinimum"), ("lt", "exclusiveMaximum"), ("min_length", "minLength"), ("max_length", "maxLength")):
                    if getattr(m, name, None) is not None:
                        out[key] = getattr(m, name)
        return out
    if origin is typing.Literal:
        kinds = list(dict.fromkeys(_JSON_TYPES[type(a)] for a in args))
        return {"type": kinds[0] if len(kinds) == 1 else kinds, "enum": list(args)}
    if origin in (typing.Union, types.UnionType):
        return normalize_schema({"anyOf": [_schema_of(a) for a in args]})
    if origin in (list, set, tuple, frozenset):
        return {"type": "array", **({"items": _schema_of(args[0])} if args else {})}
    if origin is dict:
        return {"type": "object"}
    if isinstance(annotation, type):
        if hasattr(annotation, "model_json_schema"):
            return normalize_schema(annotation.model_json_schema())
        if hasattr(annotation, "__members__"):
            values = [m.value for m in annotation]
            return {"type": _JSON_TYPES.get(type(values[0]), "string"), "enum": values}
        if annotation in _JSON_TYPES:
            return {"type": _JSON_TYPES[annotation]}
    return {"type": "object"}


def normalize_schema(schema: dict, defs: dict | None = None) -> dict:
    """References inlined, plain unions as a list of types, titles dropped."""
    defs = defs if defs is not None else schema.get("$defs", {})
    if "$ref" in schema:
        return normalize_schema(defs.get(schema["$ref"].rsplit("/", 1)[-1], {}), defs)
    out = {}
    for key, value in schema.items():
        if key in ("title", "$defs"):
            continue
        if key == "properties":
            out[key] = {k: normalize_schema(v, defs) for k, v in value.items()}
        elif key == "items" and isinstance(value, dict):
            out[key] = normalize_schema(value, defs)
        elif key in ("anyOf", "allOf", "oneOf"):
            out[key] = [normalize_schema(v, defs) for v in value]
        else:
            out[key] = value
    union = out.get("anyOf")
    if union and all("type" in u for u in union):
        merged: dict = {}
        for u in union:
            merged.update(u)
        kinds: list = []
        for u in union:
            kinds += u["type"] if isinstance(u["type"], list) else [u["type"]]
        merged["type"] = list(dict.fromkeys(kinds))
        if len(merged["type"]) == 1:
            merged["type"] = merged["type"][0]
        del out["anyOf"]
        out = {**merged, **out}
    if len(out.get("allOf", ())) == 1:
        out = {**out.pop("allOf")[0], **out}
    return out


def class_to_schema(model: type) -> dict:
    """A row for a Pydantic model; properties as JSON text, so that unlike models share one schema."""
    schema = normalize_schema(model.model_json_schema())
    return {"type": "json_schema", "name": model.__name__, "schema": json.dumps({"type": "object", "properties": schema.get("properties", {}), "required": schema.get("required", []), "additionalProperties": False}), "strict": True}


def function_to_schema(function: Callable, include_response: bool = False) -> dict:
    """A row for a Python function."""
    hints = typing.get_type_hints(function, include_extras=True)
    properties, required = {}, []
    for name, p in inspect.signature(function).parameters.items():
        properties[name] = _schema_of(hints.get(name, p.annotation))
        if hasattr(p.default, "description"):  # a Pydantic field
            if p.default.description:
                properties[name]["description"] = p.default.description
            for m in getattr(p.default, "metadata", ()):
                for key, to in (("ge", "minimum"), ("le", "maximum"), ("gt", "exclusiveMinimum"), ("lt", "exclusiveMaximum")):
                    if getattr(m, key, None) is not None:
                        properties[name][to] = getattr(m, key)
            if p.default.is_required():
                required.append(name)
        elif p.default is inspect.Parameter.empty:
            required.append(name)
    row = {
        "type": "function", "name": function.__name__, "description": inspect.getdoc(function) or "",
        "parameters": {"type": "object", "properties": json.dumps(properties), "required": required, "additionalProperties": False}, "strict": True,
    }
    result = hints.get("return")
    if include_response and isinstance(result, type) and hasattr(result, "model_json_schema"):
        row["response"] = class_to_schema(result)
    return row


def openapi_functions(document: dict) -> list[dict]:
    """A function row for each get, post, put and delete of an OpenAPI document."""
    rows = []

    def resolve(schema: dict) -> dict:
        if "$ref" in schema:
            target: Any = document
            for part in schema["$ref"].lstrip("#/").split("/"):
                target = target.get(part, {})
            return resolve(target)
        out = {k: v for k, v in schema.items() if k != "title"}
        if "properties" in out:
            out["properties"] = {k: resolve(v) for k, v in out["properties"].items()}
        if isinstance(out.get("items"), dict):
            out["items"] = resolve(out["items"])
        return out

    for path, methods in document.get("paths", {}).items():
        for method in ("get", "post", "put", "delete"):
            if method not in methods:
                continue
            op, properties, required = methods[method], {}, []
            for p in [*methods.get("parameters", ()), *op.get("parameters", ())]:
                properties[p["name"]] = {**resolve(p.get("schema", {})), **({"description": p["description"]} if p.get("description") else {})}
                if p.get("required"):
                    required.append(p["name"])
            body = op.get("requestBody", {}).get("content", {}).get("application/json", {}).get("schema")
            if body:
                schema = resolve(body)
                properties.update(schema.get("properties", {}))
                required += schema.get("required", [])
            name = op.get("operationId") or re.sub(r"[^A-Za-z0-9]+", "_", f"{method}_{path}").strip("_")
            rows.append({"type": "function", "name": name, "description": op.get("description") or op.get("summary") or "", "parameters": {"type": "object", "properties": json.dumps(properties), "required": list(dict.fromkeys(required)), "additionalProperties": False}, "strict": True})
    return rows


def python_functions_to_schemas(code: str) -> list[dict]:
    """Function rows from Python source, which is parsed but not run."""
    names = {"str": "string", "int": "integer", "float": "number", "bool": "boolean", "list": "array", "dict": "object", "List": "array", "Dict": "object"}

    def kind(node: ast.expr | None) -> dict:
        if isinstance(node, ast.Name):
            return {"type": names.get(node.id, "object")}
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name):
            if node.value.id == "Optional":
                return kind(node.slice)
            if node.value.id in ("list", "List"):
                return {"type": "array", "items": kind(node.slice)}
            return {"type": names.get(node.value.id, "object")}
        if isinstance(node, ast.BinOp):
            return kind(node.left)
        return {}

    rows = []
    for f in ast.walk(ast.parse(code)):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = [a for a in f.args.args if a.arg != "self"]
            free = len(args) - len(f.args.defaults)
            rows.append({"type": "function", "name": f.name, "description": ast.get_docstring(f) or "", "parameters": {"type": "object", "properties": json.dumps({a.arg: kind(a.annotation) for a in args}), "required": [a.arg for a in args[:free]], "additionalProperties": False}, "strict": True})
    return rows


class Tools:
    """Runs `<tool_call>{"name": …, "arguments": …}</tool_call>` texts against Python functions and keeps the messages."""

    def __init__(self, functions: Iterable[Callable]):
        self.functions = {f.__name__: f for f in functions}
        self.messages: list[dict] = []

    def schemas(self) -> list[dict]:
        return [function_to_schema(f) for f in self.functions.values()]

    def __call__(self, text: str) -> list[Any]:
        out = []
        for body in re.findall(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", text, re.S):
            call = json.loads(body)
            arguments = call.get("arguments") or {}
            arguments = json.loads(arguments) if isinstance(arguments, str) else arguments
            if call.get("name") not in self.functions:
                raise KeyError(f"unknown tool {call.get('name')!r}")
            result = self.functions[call["name"]](**arguments)
            self.messages += [{"role": "assistant", "tool_calls": [{"function": {"name": call["name"], "arguments": arguments}}]}, {"role": "tool", "content": json.dumps({call["name"]: result}, default=str)}]
            out.append(result)
        return out
