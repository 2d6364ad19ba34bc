"""A JSON Schema subset in Python: type, properties, required, additionalProperties, items, enum, const, bounds, pattern, combinations."""

from __future__ import annotations

import json
import re
from typing import Any

_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str),
    "integer": lambda v: (isinstance(v, int) and not isinstance(v, bool)) or (isinstance(v, float) and v.is_integer()),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
}


def is_valid(value: Any, schema: Any, root: Any = None) -> bool:
    if schema is True or schema == {}:
        return True
    if schema is False:
        return False
    root = schema if root is None else root
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            target = target.get(part, {}) if isinstance(target, dict) else {}
        return is_valid(value, target, root)
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(k in _TYPES and _TYPES[k](value) for k in kinds):
            return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if "const" in schema and value != schema["const"]:
        return False
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for key, bad in (("minimum", lambda a: value < a), ("maximum", lambda a: value > a), ("exclusiveMinimum", lambda a: value <= a), ("exclusiveMaximum", lambda a: value >= a), ("multipleOf", lambda a: value % a != 0)):
            if key in schema and bad(schema[key]):
                return False
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            return False
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return False
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            return False
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            return False
        if "items" in schema and not all(is_valid(v, schema["items"], root) for v in value):
            return False
    if isinstance(value, dict):
        if any(k not in value for k in schema.get("required") or ()):
            return False
        own = schema.get("properties") or {}
        for k, v in value.items():
            if k in own:
                if not is_valid(v, own[k], root):
                    return False
            elif any(re.search(p, k) and not is_valid(v, s, root) for p, s in (schema.get("patternProperties") or {}).items()):
                return False
            elif "additionalProperties" in schema and not is_valid(v, schema["additionalProperties"], root):
                return False
    if not all(is_valid(value, s, root) for s in schema.get("allOf", ())):
        return False
    if "anyOf" in schema and not any(is_valid(value, s, root) for s in schema["anyOf"]):
        return False
    if "oneOf" in schema and sum(is_valid(value, s, root) for s in schema["oneOf"]) != 1:
        return False
    return not ("not" in schema and is_valid(value, schema["not"], root))


def closed(schema: Any) -> dict:
    """The schema that validate_json applies: an object with just these properties and requirements, no others allowed."""
    schema = json.loads(schema) if isinstance(schema, str) else schema
    own = schema.get("properties") or {}
    return {"type": "object", "properties": json.loads(own) if isinstance(own, str) else own, "required": schema.get("required") or [], "additionalProperties": False}
