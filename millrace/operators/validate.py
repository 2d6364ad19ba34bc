"""Rules for tool definitions and conversations, in Python; they run in Arrow UDFs."""

from __future__ import annotations

import json
import re
from typing import Any

from ..functions.json_schema import closed, is_valid

_NAME = re.compile(r"[a-zA-Z0-9_.-]+").fullmatch
_KINDS = ("string", "number", "integer", "boolean", "object", "array", "null")


def _decoded(value: Any) -> Any:
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def tool_error(tool: Any) -> str | None:
    """What is wrong with a tool definition, or None."""
    if not isinstance(tool, dict):
        return "a tool must be an object"
    if not isinstance(tool.get("name"), str) or not _NAME(tool["name"]):
        return "bad tool name"
    if not isinstance(tool.get("description"), str):
        return "description must be a string"
    parameters = _decoded(tool.get("parameters"))
    if not isinstance(parameters, dict):
        return "parameters must be an object"
    kind = parameters.get("type")
    if kind != "object" and not (isinstance(kind, list) and "object" in kind):
        return "parameters must be of type object"
    properties = _decoded(parameters.get("properties"))
    if properties is not None and not isinstance(properties, dict):
        return "properties must be an object"
    for name, p in (properties or {}).items():
        if not _NAME(name):
            return f"bad property name {name!r}"
        if not isinstance(p, dict):
            return f"property {name!r} must be an object"
        kinds = p.get("type")
        kinds = kinds if isinstance(kinds, list) else [kinds] if kinds is not None else []
        if any(k not in _KINDS for k in kinds):
            return f"bad type of property {name!r}"
        if "enum" in p:
            if not isinstance(p["enum"], list):
                return f"enum of {name!r} must be an array"
            if kinds and not all(any(is_valid(v, {"type": k}) for k in kinds) for v in p["enum"]):
                return f"enum of {name!r} doesn't fit its type"
    required = parameters.get("required")
    if required is not None:
        if not isinstance(required, list) or not all(isinstance(r, str) for r in required):
            return "required must be an array of names"
        if properties is not None and not set(required) <= set(properties):
            return "required names an unknown property"
    return None


def tools_valid(value: Any) -> bool:
    value = _decoded(value)
    return all(tool_error(t) is None for t in (value if isinstance(value, list) else [value]))


def normalize_tool(tool: dict) -> dict:
    """Name, description and parameters of a tool, with parameters and properties decoded and a misplaced `required` moved up."""
    parameters = _decoded(tool.get("parameters"))
    if isinstance(parameters, dict):
        parameters = dict(parameters)
        properties = _decoded(parameters.get("properties"))
        if isinstance(properties, dict):
            properties = dict(properties)
            if isinstance(properties.get("required"), list):
                parameters["required"] = properties.pop("required")
            parameters["properties"] = properties
        elif "required" not in parameters:
            parameters["required"] = []
    return {k: v for k, v in (("name", tool.get("name")), ("description", tool.get("description")), ("parameters", parameters)) if v is not None}


def normalize_tools(value: Any) -> Any:
    value = _decoded(value)
    return [normalize_tool(t) for t in value] if isinstance(value, list) else normalize_tool(value)


def _schema(tool: dict) -> dict:
    return closed({**_decoded(tool.get("parameters") or {})})


def messages_error(conversation: Any) -> str | None:
    """What is wrong with {messages, tools?}, or None."""
    if not isinstance(conversation, dict) or not isinstance(conversation.get("messages"), list):
        return "messages must be an array"
    tools = _decoded(conversation.get("tools"))
    known = None
    if tools:
        known = {}
        for t in tools:
            t = t.get("function", t) if isinstance(t, dict) else {}
            known[t.get("name")] = t
    for m in conversation["messages"]:
        if not isinstance(m, dict):
            return "a message must be an object"
        role = m.get("role")
        if role in ("user", "tool") and not isinstance(m.get("content"), str):
            return f"content of {role} must be a string"
        if role == "tool" and not isinstance(_decoded(m["content"]), dict):
            return "content of tool must be a JSON object"
        if role == "assistant":
            if not any(m.get(k) is not None for k in ("content", "tool_calls", "reasoning_content")):
                return "an assistant message needs content, tool_calls or reasoning_content"
            calls = m.get("tool_calls")
            if calls is not None and not isinstance(calls, list):
                return "tool_calls must be an array"
            for call in calls or ():
                f = call.get("function") if isinstance(call, dict) else None
                if not isinstance(f, dict) or not isinstance(f.get("name"), str) or not _NAME(f["name"]):
                    return "bad tool call"
                if known is not None:
                    if f["name"] not in known:
                        return f"unknown tool {f['name']!r}"
                    if "arguments" not in f:
                        return "arguments are missing"
                    arguments = _decoded(f["arguments"])
                    if arguments is not None and (not isinstance(arguments, dict) or not is_valid(arguments, _schema(known[f["name"]]))):
                        return "arguments don't fit the tool"
        elif role not in ("user", "tool", "system"):
            return f"unknown role {role!r}"
    return None


def legacy_error(value: dict) -> str | None:
    """What is wrong with {conversation: [{speaker, message, action, details}], function_descriptions?}, or None."""
    turns = value.get("conversation")
    if not isinstance(turns, list):
        return "conversation must be an array"
    described = _decoded(value.get("function_descriptions"))
    known = {t.get("name") for t in described} if described else None
    for t in turns:
        if not isinstance(t, dict) or t.get("speaker") not in ("human", "assistant", "system"):
            return "unknown speaker"
        if any(k not in t for k in ("message", "action", "details")):
            return "message, action and details are needed"
        details = t["details"]
        if t["action"] == "function-call":
            if not isinstance(details, dict) or not isinstance(details.get("name"), str) or "arguments" not in details:
                return "a function call needs a name and arguments"
            if known is not None and details["name"] not in known:
                return "unknown function"
        elif t["action"] == "function-response" and (not isinstance(details, dict) or any(isinstance(v, list) for v in details.values())):
            return "a function response maps names to values"
    return None


def conversation_valid(value: Any) -> bool:
    value = _decoded(value)
    if isinstance(value, list):
        return all(map(conversation_valid, value))
    if not isinstance(value, dict):
        return False
    if "conversation" in value:
        return legacy_error(value) is None
    return "messages" in value and messages_error(value) is None


def legacy_to_messages(value: dict) -> dict:
    """A legacy conversation in the form of messages and tools."""
    roles, out = {"human": "user", "assistant": "assistant", "system": "system"}, []
    for t in value.get("conversation", []):
        if t.get("action") == "function-call":
            out.append({"role": "assistant", "tool_calls": [{"function": {"name": t["details"]["name"], "arguments": t["details"].get("arguments")}}]})
        elif t.get("action") == "function-response":
            out.append({"role": "tool", "content": json.dumps(t["details"], ensure_ascii=False)})
        else:
            out.append({"role": roles[t["speaker"]], "content": t.get("message")})
    return {"messages": out, **({"tools": value["function_descriptions"]} if value.get("function_descriptions") else {})}


def json_valid(instance: Any, schema: Any) -> bool:
    return is_valid(_decoded(instance) if isinstance(instance, str) and isinstance(_decoded(instance), (dict, list)) else instance, closed(schema))
