"""A small template language in Python: expressions, filters, if / for / set, whitespace control.

It serves templates that can't become a Spark expression (see `compile`), inside Arrow UDFs.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache
from typing import Any


class TemplateError(ValueError):
    """A template or expression that can't be parsed or evaluated."""


class _Undefined:
    def __bool__(self) -> bool:
        return False

    def __repr__(self) -> str:
        return "undefined"


UNDEFINED = _Undefined()
_LEX = re.compile(r"""\s+|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[-+*/%~<>()\[\]{}.,:|=])""", re.S)
_BLOCK = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'", "/": "/"}


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if m is None:
            raise TemplateError(f"unexpected character {text[at]!r} in {text!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
    return [*out, ("end", "")]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.source = _lex(text), 0, text

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return value in values and kind in ("op", "name")

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected in {self.source!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"name expected in {self.source!r}")
        self.at += 1
        return value

    def done(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")

    def expression(self) -> tuple:
        e = self.either()
        if self.take("if"):
            c = self.either()
            return ("if", c, e, self.expression() if self.take("else") else ("lit", UNDEFINED))
        return e

    def either(self) -> tuple:
        e = self.both()
        while self.take("or"):
            e = ("or", e, self.both())
        return e

    def both(self) -> tuple:
        e = self.inverse()
        while self.take("and"):
            e = ("and", e, self.inverse())
        return e

    def inverse(self) -> tuple:
        return ("not", self.inverse()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        e = self.sum()
        while True:
            if self.peek("==", "!=", "<", ">", "<=", ">="):
                op = self.tokens[self.at][1]
                self.at += 1
                e = ("cmp", op, e, self.sum())
            elif self.take("in"):
                e = ("in", e, self.sum())
            elif self.peek("not") and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                e = ("not", ("in", e, self.sum()))
            elif self.take("is"):
                negative = self.take("not")
                test = ("test", e, self.name(), self.args() if self.peek("(") else [])
                e = ("not", test) if negative else test
            else:
                return e

    def _left(self, below, ops: tuple) -> tuple:
        e = below()
        while self.peek(*ops):
            op = self.tokens[self.at][1]
            self.at += 1
            e = ("bin", op, e, below())
        return e

    def sum(self) -> tuple:
        return self._left(self.joined, ("+", "-"))

    def joined(self) -> tuple:
        return self._left(self.product, ("~",))

    def product(self) -> tuple:
        return self._left(self.unary, ("*", "/", "//", "%"))

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        if self.take("+"):
            return self.unary()
        e = self.postfix(self.primary())
        if self.take("**"):
            e = ("bin", "**", e, self.unary())
        return e

    def args(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            if self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                key = self.name()
                self.need("=")
                out.append((key, self.expression()))
            else:
                out.append((None, self.expression()))
            if not self.peek(")"):
                self.need(",")
        return out

    def postfix(self, e: tuple) -> tuple:
        while True:
            if self.take("."):
                kind, value = self.tokens[self.at]
                self.at += 1
                e = ("item", e, ("lit", int(value) if kind == "num" else value))
            elif self.take("["):
                parts, colons = [None, None, None], 0
                while not self.take("]"):
                    if self.take(":"):
                        colons += 1
                    else:
                        parts[colons] = self.expression()
                e = ("slice", e, *parts) if colons else ("item", e, parts[0])
            elif self.peek("("):
                e = ("call", e, self.args())
            elif self.take("|"):
                e = ("filter", e, self.name(), self.args() if self.peek("(") else [])
            else:
                return e

    def primary(self) -> tuple:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("lit", float(value) if "." in value or "e" in value.lower() else int(value))
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "name":
            known = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None, "null": None}
            return ("lit", known[value]) if value in known else ("name", value)
        if value == "(":
            e = self.expression()
            self.need(")")
            return e
        if value == "[":
            out = []
            while not self.take("]"):
                out.append(self.expression())
                if not self.peek("]"):
                    self.need(",")
            return ("list", out)
        if value == "{":
            out = []
            while not self.take("}"):
                k = self.expression()
                self.need(":")
                out.append((k, self.expression()))
                if not self.peek("}"):
                    self.need(",")
            return ("dict", out)
        raise TemplateError(f"unexpected {value!r} in {self.source!r}")


@lru_cache(maxsize=4096)
def parse_expression(text: str) -> tuple:
    p = _Parser(text.strip())
    e = p.expression()
    p.done()
    return e


def names(node: Any) -> set[str]:
    """Top-level names that an expression or template reads."""
    if isinstance(node, tuple):
        if node and node[0] == "name":
            return {node[1]}
        if node and node[0] == "lit":
            return set()
        return set().union(*map(names, node)) if node else set()
    if isinstance(node, list):
        return set().union(*map(names, node)) if node else set()
    return set()


@lru_cache(maxsize=1024)
def parse_template(text: str) -> list:
    """Statements: ("text", s), ("out", e), ("if", [(c, body)], else), ("for", names, e, body, else), ("set", name, e)."""
    if text.endswith("\n"):
        text = text[:-1]
    pieces = _BLOCK.split(text)
    for k in range(1, len(pieces), 2):
        if pieces[k].startswith(("{{-", "{%-")):
            pieces[k - 1] = pieces[k - 1].rstrip()
        if pieces[k].endswith(("-}}", "-%}")):
            pieces[k + 1] = pieces[k + 1].lstrip()
    at = 0

    def body(*ends: str) -> tuple[list, str]:
        nonlocal at
        out = []
        while at < len(pieces):
            s, k = pieces[at], at
            at += 1
            if k % 2 == 0:
                if s:
                    out.append(("text", s))
            elif s.startswith("{{"):
                out.append(("out", parse_expression(s[2:-2].strip("-").strip())))
            elif s.startswith("{%"):
                inner = s[2:-2].strip("-").strip()
                word = inner.split(None, 1)[0] if inner else ""
                if word in ends:
                    return out, inner
                out.append(statement(word, inner))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return out, ""

    def statement(word: str, inner: str) -> tuple:
        if word == "if":
            branches, other, cond = [], [], inner[2:]
            while True:
                inside, end = body("elif", "else", "endif")
                branches.append((parse_expression(cond), inside))
                if end.startswith("elif"):
                    cond = end[4:]
                    continue
                if end.startswith("else"):
                    other, _ = body("endif")
                return ("if", branches, other)
        if word == "for":
            m = re.fullmatch(r"for\s+(\w+(?:\s*,\s*\w+)*)\s+in\s+(.*)", inner, re.S)
            if m is None:
                raise TemplateError(f"bad loop {inner!r}")
            inside, end = body("else", "endfor")
            other = body("endfor")[0] if end == "else" else []
            return ("for", [x.strip() for x in m[1].split(",")], parse_expression(m[2]), inside, other)
        if word == "set":
            m = re.fullmatch(r"set\s+(\w+)\s*=\s*(.*)", inner, re.S)
            if m is None:
                raise TemplateError(f"bad assignment {inner!r}")
            return ("set", m[1], parse_expression(m[2]))
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


def text_of(value: Any) -> str:
    """How a value prints: JSON-like with spaces and sorted keys inside containers."""
    if value is UNDEFINED:
        return ""
    if value is None:
        return "none"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value
    if isinstance(value, (dict, list, tuple)):
        return json.dumps(value, ensure_ascii=False, sort_keys=True, default=text_of)
    return str(value)


def evaluate(node: tuple, env: dict) -> Any:
    kind = node[0]
    if kind == "lit":
        return node[1]
    if kind == "name":
        if node[1] in env:
            return env[node[1]]
        return FUNCTIONS.get(node[1], UNDEFINED)
    if kind == "item":
        base, key = evaluate(node[1], env), evaluate(node[2], env)
        if isinstance(base, dict):
            got = base.get(key, UNDEFINED)
            if got is UNDEFINED and key in ("items", "keys", "values"):
                return lambda: [list(x) for x in base.items()] if key == "items" else list(getattr(base, key)())
            return got
        if isinstance(base, (list, str)) and isinstance(key, int):
            return base[key] if -len(base) <= key < len(base) else UNDEFINED
        if isinstance(base, str) and key in ("strip", "upper", "lower", "startswith", "endswith", "split", "replace", "lstrip", "rstrip", "title"):
            return getattr(base, key)
        if isinstance(base, _Undefined):
            raise TemplateError(f"{key!r} of an undefined value")
        return UNDEFINED
    if kind == "slice":
        base = evaluate(node[1], env)
        return base[slice(*(None if x is None else evaluate(x, env) for x in node[2:]))]
    if kind == "bin":
        a, b = evaluate(node[2], env), evaluate(node[3], env)
        op = node[1]
        if op == "~":
            return text_of(a) + text_of(b)
        if op == "+":
            return a + b
        if op == "-":
            return a - b
        if op == "*":
            return a * b
        if op == "/":
            return a / b
        if op == "//":
            return a // b
        if op == "%":
            return a % b
        return a**b
    if kind == "neg":
        return -evaluate(node[1], env)
    if kind == "cmp":
        a, b = evaluate(node[2], env), evaluate(node[3], env)
        op = node[1]
        if op == "==":
            return a == b
        if op == "!=":
            return a != b
        return {"<": a < b, ">": a > b}[op] if op in "<>" else {"<=": a <= b, ">=": a >= b}[op]
    if kind == "in":
        return evaluate(node[1], env) in (evaluate(node[2], env) or ())
    if kind == "and":
        a = evaluate(node[1], env)
        return evaluate(node[2], env) if a else a
    if kind == "or":
        a = evaluate(node[1], env)
        return a if a else evaluate(node[2], env)
    if kind == "not":
        return not evaluate(node[1], env)
    if kind == "if":
        return evaluate(node[2] if evaluate(node[1], env) else node[3], env)
    if kind == "list":
        return [evaluate(x, env) for x in node[1]]
    if kind == "dict":
        return {evaluate(k, env): evaluate(v, env) for k, v in node[1]}
    if kind == "test":
        return _test(evaluate(node[1], env), node[2], [evaluate(v, env) for _, v in node[3]])
    if kind == "call":
        f = evaluate(node[1], env)
        if not callable(f):
            raise TemplateError("a value that is no function is called")
        return f(*[evaluate(v, env) for k, v in node[2] if k is None], **{k: evaluate(v, env) for k, v in node[2] if k})
    if kind == "filter":
        from .filters import FILTERS

        if node[2] not in FILTERS:
            raise TemplateError(f"unknown filter {node[2]!r}")
        return FILTERS[node[2]](evaluate(node[1], env), *[evaluate(v, env) for k, v in node[3] if k is None], **{k: evaluate(v, env) for k, v in node[3] if k})
    raise TemplateError(f"unknown node {kind!r}")


def _test(value: Any, name: str, args: list) -> bool:
    tests = {
        "defined": lambda: value is not UNDEFINED, "undefined": lambda: value is UNDEFINED, "none": lambda: value is None,
        "string": lambda: isinstance(value, str), "number": lambda: isinstance(value, (int, float)) and not isinstance(value, bool),
        "mapping": lambda: isinstance(value, dict), "sequence": lambda: isinstance(value, (list, str)), "iterable": lambda: isinstance(value, (list, str, dict)),
        "true": lambda: value is True, "false": lambda: value is False, "odd": lambda: value % 2 == 1, "even": lambda: value % 2 == 0,
        "boolean": lambda: isinstance(value, bool), "integer": lambda: isinstance(value, int) and not isinstance(value, bool),
        "divisibleby": lambda: value % args[0] == 0, "equalto": lambda: value == args[0],
    }
    if name not in tests:
        raise TemplateError(f"unknown test {name!r}")
    return bool(tests[name]())


def _raise(message: str = "") -> None:
    raise TemplateError(message)


FUNCTIONS = {"range": lambda *a: list(range(*a)), "dict": dict, "raise_exception": _raise, "random": random.random}


def run(statements: list, env: dict, out: list[str]) -> None:
    for s in statements:
        if s[0] == "text":
            out.append(s[1])
        elif s[0] == "out":
            out.append(text_of(evaluate(s[1], env)))
        elif s[0] == "set":
            env[s[1]] = evaluate(s[2], env)
        elif s[0] == "if":
            for cond, inside in s[1]:
                if evaluate(cond, env):
                    run(inside, env, out)
                    break
            else:
                run(s[2], env, out)
        else:
            items = evaluate(s[2], env)
            items = list(items) if items else []
            for k, item in enumerate(items):
                inner = {**env, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k + 1 == len(items), "length": len(items), "previtem": items[k - 1] if k else UNDEFINED, "nextitem": items[k + 1] if k + 1 < len(items) else UNDEFINED}}
                if len(s[1]) == 1:
                    inner[s[1][0]] = item
                else:
                    inner.update(zip(s[1], item))
                run(s[3], inner, out)
            if not items:
                run(s[4], env, out)


def render(template: str, env: dict) -> str:
    out: list[str] = []
    run(parse_template(template), dict(env), out)
    return "".join(out)
