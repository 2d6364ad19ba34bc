"""Expressions and loop-free templates as Spark columns.

What compiles stays in the JVM, with pushdown and code generation; what doesn't raises NotNative, and the caller runs it in an Arrow UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jinja
from .filters import jstr_column

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class NotNative(Exception):
    """An expression that has no Spark form."""


class Compiler:
    """Compiles against the native columns of a DataFrame; `dynamic` names hold JSON text and never compile."""

    def __init__(self, df: DataFrame, dynamic: set[str] = frozenset()):
        self.df, self.dynamic = df, dynamic
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType

    def expression(self, text: str) -> Column:
        return self.node(jinja.parse_expression(text))

    def node(self, n: tuple) -> Column:
        kind = n[0]
        if kind == "lit":
            if n[1] is jinja.UNDEFINED:
                raise NotNative("undefined")
            return F.lit(n[1])
        if kind == "name":
            if n[1] in self.dynamic or n[1] not in self.types:
                raise NotNative(n[1])
            return F.col(f"`{n[1]}`")
        if kind == "item":
            base = self.node(n[1])
            t = self.type_of(base)
            if n[2][0] != "lit":
                raise NotNative("computed key")
            key = n[2][1]
            if isinstance(t, T.StructType) and key in t.names:
                return base.getField(key)
            if isinstance(t, T.ArrayType) and isinstance(key, int):
                return F.get(base, F.lit(key)) if key >= 0 else F.try_element_at(base, F.lit(key))
            if isinstance(t, T.MapType):
                return F.try_element_at(base, F.lit(key))
            raise NotNative(f"{key!r} of {t.simpleString()}")
        if kind == "bin":
            return self.binary(n[1], self.node(n[2]), self.node(n[3]))
        if kind == "neg":
            return -self.numeric(self.node(n[1]))
        if kind == "cmp":
            a, b = self.node(n[2]), self.node(n[3])
            ta, tb = self.type_of(a), self.type_of(b)
            if isinstance(ta, _NUMERIC) != isinstance(tb, _NUMERIC) and not isinstance(ta, T.NullType) and not isinstance(tb, T.NullType):
                raise NotNative("comparison of unlike types")
            if n[1] == "==":
                return a.eqNullSafe(b)
            if n[1] == "!=":
                return ~a.eqNullSafe(b)
            return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[n[1]]
        if kind == "in":
            if n[2][0] == "list":
                return F.coalesce(self.node(n[1]).isin([self.literal(x) for x in n[2][1]]), F.lit(False))
            a, b = self.node(n[1]), self.node(n[2])
            t = self.type_of(b)
            if isinstance(t, T.ArrayType):
                return F.coalesce(F.array_contains(b, a), F.lit(False))
            if isinstance(t, T.StringType):
                return F.coalesce(F.contains(b, a), F.lit(False))
            raise NotNative("in")
        if kind in ("and", "or"):
            a, b = self.boolean(self.node(n[1])), self.boolean(self.node(n[2]))
            return a & b if kind == "and" else a | b
        if kind == "not":
            return ~F.coalesce(self.boolean(self.node(n[1])), F.lit(False))
        if kind == "if":
            a, b = self.node(n[2]), self.node(n[3])
            if self.type_of(a) != self.type_of(b):
                raise NotNative("branches of unlike types")
            return F.when(self.boolean(self.node(n[1])), a).otherwise(b)
        if kind == "test" and n[2] in ("none", "defined"):
            c = self.node(n[1])
            return c.isNull() if n[2] == "none" else F.lit(True)
        if kind == "filter":
            return self.filter(self.node(n[1]), n[2], [v for _, v in n[3]])
        raise NotNative(kind)

    def literal(self, n: tuple):
        if n[0] != "lit":
            raise NotNative("computed list")
        return n[1]

    def numeric(self, c: Column) -> Column:
        if not isinstance(self.type_of(c), _NUMERIC):
            raise NotNative("number expected")
        return c

    def boolean(self, c: Column) -> Column:
        if not isinstance(self.type_of(c), T.BooleanType):
            raise NotNative("truth of another type")
        return c

    def binary(self, op: str, a: Column, b: Column) -> Column:
        ta, tb = self.type_of(a), self.type_of(b)
        if op == "~":
            return F.concat(self.text(a), self.text(b))
        if op == "+" and isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
            return F.concat(a, b)
        self.numeric(a), self.numeric(b)
        if op == "/":
            return F.try_divide(a.cast("double"), b.cast("double"))
        if op == "//":
            q = F.floor(F.try_divide(a.cast("double"), b.cast("double"))) if not (isinstance(ta, _WHOLE) and isinstance(tb, _WHOLE)) else F.floor(F.try_divide(a.cast("decimal(20,0)"), b.cast("decimal(20,0)"))).cast("long")
            return q if isinstance(ta, _WHOLE) and isinstance(tb, _WHOLE) else q.cast("double")
        if op == "%":
            return F.pmod(a, b)
        if op == "**":
            return F.pow(a, b)
        return {"+": a + b, "-": a - b, "*": a * b}[op]

    def text(self, c: Column) -> Column:
        """A value as templates print it."""
        t = self.type_of(c)
        if isinstance(t, T.StringType):
            return F.coalesce(c, F.lit("none"))
        if isinstance(t, (*_WHOLE, T.BooleanType)):
            return F.coalesce(c.cast("string"), F.lit("none"))
        raise NotNative(f"text of {t.simpleString()}")

    def filter(self, c: Column, name: str, args: list) -> Column:
        t = self.type_of(c)
        text = isinstance(t, T.StringType)
        if name == "jstr":
            return jstr_column(self.text(c))
        if name == "tool_call_args" and text:
            s = jstr_column(self.text(c))
            return F.substring(s, F.lit(2), F.length(s) - 2)
        if name == "tojson" and isinstance(t, (*_WHOLE, T.BooleanType)):
            return F.coalesce(c.cast("string"), F.lit("null"))
        if name == "upper" and text:
            return F.upper(c)
        if name == "lower" and text:
            return F.lower(c)
        if name == "trim" and text:
            return F.trim(c)
        if name in ("length", "count"):
            return F.length(c) if text else F.size(c) if isinstance(t, (T.ArrayType, T.MapType)) else self._no(name)
        if name == "string":
            return self.text(c)
        if name == "abs":
            return F.abs(self.numeric(c))
        if name == "replace" and text:
            return F.replace(c, F.lit(self.literal(args[0])), F.lit(self.literal(args[1])))
        if name == "join" and isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
            return F.array_join(c, self.literal(args[0]) if args else "")
        if name in ("first", "last") and isinstance(t, T.ArrayType):
            return F.try_element_at(c, F.lit(1 if name == "first" else -1))
        return self._no(name)

    def _no(self, name: str) -> Column:
        raise NotNative(f"filter {name}")

    def template(self, source: str) -> Column:
        """A template without loops and assignments, as one concatenation."""
        return self._body(jinja.parse_template(source))

    def _body(self, statements: list) -> Column:
        parts = []
        for s in statements:
            if s[0] == "text":
                parts.append(F.lit(s[1]))
            elif s[0] == "out":
                parts.append(self.text(self.node(s[1])))
            elif s[0] == "if":
                c = self._body(s[2])
                for cond, inside in reversed(s[1]):
                    c = F.when(F.coalesce(self.boolean(self.node(cond)), F.lit(False)), self._body(inside)).otherwise(c)
                parts.append(c)
            else:
                raise NotNative(s[0])
        return F.concat(*parts) if parts else F.lit("")
