"""The expression language of APPLY steps, translated into columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecframe.functions import geo

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|@(?P<ref>[\w.$]+)|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||[<>=!]=|[-+*/%^<>!(),]))")
_LEVELS = [["||"], ["&&"], ["==", "!=", "<", "<=", ">", ">="], ["+", "-"], ["*", "/", "%"]]


def _num(c: Column) -> Column:
    return c.try_cast("double")


def _seconds(c: Column) -> Column:
    return F.timestamp_seconds(_num(c))


def _floor_to(unit: str) -> Callable[..., Column]:
    return lambda t: F.unix_timestamp(F.date_trunc(unit, _seconds(t))).cast("double")


def _format(fmt: Column, *args: Column) -> Column:
    return F.concat_ws("", F.lit("")) if fmt is None else F.format_string(_text_of(fmt), *[a.cast("string") for a in args])


def _text_of(c: Column) -> str:
    value = getattr(c, "_vecframe_text", None)
    if value is None:
        raise ValueError("a constant text is needed here")
    return value


# Letters of C's time formats in Java's.
_TIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%Z": "'UTC'"}


def _java_time(fmt: str) -> str:
    return re.sub(r"%[A-Za-z]|[A-Za-z]+", lambda m: _TIME.get(m[0], f"'{m[0]}'"), fmt)


def _split(s: Column, seps: Column | None = None, strip: Column | None = None) -> Column:
    marks = _text_of(seps) if seps is not None else ","
    trim = _text_of(strip) if strip is not None else " "
    parts = F.split(s.cast("string"), "[" + re.escape(marks) + "]")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(trim))), lambda x: x != "")))


def _count_of(s: Column, part: Column) -> Column:
    size = F.length(part)
    return F.when(size == 0, F.length(s) + 1).otherwise((F.length(s) - F.length(F.replace(s, part, F.lit("")))) / size).cast("double")


def _geo(*a: Column) -> Column:
    if len(a) == 2:
        return geo.metres(*geo.lon_lat(a[0]), *geo.lon_lat(a[1]))
    if len(a) == 3:
        return geo.metres(*geo.lon_lat(a[0]), _num(a[1]), _num(a[2]))
    return geo.metres(*map(_num, a))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": lambda x: F.abs(_num(x)),
    "ceil": lambda x: F.ceil(_num(x)).cast("double"),
    "floor": lambda x: F.floor(_num(x)).cast("double"),
    "sqrt": lambda x: F.sqrt(_num(x)),
    "exp": lambda x: F.exp(_num(x)),
    "log": lambda x: F.ln(_num(x)),
    "log2": lambda x: F.log2(_num(x)),
    "pow": lambda x, y: F.pow(_num(x), _num(y)),
    "upper": F.upper,
    "lower": F.lower,
    "startswith": lambda s, p: s.startswith(p).cast("double"),
    "contains": _count_of,
    "strlen": lambda s: F.length(s).cast("double"),
    "substr": lambda s, at, n: F.substring(s, at.cast("int") + F.when(at >= 0, 1).otherwise(0), F.when(n < 0, F.greatest(F.length(s) - at + n, F.lit(0))).otherwise(n).cast("int")),
    "format": _format,
    "split": _split,
    "timefmt": lambda t, fmt=None: F.date_format(_seconds(t), _java_time(_text_of(fmt) if fmt is not None else "%FT%TZ")),
    "parsetime": lambda s, fmt: F.unix_timestamp(F.try_to_timestamp(s, F.lit(_java_time(_text_of(fmt))))).cast("double"),
    "day": _floor_to("day"),
    "hour": _floor_to("hour"),
    "minute": _floor_to("minute"),
    "month": _floor_to("month"),
    "dayofweek": lambda t: (F.dayofweek(_seconds(t)) - 1).cast("double"),
    "dayofmonth": lambda t: F.dayofmonth(_seconds(t)).cast("double"),
    "dayofyear": lambda t: (F.dayofyear(_seconds(t)) - 1).cast("double"),
    "year": lambda t: F.year(_seconds(t)).cast("double"),
    "monthofyear": lambda t: (F.month(_seconds(t)) - 1).cast("double"),
    "geodistance": _geo,
    "exists": lambda x: x.isNotNull().cast("double"),
    "case": lambda c, a, b: F.when(_truth(c), a).otherwise(b),
}


def _truth(c: Column) -> Column:
    return F.coalesce(_num(c) != 0, F.lit(False))


class ExpressionError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str, resolve: Callable[[str], Column]) -> None:
        self.resolve = resolve
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def next(self, *marks: str) -> str | None:
        kind, value = self.tokens[self.at]
        if kind == "op" and value in marks:
            self.at += 1
            return value
        return None

    def parse(self) -> Column:
        out = self.level(0)
        if self.tokens[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def level(self, i: int) -> Column:
        if i == len(_LEVELS):
            return self.unary()
        out = self.level(i + 1)
        while op := self.next(*_LEVELS[i]):
            out = self.apply(op, out, self.level(i + 1))
        return out

    @staticmethod
    def apply(op: str, a: Column, b: Column) -> Column:
        if op in ("&&", "||"):
            return ((_truth(a) & _truth(b)) if op == "&&" else (_truth(a) | _truth(b))).cast("double")
        if op in ("==", "!="):
            same = F.coalesce(_num(a) == _num(b), a.cast("string") == b.cast("string"))
            return (same if op == "==" else ~same).cast("double")
        if op in ("<", "<=", ">", ">="):
            x, y = _num(a), _num(b)
            less = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return less.cast("double")
        x, y = _num(a), _num(b)
        return {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[op]

    def unary(self) -> Column:
        if self.next("-"):
            return -_num(self.unary())
        if self.next("!"):
            return (~_truth(self.unary())).cast("double")
        base = self.primary()
        return F.pow(_num(base), _num(self.unary())) if self.next("^") else base

    def primary(self) -> Column:
        if self.next("("):
            out = self.level(0)
            if not self.next(")"):
                raise ExpressionError(") expected")
            return out
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return F.lit(float(value))
        if kind == "str":
            plain = re.sub(r"\\(.)", r"\1", value[1:-1])
            out = F.lit(plain)
            out._vecframe_text = plain
            return out
        if kind == "ref":
            return self.resolve(value)
        if kind == "name":
            f = FUNCTIONS.get(value.lower())
            if f is None:
                raise ExpressionError(f"unknown function: {value}")
            args: list[Column] = []
            if not self.next("("):
                raise ExpressionError("( expected")
            while not self.next(")"):
                if args and not self.next(","):
                    raise ExpressionError(", expected")
                args.append(self.level(0))
            try:
                return f(*args)
            except TypeError as e:
                raise ExpressionError(f"{value}: {e}") from None
        raise ExpressionError(f"unexpected {value!r}")


def expression(text: str, resolve: Callable[[str], Column]) -> Column:
    """The column of an expression such as ``@year - (@year % 10)``; arithmetic is in doubles, what can't be computed is null."""
    return _Parser(text, resolve).parse()
