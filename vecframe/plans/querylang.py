"""The query-string language: parsed into the filter tree that also renders into it."""

from __future__ import annotations

import math
import re

from vecframe.functions.geo import UNITS
from vecframe.plans.filters import Affix, Everything, Fuzzy, Group, Missing, Node, Not, Optional, Phrase, Radius, Range, Tag, Term

_BOUND = re.compile(r"\(?[+-]?(?:inf|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)$")


class QuerySyntaxError(ValueError):
    pass


class _Parser:
    """Alternatives bind looser than the implicit and; ``-``, ``~`` and a field name bind to the next unit."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, what: str) -> QuerySyntaxError:
        return QuerySyntaxError(f"{what} at {self.at} of {self.text!r}")

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def take(self, mark: str) -> bool:
        if self.peek() == mark:
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise self.fail(f"{mark} expected")

    def parse(self) -> Node:
        if not self.peek():
            raise self.fail("a query expected")
        node = self.alternatives(None)
        if self.peek():
            raise self.fail("the end expected")
        return node

    def alternatives(self, field: str | None) -> Node:
        parts = [self.sequence(field)]
        while self.take("|"):
            parts.append(self.sequence(field))
        return parts[0] if len(parts) == 1 else _flat(parts, False)

    def sequence(self, field: str | None) -> Node:
        parts = []
        while self.peek() not in ("", ")", "|"):
            parts.append(self.unit(field))
        if not parts:
            raise self.fail("a term expected")
        return parts[0] if len(parts) == 1 else _flat(parts, True)

    def unit(self, field: str | None) -> Node:
        c = self.peek()
        if self.take("-"):
            return Not(self.unit(field))
        if self.take("~"):
            return Optional(self.unit(field))
        if self.take("("):
            node = self.alternatives(field)
            self.need(")")
            return node
        if self.take("@"):
            return self.scoped()
        if self.text.startswith("ismissing(", self.at):
            end = self.text.find(")", self.at)
            name = self.text[self.at + len("ismissing(") : end].strip() if end > 0 else ""
            if not name.startswith("@") or len(name) < 2:
                raise self.fail("a field expected")
            self.at = end + 1
            return Missing(name[1:])
        if c == '"':
            return Phrase(field, self.quoted())
        if c == "%":
            return self.fuzzy(field)
        word = self.word("*")
        if word == [("*", True)]:
            return Everything()
        return self.term(field, word)

    def scoped(self) -> Node:
        start = self.at
        while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "_.$|-"):
            self.at += 1
        name = self.text[start : self.at]
        if not name:
            raise self.fail("a field name expected")
        self.need(":")
        c = self.peek()
        if c == "{":
            return self.tags(name)
        if c == "[":
            return self.numbers(name)
        return self.unit(name)

    def tags(self, name: str) -> Node:
        self.need("{")
        values, value = [], ""
        while True:
            if self.at >= len(self.text):
                raise self.fail("} expected")
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                value += self.text[self.at]
                self.at += 1
            elif c in "|}":
                if not value.strip():
                    raise self.fail("a tag expected")
                values.append(value.strip())
                value = ""
                if c == "}":
                    return Tag(name, tuple(values))
            else:
                value += c

    def numbers(self, name: str) -> Node:
        self.need("[")
        end = self.text.find("]", self.at)
        if end < 0:
            raise self.fail("] expected")
        parts = self.text[self.at : end].replace(",", " ").split()
        self.at = end + 1
        if len(parts) == 4 and parts[3] in UNITS:
            return Radius(name, *map(float, parts[:3]), parts[3])
        if len(parts) != 2 or not all(_BOUND.match(p) for p in parts):
            raise self.fail("two bounds or a place expected")
        low, high = (float(p.lstrip("(")) for p in parts)
        return Range(name, low, high, math.isinf(low) or parts[0][0] != "(", math.isinf(high) or parts[1][0] != "(")

    def quoted(self) -> str:
        self.need('"')
        out = ""
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                out += self.text[self.at]
                self.at += 1
            elif c == '"':
                return out
            else:
                out += c
        raise self.fail('" expected')

    def fuzzy(self, field: str | None) -> Node:
        n = 0
        while self.text[self.at : self.at + 1] == "%":
            n, self.at = n + 1, self.at + 1
        term = "".join(c for c, _ in self.word(""))
        if not 1 <= n <= 3 or self.text[self.at : self.at + n] != "%" * n:
            raise self.fail("one to three % on both sides expected")
        self.at += n
        return Fuzzy(field, term, n)

    def word(self, extra: str) -> list[tuple[str, bool]]:
        """Characters of a word and whether each one was bare, that is, not behind a backslash."""
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                out.append((self.text[self.at + 1], False))
                self.at += 2
            elif c.isalnum() or c == "_" or c in extra or (c in "'.," and out):
                out.append((c, True))
                self.at += 1
            elif c == "-" and out and self.text[self.at + 1 : self.at + 2].isalnum():
                out.append((c, True))
                self.at += 1
            else:
                break
        if not out:
            raise self.fail("a term expected")
        return out

    def term(self, field: str | None, word: list[tuple[str, bool]]) -> Node:
        star = ("*", True)
        first, last = word[0] == star, word[-1] == star
        if first or last:
            piece = "".join(c for c, _ in word[first : len(word) - last])
            if not piece:
                raise self.fail("a term expected")
            return Affix(field, piece, first, last)
        return Term(field, "".join(c for c, _ in word))


def _flat(parts: list[Node], all_: bool) -> Node:
    flat: list[Node] = []
    for p in parts:
        flat += p.children if isinstance(p, Group) and p.all == all_ else [p]
    return Group(tuple(flat), all_)


def parse(text: str) -> Node:
    return _Parser(text).parse()


def rank_terms(node: Node) -> list[str]:
    """The terms that a text query is ranked by: those of every part that is not negated."""
    if isinstance(node, Not):
        return []
    if isinstance(node, Group):
        return [t for x in node.children for t in rank_terms(x)]
    if isinstance(node, Optional):
        return rank_terms(node.child)
    if isinstance(node, Term):
        return [node.term]
    if isinstance(node, Phrase):
        return [node.phrase]
    return []
