"""The Boolean query language: lexer, parser, explanation, positive terms.

A query is a literal, so all of this runs on the driver; ``lexweave.operators.search`` turns
the tree into Column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Literal

from lexweave.functions.text import normalize_value, tokenize_value


class QuerySyntaxError(ValueError):
    """The query cannot be read; nothing has been planned yet."""


@dataclass(frozen=True)
class Term:
    value: str
    kind: Literal["term", "prefix", "phrase"] = "term"

    @property
    def tokens(self) -> list[str]:
        return tokenize_value(self.value)


@dataclass(frozen=True)
class Not:
    child: Node


@dataclass(frozen=True)
class Near:
    left: Term
    right: Term
    distance: int


@dataclass(frozen=True)
class Both:
    left: Node
    right: Node


@dataclass(frozen=True)
class Either:
    left: Node
    right: Node


Node = Term | Not | Near | Both | Either


@dataclass(frozen=True)
class Query:
    """A parsed query: its tree, the distinct terms that count for ranking, its plain form."""

    root: Node
    positives: tuple[Term, ...]

    @property
    def explanation(self) -> str:
        return explain(self.root)

    def within(self, other: Query) -> Query:
        """Both queries at once, ranked by the terms of both."""
        return Query(Both(self.root, other.root), tuple(dict.fromkeys(self.positives + other.positives)))


_LEXEME = re.compile(r'\s+|(?P<open>\()|(?P<close>\))|"(?P<quoted>(?:\\["\\]|[^"])*)(?P<end>"?)|(?P<bare>[^\s()"]+)')


def _lex(text: str) -> list[tuple[str, object]]:
    out: list[tuple[str, object]] = []
    for m in _LEXEME.finditer(text):
        if m["open"]:
            out.append(("(", None))
        elif m["close"]:
            out.append((")", None))
        elif m["quoted"] is not None:
            if not m["end"]:
                raise QuerySyntaxError("Boolean search has an unclosed quoted phrase.")
            value = normalize_value(re.sub(r'\\(["\\])', r"\1", m["quoted"]))
            if not value:
                raise QuerySyntaxError("Boolean search phrases cannot be empty.")
            out.append(("TERM", Term(value, "phrase")))
        elif m["bare"]:
            out += _bare(m["bare"])
    return out


def _bare(raw: str) -> list[tuple[str, object]]:
    upper = raw.upper()
    if near := re.fullmatch(r"NEAR/([0-9]+)", upper):
        distance = int(near[1])
        if not 1 <= distance <= 100:
            raise QuerySyntaxError("NEAR proximity must be between 1 and 100 words.")
        return [("NEAR", distance)]
    if upper in ("AND", "OR", "NOT"):
        return [(upper, None)]
    stem, star, rest = raw.partition("*")
    if star and (rest or not stem):
        raise QuerySyntaxError("Wildcards are supported only as one trailing asterisk, such as tax*.")
    value = normalize_value(stem)
    return [("TERM", Term(value, "prefix" if star else "term"))] if value else []


class _Parser:
    """Precedence climbing; a missing operator between two operands means AND."""

    def __init__(self, lexemes: list[tuple[str, object]]):
        self.rest = lexemes[::-1]

    def next_is(self, *kinds: str) -> bool:
        return bool(self.rest) and self.rest[-1][0] in kinds

    def either(self) -> Node:
        node = self.both()
        while self.next_is("OR"):
            self.rest.pop()
            node = Either(node, self.both())
        return node

    def both(self) -> Node:
        node = self.near()
        while self.next_is("AND", "TERM", "(", "NOT"):
            if self.next_is("AND"):
                self.rest.pop()
            node = Both(node, self.near())
        return node

    def near(self) -> Node:
        node = self.negation()
        while self.next_is("NEAR"):
            distance = self.rest.pop()[1]
            right = self.negation()
            if not isinstance(node, Term) or not isinstance(right, Term):
                raise QuerySyntaxError("NEAR/n requires a word, prefix, or quoted phrase on each side.")
            node = Near(node, right, distance)
        return node

    def negation(self) -> Node:
        if self.next_is("NOT"):
            self.rest.pop()
            return Not(self.negation())
        return self.operand()

    def operand(self) -> Node:
        if not self.rest:
            raise QuerySyntaxError("Boolean search is missing a term.")
        kind, value = self.rest.pop()
        if kind == "TERM":
            return value
        if kind == "(":
            node = self.either()
            if not self.next_is(")"):
                raise QuerySyntaxError("Boolean search has an unclosed parenthesis.")
            self.rest.pop()
            return node
        raise QuerySyntaxError(f"Boolean search expected a term near {({')': 'RPAREN'}).get(kind, kind)}.")


def parse(text: str | None) -> Query:
    """Reads a query or raises ``QuerySyntaxError``."""
    lexemes = _lex(text or "")
    if not lexemes:
        raise QuerySyntaxError("Enter a search term.")
    parser = _Parser(lexemes)
    root = parser.either()
    if parser.next_is(")"):
        raise QuerySyntaxError("Boolean search has an unmatched closing parenthesis.")
    if parser.rest:
        raise QuerySyntaxError(f"Boolean search could not interpret {parser.rest[-1][0]}.")
    return Query(root, tuple(dict.fromkeys(_positives(root, True))))


def _positives(node: Node, wanted: bool) -> list[Term]:
    if isinstance(node, Term):
        return [node] if wanted else []
    if isinstance(node, Not):
        return _positives(node.child, not wanted)
    return _positives(node.left, wanted) + _positives(node.right, wanted)


_RANK = {Either: 1, Both: 2, Near: 3, Not: 4, Term: 5}


def explain(node: Node, outer: int = 0) -> str:
    """The query with explicit operators and no more parentheses than needed."""
    rank = _RANK[type(node)]
    if isinstance(node, Term):
        text = f'"{node.value}"' if node.kind == "phrase" else node.value + "*" * (node.kind == "prefix")
    elif isinstance(node, Not):
        text = f"NOT {explain(node.child, rank)}"
    else:
        word = f"NEAR/{node.distance}" if isinstance(node, Near) else "AND" if isinstance(node, Both) else "OR"
        text = f"{explain(node.left, rank)} {word} {explain(node.right, rank)}"
    return f"({text})" if rank < outer else text


@dataclass(frozen=True)
class Options:
    """Search options; values that are not known fall back to their defaults."""

    field: str = "statute"
    sort: str = "relevance"
    chapter: str | None = None
    status: str | None = None
    supplement: str | None = None
    within: str | None = None

    def normalized(self) -> Options:
        return replace(
            self,
            field=self.field if self.field in ("statute", "all", *FIELDS) else "statute",
            sort=self.sort if self.sort in ("relevance", "citation") else "relevance",
            status=self.status if self.status in STATUSES else None,
            supplement=self.supplement if self.supplement in ("updated", "base") else None,
            within=(self.within or "").strip() or None,
        )


FIELDS = ("citation", "heading", "body", "history", "annotations")
STATUSES = ("active", "mixed", "obsolete", "repealed", "reserved", "transferred")
