"""The query language."""

from __future__ import annotations

import pytest

from lexweave.functions.query import Options, QuerySyntaxError, parse


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("tax income", "tax AND income"), ("a or b and c", "a OR b AND c"), ("(a OR b) c*", "(a OR b) AND c*"), ('"Real  Estate" not x', '"real estate" AND NOT x'),
        ("a § b", "a AND b"), ("not not a", "NOT NOT a"), ("(a) near/2 b", "a NEAR/2 b"), ("near far", "near AND far"), ('"\\"q\\" \\\\"', '"q"'), ("Éa", "ea"),
    ],
)
def test_explain(text, plain):
    assert parse(text).explanation == plain


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("", "Enter a search term"), ("§", "Enter a search term"), ('"a', "unclosed quoted"), ('""', "cannot be empty"), ("a NOT §", "missing a term"), ("(a", "unclosed parenthesis"),
        ("a)", "unmatched closing"), ("a*b", "trailing asterisk"), ("*", "trailing asterisk"), ("a NEAR/0 b", "between 1 and 100"), ("a NEAR/2 (b OR c)", "requires a word"),
        ("a NEAR/1 b NEAR/1 c", "requires a word"), ("AND a", "expected a term near AND"), ("a OR", "missing a term"),
    ],
)
def test_errors(text, message):
    with pytest.raises(QuerySyntaxError, match=message):
        parse(text)


def test_positive_terms_and_options():
    q = parse('a NOT b NOT (NOT c) "a" a d NEAR/2 e*')
    assert [(t.kind, t.value) for t in q.positives] == [("term", "a"), ("term", "c"), ("phrase", "a"), ("term", "d"), ("prefix", "e")]
    o = Options(field="x", sort="y", status="z", supplement="w", within=" ").normalized()
    assert o == Options()
