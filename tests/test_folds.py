"""Lines of word boxes against a plain fold, from word rows and from pages that hold their words."""

from __future__ import annotations

import random

import pytest

from lexweave.operators import folds


def plain(words, tolerance, columns):
    """``(page, col, line, x0, text)``, one word after the other."""
    out, pages = [], {}
    for page, x0, top, text in words:
        pages.setdefault((page, int(columns and not x0 < folds.GUTTER)), []).append((top, x0, text))
    for (page, col), rows in pages.items():
        lines = []
        for top, x0, text in sorted(rows):
            if not lines or top - lines[-1][0][0] > tolerance:
                lines.append([])
            lines[-1].append((top, x0, text))
        for n, line in enumerate(lines):
            line.sort(key=lambda w: (w[1], w[0]))
            out.append((page, col, n, line[0][1], " ".join(w[2] for w in line)))
    return sorted(out, key=repr)


def made(seed=3):
    r = random.Random(seed)
    sizes = [(p, 0 if p == 3 else r.choice((1, 5, 60, 300))) for p in [*range(40), None]]
    words = [(p, r.uniform(0, 600), r.choice((1.0, 0.4, 12.0)) * r.randrange(60) + r.random(), f"w{p}.{i}") for p, n in sizes for i in range(n)]
    r.shuffle(words)
    return words


@pytest.mark.parametrize("tolerance", [0.0, 2.0, 9.0])
@pytest.mark.parametrize("columns", [False, True])
@pytest.mark.parametrize("pages", [3, 256])
def test_lines_against_plain_fold(spark, monkeypatch, tolerance, columns, pages):
    """Lines whose words follow each other within the tolerance and reach beyond it included."""
    monkeypatch.setattr(folds, "PAGES", pages)
    words = made()
    rows = spark.createDataFrame(words, "page int, x0 double, top double, text string").repartition(5)
    gutter = folds.GUTTER if columns else None
    for given in (rows, folds.gathered(rows)):
        assert sorted(map(tuple, folds._folded(given, tolerance, gutter).collect()), key=repr) == plain(words, tolerance, columns)


def test_pages_with_their_words(spark):
    """Pages are folded where they are: nothing is shuffled, no Python group is made of each."""
    kind = "page int, words array<struct<x0:double,top:double,text:string>>"
    d = spark.createDataFrame([(1, [(20.0, 1.0, "a"), (300.0, 1.0, "b"), (10.0, 2.0, "c")]), (2, []), (3, None), (1, [(20.0, 1.0, "x")])], kind)
    lines = folds.column_lines(d, bases=(10.0, 300.0))
    assert sorted(tuple(r) for r in lines.collect()) == [(1, 0, 0, "c a", 0), (1, 0, 0, "x", 1), (1, 1, 0, "b", 0)]
    plan = lines._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan
    assert folds.visual_lines(d.limit(0)).count() == 0
