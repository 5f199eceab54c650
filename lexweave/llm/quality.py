"""Weak supervision for document quality.

Rules look at statistics of a text and vote good (1), bad (-1) or abstain (0). Their vote
patterns are counted over all documents: with R rules there are at most 3^R patterns however
large the corpus is, so expectation-maximisation runs on that table. It estimates how often each
rule is right when it votes; the posterior of a document's pattern replaces the rule that
everything must pass. Rows never leave
DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import checkpointed, stored

#: Word separators: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Prefix of the columns that this operator works in; a name of the input never clashes.
_P = "__quality_"


@dataclass(frozen=True)
class QualityParams:
    """Thresholds of the rules and of EM."""

    min_words: int = 50
    max_repeat_percent: int = 50
    iterations: int = 50
    smoothing: float = 1.0
    threshold: float = 0.5


#: Only the posterior decides; the base of the query's contract stays out.
POSTERIOR_ONLY = QualityParams(min_words=0, max_repeat_percent=100)


def _c(name: str) -> Column:
    return F.col(_P + name)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of the text under prefixed names.

    A null text has no words. Repeats are found on 64-bit hashes of word triples, sorted with
    their positions inside the row; the text is never exploded, so nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn(_P + "words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    d = d.withColumns(
        {
            _P + "n_words": F.size(_c("words")).cast("long"),
            _P + "word_chars": F.length(F.array_join(_c("words"), "")).cast("long"),
            _P + "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            _P + "n_shouts": F.regexp_count(text, F.lit("[\\p{Lu}]{2,}")).cast("long"),
            _P + "n_bangs": F.regexp_count(text, F.lit("[!?]{2,}")).cast("long"),
            _P + "n_stops": F.regexp_count(text, F.lit("[.!?\u3002\uff01\uff1f\u0964\u061f]")).cast("long"),
            _P + "n_distinct": F.size(F.array_distinct(_c("words"))).cast("long"),
            _P + "lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0),
            _P + "triples": F.when(F.size(_c("words")) < 3, F.array().cast("array<bigint>")).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.size(_c("words")) - 3),
                    lambda i: F.xxhash64(F.get(_c("words"), i), F.get(_c("words"), i + 1), F.get(_c("words"), i + 2)),
                )
            ),
        }
    )
    d = d.withColumns(
        {
            _P + "n_dup_lines": (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long"),
            # sorted (hash, position) pairs, only where some triple occurs twice
            _P + "sorted": F.when(
                F.size(F.array_distinct(_c("triples"))) < F.size(_c("triples")),
                F.array_sort(F.transform(_c("triples"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        }
    )
    d = d.withColumn(
        _P + "starts",
        F.array_sort(
            F.transform(
                F.filter(
                    _c("sorted"),
                    lambda x, k: (F.get(_c("sorted"), k - 1)["h"] == x["h"]) | (F.get(_c("sorted"), k + 1)["h"] == x["h"]),
                ),
                lambda x: x["i"],
            )
        ),
    )
    covered = F.aggregate(
        _c("starts"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n"), (i + 3).alias("end")),
        lambda s: s["n"].cast("long"),
    )
    names = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_bangs", "n_stops", "n_distinct", "n_dup_lines")
    # the generator keeps the optimizer from putting these expressions into later filters,
    # where each use would evaluate them again
    packed = F.struct(*(_c(x).alias(x) for x in names), covered.alias("n_repeat_words"))
    d = d.select(*(F.col(f"`{x}`") for x in docs.columns), F.explode_outer(F.array(packed)).alias(_P + "s"))
    return d.select(*(F.col(f"`{x}`") for x in docs.columns), *(_c("s")[x].alias(_P + x) for x in (*names, "n_repeat_words")))


def rules() -> dict[str, Column]:
    """Each rule's vote from the statistics: detectors of junk vote bad or abstain, signs of
    prose vote good or abstain."""
    n = F.greatest(_c("n_words"), F.lit(1)).cast("double")

    def bad(when: Column) -> Column:
        return F.when(when, F.lit(-1)).otherwise(F.lit(0))

    def good(when: Column) -> Column:
        return F.when(when, F.lit(1)).otherwise(F.lit(0))

    word, symbols, shouts, bangs = _c("word_chars") / n, _c("n_symbols") / n, _c("n_shouts") / n, _c("n_bangs") / n
    repeats, lines, distinct, stops = _c("n_repeat_words") / n, _c("n_dup_lines"), _c("n_distinct") / n, _c("n_stops") / n
    return {
        "short": bad(n < 50),
        "word_length": bad((word < 1.8) | (word > 40)),
        "symbols": bad(symbols >= 0.25),
        "shouting": bad(shouts >= 0.4),
        "bangs": bad(bangs >= 0.25),
        "repeats": bad(repeats >= 0.4),
        "lines": bad(lines >= F.greatest(F.lit(3.0), n / 40)),
        "sentences": good((stops >= 0.01) & (stops <= 0.5) & (bangs < 0.1)),
        # long texts use their words again: the share falls with the root of the length
        "vocabulary": good((distinct >= 0.25 * F.least(F.lit(1.0), F.sqrt(2000 / n))) & (symbols < 0.1)),
        "plain": good((symbols < 0.1) & (shouts < 0.2) & (bangs < 0.1) & (repeats < 0.3)),
    }


def _pattern() -> Column:
    """The votes as one number in base 3."""
    code = F.lit(0)
    for v in rules().values():
        code = code * 3 + (v + 1)
    return code.cast("int")


def vote_counts(scored: DataFrame) -> DataFrame:
    """Documents per vote pattern: ``pattern, n``, at most 3^R rows."""
    return scored.groupBy(_c("pattern").alias("pattern")).agg(F.count("*").alias("n"))


def _votes(pattern: int, n_rules: int) -> list[int]:
    out = []
    for _ in range(n_rules):
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


def estimate(counts: dict[int, int], n_rules: int, p: QualityParams) -> dict[int, float]:
    """EM over pattern counts; the posterior probability of "good" for each pattern.

    Each rule has two chances to vote, one for each class, so that a rule which votes for
    nearly everything has little to say; their ratio is its accuracy. The start is the share
    of good votes among a pattern's votes, one more of each kind, so that no rule decides alone.
    Smoothing keeps chances off 0 and 1.
    """
    patterns = sorted(counts)
    votes = {x: _votes(x, n_rules) for x in patterns}
    post = {x: (votes[x].count(2) + 1) / (len(votes[x]) - votes[x].count(1) + 2) for x in patterns}
    total = sum(counts.values())
    for _ in range(p.iterations):
        good = sum(counts[x] * post[x] for x in patterns)
        hits = [[sum(counts[x] * post[x] for x in patterns if votes[x][j] != 1), sum(counts[x] * (1 - post[x]) for x in patterns if votes[x][j] != 1)] for j in range(n_rules)]
        chance = [[(h + p.smoothing) / (mass + 2 * p.smoothing) for h, mass in zip(own, (good, total - good), strict=True)] for own in hits]
        odds = math.log((good + p.smoothing) / (total - good + p.smoothing))
        for x in patterns:
            score = odds
            for v, (a, b) in zip(votes[x], chance, strict=True):
                score += math.log(a / b) if v != 1 else math.log((1 - a) / (1 - b))
            post[x] = 1 / (1 + math.exp(-max(-60.0, min(60.0, score))))
    return post


def score(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """``docs`` with statistics, ``base_failed``, ``posterior`` and ``kept`` (prefixed names).

    Rows and statistics are written to the shared folder, so that they are computed once.
    """
    d = stored(with_statistics(docs).withColumn(_P + "pattern", _pattern()), "quality")
    return _judged(d, params)


def _judged(d: DataFrame, params: QualityParams) -> DataFrame:
    """Posterior and verdict of rows with statistics and pattern."""
    counts = {r["pattern"]: r["n"] for r in vote_counts(d).collect()}  # at most 3^R rows
    post = estimate(counts, len(rules()), params)
    table = F.create_map(*(F.lit(v) for x in sorted(post.items()) for v in x)) if post else F.create_map().cast("map<int,double>")
    failed = (_c("n_words") < params.min_words) | (100 * _c("n_repeat_words") > params.max_repeat_percent * _c("n_words"))
    d = d.withColumns({_P + "base_failed": failed, _P + "posterior": F.element_at(table, _c("pattern"))})
    return d.withColumn(_P + "kept", ~_c("base_failed") & (_c("posterior") >= params.threshold))


def quality_rules(docs: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """One row per document: statistics, base verdict, posterior and verdict.

    Null and empty texts have no words and fail the base; a null doc_id stays null; repeated
    rows repeat and count as often; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    d = checkpointed(with_statistics(docs.select("doc_id", "text")).withColumn(_P + "pattern", _pattern()).drop("text"))
    d = _judged(d, params)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return d.select("doc_id", *((F.round(_c(x), 6) if x == "posterior" else _c(x)).alias(x) for x in names))


def oracle(p: QualityParams = QualityParams()) -> str:
    """The same in DuckDB SQL: statistics by unnesting, votes as masks, EM as a recursion over
    one row that holds the posteriors of all patterns."""
    n = "greatest(n_words, 1)"
    votes = [  # (votes when, good or bad)
        ("n_words < 50", "bad"), (f"word_chars / {n} < 1.8 OR word_chars / {n} > 40", "bad"), (f"n_symbols / {n} >= 0.25", "bad"), (f"n_shouts / {n} >= 0.4", "bad"),
        (f"n_bangs / {n} >= 0.25", "bad"), (f"n_repeat_words / {n} >= 0.4", "bad"), (f"n_dup_lines >= greatest(3.0, {n} / 40)", "bad"),
        (f"n_stops / {n} BETWEEN 0.01 AND 0.5 AND n_bangs / {n} < 0.1", "good"),
        (f"n_distinct / {n} >= 0.25 * least(1.0, sqrt(2000 / {n}::DOUBLE)) AND n_symbols / {n} < 0.1", "good"),
        (f"n_symbols / {n} < 0.1 AND n_shouts / {n} < 0.2 AND n_bangs / {n} < 0.1 AND n_repeat_words / {n} < 0.3", "good"),
    ]
    mask = ", ".join(f"CASE WHEN {when} THEN 1 ELSE 0 END" for when, _ in votes)
    cast = lambda want: " + ".join(f"v[{j + 1}]" for j, (_, kind) in enumerate(votes) if kind == want)
    start = f"({cast('good')} + 1) / ({cast('good')} + {cast('bad')} + 2)::DOUBLE"
    rules = range(1, len(votes) + 1)
    s = f"{p.smoothing}::DOUBLE"
    hit = lambda j, x: f"list_sum(list_transform(range(1, len(ns) + 1), lambda i: ns[i] * vs[i][{j}] * ({x})))"
    a = ", ".join(f"({hit(j, 'post[i]')} + {s}) / (good + {2 * p.smoothing}::DOUBLE)" for j in rules)
    b = ", ".join(f"({hit(j, '1 - post[i]')} + {s}) / (total - good + {2 * p.smoothing}::DOUBLE)" for j in rules)
    total = " + ".join(f"CASE WHEN vs[i][{j}] = 1 THEN ln(a[{j}] / b[{j}]) ELSE ln((1 - a[{j}]) / (1 - b[{j}])) END" for j in rules)
    return f"""WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), tri AS (SELECT r, i, list_extract(ws, i) AS x, list_extract(ws, i + 1) AS y, list_extract(ws, i + 2) AS z FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), rep AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, x, y, z) > 1
), cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r
), stats AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(regexp_extract_all(t, '\\p{{Lu}}{{2,}}')) AS n_shouts, len(regexp_extract_all(t, '[!?]{{2,}}')) AS n_bangs, len(regexp_extract_all(t, '[.!?\u3002\uff01\uff1f\u0964\u061f]')) AS n_stops, len(list_distinct(ws)) AS n_distinct,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON w.r = cov.r
), voted AS (SELECT *, [{mask}] AS v FROM stats
), pat AS (SELECT v, count(*) AS n FROM voted GROUP BY v
), lists AS (SELECT list(v ORDER BY v) AS vs, list(n ORDER BY v) AS ns, sum(n)::DOUBLE AS total FROM pat
), em(it, post) AS (
  SELECT 0, (SELECT list({start} ORDER BY v) FROM pat)
  UNION ALL
  SELECT it + 1, list_transform(range(1, len(ns) + 1), lambda i: 1 / (1 + exp(-greatest(-60.0, least(60.0, ln((good + {s}) / (total - good + {s})) + {total})))))
  FROM (SELECT *, [{a}] AS a, [{b}] AS b FROM (SELECT *, list_sum(list_transform(range(1, len(ns) + 1), lambda i: ns[i] * post[i])) AS good FROM em, lists WHERE it < {p.iterations}) e) f
), post AS (SELECT unnest(vs) AS v, unnest(post) AS p FROM em, lists WHERE it = {p.iterations})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words) AND p >= {p.threshold} AS kept, round(p, 6) AS posterior
FROM voted JOIN post ON voted.v = post.v"""


def keep_good(docs: DataFrame, params: QualityParams = POSTERIOR_ONLY) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The posterior replaces a filter that all rules must pass: a document goes if the rules that
    voted on it, weighed by what they have proved to be worth, make it bad. Null and empty texts
    are judged by the votes on no words; null doc_ids and repeated rows are judged like any
    other; columns of any name are kept; an empty table gives no rows.
    """
    return score(docs, params).where(_c("kept")).select(*(F.col(f"`{x}`") for x in docs.columns))
