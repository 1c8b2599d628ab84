"""Quality by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Every rule votes good (1), bad (-1) or abstains (0) on a document.  Expectation-maximisation over the counts of vote
patterns (at most 3 to the number of rules, whatever the corpus) estimates the share of good documents and, for each
rule, how often its vote is right on good and on bad ones.  A document's quality is its posterior probability.

Defined results: a null text has no words, as an empty one; such documents fail the base rules.  Repeated rows and ids
are rated row by row, ties cannot occur, an empty table gives no rows and the starting model.  All columns of the input
are carried; a name that the operator adds replaces none of them, see ``measured``.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from millwarden.llm.common import bind, words_of
from millwarden.session import cut_lineage

WINDOW = 8
#: Character classes that are counted.
SYMBOLS, UPPER, MARKS, STOPS = "#*$%&|<>", "A-Z", "!?", "."

#: (rule, votes bad if, votes good if) over the measures, in whole numbers; SQL that Spark and others read alike.
NEVER = "n_words < 0"
RULES = (
    ("length", "n_words < 30", NEVER),
    ("symbols", "10 * n_symbols > n_words", NEVER),
    ("symbol_share", "20 * n_symbols > word_chars", NEVER),
    ("dup_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", NEVER),
    ("repeats", "100 * n_repeat_words > 30 * n_words", NEVER),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 3 * n_words AND 8 * n_words"),
    ("shouting", "10 * n_upper > 3 * word_chars", NEVER),
    ("marks", "5 * n_marks > n_words", NEVER),
    ("sentences", "60 * n_stops < n_words", "4 * n_stops <= n_words AND 30 * n_stops >= n_words"),
    ("clean", NEVER, "50 * n_symbols <= n_words AND 50 * n_marks <= n_words AND 8 * n_upper <= word_chars AND n_dup_lines = 0"),
)
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_stops")

#: Start of the EM: share of good documents; share of the good and of the bad ones on which a rule votes good, votes bad.
GOOD_SHARE, ON_GOOD, ON_BAD = 0.8, (0.6, 0.02), (0.2, 0.3)
#: Documents' worth of votes by which the start holds, and rounds.
WEIGHT, ROUNDS = 100.0, 25


@dataclass(frozen=True)
class RuleModel:
    """Share of good documents; per rule its rates of (good, bad) votes on good documents and on bad ones."""

    good: float
    rates: tuple[tuple[tuple[float, float], tuple[float, float]], ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log odds that a rule's good and its bad vote add; an abstention adds none."""
        return [(math.log(g[0] / b[0]), math.log(g[1] / b[1])) for g, b in self.rates]

    def accuracies(self) -> list[float]:
        """Chance that a rule's vote, once cast, is right."""
        out = []
        for g, b in self.rates:
            right, wrong = self.good * g[0] + (1 - self.good) * b[1], self.good * g[1] + (1 - self.good) * b[0]
            out.append(right / (right + wrong))
        return out

    def posterior(self, votes) -> float:
        odds = math.log(self.good / (1 - self.good)) + sum(u if v > 0 else d if v < 0 else 0.0 for v, (u, d) in zip(votes, self.weights()))
        return 1 / (1 + math.exp(-odds))


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _repeat_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more; windows compare by their 64-bit hashes within the text."""
    def windows(h: Column) -> Column:
        last = F.size(h) - WINDOW
        starts = F.when(last >= 1, F.sequence(F.lit(0), F.greatest(last, F.lit(0))))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))

    hashes = bind(F.transform(words, lambda w: F.xxhash64(w)), windows)

    def covered(places: Column) -> Column:
        spans = F.transform(places, lambda p, k: F.least(F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(spans, F.lit(0), lambda a, n: a + n)

    def repeated(ordered: Column) -> Column:
        def as_beside(e: Column, k: Column) -> Column:
            return e["h"].eqNullSafe(F.get(ordered, k - 1)["h"]) | e["h"].eqNullSafe(F.get(ordered, k + 1)["h"])

        return bind(F.sort_array(F.transform(F.filter(ordered, as_beside), lambda e: e["k"])), covered)

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bind(pairs, repeated)).otherwise(0)

    return F.coalesce(bind(hashes, counted), F.lit(0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and a struct column ``measures``; a column of that name in ``docs`` is replaced."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # One pass leaves the few characters that are counted.
    signs = F.regexp_replace(whole, f"[^{SYMBOLS}{UPPER}{MARKS}{STOPS}]+", "")

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"), _repeat_words(words).alias("n_repeat_words"))

    def of_lines(rows: Column) -> Column:
        return F.struct(F.size(rows).alias("n_lines"), (F.size(rows) - F.size(F.array_distinct(rows))).alias("n_dup_lines"))

    def of_signs(left: Column) -> Column:
        kinds = {"n_symbols": SYMBOLS, "n_upper": UPPER, "n_marks": MARKS, "n_stops": STOPS}
        return F.struct(*(_count(left, c).alias(m) for m, c in kinds.items()))

    def joined(*parts: Column) -> Column:
        found = {"n_words": 0, "word_chars": 0, "n_repeat_words": 0, "n_lines": 1, "n_dup_lines": 1}
        return F.struct(*(parts[found.get(m, 2)][m].cast("long").alias(m) for m in MEASURES))

    return docs.withColumn("measures", bind(bind(words_of(whole), of_words), lambda w: bind(bind(lines, of_lines), lambda l: bind(
        bind(signs, of_signs), lambda c: joined(w, l, c)))))


def _sql(rule: str) -> str:
    """The rule over the struct column."""
    return re.sub(r"\b(\w+_\w+)\b", r"measures.\1", rule)


def vote(name: str) -> Column:
    bad, good = next((b, g) for n, b, g in RULES if n == name)
    return F.when(F.expr(_sql(bad)), -1).when(F.expr(_sql(good)), 1).otherwise(0)


def fit_rules(rated: DataFrame, rounds: int = ROUNDS) -> RuleModel:
    """EM over the vote patterns of all rows with ``measures``.  Only the pattern counts, 6561 at most, reach the driver."""
    names = [n for n, *_ in RULES]
    patterns = [(tuple(r[:-1]), r[-1]) for r in rated.select(*(vote(n).alias(n) for n in names)).groupBy(*names).count().collect()]
    model = RuleModel(GOOD_SHARE, ((ON_GOOD, ON_BAD),) * len(names))
    for _ in range(rounds):
        chance = [(votes, n, model.posterior(votes)) for votes, n in sorted(patterns)]
        good, total = sum(n * p for _, n, p in chance), sum(n for _, n, _ in chance)
        rates = []
        for k in range(len(names)):
            on_good = tuple((sum(n * p for v, n, p in chance if v[k] == s) + WEIGHT * r) / (good + WEIGHT) for s, r in zip((1, -1), ON_GOOD))
            on_bad = tuple((sum(n * (1 - p) for v, n, p in chance if v[k] == s) + WEIGHT * r) / (total - good + WEIGHT) for s, r in zip((1, -1), ON_BAD))
            rates.append((on_good, on_bad))
        model = RuleModel((good + WEIGHT * GOOD_SHARE) / (total + WEIGHT), tuple(rates))
    return model


def rate(rated: DataFrame, model: RuleModel, least: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``quality`` (posterior) and ``kept`` to rows with ``measures``, replacing columns so named."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for (name, *_), (up, down) in zip(RULES, model.weights()):
        v = vote(name)
        odds = odds + F.when(v == 1, up).when(v == -1, down).otherwise(0.0)
    failed = F.expr(_sql(BASE_FAILED))
    quality = 1 / (1 + F.exp(-odds))
    return rated.withColumns({"base_failed": failed, "quality": quality, "kept": ~failed & (quality >= least)})


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns.  The texts are measured once and written with their measures; no shuffle of rows."""
    rated = cut_lineage(measured(docs.select(F.struct(*docs.columns).alias("row"), F.col(text)), text).select("row", "measures"))
    return rate(rated, fit_rules(rated)).filter("kept").select("row.*")


def oracle(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the measures, the EM and the verdicts over ``documents``."""
    word, names = r"[^\x20\x09-\x0D]+", [n for n, *_ in RULES]
    votes = ", ".join(f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END AS v_{n}" for n, b, g in RULES)
    pattern = ", ".join(f"v_{n}" for n in names)
    sums = [f"sum(CASE WHEN v_{n} = {s} THEN n * {c} ELSE 0 END) AS {k}_{n}" for n in names for s, c, k in (
        (1, "p", "gg"), (-1, "p", "gb"), (1, "(1 - p)", "bg"), (-1, "(1 - p)", "bb"))]

    def rates(good: str, bad: str) -> str:
        return ", ".join(f"({k}_{n} + {WEIGHT * r}) / ({total} + {WEIGHT}) AS {k}_{n}" for n in names for k, r, total in (
            ("gg", ON_GOOD[0], good), ("gb", ON_GOOD[1], good), ("bg", ON_BAD[0], bad), ("bb", ON_BAD[1], bad)))

    odds = "ln(share / (1 - share))" + "".join(f" + CASE v_{n} WHEN 1 THEN ln(gg_{n} / bg_{n}) WHEN -1 THEN ln(gb_{n} / bb_{n}) ELSE 0 END" for n in names)
    start = ", ".join(f"CAST({v} AS DOUBLE) AS {k}_{n}" for n in names for k, v in (("gg", ON_GOOD[0]), ("gb", ON_GOOD[1]), ("bg", ON_BAD[0]), ("bb", ON_BAD[1])))
    steps = [f"m0 AS MATERIALIZED (SELECT CAST({GOOD_SHARE} AS DOUBLE) AS share, {start})"]
    for k in range(rounds):
        steps.append(f"s{k} AS MATERIALIZED (SELECT coalesce(sum(n * p), 0) AS good, coalesce(sum(n), 0) AS total, {', '.join(sums)} FROM "
                     f"(SELECT p.*, 1 / (1 + exp(-({odds}))) AS p FROM patterns p, m{k}))")
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT (good + {WEIGHT * GOOD_SHARE}) / (total + {WEIGHT}) AS share, {rates('good', '(total - good)')} FROM s{k})")
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT row, regexp_extract_all(t, '{word}') AS w FROM texts),
windows AS (SELECT row, k, hash(w[k:k + {WINDOW - 1}]) AS h FROM (SELECT row, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM words)),
twice AS (SELECT row, k, least({WINDOW}, coalesce(lead(k) OVER (PARTITION BY row ORDER BY k) - k, {WINDOW})) AS span FROM
  (SELECT row, k, count(*) OVER (PARTITION BY row, h) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row, sum(span) AS n FROM twice GROUP BY row),
lines AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM
  (SELECT row, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{word}') GROUP BY row),
measures AS MATERIALIZED (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  {', '.join(f"CAST(length(regexp_replace(t, '[^{c}]', '', 'g')) AS BIGINT) AS {m}" for m, c in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_marks", MARKS), ("n_stops", STOPS)))},
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts JOIN words USING (row) LEFT JOIN lines USING (row) LEFT JOIN repeats r USING (row)),
voted AS MATERIALIZED (SELECT *, {votes} FROM measures),
patterns AS MATERIALIZED (SELECT {pattern}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY {pattern}),
{(',' + chr(10)).join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM voted, m{rounds}"""
