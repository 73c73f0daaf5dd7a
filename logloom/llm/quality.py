"""Quality rules as a short-circuit cascade.

Each rule rejects a document by a measure of its text. What a rule costs and how
much it rejects is estimated on a bounded sample; rules then run in order of
rejection per cost, and a document that one rule rejects is not shown to the
later ones (``CASE`` evaluates its branches in order, so dear rules run on few
rows). The order changes the work, never the verdict: a document is kept if no
rule rejects it.

Everything is built-in expressions in one pass without a shuffle, so skew and
hot sources do not matter.

Defined results: a null or blank text has no words, symbols or lines; it is kept
or rejected by the rules like any other (the base rule rejects it). Repeated
rows and null ids get the verdict of their text. Columns of the input that bear
a name used here are replaced by :func:`measured` and :func:`cascade`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.stage import let

from .common import SPACE, replaced, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rows of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 2000

Measures = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """``reject`` gets the measures by name and says which documents go."""

    name: str
    reject: Callable[[Measures], Column]


def _share(part: str, whole: str, percent: int) -> Callable[[Measures], Column]:
    return lambda m: m[part] * 100 > m[whole] * percent


#: The default rules. Limits are wide: they are to reject junk, not odd prose.
RULES = (
    Rule("symbols", _share("n_symbols", "word_chars", 10)),
    Rule("duplicate_lines", _share("n_dup_lines", "n_lines", 30)),
    Rule("short_words", lambda m: m["word_chars"] < m["n_words"] * 2),
    Rule("long_words", lambda m: m["word_chars"] > m["n_words"] * 20),
    Rule("few_letters", lambda m: m["n_letters"] * 100 < m["word_chars"] * 50),
    Rule("bullet_lines", _share("n_bullets", "n_lines", 90)),
)


def repeat_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Most
    texts repeat nothing, which one pass over a hash set shows; only the others
    sort their windows.
    """

    def hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(found: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(found) - 1)
        return F.aggregate(
            steps, F.lit(window).cast("long"),
            lambda n, i: n + F.least(F.lit(window), F.get(found, i) - F.get(found, i - 1)),
        )

    def repeated(by_hash: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(by_hash, i)["h"] == x["h"], F.lit(False))
        marked = F.transform(by_hash, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
        return F.array_sort(F.array_compact(marked))

    def count(win: Column) -> Column:
        pairs = F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        again = let(F.array_sort(pairs), lambda s: let(repeated(s), covered))
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(again)

    wide = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: let(hashes(h), count))
    return F.when(F.size(tokens) <= window, F.lit(0).cast("long")).otherwise(wide)


def measures(text: Column, tokens: Column, lines: Column) -> dict[str, Column]:
    """Every measure as an expression; ``tokens`` and ``lines`` of the same text."""
    without = lambda drop: F.length(text) - F.length(F.translate(text, drop, ""))
    found = {
        "n_words": F.size(tokens),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")),
        "n_symbols": without(SYMBOLS),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(tokens),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
        "n_bullets": F.size(F.filter(lines, lambda line: line.rlike(r"^[\x20\t]*[-*•]"))),
    }
    return {k: v.cast("long") for k, v in found.items()}


def _parts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))
    return replaced(docs, {"_text": text, "_tokens": words(F.col("text")), "_lines": lines})


def _lazy() -> dict[str, Column]:
    return measures(F.col("_text"), F.col("_tokens"), F.col("_lines"))


def measured(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with the named measures, all computed."""
    every = _lazy()
    found = replaced(_parts(docs), {n: every[n] for n in names})
    return found.drop("_text", "_tokens", "_lines")


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimate(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS
) -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``sample_rows`` rows."""
    def timed(tested: Column) -> tuple[float, list[bool]]:
        # A limit at the root of a plan reads splits only until it has its rows.
        frame = _parts(docs.select("text")).select(tested.alias("_tested")).limit(sample_rows)
        frame.collect()  # compiles
        start = time.perf_counter()
        found = [r[0] for r in frame.collect()]
        return time.perf_counter() - start, found

    reading, _ = timed(F.length("_text") < 0)
    out = []
    for rule in rules:
        seconds, found = timed(rule.reject(_lazy()))
        out.append(Estimate(rule, max(seconds - reading, 0.0), sum(map(bool, found)) / max(len(found), 1)))
    return out


def ordered(estimates: list[Estimate]) -> tuple[Rule, ...]:
    """Most rejection per cost first; ties by lower cost, then by name."""
    best = sorted(estimates, key=lambda e: (-e.worth, e.seconds, e.rule.name))
    return tuple(e.rule for e in best)


def first_rejection(rules: tuple[Rule, ...], found: Measures) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none."""
    chain = None
    for rule in rules:
        chain = (F if chain is None else chain).when(rule.reject(found), F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``kept`` and ``rejected_by`` (which rule is met first may differ by run)."""
    order = ordered(estimate(docs, rules, sample_rows))
    found = replaced(_parts(docs), {"rejected_by": first_rejection(order, _lazy())})
    return replaced(found, {"kept": F.col("rejected_by").isNull()}).drop("_text", "_tokens", "_lines")


def base_failed(found: Measures) -> Column:
    """Under 10 words, or over a fifth of them in repeated windows."""
    return (found["n_words"] < 10) | (found["n_repeat_words"] * 100 > found["n_words"] * 20)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base measures, ``base_failed`` and ``kept``.

    The base measures are computed for every document; the cascade reads those
    and computes the others only for documents that come so far.
    """
    order = ordered(estimate(docs, rules, sample_rows))
    every = _lazy()
    names = (*BASE, "n_lines")
    found = replaced(_parts(docs), {n: every[n] for n in names})
    known = every | {n: F.col(n) for n in names}
    found = replaced(found, {"base_failed": base_failed(known)})
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(first_rejection(order, known).isNull())
    return replaced(found, {"kept": verdict}).drop("_text", "_tokens", "_lines", "n_lines")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, unnest(range(0, len(ws) - 4)) AS i,
    unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g
    FROM w WHERE len(ws) >= 5),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM again) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(ls) AS n_lines, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
    len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\t]*[-*\x{2022}]'))) AS n_bullets
    FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
        OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_letters < 50 * word_chars
        OR 100 * n_bullets > 90 * n_lines) AS kept
FROM b
"""
