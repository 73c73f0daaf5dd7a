"""Personal data by candidate gradient boosting.

High-recall generators (patterns) propose spans that may overlap. A span whose
format is verified (an address with a domain, four parts up to 255, a Luhn sum, a
dialling prefix with 9 to 15 digits) is always kept: these are the base spans.
Boosted trees over format and context features, which leave the verification
itself out, learn from all candidates of the corpus what verified data look like
and where they stand; candidates that fail verification but score above their
generator's calibrated threshold are added (a mistyped card number after other
card numbers).

The generators beside the base formats have evidence of their own, which the
features leave out: an address written with ``at`` has a domain with a top-level
part; a secret bears the prefix of a known key format, or mixes letters and digits
and is assigned to the name of a secret (``token = ...``). What has evidence is
always added, as of the added kinds; trees add to it what looks and stands alike.
Digests, paths and slugs elsewhere have none.

Features are small integers, so the training set is a table of counts with one
row per combination, bounded by the product of the features' ranges (about
100,000) whatever the size of the corpus; it covers every candidate. Fold 1 of
the documents calibrates, the other folds fit.

Finding and selecting spans is one pass of built-in expressions, row by row,
without a shuffle or Python on the executors.

Defined results: a null text is empty and has no spans; repeated rows and null
ids are treated by their text; an empty table fits an empty model, which adds
nothing. Positions are code points, ends exclusive. Other columns are kept, and
replaced where they bear a name added here.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.stage import let

from .common import fold, replaced

# The base formats. Possessive repeats and the look-behind (or the
# end of the last match) keep the search linear; they do not change a match.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Numbers of fewer than seven digits are no candidates, so the pattern passes them over.
CARD = r"(?=(?:[0-9][\x20-]?){6}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators beside the base formats.
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"
_DOT = r"(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)"
WRITTEN_AT = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+"
#: Evidence: a domain with a top-level part; known key formats; a name that secrets are
#: assigned to; letters and digits mixed in a run, as in no slug, path or date.
TOP_LEVEL = rf"{_DOT}(?:[A-Za-z]{{2,}}|xn--[A-Za-z0-9-]+)$"
KEY_FORMATS = (
    r"^(?:[spr]k_(?:live|test)_[A-Za-z0-9]{12,}|whsec_[A-Za-z0-9+/]{20,}|sk-(?:[a-z0-9]+-){0,2}[A-Za-z0-9_]{20,}|"
    r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[oprsu]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{16,}|"
    r"xox[abeoprs]-[0-9A-Za-z-]{12,}|AIza[A-Za-z0-9_-]{30,}|npm_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{17,})"
)
ASSIGNED = (
    r"(?i)(?:token|secret|passw(?:or)?d|passwd|credentials?|(?:api|access|private|auth|secret|account)[\x20_-]?key|"
    r"(?<![A-Za-z])(?:key|auth))[\"']?\s{0,4}(?:=>|:=|=|:)\s{0,4}[\"'`]?$|(?i)(?<![A-Za-z])bearer\s$"
)
MIXED = r"(?<![A-Za-z0-9+])(?=[A-Za-z+]*[0-9])(?=[0-9+]*[A-Za-z])[A-Za-z0-9+]{6,}"

#: Kinds in their order: the base ones, then those the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_like", "ip_like", "card_like", "phone_like", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

GENERATORS = (EMAIL, IP, CARD, PHONE, WRITTEN_AT, SECRET)
#: Kind (index into KINDS) of what a generator adds when it isn't verified.
ADDS = (4, 5, 6, 7, 4, 8)

CUES = (
    r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|key|auth|card|visa|iban|account|tel|phone|call|"
    r"fax|mobile|mail|contact|ip|host|address|ssn)\W{0,4}$"
)
CONTEXT = 24
#: Matches of a text that are placed together.
BLOCK = 128

#: Names and numbers of values of the features.
FEATURES = (
    ("generator", 6), ("digits", 8), ("length", 7), ("letters", 3), ("separators", 3),
    ("cue", 2), ("quoted", 2), ("starts", 2), ("ends", 2),
)


def _bucket(value: Column, limits: tuple[int, ...]) -> Column:
    chain = None
    for i, limit in enumerate(limits):
        chain = (F if chain is None else chain).when(value <= limit, F.lit(i))
    return chain.otherwise(F.lit(len(limits)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def _octets(s: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(digits) <= 3, digits.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(s, r"\."), small)


def _verified(generator: int, s: Column) -> Column:
    if generator == 0:
        return F.lit(True)
    if generator == 1:
        return _octets(s)
    if generator == 2:
        return let(_digits(s), _luhn)
    if generator == 3:
        return F.length(_digits(s)).between(9, 15)
    return F.lit(False)


def _label(generator: int, s: Column, left: Column) -> Column:
    """What a candidate counts as when the trees are fitted: verified, or with evidence."""
    if generator == 4:
        return s.rlike(TOP_LEVEL)
    if generator == 5:
        return s.rlike(KEY_FORMATS) | (left.rlike(ASSIGNED) & s.rlike(MIXED))
    return _verified(generator, s)


def _proposed(generator: int, s: Column) -> Column:
    """Which matches of a pattern are candidates at all."""
    if generator == 2:
        return F.length(_digits(s)).between(7, 19)
    if generator == 5:
        return s.rlike("[0-9]") | s.rlike(KEY_FORMATS)
    return F.lit(True)


def _features(generator: int, s: Column, left: Column, right: Column) -> list[Column]:
    letters = F.when(~s.rlike("[A-Za-z]"), 0).when(~s.rlike("[G-Zg-z]"), 1).otherwise(2)
    return [
        F.lit(generator),
        _bucket(F.length(_digits(s)), (0, 3, 6, 8, 11, 15, 19)),
        _bucket(F.length(s), (8, 12, 16, 20, 32, 40)),
        letters,
        _bucket(F.length(F.regexp_replace(s, "[A-Za-z0-9]+", "")), (0, 2)),
        left.rlike(CUES).cast("int"),
        left.endswith('"').cast("int"),
        left.rlike(r"(?:^|[\s\"'(\[:=,;])$").cast("int"),
        right.rlike(r"^(?:$|[\s\"')\],;.!?])").cast("int"),
    ]


def _places(gap: Column, found: Column) -> Column:
    """Start, end and number of each match, from the matches and the gaps around them.

    Running sums copy the list that they extend, so they are made within blocks of
    matches, from the sums of the blocks before.
    """
    none = F.array().cast("array<int>")

    def summed(sizes: Column) -> Column:
        """The sum before each element and before the end."""
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(
            sizes, start, lambda acc, n: F.struct(
                (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: F.concat(acc["out"], F.array(acc["at"])))

    def ends(b: Column) -> Column:
        """Lengths from match to match of a block."""
        numbers = F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, F.size(found)) - 1)
        return F.transform(numbers, lambda i: F.length(F.get(gap, i)) + F.length(F.get(found, i)))

    def block(sizes: Column, b: Column, before: Column) -> Column:
        return let(summed(sizes), lambda sums: F.transform(sizes, lambda _, k: let(
            before + F.get(sums, k + 1), lambda e: F.struct(
                (e - F.length(F.get(found, b * BLOCK + k))).alias("s"), e.alias("e"), (b * BLOCK + k).alias("i")))))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), ends)
    return let(blocks, lambda blocks: let(
        summed(F.transform(blocks, lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, n: a + n))),
        lambda before: F.flatten(F.transform(blocks, lambda sizes, b: block(sizes, b, F.get(before, b))))))


def _placed(text: Column, generator: int) -> Column:
    """Candidates of one generator: start, end, verified, label, features."""
    pattern = GENERATORS[generator]

    def spans(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def walk(gap: Column) -> Column:
            at = _places(gap, found)

            def candidate(p: Column) -> Column:
                return let(F.get(found, p["i"]), lambda s: let(
                    F.right(F.get(gap, p["i"]), F.lit(CONTEXT)), lambda left: F.when(
                        _proposed(generator, s) | _verified(generator, s),
                        F.struct(
                            p["s"].alias("s"), p["e"].alias("e"), F.lit(generator).alias("g"),
                            _verified(generator, s).alias("ok"), _label(generator, s, left).alias("y"),
                            F.array(*[
                                x.cast("int") for x in _features(
                                    generator, s, left, F.left(F.get(gap, p["i"] + 1), F.lit(1)))
                            ]).alias("x"),
                        ))))

            return F.array_compact(F.transform(at, candidate))

        return F.when(F.size(found) > 0, let(gaps, walk)).otherwise(F.array().cast(CANDIDATES))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


CANDIDATES = "array<struct<s:int,e:int,g:int,ok:boolean,y:boolean,x:array<int>>>"
#: Cheap tests that a generator can match at all.
_NEEDS = ("@", r"[0-9]\.[0-9]", "[0-9]", r"\+[0-9]", r"[(\[](?i:at)[)\]]", r"[A-Za-z0-9_+/-]{20}")


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``candidates``: every span that a generator proposes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(CANDIDATES)
    found = [
        F.when(text.rlike(_NEEDS[g]), _placed(text, g)).otherwise(none) for g in range(len(GENERATORS))
    ]
    return replaced(docs, {"candidates": F.concat(*found)})


# --- the model ---------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """Two levels: a test, and a test with two values on either side of it."""

    test: tuple[int, int]
    below: tuple[tuple[int, int], float, float]
    above: tuple[tuple[int, int], float, float]

    def value(self, x) -> float:
        (f, t), low, high = self.below if x[self.test[0]] <= self.test[1] else self.above
        return low if x[f] <= t else high

    def column(self, x: Column) -> Column:
        def side(s):
            (f, t), low, high = s
            return F.when(F.get(x, f) <= t, F.lit(low)).otherwise(F.lit(high))

        return F.when(F.get(x, self.test[0]) <= self.test[1], side(self.below)).otherwise(side(self.above))


@dataclass(frozen=True)
class Model:
    prior: float = 0.0
    trees: tuple[Tree, ...] = ()
    #: Least score to add a candidate, by generator; absent: nothing is added.
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, x) -> float:
        return self.prior + sum(t.value(x) for t in self.trees)

    def column(self, x: Column) -> Column:
        total = F.lit(self.prior)
        for t in self.trees:
            total = total + t.column(x)
        return total


def counts(found: DataFrame) -> list[tuple[tuple[int, ...], bool, int, int]]:
    """Feature combinations with (calibration, negatives, positives) counts.

    At most two rows for each combination of feature values reach the driver.
    """
    c = F.explode("candidates").alias("c")
    rows = found.select((fold("doc_id") == 1).alias("cal"), c).select("cal", "c.x", "c.y")
    rows = rows.groupBy("cal", "x").agg(F.count_if(~F.col("y")).alias("n"), F.count_if("y").alias("p"))
    return sorted((tuple(r.x), r.cal, r.n, r.p) for r in rows.collect())


def _best_test(rows, grads) -> tuple[tuple[int, int], float, float, float]:
    """The test with the largest gain over ``rows``, and the values beside it."""
    best = ((0, len(FEATURES)), 0.0, 0.0, -1.0)
    for f, (_, n) in enumerate(FEATURES):
        g, h = [0.0] * n, [0.0] * n
        for i in rows:
            v = grads[i][0][f]
            g[v] += grads[i][1]
            h[v] += grads[i][2]
        all_g, all_h = sum(g), sum(h)
        low_g = low_h = 0.0
        for t in range(n):
            low_g, low_h = low_g + g[t], low_h + h[t]
            high_g, high_h = all_g - low_g, all_h - low_h
            gain = low_g**2 / (low_h + 1) + high_g**2 / (high_h + 1)
            if gain > best[3] + 1e-9:
                best = ((f, t), low_g / (low_h + 1), high_g / (high_h + 1), gain)
    return best


def boost(table, rounds: int = 30, rate: float = 0.3, precision: float = 0.9) -> Model:
    """Trees by Newton steps on the logistic loss, then thresholds by generator.

    A threshold is the lowest score at which at least ``precision`` of a
    generator's calibration candidates at or above it are verified ones; one without
    calibration candidates takes those of the fit.
    """
    fit = [(x, n, p) for x, cal, n, p in table if not cal] or [(x, n, p) for x, _, n, p in table]
    if not fit:
        return Model()
    pos, neg = sum(p for *_, p in fit), sum(n for _, n, _ in fit)
    prior = math.log((pos + 1) / (neg + 1))
    scores, trees = [prior] * len(fit), []
    for _ in range(rounds):
        grads = []
        for (x, n, p), s in zip(fit, scores):
            q = 1 / (1 + math.exp(-s))
            grads.append((x, p - (n + p) * q, (n + p) * q * (1 - q)))
        rows = range(len(fit))
        test = _best_test(rows, grads)[0]
        sides = []
        for below in (True, False):
            part = [i for i in rows if (fit[i][0][test[0]] <= test[1]) == below]
            t, low, high, _ = _best_test(part, grads)
            sides.append((t, rate * low, rate * high))
        trees.append(Tree(test, *sides))
        scores = [s + trees[-1].value(x) for (x, _, _), s in zip(fit, scores)]
    model = Model(prior, tuple(trees))
    held = [(x, n, p) for x, cal, n, p in table if cal]
    thresholds = {}
    for g in range(len(GENERATORS)):
        mine = [r for r in held if r[0][0] == g] or [r for r in fit if r[0][0] == g]
        own = sorted(((model.score(x), n, p) for x, n, p in mine), reverse=True)
        n_sum = p_sum = 0
        for i, (s, n, p) in enumerate(own):
            n_sum, p_sum = n_sum + n, p_sum + p
            last = i + 1 == len(own) or own[i + 1][0] < s
            if last and p_sum >= precision * (n_sum + p_sum):
                thresholds[g] = s
    return Model(prior, tuple(trees), thresholds)


def fit(found: DataFrame, **options) -> Model:
    """The model of a table that has ``candidates``."""
    return boost(counts(found), **options)


# --- selection ---------------------------------------------------------------

SPANS = "array<struct<s:int,k:int,e:int>>"


def base_spans(found: Column) -> Column:
    """Verified spans in order of start, then kind."""
    ok = F.filter(found, lambda c: c["ok"])
    return F.array_sort(F.transform(ok, lambda c: F.struct(
        c["s"].alias("s"), c["g"].alias("k"), c["e"].alias("e"))))


def _added(found: Column, base: Column, model: Model) -> Column:
    """Unverified candidates with evidence or above their threshold, the best of those that overlap."""
    known = [v for g, t in model.thresholds.items() for v in (F.lit(g), F.lit(t))]
    least = F.create_map(*known) if known else F.lit(None).cast("map<int,double>")
    kinds = F.array(*[F.lit(k) for k in ADDS])
    open_ = F.filter(found, lambda c: ~c["ok"])
    scored = F.transform(open_, lambda c: F.struct(
        c["s"].alias("s"), F.get(kinds, c["g"]).alias("k"), c["e"].alias("e"),
        c["y"].alias("y"), model.column(c["x"]).alias("score"), F.try_element_at(least, c["g"]).alias("least")))
    # A rounding margin, since sums may be made in another order than at fitting.
    able = F.filter(scored, lambda c: c["y"] | (c["score"] >= c["least"] - 1e-9))
    free = F.filter(able, lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))

    def unbeaten(rest: Column) -> Column:
        rank = lambda c: F.struct(~c["y"], -c["score"], c["s"], -c["e"], c["k"])
        return F.filter(rest, lambda c: ~F.exists(
            rest, lambda o: (o["s"] < c["e"]) & (c["s"] < o["e"]) & (rank(o) < rank(c))))

    best = F.transform(let(free, unbeaten), lambda c: F.struct(c["s"], c["k"], c["e"]))
    return F.array_distinct(best).cast(SPANS)


def selected(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``base`` and ``spans`` (all), both ordered, without ``candidates``."""
    c = F.col("candidates")
    out = replaced(found, {"base": base_spans(c)})
    out = replaced(out, {"spans": F.when(F.size(c) == 0, F.array().cast(SPANS)).otherwise(
        F.array_sort(F.concat(F.col("base"), _added(c, F.col("base"), model))))})
    return out.drop("candidates")


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(
        ":", F.get(names, p["k"]), p["s"].cast("string"), p["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind; overlapping spans count as one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, p: Column) -> Column:
        fresh = F.concat(
            acc["out"], F.substr(text, acc["at"] + 1, p["s"] - acc["at"]), F.get(names, p["k"]))
        return F.struct(
            F.greatest(acc["at"], p["e"]).alias("at"),
            F.when(p["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind."""
    found = candidates(docs)
    if model is None:
        model = fit(found)
    out = selected(found, model)
    out = out.withColumn("_text", redacted(F.col("text"), F.col("spans")))
    own = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[own.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
