"""Toxicity, language, licences and quality rules."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from logloom.llm import language, licenses, quality, toxicity
from logloom.llm.common import fold

EDGES = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "lone row"), (4, "x" * 20_000)]


def _fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_fold(spark):
    got = {r.i: r.f for r in spark.range(50).select(F.col("id").alias("i"), fold("id").alias("f")).collect()}
    assert got == {i: _fold(i) for i in range(50)}


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(5)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(20, 80))
        bad = i % 4 == 0
        if bad:
            for w in rng.choices(["vile", "crook"], k=3):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark, docs_of, spoken):
    rows, labels = spoken
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scores(docs_of(rows + [(10_000, None), (10_001, ""), (10_001, "")]), known)
    assert got.columns.count("score") == 1 and "kept" in got.columns
    by_id = {r.doc_id: r for r in got.collect()}
    held = [(by_id[i].predicted, y) for i, y in labels if _fold(i) == 0]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in by_id.values())
    assert by_id[10_000].predicted == 0


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scores(docs_of(EDGES), none).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {0.0}
    assert toxicity.scores(docs_of([]), none).count() == 0


def test_languages(docs_of):
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["zur", "ven", "xo"]}
    rows = []
    for i in range(200):
        lang = "aa" if i % 2 else "bb"
        # Many words occur once, so most held-out words are unseen ones.
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=5)) for _ in range(8)), lang))
    rows += [(1000, None, "aa"), (1001, "12 .. 34", "bb"), (1002, "kaLOmi kami", None), (1003, "", "bb")]
    table = docs_of(rows)
    model = language.fit(table, word_share=1e-3)
    got = {r.doc_id: r for r in language.identified(table, model).collect()}
    held = [got[i] for i in range(200) if _fold(i) == 0]
    assert held and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "aa", "und"]
    assert got[1001].score == 0
    empty = language.fit(docs_of([]))
    assert {r.lang_pred for r in language.identified(docs_of(EDGES), empty).collect()} == {"und"}


def test_backoff_takes_the_longest_known_order():
    import numpy as np

    model = language.Model(("a", "b"), {}, np.zeros((0, 2)), {"\x02ab": 0, "a": 1, "b": 2},
                           np.array([[-1.0, -2.0], [-5.0, -5.0], [-7.0, -3.0]]))
    got = model.unseen(["ab", "cb", "zz"])
    assert got.tolist() == [[-1, -2], [-7, -3], [0, 0]]


def test_template_markup():
    match = lambda wording, text: licenses.Automaton(wording).longest(text.split(), 0)
    w = "Use <<optional: only>> the <<var: red | dark blue>> key"
    assert [match(w, t) for t in ("use the red key", "use only the dark blue key", "use the blue key",
                                  "use only only the red key", "use the red keys")] == [4, 6, None, None, None]
    assert [match("by <<var>> end", "by " + "x " * n + "end") for n in (0, 1, 12, 13)] == [None, 3, 14, None]
    assert match("a <<optional: b <<optional: c>>>> d", "a b c d") == 4
    assert match("a <<optional: b <<optional: c>>>> d", "a c d") is None
    for bad in ("<<optional: x>>", "a <<optional: b", "a >>", "<<var>> a"):
        with pytest.raises(ValueError):
            licenses.Scanner([licenses.Template("t", bad)])


def test_license_matches(docs_of):
    rows = EDGES + [(9, "Under the MIT-License; cc by NC cc By nc. Licensed under the APACHE license, version 2.0!")]
    got = {r.doc_id: r for r in licenses.scanned(docs_of(rows)).collect()}
    assert len(got) == len({i for i, _ in rows}) and got[1].n_words == 0 and got[1].matches == []
    found = [(m.label, m.start, m.end) for m in got[9].matches]
    assert found == [("mit", 0, 4), ("cc-by-nc", 4, 7), ("cc-by-nc", 7, 10), ("apache-2-notice", 10, 18),
                     ("apache-2", 13, 17)]


@pytest.mark.parametrize("name", ["mit-text", "bsd-text", "isc-text"])
def test_altered_license_texts_are_not_accepted(name):
    import re

    scanner = licenses.Scanner(licenses.TEMPLATES)
    labels = lambda text: [licenses.TEMPLATES[k].label for k, _, _ in scanner.scan(text)]
    wording = next(t.wording for t in licenses.TEMPLATES if t.label == name)
    # Innermost markup first: free regions become a name, choices their first, optional parts stay or go.
    plain = [wording, wording]
    for i, stays in enumerate((True, False)):
        while "<<" in plain[i]:
            plain[i] = re.sub(r"<<(optional:|var:|var)([^<>]*)>>", lambda m: (
                "The Authors of X" if m[1] == "var" else m[2].split("|")[0] if m[1] == "var:" else m[2] * stays), plain[i])
    for text in map(licenses.words, plain):
        assert labels(["x", *text, "y"]) == [name]
    text = licenses.words(plain[1])
    named = {i for i, w in enumerate(text) if "authors" in text[max(0, i - 3):i + 4]}  # free regions and about them
    for i in set(range(len(text))) - named:
        assert name not in labels(text[:i] + ["altered"] + text[i + 1:]), text[i]
        assert name not in labels(text[:i] + text[i + 1:]), text[i]
    assert name not in labels(text[:len(text) // 2])
    # A clause of one's own before the disclaimer.
    at = next(i for i in range(len(text)) if text[i:i + 3] == ["software", "is", "provided"]) - 1
    assert name not in labels(text[:at] + "the software shall be used for good not evil".split() + text[at:])


def _repeats(words):
    from collections import Counter

    at = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(at)
    return len({i + k for i, w in enumerate(at) if n[w] > 1 for k in range(5)})


def test_quality_measures(docs_of):
    rng = random.Random(1)
    rows = EDGES + [
        (20 + i, "\n".join(" ".join(rng.choices("ab c# d* eé f\U0001f600".split(), k=rng.randint(0, 6)))
                           for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows.append((99, "a b c d e f " * 300))
    names = quality.BASE
    got = quality.measured(docs_of(rows), names).select("doc_id", *names).collect()
    import re

    def want(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), _repeats(w))

    order = lambda rs: sorted(rs, key=str)
    assert order(tuple(r) for r in got) == order((i, *want(t)) for i, t in rows)


def test_cascade_order_does_not_change_the_verdict(docs_of):
    rows = EDGES + [(9, "Good plain words stand here in a row, and more of them follow after."),
                    (10, "a### b$$$ c%%% d&&& e***" * 5), (11, "same line\n" * 9 + "other line")]
    table = docs_of(rows)
    got = {r.doc_id: r for r in quality.judged(table).collect()}
    assert got[9].kept and not got[9].base_failed
    assert not got[10].kept and not got[11].kept and not got[1].kept
    found = quality.cascade(table).collect()
    back = quality.RULES[::-1]
    lazy = quality._parts(table).select("doc_id", quality.first_rejection(back, quality._lazy()).isNull().alias("k"))
    assert sorted((str(r.doc_id), r.kept) for r in found) == sorted((str(r.doc_id), r.k) for r in lazy.collect())
    worth = [quality.Estimate(quality.Rule(n, None), s, r) for n, s, r in (("a", 2, 0.1), ("b", 1, 0.5), ("c", 1, 0.0))]
    assert [r.name for r in quality.ordered(worth)] == ["b", "a", "c"]
    assert quality.judged(docs_of([])).count() == 0
