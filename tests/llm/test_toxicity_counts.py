"""Raw scores against a plain loop over the counts, wherever a word is looked up."""

import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_text_models import _fold, spoken  # noqa: F401

from logloom.llm import toxicity


def plain(rows, labels, evidence=20.0):
    """Raw score by document: weights of telling words, from distinct left neighbours."""
    tokens = {i: re.findall(r"[^\W\d_]+", (text or "").lower()) for i, text in rows}
    seen = (defaultdict(set), defaultdict(set))
    for i, y in labels:
        if _fold(i) >= 2:
            for left, word in zip([None, *tokens[i]], tokens[i]):
                seen[y][word].add(left)
    counts = [{w: len(s) for w, s in by.items()} for by in seen]
    total = [sum(c.values()) for c in counts]
    p1 = total[1] / sum(total)

    def tells(w):
        o, t = (c.get(w, 0) for c in counts)
        return 2 * sum(c * math.log(c / ((o + t) * p)) for c, p in ((t, p1), (o, 1 - p1)) if c) >= evidence

    told = {w for c in counts for w in c if tells(w)}
    kept = [sum(max(c.get(w, 0) - 0.75, 0) for w in told) / n for c, n in zip(counts, total)]
    rest = 1 - sum(kept) / 2

    def weight(w):
        if w not in told:
            return 0
        shared = rest * sum(c.get(w, 0) for c in counts) / sum(total)
        o, t = (max(c.get(w, 0) - 0.75, 0) / n + shared for c, n in zip(counts, total))
        return round(math.log(t / o) * 2**20) if abs(math.log(t / o)) >= 1 else 0

    return {i: sum(map(weight, ws)) / 2**20 / max(len(ws), 1) for i, ws in tokens.items()}


def test_portions_hold_every_text_once(monkeypatch):
    monkeypatch.setattr(toxicity, "PORTION", 10)
    for sizes in ([], [0], [3, 3, 3, 3, 3], [50, 1, 0], [1, 50, 1], [10, 10]):
        texts = ["x" * n if n else None for n in sizes]
        parts = list(toxicity._portions(texts))
        assert [t for p in parts for t in texts[p]] == texts
        assert all(sum(len(t or "") for t in texts[p][:-1]) < 10 for p in parts)


@pytest.mark.parametrize("share", [1e-5, 0.03, 0.9])
def test_raw_scores_equal_a_plain_loop(spark, docs_of, spoken, share):  # noqa: F811
    rows, labels = spoken
    rows = rows + [(10_000, None), (10_001, ""), (10_002, "Vile, vile crook!"), (10_003, "vile " * 30_000)]
    rows += [(i, "a crook and a vile crook") for i in range(20_000, 20_050)]
    docs = docs_of(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), share=share)
    assert (model.others is None) == (share == 1e-5)
    found = toxicity.marked(docs, model)
    more = None if model.others is None else toxicity.joined(found, model)
    got = {r.doc_id: r.raw for r in toxicity.raw_scores(found, more).select("doc_id", "raw").collect()}
    want = plain(rows, labels)
    assert got.keys() == want.keys() and want[10_002] > 1
    # The loop and Spark round a weight alike but for its last unit.
    assert all(got[i] == pytest.approx(want[i], abs=3e-6) for i in want)


def test_scores_do_not_depend_on_where_words_are_looked_up(spark, docs_of, spoken):  # noqa: F811
    rows, labels = spoken
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = docs_of(rows + rows[:20] + [(None, "a vile crook"), (None, None)])
    want = sorted(toxicity.scores(docs, known).select("doc_id", "score", "predicted").collect(), key=repr)
    for narrow in (False, True):
        got = toxicity.scores(docs, known, narrow=narrow, share=0.9).select("doc_id", "score", "predicted")
        assert sorted(got.collect(), key=repr) == want


def test_bitmap_holds_every_other_word(spark):
    words = [0, 1, 32767, 32768, (1 << 23) - 1, 1 << 23, (1 << 35) - 1, 123456789012 % (1 << 35)]
    table = spark.createDataFrame([(w,) for w in words], "word long").withColumn("weight", F.lit(1))
    bits = toxicity._bitmap(table)
    on = {i * 8 + b for i, v in enumerate(bits) if v for b in range(8) if v >> b & 1}
    assert on == {w % (1 << 23) for w in words}
    assert len(toxicity._bitmap(table.limit(0))) == 0
