"""Word pairs that back off to words: raw scores against a plain loop, and what only pairs tell."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from test_text_models import _fold

from logloom.llm import toxicity


@pytest.fixture(scope="module")
def ordered():
    """Both classes have the same words; in toxic texts "quill" stands behind "amber"."""
    rng = random.Random(11)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        bad, text = i % 4 == 0, []
        while not text or ("amber quill" in " ".join(text)) != bad:
            text = rng.choices(words, k=rng.randint(20, 60))
            for extra in [["amber", "quill"]] * (2 * bad) + [["amber"], ["quill"]] * (2 if bad else 4):
                at = rng.randrange(len(text) + 1)
                text[at:at] = extra
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def plain(rows, labels, evidence=20.0):
    """Raw score by document: a place's weight is its pair's if that tells, else its word's."""
    tokens = {i: re.findall(r"[^\W\d_]+", (text or "").lower()) for i, text in rows}
    pairs = [Counter(), Counter()]
    known = set()
    for i, y in labels:
        if _fold(i) >= 2 and (dict(rows)[i], y) not in known:
            known.add((dict(rows)[i], y))
            pairs[y].update(set(zip([None, *tokens[i]], tokens[i])))
    seen = [defaultdict(set), defaultdict(set)]
    for y in (0, 1):
        for v, w in pairs[y]:
            seen[y][w].add(v)
    o, t = ({w: len(s) for w, s in by.items()} for by in seen)
    sum_o, sum_t = sum(o.values()), sum(t.values())

    def tells(a, b, p):
        return 2 * sum(c * math.log(c / ((a + b) * q)) for c, q in ((a, p), (b, 1 - p)) if c) >= evidence

    words = t.keys() | o.keys()
    told = {w for w in words if tells(t.get(w, 0), o.get(w, 0), sum_t / (sum_t + sum_o))}
    kept = [sum(max(c.get(w, 0) - 0.75, 0) for w in told) / n for c, n in ((t, sum_t), (o, sum_o))]
    rest = 1 - sum(kept) / 2
    lower, weight = {}, {}
    for w in words:
        plain_ = (t.get(w, 0) + o.get(w, 0)) / (sum_t + sum_o)
        lower[w] = (plain_, plain_)
        if w in told:
            own = tuple(max(c.get(w, 0) - 0.75, 0) / n + rest * plain_ for c, n in ((t, sum_t), (o, sum_o)))
            if abs(math.log(own[0] / own[1])) >= 1:
                lower[w], weight[w] = own, round(math.log(own[0] / own[1]) * 2**20)
    context = defaultdict(lambda: [0, 0, 0])
    for pair in pairs[0].keys() | pairs[1].keys():
        for j, n in enumerate((pairs[1][pair], pairs[0][pair], 1)):
            context[pair[0]][j] += n
    gains = {}
    for v, w in pairs[0].keys() | pairs[1].keys():
        a, b = pairs[1][v, w], pairs[0][v, w]
        v_t, v_o, v_n = context[v]
        p_t, p_o = lower[w]
        if a + b >= 5 and tells(a, b, v_t * p_t / (v_t * p_t + v_o * p_o)):
            back = 0.75 * v_n / (v_t + v_o)
            q_t = max(a - 0.75, 0) / max(v_t, 1) + back * p_t
            q_o = max(b - 0.75, 0) / max(v_o, 1) + back * p_o
            gain = math.log(q_t / q_o) - math.log(p_t / p_o)
            if abs(gain) >= 1:
                gains[v, w] = round(gain * 2**20)
    return gains, {
        i: sum(weight.get(w, 0) + gains.get((v, w), 0) for v, w in zip([None, *ws], ws)) / 2**20 / max(len(ws), 1)
        for i, ws in tokens.items()}


@pytest.mark.parametrize("share", [1e-5, 0.9])
def test_raw_scores_with_pairs_equal_a_plain_loop(spark, docs_of, ordered, share):
    rows, labels = ordered
    rows = rows + [(10_000, None), (10_001, ""), (10_002, "amber quill amber quill"), (10_003, "quill amber")]
    # Copies of a text count once.
    rows += [(i, rows[0][1]) for i in range(20_000, 20_040)]
    labels = labels + [(i, 1) for i in range(20_000, 20_040)]
    docs = docs_of(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), share=share, order=2)
    assert (model.others is None) == (share == 1e-5)
    found = toxicity.marked(docs, model)
    more = None if model.others is None else toxicity.joined(found, model)
    got = {r.doc_id: r.raw for r in toxicity.raw_scores(found, more).select("doc_id", "raw").collect()}
    gains, want = plain(rows, labels)
    assert gains[("amber", "quill")] > 0 and got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=5e-6) for i in want)


def test_order_of_words_tells(spark, docs_of, ordered):
    rows, labels = ordered
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    by_id = {r.doc_id: r.predicted for r in toxicity.scores(docs_of(rows), known, narrow=True).collect()}
    held = [(by_id[i], y) for i, y in labels if _fold(i) == 0]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)


def test_pair_ids_are_one_to_one_and_alike(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(3)
    keys = sorted({rng.getrandbits(63) for _ in range(500)} | {0, 1, 1 << 28, (1 << 63) - 1})
    got = toxicity._pair_ids(np.array(keys, np.int64)).tolist()
    frame = spark.createDataFrame([(k,) for k in keys], "key long").select("key", toxicity._pair_ids(F.col("key")).alias("id"))
    assert [r.id for r in frame.orderBy("key").collect()] == got and len(set(got)) == len(keys) and max(got) < 0
