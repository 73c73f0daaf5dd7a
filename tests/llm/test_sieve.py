"""Rows that no join asks for stay where they are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import common, jaccard


def test_sifted_parts_are_the_rows_and_lose_no_id(spark):
    rows = spark.createDataFrame(
        [(i, f"t{i}", i) for i in range(2000)] + [(7, "again", 0), (-3, "below 0", 0), (None, "none", 0)],
        "doc_id long, text string, bucket long")
    ids = spark.createDataFrame([(i,) for i in range(0, 2000, 100)] + [(7,), (-3,), (None,), (10**12,)], "id long")
    may, no = common.sifted(rows, ids)
    assert may.columns == no.columns == rows.columns
    got, rest = [tuple(r) for r in may.collect()], [tuple(r) for r in no.collect()]
    assert sorted(map(str, got + rest)) == sorted(str(tuple(r)) for r in rows.collect())
    asked = {r.id for r in ids.collect()} - {None}
    assert sum(r[0] in asked for r in got) == 23 and not any(r[0] in asked for r in rest)
    # 24 bits of 2^24 rule out all but a few others.
    assert len(got) <= 25 and (None, "none", 0) in rest
    assert common.sifted(rows, ids.limit(0))[0].isEmpty()


def test_only_texts_that_pairs_ask_for_are_moved(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(60))
    rows = [(i, text()) for i in range(400)]
    # A near copy of one, an exact copy of another, repeated rows, and an id with two texts.
    rows += [(500, rows[3][1] + " tail"), (501, rows[4][1]), rows[5], (6, rows[8][1]), (None, rows[9][1])]
    moved, real = [], jaccard.sifted

    def told(docs, ids, by="doc_id"):
        may, no = real(docs, ids, by)
        moved.append(may.count())
        return may, no

    monkeypatch.setattr(jaccard, "sifted", told)
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    near = {(r.doc_id, r.component_id) for r in out if r.doc_id != r.component_id}
    assert near == {(500, 3), (501, 4), (8, 6)}
    assert len(out) == len(rows) and moved and max(moved) <= 12


def test_rows_of_an_entry_that_are_far_in_size_from_all_others_leave_the_index(spark):
    # By entry: chance (no two are close), a pair and a stranger, one class twice, two at the limit, one alone.
    rows = [(1, i, n) for i, n in enumerate((10, 20, 40, 80))]
    rows += [(2, 10, 100), (2, 11, 300), (2, 12, 95), (3, 20, 50), (3, 20, 50), (4, 30, 90), (4, 31, 100), (5, 40, 9)]
    rows += [(6, 50, 89), (6, 51, 100)]
    got = jaccard._shared(spark.createDataFrame(rows, "entry long, id long, n long"), jaccard.Join())
    assert sorted(tuple(r) for r in got.collect()) == [(2, 10, 100), (2, 12, 95), (4, 30, 90), (4, 31, 100)]


def test_a_shared_passage_joins_only_texts_of_close_sizes(spark, monkeypatch):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    text = lambda n: passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    rows = [(i, text(round(40 * 1.3**i))) for i in range(7)]
    rows += [(100, rows[5][1] + " tail"), (101, " ".join(rows[6][1].split()[:-4]))]
    sizes, real = [], jaccard._with_pivots

    def told(index, classes, join):
        sizes.append({r.id for r in index.select("id").collect()})
        return real(index, classes, join)

    monkeypatch.setattr(jaccard, "_with_pivots", told)
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out if r.doc_id != r.component_id} == {(100, 5), (101, 6)}
    assert sizes == [{5, 6, 100, 101}]


def test_sketches_grow_with_the_set_and_compare_with_those_of_the_next_size(spark):
    rng = np.random.default_rng(2)
    last, seen = 0, set()
    for n in (50, 380, 400, 900, 930, 2000, 2100, 4200, 4400, 8700, 9000, 30_000):
        t = np.unique(rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
        near, far = t[n // 20:], np.unique(rng.integers(-2**63, 2**63 - 1, n - n // 20, dtype=np.int64))
        assert len(jaccard.sketch(t)) >= last
        last = len(jaccard.sketch(t))
        row = [jaccard.sketch(x).tolist() for x in (t, near, far)]
        df = spark.createDataFrame([row], "t array<long>, near array<long>, far array<long>")
        apart = df.select(jaccard._apart(F.col("t"), F.col("near")), jaccard._apart(F.col("near"), F.col("t")),
                          jaccard._apart(F.col("t"), F.col("far"))).first()
        assert apart[0] == apart[1] and 0 < apart[0] <= len(t) - len(near)
        able = apart[2] * 190 <= (len(t) + len(far)) * 10
        assert able == (n == 30_000), n  # the largest sketch is full by then
        seen.add((len(row[0]), len(row[1])))
    assert any(a == 2 * b for a, b in seen) and last == jaccard.SKETCH[1]


def _edited(rng, words, most):
    """Copies of one text with none to ``most`` words of their own, some of them copied again."""
    texts = []
    for i in range(260):
        text = list(words)
        for p in rng.sample(range(len(words)), i % (most + 1)):
            text[p] = f"e{rng.randrange(10**9)}"
        texts.append(text)
        if i % 20 < 3:
            again = list(text)
            again[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
            texts.append(again)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def _linked_pairs(rows, join):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = frozenset(tuple(w[k:k + join.words]) for k in range(len(w) - join.words + 1))
    first = {s: i for i, s in sorted(sets.items(), reverse=True)}  # copies have no links of their own
    return {(a, b) for a in first.values() for b in first.values() if a < b and 100 * len(sets[a] & sets[b]) >= join.percent * len(sets[a] | sets[b])}


def _told_links(monkeypatch):
    seen, real = [], jaccard._links

    def told(pairs, *rest):
        pairs, out = pairs.cache(), real(pairs, *rest)
        seen.append(({tuple(r) for r in pairs.collect()}, {tuple(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(jaccard, "_links", told)
    return seen


NEAR = jaccard.Join(words=5, percent=80)


def test_copies_beyond_the_limit_are_told_apart_without_their_sets(spark, monkeypatch):
    rng = random.Random(6)
    rows = _edited(rng, [f"w{i}" for i in range(150)], 12)
    seen = _told_links(monkeypatch)
    out = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), NEAR).collect()
    links, want, before = _linked_pairs(rows, NEAR), {i: i for i, _ in rows}, None
    while before != want:
        before = dict(want)
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    first = {t: i for i, t in sorted(rows, reverse=True)}
    assert {r.doc_id: r.component_id for r in out} == {i: want[first[t]] for i, t in rows}
    assert len(seen) == 2 and len(seen[1][0]) <= len(rows) // 4


@pytest.mark.parametrize("join", [NEAR, jaccard.Join()])
def test_crowded_entries_lose_no_link(spark, monkeypatch, join):
    """Without pivots every link is found among the pairs of an entry."""
    rows = _edited(random.Random(7), [f"w{i}" for i in range(150)], 6)
    monkeypatch.setattr(jaccard, "_with_pivots", lambda index, classes, join: classes.selectExpr("id x", "id y").limit(0))
    seen = _told_links(monkeypatch)
    jaccard.linked(spark.createDataFrame(rows + rows[:3], "doc_id long, text string"), join).collect()
    assert seen[1][1] == _linked_pairs(rows, join) and len(seen[1][1]) > 1000
