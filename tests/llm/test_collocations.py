"""Phrase collocations against a plain count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from logloom.llm import collocations


def plain(rows, least=10, cover=50, limit=2000):
    counts, sizes = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for m in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= cover * a and p in (q[:2], q[1:]) for q, b in f.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), a, l, r, score))
        for rank, (_, _, p, a, l, r, score) in enumerate(sorted(kept)[:limit], 1):
            out.append((lang, rank, p.decode(), a, l, r, sizes[lang], score))
    return sorted(out)


def found(df, **options):
    out = collocations.collocations(df, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def texts(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "Straße", "the", "THE", "a-b", "x y"]
    for i in range(n):
        body = " ".join(words[min(int(rng.expovariate(0.15)), len(words) - 1)] + rng.choice(["", "", "", ".", ", ", "\t"])
                        for _ in range(rng.randint(0, 200)))
        yield i, body, rng.choice(["en", "en", "de", None])


def test_random_texts(docs_of):
    rows = [*texts(1, 60, 30), (900, None, "en"), (901, "", "fr"), (902, "one word", "fr"), (None, "a b c " * 20, "en")]
    assert found(docs_of(rows)) == plain(rows)


@pytest.mark.parametrize("dense", [1, 10**9])
def test_tiles_blocks_and_stretches(docs_of, monkeypatch, dense):
    """Small blocks, tiles and stretches, all counted by address or all as coordinates."""
    for name, value in (("BLOCK", 500), ("STRETCH", 64), ("TILE", 4), ("HEAD", 16), ("DENSE", dense), ("HELD", 300), ("ROW", 7)):
        monkeypatch.setattr(collocations, name, value)
    rows = list(texts(2, 40, 40))
    assert found(docs_of(rows), least=3, cover=70, limit=25) == plain(rows, 3, 70, 25)


def test_runs_ties_and_covered_phrases(docs_of):
    rows = [(1, "ha " * 50, "en"), (2, "Mit license grants. " * 12, "en"), (3, "Mit license grants. " * 12, "en"),
            (4, "b c! c b? " * 10, "en"), (5, "x y z q. x y. " * 11, "en")]
    assert found(docs_of(rows)) == plain(rows)


def test_one_very_long_text(docs_of):
    rows = [(1, "one two three four " * 150_000, "en"), (2, "z" * 3_000_000, "en"), (3, " " * 2_000_000 + "one", "en")]
    got = found(docs_of(rows))
    assert got == plain(rows)


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3 * 10**12, 4 * 10**12, 5 * 10**12)], "a long, l long, r long")
    assert rows.select(collocations._score("a", "l", "r")).first()[0] == 10**6 * 9 * 10**24 // (20 * 10**24)


def test_tally_and_packing():
    rng = np.random.default_rng(5)
    left, right = (np.minimum(rng.exponential(400, 300_000), 10**6).astype(np.int64) * rng.integers(1, 60, 300_000) for _ in "lr")
    got = Counter()
    for x, y, c in collocations.tally(left, right):
        for p in zip(x.tolist(), y.tolist(), c.tolist()):
            assert p[:2] not in got
            got[p[:2]] = p[2]
    assert got == Counter(zip(left.tolist(), right.tolist()))
    ids = rng.integers(-1, 2**31 - 1, 1000).astype(np.int32)
    assert (collocations.unpack(collocations.pack(ids), len(ids)) == ids).all()


def test_empty(docs_of):
    assert found(docs_of([])) == []
