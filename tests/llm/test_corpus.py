"""Near duplicates, mixing, packing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from logloom.llm import jaccard, mixing, packing
from logloom.llm.common import tokenizer_path


def _brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        grams = {tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
        sets[i] = grams
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def _noisy(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_jaccard_join_equals_brute_force(docs_of):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(40)]
    rows, n = [], 0
    for size in (8, 11, 12, 30, 64, 130, 160, 400):
        stem = rng.choices(vocab + [f"s{size}x{i}" for i in range(200)], k=size)
        for k in range(14):  # a group of near copies that are not all alike
            rows.append((n := n + 1, _noisy(rng, stem, k % 5)))
    shared = " ".join(rng.choices(vocab, k=50))  # a passage that many share
    rows += [((n := n + 1), shared + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randint(0, 90))))
             for _ in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "two words"), (2004, "Two WORDS"), (2005, "É one"),
             (2006, "é one")]
    got = jaccard.linked(docs_of(rows))
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows)


def _brute_near(rows):
    """Five words, 80 percent: the smallest id reached, by labels passed on until none changes."""
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label, before = {i: i for i in sets}, None
    while before != label:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sorted((i, len(sets[i]), label[i]) for i in sets)


def test_near_stage_takes_five_words_and_80_percent(spark, docs_of):
    rng = random.Random(21)
    rows, n = [], 0
    for size in (8, 9, 10, 12, 14, 24, 50, 135, 450):
        stem = [f"s{size}x{i}" for i in range(size)]
        rows.append((n := n + 1, " ".join(stem)))
        for cut in range(1, 4):  # shortened copies, then spread edits about the limit
            rows.append((n := n + 1, " ".join(stem[:-cut])))
        for part in (0.015, 0.02, 0.024, 0.03):
            k = round(part * size)
            text = list(stem)
            for i in range(k):
                text[(2 * i + 1) * size // (2 * k)] = f"e{rng.randrange(10**9)}"
            rows.append((n := n + 1, " ".join(text)))
    want = _brute_near(rows)
    assert want != [(i, m, c) for (i, m, _), (*_, c) in zip(want, _brute(rows))]
    got = jaccard.linked(docs_of(rows), corpus_pipeline.NEAR)
    assert sorted(tuple(r) for r in got.collect()) == want
    kept = corpus_pipeline.ngram_jaccard_stage(spark, docs_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_jaccard_edges(docs_of):
    same = "one two three four five six seven eight nine ten eleven"
    got = jaccard.linked(docs_of([(5, same), (5, same), (3, same), (None, same), (8, None)])).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [
        (5, 9, 3), (5, 9, 3), (3, 9, 3), (None, 9, None), (8, 0, 8)]))
    assert jaccard.linked(docs_of([])).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_prefixes_of_linked_sets_share_an_entry(share):
    """Whatever tokens are frequent."""
    rng = np.random.default_rng(4)
    join = jaccard.Join()
    for n in (9, 10, 19, 60, 127, 135, 500, 1100, 9000):
        t = np.unique(rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
        drop = rng.choice(len(t), join.missing(len(t)), replace=False)
        other = np.delete(t, drop)
        more = (100 * len(other)) // 90 - len(t)  # tokens of its own that still allow the link
        extra = rng.integers(-2**63, 2**63 - 1, max(0, more), dtype=np.int64)
        other = np.unique(np.concatenate([other, extra]))
        both = np.union1d(t, other)
        frequent = np.sort(rng.choice(both, int(share * len(both)), replace=False))
        k = len(np.intersect1d(t, other))
        assert 100 * k >= 90 * (len(t) + len(other) - k)
        assert set(jaccard.signatures(t, frequent, join)) & set(jaccard.signatures(other, frequent, join)), n


@pytest.mark.parametrize("percent", [30, 50, 67, 80, 85, 90, 95])
def test_prefixes_of_linked_sets_share_an_entry_at_any_percent(percent):
    rng = np.random.default_rng(percent)
    join = jaccard.Join(percent=percent)
    least = join.smallest()
    for n in [n for n in (*range(least, 60), 127, 150, 1100, 9000) for _ in range(8 if n < 60 else 1)]:
        t = np.unique(rng.integers(-2**63, 2**63 - 1, n, dtype=np.int64))
        for gone in {0, int(rng.integers(0, join.missing(n) + 1)), join.missing(n)}:
            other = np.delete(t, rng.choice(n, gone, replace=False))
            more = 100 * len(other) // percent - n  # tokens of its own that still allow the link
            other = np.union1d(other, rng.integers(-2**63, 2**63 - 1, max(0, more), dtype=np.int64))
            both, k = np.union1d(t, other), len(np.intersect1d(t, other))
            assert 100 * k >= percent * len(both)
            for share in (0.0, 0.3, 1.0):
                frequent = np.sort(rng.choice(both, int(share * len(both)), replace=False))
                a, b = (set(jaccard.signatures(x, frequent, join)) for x in (t, other))
                assert a & b, (n, len(other), share)


def test_entries_at_90_percent_need_no_small_levels():
    assert [jaccard.Join().levels(n) for n in (9, 10, 100, 120, 5000)] == [[8], [8], [8], [8, 32], [128]]


def test_sketches_never_overstate(docs_of):
    rng = np.random.default_rng(1)
    for n in (50, 700, 1900):
        a = np.unique(rng.integers(0, 2**62, n))
        b = np.union1d(a[5:], rng.integers(0, 2**62, 7))
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in jaccard.sketch(a) ^ jaccard.sketch(b))
        assert bits <= len(np.setxor1d(a, b))


def test_targets_fill_evenly(spark):
    sums = spark.createDataFrame([("a", 10), ("b", 100), (None, 40), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sums).collect()}
    # Weights a 1, b 2, c 3, null 1: c has nothing, the others share 150.
    assert got["c"] == 0 and got["a"] == pytest.approx(30) and got["b"] == pytest.approx(80)
    assert got[None] == pytest.approx(40) and sum(got.values()) == pytest.approx(150)


def test_repeated_rows_are_whole_or_absent_but_one(docs_of):
    for n, text in ((1000, "w"), (30, "a b c d e f g")):
        table = docs_of([(None, text, "en", "a")] * n + [(i, "x", "en", "b") for i in range(n * len(text.split()) // 5)])
        want = Counter()
        for r in mixing.mix(table).where("doc_id is null").collect():
            want[r.size] += r.epochs
            want[r.part] += 1
        got = Counter(len(r.text.split()) for r in mixing.mixed_rows(table).where("doc_id is null").collect())
        del want[0]
        assert got == +want and sum(k not in (0, len(text.split())) for k in got.elements()) <= 1


def test_mix_meets_targets(docs_of):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(400)]
    rows += [(5, "p q r", "en", "a"), (5, "p q r", "en", "a"), (None, "x y", "en", "b"), (6, None, "en", "b")]
    table = docs_of(rows)
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[(r.source_size, r.target)].append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert len(by) == 3
    for (size, target), part in by.items():
        assert sum(r.size for r in part) == size and abs(sum(r.taken for r in part) - target) <= 1
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mixed_rows(table)
    assert out.columns == table.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len((r.text or "").split())
    for (size, target), part in by.items():
        assert min(abs(w - target) for w in words.values()) <= 2
    assert mixing.mix(docs_of([])).count() == 0 and mixing.mixed_rows(docs_of([])).count() == 0


def test_packed_pieces_hold_every_token_once(docs_of):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(7)
    rows = [(i, " ".join(f"tok{rng.randrange(999)}" for _ in range(rng.randint(0, 400)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "<|endoftext|> a  b\n\n c"), (503, "é\U0001f600 " * 3000), (504, "dup"), (504, "dup")]
    got = packing.pack(docs_of(rows), tokenizer_path()).collect()
    texts = dict(rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[i], key=lambda r: r.start)
        if i == 504:
            assert len(mine) == 2
            mine = mine[:1]
        at = 0
        for r in mine:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padded += at & (at - 1) > 0
    tasks = {s >> packing.TASK_BITS for s in sequences}
    assert padded <= len(tasks)
    full = Counter((r.tier, r.step_group) for own in sequences.values() for r in own[:1])
    assert all(n <= packing.GROUP_TOKENS // t for (t, _), n in full.items())
    assert packing.pack(docs_of([]), tokenizer_path()).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("bcdfglmnprst", k=3)) for _ in range(300)]
    rows, labels = [], []
    for i in range(300):
        text = rng.choices(vocab, k=rng.randint(30, 90))
        if i % 5 == 0:
            text[3], text[9], text[17] = "swine", "brute", "swine"
        rows.append((i, " ".join(text), "en", "ab"[i % 2], 0))
        labels.append((i, int(i % 5 == 0), 1))
    rows.append((300, rows[1][1], "en", "a", 0))
    rows.append((301, rows[2][1] + " mail to me@here.org", "en", "b", 0))
    rows += [(302, None, None, None, None), (303, "", "en", "a", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {i for i, *_ in rows if not (i < 300 and i % 5 == 0)}
    expected = [clean, clean - {300, 301}, clean - {300, 301}]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:3], expected, strict=False):
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == before.columns
        # Labels are learned from few documents here, so one may be missed.
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        assert want <= got and len(got - want) <= 2, name
    assert corpus_pipeline.run(spark, folder).count() > 0
