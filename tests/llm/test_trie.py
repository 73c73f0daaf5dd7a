"""The conversation trie against a plain loop over all prefixes."""

import random
import zlib
from hashlib import sha256

import pytest

from logloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, p1 int"


def plain(rows, group=5, cut=9):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % cut
        base = c - int(c / group) * group if c < 0 else c % group
        built[c] = [*own.get(c - base, [])[:h], *ts[h:]]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[:len(key)] == key]
        kids = [k for k in members if len(k) == len(key) + 1 and k[:len(key)] == key]
        ended = sorted(c for c in convs if len(built[c]) == len(key))
        leaf = [k for k in below if not any(len(o) == len(k) + 1 and o[:len(k)] == k for o in below)]
        saved = sum((len(members[k]) - 1) * (len(k[-1][1]) if k else 0) for k in below)
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(kids), len(leaf),
                    saved, sha256(",".join(map(str, ended)).encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    out = trie.trie(df, **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[:2])


def test_nulls_ties_repeats_negative_ids_and_missing_groups(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, None, None), (0, 0, "user", "a"), (0, 0, "system", "é"), (0, 0, "user", "a"),
        (1, 3, "user", "a"), (1, 1, "user", ""), (7, 0, "user", "alone"), (-3, 0, "user", "b"), (-8, 1, "user", "c"),
        (10, 0, "user", "x" * 300_000), (12, 0, "user", "y"), (13, 0, "user", "y"), (14, -5, "user", "z"),
    ]
    assert found(spark, rows) == plain(rows)


def test_random_conversations_with_copies(spark):
    rng = random.Random(3)
    rows = []
    for c in range(300):
        size = rng.choice([1, 2, 3, 5, 9, 12])
        same = rng.random() < 0.5
        rows += [(c, t, "user", f"s{t}" if same else rng.choice("abc")) for t in range(size)]
    assert found(spark, rows) == plain(rows)


def test_slices_and_blocks_of_ids(spark, monkeypatch):
    """Long conversations over several slices; many ends over several blocks."""
    monkeypatch.setattr(trie, "SLICE", 4)
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [(c, t, "u", f"t{t}") for c in range(0, 200, 3) for t in range(2)]
    rows += [(c, t, "u", f"t{t}") for c in (1000, 1001, 1005) for t in range(30)]
    assert found(spark, rows) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    """Conversation 4 borrows from none and has fewer turns than it gives away."""
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "u", "gone")]
    got = found(spark, rows)
    assert got == plain(rows) and got[0][1] == 0 and got[0][7] == sha256(str(c).encode()).hexdigest()


def test_empty(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("group,cut", [(1, 1), (3, 4)])
def test_other_groups(spark, group, cut):
    rows = [(c, t, "u", f"{t % 2}{c % 2}") for c in range(20) for t in range(c % 6)]
    assert found(spark, rows, group=group, cut=cut) == plain(rows, group, cut)
