"""Personal data: base spans against a plain search, trees, redaction."""

import random
import re
import time

from logloom.llm import pii


def _luhn(s):
    total = 0
    for i, ch in enumerate(reversed(s)):
        x = int(ch) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _base(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k, pattern, ok in (
        (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (2, r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if ok(m.group())]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans_equal_a_plain_search(docs_of):
    rng = random.Random(3)
    bits = ["a@b.c", "x.y%z@q-r.s.t", "@", "1.2.3.4", "300.1.1.1", ".", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (234) 567-8901", "+", "-", " ", "0001", "é", "\U0001f600", "\n", "9" * 25, "word"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(1, 14)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "1 " * 2000), (903, "a" * 20_000 + "@" + "9" * 3000), (None, "a@b.c"),
             (904, "a@b.c"), (904, "a@b.c")]
    found = pii.candidates(docs_of(rows))
    out = pii.selected(found, pii.fit(found))
    got = out.select("doc_id", "text", pii.written(out["base"]).alias("b"), pii.written(out["spans"]).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.b == _base(r.text), r.text
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))


def test_trees_learn_from_format_and_context():
    x = lambda **kw: tuple(kw.get(name, 0) for name, _ in pii.FEATURES)
    good, bad = x(generator=2, digits=6, cue=1), x(generator=2, digits=4)
    table = [(good, False, 2, 60), (bad, False, 50, 1), (good, True, 1, 20), (bad, True, 15, 0)]
    model = pii.boost(table)
    assert model.score(good) > 0 > model.score(bad)
    assert model.score(bad) < model.thresholds[2] <= model.score(good)
    assert pii.boost([]).thresholds == {}


def test_method_adds_spans_and_redaction_covers_all(docs_of):
    hexed = ["%040x" % (0xA1B2C3D4E5F60718293A4B5C6D7E8F90 * (i + 3)) for i in range(60)]
    rows = [(i, f'Set token = "{h[-40:]}" and mail me@site{i}.org now') for i, h in enumerate(hexed)]
    rows.append((77, None))
    clean = {r.doc_id: r for r in pii.redact(docs_of(rows)).collect()}
    assert clean[3].text == 'Set token = "<SECRET>" and mail <EMAIL> now'
    assert clean[3].n_chars == len(clean[3].text) and clean[77].text is None
    assert pii.redact(docs_of([])).count() == 0


def test_addresses_written_with_at_are_redacted(docs_of):
    rows = [(i, f"Write to jane{i} [at] site.org. Or look [at] this") for i in range(40)]
    rows += [(50, "bob(AT)my-host.co.uk, or al.b [at] site [dot] org!"), (51, "meet (at) noon 7 [at] 8.30")]
    got = {r.doc_id: r for r in pii.redact(docs_of(rows)).collect()}
    assert got[3].text == "Write to <EMAIL_LIKE>. Or look [at] this"
    assert got[50].text == "<EMAIL_LIKE>, or <EMAIL_LIKE>!"
    assert got[51].text == rows[-1][1]
    alone = pii.redact(docs_of([(1, "jane [at] site.org")])).collect()[0]
    assert alone.text == "<EMAIL_LIKE>"
    x = lambda **kw: tuple(kw.get(name, 0) for name, _ in pii.FEATURES)
    table = [(x(generator=4, cue=1), False, 0, 60), (x(generator=4), False, 60, 0), (x(generator=0), True, 0, 5)]
    assert 4 in pii.boost(table).thresholds  # without calibration candidates of its own


def test_secrets_need_no_hexadecimal_form(docs_of):
    secrets = ["sk_" + "live_4eC39HqLyjWDarjtT1zdp7dc", "AKIA" + "IOSFODNN7EXAMPLE", "ghp_" + "16C7e42F292c6912E7710c838347Ae178B4a",
               "AKIA" + "IOSFODNNQEXAMPLE"]
    assigned = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA",
                "0b6e9f0c-7f0e-4b57-9d0e-3f6c1a2b4d5e"]
    clean = ["commit 11acdfb36bb72224148e6160f674b4be45601bff fixes it", "md5 9e107d9d372bb6826bd81d3542a419d6  a.tar",
             "see https://site.org/blog/2024/03/some-long-title-here now", "the slug top-10-places-to-see-in-2024 is long",
             "key: /blog/2024/03/some-long-title-here"]
    rows = [(i, f"The value {s} stands alone") for i, s in enumerate(secrets)]
    rows += [(10 + i, f"api_key: '{s}' was set") for i, s in enumerate(assigned)]
    rows += [(100 + 10 * k + i, t) for k in range(30) for i, t in enumerate(clean)]  # far more clean ones
    got = {r.doc_id: r.text for r in pii.redact(docs_of(rows)).collect()}
    assert [got[i] for i in range(len(secrets))] == ["The value <SECRET> stands alone"] * len(secrets)
    assert [got[10 + i] for i in range(len(assigned))] == ["api_key: '<SECRET>' was set"] * len(assigned)
    assert [got[100 + i] for i in range(len(clean))] == clean


def test_many_matches_are_placed_in_blocks(docs_of):
    rng = random.Random(8)
    bits = ["a@b.org", "4111 1111 1111 1111", "1.2.3.4", "+1 234 567 8901", "7 8 9", "é" * 3, "123456", "12-34-56-7", "1234567", "words"]
    rows = [(n, "; ".join(rng.choices(bits, k=n))) for n in (1, 127, 128, 129, 700)]
    found = pii.candidates(docs_of(rows))
    out = pii.selected(found, pii.Model())
    for r in out.select("text", pii.written(out["base"]).alias("b")).collect():
        assert r.b == _base(r.text)
    # The spans proposed as cards are the runs of seven digits and more.
    for r in found.select("text", "candidates").collect():
        runs = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])*", r.text) if len(re.sub("[^0-9]", "", m.group())) >= 7]
        assert [(c.s, c.e) for c in r.candidates if c.g == 2] == runs


def test_long_tables_of_numbers_take_seconds(docs_of):
    text = "".join(f"{i % 1000},{i % 77}\n" for i in range(150_000))
    assert len(text) > 900_000
    start = time.time()
    got = pii.candidates(docs_of([(1, text), (2, "mail a@b.org, " * 10_000)])).collect()
    assert {r.doc_id: len(r.candidates) for r in got} == {1: 0, 2: 10_000}
    assert time.time() - start < 30
