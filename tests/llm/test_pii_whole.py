"""Disguises that hide a part of an identifier, stand far from each other or use other signs."""

import pytest

from causeway.llm import pii


def extra(text):
    return [(k, text[s:e]) for k, s, e in pii.added(text, pii.find(text))]


@pytest.mark.parametrize("mail", ["alice@mail.exаmple.com", "jоhn@example.com", "alice@exa.mple․com"])
def test_spans_over_base_spans(mail):
    text = f"to {mail}, today"
    assert extra(text) == [("email", mail)]
    assert pii.redact(text) == "to [email], today"


@pytest.mark.parametrize("between", [".", "/", ")(", ", ", " - ", "; "])
def test_spelled_digits_with_any_separator(between):
    digits = between.join("four one one one one one one one one one one one one one one one".split())
    assert extra(f"card ({digits}) ok") == [("card", digits)]


def test_long_disguised_runs():
    mail = "jоhn" + "x" * 100 + "@" + "a" * 50 + "." + "b" * 60 + ".example.com"
    assert extra("so " + mail) == [("email", mail)]


def test_bracketed_signs_need_no_known_ending():
    assert extra("john [at] city [dot] museum") == [("email", "john [at] city [dot] museum")]
    assert extra("ann(at)city.photography") == [("email", "ann(at)city.photography")]
    assert extra("john at city dot museum") == [] and extra("meet @ home.Then go") == []


def test_overlapping_spans_are_redacted_as_one(monkeypatch):
    monkeypatch.setattr(pii, "find", lambda t: [("email", 1, 4)])
    monkeypatch.setattr(pii, "added", lambda t, base: [("phone", 3, 6)])
    assert pii.redact("abcdefgh") == "a[email]gh"


def test_added_spans_are_those_inside_no_other():
    """The sweep against a comparison of all spans with all."""
    import random

    rng = random.Random(6)
    bits = ["bob@mail.com", "jоhn@exаmple.com", "ann dot lee at site dot org", "+49 151 234567", "one nine two dot one six eight dot one dot ten", "10.0.0.1", "plus one two three four five five five one two one two", "4111 1111 1111 1111", "и", ".", " ", "x@y"]
    for _ in range(150):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(12))
        base = pii.find(text)
        found = {(k, *v.back(s, e)) for v in pii.deobfuscated(text) for k, s, e in pii.find(v.text)}
        want = {f for f in found - set(base) if not any(k == f[0] and a <= f[1] and f[2] <= b and (k, a, b) != f for k, a, b in [*base, *found])}
        assert set(pii.added(text, base)) == want


def test_many_spans_in_one_text():
    import time

    text = "и " + " ".join(f"user{i}@host{i}.example.com" for i in range(100_000))
    base = pii.find(text)
    began = time.perf_counter()
    assert len(base) == 100_000 and pii.added(text, base) == []
    assert time.perf_counter() - began < 10
