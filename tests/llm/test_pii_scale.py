"""Addresses with any letter, long texts in linear time, and pseudonyms against a plain reading of the format."""

import random
import re
import time
import unicodedata

import pytest

from seqwarden.llm import pii

KEY = b"k"
LETTERS = [chr(c) for c in range(128, 0x30000) if chr(c).isalnum()]


def test_every_letter_in_an_address():
    for c in LETTERS + [x for x in map(chr, range(128)) if x.isalnum()]:
        new, kinds = pii.pseudonymise(f"mail {c}b{c}@example.com.", KEY)
        assert kinds == ["email"] and re.fullmatch(r"mail \w\w\w@\w{7}\.com\.", new), c


@pytest.mark.parametrize("c", ["é", "Я", "漢", "ا", "İ", "ß", "Ⅷ", "٣"])
def test_letters_stay_in_their_alphabet_and_apart(c):
    alphabet = pii._alphabet(c)
    assert c in alphabet and len({unicodedata.category(x) for x in alphabet}) == 1
    assert sorted(pii._characters(x, KEY, "t") for x in alphabet) == sorted(alphabet)
    assert len({pii._characters(x + y, KEY, "t") for x in alphabet[:9] for y in alphabet[:9]}) == min(9, len(alphabet)) ** 2


def test_case_is_kept_and_ignored():
    small, mixed = pii.pseudonymise("anna.élan@example.com", KEY)[0], pii.pseudonymise("Anna.ÉLAN@Example.com", KEY)[0]
    assert small.lower() == mixed.lower() and [c.isupper() for c in mixed] == [c.isupper() for c in "Anna.ÉLAN@Example.com"]


@pytest.mark.parametrize("text", ["漢" * 1_000_000 + "@", "x" * 1_000_000 + "@a.com", "@" * 1_000_000, "a@b" * 300_000, "a@" + "b." * 500_000, "sk-" + "a1" * 500_000, "1 " * 20_000, "12-" * 30_000, "token = " * 100_000])
def test_long_texts_take_linear_time(text):
    start = time.perf_counter()
    new, _ = pii.pseudonymise(text, KEY)
    assert time.perf_counter() - start < 5 and len(new) == len(text)


def plain_addresses(text):
    """Addresses by a single pattern over short texts."""
    return [m.group() for m in re.finditer(r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}", text)]


def test_addresses_against_a_plain_pattern():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B", "1", ".", "-", "@", " ", "com", "é", "_", "漢", "x.de"]) for _ in range(rng.choice([5, 12, 30])))
        kinds: list[str] = []
        new = pii._addresses(text, KEY, kinds)
        assert len(kinds) == len(plain_addresses(text)) and len(new) == len(text)
        assert re.sub(r"\w", "x", new) == re.sub(r"\w", "x", text)
        assert pii._addresses(text, KEY, []) == new
