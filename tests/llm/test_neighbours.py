"""Personal data next to other numbers and words."""

import pytest

from seqwarden.llm import pii

CARD, IBAN = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        *[(before + CARD + after, CARD, "card") for before in ("", "7 ", "123 ", "99 88 ", "AB12 ", "+1 ") for after in ("", " 1", " 12", " 123", " 1234", " 2024-02-30")],
        *[(before + IBAN + after, IBAN, "iban") for before in ("", "pay ", "AB12 ") for after in (" EUR", " 12", " PAID NOW", " 1234 56")],
        ("AT611904300234573201 EUR", "AT611904300234573201", "iban"),
        ("4111-1111-1111-1111-12", "4111-1111-1111-1111", "card"),
        ("+49 151 1234 5678 2024", "+49 151 1234 5678", "phone"),
    ],
)
def test_neighbours_do_not_hide_a_value(text, value, kind):
    new, kinds = pii.pseudonymise(text, b"k")
    assert kind in kinds and value not in new and len(new) == len(text)


def test_the_neighbour_changes_nothing():
    alone = pii.pseudonymise(CARD, b"k")[0]
    assert pii.pseudonymise(f"{CARD} 123 EUR", b"k") == (f"{alone} 123 EUR", ["card"])
    assert pii.pseudonymise("4111 1111 1111 1112 7 items", b"k") == ("4111 1111 1111 1112 7 items", [])


@pytest.mark.parametrize("digits", ["4915112345678", "15551234567", "35312345678"])
def test_one_phone_number_has_one_pseudonym(digits):
    n = 1 if digits[0] == "1" else 2 if digits[:2] == "49" else 3
    forms = ["+" + digits, f"+{digits[:n]} {digits[n:]}", f"+{digits[:n]} {digits[n : n + 3]} {digits[n + 3 : n + 6]}-{digits[n + 6 :]}"]
    new = [pii.pseudonymise(f, b"k")[0] for f in forms]
    assert len({"".join(c for c in x if c.isdigit()) for x in new}) == 1 and new[0] != forms[0]
