"""Format-preserving pseudonyms for personal data: keyed permutations within each format."""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwarden.llm.batches import releasing

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
TWO_DIGIT_COUNTRIES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
LETTERS, DIGITS, HEXADECIMAL = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

LOCAL_PART, LABEL = 64, 63  # the most characters of these parts of an address
DOMAIN = re.compile(rf"@([\w\-]{{1,{LABEL}}}(?:\.[\w\-]{{1,{LABEL}}}){{0,8}})(\.[^\W\d_]{{2,{LABEL}}})")
BLOCK = 128  # code points; a letter outside a-z stays in its block
AT_ONCE = 64  # characters permuted as one number
SECRET = re.compile(
    r"""(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|sk-|xox[abp]-)[A-Za-z0-9\-]{16,}"""
    r"""|(?i:(?:token|secret|password|passwd|api[_-]?key)["']?\s*[=:]\s*["']?)([A-Za-z0-9_\-]{8,})(?![A-Za-z0-9_\-])"""
)
NUMBER = re.compile(
    r"""(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?(?![A-Za-z0-9]))
    |(?P<ipv4>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))
    |(?P<iso>(?<![\w\-])\d{4}-\d{2}-\d{2}(?![\d\-]))
    |(?P<date>(?<![\w./])\d{1,2}(?P<sep>[./])\d{1,2}(?P=sep)\d{4}(?![\w/]|\.\d))
    |(?P<phone>(?<![\w])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\)[ ]?\d{3}-\d{4}(?!\w)|(?<![\w\-])\d{3}-\d{3}-\d{4}(?![\w\-]))
    |(?P<ssn>(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-]))
    |(?P<card>(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-]))""",
    re.X | re.A,
)


@functools.lru_cache(maxsize=1 << 15)
def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network on the next even number of bits.

    Values that leave the range are permuted again until they fall into it, which keeps it a
    bijection. Every kind has a permutation of its own.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, n_bytes = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            mixed = hashlib.shake_256(b"%b|%b|%d|%d|%d" % (key, kind.encode(), size, i, right)).digest(n_bytes)
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def _digits(text: str, key: bytes, kind: str, fixed: int = 0) -> str:
    """Permutes all digits but the first ``fixed``; other characters keep their places."""
    own = [c for c in text if c.isascii() and c.isdigit()]
    n = len(own) - fixed
    if n <= 0:
        return text
    new = iter("".join(own[:fixed]) + str(permute(int("".join(own[fixed:])), 10**n, key, kind)).zfill(n))
    return "".join(next(new) if c.isascii() and c.isdigit() else c for c in text)


@functools.lru_cache(maxsize=1 << 12)
def _alphabet(c: str) -> str:
    """The characters that may stand for this one: digits, small or capital letters, or its kind in its own block; none for marks."""
    if c.isascii():
        return DIGITS if c.isdigit() else LETTERS if c.islower() else LETTERS.upper() if c.isupper() else ""
    if not c.isalnum():
        return ""
    first, kind = ord(c) // BLOCK * BLOCK, unicodedata.category(c)
    return "".join(x for x in map(chr, range(max(first, BLOCK), first + BLOCK)) if x.isalnum() and unicodedata.category(x) == kind)


def _characters(text: str, key: bytes, kind: str, hexadecimal: bool = False) -> str:
    """Permutes every letter and digit within its alphabet, all as one number; other characters stay.

    Of a longer text each ``AT_ONCE`` characters are a number of their own. Texts of the same shape get different pseudonyms.
    """
    if len(text) > AT_ONCE:
        parts = [text[i : i + AT_ONCE] for i in range(0, len(text), AT_ONCE)]
        return "".join(_characters(p, key, f"{kind}{i}", hexadecimal) for i, p in enumerate(parts))
    upper = hexadecimal and text.isupper()
    alphabets = [(HEXADECIMAL.upper() if upper else HEXADECIMAL) if hexadecimal and c.isalnum() else _alphabet(c) for c in text]
    value, size = 0, 1
    for c, letters in zip(text, alphabets, strict=True):
        if letters:
            value, size = value * len(letters) + letters.index(c), size * len(letters)
    value, out = permute(value, size, key, kind), []
    for c, letters in zip(reversed(text), reversed(alphabets), strict=True):
        if letters:
            value, at = divmod(value, len(letters))
            c = letters[at]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid card number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def _card(text: str, key: bytes) -> str | None:
    own = re.sub(r"\D", "", text)
    if not 13 <= len(own) <= 19 or luhn(own) % 10 or not int(own):
        return None
    body = str(permute(int(own[:-1]), 10 ** (len(own) - 1), key, "card")).zfill(len(own) - 1)
    new = iter(body + str(-luhn(body + "0") % 10))
    return "".join(next(new) if c.isdigit() else c for c in text)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    own = text.replace(" ", "")
    if not 15 <= len(own) <= 34 or _mod97(own) != 1:
        return None
    body = _characters(own[4:], key, "iban" + own[:2])
    new = iter(own[:2] + str(98 - _mod97(own[:2] + "00" + body)).zfill(2) + body)
    return "".join(c if c == " " else next(new) for c in text)


def _date(year: int, month: int, day: int, key: bytes) -> datetime.date | None:
    try:
        at = datetime.date(year, month, day).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= at <= LAST_DAY - FIRST_DAY:
        return None
    return datetime.date.fromordinal(FIRST_DAY + permute(at, LAST_DAY - FIRST_DAY + 1, key, "date"))


def _split_date(text: str, sep: str, key: bytes) -> str | None:
    """Day first with dots; with slashes month first, or day first where only that is a date."""
    a, b, year = map(int, text.split(sep))
    day_first = sep == "." or a > 12
    new = _date(year, b, a, key) if day_first else _date(year, a, b, key)
    if new is None:
        return None
    first, second = (new.day, new.month) if day_first else (new.month, new.day)
    if sep == "/" and day_first != (first > 12) and day_first:
        first, second = new.month, new.day  # stays a valid date in either reading
    return f"{first:02d}{sep}{second:02d}{sep}{new.year}"


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at, serial = divmod(permute(at, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(at, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ipv4(text: str, key: bytes) -> str | None:
    try:
        at = int(ipaddress.IPv4Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv4Address(permute(at, 1 << 32, key, "ipv4")))


def _phone(text: str, key: bytes) -> str | None:
    own = "".join(c for c in text if c.isdigit())
    if not 8 <= len(own) <= 15:
        return None
    country = 0 if text[0] != "+" else 1 if own[0] in "17" else 2 if own[:2] in TWO_DIGIT_COUNTRIES else 3
    return _digits(text, key, "phone", country)


def _number(m: re.Match, key: bytes) -> tuple[str, int] | None:
    """(pseudonym, length of what it stands for); of a card, an IBAN or a phone number the longest valid prefix of whole tokens."""
    kind, text = m.lastgroup, m.group()
    if kind == "sep" or m["date"]:
        new = _split_date(text, m["sep"], key)
    elif kind == "iso":
        day = _date(int(text[:4]), int(text[5:7]), int(text[8:]), key)
        new = day and day.isoformat()
    elif kind in ("ipv4", "ssn"):
        new = {"ipv4": _ipv4, "ssn": _ssn}[kind](text, key)
    else:
        change = {"iban": _iban, "phone": _phone, "card": _card}[kind]
        gaps = list(re.finditer(r"[ .\-]+", text))
        for end in [len(text), *(s.start() for s in reversed(gaps))]:
            if kind == "phone" and gaps and end == gaps[-1].start() and any(_card_at(m.string, m.start() + s.end(), key) for s in gaps):
                return None
            if (new := change(text[:end], key)) is not None:
                return new, end
    return None if new is None else (new, len(text))


def _card_at(text: str, at: int, key: bytes) -> bool:
    m = NUMBER.match(text, at)
    return bool(m and m.lastgroup == "card" and _number(m, key))


def _numbers(text: str, key: bytes, kinds: list[str]) -> str:
    """All numbers replaced. After one that is not valid the search goes on at its next token."""
    parts, done, at = [], 0, 0
    while m := NUMBER.search(text, at):
        new = _number(m, key)
        if new is None:
            gap = re.search(r"[ \-]", m.group())
            at = m.start() + gap.end() if gap else m.end()
            continue
        kinds.append("date" if m.lastgroup in ("iso", "sep") or m["date"] else m.lastgroup)
        parts += [text[done : m.start()], new[0]]
        done = at = m.start() + new[1]
    return "".join([*parts, text[done:]])


def _local(c: str) -> bool:
    return c.isalnum() or c in "_.%+-"


def _small(c: str) -> str:
    return low if len(low := c.lower()) == 1 else c


def _address(local: str, domain: str, key: bytes) -> str:
    """Both parts permuted as small letters, then with capitals in the same places; characters whose other case is longer stay as they are."""
    text = f"{local}@{domain}"
    small = "".join(map(_small, text))
    new = _characters(small, key, "email")
    return "".join(up if a != b and len(up := c.upper()) == 1 else c for a, b, c in zip(text, small, new, strict=True))


def _addresses(text: str, key: bytes, kinds: list[str]) -> str:
    """All e-mail addresses replaced. Each @ is looked at once, and from it to both sides, so time is linear in the text.

    Of a longer run of characters before the @ the last ``LOCAL_PART`` belong to the address.
    """
    parts, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and at - begin < LOCAL_PART and _local(text[begin - 1]):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at)):
            kinds.append("email")
            parts += [text[done:begin], _address(text[begin:at], m[1], key), m[2]]
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return "".join([*parts, text[done:]]) if parts else text


def pseudonymise(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kinds of the values replaced, in order of the passes."""
    kinds: list[str] = []

    def secret(m: re.Match) -> str:
        value = m[1] or m.group()
        if m[1] and not (any(c.isdigit() for c in value) or len(value) >= 20):
            return m.group()
        kinds.append("secret")
        one_case = value.isupper() or value == value.lower()
        new = _characters(value, key, "secret", hexadecimal=one_case and bool(re.fullmatch(r"[0-9A-Fa-f]+", value)))
        return m.group()[: m.start(1) - m.start()] + new if m[1] else value[:4] + _characters(value[4:], key, "secret")

    text = _addresses(text, key, kinds)
    if "=" in text or ":" in text or any(x in text for x in ("AKIA", "ASIA", "ghp_", "sk-", "xox")):
        text = SECRET.sub(secret, text)
    if re.search(r"\d", text):
        text = _numbers(text, key, kinds)
    return text, kinds


def with_pseudonyms(docs: DataFrame, key: str, text: str = "text", n_values: str = "n_values", kinds: str = "kinds") -> DataFrame:
    """The rows with ``text`` replaced, plus the number of values and the sorted kinds found.

    Kinds: card (Luhn), IBAN (mod 97), SSN (valid areas), IPv4, dates of 1900 to 2099, phone numbers,
    e-mail addresses, secrets. A number of which no run of whole tokens is valid stays. The same value has the same
    pseudonym in every document under one ``key``, which is needed to link and never stored.
    A null text stays null with 0 values; an empty one stays empty. Other columns pass through,
    but columns named like the two new ones are replaced. Repeated rows stay. Time is linear in a text's length.
    """
    spelled = {c.lower(): c for c in docs.columns}
    rest = [c for c in docs.columns if c.lower() not in (n_values.lower(), kinds.lower())]
    at = rest.index(spelled[text.lower()])
    secret = key.encode()

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if (t := x.as_py()) is None else pseudonymise(t, secret) for x in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            columns += [pa.array([len(k) for _, k in done], pa.int32()), pa.array([sorted(set(k)) for _, k in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*rest, n_values, kinds])

    fields = ", ".join(f"`{f.name}` {'string' if f.name == rest[at] else f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in rest]).schema)
    return docs.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, f"{fields}, `{n_values}` int, `{kinds}` array<string>")
