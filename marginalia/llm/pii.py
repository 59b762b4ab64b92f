"""Pseudonyms for personal data: validated values are permuted within their own format by a keyed Feistel network.

Kinds and what is checked of them:

- email: the local part is permuted by letter and digit, the domain stays;
- card: 13 to 19 digits with a right Luhn digit;
- iban: length and mod 97;
- ssn: US social security numbers, without the areas and groups that are never given out;
- phone: ten digits in groups of 3, 3 and 4, with or without a country code, and international numbers with a plus and 8 to 15 digits; the
  country code stays, the others are permuted.  There is no check digit, and area codes are not looked up;
- ip: IPv4 addresses with numbers up to 255;
- date: real days, in numbers (also before the time of a timestamp) or with an English month in full or of three letters; the
  century stays.  Times of day and dates in words of other languages are left as they are;
- secret: 32 or more hexadecimal digits of both letters and numerals, and keys with one of the PREFIXES, of any length.  Tokens and blocks of other
  forms (JSON web tokens, PEM) are left, as are secrets without a form to know them by.

A value is read into a number below the size of its format, permuted there (a pseudonym is again valid: check digits are
computed anew, dates stay dates), and written with the separators, length and letter case it had.  The permutation depends on the
key and the kind alone, so that equal values get equal pseudonyms in all documents, however they are separated, and
different values different ones; with the key, reveal() undoes it.  A value of more than LONG letters and digits goes through the same kind of network
symbol by symbol, half against half; a key of more than 64 bytes is hashed to 64 first.

The time is linear in the length of a text, also in one word of megabytes.  Null texts stay null, empty ones empty; repeated rows are treated alike; an empty table gives an empty result; all
other columns stay as they are (with counts, columns of the names of the counts are replaced).
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from hashlib import blake2b, shake_256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import documents
from .words import with_columns

ROUNDS = 10
#: Values of more letters and digits aren't read into one number, whose arithmetic would take the square of their length.
LONG = 128
#: The key of the registered query; in production it comes from the caller's key store.
EXAMPLE_KEY = b"marginalia example key"

KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date", "secret")
#: Texts without any of these hold no value of any kind.
HINT = r"[0-9]{2}|@|[0-9]\.[0-9]|[0-9a-fA-F]{32}|[0-9]/[0-9]|AKIA|ASIA|gh[oprsu]_|github_pat_|glpat-|[rs]k[_-]|xox|AIza"
#: Month names, the prefixes of keys of widespread services, and country codes of one and two digits (all others have three).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: May is the same in full and short, and counts as the full one.
SHORT_MONTHS = tuple(m[:3] for m in MONTHS if m != "May")
PREFIXES = ("AKIA", "ASIA", "gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "rk_live_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "AIza")
COUNTRY_1 = ("1", "7")
COUNTRY_2 = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)

PATTERN = re.compile(
    rf"""
    (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{{2,}})
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))
  | (?P<secret>(?<![A-Za-z0-9])[0-9A-Fa-f]{{32,}}+(?![A-Za-z0-9])|(?<![A-Za-z0-9_-])(?:{"|".join(PREFIXES)})[A-Za-z0-9_-]{{16,}}+)
  | (?P<card>(?<![0-9A-Za-z])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})(?![0-9A-Za-z]))
  | (?P<phone>(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ ]?|(?<![0-9A-Za-z])[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}(?![0-9A-Za-z])
      |(?<![0-9A-Za-z+])\+[1-9][0-9]{{0,14}}(?:[ .-]?\(?[0-9]{{1,6}}\)?){{0,6}}(?![0-9A-Za-z]|[/.:-][0-9]))
  | (?P<ssn>(?<![0-9A-Za-z-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z-]))
  | (?P<ip>(?<![0-9A-Za-z.])(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}(?![0-9A-Za-z]|\.[0-9]))
  | (?P<date>(?<![0-9A-Za-z/.-])(?:[0-9]{{4}}([-/.])[0-9]{{2}}\9[0-9]{{2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}\10[0-9]{{4}})(?:(?=T[0-9]{{2}}:?[0-9]{{2}})|(?![0-9A-Za-z]|[/.-][0-9]))
      |(?<![0-9A-Za-z])(?:[0-9]{{1,2}}\ (?:{"|".join(MONTHS + SHORT_MONTHS)}),?\ [0-9]{{4}}|(?:{"|".join(MONTHS + SHORT_MONTHS)})\ [0-9]{{1,2}},?\ [0-9]{{4}})(?![0-9A-Za-z]))
    """,
    re.VERBOSE | re.ASCII,
)


def _short(key: bytes) -> bytes:
    return key if len(key) <= 64 else blake2b(key).digest()


def _draw(key: bytes, kind: str, turn: int, half: int, bits: int) -> int:
    """A keyed number of so many bits."""
    data = b"%s|%d|%d|" % (kind.encode(), turn, bits) + half.to_bytes(bits // 8 + 1, "big")
    out = b"".join(blake2b(data, key=_short(key), salt=n.to_bytes(4, "big")).digest() for n in range(bits // 512 + 1))
    return int.from_bytes(out, "big") & ((1 << bits) - 1)


def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """The place of `value` in a keyed permutation of 0 .. size - 1 (`back`: the value of a place).
    The network works on an even number of bits; what falls outside is permuted again."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    kind = f"{kind}:{size}"
    while True:
        left, right = value >> half, value & mask
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ _draw(key, kind, turn, left, half), left
            else:
                left, right = right, left ^ _draw(key, kind, turn, right, half)
        value = left << half | right
        if value < size:
            return value


def permute_symbols(values: list[int], bases: list[int], key: bytes, kind: str, back: bool = False) -> list[int]:
    """The same for many symbols, each below its base: either half is moved in turn by a keyed stream of the other, in linear time."""
    v, b = np.array(values, dtype=np.int64), np.array(bases, dtype=np.int64)
    middle = len(v) // 2
    halves = (slice(0, middle), slice(middle, len(v)))
    secret = blake2b(kind.encode(), key=_short(key)).digest()
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        moved, by = halves[turn % 2], halves[1 - turn % 2]
        stream = shake_256(secret + b"%d|%d|" % (turn, len(v)) + v[by].astype("u1").tobytes()).digest(8 * len(v[moved]))
        step = (np.frombuffer(stream, dtype="<u8") % b[moved].astype(np.uint64)).astype(np.int64)
        v[moved] = (v[moved] - step if back else v[moved] + step) % b[moved]
    return v.tolist()


class _Turn:
    """The permutation of a kind, for one number or for many symbols."""

    def __init__(self, kind: str, key: bytes, back: bool):
        self.kind, self.key, self.back = kind, key, back

    def __call__(self, value: int, size: int, form: str = "") -> int:
        return permute(value, size, self.key, self.kind + form, self.back)

    def symbols(self, values: list[int], bases: list[int]) -> list[int]:
        if len(values) > LONG:
            return permute_symbols(values, bases, self.key, self.kind, self.back)
        size, value = 1, 0
        for v, base in zip(values, bases, strict=True):
            size, value = size * base, value * base + v
        value, out = self(value, size), []
        for base in reversed(bases):
            value, r = divmod(value, base)
            out.append(r)
        return out[::-1]


def _luhn(digits: str) -> str:
    """The check digit behind some digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 - i % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def _refill(template: str, symbols: str) -> str:
    """The letters and digits of the template replaced by the symbols, in order."""
    source = iter(symbols)
    return "".join(next(source) if c.isascii() and c.isalnum() else c for c in template)


def _mixed(text: str, turn: _Turn) -> str:
    """Letters stay letters of their case and digits digits; the rest stays."""
    bases = [(10, "0") if c.isdigit() else (26, "a") for c in text if c.isascii() and c.isalnum()]
    symbols = [c for c in text.lower() if c.isascii() and c.isalnum()]
    moved = turn.symbols([ord(c) - ord(first) for (_, first), c in zip(bases, symbols, strict=True)], [n for n, _ in bases])
    made = _refill(text, "".join(chr(ord(first) + r) for (_, first), r in zip(bases, moved, strict=True)))
    return "".join(m.upper() if c.isupper() else m for m, c in zip(made, text, strict=True))


def _email(text, turn):
    local, _, domain = text.rpartition("@")
    return f"{_mixed(local, turn)}@{domain}"


def _card(text, turn):
    digits = re.sub(r"\D", "", text)
    if _luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = str(turn(int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
    return _refill(text, body + _luhn(body))


def _iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in f"{body}{country}00"))
    return str(98 - number % 97).zfill(2)


def _iban(text, turn):
    plain = text.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, body) != check:
        # What follows in capitals may be another word.
        head, _, rest = text.rpartition(" ")
        made = _iban(head, turn) if head else None
        return made and f"{made} {rest}"
    body = _mixed(body, turn)
    return _refill(text, country + _iban_check(country, body) + body)


def _ssn(text, turn):
    a, b, c = map(int, text.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    value = turn((areas.index(a) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999)
    value, c = divmod(value, 9999)
    a, b = divmod(value, 99)
    return f"{areas[a]:03}-{b + 1:02}-{c + 1:04}"


def _phone(text, turn):
    digits = re.sub(r"\D", "", text)
    own = 10
    if text.startswith("+"):
        code = 1 if digits.startswith(COUNTRY_1) else 2 if digits.startswith(COUNTRY_2) else 3
        own = len(digits) - code
        if len(digits) > 15:  # what follows in digits may be another number
            head = re.match(r"(.*[0-9)])([ .-].*)", text)
            made = _phone(head[1], turn) if head else None
            return made and made + head[2]
        if len(digits) < 8:
            return None
    return _refill(text, digits[:-own] + str(turn(int(digits[-own:]), 10**own)).zfill(own))


#: The first number and the count of those with one, two and three digits in an address.
_OCTETS = {1: (0, 10), 2: (10, 90), 3: (100, 156)}


def _ip(text, turn):
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    size, value = 1, 0
    for p in parts:
        first, n = _OCTETS[len(p)]
        size, value = size * n, value * n + int(p) - first
    value, out = turn(value, size), []
    for p in reversed(parts):
        first, n = _OCTETS[len(p)]
        value, r = divmod(value, n)
        out.append(str(first + r))
    return ".".join(reversed(out))


@lru_cache(maxsize=None)
def _days(kind: tuple[bool, bool, bool], months: tuple[int, ...]) -> list[tuple[int, int]]:
    """The (month, day) pairs of a leap year in some months whose spelling shows the same: whether the day can be a month, and which parts have one digit."""
    return [(m, d) for m in months for d in range(1, monthrange(2000, m)[1] + 1) if (d > 12, d > 9, m > 9) == kind]


def _moved(year: int, month: int, day: int, turn, months: tuple[int, ...] = tuple(range(1, 13)), named: bool = False) -> tuple[int, int, int] | None:
    """The pseudonym of a day: another of the same century and spelling (`named`: the month is a word, so its digits don't matter)."""
    try:
        date(year, month, day)
    except ValueError:
        return None
    kind = (day > 12, day > 9, month > 9)
    own = [x for k in (False, True) for x in _days((*kind[:2], k), months)] if named else _days(kind, months)
    century, value = year // 100, own.index((month, day)) * 100 + year % 100
    while True:  # 29 February of a year that has none is permuted again
        value = turn(value, 100 * len(own))
        (month, day), year = own[value // 100], century * 100 + value % 100
        if year and day <= monthrange(year, month)[1]:
            return year, month, day


def _date(text, turn):
    word = re.search("[A-Za-z]+", text)
    if word:
        names = MONTHS if word.group() in MONTHS else SHORT_MONTHS
        months = tuple(k for k, m in enumerate(MONTHS, 1) if (m in names or m[:3] in names) and (names is MONTHS or m != "May"))
        day, year = re.findall("[0-9]+", text)
        made = _moved(int(year), months[names.index(word.group())], int(day), lambda v, n: turn(v, n, f"{len(months)}"), months, named=True)
        if made is None:
            return None
        out = text.replace(word.group(), "\0").replace(year, "\1").replace(day, str(made[2]).zfill(len(day)), 1)
        return out.replace("\0", names[months.index(made[1])]).replace("\1", str(made[0]).zfill(4))
    mark = next(c for c in text if not c.isdigit())
    parts = text.split(mark)
    year_first = len(parts[0]) == 4
    year, month, day = map(int, parts if year_first else reversed(parts))
    swapped = not year_first and month > 12
    if swapped:  # month before day
        month, day = day, month
    made = _moved(year, month, day, turn)
    if made is None:
        return None
    order = made if year_first else (made[1], made[2], made[0]) if swapped else (made[2], made[1], made[0])
    return mark.join(str(v).zfill(len(p)) for v, p in zip(order, parts, strict=True))


def _secret(text, turn):
    prefix = next((p for p in sorted(PREFIXES, key=len, reverse=True) if text.startswith(p)), "")
    if prefix:
        return prefix + _by_class(text[len(prefix) :], turn, (26, "abcdefghijklmnopqrstuvwxyz"))
    if not re.search("[0-9]", text) or not re.search("[A-Fa-f]", text):
        return None
    if text not in (text.lower(), text.upper()):
        return _by_class(text, turn, (6, "abcdef"))
    made = "".join(f"{v:x}" for v in turn.symbols([int(c, 16) for c in text], [16] * len(text)))
    return made.upper() if text.upper() == text else made


def _by_class(text: str, turn: _Turn, letters: tuple[int, str]) -> str:
    """Digits stay digits, and letters letters of their case; marks stay."""
    n, alphabet = letters
    symbols = [c for c in text if c.isalnum()]
    moved = iter(turn.symbols([int(c) if c.isdigit() else alphabet.index(c.lower()) for c in symbols], [10 if c.isdigit() else n for c in symbols]))
    out = []
    for c in text:
        if c.isalnum():
            r = next(moved)
            c = str(r) if c.isdigit() else alphabet[r].upper() if c.isupper() else alphabet[r]
        out.append(c)
    return "".join(out)


_WRITE = {"email": _email, "card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date, "secret": _secret}


def _changed(text: str, key: bytes, back: bool, found: dict[str, int]) -> str:
    def put(match: re.Match) -> str:
        kind = match.lastgroup
        made = _WRITE[kind](match.group(), _Turn(kind, key, back))
        if made is None:
            return match.group()
        found[kind] = found.get(kind, 0) + 1
        return made

    return PATTERN.sub(put, text)


def pseudonymize(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms and how many of each kind."""
    found: dict[str, int] = {}
    return _changed(text, key, False, found), found


def reveal(text: str, key: bytes) -> str:
    """Undoes pseudonymize()."""
    return _changed(text, key, True, {})


def with_pseudonyms(docs: DataFrame, key: bytes, counted: bool = False) -> DataFrame:
    """docs with pseudonyms in text and, if asked for, the columns n_<kind>."""
    new = {"text": T.StringType()} | ({f"n_{k}": T.LongType() for k in KINDS} if counted else {})
    columns = docs.columns

    def run(_, texts):
        likely = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, HINT), False)))
        n = {k: np.zeros(len(texts), dtype=np.int64) for k in KINDS}
        out = texts
        if len(likely):
            changed = []
            for i, t in zip(likely.tolist(), texts.take(pa.array(likely)).to_pylist(), strict=True):
                made, found = pseudonymize(t, key)
                changed.append(made)
                for k, v in found.items():
                    n[k][i] = v
            mask = np.zeros(len(texts), dtype=bool)
            mask[likely] = True
            out = pc.replace_with_mask(texts, pa.array(mask), pa.array(changed, texts.type))
        return {"text": out} | ({f"n_{k}": pa.array(v) for k, v in n.items()} if counted else {})

    return with_columns(docs, "text", run, new).select(*[f"`{c}`" for c in columns if not (counted and c in new and c != "text")], *([f"n_{k}" for k in KINDS] if counted else []))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pseudonyms(documents(spark, sf_dir, "doc_id", "text"), EXAMPLE_KEY, counted=True)
