"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

Values that pass their format's check (Luhn digit and issuer, calendar, octets,
address ranges, check sum, numbering plans) are replaced by another value of the
same format. The replacement is a keyed permutation of all values of the format,
so equal values get equal pseudonyms in every document, different values never
meet, and the owner of the key can restore them. No value is its own pseudonym.

The permutation P of 0..n-1 is a balanced Feistel network on the next even number
of bits, walked until the value is below n; the pseudonym of x is
P^-1(P(x) + k mod n) with a keyed k between 1 and n - 1.

All kinds are found in the text as it came, none within another: an address
before a secret, then account number (IBAN), IPv6 address and other numbers.
What is linked: e-mail local parts that differ in case only; a North American
number with or without +1 or 1; a national number with or without brackets; a
number with or without (0) after its country code; an IPv6 address in short or
full form; a card number in any grouping; an IBAN in one piece or in groups.

Numbers beside each other stay apart: a phone number after a + or a trunk 0 has
the digits of its country's plan at most, and whole groups. Where a plan leaves the
length open (Germany's 8 to 11), a group that fits counts as part of the number.

Numbers of 16 digits are accounts whatever their check digit: account numbers of
the corpora have none, and a miss would be a leak. The distance from the check
digit stays. Other lengths of 13 to 19 digits need a valid check digit and an
issuer's first digits; what has their shape but is none is left whole.

Defined results: a null text stays null; texts without such values come back as
they are, byte for byte; values are found in whole texts; each occurrence counts;
an IPv6 address in mixed case is restored in small letters; other columns pass
through untouched, whatever their names; repeated rows each get their text.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briarlake.llm.text import fresh, named, small_batches

#: For tests and test tables only; production sets KEY_SETTING from a secret store.
KEY = b"briarlake demonstration key"
KEY_SETTING = "spark.briarlake.pseudonym.key"
KINDS = ("email", "account", "phone", "ssn", "ip", "day", "iban", "secret")
ROUNDS = 8


class Permutation:
    """Keyed permutation of 0..size-1 without fixed points (size of 2 or more)."""

    def __init__(self, key: bytes, domain: str, size: int):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.seed = hashlib.blake2b(domain.encode() + b"\0%d" % size, key=key[:64], digest_size=32).digest()
        self.shift = 1 + int.from_bytes(self._digest(b"shift")) % (size - 1)

    def _digest(self, data: bytes) -> bytes:
        return hashlib.blake2b(data, key=self.seed, digest_size=64).digest()

    def _round(self, k: int, value: int) -> int:
        return int.from_bytes(self._digest(b"%d:%x" % (k, value))) & self.mask

    def _walk(self, value: int, order: range) -> int:
        while True:
            left, right = value >> self.half, value & self.mask
            if order.step > 0:
                for k in order:
                    left, right = right, left ^ self._round(k, right)
            else:
                for k in order:
                    left, right = right ^ self._round(k, left), left
            value = left << self.half | right
            if value < self.size:
                return value

    def move(self, value: int, back: bool = False) -> int:
        ahead = self._walk(value, range(ROUNDS))
        return self._walk((ahead + (-self.shift if back else self.shift)) % self.size, range(ROUNDS - 1, -1, -1))


@lru_cache(4096)
def _permutation(key: bytes, domain: str, size: int) -> Permutation:
    return Permutation(key, domain, size)


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def luhn(payload: str) -> int:
    """The check digit that makes payload plus digit valid."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(payload)))
    return -total % 10


def session_key(spark: SparkSession) -> bytes:
    """The session's key; that of the tests if it has none."""
    return (spark.conf.get(KEY_SETTING, None) or KEY.decode()).encode()


Move = Callable[[str, int, int], int]
"""(domain, size, value) to the value's pseudonym."""


def _number(move: Move, domain: str, digits: str) -> str:
    return str(move(f"{domain}{len(digits)}", 10 ** len(digits), int(digits))).zfill(len(digits))


#: First digits of issuers whose card numbers have 13, 14, 15 or 17 to 19 digits.
_ISSUERS = {13: ("4",), 14: ("30", "36", "38", "39"), 15: ("34", "37"), 17: ("5", "6"), 18: ("5", "6"), 19: ("4", "5", "6")}


def _account(move: Move, value: str) -> str | None:
    """16 digits keep their distance from the check digit; other lengths keep two digits and are valid before and after."""
    digits = _digits(value)
    offset = int(digits[-1]) - luhn(digits[:-1])
    if len(digits) == 16:
        payload = _number(move, "account", digits[:-1])
    elif offset == 0 and digits.startswith(_ISSUERS[len(digits)]):
        payload = digits[:2] + _number(move, f"account{digits[:2]}", digits[2:-1])
    else:
        return None
    return _refill(value, payload + str((luhn(payload) + offset) % 10))


#: Country codes of two digits; 1 and 7 have one, all others three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: First two digits of country codes of three digits.
_THREE = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())


def _north_american(move: Move, digits: str) -> str:
    """Numbers whose area and exchange are 200 or more stay such, the others stay others, with or without a 0 in front."""
    area, exchange, line = int(digits[:3]), int(digits[3:6]), int(digits[6:])
    if area >= 200 and exchange >= 200:
        moved, line = divmod(move("nanp", 800 * 800 * 10**4, ((area - 200) * 800 + exchange - 200) * 10**4 + line), 10**4)
        return f"{moved // 800 + 200}{moved % 800 + 200}{line:04d}"
    trunk = digits[0] == "0"
    while True:
        digits = _number(move, "unassigned", digits)
        if (digits[0] in "01" or digits[3] in "01") and (digits[0] == "0") == trunk:
            return digits


#: Fewest and most digits of a number after its country code, by the countries' plans; 7 and 12 for others.
_PLANS = {
    "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (8, 11), "40": (9, 9), "41": (9, 9), "43": (8, 12), "44": (9, 10), "45": (8, 8), "46": (8, 9), "47": (8, 8), "48": (9, 9), "49": (8, 11),
    "52": (10, 10), "54": (10, 11), "55": (10, 11), "57": (8, 10), "60": (8, 10), "61": (9, 9), "62": (8, 12), "63": (8, 10), "64": (8, 10), "65": (8, 8), "66": (8, 9), "81": (9, 10), "82": (8, 10), "84": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "92": (9, 10), "98": (10, 10),
    "351": (9, 9), "352": (8, 9), "353": (8, 9), "358": (8, 10), "359": (8, 9), "370": (8, 8), "371": (8, 8), "372": (7, 8), "380": (9, 9), "385": (8, 9), "386": (8, 8), "420": (9, 9), "421": (9, 9), "852": (8, 8), "886": (8, 9), "966": (8, 9), "971": (8, 9), "972": (8, 9),
}
#: Of a national number, with its trunk 0; of one written in pairs throughout.
_NATIONAL, _PAIRS = (9, 11), 10
_GROUP = re.compile(r"( ?/ ?| - | ?\(|[ .-]?)(\d+)(\)?)", re.ASCII)
_AFTER = re.compile(r"(?![\w/@]|[.-]\d)(?!(?::[0-9A-Fa-f]{1,4}){0,6}::|(?::[0-9A-Fa-f]{1,4}){7})", re.ASCII)


def _code(digits: str) -> str:
    """The country code in front of digits; none if there is none."""
    return digits[:1] if digits[:1] in ("1", "7") else digits[:2] if digits[:2] in _TWO else digits[:3] if digits[:2] in _THREE else ""


def _phone_end(text: str, start: int, limit: int) -> int | None:
    """Where the number that begins at `start`, with + or a trunk 0, ends; None if none does.

    A number is made of whole groups and of no more digits than its plan has, so
    what stands beside it is left to itself. Past the fewest digits a group of
    one or two belongs to it only if the group before is as long. Of the ends
    that remain the last counts. Only lengths, the code and the 0 decide, which
    pseudonyms keep.
    """
    groups, at = [], start
    if text[start] == "+":
        head = re.compile(r"\+(\d+)").match(text, start, limit)
        code = _code(head[1]) if head else ""
        if not code or code == "1":
            return None
        least, most = _PLANS.get(code, (7, 12))
        at = start + 1 + len(code)
        trunk = re.compile(r" ?\(0\)").match(text, at, limit)
        at = trunk.end() if trunk else at
    else:
        least, most = _NATIONAL
    used, pairs, ends, slash = 0, True, [], 0
    while (m := _GROUP.match(text, at, limit)) and m.end() > at:
        mark, digits = m[1].strip(), m[2]
        if mark == "(" and len(groups) > 0 or (mark == "(") != bool(m[3]) or m[1] == "" and groups and not m[3] and text[at - 1] != ")":
            break
        slash += mark == "/" or m[1] == " - "
        if slash > 1 or slash and len(groups) > 1 and (mark == "/" or m[1] == " - "):
            break
        if used >= least and len(digits) < 3 and groups and len(digits) != groups[-1]:
            break
        used += len(digits)
        if used > most:
            break
        groups.append(len(digits))
        pairs = pairs and len(digits) == 2
        at = m.end()
        if used >= least and _AFTER.match(text, at) and (text[start] == "+" or not pairs or used == _PAIRS):
            ends.append(at)
        if pairs and text[start] != "+" and used >= _PAIRS:
            break
    return ends[-1] if ends else None


def _phone(move: Move, value: str) -> str | None:
    """The country code after a + and the trunk 0 of a national number stay, and so does a (0) after the code."""
    digits = _digits(value)
    if value[0] == "+":
        code = _code(digits)
        rest = digits[len(code) :]
        if not code or not 8 <= len(digits) <= 15 or code == "1" and len(rest) != 10:
            return None
        trunk = re.match(rf"\+{code} ?\(0\)", value)
        if trunk:
            return trunk[0] + _refill(value[trunk.end() :], _number(move, f"phone{code}:", rest[1:]))
        return _refill(value, code + (_north_american(move, rest) if code == "1" else _number(move, f"phone{code}:", rest)))
    if digits[0] == "0" and (value[0] == "(" or _phone_end(value, 0, len(value)) == len(value)):
        return _refill(value, "0" + _number(move, "phone", digits[1:]))
    if len(digits) == 10 or len(digits) == 11 and digits[0] == "1":
        return _refill(value, digits[:-10] + _north_american(move, digits[-10:]))
    while True:
        digits = _number(move, "local", digits)
        if digits[0] != "0" and (len(digits) != 11 or digits[0] != "1"):
            return _refill(value, digits)


#: Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
_SSN = (898, 99, 9999)


def _ssn(move: Move, value: str) -> str | None:
    area, group, serial = map(int, value.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    index = ((area - 1 - (area > 666)) * _SSN[1] + group - 1) * _SSN[2] + serial - 1
    index, serial = divmod(move("ssn", _SSN[0] * _SSN[1] * _SSN[2], index), _SSN[2])
    area, group = divmod(index, _SSN[1])
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(move: Move, value: str) -> str | None:
    """Octets keep their widths' validity: 0 to 255 without leading zeros."""
    parts = value.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    moved = move("ip", 1 << 32, int.from_bytes(bytes(map(int, parts))))
    return ".".join(map(str, moved.to_bytes(4)))


#: Ranges of IPv6 addresses that name a host: base and free bits.
_V6 = ((0x2000 << 112, 125), (0xFC00 << 112, 121), (0xFE80 << 112, 118))


def _ip6(move: Move, value: str) -> str | None:
    """Addresses stay in their range, and keep being or not being the same in short and full form."""
    upper, value = value.upper() == value != value.lower(), value.lower()
    try:
        number = int(IPv6Address(value))
    except AddressValueError:
        return None
    found = next(((base, bits) for base, bits in _V6 if number >> bits == base >> bits), None)
    if found is None:
        return None
    base, bits = found
    forms = lambda n: (IPv6Address(n).compressed, IPv6Address(n).exploded)
    own = forms(number)
    if value in own:
        plain = own[0] == own[1]
        while True:
            number = base | move(f"ip6:{bits}:{plain}", 1 << bits, number & ((1 << bits) - 1))
            made = forms(number)
            if (made[0] == made[1]) == plain:
                value = made[own.index(value)]
                break
    else:  # another spelling: its digits after the first group, as long as it stays one
        head, colon, tail = value.partition(":")
        places = [k for k, c in enumerate(tail) if c in "0123456789abcdef"]
        shape, digits = "".join("0" if c != ":" else c for c in tail), "".join(tail[k] for k in places)
        while True:
            digits = f"{move(f'ip6:{shape}', 1 << 4 * len(places), int(digits, 16)):0{len(places)}x}"
            left = iter(digits)
            value = head + colon + "".join(c if c == ":" else next(left) for c in shape)
            if value not in forms(int(IPv6Address(value))) and (not upper or value.upper() != value):
                break
    return value.upper() if upper else value


def _is_day(year: int, month: int, day: int) -> bool:
    try:
        date(year, month, day)
    except ValueError:
        return False
    return True


def _day_key(value: str) -> tuple | None:
    """(order, separator, widths) of a valid date of 1900 to 2099: the format within which it moves."""
    a, b, c = re.split(r"[-./]", value)
    separator = next(x for x in value if not x.isdigit())
    if len(a) == 4:
        return ("ymd", separator, len(b), len(c)) if 1900 <= int(a) < 2100 and _is_day(int(a), int(b), int(c)) else None
    if not 1900 <= int(c) < 2100:
        return None
    if _is_day(int(c), int(b), int(a)):
        return "dmy", separator, len(a), len(b)
    return ("mdy", separator, len(a), len(b)) if _is_day(int(c), int(a), int(b)) else None


@lru_cache(64)
def _days(key: tuple) -> tuple[list[str], dict[str, int]]:
    """All dates of one format, at most 73,049."""
    order, separator, first, second = key
    out = []
    for year in range(1900, 2100):
        for month in range(1, 13):
            for day in range(1, 32):
                wide, narrow = {"ymd": (month, day), "dmy": (day, month), "mdy": (month, day)}[order]
                if _is_day(year, month, day) and (first == 2 or wide < 10) and (second == 2 or narrow < 10):
                    pair = [str(wide).zfill(first), str(narrow).zfill(second)]
                    text = separator.join([str(year), *pair] if order == "ymd" else [*pair, str(year)])
                    if _day_key(text) == key:
                        out.append(text)
    return out, {x: k for k, x in enumerate(out)}


def _day(move: Move, value: str) -> str | None:
    key = _day_key(value)
    if key is None:
        return None
    days, place = _days(key)
    return days[move(f"day{key}", len(days), place[value])]


def _folded(c: str) -> str:
    """The small letter of a letter that has exactly one small and one capital form; others stay."""
    low = c.lower()
    return low if len(low) == 1 and len(up := low.upper()) == 1 and up != low and up.lower() == low and c in (low, up) else c


@lru_cache(1)
def _alphabets() -> dict[tuple[str, int], str]:
    """Letters and digits beyond ASCII by kind and block of 256, of pairs of cases the small ones; what stands alone in its block is joined by kind."""
    by: dict[tuple[str, int], list[str]] = {}
    for n in range(128, sys.maxunicode + 1):
        c = chr(n)
        if c.isalnum() and _folded(c) == c:
            by.setdefault((_kind(c), n >> 8), []).append(c)
    for kind, block in [x for x, found in by.items() if len(found) < 2]:
        by.setdefault((kind, -1), []).extend(by.pop((kind, block)))
    return {x: "".join(found) for x, found in by.items()}


def _kind(c: str) -> str:
    return "pair" if c.upper() != c and _folded(c.upper()) == c else unicodedata.category(c)


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """The characters among which a letter or digit of folded case moves; none for others."""
    for known in ("0123456789", "abcdefghijklmnopqrstuvwxyz"):
        if c in known:
            return known
    return (_alphabets().get((_kind(c), ord(c) >> 8)) or _alphabets()[_kind(c), -1]) if c.isalnum() else ""


def _mixed(move: Move, domain: str, value: str) -> str | None:
    """Digits stay digits, small and capital letters stay such, in their script; all else stays. None without any."""
    folded = [_folded(c) for c in value]
    bases = [_alphabet(c) for c in folded]
    size = index = 0
    for c, base in zip(folded, bases, strict=True):
        if base:
            size, index = (size or 1) * len(base), index * len(base) + base.index(c)
    if size < 2:
        return None
    index = move(f"{domain}:{''.join(b[0] if b else c for b, c in zip(bases, value, strict=True))}", size, index)
    out = list(value)
    for k in range(len(value) - 1, -1, -1):
        if bases[k]:
            index, digit = divmod(index, len(bases[k]))
            out[k] = bases[k][digit] if folded[k] == value[k] else bases[k][digit].upper()
    return "".join(out)


def _email(move: Move, value: str) -> str | None:
    """The domain stays: it is not a person's. A local part without letters and digits is no person's."""
    local, _, domain = value.rpartition("@")
    moved = _mixed(move, "email", local)
    return moved and f"{moved}@{domain}"


#: Letters and digits of an IBAN by country.
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban(move: Move, value: str) -> str | None:
    """In one piece or in printed groups of four, with the same pseudonym."""
    if " " in value:
        plain = _iban(move, value.replace(" ", ""))
        return plain and " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if number(value[4:] + value[:4]) % 97 != 1:
        return None
    moved = _mixed(move, f"iban{value[:2]}", value[4:])
    return f"{value[:2]}{98 - number(moved + value[:2] + '00') % 97:02d}{moved}"


def _iban_end(text: str, start: int, end: int) -> int | None:
    """Where the grouped IBAN ends that begins at `start`: after as many signs as its country's have."""
    length = _IBAN_LENGTHS.get(text[start : start + 2], 0)
    last = start + length + (length - 1) // 4
    return last if length and last <= end and (last == len(text) or not text[last].isalnum()) else None


def _secret(move: Move, value: str) -> str:
    """Hexadecimal keys, in capitals if they have no small letter."""
    moved = f"{move(f'secret{len(value)}', 1 << 4 * len(value), int(value, 16)):0{len(value)}x}"
    return moved.upper() if value == value.upper() and value != value.lower() else moved


# Fixed formats.
def _marks() -> str:
    """Combining marks, as ranges of a character class: a name in decomposed or Indic script holds some."""
    out: list[list[int]] = []
    for n in range(128, sys.maxunicode + 1):
        if unicodedata.category(chr(n)) in ("Mn", "Mc"):
            if out and out[-1][1] == n - 1:
                out[-1][1] = n
            else:
                out.append([n, n])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


_LOCAL = rf"\w{_marks()}.%+-"
_EMAIL = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]+@(?:[\w-]+\.)+[^\W\d_]{{2,}}(?![A-Za-z0-9_-])")
_NUMBERS = re.compile(
    r"(?<![\w.-])(?:(?:"
    r"(?P<day>\d{4}-\d\d-\d\d|\d\d?\.\d\d?\.\d{4}|\d\d?/\d\d?/\d{4}|\d\d?-\d\d?-\d{4})"
    r"|(?P<ssn>\d{3}-\d\d-\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<account>\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{1,7}|\d{4}(?P<t>[ -])\d{6}(?P=t)\d{4,5})"
    r"|(?P<phone>\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|(?:1[ .-])?\d{3}(?P<u>[ .-])\d{3}(?P=u)\d{4}"
    r"|1?[2-9]\d\d[2-9]\d{6})"
    r")(?:(?![\w]|[.-]\d)|(?=[Tt]\d\d:?\d\d))(?!(?::[0-9A-Fa-f]{1,4}){0,6}::|(?::[0-9A-Fa-f]{1,4}){7})"  # not an IPv6 address's first group
    r"|(?P<run>\+[2-9]\d|0\d))",
    re.ASCII,
)
_MAYBE = re.compile(r"\d[\d().+/ -]{6}")
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:])")
_IBAN = re.compile(r"\b[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}\b|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3}\b)?)")
_SECRET = re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)[\"']?\s*[:=]\s*[\"']?)\b([0-9a-f]{32,128}|[0-9A-F]{32,128})\b")
_HEX = re.compile(r"[0-9a-fA-F]{32}")
_BY_KIND = {"email": _email, "secret": _secret, "iban": _iban, "ip6": _ip6, "day": _day, "ssn": _ssn, "ip": _ip, "account": _account, "phone": _phone}
#: Pattern, group of the value or None if the group's name is the kind, kind, and what a text needs at least.
_FINDERS = (
    (_EMAIL, 0, "email", lambda text: "@" in text),
    (_SECRET, 1, "secret", _HEX.search),
    (_IBAN, 0, "iban", _IBAN.search),
    (_IP6, 0, "ip6", lambda text: "::" in text or text.count(":") > 6),
    (_NUMBERS, None, None, _MAYBE.search),
)


def pseudonymize(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, Counter]:
    """The text with pseudonyms, and how many values of each kind were replaced. `back` restores them."""

    def move(domain: str, size: int, value: int) -> int:
        return _permutation(key, domain, size).move(value, back)

    spans: list[tuple[int, int, str, str]] = []
    for pattern, group, kind, needed in _FINDERS:
        if not needed(text):
            continue
        ends = [0, *(x for a, b, *_ in spans for x in (a, b)), len(text)]
        for a, b in zip(ends[::2], ends[1::2], strict=True):  # the gaps between what is found
            at = a
            while m := pattern.search(text, at, b):
                name = kind or next(k for k in ("day", "ssn", "ip", "account", "phone", "run") if m[k] is not None)
                first, last = m.span(group if group is not None else name)
                at = m.end()
                if name == "run":
                    end = _phone_end(text, first, b)
                    if end is None:
                        continue
                    name, last, at = "phone", end, end
                elif name == "iban" and " " in m[0]:
                    last = at = _iban_end(text, first, m.end()) or m.end()
                if at == b < len(text) or 0 < a == m.start():
                    continue  # touches another value: what it is depends on that
                if (made := _BY_KIND[name](move, text[first:last])) is not None:
                    spans.append((first, last, name, made))
        spans.sort()
    if not spans:
        return text, Counter()
    out, at = [], 0
    for a, b, _, made in spans:
        out += text[at:a], made
        at = b
    return "".join(out) + text[at:], Counter("ip" if x[2] == "ip6" else x[2] for x in spans)


_KIND = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]])


def replace(docs: DataFrame, key: bytes, text: str = "text", back: bool = False, found: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in the text column; with the struct column `found` of the counts by kind if named."""

    @F.arrow_udf(_KIND)
    def moved(texts: pa.Array) -> pa.Array:
        made = [(None, Counter()) if x is None else pseudonymize(x, key, back) for x in texts.to_pylist()]
        columns = [pa.array([x[0] for x in made], pa.string()), *[pa.array([x[1][k] for x in made], pa.int64()) for k in KINDS]]
        return pa.StructArray.from_arrays(columns, names=["text", *[f"n_{k}" for k in KINDS]])

    small_batches(docs.sparkSession)
    made = fresh(docs, "_made")
    columns = [F.col(made)["text"].alias(c) if c == text else named(c) for c in docs.columns if c != found]
    return docs.withColumn(made, moved(named(text))).select(*columns, *([F.col(made).alias(found)] if found else []))


def pseudonyms(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_found and the counts by kind) for every row."""
    found = replace(docs.select(named(doc_id).alias("doc_id"), named(text).alias("text")), key, found="_found")
    counts = [F.col(f"_found.n_{k}").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", "text", sum((F.col(f"_found.n_{k}") for k in KINDS), F.lit(0).cast("long")).alias("n_found"), *counts)
