"""Format-preserving pseudonyms for personal numbers and dates.

Values are found by pattern, validated (card numbers by Luhn's check digit, IBANs by remainder 97, social security
numbers by their ranges, telephone numbers by their plan, addresses by their octets, dates by the calendar) and then
permuted within their format: a keyed Feistel network over the value's own domain, by cycle walking where the domain
isn't a product. A pseudonym is valid where its value was, keeps its separators and length, and equal values get equal
pseudonyms in all documents, so records stay linked. Without the key it can't be undone; with it, ``restore`` does.

Kinds: ``card``, ``iban``, ``ssn``, ``phone``, ``ip``, ``date`` and ``email`` (the letters and digits of the local part).
One date in several notations gets one pseudonym date. Numbers that fail validation are left alone.

Cases: null texts stay null, empty ones empty; a text of any length is read whole; matches don't overlap, the leftmost
counts and then the kind first in the list above; a number that follows a card number or an IBAN isn't part of it; where
a match isn't valid, the search goes on just after its first character; rows that repeat each get their own result.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import arrow_map

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email")
_ROUNDS = 8
_PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("date", r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?![\w-])|(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w)|(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("phone", r"(?<![\w+])\+1[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ -]?(?:\(\d{2,4}\)|\d{2,4})(?:[ -]?\d{2,4}){1,4}(?!\w|\.\d)|(?<![\w(])\(\d{3}\) \d{3}-\d{4}(?!\w)"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w)"),
)
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PATTERNS), re.ASCII)
_MAYBE = re.compile(r"[0-9@]")
#: Characters of an IBAN by country.
_IBAN_SIZE = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in names.split()
}
_FIRST_DAY, _LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _candidates(kind: str, value: str, again: bool) -> list[str]:
    """The values that a match may stand for, in order: what it swallowed after a card number or an IBAN is cut off at a boundary.

    Of cards the shortest valid one counts; one that is cut, or begins within a match that failed (``again``), has no group
    but the last of under three digits, so that rows of small numbers aren't read as cards. An IBAN's country has its length."""
    if kind not in ("card", "iban"):
        return [value]
    cut = [value[: m.start()] for m in re.finditer("[ -]", value)]
    if kind == "iban":
        size = _IBAN_SIZE.get(value[:2])
        return [v for v in cut if len(v.replace(" ", "")) == size or size is None] + [value]
    alike = lambda v: all(len(g) >= 3 for g in re.split("[ -]", v)[:-1])
    cut = [v for v in cut if sum(map(str.isdigit, v)) >= 13 and alike(v)]
    return cut + ([value] if not again or alike(value) else [])


class Feistel:
    """Keyed permutations of 0 .. n - 1: an alternating Feistel network over two factors that cover the domain, with cycle walking."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, half: int, modulus: int) -> int:
        data = f"{tweak}|{i}|{half}".encode()
        size = max(8, (modulus.bit_length() + 7) // 8 + 8)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, size)).digest(), "big") % modulus

    def permute(self, value: int, n: int, tweak: str, inverse: bool = False) -> int:
        if n < 2:
            return value
        left_n = 1 << (n.bit_length() + 1) // 2
        right_n = -(-n // left_n)
        while True:
            left, right = value // right_n, value % right_n
            for i in reversed(range(_ROUNDS)) if inverse else range(_ROUNDS):
                sign = -1 if inverse else 1
                if i % 2:
                    right = (right + sign * self._round(tweak, i, left, right_n)) % right_n
                else:
                    left = (left + sign * self._round(tweak, i, right, left_n)) % left_n
            value = left * right_n + right
            if value < n:
                return value

    def walk(self, value: int, n: int, tweak: str, inverse: bool, valid) -> int:
        while True:
            value = self.permute(value, n, tweak, inverse)
            if valid(value):
                return value


def luhn_digit(digits: str) -> str:
    """The check digit of a number without one."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _refill(template: str, symbols: str) -> str:
    """The template with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in template)


def _mixed(symbols: str, permute, tweak: str) -> str:
    """Permute a string within the class (digit, upper, lower) of each of its symbols."""
    value, n = 0, 1
    kinds = []
    for c in symbols:
        base, low = (10, "0") if c.isdigit() else (26, "A") if c.isupper() else (26, "a")
        kinds.append((base, low))
        value, n = value * base + ord(c) - ord(low), n * base
    value = permute(value, n, f"{tweak}:{''.join(str(b) + low for b, low in kinds)}")
    out = []
    for base, low in reversed(kinds):
        value, digit = divmod(value, base)
        out.append(chr(ord(low) + digit))
    return "".join(reversed(out))


class Pseudonymizer:
    """pseudonym(kind, value) -> another value of the kind and format, or None where the value isn't valid."""

    def __init__(self, key: bytes, inverse: bool = False, memo: int = 200_000):
        self.net, self.inverse = Feistel(key), inverse
        self.pseudonym = lru_cache(memo)(self._pseudonym)

    def _permute(self, value: int, n: int, tweak: str) -> int:
        return self.net.permute(value, n, tweak, self.inverse)

    def _pseudonym(self, kind: str, value: str) -> str | None:
        return getattr(self, f"_{kind}")(value)

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        # the first digit names the issuer's kind and stays
        body = f"{self._permute(int(digits[1:-1]), 10 ** (len(digits) - 2), f'card:{len(digits)}:{digits[0]}'):0{len(digits) - 2}d}"
        return _refill(value, digits[0] + body + luhn_digit(digits[0] + body))

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        account = _mixed(plain[4:], self._permute, f"iban:{plain[:2]}")
        return _refill(value, plain[:2] + _iban_check(plain[:2], account) + account)

    def _ssn(self, value: str) -> str | None:
        ok = lambda v: v // 10**6 not in (0, 666) and v < 900 * 10**6 and v // 10**4 % 100 and v % 10**4
        number = int(value.replace("-", ""))
        return _refill(value, f"{self.net.walk(number, 10**9, 'ssn', self.inverse, ok):09d}") if ok(number) else None

    def _phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        # the country code is what stands before the first separator; in +1 numbers area codes and exchanges begin with 2 to 9
        code = re.match(r"\+(\d{1,3}?)(?=[ (-])", value)
        code = code[1] if code else "" if value[0] != "+" else digits[: 1 if digits[0] in "17" else 2]
        rest = digits[len(code) :]
        if not 7 <= len(rest) <= 12 or len(digits) > 15:
            return None
        north = code in ("", "1") and len(rest) == 10
        ok = (lambda v: v >= 2 * 10**9 and v // 10**6 % 10 >= 2) if north else (lambda v: True)
        if north and not (rest[0] >= "2" and rest[3] >= "2"):
            return None
        tweak = "phone:1:10" if north else f"phone:{code}:{len(rest)}"
        return _refill(value, code + f"{self.net.walk(int(rest), 10 ** len(rest), tweak, self.inverse, ok):0{len(rest)}d}")

    def _ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        n = self._permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _date(self, value: str) -> str | None:
        a, b, c = (int(x) for x in re.split(r"\D", value))
        year, month, day = (a, b, c) if "-" in value else (c, b, a) if "." in value else (c, a, b)
        try:
            n = dt.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= n <= _LAST_DAY:
            return None
        d = dt.date.fromordinal(_FIRST_DAY + self._permute(n - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date"))
        return d.isoformat() if "-" in value else f"{d.day:02d}.{d.month:02d}.{d.year}" if "." in value else f"{d.month:02d}/{d.day:02d}/{d.year}"

    def _email(self, value: str) -> str | None:
        local, _, domain = value.partition("@")
        symbols = "".join(c for c in local if c.isalnum())
        return f"{_refill(local, _mixed(symbols, self._permute, f'email:{domain.lower()}'))}@{domain}"

    def text(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int, str]]]:
        """The text with its values replaced, and (kind, begin, end, pseudonym) in places of the input."""
        if not text or not _MAYBE.search(text):
            return text, []
        found, parts, at, start = [], [], 0, 0
        failed = 0  # end of a match that failed: what begins before it is looked at anew
        while m := _FIND.search(text, start):
            for value in _candidates(m.lastgroup, m[0], m.start() < failed):
                if (new := self.pseudonym(m.lastgroup, value)) is not None:
                    end = m.start() + len(value)
                    found.append((m.lastgroup, m.start(), end, new))
                    parts += [text[at : m.start()], new]
                    at = start = end
                    break
            else:
                start, failed = m.start() + 1, max(failed, m.end())
        return ("".join(parts) + text[at:] if found else text), found


def restore(text: str | None, key: bytes, entities: list[tuple[str, int, int, str]] | None = None) -> str | None:
    """The text from which a pseudonymised one was made (dates with one-digit days or months come back with two).

    Where numbers stand side by side, a pseudonym and its neighbour can look like another number: with the ``entities``
    of the text, each value is taken from its very place."""
    own = Pseudonymizer(key, inverse=True)
    if text is None or entities is None:
        return own.text(text)[0]
    parts, at, shift = [], 0, 0
    for kind, begin, end, new in entities:
        parts += [text[at : begin + shift], own.pseudonym(kind, new)]
        at = begin + shift + len(new)
        shift += len(new) - (end - begin)
    return "".join(parts) + text[at:]


def pseudonymize(documents: DataFrame, key: str | bytes) -> DataFrame:
    """doc_id, text (replaced), n_found, entities (kind, begin, end, pseudonym) for each row of documents.

    Who has the key can undo the pseudonyms: it has no default, and belongs in a store of secrets."""
    if not key:
        raise ValueError("a key is needed")
    secret = key.encode() if isinstance(key, str) else key
    memo: dict[bytes, Pseudonymizer] = {}

    def each(cols: dict[str, list]) -> dict[str, list]:
        own = memo.setdefault(secret, Pseudonymizer(secret)) if secret not in memo else memo[secret]
        done = [own.text(t) for t in cols["text"]]
        keys = ("kind", "begin", "end", "pseudonym")
        return {"doc_id": cols["doc_id"], "text": [t for t, _ in done], "entities": [[dict(zip(keys, e, strict=True)) for e in found] for _, found in done]}

    out = arrow_map(documents.select("doc_id", "text"), each, "doc_id long, text string, entities array<struct<kind: string, begin: int, end: int, pseudonym: string>>")
    return out.select("doc_id", "text", F.size("entities").cast("int").alias("n_found"), "entities")
