"""Personal data replaced by format-preserving pseudonyms.

Numbers that pass their own test (card: Luhn; IBAN: mod 97; social security number: ranges;
IPv4: octets; phone: number of digits), valid dates, e-mail addresses, access keys and quoted
secrets are found in whole texts and put through a keyed permutation of their own format: a
Feistel network with cycle walking over exactly the values the format has. Check digits are
computed anew, separators, case and length stay, a date becomes a valid date. The permutation
depends on key and kind only, so equal values get equal pseudonyms in every document and
unequal ones never do, and whoever holds the key can undo it.

A card that stands next to other digits is looked for inside the run of digit groups if the
longest number fails its test, an IBAN by the length of its country. Where the pseudonyms would
be read differently among their neighbours, the next images are taken; only there can equal
values get unequal pseudonyms.

Defined results: a null text stays null, an empty one empty, with no finds; values that fail
their test stay; dates outside 1900-2099 stay; repeated rows get the same result; a hit is
never longer or shorter than its value except an IP address, whose octets vary in width. Very
long texts are searched whole; an empty table gives no rows; columns that are not carried are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt

from pyspark.sql import DataFrame

from .common import column, map_batches, remembered

ROUNDS = 10
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX = "0123456789abcdef"
#: Digits in the groups of a card as it is usually written, if they are not all in one group.
CARDS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 4, 4, 3)}
#: Letters and digits of an IBAN by country.
IBAN_LENGTHS = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in names.split()}

NUMBERS = re.compile(r"""(?<![\w@])(?:
    (?P<iban>[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![\w@]))
  | (?P<date>(?:\d{4}-\d{2}-\d{2}|\d{1,2}(?P<mark>[./-])\d{1,2}(?P=mark)\d{4})(?!\d))
  | (?P<ssn>\d{3}-\d{2}-\d{4}(?![\w@-]))
  | (?P<ip>\d{1,3}(?:\.\d{1,3}){3}(?![\w@]))
  | (?P<card>\d(?:[ -]?\d){12,18}(?![\w@]))
  | (?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}(?![\w@])
      | \(\d{3}\)\ ?\d{3}-\d{4}(?![\w@]) | \d{3}([.-])\d{3}\6\d{4}(?![\w@]))
  | (?P<access>AKIA[0-9A-Z]{16}(?![\w@]))
)""".replace(r"\6", r"(?P=sep)").replace("([.-])", "(?P<sep>[.-])"), re.X)
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}"
                   r"@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
SECRET = re.compile(r"""(?<=[=:\s"'])[0-9a-fA-F]{16,64}(?![0-9A-Za-z])""")
SECRET_NAME = re.compile(r"""(?:password|passwd|token|secret|key)\s*[=:]\s*["']?$""", re.I)
#: Whole groups of digits as far as single blanks and hyphens join them.
RUN = re.compile(r"\d+(?:[ -]\d+(?![\w@]))*")
#: The first group, and more groups with digits: as many as are looked at together.
GROUP = re.compile(r"\w+")
MORE = re.compile(r"(?:[ -]\w*\d\w*(?!\w)){0,30}")
#: No card is written longer: nineteen digits and a mark between any two.
CARD_SPAN = 37


class Permuter:
    """Keyed permutations of the ranges 0 .. n - 1."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, k: int, half: int, width: int) -> int:
        size = max(16, (width.bit_length() + 7) // 8 + 8)
        data = f"{kind}/{n}/{k}/{half}".encode()
        if size <= 64:
            raw = hashlib.blake2b(data, key=self.key, digest_size=size).digest()
        else:
            raw = hashlib.shake_256(self.key + data).digest(size)
        return int.from_bytes(raw, "big") % width

    def _once(self, kind: str, n: int, value: int, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        left, right = divmod(value, b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * self._round(kind, n, k, left, b)) % b
            else:
                left = (left + sign * self._round(kind, n, k, right, a)) % a
        return left * b + right

    def move(self, kind: str, n: int, value: int, back: bool = False,
             valid: Callable[[int], bool] | None = None) -> int:
        """The image of ``value``; steps outside the range or not ``valid`` are walked over."""
        if n < 2:
            return value
        while True:
            value = self._once(kind, n, value, back)
            if value < n and (valid is None or valid(value)):
                return value

    def spell(self, kind: str, text: str, alphabets: list[str], back: bool = False,
              valid: Callable[[str], bool] | None = None) -> str:
        """``text`` permuted among the texts with these alphabets, place by place."""
        total, number = 1, 0
        for c, letters in zip(text, alphabets, strict=True):
            number = number * len(letters) + letters.index(c)
            total *= len(letters)

        def written(x: int) -> str:
            out = []
            for letters in reversed(alphabets):
                x, k = divmod(x, len(letters))
                out.append(letters[k])
            return "".join(reversed(out))

        check = (lambda x: valid(written(x))) if valid else None
        return written(self.move(f"{kind}{len(text)}", total, number, back, check))


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def _fill(pattern: str, new: str) -> str:
    """The letters and digits of ``pattern`` replaced in order, its other marks kept."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def kind_of(m: re.Match) -> str:
    return m.lastgroup if m.lastgroup not in ("mark", "sep") else "date" if m["date"] else "phone"


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _alphabet(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c


class Replacer:
    """Finds and replaces; with ``back`` it puts the original values back."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.permuter, self.back = Permuter(key), back
        self.value = lru_cache(maxsize=100_000)(self._value)

    def _spell(self, kind, text, alphabets, valid=None):
        return self.permuter.spell(kind, text, alphabets, self.back, valid)

    def _digits(self, kind: str, text: str, valid=None) -> str:
        return self._spell(kind, text, [DIGITS] * len(text), valid)

    def _value(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, or None if it fails its test."""
        return getattr(self, f"_{kind}")(text)

    def _card(self, text: str) -> str | None:
        d = re.sub(r"\D", "", text)
        if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        body = d[0] + self._digits("card", d[1:-1],
                                   lambda x: len({d[0], *x, luhn_digit(d[0] + x)}) > 1)
        return _fill(text, body + luhn_digit(body))

    def _iban(self, text: str) -> str | None:
        c = text.replace(" ", "")
        if not 15 <= len(c) <= 34 or iban_digits(c[:2], c[4:]) != c[2:4]:
            return None
        rest = self._spell("iban" + c[:2], c[4:], [_alphabet(x) for x in c[4:]])
        return _fill(text, c[:2] + iban_digits(c[:2], rest) + rest)

    def _ssn(self, text: str) -> str | None:
        d = text.replace("-", "")
        return _fill(text, self._digits("ssn", d, _ssn_valid)) if _ssn_valid(d) else None

    def _ip(self, text: str) -> str | None:
        octets = [int(x) for x in text.split(".")]
        # A leading zero has no place in an address and would not come back.
        if max(octets) > 255 or text != ".".join(map(str, octets)):
            return None
        n = int.from_bytes(bytes(octets), "big")
        return ".".join(map(str, self.permuter.move("ip", 2**32, n, self.back).to_bytes(4, "big")))

    def _phone(self, text: str) -> str | None:
        d = re.sub(r"\D", "", text)
        if not 8 <= len(d) <= 15:
            return None
        # The country code ends at the first mark; without one it is the first digit.
        code = 0
        if text[0] == "+":
            code = len(re.match(r"\+(\d{1,3})(?!\d)|\+(\d)", text)[0]) - 1
        first = d[code]
        low = "23456789" if first in "23456789" else "01"
        rest = self._spell("phone" + d[:code], d[code:], [low] + [DIGITS] * (len(d) - code - 1))
        return _fill(text, d[:code] + rest)

    def _date(self, text: str) -> str | None:
        a, b, c = (int(x) for x in re.split(r"\D", text))
        iso = len(re.match(r"\d+", text)[0]) == 4
        for order in ("ymd",) if iso else ("dmy", "mdy"):
            y, m, d = {"ymd": (a, b, c), "dmy": (c, b, a), "mdy": (c, a, b)}[order]
            try:
                number = (date(y, m, d) - FIRST_DAY).days
            except ValueError:
                continue
            if not 0 <= number < DAYS:
                return None
            widths = [len(x) for x in re.split(r"\D", text)]
            marks = re.sub(r"\d", "", text)

            def write(k: int) -> str | None:
                day = FIRST_DAY + timedelta(k)
                parts = {"y": day.year, "m": day.month, "d": day.day}
                out = [str(parts[p]).zfill(w) for p, w in zip(order, widths, strict=True)]
                fits = [len(x) for x in out] == widths
                # Read again, the text must be this day: d/m/y comes before m/d/y.
                fits &= order != "mdy" or day.day > 12
                return out[0] + marks[0] + out[1] + marks[1] + out[2] if fits else None

            kind = f"date{order}{widths}"
            return write(self.permuter.move(kind, DAYS, number, self.back,
                                            lambda k: write(k) is not None))
        return None

    def _access(self, text: str) -> str | None:
        return text[:4] + self._spell("access", text[4:], [UPPER + DIGITS] * 16)

    def _secret(self, text: str) -> str | None:
        lower, upper = (any(c in letters for c in text) for letters in (LOWER, UPPER))
        if not upper:
            return self._spell("secret", text, [HEX] * len(text))
        if lower:
            return self._spell("mixed", text, [HEX + HEX[10:].upper()] * len(text),
                               lambda x: x.lower() != x != x.upper())

        def valid(x: str) -> bool:
            """Not all digits, and no IBAN, which is found by itself."""
            m = NUMBERS.match(x)
            return not x.isdigit() and not (m and m["iban"] and self._iban(x))
        return self._spell("upper", text, [HEX.upper()] * len(text), valid) if valid(text) else None

    def _email(self, text: str) -> str | None:
        name, _, host = text.lower().rpartition("@")
        labels, _, top = host.rpartition(".")
        new = "@".join(self._spell(k, x, [_alphabet(c) for c in x])
                       for k, x in (("name", name), ("host", labels))) + "." + top
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, text, strict=True))

    def _cards(self, run: str, stop: int) -> tuple[int, int] | None:
        """Where in a run of digit groups a card stands that starts before ``stop``: one written
        as usual, if there is any, then the first and longest."""
        groups = [m.span() for m in re.finditer(r"\d+", run)]
        best = None
        for k, (a, _) in enumerate(groups):
            if a >= stop:
                break
            sizes: tuple[int, ...] = ()
            for x, b in groups[k:]:
                sizes += (b - x,)
                n = sum(sizes)
                if n > 19:
                    break
                if n >= 13:
                    rank = (len(sizes) > 1 and sizes not in CARDS, a, -n)
                    if (best is None or rank < best[0]) and self.value("card", run[a:b]):
                        best = rank, (a, b)
        return best and best[1]

    def _iban_end(self, text: str, a: int, b: int) -> int | None:
        """Where an IBAN of its country's length ends that starts like the match."""
        left = IBAN_LENGTHS.get(text[a:a + 2], 0)
        for k in range(a, b):
            left -= text[k] != " "
            if not left:
                whole = not re.match(r"[\w@]", text[k + 1:k + 2])
                return k + 1 if whole and self.value("iban", text[a:k + 1]) else None
        return None

    def _finds(self, text: str, a: int, b: int) -> list[tuple[int, int, str]]:
        """Start, end and kind of the numbers that hold between two places, in order."""
        out = []
        while (m := NUMBERS.search(text, a)) and m.end() <= b:
            kind, (x, y) = kind_of(m), m.span()
            if kind == "iban":
                y = self._iban_end(text, x, y) or y
            if kind == "card" and self.value(kind, text[x:y]) is None:
                run = RUN.match(text, x, min(b, x + 3 * CARD_SPAN))[0]
                found = self._cards(run, y - x)
                if found:
                    out += self._finds(text, x, x + found[0]) if found[0] else []
                    x, y = x + found[0], x + found[1]
            if self.value(kind, text[x:y]) is not None:
                out.append((x, y, kind))
            elif kind in ("card", "iban"):
                y = GROUP.match(text, x).end()
            a = y
        return out

    def _stretch(self, text: str, a: int, b: int) -> tuple[str, list[str], int]:
        """The text between two places with its numbers replaced, their kinds, and where the
        last of them ends."""
        edge = min(a, 1)
        before, new, after = text[a - edge:a], text[a:b], text[b:b + 1]
        finds = self._finds(before + new + after, edge, edge + b - a)
        while finds:
            parts, at = [], 0
            for x, y, kind in finds:
                parts += [new[at:x - edge], self.value(kind, new[x - edge:y - edge])]
                at = y - edge
            new = "".join([*parts, new[at:]])
            if self._finds(before + new + after, edge, edge + b - a) == finds:
                break
        return new, [kind for *_, kind in finds], a + finds[-1][1] - edge if finds else a

    def _numbers(self, text: str, found: Counter) -> str:
        out, at, a = [], 0, 0
        while m := NUMBERS.search(text, a):
            kind, (x, a) = kind_of(m), m.span()
            if kind == "iban":
                a = self._iban_end(text, x, a) or a
            new = self.value(kind, text[x:a])
            kinds = [kind]
            if new is None:
                new, kinds = text[x:a], []
                if kind in ("card", "iban"):
                    a = MORE.match(text, a).end()
                    # A date may begin with the last group.
                    last = re.search(r"\w+$", text[x:a]).start()
                    n = last and NUMBERS.match(text, x + last)
                    cut = MORE.match(text, a).end() > a
                    a = x + last - 1 if n and kind_of(n) in ("date", "ip") else a
                    new, kinds, done = self._stretch(text, x, a)
                    part = text[x:max(x, a - CARD_SPAN)]
                    mark = max(part.rfind(" "), part.rfind("-"))
                    if cut and mark > 0:
                        # More groups follow; a card that reaches into them is still to be found.
                        a = max(done, x + mark)
                        new = new[:a - x]
            found.update(kinds)
            out += [text[at:x], new]
            at = a
        return "".join([*out, text[at:]])

    def replace(self, text: str) -> tuple[str, Counter]:
        found: Counter = Counter()

        def put(kind: str, old: str) -> str:
            new = self.value(kind, old)
            if new is None:
                return old
            found[kind] += 1
            return new

        if "@" in text:
            text = EMAIL.sub(lambda m: put("email", m[0]), text)
        if not text.isalpha() and any(c in text for c in DIGITS):
            if re.search("password|passwd|token|secret|key", text, re.I):
                text = SECRET.sub(
                    lambda m: put("secret", m[0]) if SECRET_NAME.search(
                        m.string[max(0, m.start() - 24):m.start()]) else m[0], text)
            text = self._numbers(text, found)
        return text, found


@lru_cache(maxsize=4)
def replacer(key: bytes, back: bool = False) -> Replacer:
    """One per key and Python worker, so values met before are remembered."""
    return Replacer(key, back)


remembered(__name__, replacer.cache_clear)


def pseudonymise(docs: DataFrame, key: bytes, id: str = "doc_id", text: str = "text",
                 carry: list[str] | None = None, back: bool = False) -> DataFrame:
    """Per row: doc_id, text with pseudonyms, how many values were replaced and of which kinds
    (``card:1,date:2``). Columns named in ``carry`` are handed on as text."""
    carry = carry or []
    base = docs.select(column(docs, id, "long").alias("doc_id"),
                       column(docs, text, "string").alias("body"),
                       *(column(docs, c, "string").alias(f"c_{c}") for c in carry))

    def work(ids, texts, *carried):
        one = replacer(key, back)
        out: tuple[list, ...] = ([], [], [])
        for t in texts:
            new, found = one.replace(t) if t else (t, Counter())
            out[0].append(new)
            out[1].append(sum(found.values()))
            out[2].append(",".join(f"{k}:{n}" for k, n in sorted(found.items())))
        yield [ids, *out, *carried]

    extra = "".join(f", `{c}` string" for c in carry)
    return map_batches(base, work, "doc_id long, text string, n_replaced long, kinds string" + extra)
