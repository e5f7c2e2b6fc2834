"""Format-preserving pseudonyms for personal numbers and dates.

Values are found by pattern, validated (check digits, ranges, the calendar; where
the longest match is not valid, shorter ones and other kinds are tried) and
permuted within their own format by a keyed Feistel network: a card number
becomes another valid card number, a date another date, and punctuation stays
in place.  What is permuted is the value and not its spelling: a date is the
same day in any order of its parts, a phone number its country and national
number with or without blanks, a mail address or a hexadecimal key the same in
capitals.  The permutation depends on the key and the kind of value only, so
equal values stay linked across documents and formats and distinct ones never
meet; it has no fixed point, so no value stays in clear.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("card", "iban", "date", "ssn", "phone", "ip", "secret", "email")
_ROUNDS = 10


# Country calling codes of one and two digits; all others have three.
_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


class Feistel:
    """A keyed permutation of 0 .. size - 1 without fixed points (but for a size of 1).

    A balanced network over the next even number of bits, walked until it is
    back in range, says in which order all numbers follow one another; each is
    replaced by the one that is some keyed steps further on.
    """

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.bytes = (self.half + 7) // 8
        if len(key) > 64:
            key = hashlib.blake2b(key).digest()
        self.keys = [hashlib.blake2b(f"{kind}/{size:x}/{r}".encode(), key=key, digest_size=32).digest() for r in range(_ROUNDS)]
        step = hashlib.blake2b(f"{kind}/{size:x}/step".encode(), key=key, digest_size=64).digest()
        self.step = 1 + int.from_bytes(step, "big") % (size - 1) if size > 1 else 0

    def _mix(self, r: int, x: int) -> int:
        data, size = x.to_bytes(self.bytes, "big"), self.bytes + 8
        if size <= 64:
            digest = hashlib.blake2b(data, key=self.keys[r], digest_size=size).digest()
        else:
            digest = hashlib.shake_256(self.keys[r] + data).digest(size)
        return int.from_bytes(digest, "big") & self.mask

    def _once(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for r in range(_ROUNDS):
            left, right = right, left ^ self._mix(r, right)
        return left << self.half | right

    def _back(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for r in reversed(range(_ROUNDS)):
            left, right = right ^ self._mix(r, left), left
        return left << self.half | right

    def _place(self, x: int) -> int:
        while (x := self._once(x)) >= self.size:
            pass
        return x

    def _at(self, x: int) -> int:
        while (x := self._back(x)) >= self.size:
            pass
        return x

    def __call__(self, x: int) -> int:
        return self._at((self._place(x) + self.step) % self.size)

    def inverse(self, x: int) -> int:
        return self._at((self._place(x) - self.step) % self.size)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _luhn_end(head: str) -> str:
    return next(c for c in "0123456789" if luhn(head + c))


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country)) * 100 % 97


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Pseudonyms:
    """Replaces validated values in texts; `key` decides the permutations."""

    #: In order of precedence; each match is validated by the method of its name.
    PATTERNS = [
        ("email", r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
        ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
        ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
        ("date", r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?!(?![Tt]\d\d(?!\d)|[Tt]\d{4}(?:\d\d)?(?!\d))[\w/-]|\.\d)"),
        ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
        ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
        ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
        ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\w-]|\.\d)|(?<![\w.])\+\d{7,15}(?!\w)"),
    ]

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS):
        self.key = key
        self.pattern = re.compile("|".join(f"(?P<{k}>{_renumbered(p)})" for k, p in self.PATTERNS if k in kinds), re.ASCII)
        # each kind alone, for the other readings of a place
        self.single = {k: re.compile(_renumbered(p), re.ASCII) for k, p in self.PATTERNS if k in kinds}
        self.hint = re.compile(r"\d|@")
        self.permutation = functools.lru_cache(4096)(lambda kind, size: Feistel(key, kind, size))
        self.changed = functools.lru_cache(100_000)(self._changed)

    def _digits(self, kind: str, digits: str) -> str:
        return str(self.permutation(kind, 10 ** len(digits))(int(digits))).zfill(len(digits))

    def _letters(self, kind: str, text: str) -> str:
        """Every letter and digit anew within its own alphabet, all of them permuted as one number; capitals stay capitals."""
        plain = text.lower()
        kinds = [next((a for a in (_DIGITS, _LOWER) if c in a), "") for c in plain]
        number, size = 0, 1
        for c, a in zip(plain, kinds):
            if a:
                number, size = number * len(a) + a.index(c), size * len(a)
        number = self.permutation(f"{kind}/{''.join(a[:1] or c for c, a in zip(plain, kinds))}", size)(number)
        out = list(plain)
        for i in reversed(range(len(text))):
            if a := kinds[i]:
                number, k = divmod(number, len(a))
                out[i] = a[k].upper() if text[i].isupper() else a[k]
        return "".join(out)

    @staticmethod
    def _into(shape: str, values: str) -> str:
        """`values` in place of the letters and digits of `shape`."""
        rest = iter(values)
        return "".join(next(rest) if c.isalnum() else c for c in shape)

    def _changed(self, kind: str, found: str) -> str | None:
        """The pseudonym, or None if the value is not valid."""
        return getattr(self, f"_{kind}")(found)

    def _card(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        head = self._digits("card", digits[:-1])
        return self._into(found, head + _luhn_end(head))

    def _iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        country, check, body = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or 98 - _iban_rest(country, body) != int(check):
            return None
        body = self._letters(f"iban{country}", body)
        return self._into(found, f"{country}{98 - _iban_rest(country, body):02d}{body}")

    def _date(self, found: str) -> str | None:
        first = found[4] in "-/."
        mark = found[4] if first else found[2]
        parts = found.split(mark)
        for order in ("ymd",) if first else ("dmy", "mdy"):
            try:
                day = datetime.date(*(int(parts[order.index(c)]) for c in "ymd"))
            except ValueError:
                continue
            break
        else:
            return None
        # days after the 12th, that can be read in one order only, and others are permuted among themselves
        late, rank = _day_rank(day)
        low, high = (_day_rank(datetime.date(year, 1, 13 if late else 1))[1] for year in (1900, 2100))
        if low <= rank < high:
            rank = low + self.permutation(f"date/{late}", high - low)(rank - low)
        else:
            # years long past or far ahead stay such
            size = _day_rank(datetime.date(9999, 12, 31 if late else 12))[1] + 1 - (high - low)
            rank = self.permutation(f"far date/{late}", size)(rank if rank < low else rank - (high - low))
            rank += (high - low) * (rank >= low)
        new = _day_at(late, rank)
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return mark.join(values[c] for c in order)

    def _ip(self, found: str) -> str | None:
        parts = [int(p) for p in found.split(".")]
        # a leading zero or three small numbers are a version, not an address
        if any(p > 255 for p in parts) or any(len(p) > 1 and p[0] == "0" for p in found.split(".")):
            return None
        n = self.permutation("ip", 1 << 32)(int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _ssn(self, found: str) -> str | None:
        area, middle, serial = (int(p) for p in found.split("-"))
        if area in (0, 666) or area >= 900 or not middle or not serial:
            return None
        areas = 898
        n = ((area - 1 - (area > 666)) * 99 + middle - 1) * 9999 + serial - 1
        n = self.permutation("ssn", areas * 99 * 9999)(n)
        n, serial = divmod(n, 9999)
        area, middle = divmod(n, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{middle + 1:02d}-{serial + 1:04d}"

    def _phone(self, found: str) -> str | None:
        digits = re.sub(r"\D", "", found)
        if not 7 <= len(digits) <= 15:
            return None
        # the country code is kept, and so are zeros ahead of the national number
        lead = next((len(c) for c in _CODES if digits.startswith(c)), 3) if found[0] == "+" else 0
        lead += len(digits[lead:]) - len(digits[lead:].lstrip("0"))
        own = digits[lead:]
        if len(own) < 4:
            return None
        least = 10 ** (len(own) - 1)
        return self._into(found, digits[:lead] + str(least + self.permutation("phone", 9 * least)(int(own) - least)))

    def _secret(self, found: str) -> str | None:
        if found[:4] in ("AKIA", "ASIA") and len(found) == 20:
            return found[:4] + self._letters("key", found[4:])
        if found.isdigit() or found.isalpha():
            return None
        out = f"{self.permutation('secret', 16 ** len(found))(int(found, 16)):0{len(found)}x}"
        return out.upper() if found.upper() == found else out

    def _email(self, found: str) -> str | None:
        name, _, domain = found.rpartition("@")
        head, _, top = domain.rpartition(".")
        return f"{self._letters('email', name)}@{self._letters('domain', head)}.{top}"

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds of what was replaced, in order."""
        if not text or not self.hint.search(text):
            return text, []
        kinds, out, done, at, barred = [], [], 0, 0, 0
        while m := self.pattern.search(text, at):
            start = m.start()
            for kind, end, new in self._readings(text, start):
                # groups of a number that looks like an IBAN are no phone number
                if kind == "phone" and (end <= barred or self._checked_inside(text, start + 1, end)):
                    continue
                kinds.append(kind)
                out += [text[done:start], new]
                done = at = end
                break
            else:
                if m.lastgroup == "iban":
                    barred = max(barred, m.end())
                at = start + 1
        return "".join(out) + text[done:], kinds

    def _checked_inside(self, text: str, start: int, end: int) -> bool:
        """Whether a value with check digits begins there, which goes before a phone number that has none."""
        return any(True for at in range(start, end) for _ in self._readings(text, at, ("card", "iban")))

    def _readings(self, text: str, start: int, kinds: tuple[str, ...] = KINDS) -> Iterator[tuple[str, int, str]]:
        """(kind, end, pseudonym) of the valid values that begin at `start`: by precedence of kinds, the longest first."""
        for kind, pattern in ((k, p) for k, p in self.single.items() if k in kinds):
            m = pattern.match(text, start)
            while m:
                new = self.changed(kind, m[0])
                if new is not None:
                    yield kind, m.end(), new
                m = self._shorter(pattern, text, start, m.end())

    @staticmethod
    def _shorter(pattern: re.Pattern, text: str, start: int, end: int) -> re.Match | None:
        """The longest match from `start` that ends before `end`, where no word goes on."""
        for stop in range(end - 1, start, -1):
            if not text[stop].isalnum() and (m := pattern.fullmatch(text, start, stop)):
                return m
        return None


def _renumbered(pattern: str) -> str:
    """Groups of the date pattern by name, so that patterns can be joined; the kind stays the last named group closed."""
    return pattern.replace(r"([-/.])\d{2}\1", r"(?:-\d{2}-|/\d{2}/|\.\d{2}\.)").replace(r"([-/.])\d{2}\2", r"(?:-\d{2}-|/\d{2}/|\.\d{2}\.)")


def _early(day: datetime.date) -> int:
    """Days up to the 12th of a month before `day`, from the year 1."""
    return (day.year - 1) * 144 + (day.month - 1) * 12 + min(day.day - 1, 12)


def _day_rank(day: datetime.date) -> tuple[bool, int]:
    """Whether a day is after the 12th, and its place among all such days, or among all others."""
    return (True, day.toordinal() - 1 - _early(day)) if day.day > 12 else (False, _early(day))


def _day_at(late: bool, rank: int) -> datetime.date:
    if not late:
        months, day = divmod(rank, 12)
        return datetime.date(months // 12 + 1, months % 12 + 1, day + 1)

    def upto(ordinal: int) -> int:
        day = datetime.date.fromordinal(ordinal)
        return ordinal - _early(day) - (day.day <= 12)

    return datetime.date.fromordinal(1 + bisect.bisect_left(range(1, datetime.date.max.toordinal() + 1), rank + 1, key=upto))


@functools.lru_cache(4)
def _replacer(key: bytes, kinds: tuple[str, ...]) -> Pseudonyms:
    return Pseudonyms(key, kinds)


def pseudonymise(
    docs: DataFrame, key: bytes, kinds: tuple[str, ...] = KINDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, text, n_replaced, kinds), one row for each row of `docs`: texts with pseudonyms for personal values.

    kinds holds the distinct kinds replaced, sorted.  Texts without such values
    come back unchanged, null as null, empty as empty; repeated rows give equal
    rows, no rows none, and other columns are ignored.  Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replacer = _replacer(key, kinds)
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                done = [replacer.replace(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(k) for _, k in done], pa.int32()),
                        pa.array([sorted(set(k)) for _, k in done], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text", "n_replaced", "kinds"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, text string, n_replaced int, kinds array<string>")
