"""Personal data: format-preserving Feistel pseudonyms.

Found and validated: e-mail addresses, phone numbers with a country code, payment card numbers (13 to 19 digits with a
right Luhn check digit), IPv4 addresses (four numbers up to 255), social security numbers (possible areas only), IBANs
(right check digits) and calendar dates (real days from 1900 to 2099). Each value is permuted, with a secret key, within
its own format: a keyed Feistel network runs over the value's number space, and cycle walking repeats it until the image is
valid again. So a card number becomes another valid card number of that length with the same spacing, a date another
real date in the same notation, and equal values have equal pseudonyms in every document, on every worker and in every
run with the key; different values of one format stay different. Numbers that fail validation stay as they are.

The e-mail domain's last label, a phone's country code and IPv4 addresses' special ranges (0, 10, 127 and 224 and above)
are kept as formats of their own. A phone number outside the +1 plan has no fixed length: digits that follow it after a blank
count as its own. Whole texts are read in one pass over the rows, without a shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_fields

KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "date")
_ROUNDS = 8
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# One alternative for each format. Repeats are bounded or possessive, so that no text makes matching slow.
_ANY = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/]|[.-]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
)
_DIGIT_OR_AT = re.compile("[0-9@]")
#: Where a match may end before its end, as the next number or word can be another's.
_CUTS = {"phone": re.compile(" "), "card": re.compile("[ -]"), "iban": re.compile(" ")}
_GROUP = re.compile(r"\+?\w+")


class Feistel:
    """A keyed permutation of the numbers below any size, by an alternating network over two near-equal halves."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, i: int, x: int, size: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{size}|{i}|{x}".encode(), key=self.key, digest_size=24)
        return int.from_bytes(h.digest(), "big")

    def permute(self, x: int, size: int, tweak: str) -> int:
        """The image of x (0 <= x < size): halves a and b of a grid of at least `size` cells, walked until it is below size."""
        if size < 2:
            return x
        a = 1
        while a * a < size:
            a *= 2
        b = -(-size // a)
        while True:
            left, right = divmod(x, b)
            for i in range(0, _ROUNDS, 2):
                left = (left + self._round(tweak, i, right, size)) % a
                right = (right + self._round(tweak, i + 1, left, size)) % b
            x = left * b + right
            if x < size:
                return x

    def walk(self, x: int, size: int, tweak: str, valid) -> int:
        """As permute, repeated until the image is valid; x itself is, so this ends and is a permutation of the valid numbers."""
        while True:
            x = self.permute(x, size, tweak)
            if valid(x):
                return x


def luhn(digits: str) -> bool:
    return not sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _ssn_ok(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def _refill(shape: str, digits: str) -> str:
    """The digits, put at the places of the digits of shape."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


class Pseudonyms:
    def __init__(self, key: bytes):
        self.f = Feistel(key)

    def email(self, v: str) -> str:
        """Letters and digits are permuted within their alphabets, a whole address at once; signs and the last label stay."""
        body, dot, last = v.rpartition(".")
        shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", body)))
        size, x = 1, 0
        for c in body:
            radix, low = (10, "0") if c in string.digits else (26, "a") if c in string.ascii_lowercase else (26, "A") if c in string.ascii_uppercase else (1, c)
            x, size = x * radix + ord(c) - ord(low), size * radix
        x = self.f.permute(x, size, f"email|{shape}|{last.lower()}")
        out = []
        for c in reversed(shape):
            radix = {"0": 10, "a": 26, "A": 26}.get(c, 1)
            x, k = divmod(x, radix)
            out.append(chr(ord(c) + k))
        return "".join(reversed(out)) + dot + last

    def phone(self, v: str) -> str | None:
        """Country code and signs stay, the national digits are permuted."""
        code = re.match(r"\+[1-9]\d{0,2}", v)[0]
        if not re.match(r"[ .(-]", v[len(code) :]):
            code = code[:2]
        own = _digits(v[len(code) :])
        if not 7 <= len(own) + len(code) - 1 <= 15 or len(own) < 6:
            return None
        return code + _refill(v[len(code) :], f"{self.f.permute(int(own), 10 ** len(own), f'phone|{code}|{len(own)}'):0{len(own)}d}")

    def card(self, v: str) -> str | None:
        """The last digit is the check digit of the others, which are permuted; all digits equal is no card, nor are single digits beside longer groups."""
        d = _digits(v)
        groups = {len(g) for g in re.split("[ -]", v)}
        if not luhn(d) or len(set(d)) == 1 or (1 in groups and len(groups) > 1):
            return None
        n = len(d) - 1

        def whole(x: int) -> str:
            head = f"{x:0{n}d}"
            return head + next(c for c in string.digits if luhn(head + c))

        return _refill(v, whole(self.f.walk(int(d[:-1]), 10**n, f"card|{n}", lambda x: len(set(whole(x))) > 1)))

    def ip(self, v: str) -> str | None:
        parts = [int(p) for p in v.split(".")]
        if max(parts) > 255 or any(p != str(int(p)) for p in v.split(".")):
            return None
        if parts[0] in (0, 10, 127) or parts[0] >= 224:
            x = self.f.permute(int.from_bytes(bytes(parts[1:]), "big"), 1 << 24, f"ip|{parts[0]}")
            return ".".join(map(str, [parts[0], *x.to_bytes(3, "big")]))
        x = self.f.walk(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", lambda x: x >> 24 not in (0, 10, 127) and x >> 24 < 224)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, v: str) -> str | None:
        n = int(_digits(v))
        return _refill(v, f"{self.f.walk(n, 10**9, 'ssn', _ssn_ok):09d}") if _ssn_ok(n) else None

    def iban(self, v: str) -> str | None:
        """Digits and letters of the account are permuted within their places; the check digits are computed anew."""
        t = v.replace(" ", "")
        if not 15 <= len(t) <= 34 or _iban_rest(t) != 1:
            return None
        size, x = 1, 0
        for c in t[4:]:
            radix, low = (10, "0") if c.isdigit() else (26, "A")
            x, size = x * radix + ord(c) - ord(low), size * radix
        shape = re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t[4:]))
        x = self.f.permute(x, size, f"iban|{t[:2]}|{shape}")
        out = []
        for c in reversed(shape):
            x, k = divmod(x, 10 if c == "0" else 26)
            out.append(chr(ord(c) + k))
        account = "".join(reversed(out))
        full = iter(f"{t[:2]}{98 - _iban_rest(t[:2] + '00' + account):02d}{account}")
        return "".join(c if c == " " else next(full) for c in v)

    def date(self, v: str) -> str | None:
        """Real days are permuted; day before month where only that is a date, else month before day with slashes."""
        n = [int(x) for x in re.split("[-/.]", v)]
        orders = {"-": ((0, 1, 2),), "/": ((2, 0, 1), (2, 1, 0)), ".": ((2, 1, 0),)}[re.search("[-/.]", v)[0]]
        for k, (y, m, d) in enumerate(orders):
            try:
                day = datetime.date(n[y], n[m], n[d]).toordinal()
            except ValueError:
                continue
            if not _FIRST <= day <= _LAST:
                return None

            def image(x: int, y=y, m=m, d=d) -> str:
                at = datetime.date.fromordinal(_FIRST + x)
                p: list[str] = ["", "", ""]
                p[y], p[m], p[d] = f"{at.year:04d}", str(at.month), str(at.day)
                width = [len(q) for q in re.split("[-/.]", v)]
                return re.search("[-/.]", v)[0].join(q.zfill(w) for q, w in zip(p, width, strict=True))

            # the image must be read back in the same way and have the same length
            def same(x: int, k=k, image=image) -> bool:
                s = image(x)
                return len(s) == len(v) and [len(q) for q in re.split("[-/.]", s)] == [len(q) for q in re.split("[-/.]", v)] and (k == 0 or int(re.split("/", s)[0]) > 12)

            return image(self.f.walk(day - _FIRST, _LAST - _FIRST + 1, f"date|{v[4:5] == '-'}|{orders[k]}", same))
        return None

    def _valid(self, kind: str, v: str) -> str | None:
        return None if kind == "card" and len(_digits(v)) < 13 else getattr(self, kind)(v)

    def _part(self, text: str, m: re.Match) -> tuple[int, str] | None:
        """End and pseudonym of what is valid of a match: all of it, or a part that ends before one of its later groups.

        A number of the +1 plan has ten digits after it. Else the longest part that another valid value follows goes first,
        then the longest part.
        """
        kind = m.lastgroup
        ends = [m.end(), *(m.start() + x.start() for x in reversed(list(_CUTS[kind].finditer(m[0]))))] if kind in _CUTS else [m.end()]
        got = [(end, new) for end in ends if (new := self._valid(kind, text[m.start() : end])) is not None]
        if kind == "phone" and re.match(r"\+1(?!\d)", m[0]):
            got = [g for g in got if len(_digits(g[1])) == 11] or got
        if len(got) > 1 or (got and got[0][0] < m.end()):
            for g in got:
                after = _ANY.match(text, g[0] + 1)
                if after and after.lastgroup != kind and self._valid(after.lastgroup, after[0]) is not None:
                    return g
        return got[0] if got else None

    def text(self, text: str) -> tuple[str, list[int]]:
        """The text with pseudonyms, and how many values of each kind were replaced.

        The search goes on right after what was replaced, or after the first group of a match that has no valid part.
        """
        found = [0] * len(KINDS)
        if not _DIGIT_OR_AT.search(text):
            return text, found
        out, done, at = [], 0, 0
        while m := _ANY.search(text, at):
            got = self._part(text, m)
            if got is None:
                at = m.start() + len(_GROUP.match(m[0])[0])
                continue
            out += [text[done : m.start()], got[1]]
            done = at = got[0]
            found[KINDS.index(m.lastgroup)] += 1
        return "".join([*out, text[done:]]), found


def _replacer(key: bytes, names: list[str], text: str):
    def replace(batches):
        p = Pseudonyms(key)
        for batch in batches:
            for part in slices(batch, text):
                col = part.column(text)
                at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False)).to_pylist()
                new = {k: p.text(col[k].as_py()) for k in at}
                texts = col if not new else pa.array([new[k][0] if k in new else x for k, x in enumerate(col.to_pylist())], pa.string())
                cols = [texts if n == text else part.column(n) for n in names]
                counts = [pa.array([new[k][1][i] if k in new else 0 for k in range(part.num_rows)], pa.int32()) for i in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([*cols, *counts], [*names, *(f"n_{k}" for k in KINDS)])

    return replace


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, the text with pseudonyms, and counts n_email, n_phone, ... of replaced values, for every row.

    Null texts stay null and empty ones empty, with counts of 0.
    """
    rows = docs.select(*keep, F.col(text).cast("string").alias(text))
    return rows.mapInArrow(_replacer(key, rows.columns, text), with_fields(rows.schema, ", ".join(f"n_{k} int" for k in KINDS)))
