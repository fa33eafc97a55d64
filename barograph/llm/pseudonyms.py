"""Format-preserving pseudonyms of personal numbers, dates and addresses by a keyed Feistel permutation.

Each kind maps a value to a number below a bound, and its permutation to a value of the same format:

- payment cards: 13 to 19 digits that pass Luhn's check; the first digit stays, the check digit is renewed;
- IBANs that pass their check, as long as their country's are (of other countries the longest that passes); country
  and letters' places stay, the check digits are renewed;
- calendar dates of 1900 to 2099: Y-M-D (also before T and a time), Y/M/D, D.M.Y, and M/D/Y (D/M/Y where the first
  number is over 12);
- IPv4 addresses; social security numbers within their valid ranges; North American telephone numbers;
- other telephone numbers written +NN, of 7 to 15 digits (further digits after a space count as part of it up to 15):
  the country's code and a trunk (0) stay;
- e-mail addresses: letters and digits are permuted in place, the top-level domain stays; long ones in blocks of
  ``BLOCK`` letters and digits, each by its place and the form of the whole.

A Feistel network over a domain a little larger than the bound, walked until it is back inside, is a permutation
of exactly the values of the format.  It depends on the key, the kind and the value alone, so equal values keep
equal pseudonyms in all documents, however they are spaced or punctuated, and the key's holder can invert it.  An
invalid number stays as it is, and the search goes on inside it; where a valid number overlaps an invalid one before
it, the pseudonym may make that one valid by chance, and the text is then not inverted.  Nothing is shuffled.

Nulls and edges: null text stays null; an empty text stays empty; an empty table gives no rows; all other columns,
null ids and repeated rows pass unchanged.  A new column whose name is taken gets underscores at its end until it is
not.  Each text is processed whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import small_batches, tidied

ROUNDS = 8
#: Letters and digits that are permuted as one number, so that the work grows with an address' length alone.
BLOCK = 64
#: Longest value whose pseudonym a worker's cache holds.
HELD = 256
#: First day of the date format's range, and the number of its days.
DAY_0, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()


class Feistel:
    """A keyed permutation of range(n) for any n."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.size = -(-self.half // 8)
        bound = n.to_bytes((n.bit_length() + 7) // 8, "big")
        self.key = hashlib.blake2b(tweak.encode("utf-8", "surrogatepass") + b":" + bound, key=key[:64], digest_size=32).digest()

    def _round(self, i: int, x: int) -> int:
        out = b""
        while len(out) < self.size:
            out += hashlib.blake2b(bytes([i]) + (len(out) // 64).to_bytes(4, "big") + x.to_bytes(self.size, "big"), key=self.key, digest_size=min(64, self.size)).digest()
        return int.from_bytes(out, "big") & self.mask

    def _once(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for i in range(ROUNDS):
            left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def _back(self, x: int) -> int:
        left, right = x >> self.half, x & self.mask
        for i in reversed(range(ROUNDS)):
            left, right = right ^ self._round(i, left), left
        return left << self.half | right

    def __call__(self, x: int, inside: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """The image of x; values for which ``inside`` holds are permuted among themselves, and the others too."""
        if self.n < 2:
            return x
        step, same = self._back if back else self._once, inside(x)
        y = step(x)
        while y >= self.n or inside(y) != same:
            y = step(y)
        return y


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_rest(country: str, body: str, check: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


_ALPHABETS = {"a": ("abcdefghijklmnopqrstuvwxyz", 26), "0": ("0123456789", 10)}

_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
#: Country codes of telephone numbers other than 1; what no group of such a number begins with.
_CODE = "7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
_OTHER = rf"(?:(?:{_DATE}|{_IP}|{_SSN})(?![0-9])|[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}|[0-9]{{13}})"
_ABROAD = re.compile(rf"\+({_CODE})(.*)", re.S)
#: Length of the IBANs of each country.
_IBAN_LENGTH = {
    c: int(n)
    for n, cs in (x.split(":") for x in "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU".split())
    for c in cs.split(",")
}
_FIND = re.compile(
    rf"""(?<![\w.])(?:
      (?P<iban>[A-Z]{{2}}[0-9]{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,3}})?)
    | (?P<date>[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?:(?=[Tt][0-9]{{2}})(?P<time>))?|{_DATE})
    | (?P<ip>{_IP})
    | (?P<ssn>{_SSN})
    | (?P<phone>(?:\+?1[ .-]?)?\([0-9]{{3}}\)[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|\+1[ .-]?[0-9]{{3}}[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|(?:1[ .-])?[2-9][0-9]{{2}}(?P<sep>[ .-])[2-9][0-9]{{2}}(?P=sep)[0-9]{{4}})
    | (?P<abroad>\+(?:{_CODE})(?:[ .-]?\(0\))?(?:[ .-]?\([0-9]{{1,5}}\))?(?:[ .-](?!{_OTHER}))?[0-9]{{1,14}}+(?:[ .-](?!{_OTHER})[0-9]{{1,12}}+){{0,6}}(?![:./-][0-9]))
    | (?P<card>[0-9]{{13,19}}|[0-9]{{4}}(?P<gap>[ -])[0-9]{{4}}(?P=gap)[0-9]{{4}}(?P=gap)[0-9]{{1,7}}|[0-9]{{4}}(?P<gap2>[ -])[0-9]{{6}}(?P=gap2)[0-9]{{5}})
    )(?(time)|(?!\w)(?!\.[0-9]))""",
    re.X,
)
_MAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_DIGIT = re.compile("[0-9]")


class Pseudonyms:
    """Pseudonyms of values, by kind, under one key."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.network = lru_cache(maxsize=4096)(lambda kind, n: Feistel(key, kind, n))
        self.held = lru_cache(maxsize=100_000)(self._value)

    def _permuted(self, kind: str, n: int, x: int, inside: Callable[[int], bool] = lambda _: True) -> int:
        return self.network(kind, n)(x, inside, self.back)

    def value(self, kind: str, s: str) -> str | None:
        """The pseudonym, or None where s is no valid value."""
        return (self.held if len(s) <= HELD else self._value)(kind, s)

    def _value(self, kind: str, s: str) -> str | None:
        return getattr(self, f"_{kind}")(s)

    def _card(self, s: str) -> str | None:
        d = "".join(_DIGIT.findall(s))
        if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
            return None
        body = len(d) - 2
        ones = {int(x * body) for x in "0123456789"}  # one repeated digit is no card
        new = d[0] + f"{self._permuted(f'card{len(d)}{d[0]}', 10**body, int(d[1:-1]), lambda x: x not in ones):0{body}d}"
        return _refill(s, new + next(c for c in "0123456789" if luhn(new + c)))

    def _iban(self, s: str) -> str | None:
        c = s.replace(" ", "")
        country, check, body = c[:2], c[2:4], c[4:]
        if not 11 <= len(body) <= 30 or not 2 <= int(check) <= 98 or _iban_rest(country, body, check) != 1:
            return None
        shape, new = re.sub("[0-9]", "0", body), self._string(f"iban{country}", body.lower()).upper()
        assert re.sub("[0-9]", "0", re.sub("[A-Z]", "A", new)) == re.sub("[A-Z]", "A", shape)
        it = iter(country + f"{98 - _iban_rest(country, new, '00'):02d}" + new)
        return "".join(x if x == " " else next(it) for x in s)

    def _abroad(self, s: str) -> str | None:
        code, rest = _ABROAD.fullmatch(s).groups()
        trunk = re.match(r"[ .-]?\(0\)", rest)
        head, rest = (trunk[0], rest[trunk.end() :]) if trunk else ("", rest)
        d = "".join(_DIGIT.findall(rest))
        if not 7 <= len(code + d) <= 15:
            return None
        new = self._permuted(f"abroad{code}:{len(d)}", 10 ** len(d), int(d), lambda x: x >= 10 ** (len(d) - 1))
        return f"+{code}{head}" + _refill(rest, f"{new:0{len(d)}d}")

    def _date(self, s: str) -> str | None:
        a, b, c = map(int, parts := re.split("[-/.]", s))
        year_first, dotted = len(parts[0]) == 4, "." in s
        day_first = dotted or not year_first and a > 12
        y, m, d = (a, b, c) if year_first else (c, b, a) if day_first else (c, a, b)
        try:
            n = datetime.date(y, m, d).toordinal() - DAY_0
        except ValueError:
            return None
        if not 0 <= n < DAYS:
            return None
        new = datetime.date.fromordinal(DAY_0 + self._permuted("date", DAYS, n))
        fields = (new.year, new.month, new.day) if year_first else (new.day, new.month, new.year) if day_first else (new.month, new.day, new.year)
        sep = re.findall("[-/.]", s)[0]
        return sep.join(f"{f:0{len(p)}d}" for f, p in zip(fields, parts, strict=True))

    def _ip(self, s: str) -> str | None:
        octets = [int(x) for x in s.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
            return None
        y = self._permuted("ip", 1 << 32, int.from_bytes(bytes(octets), "big"))
        return ".".join(map(str, y.to_bytes(4, "big")))

    def _ssn(self, s: str) -> str | None:
        area, group, serial = map(int, s.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(self._permuted("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(rest, 99)
        area += 1
        return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, s: str) -> str | None:
        d = "".join(_DIGIT.findall(s))
        if len(d) not in (10, 11):
            return None
        dialled = lambda x: x >= 2 * 10**9 and x // 10**6 % 10 >= 2  # noqa: E731  area and exchange from 2 on
        return _refill(s, d[:-10] + f"{self._permuted('phone', 10**10, int(d[-10:]), dialled):010d}")

    def _string(self, kind: str, s: str) -> str:
        """Letters a-z and digits of s permuted as numbers, one a block; other characters stay."""
        shape = "".join("a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c for c in s)
        form = shape if len(shape) <= HELD else hashlib.blake2b(shape.encode("utf-8", "surrogatepass")).hexdigest()
        places = [i for i, c in enumerate(shape) if c in "a0"]
        out = list(s)
        for a in range(0, len(places), BLOCK):
            x, n, at = 0, 1, places[a : a + BLOCK]
            for i in at:
                letters, k = _ALPHABETS[shape[i]]
                x, n = x * k + letters.index(s[i]), n * k
            y = self._permuted(f"{kind}:{a}:{form}", n, x)
            for i in reversed(at):
                letters, k = _ALPHABETS[shape[i]]
                y, r = divmod(y, k)
                out[i] = letters[r]
        return "".join(out)

    def _mail(self, s: str) -> str:
        rest, _, top = s.rpartition(".")
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest)
        new = self._string("mail", low)
        return "".join(b.upper() if "A" <= a <= "Z" else b for a, b in zip(rest, new, strict=True)) + "." + top

    def _ends(self, kind: str, s: str) -> Iterator[str]:
        """Beginnings of a match that may be the value: as long as the country's IBANs, or at gaps, the longest first."""
        if kind == "iban" and s[:2] in _IBAN_LENGTH:
            at = [i + 1 for i, c in enumerate(s) if c != " "]
            n = _IBAN_LENGTH[s[:2]]
            if len(at) >= n and (at[n - 1] == len(s) or s[at[n - 1]] == " "):
                yield s[: at[n - 1]]
            return
        yield s
        if kind in ("iban", "abroad"):
            for i in range(len(s) - 1, 0, -1):
                if s[i] in " .-" and s[i - 1].isalnum():
                    yield s[:i]

    def _found(self, s: str) -> tuple[str, int]:
        """s with pseudonyms of all kinds but addresses; after an invalid match the search goes on inside it."""
        out, at, start, found = [], 0, 0, 0
        while m := _FIND.search(s, start):
            kind = next(k for k in _KINDS if m[k])
            for x in self._ends(kind, m[0]):
                new = self.value(kind, x)
                if new is not None:
                    out += [s[at : m.start()], new]
                    at = start = m.start() + len(x)
                    found += 1
                    break
            else:
                start = m.start() + 1
        return "".join([*out, s[at:]]), found

    def text(self, s: str) -> tuple[str, int]:
        """The text with pseudonyms, and their number."""
        if "@" not in s:
            return self._found(s) if _DIGIT.search(s) else (s, 0)
        # what lies between addresses is searched for the other kinds, so that nothing is changed twice
        out, at, found = [], 0, 0
        for m in _MAIL.finditer(s):
            part, n = self._found(s[at : m.start()])
            out += [part, self.value("mail", m[0])]
            found += n + 1
            at = m.end()
        part, n = self._found(s[at:])
        return "".join([*out, part]), found + n


_KINDS = ("iban", "date", "ip", "ssn", "phone", "abroad", "card")
_held: dict[tuple, Pseudonyms] = {}


def _apply(key: bytes, column: str, count: str | None, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _held.setdefault((key, back), Pseudonyms(key, back))
        for batch in batches:
            at = batch.schema.get_field_index(column)
            new = [(None, 0) if s is None else p.text(s) for s in batch.column(at).to_pylist()]
            columns = [*batch.columns]
            columns[at] = pa.array([s for s, _ in new], pa.string())
            names = [*batch.schema.names]
            if count:
                columns.append(pa.array([n for _, n in new], pa.int64()))
                names.append(count)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pseudonymize(df: DataFrame, key: bytes, column: str = "text", count: str | None = None, back: bool = False) -> DataFrame:
    """``df`` with pseudonyms in a string column; with ``count``, a new last column of how many each row has.

    A ``count`` that clashes with a column gets underscores until it doesn't.

    back: invert what the same key has done (dates written M/D/Y and D/M/Y only as far as their order is clear).
    """
    small_batches(df.sparkSession)
    while count and count.lower() in [c.lower() for c in df.columns]:
        count += "_"
    schema = T.StructType([*df.schema.fields, *([T.StructField(count, T.LongType())] if count else [])])
    return df.mapInArrow(tidied(_apply(key, column, count, back)), schema)
