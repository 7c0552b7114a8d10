"""Format-preserving pseudonyms for personal numbers and dates.

What is found is validated (card numbers by Luhn, IBANs by mod 97, social security numbers by
their ranges, addresses by octets or groups, dates by the calendar, phone numbers by their shape) and
replaced by a keyed permutation of the values of its own kind, so the result is valid
too, keeps its separators, and equal values have equal pseudonyms in all documents, however
they are written: a date is permuted as a day, a phone number as country code and national
number, an address as a number, and then written in the format that it was found in. The
permutation is a ten-round Feistel network on a x b >= N with cycle walking back into the N values
of the kind; ``reveal`` inverts it with the key.

Kept for the format: a card's first digit and its check digit's rule; a phone's country code;
an IBAN's country and letters, with new check digits; a date's order and separators, and whether
its day is over 12, by which a date with slashes shows its order. E-mail addresses keep their
domain; their local part's letters and digits are permuted.

Where a find fails its check, its shorter beginnings are tried and then what begins after its
first group, so a valid number next to other digits is not passed over. The spans in ``pii`` name
every replacement; ``reveal`` with them is exact, without them it looks for values again.

Rows are handled one by one, so no skew can arise. Defined results: null stays null with no
finds; empty texts are unchanged; repeated rows get equal results; an empty table gives an empty
table; output columns replace input columns of the same name; days and months that were
written with one digit get two where the new value has two; very long texts are worked on in
time linear in their length. An empty key is refused; one of over 64 bytes is hashed. What is not looked for: dates
with the month's name, nine digits that nothing calls a social security number, domains in other scripts.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_columns
from .common import table

ROUNDS = 10
#: The session setting that names the query's key.
KEY_SETTING = "spark.roadlark.pii.key"
FIRST_DAY, DAYS = datetime.date(1900, 1, 1), 73_049  # to 2099-12-31
KINDS = ["email", "iban", "card", "phone", "ssn", "ip", "date"]

#: The country calling codes of one and two digits; all others have three.
CODES_1 = ["1", "7"]
CODES_2 = ["20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
           "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"]

_SHAPES = {
    "email": (r"(?<![\w.+-])", r"\w[\w.+'-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", ""),
    "iban": (r"(?<![A-Za-z0-9])", r"(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)", r"(?![A-Za-z0-9])"),
    "phone": (r"(?<![\w+.-])", r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.-])[2-9]\d{2}[.-]\d{4})", r"(?!\w)(?!-\d)"),
    "date": (r"(?<![\w./-])", r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})", r"(?:(?![\w/-])|(?=[Tt]\d\d:\d\d))"),
    "ip": (r"(?<![\w.:])", r"(?:\d{1,3}(?:\.\d{1,3}){3}|(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})", r"(?![\w:]|\.\d)"),
    "ssn": (r"(?<![\w-])", r"(?:\d{3}-\d{2}-\d{4}|(?:(?<=SSN )|(?<=SSN: )|(?<=ssn )|(?<=ssn: ))\d{9})", r"(?!\w)(?!-\d)"),
    "card": (r"(?<![\w-])", r"\d(?:[ .-]?\d){12,18}", r"(?!\w)(?!-\d)"),
}
_D = lambda p: p.replace(r"\d", "[0-9]")
_FIND = re.compile("|".join(f"(?P<{kind}>{_D(a)}{_D(b)}{_D(c)})" for kind, (a, b, c) in _SHAPES.items()))
_WHOLE = {kind: re.compile(_D(b)) for kind, (_, b, _) in _SHAPES.items()}
_GROUP, _FIRST = re.compile(r"[ .-]"), re.compile(r"[^\W_]+|.", re.DOTALL)


class Permutation:
    """A keyed permutation of range(n) for any n."""

    def __init__(self, key: bytes, name: str, n: int):
        self.n = n
        self.a = math.isqrt(max(n - 1, 0)) + 1
        self.b = -(-n // self.a)
        self.key, self.tweak = key, name.encode()

    def _f(self, i: int, half: int, size: int) -> int:
        h = hashlib.blake2b(b"%d|%d|%s" % (i, half, self.tweak), key=self.key, digest_size=24).digest()
        return int.from_bytes(h, "big") % size

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        sign = -1 if back else 1
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                right = (right + sign * self._f(i, left, self.b)) % self.b
            else:
                left = (left + sign * self._f(i, right, self.a)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False, kind: Callable[[int], bool] | None = None) -> int:
        """The image of x; with ``kind``, the permutation of the values that are of x's kind."""
        own = kind and kind(x)
        x = self._once(x, back)
        while x >= self.n or kind and kind(x) != own:
            x = self._once(x, back)
        return x


@functools.lru_cache(maxsize=4096)
def _permutation(key: bytes, name: str, n: int) -> Permutation:
    return Permutation(key, name, n)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


#: Sums of the digits of a doubled digit.
_DOUBLED = {str(d): sum(divmod(2 * d, 10)) for d in range(10)}


def luhn(digits: str) -> int:
    """0 for a valid number; else what its last digit is off by."""
    return (sum(map(int, digits[::-1][::2])) + sum(map(_DOUBLED.__getitem__, digits[::-1][1::2]))) % 10


def _card(text: str, key: bytes, back: bool) -> str | None:
    d = _digits(text)
    if len(d) < 13 or d == d[0] * len(d) or luhn(d):
        return None
    n = len(d) - 2
    body = d[0] + str(_permutation(key, f"card{len(d)}{d[0]}", 10**n)(int(d[1:-1]), back)).zfill(n)
    return _refill(text, body + str(-luhn(body + "0") % 10))


def _american(x: int) -> bool:
    """Ten digits whose area and exchange codes begin with 2 to 9."""
    return x >= 2 * 10**9 and x // 10**6 % 10 >= 2


def _phone(text: str, key: bytes, back: bool) -> str | None:
    """Country code and national number are told apart by the codes, not by how the number is written."""
    d = _digits(text)
    code = "" if text[0] != "+" else next((d[:n] for n, codes in ((1, CODES_1), (2, CODES_2)) if d[:n] in codes), d[:3])
    own = d[len(code) :]
    if not 6 <= len(own) <= 14:
        return None
    name = code or "1"
    kind = _american if name == "1" and len(own) == 10 else None
    return _refill(text, code + str(_permutation(key, f"phone{name} {len(own)}", 10 ** len(own))(int(own), back, kind)).zfill(len(own)))


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    d = _digits(text)
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(_permutation(key, "ssn", 898 * 99 * 9999)(x, back), 9999)
    area, group = divmod(x, 99)
    area += 1 + (area + 1 >= 666)
    return _refill(text, f"{area:03d}{group + 1:02d}{serial + 1:04d}")


def _ip(text: str, key: bytes, back: bool) -> str | None:
    if ":" in text:
        try:
            x = int(ipaddress.IPv6Address(text))
        except ValueError:
            return None
        # Few groups are more likely names in source code.
        return None if sum(map(bool, text.split(":"))) < 3 else str(ipaddress.IPv6Address(_permutation(key, "ip6", 1 << 128)(x, back, lambda v: sum(map(bool, str(ipaddress.IPv6Address(v)).split(":"))) >= 3)))
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = _permutation(key, "ip", 1 << 32)(int.from_bytes(bytes(map(int, parts)), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _late(day: int) -> bool:
    return (FIRST_DAY + datetime.timedelta(day)).day > 12


def _date(text: str, key: bytes, back: bool) -> str | None:
    mark = next(c for c in text if not c.isdigit())
    p = text.split(mark)
    # With slashes a day over 12 in first place shows the order; otherwise the month comes first.
    order = "ymd" if len(p[0]) == 4 else "dmy" if mark == "." or int(p[0]) > 12 else "mdy"
    v = dict(zip(order, map(int, p)))
    try:
        day = (datetime.date(v["y"], v["m"], v["d"]) - FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    made = FIRST_DAY + datetime.timedelta(_permutation(key, "date", DAYS)(day, back, _late))
    return mark.join(str({"y": made.year, "m": made.month, "d": made.day}[c]).zfill(len(x)) for c, x in zip(order, p))


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes, back: bool) -> str | None:
    raw = text.replace(" ", "")
    if not 15 <= len(raw) <= 34 or raw.islower() and len(_digits(raw)) < 12 or _mod97(raw) != 1:  # words look like small letters
        return None
    d = _digits(raw[4:])
    body = _refill(raw[4:], str(_permutation(key, f"iban{raw[:2].upper()}{re.sub(r'[0-9]', '9', raw[4:].upper())}", 10 ** len(d))(int(d), back)).zfill(len(d))) if d else raw[4:]
    made = f"{raw[:2]}{98 - _mod97(raw[:2] + '00' + body):02d}{body}"
    it = iter(made)
    return "".join(" " if c == " " else next(it) for c in text)


#: What of a local part is permuted together: the first character and how many follow it.
_ALPHABETS = {"a": (0x61, 26), "0": (0x30, 10), "latin": (0xDF, 0x250 - 0xDF), "other": (0x250, 0xD800 - 0x250)}


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.partition("@")
    for name, (low, radix) in _ALPHABETS.items():
        own = [ord(c.lower() if c.isascii() else c) - low for c in local]
        at = [i for i, x in enumerate(own) if 0 <= x < radix]
        if at:
            x = _permutation(key, f"email{name}{len(at)}@{domain.lower()}", radix ** len(at))(functools.reduce(lambda a, i: a * radix + own[i], at, 0), back)
            new = list(local)
            for i in reversed(at):
                x, r = divmod(x, radix)
                new[i] = chr(low + r).upper() if name == "a" and local[i].isupper() else chr(low + r)
            local = "".join(new)
    return f"{local}@{domain}"


_MAKERS: dict[str, Callable[[str, bytes, bool], str | None]] = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}


def _tried(text: str, m: re.Match, key: bytes, back: bool) -> tuple[int, str] | None:
    """The end and the pseudonym of a find, or of its longest beginning that is valid."""
    kind, start, ends = m.lastgroup, m.start(), [m.end()]
    if kind in ("card", "iban", "phone"):
        least = {"card": 13, "iban": 12, "phone": 7}[kind]
        ends += [start + g.start() for g in _GROUP.finditer(m[0]) if g.start() >= least][::-1]
    for end in ends:
        if (end == m.end() or _WHOLE[kind].fullmatch(text, start, end)) and (new := _MAKERS[kind](text[start:end], key, back)) is not None:
            return end, new
    return None


def prepared(key: bytes) -> bytes:
    """A key as the permutations take it: refused if empty, hashed if over 64 bytes."""
    if not key:
        raise ValueError("pseudonyms need a key")
    return key if len(key) <= 64 else hashlib.blake2b(key).digest()


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in it. ``back``: the originals again."""
    key = prepared(key)
    out, last, size, found, at = [], 0, 0, [], 0
    while m := _FIND.search(text, at):
        if (got := _tried(text, m, key, back)) is None:
            # On with what follows the first group of what failed.
            group = _FIRST.match(text, m.start())
            at = max(group.end(), m.start() + 1)
            continue
        end, new = got
        out += [text[last : m.start()], new]
        size += m.start() - last
        found.append((m.lastgroup, size, size + len(new)))
        size += len(new)
        last = at = end
    return "".join(out) + text[last:] if found else text, found


def reveal(text: str, key: bytes, found: list[tuple[str, int, int]] | None = None) -> str:
    """The original values: of the spans ``found``, or of all values that are found again."""
    key = prepared(key)
    if found is None:
        return pseudonymise(text, key, back=True)[0]
    for kind, a, b in sorted(found, key=lambda f: -f[1]):
        text = text[:a] + (_MAKERS[kind](text[a:b], key, True) or text[a:b]) + text[b:]
    return text


def _replace(batches: Iterator[pa.RecordBatch], column: str, keep: list[str], key: bytes) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, found = [], []
        for t in batch.column(batch.schema.names.index(column)).to_pylist():
            new, own = (t, []) if t is None else pseudonymise(t, key)
            texts.append(new)
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
        yield with_columns(batch, keep, {column: pa.array(texts, pa.string()), "pii": pa.array(found, spans)})


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the text's values replaced and ``pii``, where they stand."""
    key = prepared(key)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "pii")]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(text_col, T.StringType()), T.StructField("pii", T.ArrayType(span))])
    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(functools.partial(_replace, column=text_col, keep=keep, key=key), schema)


def op7_pii(spark, sf_dir):
    """Under the key of the session setting; without one, under a key drawn for this run alone, so that values are linked in its rows
    and nobody can reveal them."""
    import secrets

    from pyspark.sql import functions as F

    named = spark.conf.get(KEY_SETTING, None)
    key = secrets.token_bytes(32) if named is None else named.encode()
    found = pseudonyms(table(spark, sf_dir, "documents"), key, keep=["doc_id"])
    count = lambda kind: F.size(F.filter("pii", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", F.size("pii").cast("long").alias("n_pii"), *map(count, KINDS), "text")
