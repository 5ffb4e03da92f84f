"""Pseudonyms that keep their format, by keyed Feistel permutations.

A found value (an e-mail address, a card number with a right check digit, a telephone
number, a social security number, an IBAN with right check digits, an IPv4 address,
a calendar date, an access key or a long token) is ranked within the set of valid values of its
format. A keyed Feistel network permutes the ranks, walking its cycle until it is
back in the set, and the new rank is written in the old layout. The permutation
depends on the key and the format alone: equal values stay equal in all documents,
different ones stay different, and the key's holder can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selfsim.llm.common import pieces_of, small_batches

ROUNDS = 8
#: Characters of a long value that are permuted together.
MOST = 256
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_CLASSES = ((48, 10), (65, 26), (97, 26))

#: The length of an IBAN by country; one of another country is as long as it is written.
IBAN = {
    "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Prefixes of access keys, which stay.
KEYS = r"gh[pousr]_|github_pat_|glpat-|hf_|sk-|sk_live_|sk_test_|xox[abprs]-"

FOUND = re.compile(
    r"(?P<email>(?<![\w.+%-])[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/]|[.-]\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<abroad>(?<![\w+])(?:\+(?:33|34|44|49)(?:[ .-]?\(0\))?(?:[ .-]?\d{1,5}){2,6}|0[1-9](?:[ .-]\d{2}){4})(?!\w|[ .-]\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<card>(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w))"
    rf"|(?P<key>(?<![A-Za-z0-9])(?:(?:{KEYS})[A-Za-z0-9_-]{{16,}}|(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])))"
    r"|(?P<token>(?<![A-Za-z0-9])(?=[A-Za-z]*\d)[A-Za-z0-9]{24,}(?![A-Za-z0-9]))",
    re.ASCII,
)
_KEY = re.compile(rf"(?:{KEYS}|AKIA|ASIA)")


def feistel(x: int, n: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """The image of x under the permutation of range(n) that key and tweak choose (undo: under its inverse)."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    salt = f"{tweak}:{n}:".encode()

    def noise(k: int, value: int) -> int:
        size, told = max(16, (a.bit_length() + 7) // 8 + 8), salt + f"{k}:{value}".encode()
        digest = lambda part: hashlib.blake2b(told + (f":{part}".encode() if part else b""), key=key[:64], digest_size=min(64, size)).digest()
        return int.from_bytes(b"".join(map(digest, range(-(-size // 64)))))

    while True:
        left, right, m, w = x // b, x % b, a, b  # left in range(m), right in range(w)
        if not undo:
            for k in range(ROUNDS):
                left, right, m, w = right, (left + noise(k, right)) % m, w, m
        else:
            for k in reversed(range(ROUNDS)):
                left, right, m, w = (right - noise(k, left)) % w, left, w, m
        x = left * b + right
        if x < n:
            return x


def _alike(s: str, key: bytes, kind: str, undo: bool) -> str:
    """s with its ASCII digits and letters permuted, each within its class; stretches of MOST characters each have a permutation of their own."""
    return "".join(_stretch(s[k : k + MOST], key, f"{kind}{k or ''}", undo) for k in range(0, len(s), MOST))


def _stretch(s: str, key: bytes, kind: str, undo: bool) -> str:
    x, n, places = 0, 1, []
    for k, c in enumerate(map(ord, s)):
        for first, radix in _CLASSES:
            if first <= c < first + radix:
                x, n = x * radix + c - first, n * radix
                places.append((k, first, radix))
    layout = kind + "".join("dUl"[_CLASSES.index(p[1:])] for p in places)
    x, out = feistel(x, n, key, layout, undo), list(s)
    for k, first, radix in reversed(places):
        x, r = divmod(x, radix)
        out[k] = chr(first + r)
    return "".join(out)


def _digits(s: str, new: str) -> str:
    """s with its digits replaced in order."""
    own = iter(new)
    return "".join(next(own) if c.isdigit() else c for c in s)


def luhn(digits: str) -> int:
    """The check digit of a payload."""
    return -sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits))) % 10


def _card(s: str, key: bytes, undo: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    new = str(feistel(int(d[:-1]), 10 ** (len(d) - 1), key, "card", undo)).zfill(len(d) - 1)
    return _digits(s, new + str(luhn(new)))


def _phone(s: str, key: bytes, undo: bool) -> str:
    """Numbers of ten digits: those of the North American plan among themselves, whether 1 is written before them or not; others keep which of the two leading digits is 0 or 1."""
    d = re.sub(r"\D", "", s)
    country, d = d[:-10], d[-10:]
    low = [c in "01" for c in (d[0], d[3])]
    first, second = (int(c) if x else int(c) - 2 for c, x in zip((d[0], d[3]), low, strict=True))
    n1, n2 = (2 if x else 8 for x in low)
    x = (first * n2 + second) * 10**8 + int(d[1:3] + d[4:])
    kind = "".join("ab"[v] for v in low) if any(low) else ""
    x, rest = divmod(feistel(x, n1 * n2 * 10**8, key, f"phone{'' if country == '1' else country}{kind}", undo), 10**8)
    first, second = divmod(x, n2)
    rest = f"{rest:08d}"
    return _digits(s, f"{country}{first if low[0] else first + 2}{rest[:2]}{second if low[1] else second + 2}{rest[2:]}")


def _abroad(s: str, key: bytes, undo: bool) -> str | None:
    """Numbers of the national plans by country code, 33 where there is none: the subscriber's digits, of which the first isn't 0, within their number."""
    d = re.sub(r"\D", "", s.replace("(0)", ""))
    lead, d = (d[:2], d[2:]) if s[0] == "+" else ("0", d[1:])
    if not 8 <= len(d) <= 11 or d[0] == "0":
        return None
    country, n = lead if s[0] == "+" else "33", 9 * 10 ** (len(d) - 1)
    new = str(10 ** (len(d) - 1) + feistel(int(d) - 10 ** (len(d) - 1), n, key, f"abroad{country}", undo))
    head, mark, tail = s.partition("(0)")
    return _digits(head, lead) + mark + _digits(tail, new) if mark else _digits(s, lead + new)


def _ssn(s: str, key: bytes, undo: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(feistel(x, 898 * 99 * 9999, key, "ssn", undo), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(s: str, key: bytes, undo: bool) -> str | None:
    octets = list(map(int, s.split(".")))
    if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in s.split(".")):
        return None
    return ".".join(map(str, feistel(int.from_bytes(bytes(octets)), 2**32, key, "ip", undo).to_bytes(4)))


def _date(s: str, key: bytes, undo: bool) -> str | None:
    form = "%Y-%m-%d" if s[4] == "-" else "%d/%m/%Y" if s[2] == "/" else "%d.%m.%Y"
    try:
        day = datetime.datetime.strptime(s, form).date().toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    return datetime.date.fromordinal(FIRST_DAY + feistel(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", undo)).strftime(form)


def _remainder(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _iban(s: str, key: bytes, undo: bool) -> str | None:
    tight = s.replace(" ", "")
    size = IBAN.get(tight[:2], len(tight))
    if len(tight) > size >= 15:
        # groups behind the country's length are other words
        tight, at = tight[:size], [k for k, c in enumerate(s) if c != " "][size - 1] + 1
        new = _iban(s[:at], key, undo) if s[at] == " " else None
        return None if new is None else new + s[at:]
    if not 15 <= len(tight) <= 34 or len(tight) != size or _remainder(tight) != 1:
        return None
    own = _alike(tight[4:], key, "iban" + tight[:2], undo)
    new = iter(tight[:2] + f"{98 - _remainder(tight[:2] + '00' + own):02d}" + own)
    return "".join(c if c == " " else next(new) for c in s)


def _email(s: str, key: bytes, undo: bool) -> str:
    head, _, top = s.rpartition(".")
    return f"{_alike(head, key, 'email', undo)}.{top}"


def _key(s: str, key: bytes, undo: bool) -> str:
    n = _KEY.match(s).end()
    return s[:n] + _alike(s[n:], key, "key" + s[:n], undo)


_KINDS = {"card": _card, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "ip": _ip, "date": _date, "iban": _iban, "email": _email, "key": _key, "token": lambda s, key, undo: _alike(s, key, "token", undo)}
_MAYBE = re.compile(rf"[0-9@]|{KEYS}")


def pseudonymise(text: str | None, key: bytes, undo: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with every valid value replaced, and the (kind, start, end) of each in the given text.

    What looks like a number but fails its check (a wrong check digit, an octet over 255, no calendar date) stays as it is, and
    the search goes on behind its first four characters.
    """
    if text is None or not _MAYBE.search(text):
        return text, []
    out, spans, at, m = [], [], 0, FOUND.search(text)
    while m:
        new = _KINDS[m.lastgroup](m[0], key, undo)
        if new is not None:
            spans.append(("phone" if m.lastgroup == "abroad" else m.lastgroup, m.start(), m.end()))
            out += text[at : m.start()], new
            at = m.end()
        m = FOUND.search(text, m.end() if new is not None else min(m.end(), m.start() + 4))
    return "".join([*out, text[at:]]) if spans else text, spans


def pseudonyms(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """docs with pseudonymised texts under a key of 16 bytes or more, that whoever may undo them holds; n_chars, where there is one, counts the new text's characters.

    Adds pii_count (long) and pii_kinds (``kind:count`` in order of kind, joined by
    commas) in place of columns of those names. Null texts stay null. All other columns and repeated rows stay.
    """
    if len(key) < 16:
        raise ValueError("the key must have 16 bytes or more")
    small_batches(docs.sparkSession)
    docs = docs.drop("pii_count", "pii_kinds")
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_count", T.LongType()), T.StructField("pii_kinds", T.StringType())])
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text"):
                done = [pseudonymise(t, key, undo) for t in part.column(k).to_pylist()]
                kinds = [",".join(f"{x}:{n}" for x, n in sorted(Counter(s[0] for s in spans).items())) for _, spans in done]
                columns = list(part.columns)
                columns[k] = pa.array([t for t, _ in done], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(s) for _, s in done], pa.int64()), pa.array(kinds, pa.string())], [*part.schema.names, "pii_count", "pii_kinds"])

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
