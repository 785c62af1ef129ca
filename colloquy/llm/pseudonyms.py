"""Format-preserving pseudonyms for personal data and secrets.

Values are found by patterns and validated (check digits, calendar, number plans); each is then moved by a keyed
permutation of its own format: a Feistel network over the mixed-radix number that its characters (or octets, or the day
of a date) spell, walked on until the result is valid again. So a card number becomes another valid card number, a
date another date in the same notation, an address another address of the same shape; equal values become equal
pseudonyms in all documents, and who holds the key, and knows where they stand, can turn them back.

Defined cases: a null text stays null, an empty text empty, both with nothing found. Values that fail their validation
stay; of a card or phone number that fails, the longest valid run of its first groups is taken. Of overlapping values
the one of the earlier kind in KINDS is taken. Texts are processed whole, row by row, so rows that repeat are treated
alike. An empty table gives an empty result. All columns are kept; one that has the name of the column of findings
raises an error, and so does an empty key.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days that dates are permuted among: 1900-01-01 to 2099-12-31.
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def _f(key: bytes, label: str, round_: int, value: int, modulus: int) -> int:
    data = f"{label}|{round_}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=32).digest(), "big") % modulus


def feistel(value: int, a: int, b: int, key: bytes, label: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. a * b - 1."""
    left, right = divmod(value, b)
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if r % 2:
            right = (right + sign * _f(key, label, r, left, b)) % b
        else:
            left = (left + sign * _f(key, label, r, right, a)) % a
    return left * b + right


def permute(digits: list[int], radices: list[int], key: bytes, label: str, valid: Callable[[list[int]], bool] = lambda d: True, back: bool = False) -> list[int]:
    """A keyed permutation of the valid digit strings with the given radices. digits must be valid."""
    half = (len(radices) + 1) // 2
    a = b = 1
    for r in radices[:half]:
        a *= r
    for r in radices[half:]:
        b *= r
    label = f"{label}|{','.join(map(str, radices))}"
    while True:  # ends: a permutation comes back to the valid value it started from
        n = 0
        for d, r in zip(digits, radices, strict=True):
            n = n * r + d
        n = feistel(n, a, b, key, label, back)
        out = []
        for r in reversed(radices):
            n, d = divmod(n, r)
            out.append(d)
        digits = out[::-1]
        if valid(digits):
            return digits


_SETS = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "H": "0123456789ABCDEF", "A": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def permute_text(text: str, key: bytes, label: str, sets: str = "dlu", valid: Callable[[str], bool] = lambda t: True, back: bool = False) -> str:
    """text with its characters permuted within their sets (names in _SETS); others stay where they are."""
    where, digits, radices, of, shape = [], [], [], [], []
    for i, c in enumerate(text):
        name = next((s for s in sets if c in _SETS[s]), None)
        shape.append(f"<{name}>" if name else c)  # the same before and after
        if name:
            where.append(i)
            digits.append(_SETS[name].index(c))
            radices.append(len(_SETS[name]))
            of.append(_SETS[name])
    if not where:
        return text
    chars = list(text)

    def spelled(d: list[int]) -> str:
        for i, s, x in zip(where, of, d, strict=True):
            chars[i] = s[x]
        return "".join(chars)

    return spelled(permute(digits, radices, key, f"{label}|{''.join(shape)}", lambda d: valid(spelled(d)), back))


def luhn(number: str) -> bool:
    digits = [int(c) for c in number[::-1] if c.isdigit()]
    return sum(digits[0::2]) % 10 == -sum(sum(divmod(2 * d, 10)) for d in digits[1::2]) % 10


def _card_ok(t: str) -> bool:
    digits = re.sub(r"\D", "", t)
    return 13 <= len(digits) <= 19 and digits[0] != "0" and luhn(digits)


def _iban_ok(t: str) -> bool:
    t = t.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _ssn_ok(t: str) -> bool:
    a, b, c = t.split("-")
    return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"


def _phone_ok(t: str) -> bool:
    digits = re.sub(r"\D", "", t)
    if t.startswith("+"):  # a country code makes the claim; its number plan is not checked
        return 8 <= len(digits) <= 15 and digits[0] != "0"
    return len(digits) == 10 and digits[0] > "1" and digits[3] > "1"


def _ip_ok(t: str) -> bool:
    parts = [int(p) for p in t.split(".")]
    return all(p < 256 for p in parts) and parts[0] > 0


#: Layouts of dates: separator, and the places of year, month and day.
_LAYOUTS = {"-": ("ymd",), "/": ("mdy", "dmy"), ".": ("dmy",)}


def _date_of(t: str) -> tuple[str, str, datetime.date] | None:
    separator = next(c for c in t if not c.isdigit())
    parts = t.split(separator)
    for layout in _LAYOUTS[separator]:
        named = dict(zip(layout, parts, strict=True))
        if len(named["y"]) == 4:
            try:
                day = datetime.date(int(named["y"]), int(named["m"]), int(named["d"]))
            except ValueError:
                continue
            if 0 <= day.toordinal() - _FIRST_DAY < _DAYS:
                return separator, layout, day
    return None


def _date(t: str, key: bytes, back: bool) -> str:
    separator, layout, day = _date_of(t)
    widths = [len(p) for p in t.split(separator)]
    root = int(_DAYS**0.5) + 1

    def spelled(day: datetime.date) -> str:
        return separator.join(str({"y": day.year, "m": day.month, "d": day.day}[c]).zfill(w if c == "y" else min(w, 2)) for c, w in zip(layout, widths, strict=True))

    n = day.toordinal() - _FIRST_DAY
    while True:
        n = feistel(n, root, root, key, f"date|{separator}{layout}{widths}", back)
        if n < _DAYS:
            out = spelled(datetime.date.fromordinal(_FIRST_DAY + n))
            # the same notation, so that it turns back the same way
            if [len(p) for p in out.split(separator)] == widths and _date_of(out)[1] == layout:
                return out


def _card(t: str, key: bytes, back: bool) -> str:
    body, last = t[:-1], len(t) - 1
    check = lambda b: next(c for c in "0123456789" if luhn(b + c))
    body = permute_text(body, key, "card", "d", lambda b: b[0] != "0", back)
    return body + check(body) if last else t


def _iban(t: str, key: bytes, back: bool) -> str:
    body = permute_text(t[4:], key, f"iban|{t[:2]}", "du", back=back)
    rest = int("".join(str(int(c, 36)) for c in (body + t[:2]).replace(" ", "")) + "00") % 97
    return f"{t[:2]}{98 - rest:02d}{body}"


def _ip(t: str, key: bytes, back: bool) -> str:
    return ".".join(map(str, permute([int(p) for p in t.split(".")], [256] * 4, key, "ip", lambda d: d[0] > 0, back)))


def _phone(t: str, key: bytes, back: bool) -> str:
    head = re.match(r"\+1(?!\d)|\+1(?=\d{10}$)|1(?=[\s.-])|\+\d{1,2}", t)
    head = head[0] if head else ""
    return head + permute_text(t[len(head) :], key, f"phone|{head}", "d", lambda rest: _phone_ok(head + rest), back)


def _email(t: str, key: bytes, back: bool) -> str:
    name, at, domain = t.rpartition("@")
    return permute_text(name, key, f"email|{domain}", "dlu", back=back) + at + domain


def _token(t: str, key: bytes, back: bool) -> str:
    sets = "h" if re.fullmatch(r"[0-9a-f]+", t) else "H" if re.fullmatch(r"[0-9A-F]+", t) else "dlu"
    return permute_text(t, key, "token", sets, back=back)


#: Kinds in order of precedence: pattern (with the value as its last group), validation, permutation.
KINDS: dict[str, tuple[re.Pattern, Callable[[str], bool], Callable[[str, bytes, bool], str]]] = {
    "email": (re.compile(r"(?<![\w.%+-])([\w%+-][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), lambda t: True, _email),
    "access_key": (re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([0-9A-Z]{16})(?![A-Za-z0-9])"), lambda t: True, lambda t, k, b: permute_text(t, k, "access_key", "A", back=b)),
    "password": (re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api_?key)\s*[=:]\s*[\"']?([^\s\"',;]{6,})"), lambda t: True, _token),
    "token": (re.compile(r"(?<![A-Za-z0-9])((?=[A-Za-z]*\d)[A-Za-z0-9]{32,64})(?![A-Za-z0-9])"), lambda t: not t.isdigit(), _token),
    "iban": (re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b"), _iban_ok, _iban),
    "card": (re.compile(r"(?<![\d.-])(\d(?:[ -]?\d){12,18})(?![\d-])"), _card_ok, _card),
    "ssn": (re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])"), _ssn_ok, lambda t, k, b: permute_text(t, k, "ssn", "d", _ssn_ok, b)),
    "phone": (re.compile(r"(?<![\d.])((?:\+\d{1,2}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}|\+\d+(?:[ .-]?\(\d+\)\d*|[ .-]\d+){0,7})(?![\d.-]*\d)"), _phone_ok, _phone),
    "date": (re.compile(r"(?<![\d./-])(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[./-]\d)"), lambda t: _date_of(t) is not None, _date),
    "ip": (re.compile(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"), _ip_ok, _ip),
}
_NEEDS = re.compile(r"[0-9@]|AKIA|ASIA|(?i:passw|pwd|secret|token|api_?key)")


#: Kinds of which a match that fails its validation is tried again at its shorter ends.
_GROUPED = {"card", "phone"}
_DIGITS = re.compile(r"\d+")


def _spans(text: str, kind: str) -> list[tuple[int, int]]:
    """The validated values of a kind, in order. Of a grouped kind, a match is cut to the longest valid run of its groups; without one, the search goes on after its first group."""
    pattern, valid, _ = KINDS[kind]
    out, at = [], 0
    while m := pattern.search(text, at):
        a, b = m.span(m.lastindex)
        at = m.end()
        if kind in _GROUPED:
            groups = [g.end() for g in _DIGITS.finditer(text, a, b)]
            b = next((e for e in (b, *groups[-2::-1]) if valid(text[a:e])), None)
            at = b or groups[0]
        elif not valid(text[a:b]):
            continue
        if b:
            out.append((a, b))
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(from, to, kind) of the validated values in a text, in order, without overlaps."""
    if not _NEEDS.search(text):
        return []
    found, digit = [], any(c in text for c in "0123456789")
    for kind in KINDS:
        if (kind == "email" and "@" not in text) or (kind not in ("email", "password", "access_key") and not digit):
            continue
        for value in _spans(text, kind):
            at = bisect.bisect(found, (*value, kind))  # found is in order and without overlaps
            if (at == 0 or found[at - 1][1] <= value[0]) and (at == len(found) or value[1] <= found[at][0]):
                found.insert(at, (*value, kind))
    return found


def _put(text: str, found: list[tuple[int, int, str]], key: bytes, back: bool) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with the values at the given places permuted, or turned back; the places where they then stand)."""
    out, places, at, size = [], [], 0, 0
    for a, b, kind in found:
        out += [text[at:a], KINDS[kind][2](text[a:b], key, back)]
        size += a - at + len(out[-1])
        places.append((size - len(out[-1]), size, kind))
        at = b
    return "".join([*out, text[at:]]), places


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(text with its values replaced, where the values stood, where their pseudonyms stand). A pseudonym follows from the key, the kind and the value alone, whatever stands around it."""
    found = find(text)
    new, places = _put(text, found, key, False)
    return new, found, places


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """(text with its values replaced, the values found)."""
    return replaced(text, key)[:2]


def restore(text: str, places: list[tuple[int, int, str]], key: bytes) -> str:
    """The text that was replaced, from the result and the places of its pseudonyms."""
    return _put(text, places, key, True)[0]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """docs with pseudonyms in the text column, and out_col: array of (kind, start, length), in characters. key: secret bytes, 64 at most."""
    if not key or out_col in docs.columns:
        raise ValueError("a key is needed" if not key else f"there is a column {out_col} already: name another out_col")
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 1024):
                part = batch.slice(x, 1024)
                texts, spans = [], []
                for text in part.column(at).to_pylist():
                    new, found = (None, []) if text is None else replace(text, key)
                    texts.append(new)
                    spans.append([{"kind": k, "start": a, "length": b - a} for a, b, k in found])
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*names, "found"])

    ddl = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    return docs.toDF(*names).mapInArrow(run, f"{ddl}, found array<struct<kind: string, start: int, length: int>>").toDF(*docs.columns, out_col)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_pii, pii."""
    return pseudonymise(docs.select("doc_id", "text"), key).select("doc_id", "text", F.size("pii").alias("n_pii"), "pii")
