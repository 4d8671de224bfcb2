"""Format-preserving pseudonyms for personal data.

Validated numbers, dates and addresses are replaced within their format by a keyed permutation: a
Feistel network over exactly the values that the format allows, with cycle walking. Equal values get
equal pseudonyms in every document, different ones stay different, check digits stay right, and the
holder of the key can invert each of them.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexframe.llm.common import slices, worker_cache

ROUNDS = 8
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

_EMAIL = re.compile(r"(?<![\w.+%-])[A-Za-z0-9_.+%-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![\w-])")
_SECRET = re.compile(
    r"(?<!\w)(AKIA)([0-9A-Z]{16})(?!\w)|"
    r"(?i:(?<!\w)((?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?))([A-Za-z0-9+/_-]{8,})"
)
_NUMBER = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])|"
    r"(?P<date>\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?![\d-]|[/.]\d)|"
    r"(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\d]|\.\d)|"
    r"(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])|"
    r"(?P<card>\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?![\d-]|\.\d)|"
    r"(?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?![\d-]|\.\d)"
    r")|(?<![\w.+-])(?P<plus>\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{2,4})){2,5})(?![\d-]|\.\d)"
)


def _rounds(key: bytes, tweak: str, left: int, right: int, a: int, b: int, back: bool) -> tuple[int, int]:
    def f(number: int, half: int) -> int:
        data = f"{tweak}|{number}|{half}".encode()
        return int.from_bytes(hmac.digest(key, data, hashlib.sha256), "big")

    for number in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        sign = -1 if back else 1
        if number % 2:
            right = (right + sign * f(number, left)) % b
        else:
            left = (left + sign * f(number, right)) % a
    return left, right


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of ``range(size)``; ``back`` inverts it."""
    if size < 2:
        return value
    a = max(2, round(size**0.5)) if size < 1 << 100 else 1 << (size.bit_length() // 2)
    b = -(-size // a)
    while True:
        left, right = _rounds(key, tweak, *divmod(value, b), a, b, back)
        value = left * b + right
        if value < size:
            return value


def _radix(symbols: str, classes: list[str]) -> tuple[int, int]:
    value, size = 0, 1
    for symbol, alphabet in zip(symbols, classes):
        value, size = value * len(alphabet) + alphabet.index(symbol), size * len(alphabet)
    return value, size


def _digits_of(value: int, classes: list[str]) -> str:
    out = []
    for alphabet in reversed(classes):
        value, at = divmod(value, len(alphabet))
        out.append(alphabet[at])
    return "".join(reversed(out))


_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


#: Symbols that are permuted as one number; a longer value is permuted in blocks of so many.
BLOCK = 256


def _blockwise(symbols: list[str], kinds: list[str], key: bytes, tweak: str, back: bool) -> list[str]:
    """A long value in linear time: blocks permuted forwards and then backwards, each under the image of the one before.

    After both passes every block depends on all others. The inverse takes the passes and their steps back.
    """
    blocks = [slice(at, at + BLOCK) for at in range(0, len(symbols), BLOCK)]
    out = list(symbols)
    for number, order in reversed([*enumerate((blocks, blocks[::-1]))]) if back else enumerate((blocks, blocks[::-1])):
        before = ""
        for block in order:
            mine = f"{tweak}|{number}|{hashlib.sha256(before.encode()).hexdigest()}|{''.join(x[-1] for x in kinds[block])}"
            given = "".join(out[block])
            value, size = _radix(given, kinds[block])
            out[block] = _digits_of(permute(value, size, key, mine, back), kinds[block])
            before = given if back else "".join(out[block])
    return out


def _by_class(text: str, key: bytes, tweak: str, back: bool, alphabet: str | None = None) -> str:
    """Letters and digits permuted each within its class (or ``alphabet``); other characters stay."""
    classes = {c: next((x for x in ([alphabet] if alphabet else [_DIGITS, _LOWER, _UPPER]) if c in x), None) for c in set(text)}
    at = [i for i, c in enumerate(text) if classes[c]]
    kinds = [classes[text[i]] for i in at]
    symbols, out = [text[i] for i in at], list(text)
    if len(at) > BLOCK:
        image = _blockwise(symbols, kinds, key, tweak, back)
    else:
        # the pattern of classes tells apart domains of one size
        value, size = _radix("".join(symbols), kinds)
        image = list(_digits_of(permute(value, size, key, f"{tweak}|{''.join(x[-1] for x in kinds)}", back), kinds))
    for i, c in zip(at, image):
        out[i] = c
    return "".join(out)


def _refill(shape: str, symbols: str) -> str:
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def luhn_digit(body: str) -> str:
    """The check digit that completes ``body``."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[0] + _by_class(digits[1:-1], key, f"card|{digits[0]}", back)
    return _refill(text, body + luhn_digit(body))


def _iban_checks(country: str, bban: str) -> str:
    number = "".join(str(int(c, 36)) for c in f"{bban}{country}00")
    return f"{98 - int(number) % 97:02d}"


def _iban(text: str, key: bytes, back: bool) -> str | None:
    bare = text.replace(" ", "")
    country, checks, bban = bare[:2], bare[2:4], bare[4:]
    if _iban_checks(country, bban) != checks:
        return None
    other = _by_class(bban, key, f"iban|{country}", back)
    return _refill(text, country + _iban_checks(country, other) + other)


#: Length of the IBANs of each country.
_IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        x.split(":") for x in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
            "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
            "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in countries.split(",")
}


def _cuts(kind: str, text: str) -> list[int]:
    """Lengths at which a match may end, likelier ones first: whole, or before one of its separators.

    An IBAN of its country's length comes first. What decides doesn't change with the pseudonym.
    """
    if kind not in ("iban", "phone"):
        return [len(text)]
    ends = [len(text), *(i for i in range(len(text) - 1, 0, -1) if text[i] in " .-" and text[i - 1].isalnum())]
    if kind == "phone":
        # the longest that isn't too long; a number without a mark is whole or none
        return [i for i in ends if sum(c.isdigit() for c in text[:i]) <= 15][:1] if text[0] == "+" else ends[:1]
    length = _IBAN_LENGTHS.get(text[:2])
    return sorted(ends, key=lambda i: i - text.count(" ", 0, i) != length)


def _numbers(text: str, key: bytes, back: bool) -> Iterator[tuple[int, int, str, str]]:
    """``start, stop, kind, pseudonym`` of the valid numbers; the search goes on inside a match that isn't valid."""
    at = 0
    while m := _NUMBER.search(text, at):
        kind, value = next((k, v) for k, v in m.groupdict().items() if v and k in (*_KINDS, "plus"))
        kind = "phone" if kind == "plus" else kind
        at = m.start() + 1
        for end in _cuts(kind, value):
            new = pseudonym(kind, value[:end], key, back)
            if new is not None:
                at = m.start() + end
                yield m.start(), at, kind, new
                break


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    value = permute(value, 898 * 99 * 9999, key, "ssn", back)
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(str(x) for x in value.to_bytes(4, "big"))


def _phone(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if len(national) == 10 and (not text.startswith("+") or digits[0] == "1" and len(digits) == 11):
        if national[0] in "01" or national[3] in "01":
            # no number of the plan, but +1 or (ddd) says what it is: permuted among all such numbers
            if not (text.startswith("+") or "(" in text):
                return None
            other = national
            while other is national or other[0] not in "01" and other[3] not in "01":
                other = f"{permute(int(other), 10**10, key, 'phone|unassigned', back):010d}"
            return _refill(text, digits[: len(digits) - 10] + other)
        area, office, line = int(national[:3]) - 200, int(national[3:6]) - 200, int(national[6:])
        value = permute((area * 800 + office) * 10_000 + line, 800 * 800 * 10_000, key, "phone", back)
        rest, line = divmod(value, 10_000)
        area, office = divmod(rest, 800)
        return _refill(text, f"{digits[: len(digits) - 10]}{area + 200}{office + 200}{line:04d}")
    if not text.startswith("+") or not 8 <= len(digits) <= 15 or digits[0] == "0":
        return None
    return _refill(text, digits[:2] + _by_class(digits[2:], key, f"phone|{digits[:2]}", back))


def _late_days() -> list[int]:
    """Days after the 12th of their month, counted from the first day; made once in a process."""
    held = worker_cache()
    if "late" not in held:
        span = (LAST_DAY - FIRST_DAY).days + 1
        held["late"] = [d for d in range(span) if (FIRST_DAY + datetime.timedelta(d)).day > 12]
    return held["late"]


def _date(text: str, key: bytes, back: bool) -> str | None:
    mark = re.search(r"\D", text)[0]  # type: ignore[index]
    parts = text.split(mark)
    year_first = len(parts[0]) == 4
    orders = ["ymd"] if year_first else ["dmy", "mdy"]
    for order in orders:
        at = {part: int(x) for part, x in zip(order, parts)}
        try:
            day = datetime.date(at["y"], at["m"], at["d"])
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        span = (LAST_DAY - FIRST_DAY).days + 1
        if order == "mdy" and len(orders) == 2:  # the days that only this order can read: after the 12th
            days = _late_days()
            value = days[permute(bisect.bisect_left(days, (day - FIRST_DAY).days), len(days), key, "date|mdy", back)]
        else:
            value = permute((day - FIRST_DAY).days, span, key, "date", back)
        other = FIRST_DAY + datetime.timedelta(value)
        width = 2 if min(len(x) for x in parts) == 2 else 1
        return mark.join(f"{ {'y': other.year, 'm': other.month, 'd': other.day}[x]:0{width}d}" for x in order)
    return None


_KINDS = {"iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of one value (``back``: the value of a pseudonym); null if it isn't valid for its kind."""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{_by_class(local, key, 'email', back)}@{_by_class(name, key, 'domain', back)}.{top}"
    if kind == "secret":
        return _by_class(value, key, "secret", back, _HEX if set(value) <= set(_HEX) else None)
    return _KINDS[kind](value, key, back)


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """``text`` with every valid value replaced, and ``(kind, start, length)`` of each in the new text.

    A value that fails its check (Luhn digit, calendar, number ranges, IBAN remainder) stays, unless
    a shorter part of it, or one further in, is valid.
    """
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for m in _EMAIL.finditer(text):
            found.append((*m.span(), "email", pseudonym("email", m[0], key, back)))  # type: ignore[arg-type]
    if "=" in text or ":" in text or "AKIA" in text:
        for m in _SECRET.finditer(text):
            group = 2 if m[1] else 4
            if m[1] or any(c.isdigit() for c in m[group]):
                found.append((*m.span(group), "secret", pseudonym("secret", m[group], key, back)))  # type: ignore[arg-type]
    if any(d in text for d in _DIGITS):
        found += _numbers(text, key, back)
    out, spans, done, grown = [], [], 0, 0
    for start, stop, kind, new in sorted(found):
        if start < done:
            continue
        out += [text[done:start], new]
        spans.append((kind, start + grown, len(new)))
        grown += len(new) - (stop - start)
        done = stop
    return "".join([*out, text[done:]]), spans


def pseudonymize(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, spans`` of every row: whole texts with their personal data replaced.

    ``spans`` lists ``kind, start, length`` of each pseudonym in the new text (code points). Null text
    stays null; it and empty text have no spans. Rows come back as often as they come, whatever their
    id; other columns are ignored. Map only.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType())])
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("text", StringType()), StructField("spans", ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for batch in slices(batches):
            done = [(None, []) if t is None else replace(t, key) for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "start", "length"), s)) for s in found] for _, found in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], names=["id", "text", "spans"]
            )

    return rows.mapInArrow(run, schema)
