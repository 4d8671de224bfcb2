"""Text, list and display functions over columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Any Unicode white space, as JavaScript's ``\\s`` and ``trim`` take it.
BLANK = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same characters for ``str.strip``.
PY_BLANK = " \t\n\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# fixed values: what extracted text loses, in order, and what it becomes
CLEANED = (("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"))

# fixed values: spellings of names that plain letters would lose (only ASCII letters, digits and _ bound a word)
SPOKEN = (
    (r"(?<![A-Za-z0-9_])c\s*\+\s*\+", " cpp "),
    (r"(?<![A-Za-z0-9_])c\s*#", " c sharp "),
    (r"\.net(?![A-Za-z0-9_])", " dotnet "),
    (r"&", " and "),
)

# fixed values: labels shown for statuses and job types
STATUS_LABELS = {
    "UPLOADED": "Đã tải lên",
    "EXTRACTING": "Đang trích xuất",
    "EXTRACTED": "Đã trích xuất",
    "ANALYZING": "Đang phân tích",
    "READY": "Sẵn sàng",
    "FAILED": "Thất bại",
}
JOB_TYPE_LABELS = {
    "EXTRACT_TEXT": "Trích xuất nội dung",
    "CHUNK_DOCUMENT": "Chia nội dung thành chunks",
    "EMBED_DOCUMENT": "Tạo vector embedding",
    "ANALYZE_DOCUMENT": "Phân tích bằng AI",
}
JOB_STATUS_LABELS = {"PENDING": "Đang chờ", "PROCESSING": "Đang xử lý", "COMPLETED": "Hoàn thành", "FAILED": "Thất bại"}


def trim(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def normalize_text(text: Column) -> Column:
    """Extracted text: no NUL, ``\\n`` line ends, single blanks, at most one empty line, trimmed."""
    out = F.replace(text, F.lit("\0"), F.lit(""))
    out = F.replace(out, F.lit("\r\n"), F.lit("\n"))
    for pattern, new in CLEANED:
        out = F.regexp_replace(out, pattern, new)
    return trim(out)


def normalize_text_py(text: str) -> str:
    """The same for one string, inside of extractors."""
    text = text.replace("\0", "").replace("\r\n", "\n")
    for pattern, new in CLEANED:
        text = re.sub(pattern, new, text)
    return text.strip(PY_BLANK)


def normalize_tag_py(name: str) -> str:
    """Canonical form of a tag name: plain lower-case letters and digits with single blanks."""
    text = unicodedata.normalize("NFKC", name).lower()
    for pattern, spoken in SPOKEN:
        text = re.sub(pattern, spoken, text)
    text = unicodedata.normalize("NFD", text)
    kept = [("d" if c == "đ" else c) if unicodedata.category(c)[0] in "LN" else " " for c in text if unicodedata.category(c)[0] != "M"]
    return " ".join("".join(kept).split())


@F.pandas_udf(StringType())
def _normalize_tags(names: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return names.map(lambda x: None if x is None else known.setdefault(x, normalize_tag_py(x)) if x not in known else known[x])


def normalize_tag(name: Column) -> Column:
    """:func:`normalize_tag_py` over Arrow batches; plain ASCII words never leave the JVM."""
    plain = name.rlike("\\A[A-Za-z0-9 ]*\\z")
    simple = F.trim(F.regexp_replace(F.lower(name), " +", " "))
    return F.when(plain, simple).otherwise(_normalize_tags(F.when(~plain, name)))


def word_set(normalized: Column) -> Column:
    """Distinct words of two letters or more of a normalized name."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: F.length(w) > 1))


def overlap(left: Column, right: Column) -> Column:
    """Shared words as a share of the smaller set; 0 if either is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least > 0, F.size(F.array_intersect(left, right)) / least).otherwise(F.lit(0.0))


def split_list(text: Column) -> Column:
    """A user's list: items between commas and line ends, trimmed, without empty ones and repeats."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "[\n,]"), trim), lambda x: x != ""))


def distinct_trimmed(items: Column) -> Column:
    """Trimmed, non-empty, first occurrence of each."""
    return F.array_distinct(F.filter(F.transform(items, trim), lambda x: x != ""))


def snippet(text: Column, length: int = 360) -> Column:
    """The beginning, with ``...`` where something is cut."""
    return F.concat(F.substring(text, 1, length), F.when(F.length(text) > length, F.lit("...")).otherwise(F.lit("")))


def hidden_length(text: Column, shown: int = 15_000) -> Column:
    """Characters that a preview leaves out."""
    return F.greatest(F.length(text) - shown, F.lit(0))


def round_half_up(x: Column) -> Column:
    """Rounding with halves towards positive infinity."""
    return F.floor(x + 0.5)


def percent(score: Column) -> Column:
    return round_half_up(score * 100)


def format_bytes(size: Column, decimals: int = 1) -> Column:
    """``KB`` (1 at least) below one MiB, else ``MB``."""
    kb = F.greatest(F.lit(1), round_half_up(size / 1024)).cast("string")
    mb = F.format_string(f"%.{decimals}f", (size / (1024.0 * 1024.0)).cast("double"))
    return F.when(size < 1024 * 1024, F.concat(kb, F.lit(" KB"))).otherwise(F.concat(mb, F.lit(" MB")))


def format_day(ts: Column, with_year: bool = True) -> Column:
    return F.date_format(ts, "dd/MM/yyyy" if with_year else "dd/MM")


def label(code: Column, labels: dict[str, str]) -> Column:
    """Display text of a code; unknown codes show as they are."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.element_at(pairs, code), code)


def clean_base_url(url: Column) -> Column:
    return F.regexp_replace(trim(url), "/+$", "")


def clean_email(email: Column) -> Column:
    return F.lower(trim(email))
