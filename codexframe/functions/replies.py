"""Reading and checking what a language model or a user sent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from codexframe.functions.text import trim
from codexframe.schemas import DIFFICULTY

# fixed values: topics that an analysis may name
TOPICS = (
    "Artificial Intelligence",
    "Machine Learning",
    "Database",
    "Cybersecurity",
    "Web Development",
    "Software Engineering",
    "Computer Networks",
    "Mathematics",
    "Data Science",
    "Language Learning",
    "Other",
)

TEXTS = ArrayType(StringType())
ANALYSIS = StructType(
    [
        StructField("topic", StringType()),
        StructField("difficulty", StringType()),
        StructField("summary", StringType()),
        StructField("subtopics", TEXTS),
        StructField("keywords", TEXTS),
        StructField("reason", StringType()),
    ]
)
REASONS = ArrayType(StructType([StructField("documentId", StringType()), StructField("reason", StringType())]))


# fixed values: the code fence that models put around JSON
FENCE = r"(?i)^```(?:json)?\s*|\s*```$"


def _unfenced(text: Column) -> Column:
    return F.regexp_replace(trim(text), FENCE, "")


def json_object(text: Column, schema: StructType = ANALYSIS) -> Column:
    """The object between the first ``{`` and the last ``}`` of a reply, or null."""
    bare = _unfenced(text)
    inside = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(inside != "", inside).otherwise(bare), schema)


def json_array(text: Column, schema: ArrayType = REASONS) -> Column:
    """The array between the first ``[`` and the last ``]`` of a reply, or null."""
    bare = _unfenced(text)
    inside = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.from_json(F.when(inside != "", inside).otherwise(bare), schema)


def reasons(text: Column) -> Column:
    """Map of document id to reason: items that have both, the last of a repeated id."""
    items = F.filter(json_array(text), lambda x: (F.coalesce(x["documentId"], F.lit("")) != "") & (F.coalesce(x["reason"], F.lit("")) != ""))
    last_only = F.filter(
        F.transform(items, lambda x, i: F.struct(x["documentId"].alias("id"), trim(x["reason"]).alias("reason"), i.alias("i"))),
        lambda x: ~F.exists(F.transform(items, lambda y, j: F.struct(y["documentId"].alias("id"), j.alias("j"))), lambda y: (y["id"] == x["id"]) & (y["j"] > x["i"])),
    )
    return F.map_from_entries(F.transform(last_only, lambda x: F.struct(x["id"].alias("key"), x["reason"].alias("value"))))


def _length_between(value: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(trim(value)).between(low, high), F.lit(False))


def _items(values: Column, low: int, high: int, shortest: int, longest: int) -> Column:
    each = F.forall(values, lambda x: F.coalesce(F.length(trim(x)).between(shortest, longest), F.lit(False)))
    return F.coalesce(F.size(values).between(low, high) & each, F.lit(False))


def _violations(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def analysis_violations(a: Column) -> Column:
    """Names of the fields of an analysis that break its schema; empty if it is valid."""
    return _violations(
        {
            "topic": F.coalesce(a["topic"].isin(*TOPICS), F.lit(False)),
            "difficulty": F.coalesce(a["difficulty"].isin(*DIFFICULTY), F.lit(False)),
            "summary": _length_between(a["summary"], 20, 5000),
            "subtopics": _items(a["subtopics"], 2, 12, 2, 100),
            "keywords": _items(a["keywords"], 3, 30, 1, 80),
            "reason": _length_between(a["reason"], 10, 2000),
        }
    )


def project_violations(title: Column, description: Column, keywords: Column, difficulty: Column) -> Column:
    return _violations(
        {
            "title": _length_between(title, 3, 160),
            "description": _length_between(description, 10, 3000),
            "keywords": _items(keywords, 0, 20, 1, 80),
            "target_difficulty": difficulty.isNull() | difficulty.isin(*DIFFICULTY),
        }
    )


def tag_violations(name: Column, description: Column) -> Column:
    return _violations({"name": _length_between(name, 2, 100), "description": description.isNull() | (F.length(trim(description)) <= 500)})


def analysis_complete(topic: Column, difficulty: Column, summary: Column, subtopics: Column, keywords: Column) -> Column:
    """All five are there; an empty text counts as missing."""
    filled = [F.coalesce(c, F.lit("")) != "" for c in (topic, difficulty, summary)]
    return filled[0] & filled[1] & filled[2] & (F.coalesce(F.size(subtopics), F.lit(0)) > 0) & (F.coalesce(F.size(keywords), F.lit(0)) > 0)


def encrypt(text: Column, secret: str) -> Column:
    """AES-256-GCM under the SHA-256 of ``secret``, base64."""
    return F.base64(F.aes_encrypt(text, F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")))


def decrypt(text: Column, secret: str) -> Column:
    return F.aes_decrypt(F.unbase64(text), F.unhex(F.sha2(F.lit(secret), 256)), F.lit("GCM")).cast("string")
