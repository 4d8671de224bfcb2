"""Schemas of the library's tables; ids are opaque strings, enums are strings of a closed set."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

TEXT, INT, REAL, FLAG, TIME = StringType(), IntegerType(), DoubleType(), BooleanType(), TimestampType()
TEXTS, VECTOR = ArrayType(TEXT), ArrayType(FloatType())


def _table(required: dict[str, DataType], optional: dict[str, DataType] | None = None) -> StructType:
    fields = [StructField(name, kind, False) for name, kind in required.items()]
    return StructType(fields + [StructField(name, kind, True) for name, kind in (optional or {}).items()])


SECTION = _table({"text": TEXT}, {"page_number": INT, "source_label": TEXT})

TABLES: dict[str, StructType] = {
    "user": _table({"id": TEXT, "email": TEXT, "created_at": TIME}, {"name": TEXT}),
    "document": _table(
        {"id": TEXT, "user_id": TEXT, "title": TEXT, "original_file_name": TEXT, "file_type": TEXT, "file_path": TEXT, "file_size": INT,
         "subtopics": TEXTS, "keywords": TEXTS, "status": TEXT, "created_at": TIME, "updated_at": TIME},
        {"text_content": TEXT, "language": TEXT, "primary_topic": TEXT, "difficulty": TEXT, "summary": TEXT, "analysis_reason": TEXT},
    ),
    "tag": _table(
        {"id": TEXT, "name": TEXT, "normalized_name": TEXT, "created_by_user_id": TEXT, "created_at": TIME, "updated_at": TIME},
        {"description": TEXT, "embedding": VECTOR},
    ),
    "tag_alias": _table({"id": TEXT, "tag_id": TEXT, "alias": TEXT, "normalized_alias": TEXT, "created_at": TIME}),
    "document_tag": _table({"document_id": TEXT, "tag_id": TEXT, "confidence": REAL, "source": TEXT, "created_at": TIME}),
    "tag_merge_review": _table(
        {"id": TEXT, "user_id": TEXT, "candidate_tag_name": TEXT, "candidate_normalized_name": TEXT, "suggested_tag_id": TEXT,
         "similarity": REAL, "status": TEXT, "created_at": TIME},
        {"document_id": TEXT, "candidate_embedding": VECTOR, "resolved_at": TIME},
    ),
    "analysis_job": _table(
        {"id": TEXT, "document_id": TEXT, "type": TEXT, "status": TEXT, "progress": INT, "created_at": TIME, "updated_at": TIME},
        {"error_message": TEXT, "started_at": TIME, "finished_at": TIME},
    ),
    "document_chunk": _table(
        {"id": TEXT, "document_id": TEXT, "chunk_index": INT, "content": TEXT, "token_count": INT},
        {"page_number": INT, "source_label": TEXT, "embedding": VECTOR},
    ),
    "project": _table(
        {"id": TEXT, "user_id": TEXT, "title": TEXT, "description": TEXT, "keywords": TEXTS, "created_at": TIME, "updated_at": TIME},
        {"target_difficulty": TEXT, "embedding": VECTOR},
    ),
    "recommendation": _table(
        {"id": TEXT, "project_id": TEXT, "document_id": TEXT, "score": REAL, "created_at": TIME}, {"reason": TEXT, "best_chunk_id": TEXT}
    ),
    "ai_provider": _table(
        {"id": TEXT, "user_id": TEXT, "type": TEXT, "name": TEXT, "model": TEXT, "is_active": FLAG, "created_at": TIME, "updated_at": TIME},
        {"base_url": TEXT, "encrypted_api_key": TEXT},
    ),
}

#: Unique keys besides ``id``.
UNIQUE_KEYS = {
    "user": [("email",)],
    "tag": [("created_by_user_id", "normalized_name")],
    "tag_alias": [("tag_id", "normalized_alias")],
    "document_tag": [("document_id", "tag_id")],
    "document_chunk": [("document_id", "chunk_index")],
    "recommendation": [("project_id", "document_id")],
}

#: Child table, its foreign key, parent table: rows that go with their parent.
CASCADES = [
    ("document", "user_id", "user"),
    ("tag", "created_by_user_id", "user"),
    ("project", "user_id", "user"),
    ("ai_provider", "user_id", "user"),
    ("tag_merge_review", "user_id", "user"),
    ("document_chunk", "document_id", "document"),
    ("document_tag", "document_id", "document"),
    ("analysis_job", "document_id", "document"),
    ("recommendation", "document_id", "document"),
    ("tag_merge_review", "document_id", "document"),
    ("tag_alias", "tag_id", "tag"),
    ("document_tag", "tag_id", "tag"),
    ("tag_merge_review", "suggested_tag_id", "tag"),
    ("recommendation", "project_id", "project"),
]

# fixed values: closed sets of the data model
DOCUMENT_STATUS = ("UPLOADED", "EXTRACTING", "EXTRACTED", "ANALYZING", "READY", "FAILED")
DIFFICULTY = ("BEGINNER", "INTERMEDIATE", "ADVANCED")
JOB_TYPE = ("EXTRACT_TEXT", "CHUNK_DOCUMENT", "EMBED_DOCUMENT", "ANALYZE_DOCUMENT")
JOB_STATUS = ("PENDING", "PROCESSING", "COMPLETED", "FAILED")
TAG_SOURCE = ("USER", "AI", "MERGED")
REVIEW_STATUS = ("PENDING", "APPROVED", "REJECTED")
