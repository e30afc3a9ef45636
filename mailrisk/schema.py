"""Declared schemas.  Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def _fields(spec: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; unlike a DDL string it needs no running session."""
    pairs = [f.split() for f in spec.split(",")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


# Field names of the raw event format (fixed by the producers of the files).
PAYLOAD = _fields(
    "userid BIGINT, msgid STRING, sg_event_id STRING, subject STRING, from STRING, "
    "email STRING, date STRING, originating_ip STRING"
)

RAW_EVENT = T.StructType(
    [
        T.StructField("raw_mime", T.StringType()),
        T.StructField("event", T.StructType([T.StructField("payload", PAYLOAD)])),
    ]
)

RAW_EVENT_FLAT = T.StructType(
    [T.StructField("raw_mime", T.StringType())]
    + [T.StructField(f"event.payload.{f.name}", f.dataType) for f in PAYLOAD]
)

EMAIL = _fields(
    "user_id BIGINT, msg_id STRING, sg_event_id STRING, subject STRING, mime STRING, "
    "email_from STRING, email_to STRING, email_date DATE, originating_ip STRING, "
    "originating_ip_country STRING, lang STRING, s3_path STRING"
)

EMAIL_EXTRACTED = T.StructType(
    [f for f in EMAIL if f.name not in ("mime", "s3_path")]
    + [T.StructField("content_type", T.StringType()), T.StructField("email_text", T.StringType())]
)

HTML_BODIES = _fields("msg_id STRING, html STRING")
SUSPENDED = _fields("user_id BIGINT, created_at TIMESTAMP")
USER_STATS = _fields("user BIGINT, email_count BIGINT")
ADMIN_NOTES = _fields("user_id BIGINT, agent_notes STRING, created_at TIMESTAMP")
MAIL_LOG = _fields("user_id BIGINT, created TIMESTAMP")
# IPv4 ranges by number; IPv6 ranges hold 32 hex digits in the same columns.
IP_RANGES = _fields("start_ip BIGINT, end_ip BIGINT, country STRING")
IP6_RANGES = _fields("start_ip STRING, end_ip STRING, country STRING")
EMBEDDING_SET = _fields("id BIGINT, dataset STRING, embedding ARRAY<FLOAT>")
LABELLED_CORPUS = _fields("text STRING, label INT")
MESSAGE_PART = _fields(
    "idx INT, is_multipart BOOLEAN, content_type STRING, disposition STRING, payload STRING"
)
PARSED_MESSAGE = T.StructType(
    [
        T.StructField("parts", T.ArrayType(MESSAGE_PART)),
        T.StructField("error", T.StringType()),
    ]
)

# Columns of the human review sheet, in order (fixed values); the model's score column follows.
REVIEW_COLUMNS = [
    "user_id", "msg_id", "sg_event_id", "subject", "email_from", "email_to", "email_date",
    "originating_ip", "originating_ip_country", "lang", "content_type", "translated_text",
    "dataset",
]

# Marker strings for unknown values (fixed values).
UNKNOWN = "N/A"
NO_LINK = "Not Found"
