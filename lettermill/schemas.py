"""Schemas of the stored tables and of the message input."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT, BOOL, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(STRING)
UID_MAP = T.MapType(STRING, LONG)
TERM_MAP = T.MapType(STRING, STRINGS)
HEADER_MAP = T.MapType(STRING, STRING)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MESSAGE = _struct(
    message_id=STRING, subject=STRING, sender=STRING, to=STRINGS, cc=STRINGS, bcc=STRINGS, reply_to=STRINGS,
    date_raw=STRING, body=STRING, headers=HEADER_MAP, folder=STRING, imap_uid=LONG, imap_flags=STRINGS,
    imap_keywords=STRINGS,
)

METADATA = _struct(
    sender=STRING, recipients=STRINGS, raw_date=STRING, sent_at=TIME, sent_at_iso=STRING, folder=STRING,
    folders=STRINGS, folder_uids=UID_MAP, folder_flags=TERM_MAP, folder_keywords=TERM_MAP, headers=HEADER_MAP,
)

DOCUMENTS = _struct(
    document_key=STRING, source_type=STRING, source_id=STRING, title=STRING, body=STRING, searchable_text=STRING,
    content_checksum=STRING, metadata=METADATA, created_at=TIME, updated_at=TIME,
)

DOCUMENT_FOLDERS = _struct(
    document_key=STRING, folder=STRING, ord=INT, uid=LONG, flags=STRINGS, keywords=STRINGS,
)

EMBEDDINGS = _struct(
    document_key=STRING, dimensions=INT, embedding=T.ArrayType(T.DoubleType()), content_checksum=STRING,
    created_at=TIME, updated_at=TIME, provider=STRING, model_name=STRING,
)

SYNC_STATE = _struct(
    imap_user=STRING, imap_host=STRING, imap_folder=STRING, uidvalidity=LONG, last_synced_uid=LONG,
    last_sync_time=TIME, sync_run_id=STRING, total_emails_in_folder=LONG, created_at=TIME, updated_at=TIME,
)

SYNC_RUNS = _struct(
    document_key=STRING, sync_run_id=STRING, was_present_in_mailbox=BOOL, folder_names=STRINGS, folder_uids=UID_MAP,
    last_seen_at=TIME, created_at=TIME,
)

TASK_AREAS = _struct(uuid=STRING, title=STRING, created_at=TIME, updated_at=TIME)
TASK_PROJECTS = _struct(
    uuid=STRING, title=STRING, area_uuid=STRING, notes=STRING, status=STRING, created_at=TIME, updated_at=TIME
)
TASK_HEADINGS = _struct(
    uuid=STRING, title=STRING, project_uuid=STRING, project_title=STRING, notes=STRING, status=STRING,
    start_value=STRING, created_at=TIME, updated_at=TIME,
)
TASK_TODOS = _struct(
    uuid=STRING, title=STRING, project_uuid=STRING, project_title=STRING, area_uuid=STRING, heading_uuid=STRING,
    heading_title=STRING, notes=STRING, status=STRING, start_value=STRING, created_at=TIME, updated_at=TIME,
)
TASK_CHECKLIST_ITEMS = _struct(
    uuid=STRING, todo_uuid=STRING, title=STRING, status=STRING, created_at=TIME, updated_at=TIME
)
TASK_NOTES = _struct(
    item_uuid=STRING, item_type=STRING, title=STRING, content=STRING, project_uuid=STRING, area_uuid=STRING,
    created_at=TIME, updated_at=TIME,
)
