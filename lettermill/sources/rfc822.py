"""Raw RFC 822 messages to message rows.

Mail parsing is the standard library's; Spark reads and distributes the raw bytes and takes the columns.
"""

from __future__ import annotations

import email
from collections.abc import Iterator
from email.errors import MessageError
from email.header import decode_header
from email.message import Message

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.checks import fail_where
from lettermill.functions.flags import keywords_of, parse_flags, split_recipients
from lettermill.session import short_batches

_PARSED = (
    "message_id string, subject string, sender string, to_raw string, cc_raw string, bcc_raw string, "
    "reply_to_raw string, date_raw string, body string, headers map<string,string>, error string"
)
_COLUMNS = [c.split()[0] for c in _PARSED.split(", ")]
_HEADERS = pa.map_(pa.string(), pa.string())
#: Bytes of messages that are parsed before their rows leave a task.
PIECE = 1 << 20
_HEADER_OF = {
    "message_id": "Message-ID", "subject": "Subject", "sender": "From", "to_raw": "To", "cc_raw": "Cc",
    "bcc_raw": "Bcc", "reply_to_raw": "Reply-To",
}


def _text(raw: bytes, charset: str | None) -> str:
    try:
        return raw.decode(charset or "utf-8", errors="replace")
    except LookupError:  # a charset name nobody knows
        return raw.decode("utf-8", errors="replace")


def _header(value: object) -> str:
    if not value:
        return ""
    return "".join(_text(v, cs) if isinstance(v, bytes) else v for v, cs in decode_header(str(value)))


def _payload(part: Message) -> str:
    data = part.get_payload(decode=True)
    if isinstance(data, bytes):
        return _text(data, part.get_content_charset())
    plain = part.get_payload()
    return plain if isinstance(plain, str) else ""


def _body(message: Message) -> str:
    if not message.is_multipart():
        return _payload(message)
    plain = (
        part
        for part in message.walk()
        if part.get_content_type() == "text/plain"
        and "attachment" not in str(part.get("Content-Disposition") or "").lower()
    )
    first = next(plain, None)
    return "" if first is None else _payload(first)


_NOTHING: dict[str, object] = dict.fromkeys([*_HEADER_OF, "date_raw", "body", "headers", "error"])


def _row(raw: bytes | None) -> dict[str, object]:
    """The parts of a message, or what is wrong with it."""
    if raw is None:
        return _NOTHING | {"error": "no content"}
    try:
        message = email.message_from_bytes(raw)
        decoded: dict[str, str] = {}  # a header is asked for by its name and in the map of all, and decoded once

        def header(value: object) -> str:
            text = str(value) if value else ""
            if text not in decoded:
                decoded[text] = _header(text)
            return decoded[text]

        row: dict[str, object] = {column: header(message.get(name)) for column, name in _HEADER_OF.items()}
        row["date_raw"] = str(message.get("Date") or "")
        row["body"] = _body(message)
        row["headers"] = {name: header(value) for name, value in message.items()}
    except (MessageError, ValueError, LookupError, TypeError, AttributeError) as e:  # what the mail parser raises on broken input
        return _NOTHING | {"error": f"{type(e).__name__}: {e}"}
    return row | {"error": None}


def split_unreadable(parsed: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(readable rows, the others with their ``error``) of :func:`parse_rfc822`; ``strict`` fails the job instead."""
    bad = F.col("error").isNotNull()
    rejected = parsed.where(bad)
    ok = fail_where(parsed, bad, F.concat(F.lit("unreadable message: "), "error")) if strict else parsed.where(~bad)
    return ok.drop("error"), rejected


def parse_rfc822(raw: DataFrame, content: str = "content", flags: str | None = None) -> DataFrame:
    """Parse a binary column; all other columns are kept. ``flags`` names a fetch descriptor column, if any.

    The input can be ``spark.read.format("binaryFile")`` or any table with a binary column. A message that cannot be read has
    nulls and an ``error``; see :func:`split_unreadable`.
    """
    kept = [c for c in raw.columns if c != content]
    kinds = dict(raw.select(*kept).dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], _PARSED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, first, held = batch.column(content), 0, []
            size = 0
            for i in range(len(batch)):
                cell = contents[i].as_py()
                held.append(_row(cell))
                size += len(cell or b"")
                if size >= PIECE or i + 1 == len(batch):
                    yield _piece(batch, first, held)
                    first, held, size = i + 1, [], 0

    def _piece(batch: pa.RecordBatch, first: int, rows: list[dict[str, object]]) -> pa.RecordBatch:
        own = [batch.column(c).slice(first, len(rows)) for c in kept]
        parsed = [pa.array([r[c] for r in rows], _HEADERS if c == "headers" else pa.string()) for c in _COLUMNS]
        return pa.RecordBatch.from_arrays([*own, *parsed], names=[*kept, *_COLUMNS])

    # A batch crosses to Python whole, so it has few messages; what comes back goes in pieces of bounded size.
    short_batches(raw.sparkSession)
    parsed = raw.select(*kept, content).mapInArrow(run, schema)
    recipients = {name: split_recipients(F.col(f"{name}_raw")) for name in ("to", "cc", "bcc", "reply_to")}
    columns = parsed.withColumns(recipients).drop(*[f"{name}_raw" for name in recipients])
    if flags is None:
        return columns
    found = parse_flags(F.col(flags))
    return columns.withColumns({"imap_flags": found, "imap_keywords": keywords_of(found)})
