import hashlib
import random
from email.header import Header
from email.message import EmailMessage
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from lettermill.functions.dates import common_date_fields, iso_to_timestamp, parse_common_date, sent_at_iso
from lettermill.functions.flags import keywords_of, parse_flags, split_recipients
from lettermill.operators.merge import merge_duplicates
from lettermill.operators.normalize import has_rare_dates, normalize_messages, repair_rare_dates, to_document
from lettermill.session import fresh_dir
from lettermill.sources.documents import documents_from_json
from lettermill.sources.mailbox import folder_status, normalize_folders
from lettermill.sources.rfc822 import parse_rfc822, split_unreadable

SCHEMA = (
    "seq long, message_id string, subject string, sender string, to array<string>, cc array<string>, date_raw string, "
    "body string, folder string, imap_uid long, imap_flags array<string>, imap_keywords array<string>"
)


def message(seq, **fields):
    base = dict(
        seq=seq, message_id="<n-77.q@post.test>", subject=" Orchard  notes ", sender="maker@post.test",
        to=["reader@post.test", ""], cc=None, date_raw="Tue, 03 Feb 2026 17:40:00 +0000", body="Pears\n\nand plums",
        folder="INBOX", imap_uid=31, imap_flags=None, imap_keywords=None,
    )
    return tuple({**base, **fields}[name.split()[0]] for name in SCHEMA.split(", "))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


DATES = [
    "Tue, 03 Feb 2026 17:40:00 +0000", "11 Apr 2026 09:15:00 -0500", "1 Apr 2026 9:15 +0530", "11 Apr 2026 09:15:00 -0000",
    "11 Apr 2026 09:15:00 GMT", "Fri, 11 Apr 2026 09:15:00 EST", "11 Apr 2026 09:15:00 +0000 (UTC)", "11 Apr 26 09:15:00 +0000",
    "11 Apr 1970 09:15", "32 Apr 2026 09:15:00 +0000", "31 Apr 2026 09:15:00 +0000", "11 Apr 2026 24:15:00 +0000",
    "11 Apr 2026 09:15:60 +0000", "11 Apr 2026 09:15:00 CET", "not-a-real-email-date", "", "11 April 2026 09:15:00 +0100",
    "11 Apr 2026 09:15:00 +2500", "11 Apr 0026 09:15:00 +0000", "1|Apr|2026|9|15|00|+0000", "Fri Apr 11 09:15:00 2026",
    "11 Apr 2026 09:15:00 +0090", "11-Apr-2026 09:15:00 +0000", "Fri,11 Apr 2026 09:15:00 +0000", "29 Feb 2023 10:00:00 Z",
    "11 Apr 2026 09:15:00 -0000\n", " 11 Apr 2026 09:15:00 +0000",
]


def _expected(raw):
    try:
        parsed = parsedate_to_datetime(raw)
    except (TypeError, ValueError, IndexError):
        return None
    return parsed.isoformat() + ("Z" if parsed.tzinfo is None else "")


def test_date_headers_agree_with_the_library(spark):
    raw = spark.createDataFrame([(d,) for d in DATES], "d string")
    raw = raw.select("d", common_date_fields(F.col("d")).alias("f"))
    raw = raw.select("d", parse_common_date(F.col("f")).alias("p"))
    iso = raw.select("d", sent_at_iso(F.col("d"), F.col("p"), True).alias("iso"), F.col("p").isNotNull().alias("native"))
    got = {r.d: r for r in iso.withColumn("at", iso_to_timestamp(F.col("iso"))).collect()}
    for d in DATES:
        assert got[d].iso == (_expected(d) if d else None), d
        assert (got[d]["at"] is None) == (got[d].iso is None), d
    assert sum(r.native for r in got.values()) >= 6


def test_rare_dates_are_repaired_later(spark):
    rows = frame(spark, message(1, date_raw="11 Apr 26 09:15:00 CET"), message(2, message_id="<b>", date_raw="no date"))
    narrow = normalize_messages(rows, rare_dates=False).ok
    assert has_rare_dates(narrow)
    fixed = {r.seq: r.sent_at_iso for r in repair_rare_dates(narrow).collect()}
    assert fixed == {1: _expected("11 Apr 26 09:15:00 CET"), 2: None}
    assert not has_rare_dates(narrow.where("seq = 2"))


def test_flags_and_recipients(spark):
    cases = [
        ("1 (FLAGS (\\Seen \\Flagged to-file) BODY[] {58}", ["\\Seen", "\\Flagged", "to-file"], ["to-file"]),
        ("FLAGS (b a b \\Custom)", ["b", "a", "\\Custom"], ["b", "a"]),
        ("FLAGS ()", [], []),
        ("BODY[]", [], []),
        (None, [], []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, d string")
    for r in df.select("i", parse_flags(F.col("d")).alias("f")).withColumn("k", keywords_of(F.col("f"))).collect():
        assert (r.f, r.k) == cases[r.i][1:]
    split = df.select(split_recipients(F.lit(" a@x ,, b@x")).alias("a"), split_recipients(F.lit(" , ")).alias("b")).first()
    assert (split.a, split.b) == (["a@x", "b@x"], None)


def test_folder_selection():
    assert normalize_folders(["Desk, INBOX", "Bills", "Desk"]) == ["Desk", "INBOX", "Bills"]
    assert normalize_folders([" "], ["Work"]) == ["Work"]
    assert normalize_folders(None, None) == ["INBOX"]


def test_normalize(spark):
    rows = frame(spark, message(1, imap_flags=["\\Seen"], cc=["watcher@post.test"]), message(2, message_id=" ", folder=None), message(3, subject=" ", body="\x1c"))
    ok, rejected = normalize_messages(rows)
    first, second = ok.orderBy("seq").collect()
    text = "Orchard notes\n\nPears and plums"
    assert first.fingerprint == hashlib.sha256(b"<n-77.q@post.test>").hexdigest()
    assert first.searchable_text == text and first.content_checksum == hashlib.sha256(text.encode()).hexdigest()
    assert first.recipients == ["reader@post.test", "watcher@post.test"]
    assert (first.folders, first.folder_uids, first.folder_flags, first.folder_keywords) == (["INBOX"], {"INBOX": 31}, {"INBOX": ["\\Seen"]}, {})
    fallback = f"maker@post.test|Tue, 03 Feb 2026 17:40:00 +0000|Orchard notes|{text}"
    assert second.fingerprint == hashlib.sha256(fallback.encode()).hexdigest()
    assert second.source_message_id is None and second.folders == [] and second.folder_uids == {}
    assert [r.seq for r in rejected.collect()] == [3]
    with pytest.raises(Exception, match="neither subject nor body"):
        normalize_messages(rows, strict=True).ok.collect()


def test_flags_do_not_change_identity(spark):
    rows = frame(spark, message(1), message(2, imap_flags=["\\Seen"], imap_keywords=["x"]))
    keys = {(r.fingerprint, r.content_checksum) for r in normalize_messages(rows).ok.collect()}
    assert len(keys) == 1


def _merge(spark, *rows, **options):
    return merge_duplicates(normalize_messages(frame(spark, *rows)).ok, **options)


def test_merge_keeps_first_scalars_and_all_folders(spark):
    rows = [
        message(3, folder="Archive", imap_uid=47, imap_flags=["\\Seen"], imap_keywords=["later"], sender="guest@post.test"),
        message(1, imap_flags=["\\Flagged"]),
        message(5, imap_flags=["\\Seen", "again"]),
        message(7),
    ]
    expected = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        (row,) = _merge(spark, *rows).ok.collect()
        assert row.sender == "maker@post.test" and row.copies == 4 and row.first_seq == 1
        assert row.folders == ["INBOX", "Archive"]
        assert row.folder_uids == {"INBOX": 31, "Archive": 47}
        assert row.folder_flags == {"INBOX": ["\\Seen", "again"], "Archive": ["\\Seen"]}
        assert row.folder_keywords == {"Archive": ["later"]}
        assert expected in (None, row)
        expected = row


def test_merge_conflicts(spark):
    with pytest.raises(Exception, match="different content"):
        _merge(spark, message(1), message(2, body="other")).ok.collect()
    with pytest.raises(Exception, match="two UIDs in one folder"):
        _merge(spark, message(1), message(2, imap_uid=32)).ok.collect()
    report = _merge(spark, message(1), message(2, body="other"), message(3, message_id="<x>"), on_conflict="report")
    assert [r.conflict for r in report.conflicts.collect()] == ["different content"]
    assert [r.source_message_id for r in report.ok.collect()] == ["<x>"]


def test_to_document(spark):
    (row,) = to_document(_merge(spark, message(1)).ok).collect()
    assert row.source_type == "email" and row.source_id == "<n-77.q@post.test>" and row.title == "Orchard notes"
    assert row.metadata.folder == "INBOX" and row.metadata.sent_at_iso == "2026-02-03T17:40:00+00:00"
    (bare,) = to_document(_merge(spark, message(1, folder=None)).ok).collect()
    assert bare.metadata.folder is None and bare.metadata.folders == []


def test_rfc822_files(spark, tmp_path):
    multi = EmailMessage()
    multi["Message-ID"] = "<m1@post.test>"
    multi["Subject"] = Header("Grüße", "utf-8").encode()
    multi["From"] = "maker@post.test"
    multi["To"] = "a@post.test, b@post.test"
    multi["Date"] = "Tue, 03 Feb 2026 17:40:00 +0000"
    multi["Reply-To"] = "answer@post.test"
    multi.set_content("plain körper\n")
    multi.add_alternative("<p>html</p>", subtype="html")
    multi.add_attachment("attached", filename="a.txt")
    html = EmailMessage()
    html["Subject"] = "only html"
    html.set_content("<p>x</p>", subtype="html")
    html.add_attachment("notes", filename="n.txt")
    (tmp_path / "1.eml").write_bytes(multi.as_bytes())
    (tmp_path / "2.eml").write_bytes(html.as_bytes())
    (tmp_path / "3.eml").write_bytes(b"Subject: odd\nContent-Type: text/plain; charset=nobody-knows\n\nbody")
    raw = spark.read.format("binaryFile").load(str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    raw = raw.withColumn("fetch", F.lit("1 (FLAGS (\\Seen project-x) BODY[] {1}"))
    rows = {r.file: r for r in parse_rfc822(raw, flags="fetch").collect()}
    one = rows["1.eml"]
    assert (one.message_id, one.subject, one.body) == ("<m1@post.test>", "Grüße", "plain körper\n")
    assert one.to == ["a@post.test", "b@post.test"] and one.cc is None and one.reply_to == ["answer@post.test"]
    assert one.headers["Reply-To"] == "answer@post.test" and one.imap_keywords == ["project-x"]
    assert rows["2.eml"].body == "" and rows["2.eml"].message_id == "" and rows["2.eml"].date_raw == ""
    assert rows["3.eml"].body == "body"
    path = fresh_dir(spark, "parsed")
    assert split_unreadable(parse_rfc822(raw))[1].count() == 0
    parse_rfc822(raw, flags="fetch").withColumn("seq", F.lit(1)).write.parquet(path)
    assert normalize_messages(spark.read.parquet(path)).ok.count() == 3


def test_unreadable_mail_is_set_aside(spark):
    bad = b"Subject: =?utf-8?b?A?=\n\nx"
    raw = spark.createDataFrame([(1, b"Subject: fine\n\nbody"), (2, bad), (3, None)], "seq int, content binary")
    ok, rejected = split_unreadable(parse_rfc822(raw))
    assert [(r.seq, r.subject) for r in ok.collect()] == [(1, "fine")]
    found = {r.seq: r.error for r in rejected.collect()}
    assert set(found) == {2, 3} and found[3] == "no content"
    with pytest.raises(Exception, match="unreadable message"):
        split_unreadable(parse_rfc822(raw), strict=True)[0].count()


def test_checks_run_whatever_is_read(spark):
    clash = _merge(spark, message(1), message(2, body="another text")).ok
    blank = normalize_messages(frame(spark, message(1, subject=" ", body=None)), strict=True).ok
    for rows in (clash, blank):
        for read in (rows, rows.select("subject")):
            with pytest.raises(Exception, match="cannot be merged|neither subject"):
                read.count()


def test_folder_that_lost_all_mail(spark):
    uids = spark.createDataFrame([("INBOX", 5), ("INBOX", 9)], "folder string, uid long")
    validity = spark.createDataFrame([("INBOX", 7, None), ("Desk", 8, 44)], "folder string, uidvalidity long, uidnext long")
    found = {r.folder: tuple(r)[1:] for r in folder_status(uids, validity).collect()}
    assert found == {"INBOX": (2, 7, 10, 9), "Desk": (0, 8, 44, None)}
    assert {r.folder for r in folder_status(uids).collect()} == {"INBOX"}


def test_one_bad_uid_goes_alone(spark):
    row = spark.createDataFrame([(1, '{"folder_uids": {"INBOX": 1, "A": "x", "B": "7"}, "folders": ["INBOX"]}')], "id int, metadata string")
    assert documents_from_json(row).first().metadata.folder_uids == {"INBOX": 1, "B": 7}
