from lettermill.sources import rfc822


def test_a_header_is_decoded_once(monkeypatch):
    asked = []
    decode = rfc822.decode_header
    monkeypatch.setattr(rfc822, "decode_header", lambda text: asked.append(text) or decode(text))
    row = rfc822._row(b"Subject: =?utf-8?B?w6k=?=\nFrom: a@example.com\nX-Copy: =?utf-8?B?w6k=?=\n\nbody")
    assert row["subject"] == row["headers"]["Subject"] == row["headers"]["X-Copy"] == "é" and row["error"] is None
    assert sorted(asked) == ["=?utf-8?B?w6k=?=", "a@example.com"]


def test_rows_leave_in_pieces(spark, monkeypatch):
    """What is parsed goes back after some bytes of messages; kept columns stay with their rows."""
    monkeypatch.setattr(rfc822, "PIECE", 50)
    rows = [(i, None if i == 3 else f"Subject: s{i}\n\nbody {i}".encode(), [f"k{i}"]) for i in range(20)]
    parsed = rfc822.parse_rfc822(spark.createDataFrame(rows, "id int, content binary, more array<string>").coalesce(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
    got = {r.id: (r.subject, r.body, r.more, r.error) for r in parsed.collect()}
    assert got == {i: (None, None, [f"k{i}"], "no content") if i == 3 else (f"s{i}", f"body {i}", [f"k{i}"], None) for i in range(20)}
