"""One key with a third or more of all rows: whole results, and plans that combine before they shuffle."""

from pyspark.sql import functions as F

from lettermill.catalog import queries
from lettermill.operators.merge import merge_duplicates
from lettermill.operators.normalize import normalize_messages, to_document
from lettermill.operators.sync import latest_sync_state
from lettermill.plans.reports import report_flags_detail, report_terms_summary


def _mail(spark, n=6000):
    hot = F.col("id") % 3 == 0
    return spark.range(n).repartition(8).select(
        F.col("id").alias("seq"),
        F.when(hot, F.lit("<hot@example.com>")).otherwise(F.concat(F.lit("<"), F.col("id").cast("string"), F.lit("@example.com>"))).alias("message_id"),
        F.lit("Subject").alias("subject"),
        F.lit("Body").alias("body"),
        F.when(hot, F.concat(F.lit("F"), (F.col("id") % 21).cast("string"))).otherwise(F.lit("INBOX")).alias("folder"),
        F.lit(None).cast("long").alias("imap_uid"),
        F.array(F.lit("\\Seen"), F.concat(F.lit("t"), (F.col("id") % 2).cast("string"))).alias("imap_flags"),
        F.array(F.concat(F.lit("t"), (F.col("id") % 2).cast("string"))).alias("imap_keywords"),
    )


def test_hot_message(spark):
    merged = merge_duplicates(normalize_messages(_mail(spark), rare_dates=False).ok).ok
    hot = merged.where("copies > 1").collect()
    assert len(hot) == 1 and hot[0].copies == 2000 and hot[0].first_seq == 0
    assert hot[0].folders == [f"F{i % 21}" for i in range(0, 21, 3)]
    assert set(hot[0].folder_flags) == set(hot[0].folders)
    assert merged.count() == 4001
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "partial_max_by" in plan and "Window" not in plan and "Cartesian" not in plan


def test_hot_term_counts_are_exact(spark):
    documents = to_document(merge_duplicates(normalize_messages(_mail(spark), rare_dates=False).ok).ok)
    # Many documents with one source id: few distinct references.
    documents = documents.withColumn("source_id", F.when(F.col("source_id") != "<hot@example.com>", F.lit("shared")))
    rows = {(r.term_type, r.folder_name, r.term): (r.term_occurrences, r.message_count, r.unique_message_refs) for r in report_terms_summary(documents).collect()}
    assert rows[("flag", "INBOX", "\\Seen")] == (4000, 4000, 1)
    assert rows[("flag", "ALL_FOLDERS", "\\Seen")] == (4007, 4001, 2)
    detail = report_flags_detail(documents)
    assert detail.count() == 4007


def test_folder_named_like_the_total_stays_apart(spark):
    mail = _mail(spark, 2).withColumn("folder", F.lit("ALL_FOLDERS"))
    rows = report_terms_summary(to_document(merge_duplicates(normalize_messages(mail, rare_dates=False).ok).ok)).where("term = '\\\\Seen'")
    assert [r.message_count for r in rows.collect()] == [2, 2]


def test_hot_cursor_history(spark):
    states = spark.range(5000).select(
        F.lit("u").alias("imap_user"), F.lit("h").alias("imap_host"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("imap_folder"),
        F.lit(1).cast("long").alias("uidvalidity"), F.col("id").alias("last_synced_uid"), F.timestamp_seconds("id").alias("last_sync_time"),
        F.lit("r").alias("sync_run_id"), F.lit(0).cast("long").alias("total_emails_in_folder"),
    )
    latest = latest_sync_state(states)
    assert latest.where("imap_folder = 'Hot'").first().last_synced_uid == 4998
    assert "partial_max_by" in latest._jdf.queryExecution().executedPlan().toString()


def test_reports_shuffle_no_texts(spark):
    """Who reads no text of a merged message has none in the aggregation of its copies."""
    documents = queries._documents(spark, "/root/testdata/sf0.001")
    plan = report_terms_summary(documents)._jdf.queryExecution().executedPlan().toString()
    assert "min_by(struct(source_message_id" in plan and "min_by(struct(body" not in plan
    assert "min_by(struct(body" in documents.select("body")._jdf.queryExecution().executedPlan().toString()
