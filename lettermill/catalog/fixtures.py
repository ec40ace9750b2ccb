"""Mail and task shapes derived from the given tables, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.flags import keywords_of, parse_flags, split_recipients

FOLDERS = ["INBOX", "Archive", "Receipts"]
TODAY = "2026-04-28"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """On a local master, bring rows of one small file to all cores. A cluster's tables come in many splits and are left as they are."""
    context = rows.sparkSession.sparkContext
    return rows.repartition(context.defaultParallelism, key) if context.master.startswith("local[") else rows


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def mail_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One to three folder copies of every document as unparsed mail. Works on a streaming input, too."""
    d = documents.join(labels, "doc_id", "left").withColumn(
        "i", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int")))
    )
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), F.col("i") + 1)
    seq = F.col("doc_id") * 4 + F.col("i")
    flag = lambda cond, text: F.when(cond, text).otherwise("")
    return d.select(
        seq.alias("seq"),
        F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("<"), _text("doc_id"), F.lit("@example.com>"))).alias(
            "message_id"
        ),
        F.concat(F.lit("Note "), _text("doc_id"), F.lit(" from "), "source").alias("subject"),
        F.concat("source", F.lit("@example.com")).alias("sender"),
        F.concat(F.lit("team-"), "lang", F.lit("@example.com, all@example.com")).alias("to_raw"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("not-a-real-email-date"))
        .otherwise(
            F.concat(
                (F.col("doc_id") % 28 + 1).cast("string"),
                F.lit(" Apr 2026 09:15:00 "),
                F.when(F.col("doc_id") % 2 == 0, "+0000").otherwise("-0500"),
            )
        )
        .alias("date_raw"),
        F.col("text").alias("body"),
        folder.alias("folder"),
        (seq + 1).alias("imap_uid"),
        F.concat(
            F.lit("FLAGS (\\Seen"),
            flag((F.col("quality") == 1) & (F.col("i") == 0), " \\Flagged"),
            flag(F.col("toxic") == 1, " junk"),
            F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" lang-"), "lang")).otherwise(""),
            F.lit(")"),
        ).alias("flags_raw"),
        F.date_add(F.lit("2026-04-01").cast("date"), (F.col("doc_id") % 28).cast("int")).alias("received_date"),
    )


def mail_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mail_of(spread(documents, "doc_id"), table(spark, sf_dir, "labels"))


def parsed(mail: DataFrame) -> DataFrame:
    """Unparsed mail to the message schema."""
    flags = parse_flags(F.col("flags_raw"))
    return mail.select(
        "seq",
        "message_id",
        "subject",
        "sender",
        split_recipients(F.col("to_raw")).alias("to"),
        "date_raw",
        "body",
        "folder",
        "imap_uid",
        flags.alias("imap_flags"),
        keywords_of(flags).alias("imap_keywords"),
        "received_date",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(mail_messages(spark, sf_dir))


def server_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = mail_messages(spark, sf_dir).where(F.col("imap_uid") % 11 != 0)
    return mail.select("folder", F.col("imap_uid").alias("uid"))


def folder_state(uids: DataFrame) -> DataFrame:
    """What the server says per folder: UIDVALIDITY 999 everywhere."""
    return uids.groupBy("folder").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.lit(999).cast("long").alias("uidvalidity"),
        (F.max("uid") + 1).alias("uidnext"),
    )


def stored_sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        mail_messages(spark, sf_dir)
        .groupBy("folder")
        .agg((F.max("imap_uid") - 400).alias("last_synced_uid"))
        .select(
            F.lit("user@example.com").alias("imap_user"),
            F.lit("imap.example.com").alias("imap_host"),
            F.col("folder").alias("imap_folder"),
            F.when(F.col("folder") == "Receipts", 998).otherwise(999).cast("long").alias("uidvalidity"),
            "last_synced_uid",
            F.lit("2026-04-10 10:00:00").cast("timestamp").alias("last_sync_time"),
            F.lit("run-previous").alias("sync_run_id"),
            F.lit(0).cast("long").alias("total_emails_in_folder"),
        )
    )


def task_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("area-"), _text("r_regionkey")).alias("uuid"), F.col("r_name").alias("title")
    )


def task_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return c.select(
        F.concat(F.lit("project-"), _text("c_custkey")).alias("uuid"),
        F.col("c_name").alias("title"),
        F.concat(F.lit("area-"), _text("n_regionkey")).alias("area"),
        F.when(F.col("c_custkey") % 4 == 0, "   ").when(F.col("c_custkey") % 4 != 1, F.col("c_mktsegment")).alias("notes"),
        F.when(F.col("c_acctbal") < 0, "completed").otherwise("incomplete").alias("status"),
        (F.col("c_custkey") % 17 == 0).alias("trashed"),
    )


def task_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Customer and priority tell headings apart; they are much shorter than the texts made of them.
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    return o.select(
        F.concat(F.lit("heading-"), _text("o_custkey"), F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("uuid"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("project-"), _text("o_custkey")).alias("project"),
        F.lit("incomplete").alias("status"),
        F.lit(False).alias("trashed"),
        F.lit("heading").alias("type"),
    )


def _todos(orders: DataFrame, *more: Column) -> DataFrame:
    return orders.select(
        F.concat(F.lit("todo-"), _text("o_orderkey")).alias("uuid"),
        F.when(F.col("o_orderkey") % 50 == 0, " ")
        .otherwise(F.concat(F.lit("Order "), _text("o_orderkey")))
        .alias("title"),
        F.concat(F.lit("project-"), _text("o_custkey")).alias("project"),
        F.concat(F.lit("heading-"), _text("o_custkey"), F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias(
            "heading"
        ),
        F.when(
            F.col("o_orderkey") % 3 == 0,
            F.concat(F.lit("Total "), F.floor("o_totalprice").cast("string")),
        )
        .otherwise("")
        .alias("notes"),
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", "canceled")
        .otherwise("incomplete")
        .alias("status"),
        (F.col("o_orderkey") % 29 == 0).alias("trashed"),
        *more,
    )


def _has_checklist() -> Column:
    return F.col("o_orderkey") % 2 == 0


def task_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _todos(table(spark, sf_dir, "orders"), _has_checklist().alias("has_checklist"))


def _item(line: Callable[[str], Column]) -> dict[str, Column]:
    """The fields of a checklist item; ``line`` gives the columns of its row of lineitem."""
    keys = [line(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return {
        "uuid": F.concat_ws("-", F.lit("check"), *keys),
        "todo_uuid": F.concat(F.lit("todo-"), keys[0]),
        "pos": line("l_linenumber"),
        "title": F.concat(F.lit("Part "), line("l_partkey").cast("string")),
        "status": F.when(line("l_linestatus") == "F", "completed").otherwise("incomplete"),
    }


def task_checklist_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[c.alias(name) for name, c in _item(F.col).items()])


def task_todos_with_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The to-dos of an export: every third one carries its items, the others a flag.

    Only what goes into a list is shuffled, and as it is in the tables: the texts of items and to-dos are made after the join.
    """
    orders = table(spark, sf_dir, "orders")
    third = F.coalesce(F.col("o_orderkey") % 3 == 0, F.lit(False))
    line = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 3 == 0)
    lists = lines.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    named = lambda fields, *names: F.struct(*[fields[c].alias(c) for c in names])
    entries = F.array_sort(F.transform("lines", lambda e: named(_item(e.getField), "pos", "uuid", "title", "status")))
    as_json = F.to_json(F.transform(entries, lambda e: F.struct(e["uuid"].alias("uuid"), e["title"].alias("title"), e["status"].alias("status"))))
    carrying = orders.where(third).join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    flagged = _todos(orders.where(~third), _has_checklist().cast("string").alias("checklist"))
    return flagged.unionByName(_todos(carrying, as_json.alias("checklist")))


def task_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items as one table, as an export file has them."""
    parts = {
        "area": task_areas(spark, sf_dir),
        "project": task_projects(spark, sf_dir),
        "heading": task_headings(spark, sf_dir),
        "to-do": task_todos_with_lists(spark, sf_dir),
        "checklist-item": task_checklist_items(spark, sf_dir).withColumn("pos", F.col("pos").cast("long")),
    }
    typed = [rows.withColumn("type", F.lit(kind)) for kind, rows in parts.items()]
    export = typed[0]
    for rows in typed[1:]:
        export = export.unionByName(rows, allowMissingColumns=True)
    # A checklist is a JSON value, not a text that holds one.
    return export.withColumn("checklist", F.parse_json("checklist"))


def _escaped(data: Column, break_lines: bool) -> Column:
    """Every byte as =XX, in lines of 24 bytes if asked."""
    escaped = F.regexp_replace(F.hex(data), "(..)", "=$1")
    return F.regexp_replace(escaped, "(.{72})", "$1=\n") if break_lines else escaped


def _latin(text: Column) -> Column:
    """What Latin-1 has no letter for becomes a question mark."""
    return F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "ISO-8859-1")


def encoded_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an RFC 822 message (doc_id, content): whole texts as subject and body, in the encodings mail has.

    Subjects by ``doc_id % 4``: folded base64 words; ASCII and a quoted word; a quoted word in Latin-1; words of two charsets with plain text
    between them. Bodies by ``doc_id % 6``: base64; an attached text before the text; an alternative with markup first, the text
    quoted-printable in a part within a part; Latin-1 as it is; markup alone; quoted-printable.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = spread(documents, "doc_id")
    text, key = F.col("text"), F.col("doc_id")
    base64 = F.base64(F.encode(text, "UTF-8"))
    one_line = F.regexp_replace(base64, "\r?\n", "")

    def word(charset: str, encoding: str, payload: Column) -> Column:
        return F.concat(F.lit(f"=?{charset}?{encoding}?"), payload, F.lit("?="))

    folded = F.regexp_replace(F.regexp_replace(one_line, "(.{1,60})", "=?utf-8?B?$1?=\n "), "\n $", "")
    quoted = word("UTF-8", "q", F.regexp_replace(_escaped(F.encode(text, "UTF-8"), False), "=20", "_"))
    latin = word("iso-8859-1", "Q", _escaped(_latin(text), False))
    subject = (
        F.when(key % 4 == 0, folded)
        .when(key % 4 == 1, F.concat(F.lit("Re: "), quoted))
        .when(key % 4 == 2, latin)
        .otherwise(F.concat(word("utf-8", "b", one_line), F.lit(" and "), latin))
    )

    def part(kind: str, encoding: str, payload: Column, more: str = "") -> Column:
        return F.concat(F.lit(f"Content-Type: {kind}\nContent-Transfer-Encoding: {encoding}\n{more}\n"), payload, F.lit("\n"))

    def parts(kind: str, boundary: str, *inner: Column) -> Column:
        opened = [F.concat(F.lit(f"--{boundary}\n"), p) for p in inner]
        return F.concat(F.lit(f'Content-Type: multipart/{kind}; boundary="{boundary}"\n\n'), *opened, F.lit(f"--{boundary}--\n"))

    plain, markup = "text/plain; charset=utf-8", "text/html; charset=utf-8"
    attached = part(plain, "base64", F.base64(F.encode(F.concat(F.lit("attached "), text), "UTF-8")), 'Content-Disposition: ATTACHMENT; filename="a.txt"\n')
    quoted_text = _escaped(F.encode(text, "UTF-8"), True)
    html = part(markup, "base64", base64)
    rest = (
        F.when(key % 6 == 0, part(plain, "base64", base64))
        .when(key % 6 == 1, parts("mixed", "outer", attached, part(plain, "base64", base64)))
        .when(key % 6 == 2, parts("mixed", "outer", parts("alternative", "inner", html, part(plain, "quoted-printable", quoted_text)), attached))
        .when(key % 6 == 3, F.lit("Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\n"))
        .when(key % 6 == 4, parts("alternative", "outer", html))
        .otherwise(F.concat(F.lit(f"Content-Type: {plain}\nContent-Transfer-Encoding: quoted-printable\n\n"), quoted_text))
    )
    raw = F.encode(F.concat(F.lit("Subject: "), subject, F.lit("\nMIME-Version: 1.0\n"), rest), "UTF-8")
    return d.select("doc_id", F.when(key % 6 == 3, F.concat(raw, _latin(text))).otherwise(raw).alias("content"))
