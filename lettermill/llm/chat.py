"""Chat formatting by event sourcing: a log of conversation events is folded into final messages, which are rendered.

Everything is DataFrame functions. Events of one message are gathered by (conversation, message), so a conversation with many events
is folded by many tasks; only its final messages meet, once, because its formatted text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The strings chat templates use for control, as a pattern of first character and rest.
FIRST, REST = r"[<\[]", r"(?:/?s>|/?INST\]|</?SYS>>|\|(?:im_start|im_end|system|user|assistant|endoftext)\|>)"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape_controls(text: Column) -> Column:
    """One backslash goes between the first character of a control string and the rest, also where backslashes stand there already."""
    return F.regexp_replace(text, rf"({FIRST})(?=\\*{REST})", r"$1\\")


def unescape_controls(text: Column) -> Column:
    return F.regexp_replace(text, rf"({FIRST})\\(?=\\*{REST})", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, role, text, first_seq) of ``events`` (conv_id, seq, message_id, kind, role, text).

    Kinds: ``message`` and ``edit`` set the text, ``regenerate`` clears it, ``delta`` adds to it. What a message consists of is its
    last ``message``, ``edit`` or ``regenerate`` and the deltas after it, by ``seq``. The role is the last one given. Ties of ``seq``
    go by kind (``delta`` last), then text: a defined order, so that repeated deltas add twice and repeated edits once. Null texts
    are empty, null kinds are deltas. A message of deltas only starts empty. Null ids form one group of their own. Events of unknown
    kind count as deltas. Other columns are ignored; an empty log gives no messages.
    """
    sets = F.col("kind").isin("message", "edit", "regenerate")
    own = events.select(
        "conv_id", "message_id", "seq", F.coalesce(sets, F.lit(False)).alias("sets"), "role",
        F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )
    gathered = own.groupBy("conv_id", "message_id").agg(
        F.max(F.when(F.col("sets"), F.struct("seq", "text"))).alias("base"),
        F.sort_array(F.collect_list(F.when(~F.col("sets"), F.struct("seq", "text")))).alias("deltas"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.min("seq").alias("first_seq"),
    )
    later = F.filter("deltas", lambda d: F.col("base").isNull() | F.col("base.seq").isNull() | (d["seq"] >= F.col("base.seq")))
    text = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    return gathered.select("conv_id", "message_id", "role", text.alias("text"), "first_seq")


def render(messages: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: (conv_id, n_turns, formatted, loss_spans).

    ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Roles are URL-encoded, control strings in texts escaped, so that
    :func:`read_back` gives exactly what went in. ``loss_spans`` are (start, length) in characters of ``formatted``: the texts of
    ``train_roles``. Messages are ordered by (first_seq, role, text, message_id).
    """
    role, text = F.url_encode(F.coalesce("role", F.lit(""))), escape_controls(F.coalesce("text", F.lit("")))
    made = messages.select("conv_id", "first_seq", "message_id", role.alias("role"), text.alias("text"))
    turns = made.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("first_seq", "role", "text", "message_id", F.length("text").alias("n")))).alias("turns")
    )
    trained = [r for r in train_roles]
    head = len(OPEN) + 1  # and the newline after the role
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + head + F.length(t["role"]) + t["n"] + len(CLOSE)).alias("at"),
            F.when(
                t["role"].isin(trained),
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + head + F.length(t["role"])).alias("start"), t["n"].cast("bigint").alias("length"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    rendered = F.array_join(
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), ""
    )
    return turns.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), rendered.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained texts of :func:`render`'s output, from its ``formatted`` and ``loss_spans`` alone.

    Adds ``turns`` (array of role, text) and ``loss_text``.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.lit(2), F.size(F.split("formatted", r"<\|im_start\|>", -1)))
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescape_controls(
                F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)
            ).alias("text"),
        ),
    )
    loss = F.array_join(
        F.transform("loss_spans", lambda s: unescape_controls(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def format_chats(events: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Fold the log and render its conversations, see :func:`fold_events` and :func:`render`."""
    return render(fold_events(events), train_roles)
