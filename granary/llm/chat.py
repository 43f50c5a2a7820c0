"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log of events per conversation is sorted by sequence and folded into final messages, which are then rendered with
turn marks. Both steps shuffle on the conversation key alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import table, text_of

START, END = "<|im_start|>", "<|im_end|>\n"
_END_PATTERN = r"<\|im_end\|>\n"
#: Events that begin a message's text anew; a delta adds to what came before it.
RESTARTS = ("create", "edit", "regenerate")


def escaped(text):
    """Put one more backslash between ``<`` and ``|``, so that no text can hold a mark; other text stays as it is."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text):
    """Undo :func:`escaped`."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role):
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role):
    """Undo :func:`escaped_role`: between doubled backslashes, a backslash and n stand for a line feed."""
    parts = F.split(role, r"\\\\", -1)
    return unescaped(F.array_join(F.transform(parts, lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\"))


def as_events(turns: DataFrame) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as one ``create`` event each.

    Rows that repeat a (conv_id, turn) are messages of their own, ordered by role and text. Null role and text count
    as empty; other columns go.
    """
    rows = turns.select("conv_id", F.col("turn").alias("seq"), text_of("role").alias("role"), text_of("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), "role", "text"))
    return rows.select("conv_id", nth.cast("long").alias("message_id"), "seq", F.lit("create").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, message_id, seq, kind, role, text) into messages (conv_id, message_id, seq, role, text).

    Per message, in order of ``seq`` (ties: kind, then text): ``create``, ``edit`` and ``regenerate`` begin the text
    anew, ``delta`` adds to it, ``delete`` removes the message unless a later event begins it anew. The message stands
    where its first event stands; its role is that of its first event that has one. Null text and kind count as empty
    text and ``delta``. An empty log gives no rows.
    """
    order = [F.col("seq").asc_nulls_first(), "kind", "text"]
    one = Window.partitionBy("conv_id", "message_id")
    upto = one.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kind = F.coalesce("kind", F.lit("delta"))
    rows = events.select("conv_id", "message_id", "seq", kind.alias("kind"), "role", text_of("text").alias("text"))
    rows = rows.withColumns(
        {
            "epoch": F.sum(F.when(F.col("kind").isin(*RESTARTS, "delete"), 1).otherwise(0)).over(upto),
            "nth": F.row_number().over(one.orderBy(*order)),
        }
    ).withColumn("last", F.max("epoch").over(one))
    kept = F.when(F.col("epoch") == F.col("last"), F.struct("nth", "kind", "text"))
    return (
        rows.groupBy("conv_id", "message_id")
        .agg(
            F.min("seq").alias("seq"),
            F.min(F.when(F.col("role").isNotNull(), F.struct("nth", "role")))["role"].alias("role"),
            F.array_sort(F.collect_list(kept)).alias("parts"),
        )
        .filter(~F.exists("parts", lambda p: p["kind"] == "delete"))
        .select("conv_id", "message_id", "seq", text_of("role").alias("role"), F.array_join(F.col("parts.text"), "").alias("text"))
    )


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Render folded messages: one row per conversation with ``formatted``, ``n_turns`` and ``loss_spans``.

    A turn is ``<|im_start|>role``, a line feed, the escaped text, ``<|im_end|>`` and a line feed. ``loss_spans`` holds
    (start, length) in code points of ``formatted`` for each text of the ``trained`` roles.
    """
    at = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), "message_id")
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    rows = messages.select("conv_id", "message_id", "seq", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + F.lit(len(END))
    rows = rows.withColumns(
        {"nth": F.row_number().over(at), "start": F.coalesce(F.sum(size).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")}
    )
    turn = F.struct("nth", F.concat("head", "body", F.lit(END)).alias("text"), "start", F.length("body").alias("length"), F.col("role").isin(*trained).alias("trained"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.text"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].cast("int").alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def parse(rendered: DataFrame) -> DataFrame:
    """Read ``formatted`` and ``loss_spans`` back: ``turns`` array of (role, text) and ``loss_texts``, unescaped."""
    pieces = F.split(F.col("formatted"), _END_PATTERN, -1)
    body = lambda p: F.substr(p, F.lit(len(START) + 1))
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescaped_role(F.substring_index(body(p), "\n", 1)).alias("role"),
            unescaped(F.substr(body(p), F.length(F.substring_index(body(p), "\n", 1)) + 2)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return rendered.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Turns to rendered conversations, through the event log."""
    return render(fold(as_events(turns)))


def probe(spark: SparkSession) -> DataFrame:
    """The planted conversation -1 whose texts are made of another template's control strings."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    read = parse(format_chats(turns.unionByName(probe(spark))))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length('<|im_start|>') + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + length('<|im_end|>') + 1 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
