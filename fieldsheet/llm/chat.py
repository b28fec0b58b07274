"""Chat formatting from event logs, with built-in functions only.

A conversation is a log of events ``(conv_id, seq, msg, kind, role, text)``:

* ``message``     starts message ``msg`` (or starts it over) with ``text``;
* ``delta``       appends ``text`` to it (streamed output);
* ``edit``        replaces what it holds so far;
* ``regenerate``  replaces it too, and voids every later message logged before.

``fold`` partitions the log by conversation, sorts by sequence and folds the
events into final messages; ``render`` writes them with one template.

Edge cases: a null or unknown kind counts as ``message``; a null role or text is
empty; events with the same sequence number are ordered by kind, role and text;
repeated rows of a turn table are turns of their own; a null conversation id is
a conversation; empty input gives empty output; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import pick, table

TURN_OPEN, HEAD_CLOSE, TURN_CLOSE = "<|", "|>\n", "</s>\n"
#: Every control string starts with one of these; escaped texts hold neither.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), ("|>", "\\p"))


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` restores the text."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """The backslash comes last: until then each one is followed by its own code letter."""
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def turns_to_events(turns: DataFrame) -> DataFrame:
    """A finished turn table (conv_id, turn, role, text) as an event log, a message a row."""
    t = pick(turns, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    n = F.row_number().over(order).cast("long")
    return t.select("conv_id", n.alias("seq"), n.alias("msg"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, msg, role, text)``; all windows share one shuffle by conv_id."""
    e = pick(events, "conv_id", "seq", "msg", "kind", "role", "text").select(
        "conv_id", "seq", "msg",
        F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise(F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # A regeneration of an earlier message voids what was logged before it.
    earlier = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    voided = F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier)
    e = e.withColumn("voided", voided).where(F.col("voided").isNull() | (F.col("seq") > F.col("voided")))
    order = Window.partitionBy("conv_id", "msg").orderBy("seq", "kind", "role", "text")
    e = e.withColumn("pos", F.row_number().over(order))
    start = F.max(F.when(F.col("kind") != "delta", F.col("pos"))).over(Window.partitionBy("conv_id", "msg"))
    e = e.withColumn("start", F.coalesce(start, F.lit(0))).where("pos >= start")
    part = F.sort_array(F.collect_list(F.struct("pos", "role", "text")))
    return e.groupBy("conv_id", "msg").agg(part.alias("parts")).select(
        "conv_id", "msg",
        F.element_at("parts", 1)["role"].alias("role"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``; a span is ``(start, length)`` in code points of
    ``formatted`` and covers exactly the (escaped) text of one message of the trained role."""
    m = messages.select(
        "conv_id", "msg", "role",
        F.concat(F.lit(TURN_OPEN), escape(F.col("role")), F.lit(HEAD_CLOSE)).alias("head"), escape(F.col("text")).alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit(TURN_CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    span = F.when(F.col("role") == trained_role, F.struct((F.col("offset") + F.length("head")).cast("int").alias("start"), F.length("body").alias("length")))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("msg", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return g.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation as ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(formatted, TURN_CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        end = F.locate(HEAD_CLOSE, p)
        return F.struct(
            unescape(F.substring(p, F.lit(len(TURN_OPEN) + 1), end - F.lit(len(TURN_OPEN) + 1))).alias("role"),
            unescape(F.substring(p, end + F.lit(len(HEAD_CLOSE)), F.length(p))).alias("text"),
        )

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, cut out of the rendered string itself."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + F.lit(1), s["length"]))), "")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")),
    )).alias("t")).select("conv_id", "t.*")
    out = render(fold(turns_to_events(c.unionByName(probe))))
    out = out.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = {"op1_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + 1 * (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', '')))
  + (length(text) - length(replace(text, '[', ''))) AS body,
  length(role) + (length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '[', ''))) AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + head + 10) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""}
