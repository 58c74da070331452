"""Chat formatting from event logs: fold each conversation's events into final messages, then render them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Inside roles and texts these characters stand as escapes, so that no text can hold a control string of the template.
#: Each escape is a backslash and a letter; the backslash itself comes first when escaping and last when reading back.
ESCAPES = {"\\": "\\s", "<": "\\l", ">": "\\g"}
TURN_END = "</turn>\n"


def escape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES.items(), c)


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES.items()), c)


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq, nth, role, text) of a log (conv_id, seq, kind, target, role, text).

    kind 'message' opens a message whose number is its own seq. 'delta' appends to a message, 'edit' and 'regenerate'
    replace its text (deltas may follow), 'delete' takes it away; their target is the message's seq, null: the latest
    message that the log has by then. A null kind opens a message. Events of one seq apply by kind's place in
    message, regenerate, edit, delta, delete, then by role and text. Messages that share a seq all stay, ordered by role and text; events go
    to the first of them. Null texts are empty, null roles too; a null seq comes first, a null conv_id is a conversation.
    Events without a message to apply to have no effect.
    """
    kinds = ["message", "regenerate", "edit", "delta", "delete"]
    kind = F.coalesce("kind", F.lit("message"))
    e = events.select(
        "conv_id", F.col("seq").cast("bigint").alias("seq"), kind.alias("kind"), F.col("target").cast("bigint").alias("target"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), kind), F.lit(0)), F.lit(9)).alias("place"),
    )
    opens = F.col("kind") == "message"
    in_order = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), "place", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("of", F.when(opens, F.struct("seq")).otherwise(F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("seq"))).otherwise(F.last(F.when(opens, F.struct("seq")), ignorenulls=True).over(in_order))))
    e = e.withColumn("nth", F.when(opens, F.row_number().over(Window.partitionBy("conv_id", "of", opens).orderBy("role", "text"))).otherwise(F.lit(1)))
    e = e.where("of is not null")
    log = F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(-(2**63))).alias("seq"), "place", "role", "kind", "text")))
    m = e.groupBy("conv_id", "of", "nth").agg(log.alias("log"))
    m = m.where(F.exists("log", lambda x: x["kind"] == "message") & ~F.exists("log", lambda x: x["kind"] == "delete"))
    last_whole = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"].isin("message", "edit", "regenerate"), i).otherwise(F.lit(-1))))
    m = m.withColumn("from", last_whole)
    kept = F.filter(F.slice("log", F.col("from") + 1, F.size("log")), lambda x: x["kind"].isin("message", "edit", "regenerate", "delta"))
    role = F.filter("log", lambda x: x["kind"] == "message")[0]["role"]
    return m.select("conv_id", F.col("of")["seq"].alias("seq"), "nth", role.alias("role"), F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) of messages as fold() returns them.

    Each turn is "<turn ROLE>", a line break, its text and "</turn>" with a line break, roles and texts escaped.
    loss_spans: the code points [start, end) of the texts of roles in learn_from. One row holds one conversation.
    """
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n"))
    m = messages.select("conv_id", "seq", "nth", F.col("role").isin(*learn_from).alias("learn"), head.alias("head"), escape(F.col("text")).alias("body"))
    here = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), "nth")
    whole = F.length("head") + F.length("body") + len(TURN_END)
    m = m.withColumn("start", F.coalesce(F.sum(whole).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    m = m.withColumn("end", F.col("start") + F.length("body"))
    turns = F.array_sort(F.collect_list(F.struct("start", "end", "learn", F.concat("head", "body", F.lit(TURN_END)).alias("piece"))))
    m = m.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return m.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, TURN_END), lambda p: p != "")
    part = lambda p, i: unescape(F.regexp_extract(p, r"(?s)\A<turn ([^>]*)>\n(.*)\z", i))
    return F.transform(pieces, lambda p: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digest(rendered: DataFrame) -> DataFrame:
    """Figures of each conversation, all read back from what render() wrote."""
    r = rendered.withColumns({"turns": parse(F.col("formatted")), "learnt": loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of conversations as a log, and conversation -7, whose texts hold control strings."""
    rows = conversations.select("conv_id", F.col("turn").alias("seq"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return rows.unionByName(probe).withColumns({"kind": F.lit("message"), "target": F.lit(None).cast("bigint")})


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g')) + length(replace(replace(replace(text, '\', '\s'), '<', '\l'), '>', '\g')) + 16 AS n FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt, sum(n) AS n FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, n::BIGINT AS formatted_chars FROM g
"""
