"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is partitioned by conversation and sorted by sequence; streamed deltas, edits and regenerations are
folded into the messages that stand at its end; these are rendered into one string with a loss mask, which can be read
back exactly. The log is shuffled once, by conversation: the fold, the numbering of turns and the rendering all work in
that partitioning. Nothing is copied step by step: a message that is void is found by a running minimum over the events
that follow it, and the pieces of a message or conversation are put together once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<turn>", "</turn>\n"
TRAINED = "assistant"
CHUNK = 160  # code points of a streamed delta in the log that op12 derives
FIRST = -(1 << 63)


def escaped(text: Column) -> Column:
    """text in which no marker occurs: backslashes are doubled, and a marker gets one after its `<`."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<turn"), F.lit("<\\turn")), F.lit("</turn"), F.lit("<\\/turn"))


def unescaped(text: Column) -> Column:
    """The inverse of escaped."""
    return F.regexp_replace(text, r"\\(\\|(?=/?turn))", "$1")


def fold(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, turn, kind, role, text) -> (conv_id, turn, role, text), one row per message that stands.

    By kind, `message` opens a turn (its text may be empty, to be streamed), `delta` appends to it, `edit` replaces its
    text, and `regenerate` opens it anew and voids all later turns logged before. What a turn held before it was opened
    or edited is void. Its role is the last one given (none: empty).

    Events of a conversation that repeat a seq are deliveries of one event: the first by turn, kind, role and text
    counts. Events without seq come before all others, those without turn make up a first message, null texts are empty,
    null conv_ids are one conversation, events of another kind are ignored, further columns too; an empty log gives no
    rows. All events of a conversation meet in one task, which sorts them and spills.
    """
    kinds = ("message", "delta", "edit", "regenerate")
    e = events.select("conv_id", "seq", F.coalesce("turn", F.lit(FIRST)).alias("turn"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    last_first = Window.partitionBy("conv_id").orderBy(F.desc_nulls_last("seq"), *[F.desc_nulls_last(c) for c in ("turn", "kind", "role", "text")])
    follow = last_first.rowsBetween(Window.unboundedPreceding, -1)
    again = F.lead("seq").over(last_first) == F.col("seq")
    e = e.where(F.col("kind").isin(*kinds)).withColumns({"nth": F.row_number().over(last_first), "again": again}).where("again is null or not again")
    live = e.withColumn("void", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(follow)).where("void is null or void >= turn")
    part = F.struct((-F.col("nth")).alias("at"), "text")
    by_turn = live.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(F.col("role").isNotNull(), -F.col("nth"))).alias("role"),
        F.max(F.when(F.col("kind") != "delta", -F.col("nth"))).alias("since"), F.sort_array(F.collect_list(part)).alias("parts"),
    )
    held = F.filter("parts", lambda p: F.col("since").isNull() | (p["at"] >= F.col("since")))
    return by_turn.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(held, lambda p: p["text"]), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> (conv_id, formatted, loss), one row per conversation.

    A turn is `<turn>`, its role (URL-encoded), a line feed, its escaped text, `</turn>` and a line feed. loss has a
    struct for each assistant turn, in order: turn (from 1), begin (code points before its text within the turn),
    length, and offset (code points of formatted before its text). Messages equal in turn are ordered by role and text;
    null roles and texts are empty. A conversation is one row, a string of up to 2 GB.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(F.url_encode(role), F.lit("+"), F.lit("%20")), F.lit("\n"))
    m = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"))
    size = F.length("head") + F.length("body") + len(CLOSE)
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(size.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.select("conv_id", F.row_number().over(w).alias("i"), "role", "head", "body", before.alias("before"))
    begin = F.length("head")
    mask = F.struct(F.col("i").alias("turn"), begin.alias("begin"), F.length("body").alias("length"), (F.col("before") + begin).alias("offset"))
    piece = F.struct("i", F.concat("head", "body", F.lit(CLOSE)).alias("piece"))
    done = m.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"), F.sort_array(F.collect_list(F.when(F.col("role") == TRAINED, mask))).alias("loss")
    )
    return done.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) -> (conv_id, turns, trained, formatted_chars): turns are the structs (role, text) of
    the string, and trained the text under its loss mask, unescaped. Both take time linear in the string."""
    pieces = F.split("formatted", OPEN)
    p = formatted.select("conv_id", "loss", F.length("formatted").cast("long").alias("formatted_chars"), F.slice(pieces, F.lit(2), F.size(pieces)).alias("pieces"))
    line = lambda x: F.locate("\n", x)

    def turn(x: Column) -> Column:
        body = x.substr(line(x) + 1, F.length(x) - line(x) - len(CLOSE))
        return F.struct(F.url_decode(x.substr(F.lit(1), line(x) - 1)).alias("role"), unescaped(body).alias("text"))

    def masked(s: Column) -> Column:
        return F.element_at("pieces", s["turn"]).substr(s["begin"] - len(OPEN) + 1, s["length"])

    trained = F.array_join(F.transform("loss", lambda s: unescaped(masked(s))), "")
    return p.select("conv_id", F.transform("pieces", turn).alias("turns"), trained.alias("trained"), "formatted_chars")


def logged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a log that fold makes the same messages from, turns numbered from 1.

    By a hash of conversation and turn, a message is sent at once, streamed in deltas of CHUNK code points, sent as its
    first half and then edited, or (an assistant's) streamed backwards, followed by a next turn and regenerated. Rows
    equal in turn are ordered by role and text, null turns first, and each is a message, also one that repeats another.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(w).cast("long").alias("k"))
    way = F.pmod(F.xxhash64(F.col("conv_id"), F.col("k")), F.lit(4))

    def event(kind: str, text: Column, after: int = 0) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.col("k") + after).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))

    def streamed(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda t: event("delta", t))

    opened, text = F.array(event("message", F.lit(""))), F.col("text")
    half = F.left(text, F.floor(F.length(text) / 2).cast("int"))
    edited = F.concat(F.array(event("message", half), event("edit", F.lit(""))), streamed(text))
    again = F.concat(opened, streamed(F.reverse(text)), F.array(event("message", half, 1), event("regenerate", F.lit(""))), streamed(text))
    events = F.when(way == 0, F.array(event("message", text))).when(way == 1, F.concat(opened, streamed(text)))
    events = events.when((way == 3) & (F.col("role") == TRAINED), again).otherwise(edited)
    e = c.select("conv_id", "k", F.posexplode(events).alias("pos", "event"))
    return e.select("conv_id", (F.shiftleft("k", 31) + F.col("pos")).alias("seq"), "event.turn", "event.kind", "event.role", "event.text")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 1, "user", said), (-7, 2, TRAINED, said)], "conv_id long, turn long, role string, text string"))
    back = read_back(rendered(fold(logged(rows))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), digest(F.col("trained")).alias("loss_sha256"), "formatted_chars",
    )


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 2, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn') AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn>') + length(url_encode(role)) + 1 + length(body) + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
