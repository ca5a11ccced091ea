"""Chat formatting from an event log, with DataFrame functions only.

Log entries are ``(conv_id, seq, sub, message_id, kind, role, text)``. ``seq, sub`` is the entry's
place in its conversation. Kinds: ``message`` opens a message with its role and first text;
``delta`` appends a streamed piece; ``edit`` replaces the text; ``regenerate`` drops the text so
far, for the deltas that follow. A message's place is that of its first entry.

The template writes a turn as ``<s>role[INST]text[/INST]``, or, under the loss mask (role
``assistant``), as ``<s>role[INST]text</s>``. Inside roles and texts a backslash is doubled and
each control string gets a backslash after its first character, so that none is left; dropping
one backslash before each character it guards gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, TEXT, CLOSE, LOSS_CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"(<|\[)(/?(?:s>|INST\]))"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def row_events(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as a log: each opens a message and streams its halves.

    A null text is empty, a null role is the empty role. Every row is a message of its own, also
    where rows repeat a turn. Columns besides these four are ignored, whatever their names; an
    empty table makes an empty log.
    """
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    entry = lambda sub, kind, part: F.struct(F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), part.alias("text"))
    events = F.array(
        entry(0, "message", F.lit("")), entry(1, "delta", F.substring(text, F.lit(1), half)), entry(2, "delta", F.substring(text, half + 1, F.length(text)))
    )
    numbered = rows.select("conv_id", F.col("turn").alias("seq"), F.coalesce("role", F.lit("")).alias("role"), "text", F.monotonically_increasing_id().alias("message_id"))
    exploded = numbered.select("conv_id", "seq", "message_id", "role", F.explode(events).alias("e"))
    return exploded.select("conv_id", "seq", "e.sub", "message_id", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, seq, sub, role, text)`` of a log.

    Only the entries from a message's last ``message``, ``edit`` or ``regenerate`` on make its
    text; its role is the first that is given. Entries at one place are taken in order of kind
    and text. A message that only has deltas is made of all of them. A null text is empty, a
    message without role has the empty one. Other columns are ignored.
    """
    folded = events.groupBy("conv_id", "message_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "sub", "kind", "text", "role"))).alias("log")
    )
    place = lambda e: F.struct(e["seq"], e["sub"])
    last = F.array_max(F.transform(F.filter("log", lambda e: e["kind"] != "delta"), place))
    live = F.filter("log", lambda e: F.col("last").isNull() | (place(e) >= F.col("last")))
    return folded.withColumn("last", last).select(
        "conv_id",
        F.col("log")[0]["seq"].alias("seq"),
        F.col("log")[0]["sub"].alias("sub"),
        F.coalesce(F.get(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted)``: the turns of each conversation in order of place, role and text.

    The result is one text a conversation, so that a conversation is as long as one value may be.
    Rows without conv_id are one conversation. Other columns are ignored.
    """
    turns = F.sort_array(F.collect_list(F.struct("seq", "sub", "role", "text")))

    def shown(m: Column) -> Column:
        close = F.when(m["role"] == LOSS_ROLE, LOSS_CLOSE).otherwise(CLOSE)
        return F.concat(F.lit(OPEN), escape(m["role"]), F.lit(TEXT), escape(m["text"]), close)

    return messages.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.array_join(F.transform("turns", shown), "").alias("formatted"))


def parse(formatted: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns)``: turns ``(role, text, loss)`` as read from the rendered form."""

    def turn(c: Column) -> Column:
        role = F.substring_index(c, TEXT, 1)
        rest = F.substring(c, F.length(role) + len(TEXT) + 1, F.length(c))
        loss = F.endswith(rest, F.lit(LOSS_CLOSE))
        text = F.substring(rest, F.lit(1), F.length(rest) - F.when(loss, len(LOSS_CLOSE)).otherwise(len(CLOSE)))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), loss.alias("loss"))

    chunks = F.split("formatted", OPEN)
    return formatted.withColumn("turns", F.transform(F.slice(chunks, F.lit(2), F.size(chunks)), turn))


def digest(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return parsed.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
