"""Operator 8: final conversations from event logs.

A log has one row an event: conversation, sequence number, kind, message number, role and
text.  Kinds are

* ``message``: the whole message;
* ``start``: an empty message that ``delta`` events then extend;
* ``edit``: a new text for the message; later messages answered the old one and go;
* ``regenerate``: the message begins anew, empty; later messages go;
* ``delete``: the message goes.

The fold is two windows and two aggregations: what a truncation leaves, what follows a
message's last reset, the message's text in order of sequence, the conversation's in order
of messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESETS = ("message", "start", "edit", "regenerate", "delete")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, msg, role, content) after all events (conv_id, seq, kind, msg, role, text).

    seq may be of any type that has an order, structs of numbers too.
    Events without a conversation, sequence number, message number or known kind are left
    out and repeated rows count once.  Of different events with one sequence number the
    greatest reset in order of kind and text counts, and deltas follow it in order of text.  A null text is empty; a message's
    role is its last one that isn't null ('unknown' if none is).  Deltas without a start
    make a message of their own.  Other columns are ignored.
    """
    e = events.select("conv_id", "seq", "kind", "msg", "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.where(F.col("conv_id").isNotNull() & F.col("seq").isNotNull() & F.col("msg").isNotNull() & F.col("kind").isin(*RESETS, "delta")).distinct()
    earlier = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    cut = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(earlier)
    e = e.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    reset = F.col("kind") != "delta"
    own = Window.partitionBy("conv_id", "msg")
    e = e.withColumn("at", F.max(F.when(reset, F.struct("seq", "kind", "text"))).over(own)).withColumn("said", F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).over(own))
    e = e.where(F.col("at").isNull() | ((F.col("at.kind") != "delete") & ((F.col("seq") > F.col("at.seq")) | ((F.col("seq") == F.col("at.seq")) & (((F.col("kind") == F.col("at.kind")) & (F.col("text") == F.col("at.text"))) | ~reset)))))
    part = F.struct("seq", F.when(reset, 0).otherwise(1).alias("after"), F.when(F.col("kind").isin("start", "regenerate"), "").otherwise(F.col("text")).alias("text"))
    parts = F.sort_array(F.collect_list(part))
    return e.groupBy("conv_id", "msg").agg(F.coalesce(F.max("said.role"), F.lit("unknown")).alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("content"))


def template(role: Column, content: Column) -> Column:
    """One rendered message."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), content, F.lit("<|end|>\n"))


def rendered(events: DataFrame) -> DataFrame:
    """(conv_id, n_messages, rendered): each conversation that keeps a message, its messages in order."""
    m = final_messages(events).select("conv_id", F.struct("msg", template(F.col("role"), F.col("content")).alias("text")).alias("m"))
    return m.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.sort_array(F.collect_list("m")), lambda x: x["text"]), "").alias("rendered"))


def turn_events(turns: DataFrame) -> DataFrame:
    """Event logs of a table of turns (conv_id, turn, role, text).

    Turns of one role in a row are one message: a user's or system's later turn edits the
    earlier one, an assistant's regenerates it.  Assistant turns are streamed, a delta a
    line.  Of rows with one conversation and turn the least (role, text) counts; rows
    without either are left out.
    """
    t = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    t = t.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    order = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(1))
    t = t.withColumn("new", new).withColumn("msg", F.sum("new").over(order))
    streamed = F.col("role") == "assistant"
    kind = F.when(streamed, F.when(F.col("new") == 1, "start").otherwise("regenerate")).otherwise(F.when(F.col("new") == 1, "message").otherwise("edit"))
    lines = F.split("text", "(?<=\n)")
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), text.alias("text"))
    stream = F.concat(F.array(event(kind, F.lit(""))), F.transform(lines, lambda x: event("delta", x)))
    whole = F.array(event(kind, F.col("text")))
    e = t.select("conv_id", "turn", "msg", "role", F.posexplode(F.when(streamed, stream).otherwise(whole)).alias("i", "e"))
    return e.select("conv_id", F.struct("turn", "i").alias("seq"), "e.kind", "msg", "role", "e.text")
