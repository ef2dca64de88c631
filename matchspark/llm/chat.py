"""Chat formatting from event logs: fold deltas, edits and regenerations into messages, then render with a loss mask."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prefix_sums

ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("|", "\\p"))     # afterwards no text holds < or |, and a backslash only before s, l or p
OPEN, SHUT, END, TRAINED, PIECE, STREAM = "<|", "|>", "</s>", "assistant", 256, 400


def escape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), ESCAPES[::-1], text)


def event_log(turns: DataFrame) -> DataFrame:
    """A streamed log of finished conversations: conv_id, turn, tie, seq, event, role, text.

    Assistant turns are a draft, a regeneration and deltas of STREAM characters; user turns a first half and an edit to the whole
    text; any other turn its deltas. Rows of one turn keep apart by `tie` (ordered by role and text).
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("tie", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / STREAM).cast("int")), lambda i: F.struct(
        F.lit("delta").alias("event"), F.substring(F.col("text"), i * STREAM + 1, F.lit(STREAM)).alias("text")))

    def one(kind: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("event"), value.alias("text")))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    log = (F.when(F.col("role") == TRAINED, F.concat(one("delta", half), one("regenerate", F.lit("")), deltas))
           .when(F.col("role") == "user", F.concat(one("delta", half), one("edit", F.col("text")))).otherwise(deltas))
    return rows.select("conv_id", "turn", "tie", "role", F.posexplode_outer(log).alias("seq", "e")).select(
        "conv_id", "turn", "tie", "seq", F.col("e.event").alias("event"), "role", F.col("e.text").alias("text"))


def fold(log: DataFrame) -> DataFrame:
    """conv_id, turn, tie, role and final text of every message, its events taken by seq.

    A delta appends, an edit replaces what stands, a regeneration starts anew. Events meet per message, so that a long
    conversation spreads over tasks. Null texts append nothing; a null role or kind of event is kept as empty, or ignored.
    """
    events = log.groupBy("conv_id", "turn", "tie").agg(F.array_sort(F.collect_list(F.struct(
        "seq", F.coalesce("event", F.lit("")).alias("event"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")))).alias("events"))
    reset = F.array_max(F.transform("events", lambda e, i: F.when(e["event"].isin("edit", "regenerate"), i).otherwise(0)))
    live = F.filter(F.slice("events", reset + 1, F.size("events")), lambda e: e["event"].isin("delta", "edit"))
    return events.select("conv_id", "turn", "tie", F.element_at("events", -1)["role"].alias("role"),
                         F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """The formatted conversations as pieces: conv_id, piece, formatted, loss (spans of trained text in code points, in the piece).

    Pieces of a conversation, in order, make up its text; each holds the turns of one range of PIECE turn numbers, so that no
    conversation gathers in one task. A null turn comes first.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(SHUT))
    rows = messages.select("conv_id", F.floor(F.col("turn") / PIECE).alias("piece"), F.struct(
        "turn", "tie", F.concat(head, text, F.lit(END)).alias("line"), (F.col("role") == TRAINED).alias("trained"),
        F.length(head).alias("head"), F.length(text).alias("size")).alias("m"))
    parts = rows.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    sums = prefix_sums(F.transform("ms", lambda m: F.length(m["line"])))
    spans = F.zip_with("ms", sums, lambda m, s: F.struct((s + m["head"]).alias("start"), (s + m["head"] + m["size"]).alias("end"), m["trained"].alias("t")))
    loss = F.transform(F.filter(spans, lambda s: s["t"]), lambda s: s.dropFields("t"))
    return parts.select("conv_id", "piece", F.array_join(F.transform("ms", lambda m: m["line"]), "").alias("formatted"), loss.alias("loss"))


def parse(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces say: conv_id, piece, turns (role and text, in order), trained (texts under the mask)."""
    lines = F.slice(F.split("formatted", END, -1), F.lit(1), F.size(F.split("formatted", END, -1)) - 1)
    turns = F.transform(lines, lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, 3, 1 << 30), SHUT, 1)).alias("role"),
        unescape(F.substring_index(x, SHUT, -1)).alias("text")))
    trained = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return pieces.select("conv_id", "piece", F.length("formatted").alias("chars"), turns.alias("turns"), trained.alias("trained"))


def digest(pieces: DataFrame) -> DataFrame:
    """Per conversation, read back from its pieces: turns, their hash, trained text and its hash, formatted length.

    The two hashes run over the whole conversation, so its text meets in one row here, as the definition asks.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = parse(pieces).select("conv_id", "chars", F.size("turns").alias("n"), F.struct(
        "piece", said.alias("said"), F.array_join("trained", "").alias("trained")).alias("p"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("p")).alias("ps"))
    said = F.array_join(F.transform("ps", lambda p: p["said"]), "")
    loss = F.array_join(F.transform("ps", lambda p: p["trained"]), "")
    return whole.select("conv_id", F.col("n_turns").cast("long"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                        F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


def formatted(log: DataFrame) -> DataFrame:
    """Event log to formatted pieces."""
    return render(fold(log))
