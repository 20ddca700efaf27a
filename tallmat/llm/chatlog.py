"""Chat logs folded into conversations and rendered for training, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# What an event does: begins or replaces a message, adds to it, replaces its text, or starts it anew and drops
# what was said after it.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escaped(text: Column, one_line: bool = False) -> Column:
    """Text without any control string: backslashes are doubled and ``<|`` becomes ``<\\|``."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if one_line else out


def unescaped(text: Column) -> Column:
    """The inverse of :func:`escaped`; a single backslash always stands before ``|`` or ``n``."""
    # Pairs of backslashes are taken from the left; what lies between holds single ones only.
    parts = F.split(text, "\\\\\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def fold(events: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text)``: the final messages of each conversation, in order of their first event.

    ``events`` has ``conv_id, seq, kind, message, role, text``. Events of a conversation count in order of ``seq``,
    equal ones by kind, then text. A message's text is that of its last message, edit or regenerate event and
    the deltas after it; its role the last one given. A regenerate event also drops every message that began
    after its own and before the event. Null texts are empty, null roles too; a null ``kind`` is a message.
    Events whose ``conv_id``, ``seq`` or ``message`` is null are left out.

    Deltas are put together by message, so a long conversation spreads; per conversation there is one
    window over its messages.
    """
    kind = F.coalesce("kind", F.lit(MESSAGE))
    rows = events.where("conv_id IS NOT NULL AND seq IS NOT NULL AND message IS NOT NULL").select(
        "conv_id", "message", "seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    resets = F.col("kind") != DELTA
    order = F.struct("seq", "kind", "text")
    messages = rows.groupBy("conv_id", "message").agg(
        F.min("seq").alias("began"),
        F.max(F.when(resets, order)).alias("base"),
        F.max_by("role", F.when(F.col("role").isNotNull(), order)).alias("role"),
        F.max(F.when(F.col("kind") == REGENERATE, F.col("seq"))).alias("anew"),
        F.sort_array(F.collect_list(F.when(~resets, order))).alias("deltas"),
    )
    later = F.filter("deltas", lambda d: F.col("base").isNull() | (d > F.col("base")))
    text = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(F.transform(later, lambda d: d["text"]), ""))
    ordered = Window.partitionBy("conv_id").orderBy("began", "message")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        messages.select("conv_id", "message", "began", "anew", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
        .withColumn("dropped", F.max("anew").over(earlier) > F.col("began"))
        .where("dropped IS NULL OR NOT dropped")
    )
    return kept.select("conv_id", F.struct("began", "message").alias("position"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)``: one row per conversation.

    A turn is ``<|im_start|>``, role, line end, text, ``<|im_end|>``, line end; role and text are escaped, so these
    marks stand nowhere else. ``loss`` lists the turns under the loss mask, those of the assistant: ``number``
    of the turn and ``start`` and ``length`` of its text in code points of ``formatted``. A conversation is one
    training example and so one row; it must fit into one.
    """
    role, text = escaped(F.col("role"), one_line=True), escaped(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    turn = F.concat(head, text, F.lit(END + "\n"))
    order = Window.partitionBy("conv_id").orderBy("position")
    turns = messages.select(
        "conv_id",
        "position",
        turn.alias("turn"),
        F.length(turn).alias("size"),
        F.length(head).alias("head"),
        F.length(text).alias("length"),
        (F.col("role") == "assistant").alias("learned"),
    )
    placed = turns.select(
        "conv_id",
        F.struct(
            (F.row_number().over(order) - 1).alias("number"),
            "turn",
            (F.sum("size").over(order) - F.col("size") + F.col("head")).cast("int").alias("start"),
            "length",
            "learned",
        ).alias("row"),
    )
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    mask = F.transform(F.filter("rows", lambda r: r["learned"]), lambda r: F.struct(r["number"].alias("number"), r["start"].alias("start"), r["length"].alias("length")))
    return rows.select("conv_id", F.array_join(F.transform("rows", lambda r: r["turn"]), "").alias("formatted"), mask.alias("loss"))


def parse(rendered: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns, learned)``: role and text of every turn, and the texts under the loss mask.

    Both are read back from ``formatted`` and the marks alone. A masked text is checked to be as long as the mask
    says; otherwise the row fails.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p != "")
    split = F.transform(
        pieces,
        lambda p: F.struct(
            F.substring_index(p, "\n", 1).alias("role"),
            p.substr(F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1).alias("text"),
        ),
    )
    rows = rendered.select("conv_id", "formatted", "loss", split.alias("raw"))
    masked = F.transform("loss", lambda m: F.get(F.col("raw"), m["number"])["text"])
    right = F.forall(F.zip_with(masked, "loss", lambda t, m: F.length(t) == m["length"]), lambda x: F.coalesce(x, F.lit(False)))
    checked = F.when(right, masked).otherwise(F.raise_error(F.lit("a loss mask does not fit its text")).cast("array<string>"))
    return rows.select(
        "conv_id",
        "formatted",
        F.transform("raw", lambda t: F.struct(unescaped(t["role"]).alias("role"), unescaped(t["text"]).alias("text"))).alias("turns"),
        F.transform(checked, unescaped).alias("learned"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """A plain table ``(conv_id, turn, role, text)`` as events, every row a message of its own.

    Rows are in order of turn, null first; equal turns by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        "conv_id", F.row_number().over(order).alias("seq"), F.lit(MESSAGE).alias("kind"), "role", "text"
    ).withColumn("message", F.col("seq"))


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation: what a reader of the rendered text gets back.

    An empty table gives no rows; rows with a null ``conv_id`` are left out; other columns are not read.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    read = parse(render(fold(events_of(rows))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
