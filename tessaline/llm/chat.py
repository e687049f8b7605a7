"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

``fold`` replays a log of conversation events into final messages, ``render``
turns messages into one training text per conversation with a loss mask, and
``read_back`` recovers turns and masked texts from that output alone.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Texts and roles are
escaped reversibly (``&`` to ``&amp;``, then ``<|`` to ``&lt;|``; in roles also a
newline to ``&nl;``), so ``<|`` occurs in the output only where a turn is marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: A streamed message comes in deltas of so many code points.
DELTA_CHARS = 256
#: Events of one message in a log of finished turns; more than any text has deltas.
EVENTS_EACH = 1 << 32
#: Events that set a message's whole text; ``delta`` appends, ``delete`` retracts.
RESETS = ("open", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, msg, role, text)`` of an event log.

    ``events``: ``conv_id``, ``msg`` (place of the message, long), ``seq`` (order
    within the conversation, long), ``op``, ``role``, ``text``; other columns are
    ignored.  Rules: ``open``, ``edit`` and ``regenerate`` start the text anew,
    ``delta`` appends, a final ``delete`` retracts the message; ``regenerate``
    also voids every earlier event of later messages.  A repeated event counts
    once.  Null texts are empty, a null role means the role stays as it was,
    rows without ``msg`` or ``seq`` are void, and a null ``conv_id`` is a
    conversation of its own.  Among events with equal ``seq`` the order is by op
    and text.  A log without events gives no messages.
    """
    conv, msg = W.partitionBy("conv_id"), W.partitionBy("conv_id", "msg")
    log = events.select(
        "conv_id", F.col("msg").cast("long"), F.col("seq").cast("long"), "op", "role", F.coalesce("text", F.lit("")).alias("text")
    ).filter("msg is not null and seq is not null")
    voided = F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).over(conv.orderBy("msg").rangeBetween(W.unboundedPreceding, -1))
    log = log.withColumn("_void", voided).filter("_void is null or seq > _void")
    log = log.withColumn("_reset", F.max(F.when(F.col("op").isin(*RESETS), F.col("seq"))).over(msg))
    parts = F.array_sort(F.collect_set(F.when(F.expr("op <> 'delete' and (_reset is null or seq >= _reset)"), F.struct("seq", "op", "text"))))
    return (
        log.groupBy("conv_id", "msg")
        .agg(
            F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
            parts.alias("_parts"),
            F.max(F.struct("seq", "op"))["op"].alias("_last"),
        )
        .filter("_last is null or _last <> 'delete'")
        .select("conv_id", "msg", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``messages``: ``conv_id, msg, role, text`` (null role or text: empty).
    ``loss_spans`` lists, in order, each text of ``loss_role`` as the block (turn)
    it lies in, the block's first code point, and the span's start and length in
    code points of ``formatted``.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    blocks = messages.select(
        "conv_id", "msg", (F.col("role") == loss_role).alias("loss"), F.char_length(role).alias("role_chars"), F.char_length(text).alias("text_chars"),
        F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END)).alias("block"),
    )
    before = W.partitionBy("conv_id").orderBy("msg", "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("at", F.coalesce(F.sum(F.char_length("block")).over(before), F.lit(0)))
    turns = F.array_sort(F.collect_list(F.struct("msg", "at", "block", "loss", "role_chars", "text_chars")))
    return (
        blocks.groupBy("conv_id")
        .agg(turns.alias("_turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("_turns", lambda t: t["block"]), "").alias("formatted"),
            F.expr(
                f"""filter(transform(_turns, (t, i) -> if(t.loss, struct(i as block, t.at as block_start,
                    t.at + {len(START) + 1} + t.role_chars as start, cast(t.text_chars as bigint) as chars), null)), s -> s is not null)"""
            ).alias("loss_spans"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role and text) and ``loss_texts``, read from the output.

    Turns come from splitting ``formatted`` at its marks, loss texts from cutting
    ``loss_spans`` out of it; both are unescaped.
    """
    blocks = F.filter(F.split("formatted", r"(?<=<\|im_end\|>\n)"), lambda b: F.char_length(b) > 0)

    def turn(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.char_length(block) - len(START) - len(END))
        cut = F.instr(body, F.lit("\n"))
        return F.struct(
            unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(body, cut + 1, F.char_length(body))).alias("text")
        )

    return (
        formatted.withColumn("_blocks", blocks)
        .withColumn("turns", F.transform("_blocks", turn))
        .withColumn(
            "loss_texts",
            F.transform(
                "loss_spans",
                lambda s: unescape(
                    F.substring(F.element_at("_blocks", s["block"] + 1), (s["start"] - s["block_start"] + 1).cast("int"), s["chars"].cast("int"))
                ),
            ),
        )
        .drop("_blocks")
    )


def conversation_events(conversations: DataFrame, streamed_role: str = "assistant") -> DataFrame:
    """Rows of finished turns as the log that a chat server would have kept of them.

    A turn of ``streamed_role`` is a generation (``regenerate``, the kind that also
    starts a first one) and the deltas that streamed its text; any other turn is
    opened with an empty draft and edited to its text.  Repeated turns and rows are
    messages of their own, ordered by role and text; null turns come first, a null
    text is empty, and an empty streamed text has no deltas.  An empty table gives no
    events, and other columns aren't read.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("msg", F.row_number().over(order).cast("long"))
    event = lambda k, op, role, text: F.struct(F.lit(k).cast("long").alias("k"), F.lit(op).alias("op"), role.alias("role"), text.alias("text"))
    role, none = F.col("role"), F.lit(None).cast("string")
    deltas = F.expr(
        f"""transform(sequence(1, cast(ceil(char_length(text) / {DELTA_CHARS}) as int)), i -> struct(cast(i as bigint) as k, 'delta' as op,
            cast(null as string) as role, substring(text, (i - 1) * {DELTA_CHARS} + 1, {DELTA_CHARS}) as text))"""
    )
    streamed = F.concat(F.array(event(0, "regenerate", role, F.lit(""))), F.when(F.char_length("text") > 0, deltas).otherwise(F.expr("filter(array(struct(0L as k, '' as op, '' as role, '' as text)), x -> false)")))
    written = F.array(event(0, "open", role, F.lit("")), event(1, "edit", none, F.col("text")))
    log = rows.select("conv_id", "msg", F.inline(F.when(role == streamed_role, streamed).otherwise(written)))
    return log.select("conv_id", "msg", (F.col("msg") * EVENTS_EACH + F.col("k")).alias("seq"), "op", "role", "text")


def digests(read: DataFrame) -> DataFrame:
    """The digest columns of the query ``op2_chat_format``."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
