"""Chat formatting, in DataFrame operations only: messages rebuilt from event logs, then rendered with a loss mask.

Events (conv_id, message, seq, kind, role, text) are folded by message, in order of seq: ``message`` and ``edit`` set its
text, ``regenerate`` empties it (or sets the text it carries), ``delta`` appends.  The last non-null role holds.  What
remains is collected by conversation, ordered by message, and rendered:

    <|chat|>\\n  then for each turn  <|turn|>ROLE\\nTEXT<|end|>\\n

In roles and texts ``&`` and ``<`` are written ``&amp;`` and ``&lt;`` (and a line feed in a role ``&#10;``), so no text can
hold a control string, and reading back is exact.  The loss mask is a list of (start, length, first_byte, bytes) of
the output, in code points and in UTF-8 bytes: the text of each assistant turn.

Logs are dealt by conversation and message, so that a conversation with very many events is folded by many tasks; only
finished texts meet by conversation, whose one string they become.  Work is in proportion to events and text: places in the
output are running sums, and reading back cuts the bytes where the mask says.

Edge cases: a null text or role is empty; an unknown kind appends like ``delta``; events of equal seq are taken in order of
kind, role and text; a null conv_id is a conversation; repeated events are applied each; messages of equal number in a
conversation are taken in order of role and text.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAT, TURN, END = "<|chat|>\n", "<|turn|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def once(value: Column) -> Column:
    """``value`` as a generated column: evaluated once a row, also where a lambda uses it for each element."""
    return F.explode(F.array(value))


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): each message as its last event left it."""
    event = F.struct("seq", F.coalesce("kind", F.lit("")).alias("kind"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log")).select("conv_id", "message", once(F.col("log")).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e.kind.isin("message", "edit", "regenerate"), i + 1).otherwise(F.lit(1)))
    log = log.withColumn("since", F.array_max(resets))
    text = F.array_join(F.transform(F.expr("slice(log, since, size(log))"), lambda e: e.text), "")
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    return log.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def streamed(rows: DataFrame, size: int = 64, pieces: int = 32) -> DataFrame:
    """Event logs whose fold gives back ``rows`` (conv_id, message, role, text), as a chat service would have written them.

    By a hash of the key, a row is one message, or an empty message and deltas, or a draft that is edited, or deltas that are
    broken off, regenerated and streamed again.  Deltas have ``size`` code points or more, at most ``pieces`` a text.  A null
    role or text is empty.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    length = F.char_length(text)
    step = F.greatest(F.lit(size), F.ceil(length / F.lit(pieces)).cast("int"))
    event = lambda kind, value, who=F.lit(None): F.struct(F.lit(kind).alias("kind"), who.cast("string").alias("role"), value.cast("string").alias("text"))
    cuts = F.when(length > 0, F.sequence(F.lit(0), F.ceil(length / step).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    deltas = F.transform(cuts, lambda i: event("delta", F.substring(text, i * step + 1, step)))
    opening, half = event("message", F.lit(""), role), F.substring(text, F.lit(1), F.floor(length / 2).cast("int"))
    style = F.pmod(F.xxhash64("conv_id", "message"), F.lit(4))
    log = (
        F.when(style == 0, F.array(event("message", text, role))).when(style == 1, F.concat(F.array(opening), deltas))
        .when(style == 2, F.array(event("message", F.concat(half, F.lit(" ...")), role), event("edit", text)))
        .otherwise(F.concat(F.array(opening, event("delta", half), event("regenerate", F.lit(None))), deltas))
    )
    return rows.select("conv_id", "message", F.posexplode(log).alias("seq", "e")).select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "e.*")


def rendered(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss) from (conv_id, message, role, text); loss: array of (start, length, first_byte, bytes) in ``formatted``."""
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    m = messages.select("conv_id", "message", head.alias("head"), escaped(F.col("text")).alias("body"), F.col("role").isin(*learned).alias("learn"))
    order = Window.partitionBy("conv_id").orderBy("message", "head", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = lambda size: F.coalesce(F.sum(size("head") + size("body") + len(END)).over(before), F.lit(0)) + len(CHAT) + size("head")
    span = F.struct(at(F.char_length).alias("start"), F.char_length("body").cast("long").alias("length"), at(F.octet_length).alias("first_byte"), F.octet_length("body").cast("long").alias("bytes"))
    m = m.select("conv_id", F.row_number().over(order).alias("place"), F.concat("head", "body", F.lit(END)).alias("turn"), F.when(F.col("learn"), span).alias("span"))
    conv = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "turn", "span"))).alias("turns")).select("conv_id", once(F.col("turns")).alias("turns"))
    formatted = F.concat(F.lit(CHAT), F.array_join(F.transform("turns", lambda t: t.turn), ""))
    spans = F.filter(F.transform("turns", lambda t: t.span), lambda x: x.isNotNull())
    return conv.select("conv_id", once(formatted).alias("formatted"), spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a rendered conversation."""
    body = F.substring(formatted, len(CHAT) + 1, F.char_length(formatted))
    parts = F.filter(F.split(body, "<\\|end\\|>\n"), lambda p: p != "")
    part = lambda p: F.substring(p, F.lit(len(TURN) + 1), F.char_length(p))
    role = lambda p: F.substring_index(part(p), "\n", 1)
    return F.transform(parts, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(F.substring(part(p), F.char_length(role(p)) + 2, F.char_length(p))).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, in order: slices of the bytes, which are made once a row."""
    piece = lambda raw, s: unescaped(F.substring(raw, (s.first_byte + 1).cast("int"), s.bytes.cast("int")).cast("string"))
    return F.array_join(F.flatten(F.transform(F.array(formatted.cast("binary")), lambda raw: F.transform(loss, lambda s: piece(raw, s)))), "")
