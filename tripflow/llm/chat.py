"""Chat formatting of typed content parts, with DataFrame functions only.

A turn's content is an array of parts: text, image, audio, document. The visitor walks the parts
in order. Text is escaped and kept; any other part becomes a placeholder that names its kind and its
number within the conversation, its reference is recorded as an attachment, and the tokens it
expands to are computed from its measures. The template is

    <|turn|>role<|body|>content<|end|>

and inside roles and texts a backslash is put behind the first character of every control string
(and behind every backslash), so that no text can open or close anything; ``unescape`` is exact.
Rows are rendered one by one, before anything is grouped; only rendered turns of one conversation
meet in one row, which is the formatted example itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that no text may hold unescaped: all that start with these.
_CONTROL = r"(\\|<(?=\||/?s>)|\[(?=/?INST\]))"
_ESCAPED = r"([\\<\[])\\"
PART = (
    "struct<kind string, text string, uri string, width int, height int, seconds double, pages int>"
)
#: Sizes behind the token counts: pixels of an image patch's side, audio tokens a second,
#: tokens of a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 750


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def text_parts(text: Column) -> Column:
    """A plain text as content: one text part; a null as empty."""
    return F.array(_part("text", F.coalesce(text, F.lit(""))))


def _part(kind: str, text: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    )


def _tokens(part: Column) -> Column:
    """Tokens a part expands to besides its text; missing measures count as one unit."""
    side = lambda name: F.ceil(F.coalesce(part.getField(name), F.lit(1)) / PATCH)
    return (
        F.when(part.getField("kind") == "image", side("width") * side("height"))
        .when(part.getField("kind") == "audio", F.ceil(F.coalesce(part.getField("seconds"), F.lit(1.0)) * AUDIO_RATE))
        .when(part.getField("kind") == "document", F.coalesce(part.getField("pages"), F.lit(1)) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part.getField("kind"), F.lit("text")) == "text"


def format_chats(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
    content: str = "content", learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row a conversation: (conversation, formatted, loss, attachments, expanded_tokens).

    ``content`` is an array of ``PART``. ``loss`` lists (start, length) in code points of
    ``formatted``: the content of every turn whose role is in ``learn``. ``attachments`` lists
    (number, turn, kind, uri, tokens) in order; ``expanded_tokens`` adds theirs up.

    Turns are ordered by ``turn``, nulls first, then role, then content; repeated turns stay. A
    null role, content, part or text is empty, a part without kind is text, null conversations are
    one conversation. Other columns are not read. No rows: no rows.
    """
    parts = F.filter(F.coalesce(F.col(content), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    order = Window.partitionBy("conv").orderBy("turn", "role", "content")
    read = turns.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), parts.alias("content"),
    )
    media = F.filter("content", lambda p: ~_is_text(p))
    placed = read.select(
        "conv", "turn", "role", "content", media.alias("media"),
        F.row_number().over(order).alias("seq"),
        F.coalesce(F.sum(F.size(media)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"),
    )
    # A part's number: media parts of earlier turns and of the parts before it.
    body = F.array_join(
        F.transform(
            "content",
            lambda p, i: F.when(_is_text(p), escape(F.coalesce(p.getField("text"), F.lit("")))).otherwise(
                F.concat(
                    F.lit("<|"), escape(p.getField("kind")), F.lit("_"),
                    (F.col("earlier") + 1 + F.size(F.filter(F.slice("content", 1, i), lambda q: ~_is_text(q)))).cast("string"),
                    F.lit("|>"),
                )
            ),
        ),
        "",
    )
    attached = F.transform(
        "media",
        lambda p, i: F.struct(
            (F.col("earlier") + i + 1).cast("long").alias("number"), F.col("turn").alias("turn"),
            p.getField("kind").alias("kind"), p.getField("uri").alias("uri"), _tokens(p).alias("tokens"),
        ),
    )
    rendered = placed.select(
        "conv", "seq", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"),
        body.alias("body"), F.col("role").isin(*learn).alias("learned"), attached.alias("attached"),
    )
    so_far = Window.partitionBy("conv").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    start = F.coalesce(F.sum(size).over(so_far), F.lit(0)) + F.length("head")
    turn_row = F.struct(
        "seq", F.concat("head", "body", F.lit(END)).alias("text"), "learned",
        start.cast("int").alias("start"), F.length("body").alias("length"), "attached",
    )
    whole = (
        rendered.select("conv", turn_row.alias("t"))
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    attachments = F.flatten(F.col("turns.attached"))
    spans = F.transform(
        F.filter("turns", lambda t: t.getField("learned")),
        lambda t: F.struct(t.getField("start").alias("start"), t.getField("length").alias("length")),
    )
    return whole.select(
        F.col("conv").alias(conversation),
        F.array_join("turns.text", "").alias("formatted"),
        spans.alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a.getField("tokens")).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: an array of (role, text).

    ``text`` has its texts unescaped; placeholders stand where they stood.
    """
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, BODY, 1)
        rest = F.length(piece) - F.length(role) - len(BODY) - len(END)
        text = F.substring(piece, F.length(role) + len(BODY) + 1, rest)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    texts = F.transform(
        loss, lambda s: unescape(F.substring(formatted, s.getField("start") + 1, s.getField("length")))
    )
    return F.array_join(texts, "")
