r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of typed parts. :func:`flatten_parts` visits them in
order and yields one string: text parts are escaped, every other part becomes a
placeholder ``<image:3>`` numbered by the attachment's place in the conversation;
its reference and expanded token count are recorded.

Control strings all start with ``<``. Inside texts and roles ``\`` is written
``\s`` and ``<`` is written ``\l``; no text can therefore contain a control string,
and replacing ``\l`` and then ``\s`` restores it. A turn is
``<turn>role<body>content</turn>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, BODY, CLOSE = "<turn>", "<body>", "</turn>"
SEPARATOR = "\n"

#: Tokens that an attachment stands for (parameters of the visitor).
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25.0, 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """An array with one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"),
            F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def expanded_tokens(part: Column) -> Column:
    """Tokens of an attachment: patches of an image, frames of audio, pages of a document."""
    patches = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / F.lit(PATCH))
    return (
        F.when(part["kind"] == "image", patches(part["width"]) * patches(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(AUDIO_RATE)))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * F.lit(PAGE_TOKENS))
        .otherwise(F.lit(0))
        .cast("long")
    )


def flatten_parts(parts: Column, first: Column) -> Column:
    """Visit parts in order: struct(content, attachments, next).

    ``first`` is the number of the first attachment. attachments: array of
    struct(number, kind, ref, tokens). A null array or part adds nothing.
    """
    empty = F.struct(
        F.lit("").alias("content"),
        F.array().cast("array<struct<number:int,kind:string,ref:string,tokens:bigint>>").alias("attachments"),
        first.cast("int").alias("next"),
    )

    def visit(state: Column, part: Column) -> Column:
        text = F.struct(
            F.concat(state["content"], escape(F.coalesce(part["text"], F.lit("")))).alias("content"),
            state["attachments"].alias("attachments"),
            state["next"].alias("next"),
        )
        kind = F.regexp_replace(F.lower(part["kind"]), "[^a-z0-9_]", "_")
        mark = F.concat(F.lit("<"), kind, F.lit(":"), state["next"].cast("string"), F.lit(">"))
        noted = F.struct(
            state["next"].alias("number"),
            part["kind"].alias("kind"),
            part["ref"].alias("ref"),
            expanded_tokens(part).alias("tokens"),
        )
        other = F.struct(
            F.concat(state["content"], mark).alias("content"),
            F.concat(state["attachments"], F.array(noted)).alias("attachments"),
            (state["next"] + 1).alias("next"),
        )
        return F.when(part.isNull(), state).when(_is_text(part), text).otherwise(other)

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), empty, visit)


def format_conversations(
    rows: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    trained_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: key, formatted, loss_spans, attachments, n_attachment_tokens.

    ``loss_spans``: array of struct(start, length), 1-based code points of the
    contents of turns of ``trained_role`` within ``formatted``. Turns follow ``turn``
    (nulls first), ties the role and then the content, so the order of input rows
    never matters. Null roles and contents are empty. A conversation is one row by
    nature: its turns meet in one task, and only one conversation's at a time.
    """
    content = F.col(parts)
    item = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.to_json(content).alias("tie"),
        content.alias("parts"),
    )
    grouped = rows.groupBy(F.col(conversation).alias("_conv")).agg(F.sort_array(F.collect_list(item)).alias("_turns"))
    start = F.struct(
        F.lit("").alias("text"),
        F.lit(0).alias("chars"),
        F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
        F.array().cast("array<struct<number:int,kind:string,ref:string,tokens:bigint>>").alias("attachments"),
        F.lit(1).alias("next"),
    )

    def add(state: Column, t: Column) -> Column:
        # the visitor's result is used several times: bind it once as a lambda variable
        seen = F.transform(F.array(flatten_parts(t["parts"], state["next"])), lambda x: x)

        def with_visit(v: Column) -> Column:
            head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY))
            tail = F.lit(CLOSE + SEPARATOR)
            begin = state["chars"] + F.char_length(head)
            size = F.char_length(v["content"])
            span = F.struct((begin + 1).alias("start"), size.alias("length"))
            return F.struct(
                F.concat(state["text"], head, v["content"], tail).alias("text"),
                (begin + size + len(CLOSE + SEPARATOR)).alias("chars"),
                F.when(t["role"] == trained_role, F.concat(state["spans"], F.array(span)))
                .otherwise(state["spans"])
                .alias("spans"),
                F.concat(state["attachments"], v["attachments"]).alias("attachments"),
                v["next"].alias("next"),
            )

        return F.element_at(F.transform(seen, with_visit), 1)

    out = grouped.select("_conv", F.aggregate("_turns", start, add).alias("_out"))
    return out.select(
        F.col("_conv").alias(conversation),
        F.col("_out.text").alias("formatted"),
        F.col("_out.spans").alias("loss_spans"),
        F.col("_out.attachments").alias("attachments"),
        F.aggregate("_out.attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Parse a formatted conversation back: array of struct(role, content), unescaped."""
    pieces = F.split(formatted, CLOSE + SEPARATOR, -1)
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(
        turns,
        lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, BODY, 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(p, F.instr(p, BODY) + len(BODY))).alias("content"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, spans in order with nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))))
