"""Chat formatting with typed content parts and a loss mask (operator 1, native).

A message holds an ordered array of typed parts. The visitor (``flatten``) turns each part into text: text parts are
escaped, all other parts become placeholders such as ``<|image:0|>`` that count from 0 in each message. It records the
attachment behind every placeholder and how many tokens the placeholder expands to.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings begin with ``<|``; escaping doubles every backslash
and then writes ``<|`` as ``<\\|``, so no escaped text holds a control string and unescaping gives the text back. In a role a
line end is written ``<\\>``.

Turn offsets are window sums over the turns of a conversation; nothing is folded through a growing array.

Defined results: a null text, role, or part is empty. Turns are ordered by turn, role and text, null first; rows with equal turn
are separate turns. A null conversation id is one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\>"), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A text as the only part of its message."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("uri"),
                            *[F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def placeholder_tokens(part: Column, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256) -> Column:
    """Tokens that a part's placeholder stands for: image patches, audio frames, or document pages; one for another kind."""
    tiles = lambda side: F.ceil(F.coalesce(part[side], F.lit(0)) / F.lit(patch))
    return (F.when(part["type"] == "image", tiles("width") * tiles("height"))
            .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(audio_rate)))
            .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * F.lit(page_tokens)).otherwise(F.lit(1)).cast("long"))


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def flatten(parts: Column, **sizes) -> Column:
    """The visitor: a struct of body, attachments (position, type, uri, tokens) and n_placeholder_tokens of a message's parts."""
    parts = F.coalesce(F.filter(parts, lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>"))
    others = F.filter(parts, lambda p: ~is_text(p))
    attachments = F.transform(others, lambda p, i: F.struct(i.alias("position"), p["type"].alias("type"), p["uri"].alias("uri"),
                                                           placeholder_tokens(p, **sizes).alias("tokens")))
    # The i-th part is preceded by as many placeholders as there are other parts before it.
    rank = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda q: ~is_text(q)))
    pieces = F.transform(parts, lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit(""))))
                         .otherwise(F.concat(F.lit("<|"), escape(p["type"]), F.lit(":"), rank(i).cast("string"), F.lit("|>"))))
    return F.struct(F.array_join(pieces, "").alias("body"), attachments.alias("attachments"),
                    F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_placeholder_tokens"))


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts", loss_roles: tuple[str, ...] = ("assistant",), **sizes) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, n_placeholder_tokens.

    A loss span has its start and length in formatted both in code points and in UTF-8 bytes.
    """
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                           F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), flatten(F.col(parts_col), **sizes).alias("m"))
    rows = rows.select("conv_id", "turn", "role", "m.*")
    rows = rows.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = lambda size: F.sum((size("head") + size("body") + F.lit(len(END))).cast("long")).over(before) - size("body") - F.lit(len(END))
    rows = rows.select("conv_id", "role", "head", "body", "attachments", "n_placeholder_tokens", F.row_number().over(order).alias("k"),
                       upto(F.length).alias("start"), upto(F.octet_length).alias("byte_start"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct("start", F.length("body").cast("long").alias("length"),
                                                            "byte_start", F.octet_length("body").cast("long").alias("byte_length")))
    turns = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("k", F.concat("head", "body", F.lit(END)).alias("block"), span.alias("span"), "attachments"))).alias("turns"),
        F.sum("n_placeholder_tokens").alias("n_placeholder_tokens"))
    return turns.select(
        "conv_id", F.array_join(F.col("turns.block"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(
            (t["k"] - 1).alias("message"), a["position"].alias("position"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens"))))).alias("attachments"),
        "n_placeholder_tokens")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped. The inverse of the template for text parts."""
    blocks = F.split(formatted, "<\\|im_end\\|>\n")
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    at = lambda b: F.instr(b, "\n")
    return F.transform(blocks, lambda b: F.struct(unescape_role(F.substring(b, F.lit(len(START) + 1), at(b) - len(START) - 1)).alias("role"),
                                                  unescape(F.substring(b, at(b) + 1, F.length(b))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between. Byte offsets keep it linear in the text."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(raw, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string"))), "")
