"""Chat formatting with typed content parts.

A message is a role and a list of typed parts (text, image, audio, document). A visitor
turns each part into a piece of the formatted text: text parts are escaped, the others
become an ordered placeholder, an attachment reference and a count of the tokens that
the placeholder stands for once a model expands it.

Template of a turn: ``<|start|>role<|message|>content<|end|>``. Inside roles and texts, a
backslash goes before every backslash and after the first character of every control
string (those of this template and the usual ``<s> </s> [INST] [/INST] <<SYS>> <</SYS>>``),
so that none of them occurs in escaped text, and dropping the backslash of each pair
restores the text.

A conversation is formatted in blocks of consecutive turns, each of bounded size, so
that a very long one is spread over tasks; masks count code points within their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
TURNS = 64
#: Where a backslash goes: in control strings after the first character, before backslashes.
_MARKS = r"(?<=<)(?=\||/?s>|<SYS>>|</SYS>>)|(?<=\[)(?=/?INST\])|(?=\\)"
_PAIR = r"(?s)\\(.)"

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 600


def escape(text: Column) -> Column:
    """``text`` without control strings; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _MARKS, r"\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, _PAIR, "$1")


def text_part(text: Column) -> Column:
    """A message content of one text part."""
    rest = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(k) for k, t in rest.items())))


def _tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to; unknown measures count as 0, an attachment as 1 at least."""
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / IMAGE_PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / IMAGE_PATCH)
    return F.greatest(
        F.lit(1).cast("long"),
        F.when(part["kind"] == "image", patches).when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)).otherwise(F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS),
    )


def _attached(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")).isin("image", "audio", "document")


def visit(parts: Column) -> tuple[Column, Column]:
    """The formatted content of a message and its attachment references in order.

    An unknown or null kind counts as text; null parts count as an empty content.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    places = F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    attached = F.filter(places, lambda x: _attached(x["p"]))
    content = F.transform(
        parts,
        lambda p, i: F.when(_attached(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), i.cast("string"), F.lit("|>"))).otherwise(escape(p["text"])),
    )
    references = F.transform(attached, lambda x: F.struct(x["i"].alias("part"), x["p"]["kind"].alias("kind"), x["p"]["uri"].alias("uri"), _tokens(x["p"]).alias("tokens")))
    return F.array_join(content, ""), references


def format_chat(messages: DataFrame, loss_role: str = "assistant", turns: int = TURNS) -> DataFrame:
    """Formatted blocks: conv_id, block, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``messages`` has conv_id, turn, role and parts (``PART`` each). Rows are ordered by
    turn, then role and content; null turns come first, null roles count as empty,
    repeated rows are repeated turns. loss_spans has (start, length) in code points of
    the block's formatted text for every message of ``loss_role``.
    """
    content, references = visit(F.col("parts"))
    rows = messages.select(
        messages["conv_id"], messages["turn"], F.floor(messages["turn"] / turns).alias("block"),
        F.coalesce(messages["role"], F.lit("")).alias("role"), content.alias("content"), references.alias("refs"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "refs")), _by_turn).alias("m"))
    pieces = F.transform("m", lambda x: F.struct(F.concat(F.lit(START), escape(x["role"]), F.lit(MESSAGE)).alias("head"), x["content"].alias("body"), (x["role"] == loss_role).alias("loss")))
    blocks = blocks.select("conv_id", "block", "m", pieces.alias("p"))

    def span(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        more = F.when(x["loss"], F.array(F.struct(begin.alias("start"), F.length(x["body"]).alias("length")))).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        return F.struct((end + len(END)).alias("at"), F.concat(acc["spans"], more).alias("spans"))

    spans = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")), span, lambda acc: acc["spans"])
    attachments = F.flatten(F.transform("m", lambda x: F.transform(x["refs"], lambda r: F.struct(x["turn"].alias("turn"), r["part"].alias("part"), r["kind"].alias("kind"), r["uri"].alias("uri"), r["tokens"].alias("tokens")))))
    return blocks.select(
        "conv_id", "block", F.size("m").cast("long").alias("n_turns"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def _by_turn(a: Column, b: Column) -> Column:
    """Comparator: null turns first, then turn, role and content."""
    out = F.lit(0)
    for k in ("content", "role"):
        out = F.when(a[k] < b[k], -1).when(a[k] > b[k], 1).otherwise(out)
    least = F.lit(-(1 << 63)).cast("long")
    x, y = F.coalesce(a["turn"].cast("long"), least), F.coalesce(b["turn"].cast("long"), least)
    return F.when(x < y, -1).when(x > y, 1).otherwise(out)


def read_back(blocks: DataFrame) -> DataFrame:
    """What the formatted text says: conv_id, block, turns (role, text) and the loss texts, unescaped."""
    texts = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.split(x, r"<\|message\|>", 2)
        return F.struct(unescape(F.substring(cut[0], len(START) + 1, 1 << 30)).alias("role"), unescape(cut[1]).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return blocks.select("conv_id", "block", F.transform(texts, turn).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation, read back from the blocks: counts and hashes of its turns and of its loss text."""
    read = read_back(blocks).select(
        "conv_id", "block", F.size("turns").cast("long").alias("n"), "chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("loss", "").alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("block", "said", "loss"))).alias("b"),
        F.sum(F.length("loss").cast("long")).alias("loss_chars"),
    )
    # array_sort puts null structs last, but a null field first: the block of null turns leads.
    joined = lambda k: F.array_join(F.transform("b", lambda x: x[k]), "")
    return whole.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), "loss_chars", F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars")
