r"""Chat formatting: prefix-target expansion, with column functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only
that reply is trainable. A conversation whose last turn is not an assistant's also yields one
context-only example, so that no turn is lost.

The template is ``### <role>\n<text></turn>\n`` per turn. ``\``, ``#`` and ``<`` inside a text become
``\\``, ``\h`` and ``\l`` (and a line break inside a role ``\n``), so control strings cannot occur in
a text and unescaping gives the original back.

Cases: a NULL role or text is empty; a NULL conversation id is a conversation of its own; turns with
the same number are ordered by role and text, and repeated rows are turns; an empty table gives no
examples; further columns of the input are not read. Turns meet in one row per conversation, as
every example needs all turns before it; the text of the examples is, by their definition, quadratic
in a conversation's turns, and each example is built in a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.binding import let
from pageloom.llm.arrays import indices

OPEN, CLOSE = "### ", "</turn>\n"
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Split at the escaped backslashes, left to right, so that what is left holds only the other escapes."""
    def plain(part: Column) -> Column:
        for raw, safe in (("#", "\\h"), ("<", "\\l"), ("\n", "\\n")):
            part = F.replace(part, F.lit(safe), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def expand_replies(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conversation, example, formatted, loss_start, loss_end): one row per assistant turn.

    ``example`` counts from 0 in turn order. The mask is in code points of ``formatted``, end
    exclusive, and covers the reply's (escaped) text alone; a context-only example has an empty mask.
    """
    said = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = turns.groupBy(F.col(conversation).alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    marked = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == TRAINABLE).alias("ours"),
        heads.alias("heads"), bodies.alias("bodies"),
    )
    last = F.size("ours") - 1
    places = F.filter(indices(F.size("ours")), lambda i: F.get("ours", i) | (i == last))
    each = marked.select("*", F.posexplode(places).alias("example", "at"))
    segments = F.zip_with(
        F.slice("heads", F.lit(1), F.col("at")), F.slice("bodies", F.lit(1), F.col("at")),
        lambda h, b: F.concat(h, b, F.lit(CLOSE)),
    )
    head, body, mine = F.get("heads", F.col("at")), F.get("bodies", F.col("at")), F.get("ours", F.col("at"))
    built = each.select("conv_id", "example", F.array_join(segments, "").alias("context"), head.alias("head"), body.alias("body"), mine.alias("mine"))
    start = F.char_length("context") + F.char_length("head")
    return built.select(
        "conv_id", "example", F.concat("context", "head", "body", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"), F.when(F.col("mine"), start + F.char_length("body")).otherwise(start).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted example."""
    def turn(part: Column) -> Column:
        cut = F.instr(part, "\n")
        return F.struct(
            unescape(F.substring(part, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(part, cut + 1, F.char_length(part))).alias("text"),
        )

    return let(F.split(formatted, "</turn>\n", -1), lambda parts: F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn))


def masked_text(formatted: Column, start: Column, end: Column) -> Column:
    """The original text under the mask."""
    return unescape(F.substring(formatted, start + 1, end - start))
