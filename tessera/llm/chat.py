"""Chat formatting by prefix-target expansion, with built-in functions only.

Every assistant turn becomes an example of its own: the context is all turns before it,
and only its reply is under the loss mask. Examples of one conversation share their
prefixes, so the output keeps each turn's formatted segment once, with the running
length of what stands before it: example k is the first ``context_chars`` characters of
its conversation and then its own segment, the mask is ``[target_start, target_end)`` of
that text. This stays linear in the input, however long a conversation is;
:func:`materialise` writes the full prompts out, and :func:`digest` reads them.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash is
doubled and ``<|`` becomes ``<\\|`` (a line end in a role ``<\\/>``), so control strings in
a text cannot be taken for the template's, and :func:`unescape` gives the text back.

Null texts and roles are empty; turns of equal number are ordered by role, then text, and
repeated rows stay. A conversation without a reply gives no example, but its segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/>"), F.lit("\n")))


def expand(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, place (from 1), segment, context_chars; on assistant turns
    also example (from 1), target_start, target_end and example_chars, else null."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), _escape_role(role), F.lit("\n"))
    body = escape(text)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.concat(head, body, F.lit(END + "\n")).alias("segment"), F.length(head).alias("_head"), F.length(body).alias("_body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reply = F.col("role") == "assistant"
    size = F.length("segment").cast("long")
    rows = rows.select(
        "conv_id", "segment", "_head", "_body", reply.alias("_reply"),
        F.row_number().over(order).alias("place"),
        (F.sum(size).over(past) - size).alias("context_chars"),
        F.sum(reply.cast("int")).over(past).alias("_n"),
    )
    own = lambda c: F.when(F.col("_reply"), c)
    start = F.col("context_chars") + F.col("_head")
    return rows.select(
        "conv_id", "place", "segment", "context_chars", own(F.col("_n")).alias("example"),
        own(start).alias("target_start"), own(start + F.col("_body")).alias("target_end"), own(F.col("context_chars") + F.length("segment")).alias("example_chars"),
    )


def read_back(expanded: DataFrame) -> DataFrame:
    """conv_id, place, role, text of every segment, and ``trained``: the reply under the mask, or null."""
    inner = F.substr(F.col("segment"), F.lit(len(START) + 1))
    at = F.instr(inner, "\n")
    role = _unescape_role(F.substr(inner, F.lit(1), at - 1))
    text = unescape(F.substr(inner, at + 1, F.length(inner) - at - len(END) - 1))
    masked = F.substr(F.col("segment"), (F.col("target_start") - F.col("context_chars") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int"))
    return expanded.select("conv_id", "place", role.alias("role"), text.alias("text"), unescape(masked).alias("trained"), "example_chars")


def materialise(expanded: DataFrame) -> DataFrame:
    """conv_id, example, prompt, target_start, target_end with the whole text of every example.
    Its size is the sum of all contexts, so long conversations cost the square of their length."""
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = expanded.withColumn("prompt", F.array_join(F.collect_list("segment").over(before), ""))
    return whole.filter("example is not null").select("conv_id", "example", "prompt", "target_start", "target_end")


def digest(expanded: DataFrame) -> DataFrame:
    """What the output says of each conversation: the turns by reading segments back, what is trained on and
    ``formatted_chars`` by writing every example out whole and reading its reply back."""
    turns = read_back(expanded).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("t"))
    masked = F.substr("prompt", (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int"))
    examples = materialise(expanded).select("conv_id", "example", unescape(masked).alias("trained"), F.length("prompt").cast("long").alias("chars"))
    replies = examples.groupBy(F.col("conv_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("example", "trained"))).alias("r"), F.sum("chars").alias("chars"))
    loss = F.coalesce(F.array_join(F.transform("r", lambda x: x["trained"]), ""), F.lit(""))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.join(replies, F.col("conv_id").eqNullSafe(F.col("_of")), "left").select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.coalesce("chars", F.lit(0)).alias("formatted_chars"),
    )
