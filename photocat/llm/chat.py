r"""Chat formatting with Spark expressions only.

A conversation's turns are numbered by (turn, role, text); runs of adjacent turns of
one role are collected as structs, sorted and merged, and so are the runs of a
conversation, and everything is concatenated:

    ### User: first text<part>second text of the same role</turn>
    ### Assistant: reply</turn>

Inside texts and role names the control strings are replaced by escapes that
start with a backslash, so that ``parse`` gets back the very turns:

    \ -> \s    ### -> \h    </turn> -> \t    <part> -> \p    : in roles -> \c

The loss mask is the list of spans of assistant texts (each part, without
header, ``<part>`` and end mark), in code points from 0.

Edge cases. Null text or role: as empty. Null turn: before all others. Null
conversation id: one conversation of its own. Repeated rows: each is a turn.
Ties of turn: by role, then text. Empty table: no rows. Other columns: ignored.
One conversation is one row of the result, however long; Spark limits it to 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END, PART = "</turn>\n", "<part>"
#: Roles that the template writes in its own way; others stand behind "=".
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ESCAPES = [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"), ("<part>", "\\p")]


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replaced(text, ESCAPES)


def unescape(text: Column) -> Column:
    """The backslash comes last: till then each one starts an escape."""
    return _replaced(text, [(new, old) for old, new in reversed(ESCAPES)])


def _header(role: Column) -> Column:
    name = F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    for known, shown in NAMES.items():
        name = F.when(role == known, F.lit(shown)).otherwise(name)
    return F.concat(F.lit("### "), name, F.lit(": "))


def _role(name: Column) -> Column:
    role = unescape(F.replace(F.substr(name, F.lit(2)), F.lit("\\c"), F.lit(":")))
    for known, shown in NAMES.items():
        role = F.when(name == shown, F.lit(known)).otherwise(role)
    return role


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans). A span has its
    start and length, and ``part``, the place of its text among all that END and
    PART divide. Places and runs of one role are running sums over the turns, so
    the work grows with a conversation and not with its square."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "role", escape(F.col("text")).alias("shown"), ~F.lag("role").over(order).eqNullSafe(F.col("role")) | (F.row_number().over(order) == 1), (F.row_number().over(order) - 1).alias("part"))
    rows = rows.toDF("conv_id", "role", "shown", "starts", "part")
    in_order = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.when(F.col("starts"), F.char_length(_header(F.col("role"))) + F.when(F.col("part") > 0, len(END)).otherwise(0)).otherwise(len(PART))
    size = F.char_length("shown")
    rows = rows.withColumns({"run": F.count_if("starts").over(in_order), "end": F.sum(lead + size).over(in_order)})
    turn = F.struct("part", "shown", F.struct((F.col("end") - size).cast("int").alias("start"), size.alias("length"), F.col("part").cast("int").alias("part")).alias("span"))
    runs = rows.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.concat(_header(F.col("role")), F.array_join(F.transform("turns", lambda t: t["shown"]), PART), F.lit(END))
    spans = F.when(F.col("role") == "assistant", F.transform("turns", lambda t: t["span"])).otherwise(F.array())
    blocks = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("run", text.alias("text"), spans.alias("spans")))).alias("blocks"))
    return blocks.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("formatted"), F.flatten(F.transform("blocks", lambda b: b["spans"])).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array of (role, text)."""

    def block(b: Column) -> Column:
        name = F.substring_index(b, ": ", 1)
        return F.struct(_role(F.substr(name, F.lit(5))).alias("role"), F.split(F.substr(b, F.char_length(name) + 3), PART).alias("parts"))

    blocks = F.transform(F.filter(F.split(formatted, END), lambda b: b != ""), block)
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["parts"], lambda p: F.struct(b["role"].alias("role"), unescape(p).alias("text")))))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order, nothing between. A span's text
    is the end of its part, behind the header if the part has one."""
    parts = F.flatten(F.transform(F.split(formatted, END), lambda b: F.split(b, PART)))
    # the parts stand in an array of one, so that they are divided once
    found = F.transform(F.array(parts), lambda all_parts: F.array_join(F.transform(spans, lambda s: unescape(_end(F.get(all_parts, s["part"]), s["length"]))), ""))
    return F.get(found, F.lit(0))


def _end(text: Column, length: Column) -> Column:
    return F.substr(text, F.char_length(text) - length + 1, length)
