"""Chat formatting into budgeted windows with loss masks, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans. A window shows the system turn, a limited history
from the span before, and the span's own turns; only the own turns of the assistant are under the loss mask, so a turn
is a target once however often it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: What a text may not show, and how it is written: no control string of any template can then begin inside a text.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
NEWLINE = ("\n", "\\n")  # in roles, besides


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def turn_tokens(text: Column) -> Column:
    """An estimate without a vocabulary: four for the marks and one per four characters."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def format_chat(conversations: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """``conv_id, window, formatted, loss, repeated``: the windows of every conversation.

    ``loss`` lists (start, length) in code points of ``formatted`` of the assistant texts to learn from; the first
    ``repeated`` turns of a window (system turn, history) were shown before. A window stays within ``budget`` tokens
    unless one turn, with the system turn, is longer alone: turns are never cut. Rows go by turn; ties by role and text.
    Null texts and roles are empty, null conv_ids are one conversation, other columns are dropped. Only the first turn
    of a conversation counts as its system turn.
    """
    nothing = F.lit("")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), nothing).alias("role"), F.coalesce(F.col("text").cast("string"), nothing).alias("text")
    ).withColumn("tokens", turn_tokens(F.col("text")))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("idx", F.row_number().over(w))
    system = (F.col("idx") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("before", F.sum("tokens").over(so_far) - F.col("tokens"))
    rows = rows.withColumn("sys_tokens", F.coalesce(F.first(F.when(system, F.col("tokens"))).over(so_far), F.lit(0)))
    rows = rows.withColumn("sys_text", F.first(F.when(system, F.col("text"))).over(so_far))
    rows = rows.withColumn("half", F.greatest(F.lit(1.0), (F.lit(float(budget - history)) - F.col("sys_tokens")) / 2))
    rows = rows.withColumn("long", F.col("tokens") > F.col("half"))
    # a span: turns that begin in the same half of the budget; a turn over half is a span of its own
    alone = (F.col("long") | F.coalesce(F.lag("long").over(w), F.lit(False))).cast("long")
    rows = rows.withColumn("segment", F.sum(alone).over(so_far)).withColumn("cell", F.floor(F.col("before") / F.col("half")))
    fresh = (F.col("segment") != F.lag("segment").over(w)) | (F.col("cell") != F.lag("cell").over(w))
    rows = rows.withColumn("window", F.sum(F.coalesce(fresh, F.lit(False)).cast("long")).over(so_far))
    span = W.partitionBy("conv_id", "window")
    rows = rows.withColumn("to_end", F.max(F.col("before") + F.col("tokens")).over(span) - F.col("before"))
    rows = rows.withColumn("opens", F.min("idx").over(span) == F.col("idx"))

    def shown(kind: Column, window: Column, role: Column, text: Column) -> Column:
        return F.struct(kind.alias("kind"), window.alias("window"), role.alias("role"), text.alias("text"))

    target = shown(F.lit(2), F.col("window"), F.col("role"), F.col("text"))
    again = F.when((F.col("to_end") <= history) & ~((F.col("idx") == 1) & (F.col("role") == "system")), shown(F.lit(1), F.col("window") + 1, F.col("role"), F.col("text")))
    sys_again = F.when(F.col("opens") & (F.col("window") > 0) & F.col("sys_text").isNotNull(), shown(F.lit(0), F.col("window"), F.lit("system"), F.col("sys_text")))
    parts = rows.select("conv_id", "idx", F.explode(F.array_compact(F.array(sys_again, again, target))).alias("s"))
    parts = parts.select("conv_id", F.col("s.window").alias("window"), F.col("s.kind").alias("kind"), "idx", F.col("s.role").alias("role"), escape(F.col("s.text")).alias("text"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit(NEWLINE[0]), F.lit(NEWLINE[1])), F.lit("\n"))
    parts = parts.withColumn("head", head).withColumn("piece", F.concat("head", "text", F.lit(END)))
    inside = W.partitionBy("conv_id", "window").orderBy("kind", "idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.withColumn("at", F.sum(F.length("piece")).over(inside) - F.length("piece") + F.length("head"))
    masked = (F.col("kind") == 2) & (F.col("role") == "assistant")
    out = parts.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("kind", "idx", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(masked, F.struct(F.col("at").cast("long").alias("start"), F.length("text").cast("long").alias("length"))))).alias("loss"),
        F.count_if(F.col("kind") < 2).cast("int").alias("repeated"),
        F.max("kind").alias("most"),
    )
    # history that no span follows is no window
    return out.where("most = 2").select("conv_id", "window", F.array_join(F.col("pieces.piece"), "").alias("formatted"), "loss", "repeated")


def read_chat(windows: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role and text, repeated ones left out) and ``loss_texts`` to what ``format_chat`` made,
    all parsed from ``formatted``: the exact inverse."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))

    def turn(p: Column) -> Column:
        at = F.locate("\n", p) if isinstance(p, str) else F.position(F.lit("\n"), p)
        role = F.substr(p, F.lit(len(START) + 1), at - F.lit(len(START) + 1))
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE[1]), F.lit(NEWLINE[0]))).alias("role"), unescape(F.substr(p, at + 1)).alias("text"))

    spans = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return windows.withColumn("turns", F.transform(own, turn)).withColumn("loss_texts", spans)
