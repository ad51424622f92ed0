"""Chat formatting into budgeted windows, with a loss mask; DataFrame functions only.

A conversation's turns are rendered, their token estimates summed in order, and the prefix sums cut
the conversation into turn-aligned spans, a large turn into one of its own. A window is the leading system turn, a limited history
repeated from the span before, and the span itself. Assistant turns are targets in their own span
and masked where they are repeated, so each is learned from exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template, and control strings of common chat templates that texts must not hold as such.
OPEN, CLOSE = "<s>", "</s>\n"
CONTROL = r"/?INST\]|/?s>|</?SYS>>"


def escape(text: Column) -> Column:
    """Put one more backslash behind the first character of each control string, however many stand there."""
    return F.regexp_replace(text, rf"([\[<])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """Undo ``escape``: take one backslash from behind the first character of each control string."""
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({CONTROL})", r"$1$2$3")


def escape_role(role: Column) -> Column:
    """As ``escape``; backslashes and line feeds too, as a role ends at the first line feed."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``."""
    parts = F.split(role, r"\\\\", -1)
    return unescape(F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\"))


def windows(turns: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 128, system_tokens: int = 128, chars_per_token: int = 4, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format conversations as windows of about ``budget`` tokens (estimated as characters over ``chars_per_token``).

    Columns: ``key``, ``window``, ``formatted``, ``turns`` (index in the conversation, start and
    length of the escaped text in ``formatted`` in code points, loss, repeated), ``n_tokens``,
    ``over_budget``. A window is over budget only where one turn, the system turn or the two
    together don't fit; no text is cut or dropped.

    Null roles and texts count as empty, a null key is a conversation of its own. Turns with equal
    numbers are ordered by role, then text; repeated rows stay as turns. Other columns are ignored.
    """
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    rows = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lead_in = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns({"head": lead_in, "body": escape(F.col("text"))})
    rows = rows.withColumn("tokens", F.ceil((F.char_length("head") + F.char_length("body") + len(CLOSE)) / chars_per_token))
    rows = rows.withColumns({"index": F.row_number().over(order).cast("bigint") - 1, "end": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumns({"before": F.col("end") - F.col("tokens"), "leads": (F.col("index") == 0) & (F.col("role") == "system")})
    rows = rows.withColumn("system", F.coalesce(F.first(F.when(F.col("leads"), F.col("tokens"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    # turns of up to a stride: two strides at most in a step; a larger one is the first of its step and gets a span of its own
    rows = rows.withColumn("stride", F.greatest(F.lit(1), F.floor((budget - history_tokens - F.greatest("system", F.lit(system_tokens))) / 2)))
    rows = rows.withColumns({"step": F.floor((F.col("end") - 1) / F.col("stride")), "large": F.col("tokens") > F.col("stride")})
    follows = ~F.col("large") & F.max("large").over(Window.partitionBy("key", "step"))
    rows = rows.withColumn("span", 2 * F.col("step") + follows.cast("int"))
    rows = rows.withColumn("held", F.sum("tokens").over(Window.partitionBy("key", "span")))
    rows = rows.withColumns({"first": F.coalesce(F.lag("span").over(order) != F.col("span"), F.lit(True)), "assistant": F.col("role") == "assistant"})

    # a turn is history of each window that starts one to history_turns turns later, if near enough and if the window has room
    later = []
    for j in range(1, history_turns + 1):
        back = F.lead("before", j).over(order) - F.col("before")
        starts = F.lead("first", j).over(order) & (back <= history_tokens) & (back + F.lead("held", j).over(order) + F.col("system") <= budget) & ~F.col("leads")
        later.append(F.when(starts, F.struct(F.lead("span", j).over(order).alias("window"), F.lit(True).alias("repeated"))))
    own = F.struct(F.col("span").alias("window"), F.lit(False).alias("repeated"))
    placed = rows.withColumn("places", F.array_compact(F.array(own, *later)))
    columns = ["key", "index", "head", "body", "tokens", "assistant"]
    members = placed.select(*columns, F.inline("places"))

    system = rows.where("leads").select(*columns, F.col("span").alias("own"))
    starts = rows.where("first").select(F.col("key").alias("other"), F.col("span").alias("window"))
    again = system.join(starts, F.col("key").eqNullSafe(F.col("other")) & (F.col("window") != F.col("own"))).select(*columns, "window", F.lit(True).alias("repeated"))

    grouped = members.unionByName(again).groupBy("key", "window").agg(F.array_sort(F.collect_list(F.struct("index", "repeated", "assistant", "head", "body", "tokens"))).alias("parts"))
    place = lambda at, p: F.struct(p["index"].alias("index"), (at + F.char_length(p["head"])).cast("bigint").alias("start"), F.char_length(p["body"]).cast("bigint").alias("length"), (p["assistant"] & ~p["repeated"]).alias("loss"), p["repeated"].alias("repeated"))
    size = lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + len(CLOSE)
    sizes = F.transform("parts", size)
    at = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    return grouped.select(
        F.col("key").alias(key),
        "window",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform("parts", lambda p, i: place(at(i), p)).alias("turns"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["tokens"]).alias("n_tokens"),
        (F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["tokens"]) > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns of formatted windows, parsed from ``formatted``: ``key``, ``index``, ``role``, ``text``, ``loss_text``.

    Repeated turns are left out. ``loss_text`` is the text under the loss mask (null without loss).
    """
    marked = F.split("formatted", CLOSE, -1)
    each = formatted.select(F.col(key), "formatted", F.posexplode("turns").alias("i", "turn"), marked.alias("marked")).where(~F.col("turn.repeated"))
    block = F.substring(F.element_at("marked", F.col("i") + 1), len(OPEN) + 1, 2147483647)
    each = each.select(key, F.col("turn.index").alias("index"), block.alias("block"), F.when(F.col("turn.loss"), F.substring("formatted", F.col("turn.start") + 1, F.col("turn.length"))).alias("masked"))
    cut = F.instr("block", "\n")
    return each.select(key, "index", unescape_role(F.substring("block", F.lit(1), cut - 1)).alias("role"), unescape(F.substring("block", cut + 1, F.char_length("block"))).alias("text"), unescape(F.col("masked")).alias("loss_text"))
