"""Chat formatting in budgeted, turn-aligned windows, in DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line end. In roles and texts ``&``, ``#``, ``<`` (and
``:`` in roles) become ``&amp;``, ``&#35;``, ``&lt;`` and ``&#58;``, so no text can hold a control string,
and undoing ``&amp;`` last restores it exactly.

Prefix sums of the turns' tokens choose the windows: each takes as many new turns as fit
into the budget, besides the leading system turns, which every window repeats, and a limited tail of
the turns before. Targets are the assistant turns; a repeated one is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512  # tokens of a window
HISTORY = 128  # tokens of earlier turns that a window may repeat
MARKS = 6  # tokens of a turn's marks
END = "</turn>\n"
# A token is a run of letters and digits or one other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("#", "&#35;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((":", "&#58;"), ("<", "&lt;"), ("#", "&#35;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: ``conv_id, window, text, n_system, n_history, n_new, n_tokens, loss_spans``.

    ``loss_spans`` holds start (from 0) and length, in code points of ``text``, of each new
    assistant text. Turns are ordered by turn, role and text, so ties and repeated rows have a
    fixed place and all are written. Null roles and texts are empty; rows of a null conversation form one. A turn that
    alone exceeds the budget is a window of its own and is not cut. Other columns are ignored; no rows give no windows.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit("### "), F.replace(escape(F.col("role")), F.lit(":"), F.lit("&#58;")), F.lit(": "))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text")), "tokens": F.regexp_count("text", F.lit(TOKEN)).cast("bigint") + MARKS})
    rows = rows.withColumn("chars", (F.length("head") + F.length("body") + len(END)).cast("bigint"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("pos"),
        F.concat("head", "body", F.lit(END)).alias("line"),
        (F.col("role") == "assistant").alias("target"),
        F.length("head").alias("skip"),
        F.length("body").alias("size"),
        "tokens",
        F.sum("tokens").over(before).alias("upto"),
        F.sum("chars").over(before).alias("chars"),
        (F.max((F.col("role") != "system").cast("int")).over(before) == 0).alias("lead"),
    )
    every = F.array_sort(F.collect_list(F.struct("pos", "line", "target", "skip", "size", "tokens", "upto", "chars", "lead")))
    convs = rows.groupBy("conv_id").agg(every.alias("turns"))
    convs = convs.withColumns({"lead": F.filter("turns", lambda t: t["lead"]), "rest": F.filter("turns", lambda t: ~t["lead"])})
    last = lambda c, f: F.coalesce(F.try_element_at(F.col(c), F.lit(-1))[f], F.lit(0).cast("bigint"))
    convs = convs.withColumns({"lead_tokens": last("lead", "upto"), "lead_chars": last("lead", "chars"), "n_lead": F.size("lead")})
    room = lambda seen: F.greatest(F.lit(budget) - F.col("lead_tokens") - F.when(seen > 1, F.lit(history)).otherwise(0), F.lit(1))
    opened = F.aggregate(
        "rest",
        F.struct(F.lit(0).cast("bigint").alias("base"), F.array().cast("array<int>").alias("starts")),
        lambda acc, t: F.when(
            (F.size(acc["starts"]) == 0) | (t["upto"] - acc["base"] > room(F.size(acc["starts"]))),
            F.struct((t["upto"] - t["tokens"]).alias("base"), F.array_append(acc["starts"], t["pos"] - F.col("n_lead")).alias("starts")),
        ).otherwise(acc),
        lambda acc: acc["starts"],
    )
    convs = convs.withColumn("starts", opened).withColumn("starts", F.when(F.size("starts") == 0, F.array(F.lit(1))).otherwise(F.col("starts")))
    spans = convs.select("*", F.posexplode("starts").alias("window", "first"))
    spans = spans.withColumn("stop", F.coalesce(F.try_element_at("starts", F.col("window") + 2), F.size("rest") + 1))
    spans = spans.withColumn("new", F.slice("rest", F.col("first"), F.col("stop") - F.col("first")))
    earlier = F.slice("rest", F.lit(1), F.col("first") - 1)
    spans = spans.withColumn("past_upto", F.coalesce(F.try_element_at(earlier, F.lit(-1))["upto"], F.col("lead_tokens")))
    spans = spans.withColumn("past", F.filter(earlier, lambda t: F.col("past_upto") - t["upto"] + t["tokens"] <= history))
    # where the window's first repeated or new turn starts, in characters of the whole conversation
    shown = F.concat("past", "new")
    shift = F.coalesce(F.get(F.transform(F.slice(shown, 1, 1), lambda t: t["chars"] - F.length(t["line"])), F.lit(0)), F.lit(0).cast("bigint"))
    spans = spans.withColumns({"shown": shown, "shift": shift})
    targets = F.transform(
        F.filter("new", lambda t: t["target"]),
        lambda t: F.struct((F.col("lead_chars") + t["chars"] - F.length(t["line"]) - F.col("shift") + t["skip"]).cast("int").alias("start"), t["size"].alias("length")),
    )
    lines = F.transform(F.concat("lead", "shown"), lambda t: t["line"])
    total = F.aggregate("shown", F.col("lead_tokens"), lambda acc, t: acc + t["tokens"])
    return spans.select("conv_id", "window", F.array_join(lines, "").alias("text"), F.col("n_lead").alias("n_system"), F.size("past").alias("n_history"), F.size("new").alias("n_new"), total.alias("n_tokens"), targets.alias("loss_spans"))


def read_windows(windows: DataFrame) -> DataFrame:
    """The new turns of each window and the text under its mask, parsed from the written text.

    ``conv_id, window, turns array<struct<role, text>>, loss string, chars``; the system turns count as new in the first window.
    """
    lines = F.filter(F.split("text", END), lambda x: x != "")
    known = F.when(F.col("window") > 0, F.col("n_system")).otherwise(0) + F.col("n_history")
    new = F.slice(lines, known + 1, F.greatest(F.size(lines) - known, F.lit(0)))
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(5)), ": ", 1)).alias("role"),
        unescape(F.substr(x, F.length(F.substring_index(x, ": ", 1)) + 3)).alias("text"),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"]))), "")
    return windows.select("conv_id", "window", F.transform(new, turn).alias("turns"), loss.alias("loss"), F.length("text").alias("chars"))


def digest(read: DataFrame) -> DataFrame:
    """Per conversation: number and SHA-256 of all turns, of the text under the mask, and characters written."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select("conv_id", "window", said.alias("said"), "loss", F.size("turns").alias("n"), "chars")
    parts = F.array_sort(F.collect_list(F.struct("window", "said", "loss")))
    whole = rows.groupBy("conv_id").agg(parts.alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    text = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    whole = whole.withColumns({"said": text("said"), "loss": text("loss")})
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
