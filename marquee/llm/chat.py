"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation's turns are put in order and given token counts; prefix sums of
the counts choose spans of whole turns whose tokens fit the budget. Every
window starts with the system turn, repeats at most ``history`` earlier turns
that fit their share of the budget, and goes on with its own turns. Only
assistant texts of a window's own turns are targets, so each is learned once.

    window := <s> turn* </s>        turn := [TURN] role [TEXT] text [/TURN]

Control strings inside roles and texts get a backslash behind their first
character (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), which
is undone by taking one away. No control string holds the first character of
another one further inside, so none can arise where texts and marks meet.

Defined results: a null text or role is an empty one; rows with a null
conversation id form one conversation; repeated rows are turns of their own; a
turn longer than the budget has a window to itself; an empty table gives no
rows. Other columns are not read. A conversation is one row, since its digest
is defined over the whole; a window is bounded by the budget or one turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|TURN\]|TEXT\]))"
ESCAPED = r"([<\[])(\\*)\\(/?(?:s>|INST\]|TURN\]|TEXT\]))"
TURN_TOKENS = 4  # marks of a turn
CHARS_PER_TOKEN = 4.0
ROLE_SYSTEM, ROLE_TARGET = "system", "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def tokens(text: Column) -> Column:
    """An upper-side estimate that needs no tokenizer."""
    return (F.ceil(F.length(text) / CHARS_PER_TOKEN) + TURN_TOKENS).cast("long")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and ``turns``: array<role, text, sum>, ``sum`` being the prefix sum of tokens behind the turn."""
    filled = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = filled.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    counts = F.transform("t", lambda x: tokens(x["text"]))
    sums = F.aggregate(
        counts, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return grouped.select("conv_id", F.zip_with(
        "t", F.slice(sums, 2, F.greatest(F.size("t"), F.lit(1))),
        lambda x, s: F.struct(x["role"].alias("role"), x["text"].alias("text"), s.alias("sum"))).alias("turns"))


def spans(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """conv_id, turns and one row per window: ``win`` and the bounds ``lo`` (0-based) and ``hi`` (exclusive).

    A quarter of the budget is held for history; a system turn takes its own
    part, at most another quarter unless it is longer by itself.
    """
    has_system = F.get("turns", F.lit(0))["role"] == ROLE_SYSTEM
    with_room = turns.withColumn("has_system", has_system).withColumn("system", F.when(
        F.col("has_system"), F.get("turns", F.lit(0))["sum"]).otherwise(F.lit(0)).cast("long"))
    room = F.greatest(F.lit(budget) - F.lit(budget // 4) - F.col("system"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("base"),
                     F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, turn: Column) -> Column:
        # The first own turn of a window always stays, however long it is.
        full = (acc["at"] > 0) & (turn["sum"] - acc["base"] > room)
        return F.struct(
            (acc["at"] + 1).alias("at"), turn["sum"].alias("before"),
            F.when(full, acc["before"]).otherwise(acc["base"]).alias("base"),
            F.when(full, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"))

    cuts = with_room.withColumn("cuts", F.concat(
        F.array(F.lit(0)), F.aggregate("turns", start, step, lambda acc: acc["cuts"]), F.array(F.size("turns"))))
    # A system turn by itself is no window: the first cut behind it is taken back.
    alone = F.col("has_system") & (F.get("cuts", F.lit(1)) == 1) & (F.size("turns") > 1)
    cuts = cuts.withColumn("cuts", F.when(alone, F.concat(F.array(F.lit(0)), F.slice("cuts", F.lit(3), F.size("cuts")))).otherwise(F.col("cuts")))
    bounds = F.zip_with(
        F.slice("cuts", F.lit(1), F.size("cuts") - 1), F.slice("cuts", F.lit(2), F.size("cuts") - 1),
        lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))
    one = cuts.select("conv_id", "turns", "has_system", F.posexplode(bounds).alias("win", "b")).select(
        "conv_id", "turns", "has_system", "win", "b.lo", "b.hi")

    def sum_at(i: Column) -> Column:
        return F.coalesce(F.get("turns", i - 1)["sum"], F.lit(0))

    first_own = F.when(F.col("has_system"), F.lit(1)).otherwise(F.lit(0))
    back = F.lit(0)
    for h in range(1, history + 1):
        fits = (F.col("lo") - h >= first_own) & (sum_at(F.col("lo")) - sum_at(F.col("lo") - h) <= budget // 4)
        back = F.when(fits, F.lit(h)).otherwise(back)
    return one.withColumn("back", back).withColumn(
        "with_system", (F.col("has_system") & (F.col("win") > 0)).cast("int"))


def format_windows(rows: DataFrame, budget: int = 512, history: int = 2) -> DataFrame:
    """conv_id, win, formatted, tokens, repeated (leading turns that an earlier window
    taught) and ``loss``: array<start, length> of the targets, in code points of ``formatted``."""
    windows = spans(conversations(rows), budget, history)
    own = F.slice("turns", F.col("lo") - F.col("back") + 1, F.col("hi") - F.col("lo") + F.col("back"))
    head = F.slice("turns", F.lit(1), F.col("with_system"))
    chosen = windows.select(
        "conv_id", "win", (F.col("with_system") + F.col("back")).alias("repeated"), F.concat(head, own).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit("[TURN]"), escape(t["role"]), F.lit("[TEXT]")).alias("open"), escape(t["text"]).alias("body"),
        (t["role"] == ROLE_TARGET).alias("target"), tokens(t["text"]).alias("tokens")))
    built = chosen.withColumn("pieces", pieces)
    init = F.struct(F.lit(len("<s>")).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("found"), F.lit(0).alias("i"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["open"])
        span = F.array(F.struct((begin + 1).alias("start"), F.length(p["body"]).alias("length")))
        return F.struct(
            (begin + F.length(p["body"]) + len("[/TURN]")).alias("at"),
            F.when(p["target"] & (acc["i"] >= F.col("repeated")), F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"),
            (acc["i"] + 1).alias("i"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["open"], p["body"], F.lit("[/TURN]"))), "")
    return built.select(
        "conv_id", "win", F.concat(F.lit("<s>"), text, F.lit("</s>")).alias("formatted"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("tokens"),
        "repeated", F.aggregate("pieces", init, step, lambda acc: acc["found"]).alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, ``turns`` array<role, text>, ``loss_text`` and ``formatted_chars`` of each conversation,
    from the formatted windows and their masks alone."""
    inner = F.expr("substring(formatted, 4, length(formatted) - 7)")
    parts = F.slice(F.split(inner, r"\[TURN\]"), F.col("repeated") + 2, F.greatest(F.size(F.split(inner, r"\[TURN\]")), F.lit(1)))
    turns = F.transform(parts, lambda p: _let(F.split(p, r"\[TEXT\]", 2), lambda x: F.struct(
        unescape(F.get(x, F.lit(0))).alias("role"),
        unescape(F.regexp_replace(F.get(x, F.lit(1)), r"\[/TURN\]$", "")).alias("text"))))
    lost = F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"], s["length"]))), "")
    each = windows.select("conv_id", "win", turns.alias("turns"), lost.alias("lost"), F.length("formatted").cast("long").alias("chars"))
    whole = each.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("win", "turns", "lost"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"),
        F.array_join(F.transform("w", lambda x: x["lost"]), "").alias("loss_text"), "formatted_chars")
