"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

Turn texts become token counts (one token for every CHARS_PER_TOKEN code points, rounded up, and the
marks). Prefix sums of those counts, taken over blocks of turns first and then within them so that one
conversation may hold any number of rows, cut a conversation into windows: turn i is new in window
floor(tokens before i / stride). A window shows the system turn, a limited history that repeats the
turns within `history` tokens before its first new turn, then its new turns. Repeated turns and the
system turn are masked; each assistant text is a target once, where it is new.

The template marks a turn as `[INST]role` newline text `[/INST]` and a target's end as `</s>`. Inside roles and
texts a backslash is put before every backslash, `[`, `]`, `<` and `>`, and a line end in a role is written as a
backslash and n, so no control string survives there and the text can be read back.

`fitted_windows`, which `format_chats` and the digests use, keeps system turn, history and new turns together within
the budget. `windows` is a plain grid, which its last new turn and the system turn may pass.

Defined results: rows are ordered by turn (null first), then role, then the MD5 digest of the text; null role or text counts as
empty; repeated rows are turns of their own; a null conversation id is one conversation; an empty table gives no rows; other input
columns are not carried. Rows of one conversation and BLOCK_TURNS turn numbers are sorted in one task (spilling, not held).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialize, ship

CHARS_PER_TOKEN, MARK_TOKENS = 4, 4
BUDGET, HISTORY = 2048, 512
OPEN, CLOSE, STOP = "[INST]", "[/INST]", "</s>"
#: Turns of a conversation that one prefix-sum group holds.
BLOCK_TURNS = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]<>])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\\[\]<>])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def tokens_of(turns: DataFrame) -> DataFrame:
    """conv_id (also as key and no_id, which joins can use), turn, role, text, tie (orders equal turns), tokens and block of every row."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"key": F.coalesce("conv_id", F.lit(0)), "no_id": F.col("conv_id").isNull(), "tie": F.md5("text"), "tokens": (F.ceil(F.length("text") / CHARS_PER_TOKEN) + MARK_TOKENS).cast("bigint")})
    return rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))).cast("bigint"))


CONVERSATION, BLOCK = ["key", "no_id"], ["key", "no_id", "block"]


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows with their place (_i) and the tokens before them (_s) within their block."""
    inside = Window.partitionBy(*BLOCK).orderBy(F.col("turn").asc_nulls_first(), "role", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"_i": F.count("*").over(inside), "_s": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})


def _earlier_blocks(rows: DataFrame) -> DataFrame:
    """Rows and tokens in the earlier blocks of each block's conversation."""
    sums = rows.groupBy(*BLOCK).agg(F.count("*").alias("_n"), F.sum("tokens").alias("_t"))
    earlier = Window.partitionBy(*CONVERSATION).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*BLOCK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_place"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))


def _place(rows: DataFrame, sums: DataFrame) -> DataFrame:
    joined = rows.join(sums, BLOCK)
    return joined.withColumns({"place": F.col("_place") + F.col("_i"), "before": F.col("_before") + F.col("_s")}).drop("_place", "_before", "_i", "_s")


def numbered(rows: DataFrame) -> DataFrame:
    """rows of tokens_of with `place` (0, 1, ...) and `before` (tokens of the earlier turns).

    Turns are dealt to blocks by turn number; sums go over blocks, then within a block.
    """
    return _place(_in_blocks(rows), _earlier_blocks(rows))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each turn shown in a window.

    conv_id, window, place, role, text, tokens, is_new, is_target, segment (the formatted turn).
    A window's new turns begin within `budget - history` tokens; the last of them may end beyond, and the system
    turn comes on top, so a window may exceed the budget. fitted_windows keeps it.
    Where windows start is worked out on rows without texts; texts are dealt once, by block.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be at least 0 and less than budget")
    stride = budget - history
    rows = numbered(tokens_of(turns)).withColumn("window", F.floor(F.col("before") / stride).cast("bigint"))
    slim = rows.select("conv_id", "block", "window", "before")
    starts = slim.groupBy("conv_id", "window").agg(F.min("before").alias("start")).select(F.col("conv_id").alias("_c"), F.col("window").alias("_v"), "start")
    # the windows that may repeat turns of a block: window w starts at w * stride or later, so one that
    # starts within `history` tokens after a turn is at most history // stride + 1 windows on
    spans = slim.groupBy("conv_id", "block").agg(F.min("window").alias("_lo"), F.max("window").alias("_hi"))
    spans = spans.where(F.lit(history > 0))
    near = spans.withColumn("_w", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi") + F.lit(history // stride + 1)))).join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_w") == F.col("_v")))
    near = near.groupBy("conv_id", "block").agg(F.collect_list(F.struct(F.col("_w").alias("w"), "start")).alias("_near")).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), "_near")
    placed = rows.join(near, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    again = F.transform(F.filter("_near", lambda n: (n["w"] > F.col("window")) & (F.col("before") >= n["start"] - F.lit(history))), lambda n: F.struct(n["w"].alias("window"), F.lit(False).alias("is_new")))
    new = F.array(F.struct(F.col("window"), F.lit(True).alias("is_new")))
    where = F.when(is_system | F.col("_near").isNull(), new).otherwise(F.concat(new, again))
    shown = placed.select("conv_id", "place", "role", "text", "tokens", F.explode(where).alias("_x")).select("conv_id", "_x.window", "place", "role", "text", "tokens", "_x.is_new")
    systems = rows.where(is_system).select("conv_id", "place", "role", "text", "tokens")
    later = systems.join(starts.where("_v > 0"), F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", F.col("_v").alias("window"), "place", "role", "text", "tokens", F.lit(False).alias("is_new"))
    out = shown.unionByName(later)
    return _with_segments(out)


def _with_segments(out: DataFrame) -> DataFrame:
    target = F.col("is_new") & (F.col("role") == "assistant")
    segment = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(CLOSE), F.when(target, F.lit(STOP)).otherwise(F.lit("")))
    return out.withColumns({"is_target": target, "segment": segment})


def fitted_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The rows of `windows`, with windows whose turns shown have at most `budget` tokens in all.

    Only a turn that doesn't fit beside the system turn exceeds it, in a window without other turns. Turns are dealt by prefix
    sum to cells of the tokens that system turn and history leave; a turn that ends beyond its cell stays
    while it fits, with less history, and else has a window of its own. Windows are numbered from 0 on.
    """
    shown, later = _fitted(turns, budget, history, BLOCK)
    cols = ["conv_id", "window", "place", "role", "text", "tokens", "is_new"]
    return _with_segments(shown.select(cols).unionByName(later.select(cols)))


def _fitted(turns: DataFrame, budget: int, history: int, deal: list[str]) -> tuple[DataFrame, DataFrame]:
    """The turns shown in windows, and apart from them the system turns that later windows show again.

    Windows are worked out on a table of numbers, written once. Texts are dealt once, by block, or by conversation if the
    caller brings each conversation together anyway; what a block has to know meets them by the same keys.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be at least 0 and less than budget")
    rows = tokens_of(turns)
    slim = numbered(rows.drop("text")).withColumn("is_system", (F.col("place") == 0) & (F.col("role") == "system"))
    slim = materialize(slim.select(*BLOCK, "place", "before", "tokens", "is_system"), "chat-turns")
    sizes = slim.where("is_system").select(*CONVERSATION, F.col("tokens").alias("_system"))
    firsts = slim.groupBy(*BLOCK).agg(F.min("place").alias("_place"), F.min("before").alias("_before"), F.max("place").alias("_last"))
    firsts = firsts.join(sizes, CONVERSATION, "left").withColumn("_system", F.coalesce("_system", F.lit(0)))
    placed = _cells(slim.join(firsts, BLOCK), budget, history)
    new = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("tokens"))
    wins = placed.groupBy(*CONVERSATION, "cell", "alone").agg(F.min("at").alias("start"), F.sum(new).alias("_new"), F.first("room").alias("room"))
    wins = _number(wins).withColumn("since", F.col("start") - F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - F.col("_new"))))
    wins = materialize(wins.select(*CONVERSATION, "cell", "alone", "window", "start", "since"), "chat-windows")
    # the windows that may show turns of a block: those of its cells and of the next two
    cells = placed.select(*BLOCK, F.explode(F.array("cell", F.col("cell") + 1, F.col("cell") + 2)).alias("cell")).distinct()
    near = cells.join(wins, [*CONVERSATION, "cell"]).groupBy(*BLOCK).agg(F.collect_list(F.struct("cell", "alone", "window", "start", "since")).alias("_near"))
    facts = firsts.join(near, BLOCK).groupBy(*deal).agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct("_place", "_before", "_system", "_near")))).alias("_facts"))
    dealt = rows if deal == BLOCK else rows.repartition(*deal)
    known = _in_blocks(dealt).join(facts, deal).withColumn("_known", F.element_at("_facts", F.col("block"))).drop("_facts")
    known = known.withColumns({"place": F.col("_known._place") + F.col("_i"), "before": F.col("_known._before") + F.col("_s"), "_system": F.col("_known._system"), "_near": F.col("_known._near")})
    known = _cells(known.withColumn("is_system", (F.col("place") == 0) & (F.col("role") == "system")), budget, history)
    own = F.transform(F.filter("_near", lambda w: (w["cell"] == F.col("cell")) & (w["alone"] == F.col("alone"))), lambda w: F.struct(w["window"].alias("window"), F.lit(True).alias("is_new")))
    back = F.filter("_near", lambda w: ~F.col("is_system") & (F.col("at") >= w["since"]) & (F.col("at") < w["start"]))
    again = F.transform(back, lambda w: F.struct(w["window"].alias("window"), F.lit(False).alias("is_new")))
    said = [*CONVERSATION, "conv_id", "place", "role", "text", "tokens"]
    shown = known.select(*said, F.explode(F.concat(own, again)).alias("_x")).select(*said, "_x.window", "_x.is_new")
    # a system turn in the first place is the least of its conversation's system turns
    least = F.min(F.struct(F.col("turn").isNotNull(), "turn", "tie", "conv_id", "role", "text", "tokens")).alias("_s")
    systems = rows.where("role = 'system'").groupBy(*CONVERSATION).agg(least).join(sizes.select(*CONVERSATION), CONVERSATION).select(*CONVERSATION, "_s.conv_id", F.lit(0).cast("bigint").alias("place"), "_s.role", "_s.text", "_s.tokens")
    later = systems.join(wins.where("window > 0").select(*CONVERSATION, "window"), CONVERSATION).select(*said, "window", F.lit(False).alias("is_new"))
    return shown, later


def _cells(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """room and stride of a conversation's windows; at (tokens before, but for the system turn), cell and alone of each turn."""
    rows = rows.withColumn("room", F.greatest(F.lit(budget) - F.col("_system"), F.lit(1)))
    # at least half of the room, so that history reaches back over three cells at most
    rows = rows.withColumn("stride", F.greatest(F.col("room") - history, F.ceil(F.col("room") / 2)).cast("bigint"))
    rows = rows.withColumn("at", F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("before") - F.col("_system")))
    rows = rows.withColumn("cell", F.floor(F.col("at") / F.col("stride")).cast("bigint"))
    return rows.withColumn("alone", ~F.col("is_system") & (F.col("at") + F.col("tokens") - F.col("cell") * F.col("stride") > F.col("room")))


def _number(wins: DataFrame) -> DataFrame:
    """Windows of each conversation numbered from 0 on by cell, over runs of cells first and then within them."""
    wins = wins.withColumn("_run", F.floor(F.col("cell") / 4096))
    runs = wins.groupBy(*CONVERSATION, "_run").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*CONVERSATION).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*CONVERSATION, "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(*CONVERSATION, "_run").orderBy("cell", "alone"))
    return wins.withColumn("_k", within).join(runs, [*CONVERSATION, "_run"]).withColumn("window", (F.col("_first") + F.col("_k") - 1).cast("bigint")).drop("_run", "_k", "_first")


def read_back(segments: DataFrame) -> DataFrame:
    """Role and text of each shown turn, parsed from its segment alone, and whether it is a target."""
    body = F.substring(F.col("segment"), len(OPEN) + 1, F.length("segment"))
    stop = F.endswith(F.col("segment"), F.lit(CLOSE + STOP))
    body = F.substring(body, F.lit(1), F.length(body) - F.when(stop, F.lit(len(CLOSE + STOP))).otherwise(F.lit(len(CLOSE))))
    cut = F.locate("\n", body)
    return segments.withColumns({"_body": body, "_cut": cut, "read_target": stop}).withColumns({"read_role": unescape_role(F.expr("substring(_body, 1, _cut - 1)")), "read_text": unescape(F.expr("substring(_body, _cut + 1)"))}).drop("_body", "_cut")


def formatted(segments: DataFrame) -> DataFrame:
    """(conv_id, window, formatted): the windows as texts, turns in order; a group is one window."""
    parts = F.array_sort(F.collect_list(F.struct("place", "segment")))
    return segments.groupBy("conv_id", "window").agg(F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("formatted"))


def conversation_digests(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Digests of what the formatted windows say about each conversation, read back from the segments.

    A digest is sequential, so a conversation's text meets in one row here, and here only.
    """
    shown, later = _fitted(turns, budget, history, CONVERSATION)
    turn = F.struct("place", F.col("read_role").alias("role"), F.col("read_text").alias("text"), F.col("read_target").alias("target"))
    per = read_back(_with_segments(shown)).groupBy(*CONVERSATION).agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.when(F.col("is_new"), turn))).alias("said"), F.sum(F.length("segment")).alias("_chars"),
        F.count_if("is_new").alias("_new"), F.size(F.collect_set(F.when(F.col("is_new"), F.col("window")))).cast("bigint").alias("n_windows"), F.count_if(~F.col("is_new")).alias("_again"),
    )
    more = _with_segments(later).groupBy(*CONVERSATION).agg(F.sum(F.length("segment")).alias("_more"), F.count("*").alias("_systems"))
    per = per.join(more, CONVERSATION, "left").withColumns({"formatted_chars": F.col("_chars") + F.coalesce("_more", F.lit(0)), "repeated_turns": F.col("_again") + F.coalesce("_systems", F.lit(0))})
    turns_text = F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("said", lambda x: x["target"]), lambda x: x["text"]), "")
    per = per.withColumn("_loss", loss)
    return per.select(
        "conv_id", F.col("_new").alias("n_turns"), F.sha2(F.encode(turns_text, "UTF-8"), 256).alias("turns_sha256"), F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("_loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "n_windows", "repeated_turns",
    )


def format_chats(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted) of all conversations, within the budget."""
    ship(turns.sparkSession)
    return formatted(fitted_windows(turns, budget, history))
