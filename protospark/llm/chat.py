"""Chat formatting: turns in marked, reversible text, cut into budgeted windows with repeated history (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, of them for repeated history at most, turns repeated at most, and tokens of a turn's marks.
BUDGET, HISTORY, REPEATS, MARKS = 1024, 256, 4, 5


def escape(text: Column) -> Column:
    """Put a backslash into every `<|`, and one more where there were some: no control string is left, and unescape undoes it."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    r"""Also write line ends as \n and backslashes as \s, since a line end closes the role."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """The measure of a turn: a token for each four code points begun, besides MARKS."""
    return F.ceil(F.char_length(text) / 4) + MARKS


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, repeats: int = REPEATS) -> DataFrame:
    """Format conversations into windows: rows (conv, win, text, marks, n_tokens).

    A window has the leading system turn, then repeated turns, then new ones, and `budget` tokens in all. Windows are
    filled one after the other: prefix sums of the turns' tokens since the window's first new turn tell how far it
    reaches, and the turn that no longer fits opens the next. The turns before that one are repeated in it: the last
    `repeats` at most, as far as they have `history` tokens together; none of them if the turn itself would not fit
    beside them. A turn is never cut, so a window exceeds the budget only if its single new turn does so beside the system
    turn. A leading system turn of more than half the budget is a turn like others, and not retained. `marks` has for each
    turn in the text: start and length of its escaped content in code points, fresh (not a repeat), and loss (a fresh
    assistant turn). Further system turns are turns like others. A conversation of one system turn is one window.

    Turns are ordered by turn, then role, then text, nulls first; a null text or role counts as empty, a null
    conversation is a conversation. Repeated rows are turns of their own. Empty in, empty out. The places where a
    conversation's windows begin are found in one row, which holds its turns' tokens but no text.
    """
    x = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # one exchange by conversation serves all that follows
    x = x.repartition("conv")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")))
    x = x.select("conv", "k", "role", escape_role(F.col("role")).alias("role_text"), escape(F.col("text")).alias("body"))
    x = x.withColumn("cost", tokens(F.col("body")).cast("long"))
    x = x.withColumn("is_head", (F.col("k") == 1) & (F.col("role") == "system") & (F.col("cost") <= budget // 2))
    by_k = Window.partitionBy("conv").orderBy("k")
    so_far = by_k.rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct("k", "cost", "role_text", "body", (F.col("role") == "assistant").alias("target"))
    x = x.select(
        "conv", "k", "cost", "is_head", here.alias("new"),
        F.first(F.when(F.col("is_head"), here)).over(so_far).alias("head"),
        F.lead("k").over(by_k).isNull().alias("last"),
        F.collect_list(F.when(~F.col("is_head"), here)).over(by_k.rowsBetween(-repeats, -1)).alias("before"),
    )
    room = F.lit(budget) - F.coalesce(F.col("head.cost"), F.lit(0))
    # how many of the turns before are repeated if this one opens a window, and their tokens
    none = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens"), F.lit(True).alias("on"))

    def more(s: Column, t: Column) -> Column:
        fits = s["on"] & (s["tokens"] + t["cost"] <= history) & (s["tokens"] + t["cost"] + F.col("cost") <= room)
        return F.struct((s["n"] + fits.cast("int")).alias("n"), (s["tokens"] + F.when(fits, t["cost"]).otherwise(0)).alias("tokens"), fits.alias("on"))

    x = x.withColumn("again", F.aggregate(F.reverse("before"), none, more)).withColumn("room", room)
    sizes = x.where(~F.col("is_head")).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", "cost", F.col("again.tokens").alias("tokens"), "room"))).alias("turns"))
    begun = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("left"))

    def step(s: Column, t: Column) -> Column:
        opens = (F.size(s["starts"]) == 0) | (t["cost"] > s["left"])
        left = F.when(opens, t["room"] - F.when(F.size(s["starts"]) == 0, 0).otherwise(t["tokens"])).otherwise(s["left"])
        return F.struct(F.when(opens, F.concat(s["starts"], F.array(t["k"]))).otherwise(s["starts"]).alias("starts"), (left - t["cost"]).alias("left"))

    starts = sizes.select(F.col("conv").alias("_conv"), F.aggregate("turns", begun, step)["starts"].alias("starts"))
    x = x.join(starts.hint("merge"), F.col("conv").eqNullSafe(F.col("_conv")), "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))
    x = x.withColumn("win", F.size(F.filter("starts", lambda s: s <= F.col("k"))))
    opens = (F.col("win") > 1) & F.array_contains("starts", F.col("k"))
    x = x.select("conv", "win", "is_head", "new", "head", "last", F.when(opens, F.slice("before", F.size("before") - F.col("again.n") + 1, F.col("again.n"))).alias("again"))
    x = x.where(~F.col("is_head") | F.col("last"))
    group = x.groupBy("conv", "win").agg(F.sort_array(F.collect_list("new")).alias("new"), F.max("again").alias("again"), F.max(F.when(~F.col("is_head"), F.col("head"))).alias("head"))

    def tagged(turns: Column, fresh: Column) -> Column:
        empty = F.array().cast("array<struct<role_text: string, body: string, fresh: boolean, loss: boolean>>")
        return F.coalesce(F.transform(turns, lambda t: F.struct(t["role_text"].alias("role_text"), t["body"].alias("body"), fresh.alias("fresh"), (t["target"] & fresh).alias("loss"))), empty)

    lead = F.get(F.col("new"), F.lit(0))["k"] == 2
    head = tagged(F.when(F.col("head").isNotNull(), F.array("head")), lead)
    return render(group.select("conv", "win", F.concat(head, tagged(F.col("again"), F.lit(False)), tagged(F.col("new"), F.lit(True))).alias("turns")))


def render(group: DataFrame) -> DataFrame:
    """Put turns (role_text, body, fresh, loss) into the template and say where each body lies."""
    line = lambda t: F.concat(F.lit(START), t["role_text"], F.lit("\n"), t["body"], F.lit(END + "\n"))
    lead, close = len(START) + 1, len(END) + 1
    lengths = F.transform("turns", lambda t: F.struct((F.char_length(t["role_text"]) + lead).alias("lead"), F.char_length(t["body"]).alias("body"), t["fresh"].alias("fresh"), t["loss"].alias("loss")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int, fresh: boolean, loss: boolean>>").alias("marks"))
    folded = F.aggregate(
        lengths,
        start,
        lambda a, t: F.struct((a["at"] + t["lead"] + t["body"] + close).alias("at"), F.concat(a["marks"], F.array(F.struct((a["at"] + t["lead"]).alias("start"), t["body"].alias("length"), t["fresh"].alias("fresh"), t["loss"].alias("loss")))).alias("marks")),
        lambda a: a["marks"],
    )
    out = group.select("conv", "win", F.array_join(F.transform("turns", line), "").alias("text"), folded.alias("marks"))
    return out.select("conv", "win", "text", "marks", F.aggregate("marks", F.lit(0).cast("long"), lambda a, m: a + F.ceil(m["length"] / 4) + MARKS).alias("n_tokens"))


def turns_of(text: Column, marks: Column) -> Column:
    """Parse a window back: an array of its fresh turns, with role and text as they were."""
    pattern = F.lit(r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n")
    roles, bodies = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    both = F.zip_with(F.arrays_zip(roles.alias("role"), bodies.alias("text")), marks, lambda t, m: F.struct(t["role"].alias("role"), t["text"].alias("text"), m["fresh"].alias("fresh")))
    return F.transform(F.filter(both, lambda t: t["fresh"]), lambda t: F.struct(unescape_role(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """A row per conversation, all read back from the windows: number and hash of its turns, text under the loss mask."""
    loss = F.array_join(F.transform(F.filter("marks", lambda m: m["loss"]), lambda m: unescape(F.substr(F.col("text"), m["start"] + 1, m["length"]))), "")
    x = formatted.select("conv", "win", turns_of(F.col("text"), F.col("marks")).alias("turns"), loss.alias("loss"), F.char_length("text").alias("chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    x = x.select("conv", F.struct("win", said.alias("said"), "loss").alias("part"), F.size("turns").alias("n"), "chars")
    x = x.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    said, masked = F.array_join("parts.said", ""), F.array_join("parts.loss", "")
    return x.select("conv", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), "formatted_chars")
