"""Chat formatting in budgeted windows.

A conversation too long for one training sequence is cut into windows at turns. Prefix sums of turn
tokens choose the cuts: turns are added to a window while their tokens fit its share of the budget.
Each window begins with the conversation's system turn and repeats as many of the turns before it as
fit the share for history. The loss mask, spans in code points, covers the texts of assistant turns
where they are new, so a repeated turn is never learned twice.

A turn is written as <|im_start|>role, a line end, text, <|im_end|> and a line end. In a text (or role)
a string that any common template reads as control, with any number of backslashes after its first
character, gets one backslash more there; reading back takes one away. All else is left as it is, so
both directions are exact. Line ends and backslashes in roles are written as \\n and \\\\.

All is DataFrame expressions; one shuffle, by conversation. A turn with more tokens than its share
makes a window of its own, without history if that would be over the budget; turns are never cut.

Defined cases. A null text or role counts as empty; a null conv_id is a conversation's id like any
other. Turns with equal numbers are ordered by role and text, null numbers come first, repeated rows
are turns of their own. An empty table gives an empty one; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, and of those for repeated history. A turn's marks count as MARKS tokens.
BUDGET, HISTORY, MARKS = 1024, 256, 4
START, END = "<|im_start|>", "<|im_end|>\n"

#: Control strings of common templates, less their first character. Fixed values.
_CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|/?s>|/?SYS>>|<SYS>>|</SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    # Between pairs of backslashes, each of which is one, \\n is a line end.
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


#: What counts as a token: a character of a script that is written without spaces, six letters or digits of
#: a word or what is left of it, or a mark. Vocabularies spend about as many on such.
TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsHangul}]|[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsHangul}]]{1,6}|[^\p{L}\p{M}\p{N}_\s]"


def n_tokens(text: Column) -> Column:
    """Tokens of a text, as TOKEN counts them."""
    return F.regexp_count(text, F.lit(TOKEN))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window (from 0), text, loss (array of start and length in code points) and repeated (the
    number of turns at the window's start that an earlier window has) for turns(conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "text", (n_tokens(F.col("text")) + MARKS).cast("long").alias("cost"), head.alias("head"), escape(F.col("text")).alias("body"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(in_order))
    rows = rows.withColumn("system", (F.col("pos") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("own", F.when(F.col("system"), F.lit(0)).otherwise(F.col("cost")))
    # Tokens before the turn, the system turn's aside: strictly growing, so ties can't arise.
    rows = rows.withColumn("upto", F.sum("own").over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("own") - F.when(F.col("system"), F.lit(1)).otherwise(F.lit(0)))
    near = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)
    rows = rows.withColumn("back", F.sum(F.when(F.col("system"), 0).otherwise(1)).over(near) - 1)
    turn = F.struct("pos", "system", "cost", "back", "before", "head", "body", (F.col("role") == "assistant").alias("learn"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    convs = convs.withColumn("has", F.element_at("all", 1)["system"].cast("int"))
    convs = convs.withColumn("sys", F.slice("all", 1, F.col("has"))).withColumn("body", F.slice("all", F.col("has") + 1, F.greatest(F.size("all") - F.col("has"), F.lit(0))))
    share = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(F.get("sys", F.lit(0))["cost"], F.lit(0)))
    convs = convs.withColumn("share", share)
    # Positions in `body` (from 1) at which windows start.
    begun = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(s: Column, t: Column) -> Column:
        full = (s["at"] == 0) | (s["used"] + t["cost"] > F.col("share"))
        return F.struct(F.when(full, t["cost"]).otherwise(s["used"] + t["cost"]).alias("used"), (s["at"] + 1).alias("at"), F.when(full, F.array_append(s["starts"], s["at"] + 1)).otherwise(s["starts"]).alias("starts"))

    convs = convs.withColumn("starts", F.aggregate("body", begun, add)["starts"])
    # A conversation of a system turn alone is one window.
    convs = convs.withColumn("starts", F.when(F.size("starts") == 0, F.array(F.lit(1))).otherwise(F.col("starts")))

    def window(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1) - 1, F.size("body"))
        back = F.coalesce(F.get("body", start - 1)["back"], F.lit(0)).cast("int")
        new = F.slice("body", start, F.greatest(end - start + 1, F.lit(0)))
        tokens = F.aggregate(new, F.lit(0).cast("long"), lambda s, t: s + t["cost"])
        back = F.when((k == 0) | (tokens > F.col("share")), F.lit(0)).otherwise(back)
        told = F.concat(F.col("sys"), F.slice("body", start - back, F.greatest(end - start + 1 + back, F.lit(0))))
        repeated = F.when(k == 0, F.lit(0)).otherwise(F.col("has") + back)
        return F.struct(k.alias("window"), repeated.alias("repeated"), told.alias("told"))

    cut = convs.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    text = F.array_join(F.transform("told", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def mask(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(t["head"])
        new = t["learn"] & (s["n"] >= F.col("repeated"))
        spans = F.when(new, F.array_append(s["spans"], F.struct(start.alias("start"), F.length(t["body"]).alias("length")))).otherwise(s["spans"])
        return F.struct((start + F.length(t["body"]) + len(END)).alias("at"), (s["n"] + 1).alias("n"), spans.alias("spans"))

    return cut.select("conv_id", "window", "repeated", text.alias("text"), F.aggregate("told", none, mask)["spans"].alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns that a formatted text holds: an array of role and text."""
    parts = F.split(text, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        line = F.instr(p, "\n")
        return F.struct(_role_in(F.substring(p, F.lit(len(START) + 1), line - len(START) - 1)).alias("role"), unescape(F.substring(p, line + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say of each conversation: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars and n_windows, repeats left out."""
    turns = F.transform(F.slice(read_turns(F.col("text")), F.col("repeated") + 1, F.lit(1 << 30)), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    one = formatted.select("conv_id", F.struct("window", F.size(turns).cast("long").alias("n"), F.array_join(turns, "").alias("turns"), read_loss(F.col("text"), F.col("loss")).alias("loss"), F.length("text").cast("long").alias("chars")).alias("w"))
    convs = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    whole = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    total = lambda c: F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x[c])
    return convs.select("conv_id", total("n").alias("n_turns"), F.sha2(whole("turns").cast("binary"), 256).alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss").cast("binary"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"), F.size("w").cast("long").alias("n_windows"))
