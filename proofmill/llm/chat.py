"""Chat formatting: budgeted windows over conversations, with DataFrame functions only.

Prefix sums of turn tokens put each turn into the stripe in which it begins; a stripe is half of what the budget leaves
beside the system turn. Turns of one stripe that cost no more than a stripe each are the own turns of one window, as they
fit together; a longer turn is a window alone. Windows are numbered by the turns that begin them. A leading system turn
is repeated in every window unless it takes over half the budget, and so are up to HISTORY turns before the window while
all of it fits the budget. Only the window's own assistant texts are under the loss mask.

A turn is <|role|>role<|text|>text<|end|>, a window <s>turns</s>. Control strings in roles and texts are broken up by a
backslash after their first character, backslashes are doubled; dropping each backslash before a character undoes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE, TEXT, END, OPEN, CLOSE = "<|role|>", "<|text|>", "<|end|>", "<s>", "</s>"
HISTORY, OVERHEAD = 2, 4
_CONTROL = r"(<(?=\||/?s>)|\|(?=>)|\[(?=/?INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Words and the template's share."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")) + OVERHEAD


def chat_windows(conversations: DataFrame, budget: int = 512) -> DataFrame:
    """Rows (conv_id, window, n_repeated, n_tokens, text, loss): loss has the spans (start, end) of text, in code points, to be learnt.

    Rows are ordered by turn, then role and text; repeated rows are all kept. Null roles and texts are empty, null turns
    come first, rows with a null conv_id are one conversation. A window holds whole turns, at least one of its own, and at
    most `budget` tokens, unless a turn by itself takes more than the budget leaves beside the system turn: such a turn is
    its window's only own turn. A system turn of over half the budget counts as any other turn. Other columns are ignored.
    """
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = conversations.select("conv_id", F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"i": F.row_number().over(conv), "cost": tokens(F.col("text"))})
    rows = rows.withColumn("system", (F.col("i") == 1) & (F.col("role") == "system") & (F.col("cost") <= budget // 2))
    own_cost = F.when(~F.col("system"), F.col("cost")).otherwise(0)
    rows = rows.withColumns({"before": F.sum(own_cost).over(upto) - own_cost, "room": budget - F.sum(F.when(F.col("system"), F.col("cost")).otherwise(0)).over(upto)})
    rows = rows.withColumns({"stripe": F.floor(2 * F.col("before") / F.col("room")), "long": 2 * F.col("cost") > F.col("room")})
    begins = ~F.col("system") & (F.lag("system", 1, True).over(conv) | F.col("long") | F.lag("long", 1, False).over(conv) | (F.lag("stripe", 1, -1).over(conv) != F.col("stripe")))
    rows = rows.withColumn("window", F.greatest(F.lit(0), F.sum(begins.cast("long")).over(upto) - 1).cast("long"))
    rows = rows.withColumn("own", F.sum(own_cost).over(Window.partitionBy("conv_id", "window")))
    ahead = {f"{c}{d}": F.lead(c, d).over(conv) for c in ("window", "before", "own") for d in range(1, HISTORY + 1)}
    rows = rows.withColumns({"last": F.max("window").over(Window.partitionBy("conv_id")), **ahead})
    places = [F.struct(F.col("window").alias("window"), F.lit(False).alias("again"))]
    for d in range(1, HISTORY + 1):  # the d-th turn from here begins a window: this one is among its history
        new = (F.col(f"window{d}") > (F.col("window") if d == 1 else F.col(f"window{d - 1}"))) & (F.col(f"before{d}") - F.col("before") + F.col(f"own{d}") <= F.col("room")) & ~F.col("system")
        places.append(F.when(new, F.struct(F.col(f"window{d}").alias("window"), F.lit(True).alias("again"))))
    own = F.filter(F.array(*places), lambda p: p.isNotNull())
    everywhere = F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda w: F.struct(w.alias("window"), (w > 0).alias("again")))
    rows = rows.select("conv_id", "i", "role", "text", "cost", F.explode(F.when(F.col("system"), everywhere).otherwise(own)).alias("p"))

    head = F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(TEXT))
    rows = rows.select("conv_id", "p.window", "p.again", "i", "cost", (F.col("role") == "assistant").alias("target"), head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumns({"from": F.char_length("head"), "size": F.char_length("body")})
    turn = F.struct("i", "again", "target", "from", "size", F.concat("head", "body", F.lit(END)).alias("piece"))
    packed = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("cost").alias("n_tokens"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + t["from"]
        mine = F.when(t["target"] & ~t["again"], F.array(F.struct(start.alias("start"), (start + t["size"]).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((start + t["size"] + len(END)).alias("at"), F.concat(acc["loss"], mine).alias("loss"))

    begin = F.struct(F.lit(len(OPEN)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return packed.select(
        "conv_id", "window", F.size(F.filter("turns", lambda t: t["again"])).alias("n_repeated"), "n_tokens",
        F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda t: t["piece"]), ""), F.lit(CLOSE)).alias("text"),
        F.aggregate("turns", begin, step)["loss"].alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, learnt): the turns (role, text) that are the window's own, and the unescaped texts under the mask."""
    inner = F.substring("text", F.lit(len(OPEN) + 1), F.char_length("text") - len(OPEN) - len(CLOSE))
    pieces = F.split(inner, r"<\|end\|>")
    pieces = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))
    turns = F.transform(F.transform(pieces, lambda p: F.split(p, r"<\|text\|>", -1)), lambda x: F.struct(unescaped(F.substring(x[0], F.lit(len(ROLE) + 1), F.char_length(x[0]))).alias("role"), unescaped(x[1]).alias("text")))
    learnt = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", turns.alias("turns"), learnt.alias("learnt"), F.char_length("text").cast("long").alias("chars"))


def chat_digest(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, read back from the windows."""
    own = read_windows(windows).select("conv_id", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), F.array_join("learnt", "").alias("learnt"), "chars")
    conv = own.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("all"))
    said, learnt = (F.array_join(F.col("all")[k], "") for k in ("said", "learnt"))
    return conv.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
