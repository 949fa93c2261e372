"""Chat formatting in budgeted windows with a loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, stored

#: Tokens (words, and one for the marks of a turn) of new turns, and of repeated ones, in a window.
BUDGET = 768
HISTORY = 192
#: Conversations of up to so many turns are folded into windows; longer ones are by joins, so that no fold grows with one.
FOLDED = 1024
#: Marks of the template; roles and texts are escaped, so "<" is in marks only.
OPEN, AGAIN, BETWEEN, CLOSE = "<turn ", "<again ", ">\n", "</turn>\n"


def escaped(text: Column) -> Column:
    """No "<" is left, and unescaped() gives the text back whatever it holds."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    """A role has no ">" either, as that ends the mark it is in."""
    return F.replace(escaped(role), F.lit(">"), F.lit("&gt;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&gt;"), F.lit(">")))


def _spans(t: DataFrame, budget: int, history: int) -> DataFrame:
    """(conv, at): the turns that windows begin at, of conversations of any length; t: conv_id, n, tokens, before, charged.

    A window that began at a turn would end before the last turn whose prefix sum is within its room: prefix sums and
    the ends of all rooms are sorted together, and a running maximum tells. Which of these windows there are follows from
    the first one by doubling jumps: each round joins the turns reached with jumps over twice as many windows, so there are as
    many rounds as the longest conversation's number of windows has bits."""
    charged = F.col("charged")
    room = F.when(F.col("n") == 1, budget - charged).otherwise(F.greatest(F.lit(1), budget - history - charged))
    place = t.select(F.col("conv_id").alias("conv"), F.col("n").alias("at"), F.explode(F.array(F.struct(F.col("before").alias("v"), F.lit(0).alias("ask")), F.struct((F.col("before") + room).alias("v"), F.lit(1).alias("ask")))).alias("x"))
    last = F.max(F.when(F.col("x.ask") == 0, F.col("at"))).over(Window.partitionBy("conv").orderBy("x.v", "x.ask").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.col("before") + F.col("tokens")  # a turn fits if its own end does: the next turn's prefix sum, or the last one's end
    ends = t.groupBy(F.col("conv_id").alias("conv")).agg(F.max("n").alias("n"), F.max(end).alias("end"))
    place = place.unionByName(ends.select("conv", (F.col("n") + 1).alias("at"), F.struct(F.col("end").alias("v"), F.lit(0).alias("ask")).alias("x")))
    jumps = place.withColumn("to", F.greatest(F.coalesce(last, F.lit(0)), F.col("at") + 1)).filter("x.ask = 1").select("conv", "at", "to")
    whose = ends.select(F.col("conv").alias("of"), F.col("n").alias("most"))
    jumps = stored(jumps.join(whose, F.col("conv").eqNullSafe(F.col("of"))).filter("to <= most").select("conv", "at", "to"), "chat-jumps")
    reached = stored(ends.select("conv", F.lit(1).cast("long").alias("at")), "chat-starts")
    while not jumps.isEmpty():
        of = jumps.select(F.col("conv").alias("of"), F.col("at").alias("from"), "to")
        from_ = lambda key: F.col("conv").eqNullSafe(F.col("of")) & (F.col(key) == F.col("from"))
        reached = stored(reached.unionByName(reached.join(of, from_("at")).select("conv", F.col("to").alias("at"))), "chat-starts")
        on = jumps.withColumnRenamed("to", "via").join(of, from_("via")).select("conv", "at", "to")
        jumps = stored(on, "chat-jumps")
    return reached


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, folded: int = FOLDED) -> DataFrame:
    """One row for each window of a conversation: conv_id, window (from 0), formatted, loss.

    turns: conv_id, turn, role, text. A turn's tokens are its words and one; prefix sums of them choose turn-aligned
    spans: a window takes new turns while their sum is within its room, which is the budget in the first window and in
    later ones what the leading system turn, repeated in each, and the history leave of it. A window after the first
    repeats the last turns of the one before, up to history tokens and what its own
    turns leave of the budget. So new turns, system turn and history together are within the budget; only a window
    of a single new turn, which with the system turn is over it, is longer (and has no history). No turn is cut. loss
    is an array of (start, length) in code points of formatted: the texts of assistant turns, but not of
    repeated ones, so each assistant text is a target once.

    A turn is written as a mark with its place in the conversation and its role, its text, and an end
    mark. Null text is empty, null role is the empty role, and a null conv_id is a conversation of its
    own. Turns with equal numbers follow in order of role and text; equal rows are kept, as turns of their own.
    An empty table gives no rows; other columns are not looked at, so their names do not clash. Sums run over sorted rows
    that spill. Conversations of up to folded turns find their windows in one pass over their token counts; whether there
    are longer ones is looked for when called, and theirs are found by joins (_spans), with the same result. Only a
    window's rows are collected, so a long conversation needs no memory; very long texts are windows of their own.
    """
    if not 0 <= history <= budget or budget < 1 or folded < 1:
        raise ValueError("history must be from 0 to budget, budget and folded at least 1")
    long = not turns.groupBy("conv_id").count().filter(F.col("count") > folded).isEmpty()
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("tokens", (F.regexp_count("text", F.lit(WORD)) + 1).cast("long"))
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("n")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leads = (F.col("n") == 1) & (F.col("role") == "system")
    own = F.when(leads, 0).otherwise(F.col("tokens"))
    t = t.withColumn("leads", leads).withColumn("before", F.sum(own).over(so_far) - own)
    t = t.withColumn("system", F.first(F.when(F.col("leads"), F.col("text")), ignorenulls=True).over(so_far))
    charged = F.coalesce(F.first(F.when(F.col("leads"), F.col("tokens")), ignorenulls=True).over(so_far), F.lit(0))
    t = t.withColumn("charged", charged.cast("long"))

    # The turns that begin a window: greedily, over the token counts from the start of the conversation.
    counts = F.collect_list("tokens").over(so_far)
    room = F.greatest(F.lit(1), budget - history - F.col("charged"))

    def take(at, tokens):
        fits = (at["k"] == 0) | (at["used"] + tokens <= F.when(at["start"] == 0, F.lit(budget)).otherwise(room))
        used = F.when(fits, at["used"] + tokens).otherwise(tokens)
        return F.struct(used.alias("used"), F.when(fits, at["start"]).otherwise(at["k"]).alias("start"), (at["k"] + 1).alias("k"))

    zero = F.lit(0).cast("long")
    fold = lambda x: x.withColumn("fold", F.aggregate(counts, F.struct(zero.alias("used"), zero.alias("start"), zero.alias("k")), take))
    started = lambda x: fold(x).withColumn("starts", F.col("fold.start") + 1 == F.col("fold.k")).drop("fold")
    if long:
        t = t.withColumn("many", F.count("*").over(Window.partitionBy("conv_id")))
        far = t.filter(F.col("many") > folded)
        begin = _spans(stored(far.select("conv_id", "n", own.alias("tokens"), "before", "charged"), "chat-turns"), budget, history)
        far = far.join(begin, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("n") == F.col("at")), "left").withColumn("starts", F.col("at").isNotNull())
        t = started(t.filter(F.col("many") <= folded)).unionByName(far.drop("conv", "at")).drop("many")
    else:
        t = started(t)
    # What a window has used up to a turn: its new turns, and in the first one the system turn.
    begun = F.last(F.when(F.col("starts"), F.col("before")), ignorenulls=True).over(so_far)
    t = t.withColumn("used", F.col("before") + F.when(F.col("leads"), 0).otherwise(F.col("tokens")) - begun)
    t = t.withColumn("window", (F.sum(F.col("starts").cast("long")).over(so_far) - 1).cast("long"))
    t = t.withColumn("used", F.col("used") + F.when(F.col("window") == 0, F.col("charged")).otherwise(0))
    # The tokens of its window, and the next window, seen from each turn: rows run backwards, so that sums stay running ones.
    t = t.withColumn("ends", F.coalesce(F.lead("starts").over(order), F.lit(True)))
    back = Window.partitionBy("conv_id").orderBy(F.col("n").desc())
    t = t.withColumn("total", F.last(F.when(F.col("ends"), F.col("used")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumn("next", F.last(F.when(F.col("starts"), F.struct("window", "before", "total")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    allowed = F.least(F.lit(history), F.greatest(F.lit(0), budget - F.col("charged") - F.col("next.total")))

    repeats = F.col("next").isNotNull() & ~F.col("leads") & (F.col("next.before") - F.col("before") <= allowed)
    places = F.array_compact(F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("again")), F.when(repeats, F.struct(F.col("next.window").alias("w"), F.lit(True).alias("again")))))
    t = t.withColumn("place", F.explode(places))
    mark = F.concat(F.when(F.col("place.again"), AGAIN).otherwise(OPEN), F.col("n").cast("string"), F.lit(" "), escaped_role(F.col("role")), F.lit(BETWEEN))
    piece = F.struct("n", mark.alias("mark"), escaped(F.col("text")).alias("body"), ((F.col("role") == "assistant") & ~F.col("place.again")).alias("loss"))
    w = t.groupBy("conv_id", F.col("place.w").alias("window")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.first("system", ignorenulls=True).alias("system"))
    kept = F.concat(F.lit(f"{AGAIN}1 system{BETWEEN}"), escaped(F.col("system")), F.lit(CLOSE))
    head = F.when((F.col("window") > 0) & F.col("system").isNotNull(), kept).otherwise(F.lit(""))
    w = w.withColumn("head", head)
    shown = F.transform("pieces", lambda p: F.concat(p["mark"], p["body"], F.lit(CLOSE)))
    step = lambda at, p: F.struct(
        (at["at"] + F.char_length(p["mark"]) + F.char_length(p["body"]) + len(CLOSE)).cast("long").alias("at"),
        F.when(p["loss"], F.concat(at["spans"], F.array(F.struct((at["at"] + F.char_length(p["mark"])).cast("long").alias("start"), F.char_length(p["body"]).cast("long").alias("length"))))).otherwise(at["spans"]).alias("spans"),
    )
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")
    loss = F.aggregate("pieces", F.struct(F.char_length("head").cast("long").alias("at"), none.alias("spans")), step)["spans"]
    return w.select("conv_id", "window", F.concat(F.col("head"), F.concat_ws("", shown)).alias("formatted"), loss.alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """The turns that are not repeats, read back from formatted: conv_id, window, n, role, text.

    What format_windows wrote comes back exactly, with null roles and texts as empty ones; windows of any length are read
    whole. A null formatted has no turns; repeated windows are read each; an empty table gives no rows. Other columns
    are not looked at."""
    turn = rf"{OPEN}(\d+) ([^<>]*){BETWEEN}([^<]*){CLOSE}"
    parts = F.arrays_zip(*[F.regexp_extract_all("formatted", F.lit(turn), F.lit(i)).alias(k) for i, k in enumerate(("n", "role", "text"), 1)])
    read = windows.select("conv_id", "window", F.explode(parts).alias("t"))
    return read.select("conv_id", "window", F.col("t.n").cast("long").alias("n"), unescaped_role(F.col("t.role")).alias("role"), unescaped(F.col("t.text")).alias("text"))


def loss_text(formatted: Column, loss: Column) -> Column:
    """The text under the mask, unescaped."""
    parts = F.transform(loss, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.concat_ws("", parts)
