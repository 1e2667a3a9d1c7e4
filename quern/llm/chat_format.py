r"""Chat formatting into budgeted, turn-aligned windows, in DataFrame operations only.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts and roles
every ``<|`` gets a backslash between its characters (and ``<\|`` one more, and so
on), so control strings appear only where a turn begins or ends, and the change
can be undone exactly. Roles also have ``%`` and line feeds percent-encoded.

Windows: a target turn and the turns since the last target before it are an
exchange, which stays together where the budget less the system turn (the room)
holds it; turns after the last target go with it. Of a longer exchange the turns
next to its target stay with it as far as there is room, and the others stand alone. So a
question is in the window of its answer, and a window has no target only
if its turns fit beside none.

An exchange of more than half the room has a window of its own. Between such, the
running sum of turn tokens puts an exchange into the span ``start // stride``; the stride
is the room less the longest of the conversation's other exchanges, so that a span
never passes the budget by ending within one, and is at least half the
room. The first turn, if its role is ``system``, opens every window. What the
budget leaves is filled with the turns just before, up to ``history`` tokens. Only
assistant texts of the window itself are under the loss mask; repeated ones are
not, so each is a target exactly once.

Every window but the last of a run has a stride of tokens or belongs to an exchange of half the
room, so the repeated turns are at most about 2 x history / stride times the
turns' tokens, and a system turn a window. A turn is never cut: if the system turn
and one turn pass the budget alone, their window has ``over_budget``. Windows are
bounded by the budget or one turn.

Defined results: null role and text count as empty; a null conversation id is a
conversation of its own; turns are ordered by (turn, role, MD5 of the
text), nulls first, and repeated rows are repeated turns; an empty table gives no
windows; texts of any length are kept whole; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def quarter_chars(piece: Column) -> Column:
    """Tokens of a formatted turn, estimated at four characters each."""
    return F.ceil(F.char_length(piece) / 4).cast("long")


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 512, target_role: str = "assistant", tokens: Callable[[Column], Column] = quarter_chars) -> DataFrame:
    """conv_id, window, text, loss_spans (code points, end exclusive), repeated (leading turns), n_tokens, over_budget."""
    # ck and tk: the conversation and the turn as join keys that null has a value of, too.
    rows = turns.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("ck"),
        "turn",
        F.coalesce(F.col("turn").cast("string"), F.lit("n")).alias("tk"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("raw"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("piece", F.concat("head", escape(F.col("raw")), F.lit(END + "\n"))).withColumn("h", F.md5("raw"))
    # The plan is made from lengths alone; texts join it when it is done.
    plan = rows.select("conv_id", "ck", "turn", "tk", "role", "h", F.char_length("head").alias("lo"), F.char_length("piece").alias("size"), tokens(F.col("piece")).alias("tok"))
    by, whole = Window.partitionBy("ck").orderBy("turn", "role", "h"), Window.partitionBy("ck")
    until, prior = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("nth", F.row_number().over(by))
    plan = plan.withColumn("is_system", (F.col("nth") == 1) & (F.col("role") == "system"))
    own, target = ~F.col("is_system"), ~F.col("is_system") & (F.col("role") == target_role)
    plan = plan.withColumn("sys", F.coalesce(F.max(F.when(F.col("is_system"), F.col("tok"))).over(whole), F.lit(0))).withColumn("room", F.greatest(F.lit(1), F.lit(budget) - F.col("sys")))
    plan = plan.withColumn("size_of", F.when(own, F.col("tok")).otherwise(F.lit(0))).withColumn("to", F.sum("size_of").over(until)).withColumn("from", F.col("to") - F.col("size_of"))
    # Exchanges, numbered by the targets before; the turns after the last target belong to its exchange.
    plan = plan.withColumn("exchange", F.least(F.coalesce(F.count_if(target).over(prior), F.lit(0)), F.count_if(target).over(whole) - 1))
    inside = Window.partitionBy("ck", "exchange")
    plan = plan.withColumn("t_to", F.max(F.when(target, F.col("to"))).over(inside))
    ahead = own & (F.col("to") < F.col("t_to")) & (F.col("t_to") - F.col("from") <= F.col("room"))
    plan = plan.withColumn("begin", F.min(F.when(target | ahead, F.col("from"))).over(inside))
    behind = own & (F.col("to") > F.col("t_to")) & (F.col("to") - F.col("begin") <= F.col("room"))
    plan = plan.withColumn("joined", F.coalesce(target | ahead | behind, F.lit(False)))
    # Items: what is joined in an exchange, or one turn.
    follows = F.coalesce(F.lag("joined").over(by) & (F.lag("exchange").over(by) == F.col("exchange")), F.lit(False))
    plan = plan.withColumn("begins", own & ~(F.col("joined") & follows)).withColumn("item", F.sum(F.col("begins").cast("int")).over(until))
    of_item = Window.partitionBy("ck", "item")
    plan = plan.withColumn("item_tok", F.sum("size_of").over(of_item)).withColumn("is_long", own & (F.col("item_tok") > F.floor(F.col("room") / 2)))
    plan = plan.withColumn("stride", F.greatest(F.lit(1), F.col("room") - F.coalesce(F.max(F.when(own & ~F.col("is_long"), F.col("item_tok"))).over(whole), F.lit(0))))
    # Segments, in order: odd ones are a long item each, even ones the items between two of them. A system turn goes with the next turn.
    seg = 2 * F.sum((F.col("is_long") & F.col("begins")).cast("int")).over(until) - F.col("is_long").cast("int")
    plan = plan.withColumn("seg", seg).withColumn("seg", F.when(F.col("is_system"), F.coalesce(F.lead("seg").over(by), F.lit(0))).otherwise(F.col("seg")))
    first_of = lambda keys: F.min(F.when(own, F.col("from"))).over(Window.partitionBy("ck", *keys))
    start = F.coalesce(first_of(["item"]) - first_of(["seg"]), F.lit(0))
    plan = plan.withColumn("span", F.when(F.col("is_system"), F.lit(0)).otherwise(F.floor(start / F.col("stride"))).cast("long"))
    plan = cut(plan.select("conv_id", "ck", "tk", "role", "h", "lo", "size", "tok", "nth", "is_system", "sys", "from", "to", "seg", "span"))  # used four times below; a row of it is some numbers and keys

    own = ~F.col("is_system")
    spans = plan.groupBy("ck", "seg", "span").agg(F.coalesce(F.min(F.when(own, F.col("from"))), F.lit(0)).alias("first"), F.coalesce(F.max(F.when(own, F.col("to"))), F.lit(0)).alias("last"), F.max("sys").alias("sys"), F.max("is_system").alias("has_system"))
    spans = spans.withColumn("room", F.least(F.lit(history), F.lit(budget) - F.col("sys") - (F.col("last") - F.col("first"))))
    spans = spans.withColumn("window", F.row_number().over(Window.partitionBy("ck").orderBy("seg", "span")) - 1)
    kept = ["conv_id", "ck", "tk", "role", "h", "nth", "lo", "size", "tok", "window"]
    new = plan.join(spans.select("ck", "seg", "span", "window"), ["ck", "seg", "span"]).select(*kept, F.lit(2).alias("part"))
    # A turn is history of windows that begin at most `history` tokens after it began; both meet in stretches of that many tokens.
    width = max(1, history)
    looks_at = F.explode(F.sequence(F.floor((F.col("first") - F.col("room")) / width), F.floor(F.col("first") / width)))
    back = spans.where("room > 0 and first > 0").select("ck", "window", "first", "room", looks_at.alias("stretch"))
    past = plan.where(own).withColumn("stretch", F.floor(F.col("from") / width)).join(back, ["ck", "stretch"]).where("from >= first - room and to <= first").select(*kept, F.lit(1).alias("part"))
    opening = plan.where("is_system").join(spans.where("not has_system").select("ck", "window"), "ck").select(*kept, F.lit(0).alias("part"))

    before = Window.partitionBy("ck", "window").orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    parts = new.unionByName(past).unionByName(opening).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # Repeated rows have one text; its numbering leaves the rows in place and order for the join.
    key = ["ck", "tk", "role", "h"]
    texts = rows.select(*key, "piece").withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))).where("copy = 1").drop("copy")
    piece = F.struct("part", "nth", "piece", (F.col("at") + F.col("lo")).alias("start"), (F.col("at") + F.col("size") - len(END) - 1).alias("end"), (F.col("role") == target_role).alias("target"))
    got = parts.join(texts, key).groupBy("ck", "window").agg(F.max("conv_id").alias("conv_id"), F.sort_array(F.collect_list(piece)).alias("p"), F.sum("tok").alias("n_tokens"))
    return got.select(
        "conv_id",
        "window",
        F.array_join(F.col("p.piece"), "").alias("text"),
        F.transform(F.filter("p", lambda x: (x["part"] == 2) & x["target"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
        F.size(F.filter("p", lambda x: x["part"] < 2)).alias("repeated"),
        "n_tokens",
        (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_turns(text: Column) -> Column:
    """Array of (role, text) as a window's text has them, repeated turns included."""
    cut = F.split(text, r"<\|im_end\|>\n")
    bodies = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda s: F.substr(s, F.lit(len(START) + 1)))
    role = lambda s: F.substring_index(s, "\n", 1)
    return F.transform(bodies, lambda s: F.struct(unescape_role(role(s)).alias("role"), unescape(F.substr(s, F.char_length(role(s)) + 2)).alias("text")))


def read_targets(text: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(loss_spans, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def digest(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say, read back from their texts and masks."""
    turns = F.slice("turns", F.col("repeated") + 1, F.size("turns"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = windows.withColumn("turns", read_turns(F.col("text"))).select(
        "conv_id",
        "window",
        lines.alias("lines"),
        F.array_join(read_targets(F.col("text"), F.col("loss_spans")), "").alias("loss"),
        F.size(turns).cast("long").alias("n"),
        F.char_length("text").cast("long").alias("chars"),
    )
    whole = per.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "lines", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    loss = F.array_join(F.col("w.loss"), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("w.lines"), ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
