"""Chat formatting in budgeted windows. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.native import once, running

#: Characters of which marks are made, and what stands for them in roles and texts: & first, and decoded last.
ESCAPES = {"&": "&amp;", "<": "&lt;", "[": "&#91;", "]": "&#93;"}
BOS, EOS = "<s>", "</s>"
#: Marks of a turn that is new in its window, of one repeated as history, and of the system turn kept.
NEW, PAST, KEPT = "TURN", "PAST", "KEPT"
TURN = r"\[TURN:([^\]]*)\]([^<]*)</s>"


def escape(text: Column) -> Column:
    for mark, code in ESCAPES.items():
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for mark, code in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def _marked(kind: str, role: Column) -> Column:
    return F.concat(F.lit(f"[{kind}:"), role, F.lit("]"))


def _array(items: Column, start: Column, end: Column) -> Column:
    """items[start:end], counted from 0."""
    return F.slice(items, start + 1, F.greatest(F.lit(0), end - start))


def _starts(n: Column, room: Column, budget: int) -> Column:
    """Where windows start: at turn 0, and at each turn that ends after `upto`, where the last one is full. Turns are
    walked in steps of 256, as adding to an array copies it."""
    found = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(budget - 1).cast("long").alias("upto"))

    def walk(upto: Column, turns: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            full = (F.get("sums", i + 1) > acc["upto"]) & (i > 0)
            starts = F.when(full | (i == 0), F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"])
            return F.struct(starts.alias("starts"), F.when(full, F.get("sums", i) + room).otherwise(acc["upto"]).cast("long").alias("upto"))

        return F.aggregate(turns, F.struct(F.array().cast("array<int>").alias("starts"), upto.alias("upto")), step)

    steps = F.transform(F.sequence(F.lit(0), ((n - 1) / 256).cast("int")), lambda k: F.sequence(k * 256, F.least(k * 256 + 255, n - 1)))
    state = F.struct(F.array().cast("array<array<int>>").alias("done"), found.alias("last"))
    over = lambda acc, turns: F.struct(F.concat(acc["done"], F.array(acc["last"]["starts"])).alias("done"), walk(acc["last"]["upto"], turns).alias("last"))
    return F.aggregate(steps, state, over, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]["starts"]))))


def format_windows(rows: DataFrame, budget: int = 2048, history: int = 512) -> DataFrame:
    """Conversations as training windows: (conv_id, window, formatted, loss_spans, n_tokens).

    A window is `<s>`, then turns `[TURN:role]text</s>`. Roles and texts are escaped (& < [ ]), so that no text can
    look like a mark, and parsing gives them back exactly. A token is four characters begun, of a turn with its marks and
    of `<s>`; n_tokens are those of the window. Prefix sums of the turns' tokens choose the windows: each goes on from
    where the last one ended with as many whole turns as fit; none is cut. A window after the first starts with the
    system turn, if the conversation starts with one (marked KEPT), and repeats as many of the turns just before it as fit
    in `history` (marked PAST); room for both is kept free. A system turn that leaves no room beside the history isn't
    repeated. A turn that doesn't fit into that room has a window of its own, with as much of the system turn and the
    history as the budget still allows: none of either if the turn alone exceeds it, and only such a window does.
    loss_spans are the (start, end) of assistant texts in the window, in code points; repeated turns aren't in them, so
    that each assistant text is a target once.

    Turns are ordered by turn, and, where that ties, by role and text; a null turn comes first. A null text or role is
    empty, a null conv_id a conversation of its own. Repeated rows are turns each. Other columns aren't read. A
    conversation is one sequence and is gathered as one row; only its own length bounds it. Each window is built from its
    own turns.
    """
    if not 0 <= history < budget - 1:
        raise ValueError("the history has to leave room in the budget")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def cost(x: Column) -> Column:
        role, text = escape(x["role"]), escape(x["text"])
        chars = F.length(_marked(NEW, role)) + F.length(text) + len(EOS)
        return F.struct(role.alias("role"), text.alias("text"), (x["role"] == "assistant").alias("target"), F.ceil(chars / 4).cast("long").alias("cost"))

    convs = convs.select("conv_id", F.transform("turns", cost).alias("turns"))
    convs = convs.select("conv_id", "turns", running(F.transform("turns", lambda x: x["cost"])).alias("sums"), F.size("turns").alias("n"))
    own = F.when(F.get("turns", F.lit(0))["role"] == "system", F.get("turns", F.lit(0))["cost"])
    convs = convs.withColumn("system", F.when(own < budget - 1 - history, own))  # null: there is none to keep
    convs = convs.withColumn("skipped", F.when(own.isNotNull(), 1).otherwise(0)).withColumn("starts", _starts(F.col("n"), F.lit(budget - 1 - history) - F.coalesce("system", F.lit(0)), budget))

    def part(kind: str) -> Callable[[Column], Column]:
        return lambda x: F.concat(_marked(kind, x["role"]), x["text"], F.lit(EOS))

    def window(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.col("n"))
        new = F.get("sums", end) - F.get("sums", at)
        keep = (at > 0) & F.coalesce(F.col("system") + new < budget, F.lit(False))
        kept = F.when(keep, F.col("system")).otherwise(0)
        room = F.greatest(F.lit(0), F.least(F.lit(history), budget - 1 - new - kept))
        back = F.least(at, F.greatest(F.col("skipped"), at - history // 3))  # each turn costs three tokens or more
        past = F.array_min(F.filter(F.sequence(back, at), lambda j: F.get("sums", at) - F.get("sums", j) <= room))
        head = F.concat(
            F.lit(BOS),
            F.when(keep, part(KEPT)(F.get("turns", F.lit(0)))).otherwise(F.lit("")),
            F.array_join(F.transform(_array(F.col("turns"), past, at), part(PAST)), ""),
        )
        return F.struct(k.alias("window"), head.alias("head"), _array(F.col("turns"), at, end).alias("new"), (1 + kept + F.get("sums", end) - F.get("sums", past)).cast("long").alias("n_tokens"))

    cut = convs.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    ends = running(F.transform("new", lambda x: F.length(part(NEW)(x)).cast("long")))

    def spans(at: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            begin = F.length("head") + F.get(at, i) + F.length(_marked(NEW, x["role"]))
            return F.when(x["target"], F.struct(begin.cast("long").alias("start"), (begin + F.length(x["text"])).cast("long").alias("end")))

        return F.filter(F.transform("new", span), lambda x: x.isNotNull())

    formatted = F.concat("head", F.array_join(F.transform("new", part(NEW)), ""))
    return cut.select("conv_id", "window", formatted.alias("formatted"), once(ends, spans).alias("loss_spans"), "n_tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) from the output of format_windows alone: turns are the (role, text) that
    are new in their windows; loss is all text under the mask."""

    def targets(w: Column) -> Column:
        return F.transform(w["loss_spans"], lambda s: F.substring(w["formatted"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    one = F.struct("window", "formatted", "loss_spans")
    held = windows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("w"))
    part = lambda group: F.flatten(F.transform("w", lambda w: F.regexp_extract_all(w["formatted"], F.lit(TURN), F.lit(group))))
    turns = F.zip_with(part(1), part(2), lambda role, text: F.struct(unescape(role).alias("role"), unescape(text).alias("text")))
    loss = unescape(F.array_join(F.flatten(F.transform("w", targets)), ""))
    chars = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.length(w["formatted"]))
    return held.select("conv_id", turns.alias("turns"), loss.alias("loss"), chars.alias("formatted_chars"))
