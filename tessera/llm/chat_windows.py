"""Chat formatting in budgeted windows, with DataFrame expressions only.

Prefix sums of turn tokens (one window sum per conversation) choose turn-aligned spans: a new
window starts at the turn whose prefix sum leaves the room for new turns.  Every window holds
the system turn (a first turn whose role is ``system``), then at most ``history_tokens`` of the
turns just before the span, then the span's own turns.  History and system turns that an
earlier window has shown are repeated without loss, so each target is learnt once.

Template: ``<|role|>\\ntext<|end|>\\n`` for every turn.  Inside roles and texts ``~ < [`` (in roles
also ``|`` and the line break) become ``~0 ~1 ~2 ~3 ~4``, so no control string of this or of bracket
templates can come from a text, and ``unescape`` gives the text back exactly.

Sizes are linear in the turns: where a turn's history would begin is a range frame over the prefix sums, the fold
that finds window starts carries numbers only, and every window takes its turns as one slice inside the conversation's row before
windows are exploded.

Defined results: null role or text counts as empty; turns are ordered by turn (null first),
then role, then text, so ties and repeated rows have one order and all stay; rows of the null
conversation are one conversation; texts of any length are taken whole, and a turn longer than the budget gets a window of its own;
a conversation with only a system turn has one window; other columns, whatever their names, are not read; an empty table gives none.
The array of a conversation's turns lives in one row, as its formatted text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

END = "<|end|>\n"
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "~3"), ("|", "~4"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ROLE_ESCAPES if role else ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ROLE_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_windows(turns: DataFrame, *, budget_tokens: int = 512, history_tokens: int = 128, turn_overhead: int = 2) -> DataFrame:
    """(conv_id, window, formatted, n_turns, n_repeated, tokens, loss_spans) for rows (conv_id, turn, role, text).

    ``loss_spans`` are (start, length) in code points of ``formatted``: the assistant texts of the
    window's own turns.  The first ``n_repeated`` turns of a window repeat earlier windows.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", word_count(F.col("text")) + turn_overhead)
    rows = rows.withColumn("p", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(order))
    # the first turn of the history that a window would have which starts here: prefix sums before the turns, at most history_tokens back
    sums = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-int(history_tokens), 0)
    rows = rows.withColumn("before", F.col("p") - F.col("n")).withColumn("h", F.min("i").over(sums))
    head = F.concat(F.lit("<|"), escape(F.col("role"), role=True), F.lit("|>\n"))
    body = escape(F.col("text"))
    turn = F.struct(
        "i", "n", "p", "h", (F.col("role") == "assistant").alias("target"), ((F.col("i") == 1) & (F.col("role") == "system")).alias("sys"),
        F.length(head).alias("hl"), F.length(body).alias("bl"), F.concat(head, body, F.lit(END)).alias("s"),
    )
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    conv = conv.withColumn("sys", F.when(F.element_at("all", 1)["sys"], 1).otherwise(0))
    conv = conv.withColumn("room", F.greatest(F.lit(1).cast("long"), budget_tokens - history_tokens - F.col("sys") * F.element_at("all", 1)["n"]))
    # numbers of the turns that windows start at; a conversation of a system turn alone has one window, after its end
    starts = F.expr(
        "aggregate(transform(slice(all, sys + 1, size(all)), t -> named_struct('i', t.i, 'n', t.n, 'p', t.p)),"
        " named_struct('base', -1L, 'starts', cast(array() as array<int>)),"
        " (a, t) -> if(a.base < 0 or (t.p - a.base > room and t.p - t.n > a.base),"
        " named_struct('base', t.p - t.n, 'starts', concat(a.starts, array(t.i))), a),"
        " a -> if(size(a.starts) = 0, array(sys + 1), a.starts))"
    )
    conv = conv.withColumn("starts", starts)
    # the system turn, then one slice from where the history begins up to the next start
    windows = F.expr(
        "transform(starts, (f, w) -> named_struct('window', w, 'first', f, 'low', greatest(sys + 1, if(f > size(all), f, element_at(all, least(f, size(all))).h)),"
        " 'next', if(w + 1 < size(starts), element_at(starts, least(w + 2, size(starts))), size(all) + 1)))"
    )
    windows = F.transform(
        windows,
        lambda w: F.struct(
            w["window"].alias("window"),
            F.concat(F.slice("all", F.lit(1), F.col("sys")), F.slice("all", w["low"], w["next"] - w["low"])).alias("turns"),
            (w["first"] - w["low"] + F.when(w["window"] > 0, F.col("sys")).otherwise(0)).alias("n_repeated"),
        ),
    )
    spans = conv.select("conv_id", F.explode(windows).alias("w")).select("conv_id", "w.window", "w.turns", "w.n_repeated")
    marks = F.expr(
        "aggregate(sequence(1, size(turns)), named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>)),"
        " (a, k) -> named_struct('at', a.at + length(turns[k - 1].s), 'spans',"
        " if(turns[k - 1].target and k > n_repeated,"
        " concat(a.spans, array(named_struct('start', a.at + turns[k - 1].hl, 'length', turns[k - 1].bl))), a.spans)),"
        " a -> a.spans)"
    )
    return spans.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("formatted"),
        F.size("turns").alias("n_turns"), "n_repeated", F.expr("aggregate(turns, 0L, (a, t) -> a + t.n)").alias("tokens"), marks.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what ``format_windows`` wrote, taken from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def turn_text(piece: Column) -> Column:
        cut = F.instr(piece, "|>\n")
        role = F.substr(piece, F.lit(3), cut - 3)
        return F.concat(unescape(role), F.lit("\n"), unescape(F.substr(piece, cut + 3)), F.lit("\n"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    parts = windows.select(
        "conv_id", "window", F.size(own).cast("long").alias("n"), F.array_join(F.transform(own, turn_text), "").alias("said"),
        F.array_join(loss, "").alias("learnt"), F.length("formatted").cast("long").alias("chars"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "said", "learnt"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    )
    said = F.array_join(F.transform("w", lambda x: x["said"]), "")
    learnt = F.array_join(F.transform("w", lambda x: x["learnt"]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )
