"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation becomes windows of at most ``budget`` tokens.  Prefix sums of the turns' tokens choose
turn-aligned spans: a turn belongs to the span in which its first token falls, and a turn longer than a span
begins a window of its own.  Every window shows the system turn (the first turn, if its role is system) and
up to ``history`` turns before its span, as far as their tokens fit ``history_tokens``; these repeated turns
are never under the loss mask, the assistant turns of the span itself are.

Template: ``<|start|>role`` newline ``text<|end|>`` newline.  Control strings inside texts and roles
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) get a backslash after their first
character; one that has backslashes there already gets one more, so taking one away restores every text.

Bound: system + history + span stay within ``budget`` unless one single turn is longer than a span.

Defined cases: a null or empty text is an empty turn; a null role is empty; turns of equal number are ordered
by role, then text; equal rows are turns of their own; a null turn number comes first; rows with null conv_id
are one conversation; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 2
HISTORY_TOKENS = 96

START, END = "<|start|>", "<|end|>\n"

# The control strings that are escaped, as one pattern of first character, backslashes and rest.
_CONTROL = r"(<|\[)(\\*)(\||/?s>|</?SYS>>|/?INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|</?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _one_line(role: Column) -> Column:
    """Line breaks in a role as %0A, and % as %25."""
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _lines(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def token_count(text: Column) -> Column:
    """Default measure of a turn: its words and marks, and the template's two."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + F.lit(2)


def spans(turns: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """Turns with their order, tokens, window and whether they are the system turn."""
    order = ["turn", "role", "text"]
    ordered = Window.partitionBy("conv_id").orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").orderBy("position")
    placed = turns.withColumns({"position": F.row_number().over(ordered), "tokens": token_count(F.col("text")).cast("long")})
    system = (F.col("position") == 1) & (F.col("role") == "system")
    placed = placed.withColumn("is_system", system)
    system_tokens = F.first(F.when(F.col("is_system"), F.col("tokens")).otherwise(F.lit(0))).over(ordered)
    # Two spans' worth: a span's turns start within one width and the last of them is no longer than one.
    width = F.greatest(F.lit(1), F.floor((F.lit(budget - history_tokens) - system_tokens) / 2))
    placed = placed.withColumn("width", width)
    own = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("tokens"))
    placed = placed.withColumns({"own": own, "prefix": F.coalesce(F.sum(own).over(before), F.lit(0))})
    long_turn = (~F.col("is_system")) & (F.col("own") > F.col("width"))
    placed = placed.withColumns({"long_turn": long_turn, "span": F.floor(F.col("prefix") / F.col("width"))})
    earlier = F.lag("long_turn").over(whole)
    begins = (F.col("position") == 1) | F.col("long_turn") | F.coalesce(earlier, F.lit(False)) | (F.col("span") != F.lag("span").over(whole))
    # The system turn is in all windows, so the turn after it goes on with the first one.
    begins = F.when(F.lag("is_system").over(whole), F.lit(False)).otherwise(begins)
    placed = placed.withColumn("begins", begins)
    begins_at = F.sum(F.col("begins").cast("long")).over(whole.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return placed.withColumn("window", begins_at)


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_tokens, n_turns, n_repeated (leading turns that other
    windows show first) and loss_spans (start from 0 and length, in characters of ``formatted``)."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = spans(turns, budget, history_tokens)
    whole = Window.partitionBy("conv_id").orderBy("position")
    last = F.max("window").over(Window.partitionBy("conv_id"))
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("repeated")))
    again = []
    for ahead in range(1, history + 1):
        # This turn is history of the window that the turn ``ahead`` begins, if what lies between fits.
        opened = F.lead("begins", ahead).over(whole)
        there = F.lead("window", ahead).over(whole)
        cost = F.sum("tokens").over(whole.rowsBetween(0, ahead - 1))
        again.append(F.when(opened & ~F.col("is_system") & (there != F.col("window")) & (cost <= history_tokens), there))
    placed = placed.withColumns({"last_window": last, "again": F.array_distinct(F.array(*again)) if again else F.array().cast("array<long>")})
    later = F.when(F.col("is_system"), F.sequence(F.lit(1), F.col("last_window"))).otherwise(F.array_compact("again"))
    later = F.when(F.col("is_system") & (F.col("last_window") < 1), F.array().cast("array<bigint>")).otherwise(later)
    shown = F.concat(own, F.transform(later, lambda w: F.struct(w.alias("window"), F.lit(True).alias("repeated"))))
    rows = placed.select("conv_id", "position", "role", "text", "tokens", F.explode(shown).alias("shown"))
    head = F.concat(F.lit(START), escape(_one_line(F.col("role"))), F.lit("\n"))
    body = escape(F.col("text"))
    target = (F.col("role") == "assistant") & ~F.col("shown.repeated")
    piece = F.struct(
        F.col("position"), F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"),
        target.alias("target"), F.col("shown.repeated").alias("repeated"), F.col("tokens"),
    )
    grouped = rows.groupBy("conv_id", F.col("shown.window").alias("window")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    ends = F.aggregate(
        F.col("pieces"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["target"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return grouped.select(
        "conv_id", "window",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("n_tokens"),
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["repeated"])).cast("long").alias("n_repeated"),
        ends["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Conversations from their windows: conv_id, ``turns`` (role, text) in order, each once, and ``targets``,
    the texts under the loss mask."""
    parts = F.slice(F.split(F.col("formatted"), r"<\|start\|>"), 2, 1 << 30)
    own = F.slice(parts, (F.col("n_repeated") + 1).cast("int"), F.greatest(F.lit(0), F.size(parts) - F.col("n_repeated").cast("int")))
    turn = F.transform(
        own,
        lambda p: F.struct(
            _lines(unescape(F.substring_index(p, "\n", 1))).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - F.lit(len(END)))).alias("text"),
        ),
    )
    targets = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    made = formatted.select("conv_id", F.struct("window", turn.alias("turns"), targets.alias("targets"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    grouped = made.groupBy("conv_id").agg(F.array_sort(F.collect_list("w"), lambda a, b: F.when(a["window"] < b["window"], -1).otherwise(1)).alias("w"))
    return grouped.select(
        "conv_id",
        F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda w: w["targets"])).alias("targets"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + w["chars"]).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )


def digests(conversations: DataFrame, **settings) -> DataFrame:
    """What is read back from the formatted windows, as counts and digests."""
    back = read_back(windows(conversations, **settings))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
