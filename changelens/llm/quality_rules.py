"""Quality rules: a learned decision list over text statistics.

Statistics of every whole text come from one Arrow pass.  On a bounded sample of labelled documents
(``SAMPLE_ROWS``) that pass the base rule, sequential covering learns rules for the bad ones: a rule is grown by adding the threshold
condition of the highest information gain until it covers no good example, pruned on held-back examples, and
kept if it is precise enough there; what it covers is set aside and the next rule is learned.  The list then
runs over all documents as one ordered Spark conditional expression.

A document is bad if its label says low quality or toxic.  Words (and word beginnings) that mark labelled
toxic documents are found by document counts in the same sample, and their number in a text is a statistic.

Defined cases: a null or empty text has no words and fails the base rule; without labels the list is empty
and the base rule decides; null labels count as good; labels without a document are ignored; rows of one
doc_id are each judged; other columns are ignored by ``judge`` and kept by ``drop_rejected``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.bitmap import row_id, without
from changelens.llm.common import bounded_sample, pieces, raw_texts, starts_of
from changelens.scratch import settle

SAMPLE_ROWS = 8_000
FLAG_WORDS = 2_000
WINDOW = 5

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(0x41, 0x5B))
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")
_BEGINNINGS = (4, 5, 6)

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_distinct_words", "n_marks", "n_flagged"]
#: What rules may test: statistics as shares of the text's size, so that long and short texts compare.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_count": "n_dup_lines",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "capital_share": "n_capitals / greatest(word_chars, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "flagged_share": "n_flagged / greatest(n_words, 1)",
}


def _count(text: bytes, wanted: bytes) -> int:
    return len(text) - len(text.translate(None, wanted))


def _repeat_words(ids: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """For each text of a shard, its words inside windows of ``WINDOW`` words found twice or more in it."""
    found = np.zeros(size, np.int64)
    count = len(ids) - WINDOW + 1
    if count <= 0:
        return found
    # Number windows exactly by pairing: (1 word, 1 word) -> 2 -> 4 -> 5, each pair renumbered densely.
    same = owner[:count] == owner[WINDOW - 1 :]
    code = ids.astype(np.int64)
    for shift, other in ((1, None), (2, None), (4, ids)):
        left = code[: len(code) - shift] if other is None else code
        right = code[shift:] if other is None else ids[shift : shift + len(code)]
        left = left[: len(right)]
        _, code = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
    at = np.flatnonzero(same)
    key = code[at] * size + owner[at]
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = at[times[inverse] > 1]
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, hit, 1)
    np.subtract.at(depth, hit + WINDOW, 1)
    np.add.at(found, owner[np.cumsum(depth)[:-1] > 0], 1)
    return found


def _statistics(batches: Iterator[pa.RecordBatch], flagged: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = raw_texts(batch.column("text"))
        words = [text.split() for text in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        numbers: dict[bytes, int] = {}
        ids = np.empty(int(lengths.sum()), np.int64)
        distinct = []
        for start, own in zip(starts_of(lengths).tolist(), words):
            ids[start : start + len(own)] = [numbers.setdefault(w, len(numbers)) for w in own]
            distinct.append(len(set(own)))
        flags = np.zeros(len(numbers) + 1, np.int64)
        if flagged:
            flags[:-1] = [any(p in flagged for p in parts_of(w)) for w in numbers]
        owner = np.repeat(np.arange(len(words)), lengths)
        columns: dict[str, object] = {"n_words": lengths}
        text_points = [len(t) - _count(t, bytes(range(0x80, 0xC0))) for t in texts]
        columns["word_chars"] = [n - _count(t, b" \t\n\v\f\r") for n, t in zip(text_points, texts)]
        columns["n_symbols"] = [_count(t, _SYMBOLS) for t in texts]
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
        columns["n_dup_lines"] = [len(x) - len(set(x)) for x in lines]
        columns["n_repeat_words"] = _repeat_words(ids, owner, len(words))
        columns["n_capitals"] = [_count(t, _CAPITALS) for t in texts]
        columns["n_distinct_words"] = distinct
        columns["n_marks"] = [_count(t, b"!?") for t in texts]
        columns["n_flagged"] = np.bincount(owner, flags[ids], minlength=len(words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(columns[c], pa.int64()) for c in STATISTICS)], ["doc_id", *STATISTICS])


def statistics(docs: DataFrame, flagged: frozenset[bytes] = frozenset()) -> DataFrame:
    """The counts in ``STATISTICS`` for every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(flagged)
    schema = ", ".join([f"doc_id {kind}", *(f"{c} long" for c in STATISTICS)])
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _statistics(batches, sent.value), schema)


def parts_of(word: bytes) -> list[bytes]:
    """A word without its marks, whole (ended by a dot) and as beginnings of a few lengths."""
    made = []
    for own in _LETTERS.findall(word.lower()):
        made += [own + b".", *(own[:n] for n in _BEGINNINGS if len(own) > n)]
    return made


def labelled(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A bounded sample of labels: ``label_id``, and whether the document is ``bad`` or ``toxic``."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 0, F.lit(False))).alias("poor"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    return bounded_sample(known, "doc_id", rows).select(F.col("doc_id").alias("label_id"), (F.col("poor") | F.col("toxic")).alias("bad"), "toxic")


def sample_texts(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The sampled documents, settled: doc_id, text, bad, toxic.  At most ``rows`` labels are broadcast."""
    chosen = labelled(labels, rows)
    return settle(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).drop("label_id"))


def flag_words(sample: DataFrame, least: int = 5, odds: float = 50.0, shared: float = 1.0, limit: int = FLAG_WORDS) -> frozenset[bytes]:
    """Words and beginnings found in at least ``least`` toxic documents of the sample and hardly any others.
    A whole word that others have too needs ``shared`` times the evidence.

    The report is a top list by document count; its length bounds what is sent to the tasks."""

    def run(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_pylist()
            found = [sorted({p for w in set(t.split()) for p in parts_of(w)}) for t in raw_texts(batch.column("text"))]
            flat = [p for x in found for p in x]
            mark = [t for x, t in zip(found, toxic) for _ in x]
            for low in range(0, len(flat), 100_000):
                part = slice(low, low + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(flat[part], pa.binary()), pa.array(mark[part], pa.bool_())], ["part", "toxic"])

    counted = sample.select("text", "toxic").mapInArrow(run, "part binary, toxic boolean").groupBy("part")
    counted = counted.agg(F.count_if("toxic").alias("ours"), F.count_if(~F.col("toxic")).alias("theirs"))
    sizes = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    weight = (sizes[1] + 1) / (sizes[0] + 1)
    whole = F.col("part").cast("string").endswith(".") & (F.col("theirs") > 0)
    asked = F.when(whole, shared * odds).otherwise(odds) * (F.col("theirs") + 0.5)
    ranked = counted.filter((F.col("ours") >= least) & (F.col("ours") * weight >= asked))
    return frozenset(bytes(r["part"]) for r in ranked.orderBy(F.desc("ours"), "part").limit(limit).collect())


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray], size: int) -> np.ndarray:
    found = np.ones(size, bool)
    for condition in rule:
        found &= condition.holds(values)
    return found


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    inside, rule = np.ones(len(bad), bool), ()
    while len(rule) < longest and bad[inside].any() and not bad[inside].all():
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, chosen = 0.0, None
        for feature, column in values.items():
            own, label = column[inside], bad[inside]
            order = np.argsort(own, kind="stable")
            own, label = own[order], label[order]
            cut = np.flatnonzero(own[1:] > own[:-1]) + 1
            if not len(cut):
                continue
            hits = np.cumsum(label)
            for above in (True, False):
                tp = (p - hits[cut - 1]) if above else hits[cut - 1]
                fp = (len(own) - cut - tp) if above else (cut - tp)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(tp > 0, tp * (np.log2(tp / (tp + fp)) - np.log2(p / (p + n))), 0.0)
                at = int(np.argmax(gain))
                if gain[at] > best + 1e-9:
                    best, chosen = float(gain[at]), Condition(feature, above, float((own[cut[at] - 1] + own[cut[at]]) / 2))
        if chosen is None:
            break
        rule += (chosen,)
        inside &= chosen.holds(values)
    return rule


def _worth(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    inside = _covers(rule, values, len(bad))
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(values: dict[str, np.ndarray], bad: np.ndarray, longest: int = 4, rules: int = 16, precision: float = 0.97, least: int = 3) -> list[Rule]:
    """Ordered rules for the bad examples.  Every third example is held back for pruning."""
    left = np.ones(len(bad), bool)
    held = np.arange(len(bad)) % 3 == 2
    found: list[Rule] = []
    for _ in range(4 * rules):
        if len(found) >= rules or not bad[left & ~held].any():
            break
        part = lambda mask: ({k: v[mask] for k, v in values.items()}, bad[mask])
        rule = _grow(*part(left & ~held), longest)
        options = [rule[:k] for k in range(1, len(rule) + 1)]
        if not options:
            break
        rule = max(options, key=lambda r: _worth(r, *part(left & held))[0] if bad[left & held].any() else len(r))
        _, p, n = _worth(rule, *part(left))
        inside = left & _covers(rule, values, len(bad))
        if p < least or p < precision * (p + n):
            # Not precise enough: the bad examples behind it are set aside, the good ones stay as a warning.
            inside &= bad
        else:
            found.append(rule)
        if not inside.any():
            break
        left &= ~inside
    return found


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def expression(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), else 0: one ordered conditional expression."""
    made = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        made = F.when(F.expr(" AND ".join(c.sql() for c in rule)), F.lit(number)).otherwise(made)
    return made


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[Rule], frozenset[bytes]]:
    """Rules and flagged words from at most ``sample_rows`` labelled documents."""
    sample = sample_texts(docs, labels, sample_rows)
    flagged = flag_words(sample)
    marks = sample.select("doc_id", "bad").distinct()
    measured = statistics(sample, flagged).join(F.broadcast(marks.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))
    measured = measured.filter(f"NOT ({BASE_FAILED})")
    rows = measured.select("doc_id", "bad", *(F.expr(f"CAST({x} AS double)").alias(k) for k, x in FEATURES.items())).orderBy(F.xxhash64("doc_id"), *FEATURES).limit(sample_rows).collect()
    values = {k: np.array([r[k] for r in rows], float) for k in FEATURES}
    return learn(values, np.array([r["bad"] for r in rows], bool)), flagged


def _judged(docs: DataFrame, rules: list[Rule], flagged: frozenset[bytes]) -> DataFrame:
    measured = statistics(docs, flagged)
    judged = measured.withColumns({"base_failed": F.expr(BASE_FAILED), "rule": expression(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, the statistics, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    return _judged(docs, *fit(docs, labels, sample_rows))


def drop_rejected(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, each judged by its own text; all columns stay."""
    judged = _judged(docs.select(row_id().alias("doc_id"), "text"), *fit(docs, labels, sample_rows))
    return without(docs, settle(judged.filter("NOT kept").select("doc_id").distinct()), row_id())
