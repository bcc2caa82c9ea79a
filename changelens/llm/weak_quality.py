"""Quality classifier from weak labels.

Overlapping heuristic labellers look at every whole text and vote bad, good or nothing.  Each document thereby
has a vote pattern; their counts over the whole table, at most 3 ** labellers rows, are all that
expectation-maximisation needs to estimate how often each labeller casts each vote on good and on bad documents,
and with that the posterior of every pattern.  The posteriors then train a hashed linear scorer (logistic, on
hashed words, word beginnings and bins of the statistics) on a bounded sample, ``SAMPLE_ROWS``; it scores all
documents.

One labeller knows words that mark toxic documents, learned from at most ``LABEL_ROWS`` labelled documents.

Defined cases: a null or empty text has no words and only the labeller for short texts votes; without labels
the toxic labeller never votes; an empty table gives an empty result; equal texts get equal scores; rows of
one doc_id are each judged; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import bounded_sample, pieces, raw_texts
from changelens.llm.quality_rules import flag_words, parts_of, sample_texts
from changelens.scratch import settle

SAMPLE_ROWS = 6_000
LABEL_ROWS = 8_000
BUCKETS = 1 << 18
EPOCHS = 6

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(0x41, 0x5B))


def _share(value: np.ndarray, of: np.ndarray) -> np.ndarray:
    return value / np.maximum(of, 1)


#: name: (votes bad, votes good), each from the statistics.
LABELLERS = {
    "short": (lambda s: s["n_words"] < 1, lambda s: s["n_words"] < 0),
    "symbols": (lambda s: _share(s["symbols"], s["chars"]) > 0.08, lambda s: s["n_words"] < 0),
    "capitals": (lambda s: _share(s["capitals"], s["chars"]) > 0.3, lambda s: s["n_words"] < 0),
    "marks": (lambda s: _share(s["marks"], s["n_words"]) > 0.3, lambda s: s["n_words"] < 0),
    "monotone": (lambda s: (s["n_words"] >= 10) & (_share(s["distinct"], s["n_words"]) < 0.25 * np.minimum(1, 200 / np.maximum(s["n_words"], 1)) ** 0.5), lambda s: s["n_words"] < 0),
    "lines": (lambda s: s["dup_lines"] >= 3, lambda s: s["n_words"] < 0),
    "toxic": (lambda s: (s["flagged"] >= 2) | ((s["flagged"] == 1) & (s["n_words"] < 60)), lambda s: s["n_words"] < 0),
    "plain": (lambda s: s["n_words"] < 0, lambda s: (s["n_words"] >= 1) & (_share(s["symbols"], s["chars"]) < 0.02) & (_share(s["capitals"], s["chars"]) < 0.25) & (s["flagged"] <= 1)),
    "varied": (lambda s: s["n_words"] < 0, lambda s: (s["n_words"] >= 1) & (_share(s["distinct"], s["n_words"]) > 0.35 * np.minimum(1, 200 / np.maximum(s["n_words"], 1)) ** 0.5)),
}

#: Statistics whose bins are features of the scorer, with the edges of the bins.
_BINS = {
    "symbols": ("chars", [0.005, 0.02, 0.05, 0.1, 0.2]),
    "capitals": ("chars", [0.02, 0.05, 0.1, 0.2, 0.4]),
    "marks": ("n_words", [0.02, 0.1, 0.3, 0.6]),
    "distinct": ("n_words", [0.05, 0.1, 0.2, 0.3, 0.5, 0.8]),
    "flagged": ("one", [0.5, 1.5, 3.5]),
    "dup_lines": ("one", [0.5, 2.5]),
    "n_words": ("one", [9.5, 29.5, 99.5]),
}


@dataclass
class Slice:
    """Statistics of some texts, and for each the hashed features of its words."""

    statistics: dict[str, np.ndarray]
    features: list[np.ndarray] | None

    def votes(self) -> np.ndarray:
        cast = [np.where(bad(self.statistics), 0, np.where(good(self.statistics), 2, 1)) for bad, good in LABELLERS.values()]
        return np.array(cast, np.int64)

    def bins(self) -> np.ndarray:
        """Hashed bin of each binned statistic, one row for each."""
        made = []
        for name, (of, edges) in _BINS.items():
            names = np.array([zlib.crc32(f"bin {name} {k}".encode()) % BUCKETS for k in range(len(edges) + 1)], np.int64)
            value = self.statistics[name] if of == "one" else _share(self.statistics[name], self.statistics[of])
            made.append(names[np.searchsorted(edges, value)])
        return np.array(made)


class _Runs:
    """Runs of values, one after the other; ``ends`` tells where each stops."""

    def __init__(self, values: np.ndarray, ends: np.ndarray):
        self.values, self.starts = values, np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.lengths = ends - self.starts

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The values of some runs."""
        lengths = self.lengths[numbers]
        behind = np.cumsum(lengths)
        inside = np.arange(behind[-1] if len(behind) else 0) - np.repeat(behind - lengths, lengths)
        return self.values[np.repeat(self.starts[numbers], lengths) + inside]


def _measure(texts: list[bytes], flagged: frozenset[bytes], with_features: bool) -> Slice:
    words = [text.split() for text in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    numbers: dict[bytes, int] = {}
    own_ids = []
    for own in words:
        own_ids.append(np.unique(np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64)))
    # A marked word weighs two, a word that only begins like marked ones weighs one.
    flags = np.zeros(len(numbers) + 1, np.int64)
    hashed: list[int] = []
    ends = np.zeros(len(numbers) + 1, np.int64)
    for k, word in enumerate(numbers):
        found = parts_of(word)
        flags[k] = max((1 + p.endswith(b".") for p in found if p in flagged), default=0)
        if with_features:
            hashed += [zlib.crc32(p) % BUCKETS for p in found or [word]]
            ends[k] = len(hashed)
    runs = _Runs(np.array(hashed, np.int64), ends[:-1])
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    count = lambda wanted: np.array([len(t) - len(t.translate(None, wanted)) for t in texts], np.int64)
    statistics = {
        "n_words": lengths,
        "chars": np.array([sum(map(len, own)) for own in words], np.int64),
        "symbols": count(_SYMBOLS),
        "capitals": count(_CAPITALS),
        "marks": count(b"!?"),
        "distinct": np.array([len(x) for x in own_ids], np.int64),
        "dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "flagged": np.array([int(flags[x].sum()) for x in own_ids], np.int64),
    }
    return Slice(statistics, [np.unique(runs.of(x)) for x in own_ids] if with_features else None)


def vote_patterns(docs: DataFrame, flagged: frozenset[bytes]) -> DataFrame:
    """doc_id and the votes of all labellers as one number in base 3 (0 bad, 1 none, 2 good)."""
    sent = docs.sparkSession.sparkContext.broadcast(flagged)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        weights = 3 ** np.arange(len(LABELLERS))
        for batch in pieces(batches, "text"):
            votes = _measure(raw_texts(batch.column("text")), sent.value, False).votes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weights @ votes)], ["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, pattern long")


@dataclass
class LabelModel:
    """Posterior of being good for each pattern; P(vote | bad) and P(vote | good) of each labeller."""

    posterior: dict[int, float]
    votes: np.ndarray

    def accuracy(self) -> dict[str, float]:
        """Share of right ones among a labeller's votes, both kinds of document being equally frequent."""
        bad, good = self.votes[:, 0], self.votes[:, 1]
        cast = bad[:, 0] + bad[:, 2] + good[:, 0] + good[:, 2]
        return dict(zip(LABELLERS, ((bad[:, 0] + good[:, 2]) / np.maximum(cast, 1e-12)).tolist()))


def estimate(patterns: dict[int, int], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over counted patterns."""
    keys = np.array(sorted(patterns), np.int64)
    times = np.array([patterns[k] for k in keys.tolist()], float)
    votes = (keys[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    one_hot = (votes[:, :, None] == np.arange(3)).astype(float)
    good = np.where((votes == 0).any(axis=1), 0.05, 0.95)
    table = np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * times, good * times])
        table = np.einsum("yk,kjv->jyv", weight, one_hot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (times.sum() + 2)
        logs = np.log(prior) + np.einsum("kjv,jyv->ky", one_hot, np.log(table))
        good = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
    return LabelModel(dict(zip(keys.tolist(), good.tolist())), table)


@dataclass
class HashedScorer:
    weights: np.ndarray
    bias: float

    def logits(self, own: Slice) -> np.ndarray:
        bins = self.weights[own.bins()].sum(axis=0)
        words = np.array([self.weights[x].sum() / np.sqrt(len(x)) if len(x) else 0.0 for x in own.features])
        return bins + words + self.bias


def train(features: list[np.ndarray], bins: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, batch: int = 256) -> HashedScorer:
    """Logistic regression towards posteriors with per-weight step sizes; the order of examples is fixed."""
    weights, squares, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0
    scale = [1 / np.sqrt(max(len(x), 1)) for x in features]
    order = np.random.default_rng(0).permutation(len(features))
    for _ in range(epochs):
        for low in range(0, len(order), batch):
            part = order[low : low + batch]
            index = np.concatenate([np.concatenate([features[i], bins[i]]) for i in part])
            value = np.concatenate([np.concatenate([np.full(len(features[i]), scale[i]), np.ones(len(bins[i]))]) for i in part])
            owner = np.repeat(np.arange(len(part)), [len(features[i]) + len(bins[i]) for i in part])
            logit = np.bincount(owner, weights[index] * value, len(part)) + bias
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - good[part]
            slope = np.bincount(index, error[owner] * value, BUCKETS) / len(part)
            squares += slope**2
            weights -= 0.3 * slope / np.sqrt(squares) + 1e-5 * weights
            bias -= 0.3 * error.mean()
    return HashedScorer(weights.astype(np.float32), float(bias))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_rows: int = LABEL_ROWS) -> tuple[HashedScorer, LabelModel, frozenset[bytes]]:
    # One marked whole word is a vote, so one that clean documents have too is hardly ever marked.
    flagged = flag_words(sample_texts(docs, labels, label_rows), shared=20.0)
    patterns = settle(vote_patterns(docs, flagged))
    model = estimate({r["pattern"]: r["count"] for r in patterns.groupBy("pattern").count().collect()})
    chosen = bounded_sample(patterns.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("pattern").alias("pattern")), "doc_id", sample_rows)
    chosen = chosen.withColumnRenamed("doc_id", "chosen_id")
    sent = docs.sparkSession.sparkContext.broadcast(flagged)

    def run(batches):
        for batch in pieces(batches, "text"):
            own = _measure(raw_texts(batch.column("text")), sent.value, True)
            rows = [pa.array([x.astype("<i4").tobytes() for x in part], pa.binary()) for part in (own.features, own.bins().T)]
            yield pa.RecordBatch.from_arrays([batch.column("pattern"), *rows], ["pattern", "features", "bins"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).select("pattern", "text")
    rows = settle(texts.mapInArrow(run, "pattern long, features binary, bins binary")).orderBy("features", "pattern").limit(sample_rows).collect()
    read = lambda name: [np.frombuffer(r[name], "<i4").astype(np.int64) for r in rows]
    good = np.array([model.posterior[r["pattern"]] for r in rows])
    bins = np.array(read("bins"), np.int64).reshape(len(rows), len(_BINS))
    return train(read("features"), bins, good), model, flagged


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """Per row: doc_id, score (0 to 1, of being good), posterior (of its votes), n_bad_votes, kept."""
    scorer, model, flagged = fit(docs, labels, **settings)
    sent = docs.sparkSession.sparkContext.broadcast((scorer, model.posterior, flagged))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        weights = 3 ** np.arange(len(LABELLERS))
        for batch in pieces(batches, "text"):
            scorer, posterior, flagged = sent.value
            own = _measure(raw_texts(batch.column("text")), flagged, True)
            votes = own.votes()
            value = 1 / (1 + np.exp(-np.clip(scorer.logits(own), -30, 30)))
            believed = [posterior.get(p, 0.5) for p in (weights @ votes).tolist()]
            columns = [pa.array(value, pa.float64()), pa.array(believed, pa.float64()), pa.array((votes == 0).sum(axis=0))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "score", "posterior", "n_bad_votes"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, posterior double, n_bad_votes long")
    return scored.withColumn("kept", F.col("score") >= threshold)
