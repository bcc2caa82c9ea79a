"""Language identification with string kernels.

The kernel of two texts is the share of byte n-grams (lengths 1 to ``LONGEST``, a blended spectrum, presence
only) that they have in common, over the ``FEATURES`` n-grams that most texts of the sample hold.  ``LANDMARKS`` training texts stand for the kernel space (Nyström): every text
is described by its kernel with each landmark, whitened by the landmarks' own kernel matrix, and one-versus-rest
ridge regression on those features gives a value for each language.  Whole texts are scored in batches by two
matrix products, presence x landmarks and features x languages.

The classifier is fitted on a bounded sample of labelled rows, ``SAMPLE_ROWS``, the same number for each language and
one at least, however many languages there are; only text and label enter it.

Defined cases: a null text or one without a letter is ``und`` with score 0; a label that is null teaches
nothing; without labelled rows every text is ``und``; equal texts get equal answers (scores up to rounding); of equal values the first
label in order wins; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import first_rows, pieces, raw_texts
from changelens.scratch import settle

SAMPLE_ROWS = 2_000
LANDMARKS = 400
LONGEST = 3
FEATURES = 8_000
RIDGE = 1e-3
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: Letters keep their byte (A-Z as a-z), everything else in ASCII becomes a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _codes(text: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """Numbers of all n-grams of a text, one array for each length; lengths never share a number."""
    code, offset = text.astype(np.int32), 0
    for length in range(1, longest + 1):
        if length > 1:
            code = (code[:-1] << 8) | text[length - 1 :]
        if len(code):
            yield code + offset
        offset += 1 << (8 * length)


def _folded(text: bytes) -> np.ndarray:
    return np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8)


class StringKernelClassifier:
    def __init__(self, texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, longest: int = LONGEST, features: int = FEATURES, ridge: float = RIDGE):
        self.longest = longest
        self.labels = sorted(set(labels))
        sets = [np.unique(np.concatenate(list(_codes(_folded(t), longest)))) for t in texts]
        found, times = np.unique(np.concatenate(sets), return_counts=True)
        # Presence in one text tells texts apart only by that text; the most frequent others are kept, in a fixed order.
        found, times = found[times > 1], times[times > 1]
        chosen = found[np.argsort(-times, kind="stable")[:features]]
        self.codes = np.sort(chosen).astype(np.int64)
        presence = np.zeros((len(sets), len(self.codes)), np.float32)
        for row, own in zip(presence, sets):
            at = np.searchsorted(self.codes, own)
            at = at[(at < len(self.codes))]
            row[at[np.isin(self.codes[at], own)]] = 1
        picked = self._spread(labels, landmarks)
        self.marks = self._unit(presence[picked])
        own = self.marks @ self.marks.T
        values, vectors = np.linalg.eigh(own.astype(np.float64))
        good = values > 1e-6 * max(values.max(), 1e-12)
        whiten = vectors[:, good] / np.sqrt(values[good])
        features_ = np.hstack([(self._unit(presence) @ self.marks.T) @ whiten, np.ones((len(sets), 1))])
        target = np.array([[1.0 if own == label else -1.0 for label in self.labels] for own in labels])
        weigh = np.array([1.0 / labels.count(x) for x in labels])[:, None] * len(labels)
        solved = np.linalg.solve(features_.T @ (weigh * features_) + ridge * len(labels) * np.eye(features_.shape[1]), features_.T @ (weigh * target))
        self.weights = (whiten @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)

    @staticmethod
    def _unit(presence: np.ndarray) -> np.ndarray:
        return presence / np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True), 1))

    @staticmethod
    def _spread(labels: list[str], landmarks: int) -> list[int]:
        """Landmarks in turn from every language."""
        queues = {x: [i for i, own in enumerate(labels) if own == x] for x in sorted(set(labels))}
        rounds = [q[k] for k in range(max(map(len, queues.values()))) for q in queues.values() if k < len(q)]
        return sorted(rounds[:landmarks])

    def lookup(self) -> np.ndarray:
        """Feature of each n-gram number, or -1."""
        size = sum(1 << (8 * n) for n in range(1, self.longest + 1))
        table = np.full(size, -1, np.int32)
        table[self.codes] = np.arange(len(self.codes))
        return table

    def values(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        presence = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        for row, text in zip(presence, texts):
            whole = _folded(text)
            for low in range(0, len(whole), 1 << 20):
                for codes in _codes(whole[low : low + (1 << 20) + self.longest - 1], self.longest):
                    row[table[codes]] = 1  # what is no feature falls on the last column
        kernel = self._unit(presence[:, :-1]) @ self.marks.T
        return kernel @ self.weights + self.bias


_TABLES: dict[int, np.ndarray] = {}


def _predict(batches: Iterator[pa.RecordBatch], key: int, model: StringKernelClassifier | None) -> Iterator[pa.RecordBatch]:
    if model is not None and key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = model.lookup()
    for batch in pieces(batches, "text", 1 << 20):
        texts = raw_texts(batch.column("text"))
        known = [bool(_LETTER.search(t.decode())) for t in texts]
        languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        own = [i for i, k in enumerate(known) if k and model is not None]
        for low in range(0, len(own), 256):
            part = own[low : low + 256]
            found = model.values([texts[i] for i in part], _TABLES[key])
            best = found.argmax(axis=1)
            odds = np.exp(4 * (found - found.max(axis=1, keepdims=True)))
            odds /= odds.sum(axis=1, keepdims=True)
            for i, b, p in zip(part, best.tolist(), odds.max(axis=1).tolist()):
                languages[i], scores[i] = model.labels[b], min(1.0, float(p))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, features: int = FEATURES) -> StringKernelClassifier | None:
    """A classifier from rows with text and lang: an equal number for each language, one at least, so at most
    ``sample_rows`` or as many as there are languages."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    languages = labelled.select("lang").distinct().count()
    if not languages:
        return None
    share = max(1, sample_rows // languages)
    narrow = labelled.select("lang", "row_key", F.xxhash64("row_key").alias("turn"))
    chosen = settle(first_rows(narrow, ["lang"], [F.asc("turn"), F.asc("row_key")], share, F.pmod("turn", F.lit(64))).select("lang", "row_key").distinct())
    rows = settle(labelled.join(chosen, ["lang", "row_key"], "left_semi").dropDuplicates(["row_key", "lang"])).orderBy("row_key", "lang").collect()
    return StringKernelClassifier([r["text"].encode() for r in rows], [r["lang"] for r in rows], landmarks, features=features)


def predict(docs: DataFrame, model: StringKernelClassifier | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = id(sent)
    return docs.select("doc_id", "text").mapInArrow(lambda b: _predict(b, key, sent.value), f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, **settings) -> DataFrame:
    """Learn from the rows whose remainder is not ``held``, predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.filter(remainder(F.col("doc_id"), modulus) != held), **settings)
    return predict(docs, model).select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "lang_pred", "score")
