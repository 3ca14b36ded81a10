"""Toxicity scores by a convolutional text classifier (operator 5).

Method: every word is the sum of hashed embedding rows (the word and its first
letters, two hash functions each, so that one collision never looks like a whole
word); filters of several widths run over the word sequence and the maximum over
the whole text is pooled; a logistic layer gives the raw score. All is trained
in numpy on a bounded sample of labelled rows, and thresholds are calibrated by
language on rows kept out of that training.

The language is guessed from the text's own function words. Each language's
threshold is moved to the common ``THRESHOLD`` by a piecewise linear, monotone map of
the raw score, so one comparison decides for all languages. Labels, ``lang``,
``source`` and ids are not inputs of a score; rows whose ``crc32(id) mod 4`` is
``HELD_OUT`` are neither trained nor calibrated on.

Training reads at most ``SAMPLE_ROWS`` labelled texts of at most ``SAMPLE_CHARS``
characters each (the smallest hashes of their ids), gathered on the driver;
scoring reads every whole text, in a map without shuffle.

Defined results:
* null text counts as empty; a text without words gets the model's score of no words;
* null ids are scored and count as not held out; repeated rows each get their row;
* labels without id or value, and ids labelled both 0 and 1, are not learned from;
* without labelled rows of both classes every score is the rate of the class seen
  (0 without any), at most just under the threshold;
* an empty table gives no rows; other columns are not carried by ``score``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.batches import shipped, slices

THRESHOLD = 0.3
HELD_OUT = 2
#: Remainder whose rows calibrate instead of train.
CALIBRATION = 3
SAMPLE_ROWS, SAMPLE_CHARS = 12_000, 100_000
ROWS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
EPOCHS, LEAST_STEPS, BATCH, SEED = 5, 300, 64, 7
#: Embedding rows a word.
FEATURES = 6
#: Words whose embeddings a Python worker keeps.
MEMO_WORDS = 300_000

#: Function words by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to in is was for that with are this by from have not",
    "fr": "le les des et est une dans que pour qui sur pas avec au",
    "de": "der die das und ist von mit den nicht ein eine zu auf im",
    "es": "el los las y del una por para con como su al más esta",
}
WORD = re.compile(r"\w+")


def crc_fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Embedding rows of a word: itself and its first four and five letters, twice each."""
    parts = [b"w" + (data := word.encode("utf-8", "replace")), b"4" + word[:4].encode("utf-8", "replace"),
             b"5" + word[:5].encode("utf-8", "replace")]
    if len(data) < 4:
        parts[1:] = parts[:1] * 2
    return [zlib.crc32(p, salt) % ROWS for p in parts for salt in (0, 0x5BD1E995)]


@dataclass
class Model:
    """Parameters of the network and the calibrated thresholds."""

    table: np.ndarray
    filters: np.ndarray  # (DIM, sum of widths * FILTERS), by width and offset
    bias: np.ndarray
    out: np.ndarray
    shift: float
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows].sum(axis=1)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Filter responses at every word; windows reach over the end into zeros."""
        y, outs, at = x @ self.filters, [], 0
        for width in WIDTHS:
            z = y[:, at:at + FILTERS].copy()
            for k in range(1, width):
                z[:-k or None] += y[k:, at + k * FILTERS:at + (k + 1) * FILTERS] if len(z) > k else 0
            outs.append(z)
            at += width * FILTERS
        return np.hstack(outs)

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.maximum(pooled + self.bias, 0) @ self.out + self.shift, -30, 30)))

    def calibrated(self, raw: float, language: str) -> float:
        """Monotone map that moves the language's threshold to the common one."""
        t = self.thresholds.get(language, self.thresholds.get("", 0.5))
        return THRESHOLD * raw / t if raw < t else THRESHOLD + (1 - THRESHOLD) * (raw - t) / (1 - t)


def _separated(x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after the other with zero rows between, and their starts."""
    gap = max(WIDTHS) - 1
    starts = np.concatenate(([0], np.cumsum(lengths + gap)))[:-1]
    spread = np.zeros((int(lengths.sum() + gap * len(lengths)), x.shape[1]), dtype=x.dtype)
    keep = np.arange(len(x)) + np.repeat(np.arange(len(lengths)) * gap, lengths)
    spread[keep] = x
    return spread, starts


def train(docs: Iterable[list[str]], labels: np.ndarray) -> Model:
    """Train on tokenised texts, read once: Adagrad, maxima's positions carry the gradient."""
    rng = np.random.default_rng(SEED)
    vocab: dict[str, int] = {}
    ids = [np.fromiter((vocab.setdefault(w, len(vocab)) for w in d), dtype=np.int32) for d in docs]
    feats = np.fromiter((x for w in vocab for x in features(w)), dtype=np.int32).reshape(-1, FEATURES)
    del vocab
    total = sum(WIDTHS) * FILTERS
    m = Model(rng.normal(0, 0.01, (ROWS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, total)).astype(np.float32),
              np.zeros(len(WIDTHS) * FILTERS, np.float32), np.abs(rng.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32), -2.0)
    squares = {"table": np.full((ROWS, 1), 1e-3, np.float32), "filters": np.full_like(m.filters, 1e-2),
               "bias": np.full_like(m.bias, 1e-2), "out": np.full_like(m.out, 1e-2), "shift": 1e-2}
    weight = np.where(labels > 0, min(10.0, (len(labels) - labels.sum()) / max(1, labels.sum())), 1.0)
    offsets = [(i, at, k) for i, (width, at) in enumerate(zip(WIDTHS, np.concatenate(([0], np.cumsum(WIDTHS)))[:-1] * FILTERS))
               for k in range(width)]
    full = [i for i, d in enumerate(ids) if len(d)]
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(full))))
    for epoch in range(epochs):
        rate = 0.1 / (1 + epoch * EPOCHS / epochs)
        order = rng.permutation(full)
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            lengths = np.array([len(ids[i]) for i in pick])
            rows = feats[np.concatenate([ids[i] for i in pick])]
            x, starts = _separated(m.embed(rows), lengths)
            z = m.convolve(x)
            best = np.stack([s + z[s:s + n].argmax(axis=0) for s, n in zip(starts, lengths)])  # doc, filter
            pooled = z[best, np.arange(z.shape[1])]
            active = pooled + m.bias > 0
            hidden = np.where(active, pooled + m.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ m.out + m.shift, -30, 30)))
            d_logit = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            d_hidden = np.where(active, d_logit[:, None] * m.out, 0)
            grad = {"out": hidden.T @ d_logit, "shift": d_logit.sum(), "bias": d_hidden.sum(axis=0)}
            # dead filters of positive documents wake up through a small leak
            leak = np.where(active, 1.0, 0.05)
            d_pool = d_logit[:, None] * m.out * leak
            d_filters, d_x, touched = np.zeros_like(m.filters), [], []
            for i, col, k in offsets:
                g = d_pool[:, i * FILTERS:(i + 1) * FILTERS]
                word = np.minimum(best[:, i * FILTERS:(i + 1) * FILTERS] + k, len(x) - 1)
                span = slice(col + k * FILTERS, col + (k + 1) * FILTERS)
                d_filters[:, span] = np.einsum("dfe,df->ef", x[word], g)
                d_x.append((g[:, :, None] * m.filters[:, span].T[None]).reshape(-1, DIM))
                touched.append(word.ravel())
            grad["filters"] = d_filters
            touched, d_x = np.concatenate(touched), np.concatenate(d_x)
            # positions back to words; zero rows between documents have none
            where = np.full(len(x), -1)
            where[np.arange(len(rows)) + np.repeat(np.arange(len(pick)) * (max(WIDTHS) - 1), lengths)] = np.arange(len(rows))
            real = where[touched] >= 0
            flat = rows[where[touched[real]]].ravel()
            each = np.repeat(d_x[real], rows.shape[1], axis=0)
            uniq, inverse = np.unique(flat, return_inverse=True)
            sums = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(sums, inverse, each)
            squares["table"][uniq] += (sums ** 2).mean(axis=1, keepdims=True)
            m.table[uniq] -= rate * sums / np.sqrt(squares["table"][uniq])
            for name, g in grad.items():
                squares[name] = squares[name] + g ** 2
                setattr(m, name, (getattr(m, name) - rate * g / np.sqrt(squares[name])).astype(np.float32))
    trained = np.zeros(ROWS, bool)
    trained[feats.ravel()] = True
    m.table[~trained] = 0  # words never seen are neutral
    return m


class Scorer:
    """A model with the embeddings of the words it has met."""

    def __init__(self, model: Model):
        self.model, self.index, self.rows = model, {}, np.zeros((1024, model.filters.shape[1]), np.float32)
        self.language = {w: k for k, ws in FUNCTION_WORDS.items() for w in ws.split()}

    def _ids(self, words: list[str]) -> np.ndarray:
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, words), np.int32, len(words))
        except KeyError:
            new = list({w for w in words if w not in index})
        if len(index) + len(new) > MEMO_WORDS:
            index.clear()
            new = list(set(words))
        start = len(index)
        index.update((w, start + i) for i, w in enumerate(new))
        if len(index) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), len(index)), self.rows.shape[1]), np.float32)
            grown[:start] = self.rows[:start]
            self.rows = grown
        self.rows[start:len(index)] = self.model.embed(np.array([features(w) for w in new])) @ self.model.filters
        return np.fromiter(map(index.__getitem__, words), np.int32, len(words))

    def guess(self, words: list[str]) -> str:
        """The language with most function words in the text; English on a tie, '' without any."""
        counts = dict.fromkeys(FUNCTION_WORDS, 0)
        for lang in filter(None, map(self.language.get, words)):
            counts[lang] += 1
        best = max(counts, key=counts.get)
        return best if counts[best] else ""

    def pooled(self, words: list[str]) -> np.ndarray:
        """Largest response of every filter over the whole text, in bounded pieces."""
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        reach = max(WIDTHS) - 1
        for at in range(0, len(words), 1 << 16):
            ids = self._ids(words[at:at + (1 << 16) + reach])  # may add rows
            y = self.rows[ids]
            col = 0
            for i, width in enumerate(WIDTHS):
                z = y[:, col:col + FILTERS]
                for k in range(1, width):
                    z = z + np.vstack([y[k:, col + k * FILTERS:col + (k + 1) * FILTERS], np.zeros((min(k, len(y)), FILTERS), np.float32)])
                part = best[i * FILTERS:(i + 1) * FILTERS]
                np.maximum(part, z.max(axis=0), out=part)
                col += width * FILTERS
        return best if len(words) else np.zeros(len(WIDTHS) * FILTERS, np.float32)

    def raw(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        pooled, languages = [], []
        for text in texts:  # one text's words at a time
            words = words_of(text)
            pooled.append(self.pooled(words))
            languages.append(self.guess(words))
        return self.model.raw(np.stack(pooled)), languages

    def score(self, texts: list[str | None]) -> tuple[list[float], list[str]]:
        if self.model.constant is not None:
            return [self.model.constant] * len(texts), [self.guess(words_of(t)) for t in texts]
        raw, languages = self.raw(texts)
        return [self.model.calibrated(float(r), g) for r, g in zip(raw, languages)], languages


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Cut with the best F1, in the middle of the gap it falls into."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    ends = np.append(scores[order][1:] < scores[order][:-1], True)  # ties stay on one side
    k = int(np.argmax(np.where(ends, f1, -1)))
    above = scores[order][k]
    below = scores[order][k + 1] if k + 1 < len(order) else 0.0
    return float(np.clip((above + below) / 2, 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train and calibrate on at most ``sample_rows`` labelled rows outside the held-out fold."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most"))
             .where("label = most").drop("most").withColumn("fold", crc_fold("_id")).where(F.col("fold") != HELD_OUT))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    present = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).select("_id")
    # bounded by sample_rows, hence safe to broadcast
    chosen = (known.join(present, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    # an id that repeats is learned once, with its smallest text
    rows = (texts.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS).join(F.broadcast(chosen), "_id")
            .groupBy("_id").agg(F.first("fold").alias("fold"), F.first("label").alias("label"), F.min("text").alias("text"))
            .toArrow().to_pylist())
    rows.sort(key=lambda r: (r["fold"], str(r["_id"])))
    learn = [r for r in rows if r["fold"] != CALIBRATION]
    check = [r for r in rows if r["fold"] == CALIBRATION]
    y = np.array([r["label"] for r in learn], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        rate = float(np.mean([r["label"] for r in rows])) if rows else 0.0
        return Model(np.zeros((1, DIM), np.float32), np.zeros((DIM, sum(WIDTHS) * FILTERS), np.float32), np.zeros(0), np.zeros(0), 0.0,
                     constant=min(rate, THRESHOLD - 1e-6))
    model = train((words_of(r["text"]) for r in learn), y)
    check = check if len({r["label"] for r in check}) == 2 else learn
    scores, languages = Scorer(model).raw([r["text"] for r in check])
    truth = np.array([r["label"] for r in check])
    model.thresholds = {"": best_threshold(scores, truth)}
    for lang in FUNCTION_WORDS:
        own = np.array([g == lang for g in languages])
        if (truth[own] == 1).sum() >= 5 and (truth[own] == 0).sum() >= 5:
            model.thresholds[lang] = best_threshold(scores[own], truth[own])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, language, threshold`` of every row (``threshold``:
    the raw score at which that language is called toxic)."""
    shared = shipped(docs).sparkSession.sparkContext.broadcast(model)  # of fixed size
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            scores, languages = scorer.score(part.column(1).to_pylist())
            own = shared.value.thresholds
            cuts = [own.get(g, own.get("", THRESHOLD)) for g in languages]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores, pa.float64()), pa.array(languages, pa.string()), pa.array(cuts, pa.float64())],
                ["doc_id", "score", "language", "threshold"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, score double, language string, threshold double").select(
        "doc_id", F.coalesce(crc_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "language", "threshold")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't call toxic."""
    shared = shipped(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in texts:
            yield pd.Series(scorer.score(part.tolist())[0] if len(part) else [], dtype="float64")

    return docs.where(score_udf(F.col(text_col)) < THRESHOLD)
