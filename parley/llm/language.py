"""Language identification by families, then pairs (operator 13).

Method: hierarchical discrimination. Linear support vector machines, one per language
family against the rest, choose the family first; inside it, one machine for every pair
of its languages votes, ties going to the larger sum of margins, then to the smaller name.

A text is the mean of its words' features: hashed letter runs of one to four letters with
word marks, and the word itself. A score is therefore the mean of the words' scores, so a task
keeps the scores of words it has met and reads every whole text once. All machines
are trained in numpy by dual coordinate descent on a bounded sample: at most
``SAMPLE_ROWS`` rows in all, equally many of each language, of at most ``SAMPLE_CHARS``
characters each, chosen by the hash of their id.

Rows whose ``crc32(id) mod 4`` is ``HELD_OUT`` are not learned from; language, source and id
are never inputs of a prediction. Languages that ``FAMILIES`` doesn't name are a family of
their own.

Defined results:
* null texts and texts without a letter are ``und`` with score 0;
* null ids are predicted, count as not held out, and are not learned from;
* a text found under several languages in the sample counts once for each;
* if nothing can be learned, all is ``und`` with score 0; a single language is always predicted;
* repeated rows each get their row; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.batches import shipped, slices

HELD_OUT = 2
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 20_000
#: Hashed features, rounds of training, cost of a margin error, seed.
BUCKETS, EPOCHS, COST, SEED = 1 << 17, 12, 64.0, 13
#: Longest run of letters, longer ones being cut, and word scores a Python worker keeps.
RUN, MEMO_WORDS = 32, 300_000
#: Words of a text, or of several, scored at once, and new ones whose features are made at once.
PIECE, NEW_WORDS = 1 << 15, 4096

# Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms tl",
}

_MUL = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(RUN + 1, 0xD6E8FEB86659FD93, np.uint64), dtype=np.uint64)

WORD = re.compile(r"[^\W\d_]{1,%d}" % RUN)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, of ``RUN`` letters at most."""
    return WORD.findall(text.lower()) if text else []


def family_of(language: str, families: dict[str, str] = FAMILIES) -> str:
    base = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, members in families.items() if base in members.split()), f"only {language}")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one word's after the other's, and where each word's start.
    A word of ``n`` letters has ``4 n + 1``: its letters, the runs of two to four characters of
    the word with a mark on both sides, and itself."""
    letters = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate(([1], 1 + np.cumsum(size + 1)))[:-1]
    owner = np.zeros(len(letters), np.int64)  # of runs that start here; a mark starts runs of the next word
    owner[first - 1] = 1
    owner = np.cumsum(owner) - 1
    mark = letters == np.uint64(33)
    with np.errstate(over="ignore"):
        inside = np.flatnonzero(~mark)
        found, of = [_mixed(letters[inside] * _MUL)], [owner[inside]]
        run, clear = letters * _MUL, np.ones(len(letters), bool)
        for n in (2, 3, 4):
            run = run[:-1] * _MUL + letters[n - 1:] * np.uint64(2 * n + 1)
            if n > 2:  # no mark in the middle
                clear = clear[:len(run)] & ~mark[n - 2:n - 2 + len(run)]
            at = np.flatnonzero(clear[:len(run)] & (owner[:len(run)] >= 0))
            at = at[at + n <= first[owner[at]] + size[owner[at]] + 1]
            found.append(_mixed(run[at]))
            of.append(owner[at])
        place = np.arange(len(letters)) - first[np.minimum(owner, len(words) - 1)]
        whole = np.where(mark, np.uint64(0), letters * _POWERS[np.clip(place, 0, RUN)])
        found.append(_mixed(np.add.reduceat(whole, first)))
        of.append(np.arange(len(words)))
    of = np.concatenate(of)
    return np.concatenate(found)[np.argsort(of, kind="stable")], np.concatenate(([0], np.cumsum(4 * size + 1)))[:-1]


def document(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their mean number a word."""
    index, count = np.unique(features(words)[0], return_counts=True)
    return index, count / len(words)


@dataclass
class Machine:
    """A linear decision between two groups of languages."""

    weights: np.ndarray
    bias: float


def train_machine(docs: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> Machine:
    """Support vector machine with squared-hinge loss by dual coordinate descent; both sides
    weigh the same in total."""
    rng = np.random.default_rng(SEED)
    w, bias = np.zeros(BUCKETS), 0.0
    dual = np.zeros(len(docs))
    share = np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum())
    soft = share / (COST * len(docs))
    norm = np.array([float(v @ v) + 1 for _, v in docs]) + soft
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            index, value = docs[i]
            gap = 1 - sign[i] * (float(w[index] @ value) + bias) - soft[i] * dual[i]
            new = max(0.0, dual[i] + gap / norm[i])
            if new != dual[i]:
                move = (new - dual[i]) * sign[i]
                w[index] += move * value
                bias += move
                dual[i] = new
    return Machine(w.astype(np.float32), bias)


@dataclass
class Model:
    """Families with their languages, and one column of weights for every machine."""

    families: list[list[str]]
    weights: np.ndarray
    bias: np.ndarray
    #: Columns of the families' machines, and of the pairs ``(first, second)``.
    by_family: list[int]
    by_pair: dict[tuple[str, str], int]


def train(rows: list[tuple[str, str]], families: dict[str, str] = FAMILIES) -> Model:
    """Train on ``(language, text)``."""
    docs, langs = [], []
    for lang, text in rows:
        words = words_of(text)
        if words:
            docs.append(document(words))
            langs.append(lang)
    of = {lang: family_of(lang, families) for lang in sorted(set(langs))}
    groups = [[lang for lang in of if of[lang] == name] for name in sorted(set(of.values()))]
    langs = np.array(langs, dtype=object)
    machines: list[Machine] = []

    def add(chosen: np.ndarray, positive: np.ndarray) -> int:
        machines.append(train_machine([docs[i] for i in np.flatnonzero(chosen)], np.where(positive[chosen], 1.0, -1.0)))
        return len(machines) - 1

    by_family: list[int] = []
    if len(groups) > 1:
        by_family = [add(np.ones(len(langs), bool), np.isin(langs, g)) for g in groups]
    by_pair = {(a, b): add((langs == a) | (langs == b), langs == a) for g in groups for a, b in combinations(g, 2)}
    weights = np.stack([m.weights for m in machines], axis=1) if machines else np.zeros((BUCKETS, 0), np.float32)
    return Model(groups, weights, np.array([m.bias for m in machines]), by_family, by_pair)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class Scorer:
    """A model with the scores of the words it has met."""

    def __init__(self, model: Model):
        self.model, self.index, self.rows = model, {}, np.zeros((1024, model.weights.shape[1]), np.float64)

    def _ids(self, words: list[str]) -> np.ndarray:
        index = self.index
        try:
            return np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = list({w for w in words if w not in index})
        if len(index) + len(new) > MEMO_WORDS:
            index.clear()
            new = list(set(words))
        start = len(index)
        index.update(zip(new, range(start, start + len(new))))
        if len(index) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), len(index)), self.rows.shape[1]))
            grown[:start] = self.rows[:start]
            self.rows = grown
        for at in range(0, len(new), NEW_WORDS):
            some = new[at:at + NEW_WORDS]
            found, starts = features(some)
            self.rows[start + at:start + at + len(some)] = np.add.reduceat(self.model.weights[found], starts, axis=0, dtype=np.float64)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def predict(self, words: list[str]) -> tuple[str, float]:
        """Language and score of a text's words, a long text's in bounded pieces."""
        total = np.zeros(self.rows.shape[1])
        for at in range(0, len(words), PIECE):
            ids = self._ids(words[at:at + PIECE])
            total += self.rows[ids].sum(axis=0)
        return self._decided(total, len(words))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """``predict`` of every text; words of several texts are looked up together."""
        out, held, size = [], [], 0
        for words in map(words_of, texts):
            if size + len(words) > PIECE:
                out += self._together(held)
                held, size = [], 0
            held.append(words)
            size += len(words)
        return out + self._together(held)

    def _together(self, held: list[list[str]]) -> list[tuple[str, float]]:
        if len(held) < 2:
            return [self.predict(words) for words in held]
        ids = self._ids([w for words in held for w in words])  # may add rows
        rows, out, at = self.rows[ids], [], 0
        for words in held:
            out.append(self._decided(rows[at:at + len(words)].sum(axis=0), len(words)))
            at += len(words)
        return out

    def _decided(self, total: np.ndarray, n: int) -> tuple[str, float]:
        """Language and score from the sum over ``n`` words: the logistic of the family's margin
        lead times that of the least margin against another language of the family."""
        m = self.model
        if not n or not m.families:
            return "und", 0.0
        margins = total / n + m.bias
        family, score = 0, 1.0
        if m.by_family:
            by = margins[m.by_family]
            family = int(np.argmax(by))
            score = _sigmoid(float(by[family] - np.delete(by, family).max()))
        members = m.families[family]
        votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        lead = dict.fromkeys(members, np.inf)
        for a, b in combinations(members, 2):
            d = float(margins[m.by_pair[a, b]])
            votes[a if d >= 0 else b] += 1
            for name, own in ((a, d), (b, -d)):
                sums[name] += own
                lead[name] = min(lead[name], own)
        best = min(members, key=lambda name: (-votes[name], -sums[name], name))
        return best, score * (_sigmoid(lead[best]) if len(members) > 1 else 1.0)


def crc_fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        families: dict[str, str] = FAMILIES, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``sample_rows`` rows outside the held-out fold, the languages in turn."""
    size = F.length(text_col)
    rows = docs.where(F.col(lang_col).isNotNull() & (crc_fold(id_col) != HELD_OUT) & (size > 0) & (size <= SAMPLE_CHARS)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    # the sample_rows most frequent languages at most, hence safe to broadcast
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows)
    share = F.lit(2.0 * sample_rows) / F.col("n")
    # about twice sample_rows of a language are ranked, however many it has
    few = rows.select("id", "lang", "hash").join(F.broadcast(counts), "lang").where(
        F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "hash")
    chosen = (few.withColumn("place", F.row_number().over(order)).orderBy("place", "lang").limit(sample_rows)
              .select("id", "lang", "hash").distinct())
    picked = (rows.join(F.broadcast(chosen), ["id", "lang", "hash"]).dropDuplicates(["id", "lang", "hash"])  # bounded by sample_rows
              .select("lang", "text").toArrow())
    sample = sorted(zip(picked.column("lang").to_pylist(), picked.column("text").to_pylist()))
    return train(sample, families)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    shared = shipped(docs).sparkSession.sparkContext.broadcast(model)  # of fixed size
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in slices(batches, "text"):
            found = scorer.predict_all(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, lang_pred string, score double").select(
        "doc_id", F.coalesce(crc_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
