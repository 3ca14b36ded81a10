"""Document quality rules as a short-circuit cascade (operator 1).

Method: every rule's cost and rejection rate are estimated on a random sample of
about ``SAMPLE_ROWS`` documents (inside the tasks that hold them; a row per rule and
task comes back); the rules are then ordered by rejection per cost, and a
document leaves the cascade at the first rule that rejects it. The verdict is
the conjunction of all rules, so it does not depend on the order or the sample.

Base statistics are counted for every document; a document that fails the base
limits does not enter the cascade.

Defined results:
* words are runs of other bytes than blank and 09-0D; null text has none of anything
  and, like empty and short texts, fails the base limits;
* very long texts are counted whole; repeated rows and ids each get their row;
* an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.batches import shipped, slices

SAMPLE_ROWS, SEED = 2000, 5
LEAST_WORDS, REPEAT_PERCENT = 50, 50
BLANKS, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
#: Limits of the rules.
MOST_SYMBOLS_A_WORD = 0.1
MOST_UPPER = 0.6
MOST_EXCLAIMED = 0.3
MOST_DUP_LINES = 0.5
WORD_LENGTH = (2.0, 14.0)
LEAST_LETTERED = 0.6
LEAST_PACKED = 0.12
LEAST_LINE_CHARS = 8.0


@dataclass
class Doc:
    """A text and the base statistics that the rules may use."""

    data: bytes
    words: list[bytes] = field(default_factory=list)
    lines: list[bytes] = field(default_factory=list)
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0

    @property
    def base_failed(self) -> bool:
        n = len(self.words)
        return n < LEAST_WORDS or 100 * self.n_repeat_words > REPEAT_PERCENT * n


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def read(text: str | None) -> Doc:
    data = (text or "").encode("utf-8", "replace")
    words = data.split()  # bytes split at blank and 09-0D only
    lines = [x for x in data.split(b"\n") if x.strip()]
    dense = data.translate(None, BLANKS)
    # code points: bytes that don't continue a character
    chars = len(dense) if dense.isascii() else len(dense.decode("utf-8"))
    return Doc(data, words, lines, chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
               repeated_words(words))


def _symbols(d: Doc) -> bool:
    return d.n_symbols > MOST_SYMBOLS_A_WORD * len(d.words)


def _upper(d: Doc) -> bool:
    text = d.data.decode("utf-8")
    upper = sum(map(str.isupper, text))
    return upper > MOST_UPPER * max(1, sum(map(str.isalpha, text)))


def _exclaimed(d: Doc) -> bool:
    return d.data.count(b"!!") > MOST_EXCLAIMED * len(d.words)


def _dup_lines(d: Doc) -> bool:
    return d.n_dup_lines > MOST_DUP_LINES * len(d.lines)


def _word_length(d: Doc) -> bool:
    return not WORD_LENGTH[0] <= d.word_chars / len(d.words) <= WORD_LENGTH[1]


def _lettered(d: Doc) -> bool:
    return sum(any(map(str.isalpha, w.decode("utf-8"))) for w in d.words) < LEAST_LETTERED * len(d.words)


def _packed(d: Doc) -> bool:
    return len(zlib.compress(d.data, 1)) < LEAST_PACKED * len(d.data)


def _line_chars(d: Doc) -> bool:
    return d.word_chars < LEAST_LINE_CHARS * len(d.lines)


#: Name -> whether a document that passed the base limits is rejected.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": _symbols, "upper": _upper, "exclaimed": _exclaimed, "dup_lines": _dup_lines, "word_length": _word_length,
    "lettered": _lettered, "packed": _packed, "line_chars": _line_chars,
}


def estimate(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rule, seconds, seen, rejected`` on a sample, by rule."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hit, seen = Counter(), Counter(), 0
        for part in slices(batches, "text"):
            for text in part.column(0).to_pylist():
                doc = read(text)
                if doc.base_failed:
                    continue
                seen += 1
                for name, rule in RULES.items():
                    began = time.thread_time()
                    hit[name] += rule(doc)
                    took[name] += time.thread_time() - began
        if seen:
            yield pa.RecordBatch.from_pylist([{"rule": n, "seconds": float(took[n]), "seen": seen, "rejected": hit[n]} for n in RULES])

    share = min(1.0, sample_rows / max(1, docs.count()))
    rows = shipped(docs).select(F.col(text_col).alias("text")).sample(share, SEED)
    parts = rows.mapInArrow(run, "rule string, seconds double, seen bigint, rejected bigint")
    return parts.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"))


def order_rules(estimates: list[dict]) -> list[str]:
    """Rules by rejection per cost, best first; unseen rules keep their place at the end."""
    gain = {r["rule"]: (r["rejected"] / max(1, r["seen"])) / max(1e-9, r["seconds"] / max(1, r["seen"])) for r in estimates}
    return sorted(RULES, key=lambda n: -gain.get(n, -1.0))


def cascade(doc: Doc, order: list[str]) -> bool:
    """Whether the document passes all rules; stops at the first that rejects it."""
    return not any(RULES[name](doc) for name in order)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``."""
    order = order_rules([r.asDict() for r in estimate(docs, text_col, sample_rows).collect()])  # one row a rule
    key = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for text in part.column(1).to_pylist():
                d = read(text)
                failed = d.base_failed
                out.append((len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed,
                            not failed and cascade(d, order)))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.bool_()) for c in cols[5:]]],
                ["doc_id", *names, "base_failed", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, {', '.join(f'{n} bigint' for n in names)}, base_failed boolean, kept boolean")
