"""BPE encoding and decoding (operator 2) as a distributed, shuffle-free Spark job.

Method: a priority queue of merge ranks over a doubly linked symbol list. Every
queue entry is ``(rank, position)``; an entry whose pair has changed since it
was pushed is stale and skipped. Decoding concatenates vocabulary strings.

The vocabulary file (a tokenizers JSON with a BPE model whose last symbol of a
word carries an end-of-word suffix) is a parameter; it is read on the driver
and shipped to the tasks as a broadcast of the file's own, fixed size.

Defined results:
* null text counts as empty; an empty text has no tokens and decodes to ``""``;
* repeated rows and repeated ids are encoded one by one, every row is returned;
* very long words cost ``n log n`` in their own length, and are not memoised;
* an empty table returns no rows; columns of the input that clash with result
  columns are not carried (``encode`` returns the id column and its results).
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.batches import shared_text, slices

#: Pieces kept in one Python worker's memo (about 200 bytes each); beyond it the
#: memo starts anew. The memo saves time only, results do not depend on it.
MEMO_WORDS = 1_000_000
#: Pieces longer than this are encoded each time and never memoised.
MEMO_CHARS = 64


def read_vocabulary(path: str) -> str:
    """The tokenizer file's JSON text (its size is that of a vocabulary, not of the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _char_class(major: str) -> str:
    """Character-class body of the code points whose general category starts with ``major``."""
    points = (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == major)
    body = []
    for _, run in groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        body.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(body)


SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


BLANKS = re.compile(f"[{SPACES}]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def _word_pattern() -> re.Pattern:
    letter, number = _char_class("L"), _char_class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACES}{letter}{number}]+")


class Bpe:
    """One tokenizer file: pre-tokenisation, merge ranks, vocabulary strings."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        symbols = _byte_symbols()
        self.plain = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] << 20 | vocab[right], r)
            self.made.append(vocab[left + right])
        self.word_pattern = _word_pattern()
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo = _Memo(self)

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ids = [self.plain[b] for b in word]
        ids[-1] = self.final[word[-1]]
        return self.merge_symbols(ids)

    def merge_symbols(self, ids: list[int]) -> list[int]:
        """Merge a symbol list (overwritten): lowest rank first, leftmost on ties."""
        n = len(ids)
        if n == 1:
            return ids
        rank, made = self.rank, self.made
        queue = []
        left = ids[0]
        for i in range(1, n):
            right = ids[i]
            r = rank.get(left << 20 | right)
            if r is not None:
                queue.append(r * n + i - 1)
            left = right
        if not queue:
            return ids
        heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            r, i = divmod(heappop(queue), n)
            j = after[i]
            if j >= n or ids[i] < 0 or rank.get(ids[i] << 20 | ids[j]) != r:
                continue  # stale: one of its symbols has been merged since
            ids[i] = new = made[r]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                s = rank.get(new << 20 | ids[k])
                if s is not None:
                    heappush(queue, s * n + i)
            h = before[i]
            if h >= 0:
                s = rank.get(ids[h] << 20 | new)
                if s is not None:
                    heappush(queue, s * n + h)
        return [x for x in ids if x >= 0]

    @staticmethod
    def normalise(text: str) -> str:
        """NFC and lower case of a text without special strings."""
        if not text.isascii():
            # a capital sigma lowers to the plain small one wherever it stands
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Normalised text without special strings, cut at white space (no
        pre-token crosses it)."""
        text = self.normalise(text)
        # str.split would also cut at the information separators
        return [x for x in BLANKS.split(text) if x] if SEPARATORS.search(text) else text.split()

    def words(self, piece: str) -> list[str]:
        """Pre-tokens of a piece."""
        return [piece] if piece.isalpha() else self.word_pattern.findall(piece)

    def pack(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        if self.special_pattern is None or "<" not in text:
            return b"".join(map(memo.__getitem__, self.pieces(text)))
        out = []
        for k, part in enumerate(self.special_pattern.split(text)):
            if k % 2:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out.extend(map(memo.__getitem__, self.pieces(part)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return list(array("I", self.pack(text)))

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids, joined as the file without a decoder joins them."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])


class _Memo(dict):
    """Piece -> packed ids, filled by ``Bpe.merge``."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        words = self.bpe.words(piece)
        if words == [piece]:
            packed = array("I", self.bpe.merge(piece.encode("utf-8", "replace"))).tobytes()
        else:
            packed = b"".join([self[word] for word in words])
        if len(piece) <= MEMO_CHARS:
            self[piece] = packed
        return packed


@lru_cache(maxsize=2)
def load(text: str) -> Bpe:
    """The tokenizer of a file's text, made once per Python worker."""
    return Bpe(text)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens`` (long) and ``ids`` (binary,
    little-endian unsigned 32-bit integers); with ``decoded`` also the text that
    decoding those ids gives, made in the same pass.

    ``vocabulary`` is the path of the tokenizer file. No shuffle: a map over the
    scan. Batches are worked off in slices of bounded text size.
    """
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids binary"
    spec = shared_text(df.sparkSession, read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for part in slices(batches, "text"):
            packed = [bpe.pack(t) for t in part.column(1).to_pylist()]
            out = [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if decoded:
                out.append(pa.array([bpe.decode(array("I", x)) for x in packed], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names)

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema + (", decoded string" if decoded else ""))


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` of packed ids; null ids count as none."""
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, decoded string"
    spec = shared_text(df.sparkSession, read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for part in slices(batches, "ids"):
            texts = [bpe.decode(array("I", x or b"")) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def encode_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode``'s real output."""
    return encode(df, vocabulary, id_col, text_col, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
