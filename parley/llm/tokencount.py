"""Token counts by a compiled finite-state tokenizer (operator 6).

Method: BPE is compiled into a deterministic transducer over a word's bytes. Its
state holds, for every place where a token may have begun that is not finished
yet, the trie node reached since, the last token before that place and the
count there; its transitions carry the number of tokens emitted (negative where
a longer token takes shorter ones back). That is exact because a sequence of
tokens is what BPE gives if and only if every neighbouring pair is. States and
transitions are compiled when first met, and kept.

A text is cut into chunks of ``CHUNK`` characters anywhere. A state at a cut is
the kind of the pre-token that is open there (letters, others, or the characters
of a contraction that may yet come), the transducer's state in it, and its last
byte, whose symbol depends on what follows. A chunk's state map is a table from
entry states to exit states and emitted tokens. Chunks are mapped independently:
for the state that the characters just before the cut leave (white space resets
the machine, and it forgets early characters soon); should another state
arrive, its row is added. Maps compose by lookup, associatively; a parallel
prefix scan (doubling) gives the map from a text's start to every chunk's end.
No word is put together across chunks.

Defined results:
* null text counts as empty: no bytes, no tokens;
* special strings inside a text are one token each, and cut it;
* very long texts are worked off chunk by chunk, words of any length included;
* repeated rows and ids each get their row; an empty table gives no rows; other
  columns are not carried.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.batches import shared_text, slices
from parley.llm.bpe import BLANKS, MEMO_CHARS, MEMO_WORDS, SEPARATORS, Bpe, load, read_vocabulary

CHUNK = 1 << 14
#: Characters before a cut that tell the state in which the next chunk is mapped.
LOOK_BACK = 64
#: State at a text's start and after white space: nothing open.
REST = ("", None, None)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LIMIT = 2048
#: Compiled states kept by one Python worker; beyond it compilation starts anew.
MAX_STATES = 200_000


class StateMap:
    """Entry state -> (exit state, tokens emitted); rows for ``live`` at once, others when asked for."""

    def __init__(self, step: Callable[[tuple], tuple[tuple, int]], live: Iterable[tuple]):
        self.step = step
        self.table = {s: step(s) for s in live}

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        row = self.table.get(state)
        if row is None:
            row = self.table[state] = self.step(state)
        return row

    def then(self, after: StateMap) -> StateMap:
        """The map of two neighbouring stretches of text."""
        def step(state: tuple) -> tuple[tuple, int]:
            between, n = self(state)
            end, more = after(between)
            return end, n + more

        return StateMap(step, self.table)


class Transducer:
    """The BPE transducer of a vocabulary, compiled on demand."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        base = {i: [k] for k, i in enumerate(bpe.plain)} | {i: [256 + k] for k, i in enumerate(bpe.final)}
        # every token's symbols: bytes, or 256 + byte where a word ends
        pairs = sorted((r, key) for key, r in bpe.rank.items())
        for r, key in pairs:
            left, right = base.get(key >> 20), base.get(key & (1 << 20) - 1)
            if left and right:
                base.setdefault(bpe.made[r], left + right)
        self.symbols = base
        ids = bpe.plain + bpe.final
        self.as_ids = {t: [ids[x] for x in s] for t, s in base.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int | None] = [None]
        for t, symbols in base.items():
            node = 0
            for x in symbols:
                if (down := self.children[node].get(x)) is None:
                    down = self.children[node][x] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                node = down
            self.token[node] = t
        self.fits: dict[tuple[int | None, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.keys: list[tuple] = [((0, None, 0),)]
        self.number = {self.keys[0]: 0}
        #: by state: symbol -> (next state, tokens emitted)
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]
        self.counts = _Counts(self)
        #: short openings of a word after white space -> (state, tokens emitted)
        self.opened: dict[str, tuple[tuple, int]] = {}

    def fit(self, before: int | None, t: int) -> bool:
        """Whether BPE keeps ``t`` whole and apart after ``before``."""
        known = self.fits.get((before, t))
        if known is None:
            if len(self.fits) > 4 * MAX_STATES:
                self.fits.clear()
            first = [] if before is None else [before]
            merged = self.bpe.merge_symbols([x for y in (*first, t) for x in self.as_ids[y]])
            known = self.fits[before, t] = merged == [*first, t]
        return known

    def _known(self, key: tuple) -> int:
        """A state's number; new where it was not met since the last start."""
        state = self.number.get(key)
        if state is None:
            state = self.number[key] = len(self.keys)
            self.keys.append(key)
            self.arcs.append({})
        return state

    def compile(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition of ``state`` on a symbol."""
        last, shift, going = None, 0, []
        for node, before, ahead in self.keys[state]:
            down = self.children[node].get(symbol)
            if down is None:
                continue
            t = self.token[down]
            if t is not None and last is None and self.fit(before, t):
                last, shift = t, ahead + 1
            if self.children[down]:
                going.append((down, before, ahead))
        if symbol >= 256:
            arc = 0, shift  # the word ends
        else:
            # longest first; counts are relative to the new place
            key = (*((node, before, ahead - shift) for node, before, ahead in going), (0, last, 0))
            arc = self._known(key), shift
        self.arcs[state][symbol] = arc
        return arc

    def run(self, word: bytes) -> int:
        """Tokens of one word, by following the transitions from its start to its end."""
        state = total = 0
        arcs = self.arcs
        for b in word[:-1]:
            state, emitted = arcs[state].get(b) or self.compile(state, b)
            total += emitted
        b = 256 + word[-1]
        return total + (arcs[state].get(b) or self.compile(state, b))[1]

    # chunk state maps

    def _feed(self, key: tuple | None, last: int | None, data: bytes) -> tuple[tuple, int, int]:
        """Go on in an open word; its newest byte waits, as it may be the word's end."""
        state = total = 0
        if key is not None:
            state, data = self._known(key), bytes([last]) + data
        for b in data[:-1]:
            state, emitted = self.arcs[state].get(b) or self.compile(state, b)
            total += emitted
        return self.keys[state], data[-1], total

    def close(self, state: tuple) -> int:
        """Tokens still to come where white space or the end follows."""
        kind, key, last = state
        if key is None:
            return self.counts[kind] if kind else 0
        return self._end(key, last)

    def _end(self, key: tuple, last: int) -> int:
        state = self._known(key)
        return (self.arcs[state].get(256 + last) or self.compile(state, 256 + last))[1]

    def advance(self, state: tuple, text: str) -> tuple[tuple, int]:
        """``(state, emitted)`` after ``text``, which has no white space."""
        if not text:
            return state, 0
        kind, key, last = state
        total = 0
        if key is not None:
            more = self.bpe.word_pattern.match(("a" if kind == "L" else "!") + text).group()[1:]
            if more:
                key, last, total = self._feed(key, last, more.encode("utf-8", "replace"))
                text = text[len(more):]
                if not text:
                    return (kind, key, last), total
            total += self._end(key, last)
        else:
            text = kind + text
        words = self.bpe.word_pattern.findall(text)
        ends = words.pop()
        if ends in ("r", "v", "l") and words and words[-1] == "'":
            ends = words.pop() + ends
        counts = self.counts
        total += sum([counts[w] for w in words])
        if ends in ("'", "'r", "'v", "'l"):
            return (ends, None, None), total
        if ends in CONTRACTIONS or unicodedata.category(ends[0])[0] == "N":
            return REST, total + counts[ends]
        key, last, n = self._feed(None, None, ends.encode("utf-8", "replace"))
        return ("L" if ends[0].isalpha() else "O", key, last), total + n

    def chunk_map(self, chunk: str, live: Iterable[tuple] = (REST,)) -> StateMap:
        """The map of one chunk. What stands before its first blank depends on the entry
        state, what follows its last one alone gives the exit state."""
        if SEPARATORS.search(chunk):
            parts = BLANKS.split(chunk)
        else:
            parts = chunk.split()
            if chunk[0].isspace():
                parts.insert(0, "")
            if chunk[-1].isspace():
                parts.append("")
        head = parts[0]
        if len(parts) == 1:
            return StateMap(lambda state: self.advance(state, head), live)
        inner = sum(map(self.counts.__getitem__, parts[1:-1]))
        tail = parts[-1]
        opened = self.opened.get(tail)
        if opened is None:
            opened = self.advance(REST, tail)
            if len(tail) <= MEMO_CHARS:
                self.opened[tail] = opened
        out, n = opened
        inner += n

        def step(state: tuple) -> tuple[tuple, int]:
            if state == REST:  # the head is a whole word
                return out, (self.counts[head] if head else 0) + inner
            state, n = self.advance(state, head)
            return out, n + self.close(state) + inner

        return StateMap(step, live)

    def maps(self, text: str) -> Iterator[StateMap]:
        """The maps of a text's chunks."""
        for i in range(0, len(text), CHUNK):
            live = self.chunk_map(text[max(0, i - LOOK_BACK):i])(REST)[0] if i else REST
            yield self.chunk_map(text[i:i + CHUNK], [live])
            if len(self.keys) > MAX_STATES:
                self._restart()  # states at cuts are spelled out, so maps stay right

    @staticmethod
    def scan(maps: list[StateMap]) -> list[StateMap]:
        """All prefixes' maps; each of the log2(n) rounds combines independent pairs."""
        step = 1
        while step < len(maps):
            maps = maps[:step] + [a.then(b) for a, b in zip(maps, maps[step:])]
            step *= 2
        return maps

    def tokens(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        bpe, total = self.bpe, 0
        special = bpe.special_pattern if bpe.special_pattern is not None and "<" in text else None
        for k, part in enumerate(special.split(text) if special else [text]):
            if k % 2:
                total += 1
            elif part:
                part = bpe.normalise(part)
                state, n = self.scan(list(self.maps(part)))[-1](REST)
                total += n + self.close(state)
        if len(self.keys) > MAX_STATES or len(self.counts) + len(self.opened) > MEMO_WORDS:
            self._restart()
        return total


class _Counts(dict):
    """Piece between blanks -> its tokens, filled by the transducer."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> int:
        t = self.transducer
        words = t.bpe.words(piece)
        n = t.run(piece.encode("utf-8", "replace")) if words == [piece] else sum([self[w] for w in words])
        if len(piece) <= MEMO_CHARS:
            self[piece] = n
        return n


_COMPILED: dict[str, Transducer] = {}


def compiled(spec: str) -> Transducer:
    """One transducer per Python worker and vocabulary."""
    if spec not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[spec] = Transducer(load(spec))
    return _COMPILED[spec]


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; a map without shuffle."""
    spec = shared_text(df.sparkSession, read_vocabulary(vocabulary))
    key = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(spec.value)
        for part in slices(batches, "text"):
            counts = [machine.tokens(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), n_bytes)
    return rows.mapInArrow(run, f"doc_id {key}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
