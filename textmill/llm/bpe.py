"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are: their merges
don't reach over the border.  So encoding is a non-deterministic transducer over the vocabulary's
trie: at a node that is a token, either emit it, if it may follow the last one, and go back to the
root, or read on.  Subset construction makes it deterministic: a state is the set of open
alternatives, each with the tokens that it has over the others; tokens on which all agree are
emitted at once, so the lookahead is bounded by the longest token.  States and transitions are made
when first needed and kept in a hash table that numpy reads for many words in step; when the table
outgrows its budget it is emptied and filled anew.

Texts are first cut into pieces by the tokenizer's pattern, and no token reaches over a piece.
Decoding joins token bytes and feeds them to an incremental UTF-8 state machine, which holds back an
unfinished character until its bytes have come.

The vocabulary (a public tokenizer's file of ranks) is a parameter; it is read by the driver and
broadcast after its size is checked.  Defined results: a null text has null tokens; an empty text has
no tokens; any text is encoded whole; bytes that aren't UTF-8 decode to U+FFFD; repeated rows and
null ids are encoded like others; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import U64, column_bytes, keep, mix, row_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Vocabularies are of a fixed size, whatever the corpus; a file beyond this isn't one.
MAX_VOCABULARY_BYTES = 64_000_000
#: Transitions of the transducer, and distinct pieces with their tokens, that a worker keeps.
MAX_TRANSITIONS, MAX_PIECES = 450_000, 200_000
#: Pieces from this length on go through the transducer one by one: side by side they would be too few.
LONG = 1024
_SLICE = 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: more than {MAX_VOCABULARY_BYTES} bytes")
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, raw.splitlines()) if token)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks aren't 0, 1, 2, ...")
    return [t for _, t in pairs]


def merge(word: bytes, rank: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """BPE by definition: join the neighbours of least rank until none can be joined."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = min(((rank.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)))
        if best == 1 << 30 or below is not None and best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """The compiled vocabulary; ``encode`` is its only entry."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        rank = {t: i for i, t in enumerate(tokens)}
        missing = [b for b in range(256) if bytes([b]) not in rank]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.halves = [(i, i) for i in range(len(tokens))]
        self.joined: dict[tuple[int, int], int] = {}
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [True]
        for i, t in enumerate(tokens):
            if len(t) > 1:
                parts = merge(t, rank, i)
                if len(parts) != 2:  # merges never make this token
                    continue
                a, b = rank[parts[0]], rank[parts[1]]
                self.halves[i] = (a, b)
                self.joined[a, b] = i
            node = 0
            for byte in t:
                key = node << 8 | byte
                self.inner[node] = True
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = i
        self.follows: dict[int, bool] = {}
        self.reset()

    def may_follow(self, a: int, b: int) -> bool:
        """Whether [a, b] is the encoding of its bytes.

        The border lies between the right edge of a and the left edge of b.  Undo their merges,
        the latest first; a join over the border that would come before the one undone breaks it.
        """
        key = a << 32 | b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > MAX_PIECES:
                self.follows.clear()
            known = self.follows[key] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        limit = 1 << 30
        while True:
            join = self.joined.get((a, b))
            if join is not None and join < limit:
                return False
            # the later merge of the two edges is undone; where the ranks tie, the left one came first
            left, right = self.halves[a][1], self.halves[b][0]
            open_a, open_b = left != a, right != b
            if open_a and (a > b or not open_b):
                limit, a = a, left
            elif open_b:
                limit, b = b + 1, right
            else:
                return True

    def reset(self) -> None:
        """Forget all states but the first."""
        # a state is a flat tuple of its alternatives: last token, node, number of tokens held, those tokens
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_number: dict[tuple[int, ...], int] = {(): 0}
        self.lengths, self.starts, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.finals = np.zeros(1024, np.int32)
        self.single: dict[int, tuple[int, int]] = {}  # transitions that long pieces took
        self._table(1 << 16)
        self._state([(-1, 0, ())])

    def _table(self, size: int) -> None:
        self.keys = np.zeros(size, np.int64)
        self.targets = np.zeros(size, np.int32)
        self.emits = np.zeros(size, np.int32)
        self.filled = 0

    def _state(self, alternatives: list[tuple[int, int, tuple[int, ...]]]) -> int:
        flat: tuple[int, ...] = ()
        for last, node, rest in alternatives:
            flat += (last, node, len(rest), *rest)
        found = self.number.get(flat)
        if found is None:
            found = self.number[flat] = len(self.states)
            self.states.append(flat)
            if found >= len(self.finals):
                self.finals = np.concatenate([self.finals, np.zeros_like(self.finals)])
            # at the end of a word the alternative at the root holds
            self.finals[found] = self._output(next(rest for _, node, rest in alternatives if node == 0))
        return found

    def _output(self, tokens: tuple[int, ...]) -> int:
        found = self.output_number.get(tokens)
        if found is None:
            found = self.output_number[tokens] = len(self.outputs)
            self.outputs.append(tokens)
        return found

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        flat, child, tokens, inner = self.states[state], self.child, self.token, self.inner
        open_, i = [], 0
        while i < len(flat):
            last, node, held = flat[i : i + 3]
            rest = flat[i + 3 : i + 3 + held]
            i += 3 + held
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            token = tokens[to]
            if token >= 0 and (last < 0 or self.may_follow(last, token)):
                open_.append((token, 0, (*rest, token)))
            if inner[to]:
                open_.append((last, to, rest))
        common = open_[0][2]
        for _, _, rest in open_[1:]:
            n = min(len(common), len(rest))
            while common[:n] != rest[:n]:
                n -= 1
            common = common[:n]
        n = len(common)
        if n:
            open_ = [(last, node, rest[n:]) for last, node, rest in open_]
        open_.sort()
        return self._state(open_), self._output(common)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the empty slot where it belongs."""
        mask = len(self.keys) - 1
        slot = (mix(keys.view(U64)) & U64(mask)).astype(np.int64)
        seek = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != 0))
        while len(seek):
            slot[seek] = slot[seek] + 1 & mask
            at = slot[seek]
            seek = seek[(self.keys[at] != keys[seek]) & (self.keys[at] != 0)]
        return slot

    def _move(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (state.astype(np.int64) << 8 | byte) + 1
        slot = self._find(keys)
        new = np.unique(keys[self.keys[slot] == 0])
        if len(new):
            while 2 * (self.filled + len(new)) > len(self.keys):
                old = self.keys, self.targets, self.emits
                live = np.flatnonzero(old[0])
                self._table(2 * len(self.keys))
                self._insert(*(x[live] for x in old))
            made = [self._step(int(k) - 1 >> 8, int(k) - 1 & 255) for k in new]
            self._insert(new, *(np.array(x, np.int32) for x in zip(*made)))
            slot = self._find(keys)
        return self.targets[slot], self.emits[slot]

    def _insert(self, keys: np.ndarray, targets: np.ndarray, emits: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            slot = self._find(keys[left])
            _, first = np.unique(slot, return_index=True)  # one key for each empty slot at a time
            put = left[first]
            self.keys[slot[first]], self.targets[slot[first]], self.emits[slot[first]] = keys[put], targets[put], emits[put]
            left = np.delete(left, first)
        self.filled += len(keys)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, number of tokens of each)."""
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        lo = 0
        while lo < len(order):
            width = max(1, int(sizes[order[lo]]))
            if width >= LONG:
                tokens = self._encode_long(words[order[lo]])
                counts[order[lo]] = len(tokens)
                parts.append((order[lo : lo + 1], tokens))
                lo += 1
                continue
            # words of like length, in a matrix of bounded size
            hi = min(len(order), lo + max(1, (1 << 19) // width))
            if self.filled + len(self.single) > MAX_TRANSITIONS:
                self.reset()
            parts.append((order[lo:hi], self._encode([words[i] for i in order[lo:hi]], sizes[order[lo:hi]], counts, order[lo:hi])))
            lo = hi
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for own, tokens in parts:
            n = counts[own]
            out[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(len(tokens))] = tokens
        return out, counts

    def _encode_long(self, word: bytes) -> np.ndarray:
        out: list[int] = []
        state, single, outputs = 0, self.single, self.outputs
        for byte in word:
            key = state << 8 | byte
            step = single.get(key)
            if step is None:
                if len(single) > MAX_TRANSITIONS:
                    single.clear()
                step = single[key] = self._step(state, byte)
            state, emitted = step
            if emitted:
                out += outputs[emitted]
        return np.array([*out, *outputs[self.finals[state]]], np.int32)

    def _encode(self, words: list[bytes], sizes: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        n, width = len(words), int(sizes[0])
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        emitted = np.zeros((n, width + 1), np.int32)
        state = np.zeros(n, np.int32)
        for j in range(width):
            m = int(np.searchsorted(-sizes, -j, "left"))  # the first m words are longer than j
            state[:m], emitted[:m, j] = self._move(state[:m], flat[begin[:m] + j])
        emitted[:, width] = self.finals[state]
        row, _ = np.nonzero(emitted)
        output = emitted[emitted != 0]
        if len(self.outputs) > len(self.lengths):
            new = self.outputs[len(self.lengths) :]
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, new), np.int64, len(new))])
            self.values = np.concatenate([self.values, np.array([x for t in new for x in t], np.int32)])
            self.starts = np.cumsum(self.lengths) - self.lengths
        size = self.lengths[output]
        counts[own] = np.bincount(row, size, n).astype(np.int64)
        return self.values[np.repeat(self.starts[output] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Encoder:
    """Texts to tokens, with a memory of pieces already seen."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.transducer = Transducer(tokens)
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.tokens = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, number of tokens of each)."""
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            pieces += self.split(text)
            ends.append(len(pieces))
        if len(self.ids) > MAX_PIECES:
            self.forget()
        ids = self.ids
        new = [p for p in set(pieces) if p not in ids]
        if new:
            tokens, counts = self.transducer.encode([p.encode("utf-8", "surrogatepass") for p in new])
            ids.update(zip(new, range(len(ids), len(ids) + len(new))))
            self.begin = np.concatenate([self.begin, len(self.tokens) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.tokens = np.concatenate([self.tokens, tokens])
        at = np.fromiter(map(ids.__getitem__, pieces), np.int64, len(pieces))
        size = self.count[at]
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.tokens[np.repeat(self.begin[at] - total[:-1], size) + np.arange(int(total[-1]))]
        return out, np.diff(total[np.array(ends)])


def _utf8_table() -> np.ndarray:
    """next[state][byte]: 0 accepts, 1 rejects; the others wait for that many or special continuations."""
    table = np.ones((9, 256), np.uint8)
    table[0, :128] = 0
    table[0, 0xC2:0xE0] = 2  # one more
    table[0, 0xE1:0xF0] = 3  # two more
    table[0, 0xE0], table[0, 0xED] = 4, 5
    table[0, 0xF0], table[0, 0xF1:0xF4], table[0, 0xF4] = 6, 7, 8
    table[2, 0x80:0xC0] = 0
    table[3, 0x80:0xC0] = 2
    table[4, 0xA0:0xC0] = 2  # no overlong form
    table[5, 0x80:0xA0] = 2  # no surrogate
    table[6, 0x90:0xC0] = 3
    table[7, 0x80:0xC0] = 3
    table[8, 0x80:0x90] = 3  # not above U+10FFFF
    return table


_UTF8 = _utf8_table().tolist()


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the characters that are complete, ``end`` what is left."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        # only the last three bytes can belong to an unfinished character: run the machine on them
        cut = len(data)
        for start in range(len(data) - 1, max(-1, len(data) - 4), -1):
            if data[start] & 0xC0 != 0x80:
                state = 0
                for byte in data[start:]:
                    state = _UTF8[state][byte]
                if state > 1:
                    cut = start
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        left, self.held = self.held, b""
        return left.decode("utf-8", "replace")


def decode_stream(tokens: Iterable[int], vocabulary: list[bytes], chunk: int = 4096) -> Iterator[str]:
    """Text of a stream of tokens, in parts; ids outside the vocabulary decode to nothing."""
    stream, held = Utf8Stream(), []
    size = len(vocabulary)
    for token in tokens:
        if 0 <= token < size:
            held.append(vocabulary[token])
        if len(held) == chunk:
            yield stream.feed(b"".join(held))
            held = []
    yield stream.feed(b"".join(held))
    yield stream.end()


def _share(df: DataFrame, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(tuple(read_ranks(vocabulary)))


def _lists(offsets: np.ndarray, values: np.ndarray, null: np.ndarray) -> pa.Array:
    bits = None if not null.any() else pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.list_(pa.int32()), len(null), [bits, pa.py_buffer(offsets.astype(np.int32))], children=[pa.array(values, pa.int32())])


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): whether decoding the tokens gives the text again."""
    shared = _share(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_ = shared.value
        encoder = keep(("bpe", hash(tokens_)), lambda: Encoder(list(tokens_)))
        table = list(tokens_)
        for batch in batches:
            column = batch.column("text")
            _, offsets = column_bytes(column)
            for lo, hi in row_slices(offsets, _SLICE):
                texts = column.slice(lo, hi - lo).to_pylist()
                null = np.array([t is None for t in texts])
                values, counts = encoder.encode([t or "" for t in texts])
                ends = np.concatenate([[0], np.cumsum(counts)])
                every = values.tolist()
                same = [t is not None and "".join(decode_stream(every[a:b], table)) == t for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist())]
                columns = [batch.column("doc_id").slice(lo, hi - lo), _lists(ends, values, null), pa.array(counts, pa.int64(), mask=null), pa.array(same, pa.bool_(), mask=null)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tokens", "n_tokens", "round_trip"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, tokens array<int>, n_tokens bigint, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens); null tokens decode to null."""
    shared = _share(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if t is None else "".join(decode_stream((x for x in t if x is not None), table)) for t in part.column("tokens").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "tokens").mapInArrow(run, f"doc_id {id_type}, text string")
