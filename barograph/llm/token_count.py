"""Token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the mark of its leading space.  The best segmentation of a pre-token maximises the sum
of its pieces' log-probabilities; the forward score of a prefix depends on the prefix alone, so distinct
pre-tokens are inserted in a trie and each node's score is computed once for all words that share it.  A node
stores the score and the number of tokens of the best segmentation up to it; at a word's end that is its count.
Of equal scores the one with fewer tokens counts.

The pieces are those of a public vocabulary; log-probabilities follow its order by Zipf's law, -ln(rank + 2) in
units of 2**-20, since that file has ranks only.  A byte that no piece covers is a token of its own, with a score
below every piece's.

The trie's symbols are UTF-8 bytes.  Sorted words share prefixes with their neighbours, so that one comparison a
level gives the nodes; a trie of reversed pieces, walked back from each node, ends the search for pieces early; the
recurrence then runs level by level.  Words of a block of texts are inserted unless a worker still holds their
counts, in groups of ``GROUP_WORDS``; neither bound changes a count.  Words of more than ``LONG_BYTES`` go through
the same recurrence without a trie, in chunks.  There is no shuffle.

Nulls and edges: null and empty texts count 0 tokens and 0 words; an empty table gives no rows.  Null and repeated
doc_id are kept: one row for each row.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, string_column

MARK = "▁".encode()
UNIT = 1 << 20
#: Bytes of text whose words are told apart at once, unless a batch or document is longer.
BLOCK_BYTES = 16_000_000
#: Words inserted in one trie.
GROUP_WORDS = 50_000
#: Words whose counts a worker holds: these last ones, and as many before them.
HELD_WORDS = 1 << 18
LONG_BYTES = 1000
_loaded: dict[str, "Counter"] = {}


def unigram(path: str) -> dict[bytes, int]:
    """Pieces of a sentencepiece model and their log-probabilities; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return {p.id_to_piece(i).encode(): -round(math.log(rank + 2) * UNIT) for rank, i in enumerate(ids)}


class Pieces:
    """A trie of reversed pieces: (state, byte before) to the longer state, in a hash table; value 0 is no piece."""

    def __init__(self, pieces: dict[bytes, int]):
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0) - 10 * UNIT
        edges: dict[int, int] = {}
        value = [0]
        for piece, score in pieces.items():
            state = 0
            for b in reversed(piece):
                key = state << 8 | b
                state = edges.get(key, 0)
                if not state:
                    state = edges[key] = len(value)
                    value.append(0)
            value[state] = score
        self.value = np.array(value, np.int64)
        self.bits = max(4, (4 * len(edges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.states = np.zeros(1 << self.bits, np.int64)
        keys, states = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.states[at[first]] = keys[first], states[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, states, at = keys[rest], states[rest], (at[rest] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one more byte to the left, 0 where no piece ends so."""
        key = state << 8 | byte
        out, at, open_ = np.zeros(len(key), np.int64), self._slot(key), np.arange(len(key))
        while len(open_):
            there = self.keys[at]
            hit = there == key[open_]
            out[open_[hit]] = self.states[at[hit]]
            on = ~hit & (there >= 0)
            open_, at = open_[on], (at[on] + 1) % len(self.keys)
        return out

    def ending(self, text: np.ndarray, ends: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece that ends at one of ``ends`` and is no longer than its depth: which end, length, score."""
        found = []
        alive, state = np.arange(len(ends)), np.zeros(len(ends), np.int64)
        for k in range(1, self.longest + 1):
            inside = depth[alive] >= k
            alive, state = alive[inside], state[inside]
            state = self.step(state, text[ends[alive] - k].astype(np.int64))
            alive, state = alive[state > 0], state[state > 0]
            if not len(alive):
                break
            score = self.value[state]
            hit = score != 0
            found.append((alive[hit], np.full(int(hit.sum()), k), score[hit]))
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Counter:
    """Words to token counts."""

    def __init__(self, pieces: dict[bytes, int], held: int = HELD_WORDS, group: int = GROUP_WORDS, long: int = LONG_BYTES):
        self.pieces, self.most, self.group, self.long = Pieces(pieces), held, group, long
        self.last: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Token counts of distinct words, without their marks; 0 of an empty one."""
        last, before, new = self.last, self.before, []
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            n = last.get(w)
            if n is None:
                n = before.get(w)
                if n is None:
                    new.append(i)
                    continue
                last[w] = n
            out[i] = n
        short = sorted((MARK + words[i], i) for i in new if 0 < len(words[i]) <= self.long)
        for a in range(0, len(short), self.group):
            part = short[a : a + self.group]
            out[[i for _, i in part]] = self._trie([w for w, _ in part])
        for i in new:
            n = len(words[i])
            if not n:
                out[i] = 0
            elif n > self.long:
                out[i] = self._alone(MARK + words[i])
            else:
                last[words[i]] = int(out[i])
        if len(last) > self.most:
            self.before, self.last = last, {}
        return out

    def _trie(self, words: list[bytes]) -> np.ndarray:
        """Token counts of sorted distinct words: a trie, and one forward score a node."""
        n = len(words)
        text = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        slot = start + np.arange(n)  # of a word's root in ``node``; that of its prefix of d bytes is d further
        node = np.zeros(len(text) + n, np.int64)
        owners, first, total = [], [1], 1
        live, parent, d = np.arange(n), np.zeros(n, np.int64), 0
        while True:
            longer = size[live] > d
            live, parent = live[longer], parent[longer]
            if not len(live):
                break
            c = text[start[live] + d]
            new = np.ones(len(live), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (c[1:] != c[:-1])
            parent = total - 1 + np.cumsum(new)
            d += 1
            node[slot[live] + d] = parent
            owners.append(live[new])
            total += len(owners[-1])
            first.append(total)
        word = np.concatenate(owners)
        depth = np.repeat(np.arange(1, d + 1), [len(x) for x in owners])
        which, length, score = self.pieces.ending(text, start[word] + depth, depth)
        every = np.arange(len(word))
        which, length = np.r_[every, which], np.r_[np.ones(len(word), np.int64), length]
        # a score and a number of tokens as one number: words are shorter than 4096 bytes
        gain = np.r_[np.full(len(word), self.pieces.byte), score] * 4096 - 1
        order = np.argsort(which, kind="stable")
        which, gain = which[order], gain[order]
        source = node[slot[word[which]] + depth[which] - length[order]]
        begin = np.searchsorted(which, every)
        best = np.zeros(total, np.int64)
        for a, b in zip(first, first[1:], strict=False):  # nodes of one level
            i, j = begin[a - 1], begin[b - 1] if b - 1 < len(begin) else len(which)
            best[a:b] = np.maximum.reduceat(best[source[i:j]] + gain[i:j], begin[a - 1 : b - 1] - i)
        return -best[node[slot + size]] % 4096

    def _alone(self, word: bytes, chunk: int = 1 << 16) -> int:
        """Token count of one long word."""
        back, byte = self.pieces.longest, (self.pieces.byte << 40) - 1
        best = [0]  # of the last prefixes
        for a in range(0, len(word), chunk):
            from_ = max(0, a - back)
            text = np.frombuffer(word[from_ : a + chunk], np.uint8)
            ends = np.arange(a + 1, min(a + chunk, len(word)) + 1)
            which, length, score = self.pieces.ending(text, ends - from_, np.minimum(ends, back))
            pieces: list[list] = [[] for _ in ends]
            for e, k, s in zip(which.tolist(), length.tolist(), score.tolist(), strict=True):
                pieces[e].append((k, s))
            for ps in pieces:
                best.append(max([best[-1] + byte, *[best[-k] + (s << 40) - 1 for k, s in ps]]))
            del best[:-back]
        return -best[-1] % (1 << 40)


def _block(counter: Counter, text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Words and tokens of each row."""
    split = pc.ascii_split_whitespace(text)
    coded = split.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    ids = coded.indices.to_numpy()
    full = np.array([len(w) > 0 for w in distinct], bool)
    bounds = split.offsets.to_numpy().astype(np.int64)
    out = []
    for per_word in (full.astype(np.int64), counter.counts(distinct)):
        sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(per_word[ids], out=sums[1:])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1]


def _count(path: str):
    def counted(counter: Counter, batches: list[pa.RecordBatch], texts: list[pa.StringArray]) -> Iterator[pa.RecordBatch]:
        words, tokens = _block(counter, pa.concat_arrays(texts))
        a = 0
        for batch in batches:
            b = a + len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words[a:b]), pa.array(tokens[a:b])], ["doc_id", "n_words", "n_tokens"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Counter(unigram(path))
        held, texts, size = [], [], 0
        for batch in batches:
            held.append(batch)
            texts.append(string_column(batch, "text"))
            size += texts[-1].nbytes
            if size >= BLOCK_BYTES:
                yield from counted(_loaded[path], held, texts)
                held, texts, size = [], [], 0
        if held:
            yield from counted(_loaded[path], held, texts)

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_count(vocabulary), "doc_id long, n_words long, n_tokens long")
