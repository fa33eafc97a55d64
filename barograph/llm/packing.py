"""Best-fit packing by a configuration linear program over the length histogram.

A sequence of ``size`` tokens is filled by a configuration: how many pieces of each length it takes.  The program
asks for the fewest sequences whose configurations cover the histogram.  Multiplicative weights solve it: every
round prices the lengths, an unbounded knapsack over the capacity finds, for each length that still lacks cover,
the best configuration that holds it, and lengths that are covered become cheaper.  The fractional solution is
rounded down, then up wherever the pieces last, and what is left is placed best-fit, longest first.  The
histogram has at most ``size`` rows and the number of configurations at most rounds * size, so the driver's part
doesn't grow with the data.  A task counts its pieces of each length as it cuts them; the sums of the tasks before it
make that a rank within the length, and the rank gives the sequence and the offset by arithmetic.  Pieces meet those
sums by length and task, so that no key has more rows than a task has pieces, whatever is repeated.

Nulls and edges: null text counts as empty; an empty text still has the closing id.  doc_id may be null or
repeated: each row is packed.  An empty table gives no rows.  Only texts of more than ``size`` ids are cut.
Other columns are not touched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, small_batches, string_column, tidied

ROUNDS = 24
#: Entries that a worker's caches of word ids hold before they are emptied: some 50 MB, which a worker keeps over tasks.
CACHE = 1 << 18
_caches: dict[str, tuple] = {}
#: Letters of ASCII and Latin-1, single digits, other runs: with lower case as the pre-tokenizer of the vocabulary splits a word of these characters.
_PIECES = re.compile("[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_PLAIN = re.compile("[!-&(-~¡-¬®-ÿ]*")


class WordIds(dict):
    """Ids of a word (a run without spaces) as little-endian unsigned 32-bit numbers.

    Ids of a text are those of its words in turn, since the vocabulary drops white space.  Words of ASCII and
    Latin-1 without an apostrophe are lower-cased, split and looked up piece by piece; all others go through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        self.byte = {b: chr(b) if b in keep else chr(next(spare)) for b in range(256)}
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if len(self.pieces) >= CACHE:
            self.pieces.clear()
        if _PLAIN.fullmatch(word):
            out = b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECES.findall(word.lower())])
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = out
        return out

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.byte.__getitem__, piece.encode()))
        self.pieces[piece] = out = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return out


def word_ids(path: str) -> WordIds:
    """This worker's cache for a vocabulary; it lasts over tasks."""
    if path not in _caches:
        _caches[path] = WordIds(path)
    return _caches[path]


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local long"


def _cut(path: str, size: int, end: int):
    special = ("<|startoftext|>", "<|endoftext|>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_ids(path)
        close, step = np.array([end], "<u4").tobytes(), 4 * size
        task, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            row, piece, length, crc, local = [], [], [], [], []
            for i, text in enumerate(string_column(batch, "text").to_pylist()):
                if special[0] in text or special[1] in text:
                    ids = np.array(of.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + close
                else:
                    ids = b"".join(map(of.__getitem__, text.replace("\n", " ").split(" "))) + close
                for p in range(-(-len(ids) // step)):
                    x = ids[p * step : (p + 1) * step]
                    row.append(i)
                    piece.append(p)
                    n = len(x) // 4
                    length.append(n)
                    crc.append(zlib.crc32(x))
                    local.append(seen[n])
                    seen[n] += 1
            p = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(p.astype(np.int32)), pa.array(p * size), pa.array(np.array(length, np.int64)), pa.array(np.array(crc, np.int64)), pa.array(np.full(len(p), task, np.int32)), pa.array(np.array(local, np.int64))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local"])

    return run


# ---------------------------------------------------------------- the linear program


def _knapsack(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity, and the last item taken (-1: one token is left empty)."""
    value, last = np.zeros(size + 1), np.full(size + 1, -1)
    for c in range(1, size + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        value[c] = value[c - 1]
        if n:
            v = value[c - lengths[:n]] + price[:n]
            j = int(v.argmax())
            if v[j] > value[c] + 1e-12:
                value[c], last[c] = v[j], j
    return value, last


def _configurations(lengths: np.ndarray, last: np.ndarray, wanted: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """For each wanted item the configuration that holds it and the best fill of the rest: items, ascending."""
    space = size - lengths[wanted]
    items = [[int(j)] for j in wanted]
    live = np.arange(len(wanted))
    while len(live):
        j = last[space[live]]
        space[live[j < 0]] -= 1
        for r, x in zip(live[j >= 0].tolist(), j[j >= 0].tolist(), strict=True):
            items[r].append(x)
        space[live[j >= 0]] -= lengths[j[j >= 0]]
        live = live[space[live] >= lengths[0]]
    return [tuple(sorted(x)) for x in items]


def solve(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int = ROUNDS, rate: float = 0.7) -> dict[tuple[int, ...], float]:
    """Fractional numbers of configurations (tuples of positions in ascending lengths) by multiplicative weights.

    A round adds up to a 1/rounds share of each length's demand, through the best configuration that holds it, where
    the round's other configurations don't cover it.  A length's price is its size times
    its weight, and the weight falls by exp(-rate * cover beyond the round's share).
    """
    weight, x, covered = np.ones(len(lengths)), {}, np.zeros(len(lengths))
    for r in range(rounds):
        goal = counts * (r + 1) / rounds
        _, last = _knapsack(lengths, weight * lengths, size)
        for c in _configurations(lengths, last, np.flatnonzero(covered < goal)[::-1], size):
            at, k = np.unique(c, return_counts=True)
            short = (goal - covered)[at]
            if (short > 0).sum() * 2 > len(at):  # of no use if most of it is covered meanwhile
                step = float((short / k)[short > 0].min())
                x[c] = x.get(c, 0.0) + step
                covered[at] += step * k
        weight *= np.exp(-rate * np.clip(covered / goal - 1, -1, 1))
        weight /= weight.max()
    return x


def rounded(x: dict[tuple[int, ...], float], lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations that place every piece once: floors, then whole uses while pieces last, then best fit."""
    left, plan = counts.astype(np.int64), {}

    def use(c: tuple[int, ...], most: int) -> None:
        at, k = np.unique(c, return_counts=True)
        if (t := min(most, int((left[at] // k).min()))) > 0:
            left[at] -= t * k
            plan[c] = plan.get(c, 0) + t

    waste = {c: size - int(lengths[list(c)].sum()) for c in x}
    ranked = sorted(x, key=lambda c: (-x[c], waste[c]))
    for c in ranked:
        use(c, int(x[c]))
    for c in sorted(ranked, key=lambda c: (waste[c], -lengths[c[-1]])):
        if waste[c] <= size // 512:
            use(c, int(x[c]) + 1)
    # best fit of what is left, longest first; bins of one state stand together
    room: dict[int, list] = {}
    mask = 0
    for j in range(len(lengths) - 1, -1, -1):
        many, n = int(left[j]), int(lengths[j])
        while many:
            fit = mask >> n
            if not fit:
                per = size // n
                t, k = (many // per, per) if many >= per else (1, many)
                many -= t * k
                c, space = (j,) * k, size - k * n
                room.setdefault(space, []).append([c, t])
                mask |= 1 << space
                continue
            space = n + (fit & -fit).bit_length() - 1
            c, t = room[space].pop()
            if not room[space]:
                mask &= ~(1 << space)
            k = min(space // n, -(-many // t))
            u = min(t, many // k)
            if not u:
                u, k = 1, many
            if t > u:
                room.setdefault(space, []).append([c, t - u])
                mask |= 1 << space
            many -= u * k
            room.setdefault(space - k * n, []).append([c + (j,) * k, u])
            mask |= 1 << (space - k * n)
    for states in room.values():
        for c, t in states:
            c = tuple(sorted(c))
            plan[c] = plan.get(c, 0) + t
    return sorted(plan.items())


def best_plan(lengths: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """The shorter of two roundings of the program's solution: as it is, and scaled to the volume of the pieces.

    The solution covers some lengths more than once; scaled down, more is left to best fit.
    """
    x = solve(lengths, counts, size)
    volume = float((lengths * counts).sum()) / size
    share = min(1.0, volume / max(sum(x.values()), 1e-9))
    plans = [rounded({c: v * s for c, v in x.items()}, lengths, counts, size) for s in (1.0, share)]
    return min(plans, key=lambda p: sum(t for _, t in p))


def slots(plan: list[tuple[tuple[int, ...], int]], lengths: np.ndarray) -> dict[int, np.ndarray]:
    """For each length the places of its pieces by rank: rows (first rank, first sequence, copies in it, first offset)."""
    out: dict[int, list] = {}
    rank, sequence = np.zeros(len(lengths), np.int64), 0
    for c, t in plan:
        offset = 0
        for j, k in zip(*np.unique(c, return_counts=True), strict=True):
            out.setdefault(int(lengths[j]), []).append((rank[j], sequence, k, offset))
            rank[j] += t * k
            offset += int(k * lengths[j])
        sequence += t
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _place(where: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at, w = length == n, where[int(n)]
                s = w[np.searchsorted(w[:, 0], rank[at], "right") - 1]
                by = rank[at] - s[:, 0]
                sequence[at], offset[at] = s[:, 1] + by // s[:, 2], s[:, 3] + by % s[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text), with its sequence and place there."""
    small_batches(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = saved(text.mapInArrow(tidied(_cut(tokenizer, size, end)), _PIECE), "pieces")
    counted = pieces.groupBy("length", "task").agg(F.count("*").alias("k"))
    histogram = counted.groupBy("length").agg(F.sum("k").alias("k")).orderBy("length").toArrow()  # at most ``size`` rows
    lengths, counts = histogram["length"].to_numpy(), histogram["k"].to_numpy()
    plan = best_plan(lengths, counts, size) if len(lengths) else []
    base = counted.withColumn("base", F.sum("k").over(Window.partitionBy("length").orderBy("task")) - F.col("k")).select("length", "task", "base")
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("local"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(slots(plan, lengths)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
