"""Chroma fingerprints of audio columns, and alignment of recordings.

A recording is 8-bit unsigned PCM.  Overlapping windowed frames go through a Fourier transform whose energy is
summed into twelve pitch classes.  Sixteen filters compare regions of frames by pitch classes, with sums from an integral image;
each response is quantised to two bits in Gray code, and the sixteen make one packed 32-bit integer a frame.

Two recordings are aligned by the offsets of their equal integers: offsets with enough of them are tested by the share
of differing bits over the whole overlap, those with most first, until one passes; among equally many the smaller share
of differing bits wins, then the smaller offset.  Integers that both repeat often, as in silence or a steady tone, are
counted for all offsets at once by a Fourier transform of their places, and so are the differing bits of a pair whose
first ``TESTS`` offsets fail, so that no pair costs the product of its lengths.  A stated set of query recordings is aligned with all rows: queries go out in
blocks of at most ``block`` integers, whatever the size of the table, and each row comes once for every class of
queries that it aligns with.  Queries of one and the same fingerprint form a class, which stands in the result by its
smallest id other than the row's own; ``all_pairs`` puts every member in its place, so that none is lost.

Nulls and edges: null, empty and too short recordings (under FRAME + (SPAN - 1) * HOP samples) have no integers and are
aligned with nothing.  A row that is aligned with nothing comes once, with nulls.  A null id is no query; repeated
rows are rows.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, small_batches

RATE, FRAME, HOP = 8000, 256, 48
#: Frames that the widest filter spans.
SPAN = 16
LOW, HIGH, A4 = 100.0, 3600.0, 440.0
#: Response beyond which the outer two of four levels begin.
LEVEL = 0.12
#: Equal integers at one offset (all of the shorter side, where it has fewer), and share of differing bits, that an alignment needs.
LEAST_VOTES, MOST_ERROR = 4, 0.35
#: Pairs of equal integers that one step holds.
PAIRS = 1_000_000
#: Pairs of places of one integer that are counted one by one, for each frame of both recordings and beside it.
PAIRS_FRAME, PAIRS_LEAST = 4, 4096
#: Offsets of a pair that are tested one by one.
TESTS = 16


def pitch_classes() -> np.ndarray:
    """(bins, 12): the pitch class of each bin of the transform, for tones from LOW to HIGH."""
    f = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(f), 12), np.float32)
    use = np.flatnonzero((f >= LOW) & (f <= HIGH))
    out[use, np.round(12 * np.log2(f[use] / A4)).astype(int) % 12] = 1
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) by rule: four kinds at four places and widths."""
    return [(kind, (3 * i + kind) % 10, 2 + (i + kind) % 2, SPAN >> (i + kind) % 3) for i in range(4) for kind in range(4)]


_CLASSES, _HANN = pitch_classes(), np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) energies, each frame's sum being 1 (or 0 in silence)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12), np.float32)
    x = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP].astype(np.float32)
    x -= x.mean(1, keepdims=True)
    x *= _HANN
    z = np.fft.rfft(x, axis=1)
    e = (z.real**2 + z.imag**2).astype(np.float32) @ _CLASSES
    return e / np.maximum(e.sum(1, keepdims=True), 1e-9)


def packed(c: np.ndarray) -> np.ndarray:
    """The packed integers of a chroma image."""
    n = len(c) - SPAN + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    np.cumsum(np.cumsum(c, 0, dtype=float), 1, out=image[1:, 1:])
    out = np.zeros(n, np.uint32)

    def area(t: int, w: int, a: int, k: int) -> np.ndarray:
        """Sums over frames t..t+w of each position and classes a..a+k."""
        return image[t + w : t + w + n, a + k] - image[t : t + n, a + k] - image[t + w : t + w + n, a] + image[t : t + n, a]

    for kind, a, k, w in filters():
        h = w // 2
        if kind == 0:  # earlier against later
            x, y = area(0, h, a, k), area(h, h, a, k)
        elif kind == 1:  # lower against higher classes
            x, y = area(0, w, a, k // 2), area(0, w, a + k // 2, k - k // 2)
        elif kind == 2:  # crosswise
            x = area(0, h, a, k // 2) + area(h, h, a + k // 2, k - k // 2)
            y = area(h, h, a, k // 2) + area(0, h, a + k // 2, k - k // 2)
        else:  # middle against both ends
            q = w // 4
            x, y = area(q, w - 2 * q, a, k), area(0, q, a, k) + area(w - q, q, a, k)
        r = np.log((x + 0.01 * w) / (y + 0.01 * w))
        level = (r > -LEVEL).astype(np.uint32) + (r > 0) + (r > LEVEL)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("audio"))
        prints = [packed(chroma(np.frombuffer(b.as_buffer(), np.uint8))) if b.is_valid else np.empty(0, np.uint32) for b in col]
        raw = [x.astype("<u4").tobytes() for x in prints]
        names = [hashlib.blake2b(r, digest_size=16).hexdigest() if r else None for r in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in prints], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(names, pa.string()), pa.array([x.view(np.int32) for x in prints], pa.list_(pa.int32()))], ["id", "n_items", "items_crc32", "fingerprint", "items"])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """id, n_items, items_crc32, fingerprint, items of every row of ``recordings`` (id, audio).

    fingerprint: a 128-bit digest of the integers, null where there are none.
    """
    small_batches(recordings.sparkSession)
    own = recordings.select(F.col("id").cast("long").alias("id"), F.col("audio").cast("binary").alias("audio"))
    return own.mapInArrow(_prints, "id long, n_items long, items_crc32 long, fingerprint string, items array<int>")


class Queries:
    """Query fingerprints of one block, in the order of their integers; a second id of None: the class has no other."""

    def __init__(self, first: list[int], second: list[int | None], names: list[str], items: list[np.ndarray]):
        self.first, self.second, self.names, self.items = first, second, names, items
        flat = np.concatenate(items)
        order = np.argsort(flat, kind="stable")
        self.value = flat[order]
        self.length = np.array([len(x) for x in items])
        self.owner = np.repeat(np.arange(len(items)), self.length)[order]
        self.place = np.concatenate([np.arange(len(x)) for x in items])[order]

    def votes(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, offset, number of equal integers, wherever these are enough: by query, then most first, then by offset."""
        value, inverse, times = np.unique(items, return_inverse=True, return_counts=True)
        lo, hi = np.searchsorted(self.value, value, "left"), np.searchsorted(self.value, value, "right")
        often = times * (hi - lo) > PAIRS_LEAST
        span = 1 << 31
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def add(query, offset, n) -> None:
            nonlocal keys, counts
            keys, at = np.unique(np.r_[keys, query * (2 * span) + offset + span], return_inverse=True)
            counts = np.bincount(at, np.r_[counts, n]).astype(np.int64)

        some = np.flatnonzero(~often[inverse])
        first, many = lo[inverse[some]], (hi - lo)[inverse[some]]
        upto = np.cumsum(many)
        a = 0
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            m = many[a:b]
            if m.any():
                at = np.repeat(first[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                k, c = np.unique(self.owner[at] * (2 * span) + np.repeat(some[a:b], m) - self.place[at] + span, return_counts=True)
                add(k // (2 * span), k % (2 * span) - span, c)
            a = b
        # integers with many pairs, query by query: either few there, or counted for all offsets at once
        whole: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i in np.flatnonzero(often):
            mine, owner, place = np.flatnonzero(inverse == i), self.owner[lo[i] : hi[i]], self.place[lo[i] : hi[i]]
            for at in np.split(np.arange(len(owner)), np.flatnonzero(owner[1:] != owner[:-1]) + 1):
                q = int(owner[at[0]])
                if len(mine) * len(at) > PAIRS_FRAME * (len(items) + self.length[q]) + PAIRS_LEAST:
                    whole.setdefault(q, []).append((mine, place[at]))
                else:
                    k, c = np.unique((mine[:, None] - place[at][None]).ravel(), return_counts=True)
                    add(q, k, c)
        for q, both in whole.items():
            n = correlation(((_marks(x, len(items)), _marks(y, int(self.length[q]))) for x, y in both), len(items), int(self.length[q]))
            at = np.flatnonzero(n)
            add(q, at - self.length[q] + 1, n[at])
        query, offset = keys // (2 * span), keys % (2 * span) - span
        enough = counts >= np.minimum(np.minimum(LEAST_VOTES, len(items)), self.length[query])
        query, offset, counts = query[enough], offset[enough], counts[enough]
        order = np.lexsort((offset, -counts, query))
        return query[order], offset[order], counts[order]

    def align(self, own: int | None, items: np.ndarray) -> list[tuple]:
        """(query id, query fingerprint, offset, votes, share of differing bits) of each class that aligns with the row."""
        found = []
        if not len(items):
            return found
        query, offset, votes = self.votes(items)
        at = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.empty(0, np.int64)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(query)], strict=False):
            q = int(query[a])
            i = self.second[q] if self.first[q] == own else self.first[q]
            best = None if i is None else best_offset(items, self.items[q], offset[a:b], votes[a:b])
            if best:
                found.append((i, self.names[q], *best))
        return found


def _marks(places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    out[places] = 1
    return out


def correlation(pairs, n: int, m: int) -> np.ndarray:
    """Sums over pairs (x of n, y of m) of x[i] * y[i - offset], rounded to whole numbers: for offsets 1 - m .. n - 1."""
    size = 1 << (n + m - 1).bit_length()
    total = np.zeros(size // 2 + 1, complex)
    for x, y in pairs:
        total += np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size))
    out = np.rint(np.fft.irfft(total, size)).astype(np.int64)
    return np.r_[out[size - m + 1 :], out[:n]]


def best_offset(items: np.ndarray, other: np.ndarray, offset: np.ndarray, votes: np.ndarray) -> tuple[int, int, float] | None:
    """Offset, votes and share of differing bits: of the offsets that pass those with most votes, then the smallest share."""
    best = None
    for o, v in zip(offset[:TESTS].tolist(), votes[:TESTS].tolist(), strict=True):
        if best and v < best[1]:
            return best
        x, y = items[max(o, 0) : len(other) + o], other[max(-o, 0) : len(items) - o]
        error = float(np.bitwise_count(x ^ y).sum()) / (32 * len(x))
        if error <= MOST_ERROR and (best is None or error < best[2]):
            best = o, v, error
    offset, votes = offset[TESTS:], votes[TESTS:]
    if not len(offset) or best and votes[0] < best[1]:
        return best
    signs = lambda x, b: 1.0 - 2.0 * (x >> np.uint32(b) & np.uint32(1))
    same = correlation(((signs(items, b), signs(other, b)) for b in range(32)), len(items), len(other))
    bits = 32 * (np.minimum(len(other) + offset, len(items)) - np.maximum(offset, 0))
    error = (bits - same[offset + len(other) - 1]) / 2 / bits
    fits = np.flatnonzero(error <= MOST_ERROR)
    if len(fits):
        fits = fits[votes[fits] == (best[1] if best else votes[fits[0]])]
    if len(fits):
        k = fits[np.argmin(error[fits])]
        if best is None or error[k] < best[2]:
            best = int(offset[k]), int(votes[k]), float(error[k])
    return best


#: Columns of a row, and of its alignment.
ROW = ("id", "n_items", "items_crc32", "fingerprint")
PAIR = {"query_id": "long", "query_fingerprint": "string", "offset": "long", "votes": "long", "bit_error": "double"}
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
#: Alignments that one Arrow batch of the result holds, unless a single row has more.
OUT_ROWS = 50_000


def _align(queries: Queries, lone: bool):
    """lone: rows that align with nothing come too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(batch.schema.get_field_index("items"))
            at, flat = items.offsets.to_numpy(), items.values.to_numpy(zero_copy_only=False).view(np.uint32)
            rows, found = [], []

            def out(batch=batch, rows=rows, found=found):
                take = pa.array(rows, pa.int64())
                own = [batch.column(batch.schema.get_field_index(c)).take(take) for c in ROW]
                return pa.RecordBatch.from_arrays([*own, *(pa.array([f[k] for f in found], t) for k, t in enumerate(_TYPES))], [*ROW, *PAIR])

            for k, i in enumerate(batch.column(batch.schema.get_field_index("id")).to_pylist()):
                pairs = queries.align(i, flat[at[k] : at[k + 1]])
                if lone and not pairs:
                    pairs = [(None,) * len(PAIR)]
                rows += [k] * len(pairs)
                found += pairs
                if len(rows) >= OUT_ROWS:
                    yield out()
                    rows.clear()
                    found.clear()
            yield out()

    return run


def align_recordings(recordings: DataFrame, is_query: Column, block: int = 1 << 21) -> DataFrame:
    """id, n_items, items_crc32, fingerprint, query_id, query_fingerprint, offset, votes, bit_error: one row for each row
    of ``recordings`` (id, audio) and class of queries that aligns with it, and one for each row without any.

    is_query: which rows are queries, by ``id``.  offset: the row's frame at which the query's first frame stands.
    """
    prints = saved(fingerprints(recordings), "prints")
    asked = prints.where(F.coalesce(is_query, F.lit(False)) & F.col("id").isNotNull() & (F.col("n_items") > 0)).select("id", "fingerprint", "items").distinct()
    two = asked.groupBy("items").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.first("fingerprint").alias("fingerprint"))
    # the second smallest id of a class: the smallest beyond the first
    more = asked.join(two.where("first <> last").select(F.col("items").alias("i"), "first"), (F.col("items") == F.col("i")) & (F.col("id") > F.col("first"))).groupBy("items").agg(F.min("id").alias("second"))
    classes = two.join(more, "items", "left").select("first", "second", "fingerprint", "items")
    total = asked.agg(F.sum(F.size("items"))).first()[0] or 0
    blocks = 1 if total <= block else -(-2 * total // block)
    if blocks > 1:
        classes = saved(classes, "classes")
    results = []
    schema = ", ".join(["id long, n_items long, items_crc32 long, fingerprint string", *(f"{c} {t}" for c, t in PAIR.items())])
    for b in range(blocks):
        rows = classes.where(F.pmod(F.xxhash64("fingerprint"), F.lit(blocks)) == b).orderBy("first", "fingerprint").toArrow()
        if not rows.num_rows:
            continue
        items = rows["items"].combine_chunks()
        at, flat = items.offsets.to_numpy(), items.values.to_numpy().view(np.uint32)
        held = Queries(rows["first"].to_pylist(), rows["second"].to_pylist(), rows["fingerprint"].to_pylist(), [flat[at[k] : at[k + 1]] for k in range(len(items))])
        found = prints.mapInArrow(_align(held, blocks == 1), schema)
        results.append(found if blocks == 1 else saved(found, "aligned"))
    if not results:
        return prints.select(*ROW, *(F.lit(None).cast(t).alias(c) for c, t in PAIR.items()))
    if blocks == 1:
        return results[0]
    every = results[0]
    for r in results[1:]:
        every = every.unionAll(r)
    # rows of equal id and fingerprint have the same alignments
    some = every.select(F.col("id").alias("i"), F.col("fingerprint").alias("f")).distinct()
    lone = prints.join(some, F.col("id").eqNullSafe(F.col("i")) & F.col("fingerprint").eqNullSafe(F.col("f")), "left_anti")
    return every.unionAll(lone.select(*ROW, *(F.lit(None).cast(t).alias(c) for c, t in PAIR.items())))


def all_pairs(aligned: DataFrame, is_query: Column) -> DataFrame:
    """The rows of ``align_recordings`` that have an alignment, once for each single query: members in place of classes."""
    members = aligned.where(F.coalesce(is_query, F.lit(False)) & F.col("id").isNotNull() & F.col("fingerprint").isNotNull())
    members = members.select(F.col("fingerprint").alias("query_fingerprint"), F.col("id").alias("member")).distinct()
    pairs = aligned.join(members, "query_fingerprint").where(~F.col("member").eqNullSafe(F.col("id")))
    return pairs.withColumn("query_id", F.col("member")).select(*aligned.columns)
