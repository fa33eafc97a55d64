"""Stupid-backoff scores of documents under the corpus' own n-gram counts, computed relationally.

A document is scored by the counts of all others: its own occurrences are taken off, so that a text isn't found
likely because it is there.  A word after a context scores count(context word) / count(context) where other documents
have that n-gram; else backoff times its score after a context one word shorter, down to count(word) / words; a word
that no other document has scores backoff / words there (words: those of the other documents, at least 1).  Marks
stand before the first word.  The document's score is the mean natural logarithm over its words.

Texts are exploded to distinct n-grams of the highest ``order`` with their counts in the document; numpy does this for
each batch and sends 64-bit hashes.  The count table of these n-grams, partitioned by hash, is joined to the exploded
ones, without what is there once; then each needs one count of the next lower order, that of its context where it was found, else of its last
words, and so on down to single words.  Logarithms are summed for each document.  n-grams of the highest order are
handled in ``slices`` of the hash space, each shuffled and reduced by itself, which bounds the disk that shuffles
take; every slice reads the texts again.

No key is one task's: lower n-grams that make up more than a ``hot`` share, so fewer than 1 / hot, are joined by
broadcast, others by a shuffle.  n-grams of the highest order that make up more than a ``share``-th, so fewer than
``share``, are counted beforehand, as all their words are as frequent; each worker holds their counts, and their rows
go through the exchange by document with what they need.

Nulls and edges: null, empty and blank texts have 0 words and a null score.  Rows that share a doc_id, null too,
count as other documents to each other and share one score, the mean over the words of all of them.  An only
document backs off everywhere.  An empty table gives no rows.  Other columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mixed, raw, saved, small_batches, steps, string_column, word_hashes

#: Stands before a text's first word: no hash of a word, but for a chance of 2**-64 each.
FIRST = np.uint64(0x5BD1E995)
#: n-grams kept before they are counted off.
SEGMENT = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, where each new key starts in it, and how often each is there."""
    order = np.argsort(key)
    k = key[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return order, at, np.diff(np.r_[at, len(k)])


def _longer(before: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n-grams from those of their first n - 1 words and the last one."""
    with np.errstate(over="ignore"):
        return mixed(before * _ODD + word, n + 3)


def _marks(n: int) -> np.ndarray:
    """The n-gram of marks alone."""
    out = np.array([FIRST])
    for k in range(2, n + 1):
        out = _longer(out, np.array([FIRST]), k)
    return out


def _after(row: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """For each word the n-gram that ends before it."""
    out = np.r_[_marks(n), grams[:-1]]
    out[np.r_[True, row[1:] != row[:-1]]] = _marks(n)[0]
    return out


class Among:
    """Sorted hashes to look others up in; most of those are told off by 16 of their bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.marks = keys, np.zeros(1 << 16, bool)
        self.marks[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are there, and where."""
        some = np.flatnonzero(self.marks[x.astype(np.uint16)])
        at = np.minimum(np.searchsorted(self.keys, x[some]), len(self.keys) - 1)
        same = self.keys[at] == x[some]
        return some[same], at[same]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, rows and hashes of the words of each step with any."""
    text, bounds = raw(string_column(batch, "text"))
    for lo, hi in steps(bounds):
        row, word = word_hashes(text[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        if len(row):
            yield lo, row, word


def _columns(order: int) -> list[str]:
    """The context before a word and the words that end with it, of every lower order; the last word is in ``pair``."""
    return [f"{kind}_{m}" for m in range(order - 1, 0, -1) for kind in ("ctx", "gram")][:-1]


def _exploded(order: int, slices: int, part: int, hot: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """The n-grams of one slice: pair, lower ones, doc_id, tf, and how often the document has the lower ones.

    pair: the highest context, and the last word with its halves swapped, as one 64-bit key from which either gives the
    other.  own: how often the document has the context, and in the lower 32 bits the words that end with the last one.
    hot: hashes, counts and counts of the contexts of hot n-grams.  In their rows context and last word are others'
    count of the context, and others' count shifted by 16 bits that deal them out; own of the highest order is negative.
    """
    names, above = ["pair", *_columns(order)], order - 1
    among = Among(hot[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, row, word in _texts(batch):
                salt = mixed(row.astype(np.uint64), 3)
                starts = np.r_[True, row[1:] != row[:-1]]
                value, often, gram = {}, {}, word
                for m in range(1, order):
                    by, _, many = _groups(mixed(gram ^ salt))
                    n = np.empty(len(row), np.int32)
                    n[by] = np.repeat(many, many)
                    value[f"gram_{m}"], often[f"gram_{m}"] = gram, n
                    value[f"ctx_{m}"] = _after(row, gram, m)
                    often[f"ctx_{m}"] = np.where(starts, 1, np.r_[n[:1], n[:-1]]).astype(np.int32)
                    gram = _longer(value[f"ctx_{m}"], word, m + 1)
                here = np.flatnonzero(gram % np.uint64(slices) == np.uint64(part))
                by, at, tf = _groups(mixed(gram[here] ^ salt[here]))
                first = here[by[at]]
                value = {c: x[first].view(np.int64) for c, x in value.items()}
                often = {c: x[first] for c, x in often.items()}
                if len(hot[0]):
                    these, k = among.places(gram[first])
                    left = hot[1][k] - tf[these]
                    these, k, left = these[left > 0], k[left > 0], left[left > 0]
                    dealt = (salt[first[these]] >> np.uint64(48)).astype(np.int64)
                    value[f"ctx_{above}"][these] = hot[2][k] - often[f"ctx_{above}"][these]
                    value["gram_1"][these] = left << 16 | dealt
                    often[f"ctx_{above}"][these] = -1
                last = value["gram_1"].view(np.uint64)
                value["pair"] = value[f"ctx_{above}"] ^ (last << np.uint64(32) | last >> np.uint64(32)).view(np.int64)
                own = [often[f"ctx_{m}"].astype(np.int64) << 32 | often[f"gram_{m}"] for m in range(above, 0, -1)]
                arrays = [*(pa.array(value[c]) for c in names), ids.take(pa.array(lo + row[first])), pa.array(tf.astype(np.int32)), *map(pa.array, own)]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "doc_id", "tf", *(f"own_{m}" for m in range(above, 0, -1))])

    return run


def _counted(n: int):
    """Distinct n-grams of some texts with their counts; marks alone count once for each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def off() -> pa.RecordBatch:
            w, k = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(k.astype(np.int64))], ["w", "n"])

        for batch in batches:
            for _, row, word in _texts(batch):
                gram = word
                for m in range(1, n):
                    gram = _longer(_after(row, gram, m), word, m + 1)
                held += [gram, np.repeat(_marks(n), 1 + np.count_nonzero(row[1:] != row[:-1]))]
                if sum(map(len, held)) >= SEGMENT:
                    yield off()
        yield off()

    return run


def _counted_of(order: int, frequent: np.ndarray):
    """Distinct n-grams all of whose words are among ``frequent`` ones: hash, context, count."""

    among = Among(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row, word in _texts(batch):
                inside, starts, gram = np.zeros(len(word), bool), np.r_[True, row[1:] != row[:-1]], word
                inside[among.places(word)[0]] = True
                whole = inside
                for _ in range(1, order):
                    whole = inside & (np.r_[True, whole[:-1]] | starts)
                for m in range(1, order - 1):
                    gram = _longer(_after(row, gram, m), word, m + 1)
                at = np.flatnonzero(whole)
                before = _after(row, gram, order - 1)[at]
                gram = _longer(before, word[at], order)
                by, first, many = _groups(gram)
                first = by[first]
                yield pa.RecordBatch.from_arrays([pa.array(gram[first].view(np.int64)), pa.array(before[first].view(np.int64)), pa.array(many.astype(np.int64))], ["g", "w", "whole"])

    return run


def stupid_backoff(docs: DataFrame, order: int = 2, backoff: float = 0.4, slices: int = 4, hot: float = 1e-4, share: int = 4000) -> DataFrame:
    """doc_id, n_words, score of every row of ``docs`` (doc_id, text), by n-grams of up to ``order`` words."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = docs.where("text is not null")
    counted = lambda m: text.select("text").mapInArrow(_counted(m), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    tables = {m: saved(counted(m), f"grams-{m}") for m in range(1, order)}
    marks = int(FIRST.view(np.int64))
    total = tables[1].where(F.col("w") != marks).agg(F.sum("n")).first()[0] or 0
    # hot lower n-grams, fewer than 1 / hot and those of marks, and the others
    is_hot = lambda m: (F.col("n") > hot * total) | (F.col("w") == int(_marks(m).view(np.int64)[0]))
    common, rare = {}, {}
    for m, table in tables.items():
        few = table.where(is_hot(m)).select(F.col("w").alias("u"), F.col("n").alias("often"))
        common[m] = F.broadcast(spark.createDataFrame(few.collect(), few.schema))
        rare[m] = table.where(~is_hot(m))
    frequent = np.sort(np.array([r[0] for r in tables[1].where(F.col("n") * share > total).select("w").collect()], np.int64).view(np.uint64))
    hot_grams = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    if len(frequent):
        of = text.select("text").mapInArrow(_counted_of(order, frequent), "g long, w long, whole long").groupBy("g", "w").agg(F.sum("whole").alias("whole"))
        of = of.where(F.col("whole") * share > total)  # fewer than ``share``
        top = F.broadcast(of).join(tables[order - 1], "w").select("g", "whole", "n").toArrow()
        g = top["g"].to_numpy().view(np.uint64)
        by = np.argsort(g)
        hot_grams = (g[by], top["whole"].to_numpy()[by], top["n"].to_numpy()[by])

    above, owns = order - 1, [f"own_{m}" for m in range(order - 1, 0, -1)]
    names, log = _columns(order), math.log(backoff)
    schema = ", ".join([*(f"{c} long" for c in ("pair", *names)), "doc_id long, tf int", *(f"{c} long" for c in owns)])
    is_top = F.col(f"own_{above}") < 0
    sums = []
    for part in range(slices):
        rows = text.mapInArrow(_exploded(order, slices, part, hot_grams), schema).where("pair is not null").repartition("pair")
        # the filter, which Spark would put on the counts' side alone, and adding no bits of the other columns keep the
        # two sides' exchanges equal, so that one serves both
        none = F.coalesce("doc_id", F.lit(0))
        for c in (*names, *owns):
            none = none.bitwiseOR(F.col(c))
        counts = rows.groupBy("pair").agg(F.sum(F.col("tf") + none.bitwiseAND(F.lit(0))).alias("here"))
        # most n-grams are there once: no other document has them, and the join needs no count of theirs
        found = rows.join(counts.where("here > 1").hint("shuffle_hash"), "pair", "left")
        turned = F.col("pair").bitwiseXOR(F.col(f"ctx_{above}"))
        found = found.withColumn("gram_1", F.shiftleft(turned, 32).bitwiseOR(F.shiftrightunsigned(turned, 32))).drop("pair")
        found = found.withColumn("left", F.when(is_top, F.shiftright("gram_1", 16)).otherwise(F.coalesce(F.col("here") - F.col("tf"), F.lit(0))))
        for m in range(above, 0, -1):
            seen = F.col("left") > 0
            lower = [*(f"{kind}_{k}" for k in range(m - 1, 0, -1) for kind in ("ctx", "gram")), *(f"own_{k}" for k in range(m - 1, 0, -1))]
            u = F.when(seen, F.col(f"ctx_{m}")).otherwise(F.col(f"gram_{m}"))
            own = F.when(seen, F.shiftright(f"own_{m}", 32)).otherwise(F.col(f"own_{m}").bitwiseAND(F.lit(2**32 - 1)))
            if m == above:  # hot rows have no count to meet: nothing less a negative number is what they bring
                u, own = F.when(is_top, F.xxhash64("doc_id", "gram_1")).otherwise(u), F.when(is_top, -F.col(f"ctx_{m}")).otherwise(own)
            need = found.select("doc_id", "tf", seen.alias("seen"), F.col("left").alias("top"), u.alias("u"), own.alias("own"), *lower)
            # a common n-gram's rows are dealt out by document, eight keys each, so that its shuffle is even and leaves
            # few sums of a document; whether such a key is a rare n-gram's is not looked at
            dealt = F.coalesce(F.shiftleft("doc_id", 3).bitwiseOR(F.col("u").bitwiseAND(F.lit(7))), F.xxhash64("u"))
            need = need.join(common[m], "u", "left").withColumn("key", F.when(F.col("often").isNull(), F.col("u")).otherwise(dealt))
            found = need.join(rare[m], F.col("key") == F.col("w"), "left").withColumn("left", F.coalesce("often", "n", F.lit(0)) - F.col("own")).drop("often", "key", "w", "n", "u", "own")
            backs = (order - 1 - m) * log
            if m > 1:  # what was found is done, the rest goes on to the next lower order
                found = saved(found, "level")
                done, found = found.where("seen"), found.where("not seen")
                sums.append(saved(_summed(done.withColumn("value", F.ln("top") - F.ln("left") + backs)), "slice"))
        value = F.when(F.col("seen"), F.ln("top") - F.ln("left") + backs).otherwise(backs + log + F.when(F.col("left") > 0, F.ln("left")).otherwise(log))
        sums.append(saved(_summed(found.withColumn("value", value)), "slice"))
    every = sums[0]
    for s in sums[1:]:
        every = every.unionAll(s)
    every = every.groupBy("doc_id").agg(F.sum("s").alias("s"), F.sum("backed").alias("backed"), F.sum("words").alias("n_words"))
    others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    scored = every.select(F.col("doc_id").alias("id"), "n_words", ((F.col("s") - F.col("backed") * F.ln(others)) / F.col("n_words")).alias("score"))
    out = docs.select("doc_id").join(scored, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), "score")


def _summed(rows: DataFrame) -> DataFrame:
    """Sums a document; backed: words that are divided by the number of the others' words."""
    return rows.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("value")).alias("s"), F.sum(F.when(~F.col("seen"), F.col("tf")).otherwise(0)).alias("backed"), F.sum("tf").alias("words"))
