"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths run over the bytes of a fixed-length window; the largest response of each filter over
the window, rectified, goes into a softmax layer.  On bytes as one-hot vectors a filter is a table of 256 weights
for each of its places, so a convolution is a sum of looked-up rows.  The network is trained by Adam with label
windows on the driver from a bounded sample: at most ``per_language`` documents of every label, fewer where all labels
together would have more than ``most``, the ones of smallest seeded hash, a window at a hashed place of each.  It is applied to every window of every
whole text; a text's probabilities are the normalised geometric mean over its windows, weighed by their bytes.

Nulls and edges: a text that is null or has no letter gives ``und`` with score 0, and so does every text if no
labelled row may be learned from.  Null labels are never learned.  Null and repeated ids give a row each; a null
id is not held out.  An empty table gives no rows.  Other columns are not used; ``keep`` passes some of them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_rows, raw, small_batches, steps, string_column, tidied

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 6
#: Zeros after a window, for filters that run over its end.
PAD = 4
EPOCHS = 12
#: Gradient steps at least, where the sample is small.
STEPS = 700
#: Bytes of text whose windows are convolved in one step.
STEP = 48_000
UND = "und"
#: Labels whose counts are sent to the scan; more are joined by a shuffle.
LABELS = 10_000


class ByteNet:
    """languages; places: for each offset a table (256, filters of the widths beyond it); dense, bias: the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        # filters in the order of falling width, so that those which reach offset i stand first
        self.widths = sorted(WIDTHS, reverse=True)
        self.reach = [sum(FILTERS for w in self.widths if w > i) for i in range(self.widths[0])]
        self.places = [rng.normal(0, 0.3, (256, n)).astype(np.float32) for n in self.reach]
        self.shift = np.zeros(self.reach[0], np.float32)
        self.dense = rng.normal(0, 0.1, (self.reach[0], len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over windows (n, WINDOW + PAD) of bytes, and where it is."""
        out = self.places[0][x[:, :WINDOW]]
        for i in range(1, len(self.places)):
            out[:, :, : self.reach[i]] += self.places[i][x[:, i : i + WINDOW]]
        at = out.argmax(1)
        return np.take_along_axis(out, at[:, None], 1)[:, 0] + self.shift, at

    def paired(self) -> None:
        """Tables of two neighbouring places at once, for prediction."""
        p = self.places
        self.pairs = [(p[i][:, None, : self.reach[i]] + np.pad(p[i + 1], ((0, 0), (0, self.reach[i] - self.reach[i + 1])))[None]).reshape(1 << 16, -1) for i in range(0, len(p), 2)]

    def largest(self, x: np.ndarray) -> np.ndarray:
        """As pooled, from the tables of pairs."""
        two = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
        out = self.pairs[0][two[:, :WINDOW]]
        for i in range(1, len(self.pairs)):
            out[:, :, : self.pairs[i].shape[1]] += self.pairs[i][two[:, 2 * i : 2 * i + WINDOW]]
        return out.max(1) + self.shift

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.dense + self.bias

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Cross-entropy; a filter's gradient reaches only the bytes of its largest response."""
        rng = np.random.default_rng(seed)
        params = [*self.places, self.shift, self.dense, self.bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(max(epochs, -(-STEPS // -(-len(x) // batch)))):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                b = order[a : a + batch]
                r, at = self.pooled(x[b])
                hidden = np.maximum(r, 0)
                p = softmax(hidden @ self.dense + self.bias)
                p[np.arange(len(b)), y[b]] -= 1
                p /= len(b)
                back = (p @ self.dense.T) * (r > 0)
                grads = []
                for i, n in enumerate(self.reach):
                    g = np.zeros_like(self.places[i])
                    byte = np.take_along_axis(x[b], at[:, :n] + i, 1)
                    np.add.at(g, (byte, np.broadcast_to(np.arange(n), byte.shape)), back[:, :n])
                    grads.append(g)
                grads += [back.sum(0), hidden.T @ p, p.sum(0)]
                t += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that cut every row's bytes, with zeros after a text's end and PAD after each; their rows and lengths."""
    size = np.diff(bounds)
    many = -(-size // WINDOW)
    first = np.cumsum(many) - many
    flat = np.zeros(int(many.sum()) * WINDOW, np.uint8)
    for i in range(len(size)):
        flat[first[i] * WINDOW : first[i] * WINDOW + size[i]] = text[bounds[i] : bounds[i + 1]]
    x = np.zeros((int(many.sum()), WINDOW + PAD), np.uint8)
    x[:, :WINDOW] = flat.reshape(-1, WINDOW)
    row = np.repeat(np.arange(len(many)), many)
    return x, row, np.minimum(size[row] - (np.arange(len(row)) - first[row]) * WINDOW, WINDOW)


def train(rows: pa.Table, seed: int = 7) -> ByteNet | None:
    """From a table (sample: text of at most WINDOW characters, lang)."""
    labels = sorted(set(rows["lang"].to_pylist()))
    if not labels:
        return None
    net = ByteNet(labels, seed)
    x = np.zeros((rows.num_rows, WINDOW + PAD), np.uint8)
    for i, s in enumerate(rows["sample"].to_pylist()):
        b = s.encode()[:WINDOW]
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    y = np.array([labels.index(s) for s in rows["lang"].to_pylist()])
    if len(labels) > 1:
        net.fit(x, y)
    return net


def _predict(net: ByteNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net.paired()
        for batch in batches:
            text, bounds = raw(string_column(batch, "text"))
            total = np.zeros((batch.num_rows, len(net.languages)))
            for lo, hi in steps(bounds):
                x, row, length = windows(text, bounds[lo : hi + 1])
                k = max(1, STEP // WINDOW)
                for a in range(0, len(row), k):
                    z = softmax(net.logits(net.largest(x[a : a + k])).astype(float))
                    np.add.at(total, lo + row[a : a + k], np.log(z + 1e-9) * length[a : a + k, None])
            p = softmax(total / np.maximum(np.diff(bounds), 1)[:, None])
            letter = batch.column(batch.schema.get_field_index("letter")).to_numpy(zero_copy_only=False).astype(bool)
            best = p.argmax(1)
            lang = np.where(letter, np.array(net.languages, object)[best], UND)
            score = np.where(letter, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[:-2], "lang_pred", "score"])

    return run


def fold(doc_id: Column, folds: int = 4) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, per_language: int = 1024, most: int = 1 << 17, seed: int = 7) -> pa.Table:
    """At most ``per_language`` rows (sample, lang) of every label, or ``most`` over the number of labels, but one at least.

    Labels are counted first, then a hash threshold leaves about four times the bound to rank, so that a hot
    label is never sorted as a whole.
    """
    counts = docs.groupBy("lang").agg(F.count("*").alias("k"))
    rows = bounded_rows(counts, LABELS)
    labels = len(rows) if rows is not None else counts.count()
    each = max(1, min(per_language, most // max(labels, 1)))
    counts = counts if rows is None else F.broadcast(docs.sparkSession.createDataFrame(rows, counts.schema))
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    share = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    some = docs.select("lang", h.alias("h"), share.alias("share"), F.substring("text", start, F.lit(WINDOW)).alias("sample")).join(counts, "lang")
    some = some.where(F.col("share") * F.col("k") < 4 * each)
    order = Window.partitionBy("lang").orderBy("h", "sample")
    return some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).orderBy("lang", "r").select("sample", "lang").toArrow()


def identify(docs: DataFrame, held_out: Column, per_language: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang); rows held out aren't learned from.

    keep: columns of ``docs`` that come before these as they are, so that no join has to bring them back.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    learn = own.where(~F.col("held_out") & F.col("lang").isNotNull() & letter)
    net = train(training_rows(learn, per_language))
    passed = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    given = [*passed, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out")]
    text = F.col("text").cast("string")
    if net is None:
        out = docs.select(*given, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        rows = docs.select(*given, text.alias("text"), F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letter"))
        schema = T.StructType([*rows.schema.fields[:-2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
        out = rows.mapInArrow(tidied(_predict(net)), schema)
    return out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *(c for c in ("doc_id", "held_out", "lang_pred", "score") if c not in keep))
