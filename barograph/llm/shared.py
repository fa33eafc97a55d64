"""Helpers of the operators: tables, shared storage, Arrow text, word and shingle hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words in every contract here: space, tab, LF, VT, FF, CR.
SPACES = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Most bytes of text that one numpy step takes, unless a single document is longer.
STEP_BYTES = 2_000_000
#: Rows of one Arrow batch: a few MB of ordinary documents.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder in the warehouse on a cluster, and a temporary one in local mode, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = f"file://{tempfile.mkdtemp(prefix='barograph-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/barograph-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Folders of ``saved``, and how to remove each.
_written: dict[str, Callable[[], None]] = {}


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Shuffles of the write are removed when it ends; nothing reads them again.  The tables go by ``forget``, at the
    latest when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    place, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()
    _written[path] = lambda: place.getFileSystem(conf).delete(place, True)
    return spark.read.schema(df.schema).parquet(path)


def written() -> set[str]:
    """The tables of ``saved`` that are still there."""
    return set(_written)


@atexit.register
def forget(paths: set[str] | None = None) -> None:
    """Remove tables of ``saved``, all of them by default: for when nothing reads them any more."""
    for path in written() if paths is None else paths:
        remove = _written.pop(path)
        with contextlib.suppress(Exception):  # the JVM may have gone before
            remove()


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, so that long texts don't add up; the same for all operators."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") != str(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidied(run: Callable) -> Callable:
    """``run`` of batches; at its end the worker gives back what allocators hold, as idle workers stay beside later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def even_join(rows: DataFrame, one: DataFrame, keys: list[str], total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``one``, which has one row a key, and in ``many`` how many of ``total`` rows the key has.

    Keys of more than a ``share``-th of all rows, so fewer than ``share``, are joined by broadcast, the others by a
    shuffle; no task gets the rows of a hot key.  Both tables are read more than once.
    """
    hot = one.where(F.col("many") > total / share)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(one.where(F.col("many") <= total / share), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; 0 for null.

    Every run is first cut to one letter, then white space goes; regexp_count would build a string per word.
    """
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), SPACES.decode(), "")), F.lit(0)).cast("long")


# ---------------------------------------------------------------- Arrow text


def string_column(batch: pa.RecordBatch, name: str) -> pa.StringArray:
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def raw(col: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and where each row starts; the last entry is the end."""
    bounds = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    text = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return text, bounds - bounds[0]


def steps(bounds: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each, or one longer row."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


# ---------------------------------------------------------------- hashes

_U = np.uint64
_FULL = np.ones(256, bool)
_FULL[list(SPACES)] = False
#: The first 0 to 8 bytes of eight.
_MASK = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are taken by eights.
_NEAR = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_GRAM = np.random.default_rng(19011970).integers(0, 2**64, 64, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finisher of SplitMix64 over h + seed: a permutation of 64-bit values."""
    h = h + _U((seed * _BASE) % 2**64)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        a = np.full(n, _BASE, _U)
        a[0] = 1
        _powers["up"] = np.cumprod(a, dtype=_U)
    return _powers["up"]


def word_hashes(text: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the rows: its row, and a 64-bit hash of its bytes (A-Z as a-z if ``lower``).

    Words are taken eight bytes at a time, all words at once; what a word has beyond ``_NEAR`` bytes is a polynomial in them.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64), np.empty(0, _U)
    full = _FULL[text]
    turn = np.empty(n + 1, bool)
    turn[0], turn[n] = full[0], full[-1]
    np.not_equal(full[1:], full[:-1], out=turn[1:-1])
    edges = np.flatnonzero(turn)
    # rows that end in a word and the next one's first word
    cuts = bounds[(bounds > 0) & (bounds < n)]
    cuts = np.unique(cuts[full[cuts] & full[cuts - 1]])
    if len(cuts):
        edges = np.insert(edges, np.repeat(np.searchsorted(edges, cuts), 2), np.repeat(cuts, 2))
    starts, size = edges[0::2], edges[1::2] - edges[0::2]
    held = np.zeros(n + 8, np.uint8)
    held[:n] = _LOWER[text] if lower else text
    eight = np.ndarray(n + 1, "<u8", held, strides=(1,))
    h = mixed((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(_U) * _U(_BASE))
    for k in range(8, _NEAR, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        h[more] = mixed(h[more] ^ (eight[starts[more] + k] & _MASK[np.minimum(size[more] - k, 8)]), k)
    far = np.flatnonzero(size > _NEAR)
    if len(far):
        many = size[far] - _NEAR
        first = np.cumsum(many) - many
        inside = np.arange(int(many.sum())) - np.repeat(first, many)
        letters = _LETTER[held[np.repeat(starts[far] + _NEAR, many) + inside]]
        h[far] = mixed(h[far] ^ np.add.reduceat(letters * powers(int(many.max()))[inside], first), _NEAR)
    return np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds))), h


def gram_hashes(row: np.ndarray, words: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all runs of n words within a row; with ``short`` a row of fewer words gives them as one."""
    k = len(words) - n + 1
    if k > 0:
        h = words[:k] * _GRAM[0]
        for i in range(1, n):
            h = h + words[i : k + i] * _GRAM[i]
        same = row[:k] == row[n - 1 :]
        rows, hashes = row[:k][same], mixed(h[same], n)
    else:
        rows, hashes = row[:0], words[:0]
    if short and len(row):
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        many = np.diff(np.r_[at, len(row)])
        less = many < n
        if less.any():
            extra = np.zeros(int(less.sum()), _U)
            for i in range(n - 1):
                here = many[less] > i
                extra[here] += words[at[less][here] + i] * _GRAM[i]
            rows, hashes = np.r_[rows, row[at[less]]], np.r_[hashes, mixed(extra + many[less].astype(_U), 63)]
            order = np.argsort(rows, kind="stable")
            rows, hashes = rows[order], hashes[order]
    return rows, hashes


def shingle_sets(col: pa.StringArray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its word n-grams) for each row with any, A-Z as a-z."""
    text, bounds = raw(col)
    for a, b in steps(bounds):
        part = bounds[a : b + 1] - bounds[a]
        rows, hashes = gram_hashes(*word_hashes(text[bounds[a] : bounds[b]], part, True), n, True)
        if not len(rows):
            continue
        at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for i, j in zip(at, np.r_[at[1:], len(rows)], strict=True):
            x = np.sort(hashes[i:j])
            yield a + int(rows[i]), x[np.r_[True, x[1:] != x[:-1]]]


def found(x: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each x among sorted keys, 0 where it isn't there."""
    if not len(keys):
        return np.zeros(len(x), values.dtype)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], 0).astype(values.dtype)


def bounded_rows(df: DataFrame, most: int) -> list | None:
    """The rows of ``df`` if there are at most ``most``, else None."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


#: Buckets of 2**15 bits in the bitmap of ``maybe``: 8 MB whatever the input.
BITMAPS = 2048


def _marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with ``may``: whether doc_id may be in ``wanted``.

    Hashes of the wanted ids set bits in a bitmap of fixed size, which is broadcast.  Nothing wanted is lost; the more
    ids there are for the bitmap's bits, the more other rows may be in it.
    """
    bits = 1 << 15
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAPS * bits))
    marks = wanted.groupBy((F.floor(place / bits)).alias("bucket")).agg(F.bitmap_construct_agg((place % bits).cast("int")).alias("bitmap"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(place % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    both = docs.withColumn("place", place).join(F.broadcast(marks), F.floor(F.col("place") / bits) == F.col("bucket"), "left")
    may = F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1, F.lit(False))
    return both.select(*docs.columns, may.alias("may"))


def maybe(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``wanted``, before any shuffle; a join must follow."""
    return _marked(docs, wanted).where("may").drop("may")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``gone``; only those that may be there are shuffled."""
    marked = _marked(docs, gone)
    unsure = marked.where("may").drop("may").join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    return marked.where("not may").drop("may").unionByName(unsure.select(*docs.columns))
