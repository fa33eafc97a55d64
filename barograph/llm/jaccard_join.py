"""N-gram Jaccard join by T-occurrence search: groups of documents whose shingle sets overlap enough.

Documents with one and the same shingle set form a class, and only its smallest id goes on.  Shingles have an order that
all documents keep: by hash, but heavy ones last, by their counts.  Sets that reach the similarity t share l of their first
|x| - ceil(t|x|) + l shingles; with l a share of the size, a document goes on only if that many of its first
shingles, less what a partner's size may take off, stand in another one's too.  So a passage in common makes no
candidate.  It leaves blocks that hold fewer than half of those together.  Heavy shingles are counted over all texts, a segment at a time, and at most ``heavy`` are kept; a wrong count
costs time, never a link.  These short lists of shingles give blocks of documents; inside a block, DivideSkip searches the lists of the
whole sets: the short ones are heap-merged, the long ones binary-probed, and documents with the required
overlap are linked.  A large block is dealt into chunks.  First each chunk is searched by itself, together with
the block's first document; then only documents outside the block's largest component are queries against the
other chunks.  So a group of near copies is linked without its pairs, and no task gets an unbounded group.  Joins by
shingle, set, block or hub of a component take what is hot there by broadcast: fewer keys than a fixed number.

Nulls and edges: null or empty text gives an empty set, linked with nothing (n_shingles 0, component_id its own
doc_id); a text with fewer words than n gives one shingle.  A null doc_id takes part in nothing and keeps a null
component_id.  Repeated rows fall into one class; where rows of one doc_id differ in their sets, the greatest text by
code point counts for all of them.  An empty table gives no rows.  Other columns are not touched.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import even_join, found, gram_hashes, maybe, mixed, raw, saved, shingle_sets, small_batches, steps, string_column, tidied, without, word_hashes

#: Words or shingles kept before the frequent ones among them are counted off.
SEGMENT = 1 << 22
#: Shingles and documents that a chunk of a block gets on average at most.
CHUNK_SHINGLES, CHUNK_DOCS = 1 << 20, 512
#: DivideSkip's weight of the longest list.
MU = 0.0085


def _need(n: np.ndarray | int, num: int, den: int):
    """ceil(num * n / den)."""
    return -(-num * n // den)


def _heavy(n: int):
    """Shingles that stand three times or more in a segment of texts, with their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def off() -> pa.RecordBatch:
            x = np.concatenate([np.empty(0, np.uint64), *held])
            held.clear()
            x.sort()
            # what equals the second one before it stands three times or more; few shingles do
            u, c = np.unique(x[2:][x[2:] == x[:-2]], return_counts=True)
            c = c + 2
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], ["shingle", "seen"])

        size = 0
        for batch in batches:
            text, bounds = raw(string_column(batch, "text"))
            for lo, hi in steps(bounds):
                x = gram_hashes(*word_hashes(text[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], True), n, True)[1]
                held.append(x)
                size += len(x)
                if size >= SEGMENT:
                    yield off()
                    size = 0
        yield off()

    return run


def _more(size: int) -> int:
    """l: how many more shingles than one needs a prefix has; a tenth of the set."""
    return max(1, size // 10)


def _sets(n: int, num: int, den: int, heavy):
    """doc_id, size and 128-bit fingerprint of each set, the shingles of its prefix, and how many of them a partner shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = heavy.value
        for batch in batches:
            rows = batch.num_rows
            size, one, two, least = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64), np.zeros(rows, np.int64)
            prefix: list = [None] * rows
            for i, x in shingle_sets(string_column(batch, "text"), n):
                size[i] = m = len(x)
                one[i], two[i] = mixed(x, 1).sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(x, 2))
                # of a pair the smaller set's l counts, and its size is num/den of this one's at least
                least[i] = _more(_need(m, num, den))
                prefix[i] = _prefix(x, m - _need(m, num, den) + _more(m), keys, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(least), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n", "one", "two", "least", "prefix"])

    return run


def _prefix(x: np.ndarray, p: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    often = found(x, keys, counts)
    return x[np.argsort(often, kind="stable")[:p]] if often.any() else x[:p]


def divide_skip(docs: list[tuple[int, np.ndarray]], num: int, den: int, query: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions) among ``docs`` that join groups, found by T-occurrence search.

    query: which documents search; group: positions with equal values are connected already.  Of the links
    between two groups one is enough, so no pair inside a group is probed.
    """
    parent = {}

    def root(a):
        while parent.get(a, a) != a:
            parent[a] = parent.get(parent[a], parent[a])
            a = parent[a]
        return a

    order = sorted(range(len(docs)), key=lambda i: len(docs[i][1]))
    size = [len(docs[i][1]) for i in order]
    every = np.concatenate([docs[i][1] for i in order])
    owner = np.repeat(np.arange(len(order)), size)
    by = np.lexsort((owner, every))
    every, owner = every[by], owner[by]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    names, ends, owner = every[first], np.r_[first[1:], len(every)], owner.tolist()
    links = []
    low = 0
    for r in range(len(order)):
        i, n = order[r], size[r]
        t = _need(n, num, den)
        while size[low] < t:
            low += 1
        at = np.searchsorted(names, docs[i][1])
        # a partner is an earlier one, or any later one too if that doesn't search
        lists = sorted(zip(first[at].tolist(), ends[at].tolist(), strict=True), key=lambda ab: ab[1] - ab[0])
        lists = [ab for ab in lists if ab[1] - ab[0] > 1]
        if not query[i] or len(lists) < t:
            continue
        longest = lists[-1][1] - lists[-1][0]
        skip = min(t - 1, int(t / (MU * math.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]

        def runs(ab, r=r, low=low):
            return owner[bisect_left(owner, low, *ab) : ab[1]] if ab[1] - ab[0] > 8 else owner[ab[0] : ab[1]]

        seen, count = -1, 0
        found: list[tuple[int, int]] = []
        for y in heapq.merge(*map(runs, short)):
            if y != seen:
                if count >= t - skip:
                    found.append((seen, count))
                seen, count = y, 0
            count += 1
        if count >= t - skip:
            found.append((seen, count))
        mine = root(group[i])
        for y, count in found:
            j, m = order[y], size[y]
            if y == r or y > r and query[j] or m < t or _need(m, num, den) > n or root(group[j]) == mine:
                continue
            least = _need(n + m, num, num + den)
            left = len(long)
            for a, b in long:
                if count >= least or count + left < least:
                    break
                left -= 1
                k = bisect_left(owner, y, a, b)
                count += k < b and owner[k] == y
            if count >= least:
                links.append((i, j))
                parent[root(group[j])] = mine
    return links


_LINK = "x long, y long"
#: Links whose components the driver finds: 4 MB at most.
FEW_LINKS = 1 << 18


def _search(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        ids, sets = t["doc_id"].to_numpy(), t["shingles"].combine_chunks()
        flat, at = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
        keep, seen = [], set()
        searches, groups = t["searches"].to_numpy(zero_copy_only=False), t["group"].to_numpy()
        for i in np.argsort(~searches, kind="stable").tolist():  # the block's first document may stand twice
            if ids[i] not in seen:
                seen.add(ids[i])
                keep.append(i)
        docs = [(int(ids[i]), flat[at[i] : at[i + 1]]) for i in keep]
        links = divide_skip(docs, num, den, searches[keep], groups[keep]) if len(docs) > 1 else []
        return pa.table({"x": pa.array([docs[i][0] for i, _ in links], pa.int64()), "y": pa.array([docs[j][0] for _, j in links], pa.int64())})

    return run


def least_ids(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that links lead to, and the smallest id that each reaches: labels spread along links, and jump to their own."""
    ids, at = np.unique(np.r_[x, y], return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(ids))
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        # of two trees the root of the greater label goes below the other one
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def components(edges: DataFrame, tag: str = "components", few: int = FEW_LINKS) -> DataFrame:
    """doc_id, component: the smallest id that links reach, for ids that reach a smaller one.

    At most ``few`` links are taken to the driver: their tables are small, and dozens of jobs on them cost more than they do.
    More links take large-star and small-star steps; each step is a groupBy with a minimum, and tables are written
    between steps, never collected.
    """
    if edges.count() <= few:
        links = edges.where("x <> y").toArrow()
        ids, least = least_ids(links["x"].to_numpy(), links["y"].to_numpy())
        ids, least = ids[ids != least], least[ids != least]
        found = pa.table({"doc_id": pa.array(ids, pa.int64()), "component": pa.array(least, pa.int64())})
        return saved(edges.sparkSession.createDataFrame(found, "doc_id long, component long"), tag)
    e = edges.select("x", "y").where("x <> y").distinct()
    while True:
        both = saved(e.select("x", "y").unionAll(e.select(F.col("y").alias("x"), F.col("x").alias("y"))), f"{tag}-both")
        least = saved(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("many")), f"{tag}-least")
        large = even_join(both, least, ["x"], both.count()).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.unionAll(least.where("m < x").select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        large = saved(large, f"{tag}-large")
        least = saved(large.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("many")), f"{tag}-least")
        small = even_join(large, least, ["x"], large.count()).where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        small = small.unionAll(least.select("x", F.col("m").alias("y"))).where("x <> y").distinct()
        small = saved(small.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), f"{tag}-small")
        # done when every document has one link and no link leads to a document that has one
        left = small.groupBy("x").agg(F.count("*").alias("k")).where("k > 1").select("x").unionAll(small.select("x").intersect(small.select("y")))
        e = small
        if left.isEmpty():
            return e.select(F.col("x").alias("doc_id"), F.col("y").alias("component"))


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, heavy: int = 1 << 18) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text): links at den * both >= num * either."""
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    often = text.where("text is not null").select("text").mapInArrow(tidied(_heavy(n)), "shingle long, seen long").groupBy("shingle").agg(F.sum("seen").alias("seen"))
    top = often.orderBy(F.desc("seen"), "shingle").limit(heavy).toArrow()
    keys, seen = top["shingle"].to_numpy().view(np.uint64), top["seen"].to_numpy()
    by = np.argsort(keys)
    order = spark.sparkContext.broadcast((keys[by], seen[by]))
    sets = saved(text.mapInArrow(tidied(_sets(n, num, den, order)), "doc_id long, n long, one long, two long, least long, prefix array<long>"), "sets")
    key = ["n", "one", "two"]
    unlike = sets.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b"))
    unlike = saved(unlike.where("a <> b").select("doc_id"), "unlike")
    if not unlike.isEmpty():
        one = maybe(text, unlike).join(unlike, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        groups = saved(jaccard_groups(without(text, unlike).unionByName(one), n, num, den, heavy), "groups")
        of_one = groups.join(unlike, "doc_id", "left_semi")
        return without(groups, unlike).unionByName(maybe(text, unlike).select("doc_id").join(of_one, "doc_id"))
    rows = sets.count()
    full = sets.where("n > 0 and doc_id is not null")
    reps = saved(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")), "reps")
    first = full.select("doc_id", "least", "prefix").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    posts = saved(first, "first").select("doc_id", F.explode("prefix").alias("shingle")).where(_FULL)
    # shingles that may stand in more than a thousandth of the documents: at most ``heavy``
    hot = keys.view(np.int64)[seen * 1000 > rows]
    hot = spark.createDataFrame(pa.table({"shingle": hot})) if len(hot) else None
    held = saved(_in_lists(posts, hot).select("doc_id", "shingle"), "posts")
    enough = held.groupBy("doc_id").agg(F.count("*").alias("k")).join(sets.where("n > 0").groupBy("doc_id").agg(F.min("least").alias("least")), "doc_id")
    enough = saved(enough.where("k >= least").select("doc_id", "least"), "enough")
    held = saved(held.join(enough, "doc_id", "left_semi"), "held").where(_FULL)
    inside = _in_lists(held, hot).groupBy("block", "doc_id").agg(F.count("*").alias("k"))
    inside = saved(_needed(inside.join(enough, "doc_id")), "in-blocks")
    many = saved(inside.groupBy("block").agg(F.count("*").alias("many")), "many")
    inside = saved(even_join(inside, many, ["block"], inside.count()).where("many > 1").drop("many"), "blocks")
    wanted = saved(inside.select("doc_id").distinct(), "wanted")
    sizes = full.select("doc_id", "n").join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("n").alias("m"), F.count("*").alias("rows"))
    sizes = saved(sizes, "sizes")
    near = maybe(text, wanted)
    # only where ids repeat do texts need a shuffle to stand once
    repeated = not sizes.where("rows > 1").isEmpty()
    width = inside.join(sizes, "doc_id").groupBy("block").agg(F.count("*").alias("many"), F.sum("m").alias("m"))
    chunks = F.greatest(F.ceil(F.col("many") / CHUNK_DOCS), F.ceil(F.col("m") / CHUNK_SHINGLES)).cast("int")
    width = saved(width.select("block", "many", chunks.alias("chunks")), "width")
    dealt = even_join(inside, width, ["block"], inside.count())
    dealt = saved(dealt.select("block", "doc_id", "chunks", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk")), "dealt")

    def sets_of(these: DataFrame) -> DataFrame:
        """These ids and tasks with their whole sets: the text goes through the join, as it is smaller than the hashes."""
        held = near.join(these, "doc_id").select("doc_id", "text", "tasks")
        return (held.dropDuplicates(["doc_id"]) if repeated else held).mapInArrow(tidied(_shingles(n)), f"doc_id long, tasks {these.schema['tasks'].dataType.simpleString()}, shingles array<long>")

    # a document has at most as many blocks as its prefix has shingles
    tasks = dealt.groupBy("doc_id").agg(F.collect_list(F.struct("block", "chunks", "chunk")).alias("tasks"))
    each = sets_of(tasks).select("doc_id", "shingles", F.explode("tasks").alias("t")).select("t.*", "doc_id", "shingles")
    # the block's first document goes to each of its chunks, as the others' common neighbour
    chunk = F.explode(F.when(F.col("doc_id") == F.col("block"), F.expr("sequence(0, chunks - 1)")).otherwise(F.array("chunk")))
    searched = each.select("block", chunk.alias("part"), "doc_id", F.lit(True).alias("searches"), F.col("doc_id").alias("group"), "shingles")
    links = saved(searched.groupBy("block", "part").applyInArrow(_search(num, den), _LINK), "links")
    found = components(links) if not links.isEmpty() else links.select(F.col("x").alias("doc_id"), F.col("y").alias("component"))

    large = dealt.where("chunks > 1")
    if not large.isEmpty():
        # what is not in the largest component of its block searches the block's other chunks
        labelled = large.join(found, "doc_id", "left").select("block", "doc_id", "chunks", "chunk", F.coalesce("component", "doc_id").alias("group"))
        labelled = saved(labelled, "labelled-all")
        held = labelled.groupBy("block", "group").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("group", F.struct("k", "group")).alias("main"), F.count("*").alias("groups"), F.sum("k").alias("many"))
        held = saved(held.where("groups > 1").select("block", "main", "many"), "main")
        labelled = saved(even_join(labelled, held, ["block"], labelled.count()).withColumn("searches", F.col("group") != F.col("main")), "labelled")
        # task (i, j): searching documents of chunk i, all of chunk j
        asks = labelled.where("searches").select("block", F.col("chunk").alias("i"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("j"), "doc_id", "group", "searches")
        busy = asks.select("block", "i", "j").distinct()
        holds = labelled.select("block", F.col("chunk").alias("j"), "doc_id", "group", F.lit(False).alias("searches")).join(busy, ["block", "j"]).select("block", "i", "j", "doc_id", "group", "searches")
        some = sets_of(labelled.select("doc_id").distinct().withColumn("tasks", F.lit(0)))
        cross = asks.unionAll(holds).join(some, "doc_id").select("block", "i", "j", "doc_id", "searches", "group", "shingles")
        more = saved(cross.groupBy("block", "i", "j").applyInArrow(_search(num, den), _LINK), "more-links")
        if not more.isEmpty():
            found = components(links.unionAll(more), "components-all")

    classes = reps.join(found.select(F.col("doc_id").alias("rep"), "component"), "rep", "left").select(*key, "many", F.coalesce("component", "rep").alias("component_id"))
    linked = even_join(full.select("doc_id", *key), saved(classes, "classes"), key, rows).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)


def _lists(posts: DataFrame) -> DataFrame:
    """shingle, block: the smallest doc_id of each list of two documents or more.

    It reads the same columns and rows as the caller's side of the join, so that one exchange serves both.
    """
    return posts.groupBy("shingle").agg(F.min("doc_id").alias("block"), F.max("doc_id").alias("last")).where("block < last").select("shingle", "block")


def _in_lists(posts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """doc_id, shingle, block of what stands in a list; ``hot`` shingles are never dealt by shingle."""
    cold = posts if hot is None else posts.join(F.broadcast(hot), "shingle", "left_anti").select("doc_id", "shingle")
    cold = cold.repartition("shingle")
    out = cold.join(_lists(cold), "shingle")
    if hot is not None:
        warm = posts.join(F.broadcast(hot), "shingle", "left_semi")
        out = out.unionByName(warm.join(F.broadcast(_lists(warm)), "shingle"))
    return out


#: What Spark would add to one side of a join alone.
_FULL = "doc_id is not null and shingle is not null"


def _needed(inside: DataFrame) -> DataFrame:
    """block, doc_id of the blocks in which a document must be (block, doc_id, k, least).

    A link shares ``least`` prefix shingles at least, for both its documents.  If each leaves blocks that hold fewer than
    half of them together, one shared shingle's block still has both.  A block's first document stays in it.
    """
    others = Window.partitionBy("doc_id").orderBy("k", "block").rowsBetween(Window.unboundedPreceding, 0)
    kept = inside.withColumn("left", F.sum(F.when(F.col("doc_id") != F.col("block"), F.col("k")).otherwise(0)).over(others))
    return kept.where("doc_id = block or left > (least - 1) div 2").select("block", "doc_id")


def _shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sets = [], []
            for i, x in shingle_sets(string_column(batch, "text"), n):
                at.append(i)
                sets.append(x.view(np.int64))
            kept = batch.select(["doc_id", "tasks"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "tasks", "shingles"])

    return run
