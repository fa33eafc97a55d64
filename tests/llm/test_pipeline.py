import re

import pytest
from pyspark.sql import functions as F
from test_llm import DIR, EDGE, WORDS, brute_groups, docs, near_copies

from barograph.llm import jaccard_join, mixing, pseudonyms


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def key(r):
    return tuple(str(x) for x in r)


def test_stages_keep_columns_of_edges_and_empty_tables(spark, pipeline):
    for rows in (EDGE, []):
        d = docs(spark, rows).withColumnsRenamed({"doc": "score"}).withColumn("component_id", F.lit(1)).withColumn("size", F.lit(2))
        for name, stage in pipeline.STAGES[:-1]:
            got = stage(spark, d, DIR)
            assert got.columns == list(pipeline.COLUMNS), name
            assert got.count() <= 3 * len(rows)
        packed = pipeline.pack(spark, d, DIR).count()
        assert packed >= len(rows) and (rows or not packed)


def test_language_stage_uses_the_network(spark, pipeline):
    """Not a letter filter: a text whose halves are of two languages has letters, and no likelier language."""
    english, german = "the cat of the hat and the dog with ", "der Hund und die Katze von dem Haus "
    rows = [(4 * i, (english if i % 2 else german) * (1 + i % 5), "s") for i in range(80)]
    d = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 8 == 4, "en").otherwise("de")).drop("doc")
    between = [(10_000 + w, (english[:w] + german * 9)[: 2 * w]) for w in range(1, 120)]  # texts between both
    odd = spark.createDataFrame([(9001, None), (9002, "12 34"), (9003, ""), (None, english), *between], "doc_id long, text string")
    d = d.unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    kept = pipeline.language(spark, d, DIR)
    from barograph.llm import language_id

    judged = {r.doc_id: r for r in language_id.identify(d, language_id.fold(F.col("doc_id")) == 2).collect()}
    want = {i for i, r in judged.items() if r.lang_pred != "und" and r.score > 0.5}
    got = {r.doc_id for r in kept.collect()}
    assert got == want and {i for i, _, _ in rows} <= got and None in got and not got & {9001, 9002, 9003}
    unlabelled = d.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language(spark, unlabelled, DIR).count() == d.where(F.col("text").rlike("\\p{L}")).count()


def test_language_stage_rejects_what_has_letters(spark, pipeline, monkeypatch):
    monkeypatch.setattr(pipeline, "LEAST_SCORE", 0.99)
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    letters = d.where(F.col("text").rlike("\\p{L}")).count()
    assert 0 < pipeline.language(spark, d, DIR).count() < letters


def test_near_duplicates_equal_brute_force(spark, pipeline):
    rows = near_copies(11)
    d = docs(spark, rows + [(3, rows[3][1], "a"), (None, "x y z", "a")]).drop("doc")
    got = sorted((str(r.doc_id), r.text) for r in pipeline.near_duplicates(spark, d, DIR).collect())
    groups = brute_groups(rows, 5, 80, 100)
    assert got == sorted([(str(i), t) for i, t, _ in rows if groups[i][1] == i] + [("None", "x y z")])


def test_ids_repeated_with_other_texts(spark, pipeline):
    a, b, c = (" ".join(f"{x}{w}" for w in WORDS) for x in "abc")
    rows = [(1, a, "s"), (1, b, "s"), (1, b, "s"), (2, a, "s"), (3, b, "s"), (3, None, "s"), (4, c, "s")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs(spark, rows), 5, 80, 100).collect())
    n = len(WORDS) - 4
    assert got == [(1, n, 1)] * 3 + [(2, n, 2)] + [(3, n, 1)] * 2 + [(4, n, 4)]
    kept = sorted((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs(spark, rows).drop("doc"), DIR).collect())
    assert kept == [(1, a), (1, b), (2, a), (4, c)]


def test_hot_group_of_near_copies(spark):
    """A third of all documents are exact copies, a third near copies of one text: hot sets, shingles, blocks and hubs."""
    n = 9000
    base = [f"b{i}" for i in range(80)]
    near = F.concat(F.lit(" ".join(base)), F.lit(" tail"), F.col("id").cast("string"))
    other = F.concat_ws(" ", *[F.concat(F.lit(f"o{k}x"), F.col("id").cast("string")) for k in range(8)])
    text = F.when(F.col("id") % 3 == 0, F.lit(" ".join(WORDS))).when(F.col("id") % 3 == 1, near).otherwise(other)
    got = jaccard_join.jaccard_groups(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")), 5, 80, 100)
    want = F.when(F.col("doc_id") % 3 == 2, F.col("doc_id")).otherwise(F.col("doc_id") % 3)
    assert got.where(F.col("component_id") != want).isEmpty() and got.count() == n


def test_pii_and_mix_stages_equal_operators(spark, pipeline):
    rows = [(i, f"word number {i} 123-45-{6000 + i} and a.b{i}@mail.org", "ab"[i % 2]) for i in range(60)] + EDGE
    d = docs(spark, rows).drop("doc")
    p = pseudonyms.Pseudonyms(pipeline.DEMO_KEY)
    got = sorted(map(key, pipeline.pii(spark, d, DIR).collect()))
    new = [(i, t if t is None else p.text(t)[0], s) for i, t, s in rows]
    assert got == sorted(key((i, t, "en", s, None if t is None else len(t))) for i, t, s in new)
    taken = {}
    for r in mixing.mix(d, mixing.cyclic_weights(3), 3).collect():
        k = (str(r.doc_id), r.size)
        taken[k] = taken.get(k, 0) + (r.taken // r.size if r.size else 0)
    mixed = {}
    for r in pipeline.mix(spark, d, DIR).collect():
        k = (str(r.doc_id), len(re.findall("[^\\x20\\x09-\\x0D]+", r.text)))
        mixed[k] = mixed.get(k, 0) + 1
    assert mixed == {k: v for k, v in taken.items() if v}
