import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import EDGE, docs

from barograph.llm import language_id, mixing, shared


def test_tables_of_pairs_equal_filters():
    """Prediction's looked-up pairs against a plain convolution."""
    rng = np.random.default_rng(0)
    net = language_id.ByteNet(["a", "b", "c"], 3)
    net.shift[:] = rng.normal(0, 1, len(net.shift))
    net.paired()
    x = rng.integers(0, 256, (20, language_id.WINDOW + language_id.PAD)).astype(np.uint8)
    plain = np.full((20, len(net.shift)), -np.inf)
    for f in range(len(net.shift)):
        width = sum(f < n for n in net.reach)
        for t in range(language_id.WINDOW):
            plain[:, f] = np.maximum(plain[:, f], sum(net.places[i][x[:, t + i], f] for i in range(width)))
    plain += net.shift
    np.testing.assert_allclose(net.largest(x), plain, atol=1e-4)
    np.testing.assert_allclose(net.pooled(x)[0], plain, atol=1e-4)


def test_whole_texts_equal_brute_force(spark, monkeypatch):
    rows = [(i, ("the of and " if i % 2 else "der die das ") * (1 + i * 13 % 90), "s") for i in range(60)]
    lang = F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de")
    df = docs(spark, rows).withColumn("lang", lang)
    nets = []
    train = language_id.train
    monkeypatch.setattr(language_id, "train", lambda rows: nets.append(train(rows)) or nets[-1])
    got = {r.doc_id: r for r in language_id.identify(df, F.col("doc_id") % 4 == 2).collect()}
    (net,) = nets
    for i, text, _ in rows:
        data, total = text.encode(), np.zeros(2)
        for a in range(0, len(data), language_id.WINDOW):
            part = np.zeros((1, language_id.WINDOW + language_id.PAD), np.uint8)
            part[0, : len(data[a : a + language_id.WINDOW])] = list(data[a : a + language_id.WINDOW])
            total += np.log(language_id.softmax(net.logits(net.pooled(part)[0]).astype(float))[0] + 1e-9) * len(data[a : a + language_id.WINDOW])
        p = language_id.softmax((total / len(data))[None])[0]
        assert got[i].lang_pred == net.languages[p.argmax()] and got[i].score == pytest.approx(p.max(), abs=1e-5)
        assert got[i].held_out == (i % 4 == 2)


def test_every_label_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 1)
    df = docs(spark, [(i, f"text {i}", "s") for i in range(700)]).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 70).cast("string")))
    for labels in (10_000, 5):  # by broadcast, by a shuffle
        monkeypatch.setattr(language_id, "LABELS", labels)
        rows = language_id.training_rows(df, 4)
        assert rows.num_rows == 280 and len(set(rows["lang"].to_pylist())) == 70
        assert language_id.training_rows(df, 4, most=140).num_rows == 140


def test_identify_edges(spark):
    assert language_id.identify(docs(spark, []), F.lit(False)).count() == 0
    df = docs(spark, EDGE).withColumnRenamed("doc", "score").withColumn("lang", F.lit("en"))
    out = language_id.identify(df, F.lit(False), keep=("doc_id", "source", "n_chars"))
    assert out.columns == ["doc_id", "source", "n_chars", "held_out", "lang_pred", "score"] and out.count() == len(EDGE)


def test_mix_of_many_sources_equals_broadcast(spark):
    """More sources than are sent to the scan, one of them hot, null among them, and columns that pass through."""
    rows = [(i, "w " * (1 + i % 7), None if i % 5 == 0 else "hot" if i % 5 < 3 else f"s{i % 40}") for i in range(800)] + EDGE
    df = docs(spark, rows)
    key = lambda r: str((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken))
    want = sorted(map(key, mixing.mix(df, mixing.cyclic_weights(3), 3).collect()))
    got = mixing.mix(df, mixing.cyclic_weights(3), 3, most=5)
    assert sorted(map(key, got.collect())) == want and len(want) == len(rows)
    for most in (5, 10_000):
        kept = mixing.mix(df, mixing.cyclic_weights(3), 3, most=most, keep=("doc", "doc_id", "source", "text"))
        assert kept.columns == ["doc", "doc_id", "source", "text", "size", "source_size", "target", "taken"]
        assert sorted(map(key, kept.collect())) == want


def test_saved_tables_go(spark, tmp_path):
    before = shared.written()
    df = shared.saved(spark.range(5), "some")
    (path,) = shared.written() - before
    assert df.count() == 5
    shared.forget({path})
    from pathlib import Path

    assert shared.written() == before and not Path(path.removeprefix("file:").replace("//", "/")).exists()


def test_even_join_and_without(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("doc_id"))
    one = rows.groupBy("k").agg(F.count("*").alias("many"), F.min("doc_id").alias("least"))
    got = shared.even_join(rows, one, ["k"], 3000)
    assert got.count() == 3000 and {r.least for r in got.where("k = 7").collect()} == {0}
    left = shared.without(rows, rows.where("k = 7").select("doc_id"))
    assert left.columns == rows.columns and left.count() == 1999 and left.where("k = 7").isEmpty()
