"""Hashes of words by eight bytes at a time, and the join of n-grams with their counts."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from barograph.llm import ngram_lm, shared


@pytest.mark.parametrize("lower", [False, True])
def test_equal_words_have_equal_hashes_and_others_not(lower):
    rng = np.random.default_rng(1)
    some = ["".join(rng.choice(list("abAB \n\tx\x0b\x00é漢"), rng.integers(0, 150))) for _ in range(800)]
    ends = ["a" * k + "b" * (k % 3) for k in range(70)]  # around eight bytes and what is beyond them
    rows = [*some, "", "  ", None, *ends, "q" * 500, "q" * 501, "Q" * 500, "a\x00", "a", " ".join(ends)]
    row, h = shared.word_hashes(*shared.raw(shared.string_column(pa.record_batch({"text": rows}), "text")), lower)
    fold = {c: c + 32 for c in range(65, 91)} if lower else {}
    want = [(i, w) for i, t in enumerate(rows) for w in re.findall(shared.WORD, (t or "").translate(fold))]
    assert row.tolist() == [i for i, _ in want]
    of, back = {}, {}
    for (_, w), x in zip(want, h.tolist(), strict=True):
        assert of.setdefault(w, x) == x and back.setdefault(x, w) == w


def test_hashing_takes_a_bounded_multiple_of_the_text():
    text = np.frombuffer((b"some ordinary words of a text " * 70_000)[: shared.STEP_BYTES], np.uint8)
    tracemalloc.start()
    shared.word_hashes(text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(text)


def test_ngrams_of_one_document_are_not_in_the_join(spark, monkeypatch):
    plans, keep = [], ngram_lm.saved

    def saved(df, tag):
        if tag == "slice":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, tag)

    monkeypatch.setattr(ngram_lm, "saved", saved)
    docs = spark.createDataFrame([(i, f"one two three w{i} w{i + 1} w{i + 2}") for i in range(50)], "doc_id long, text string")
    assert ngram_lm.stupid_backoff(docs, slices=1).count() == 50
    assert len(plans) == 1 and re.search(r"here#\d+L > 1", plans[0])
    assert "ReusedExchange" in plans[0]  # texts are read once a slice


def test_workers_give_back_memory_at_the_end_of_a_task():
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    def run(batches):
        held = [np.ones(5_000) for _ in range(4_000)]  # 160 MB in pieces that the allocator keeps
        seen.append(np.ones(5_000))  # stays at the heap's end
        yield from batches
        del held
        seen.append(resident())

    seen = []
    assert len(list(shared.tidied(run)(iter([1, 2])))) == 2
    assert resident() < seen[1] - 100
