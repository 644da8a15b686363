"""Benchmark items too long for walks: verified without them, against edit distance over whole texts."""

import time

import numpy as np
import pyarrow as pa
import pytest

from acopio.llm import decontaminate
from acopio.llm.decontaminate import Index, edit_distance

VOCABULARY = [f"w{k}" for k in range(4000)]


def words(draw, n):
    return [VOCABULARY[k] for k in draw.integers(len(VOCABULARY), size=n)]


def changed(draw, x, edits):
    y = list(x)
    for _ in range(edits):
        kind, at = int(draw.integers(3)), int(draw.integers(len(y)))
        if kind == 0:
            y[at] = f"z{draw.integers(1 << 30)}"
        elif kind == 1:
            y.insert(at, f"z{draw.integers(1 << 30)}")
        else:
            del y[at]
    return y


def test_long_items_equal_whole_verification():
    draw = np.random.default_rng(7)
    items = [words(draw, n) for n in (70, 90, 120, 150)] + [["la"] * 80, ["do", "re", "mi"] * 30]
    index = Index([(k, " ".join(x)) for k, x in enumerate(items)], 0.2, 0.99, 3, 8)
    assert index.whole == set(range(len(items))) and not index.tables
    texts = []
    for k in range(60):
        x = items[k % len(items)]
        share = draw.choice([0.1, 0.19, 0.2, 0.23, 0.4])
        texts.append(" ".join(words(draw, int(draw.integers(40))) + changed(draw, x, int(share * len(x))) + words(draw, int(draw.integers(40)))))
    texts += [" ".join(items[0] + items[1]), " ".join(["la"] * 3000), "", " ".join(words(draw, 3000))]
    scan = decontaminate._matcher(index)
    got = {(d, i): m for d, i, m in scan(pa.array(texts))}
    want = {}
    for d, text in enumerate(texts):
        own = Index([(0, text)], 0.2, 0.99, 3, 8).words
        for i, x in enumerate(index.words):
            if own:
                cost, a, b = edit_distance(x, own[0])
                if cost <= index.edits[i]:
                    want[d, i] = (cost, a, b)
    assert want and {k: m[0] for k, m in got.items()} == {k: m[0] for k, m in want.items()}


@pytest.mark.parametrize("n", [300, 2000, 5000])
def test_recall_of_long_items(n):
    draw = np.random.default_rng(n)
    x = words(draw, n)
    scan = decontaminate._matcher(Index([(0, " ".join(x))], 0.2, 0.99, 3, 8))
    texts = [" ".join(words(draw, 60) + changed(draw, x, n // 5) + words(draw, 60)) for _ in range(10)]
    assert {d for d, _, _ in scan(pa.array(texts + [" ".join(words(draw, 3 * n))]))} == set(range(10))


def test_index_of_many_lengths_is_quick():
    draw = np.random.default_rng(3)
    began = time.process_time()
    index = Index([(n, " ".join(words(draw, n))) for n in range(8, 408)], 0.2, 0.99, 3, 8)
    assert len(index.tables) == 57 and len(index.whole) == 343
    assert time.process_time() - began < 30


def test_walks_that_do_not_reach_the_recall(monkeypatch):
    monkeypatch.setattr(decontaminate, "WALKS", 4)
    draw = np.random.default_rng(5)
    x = words(draw, 30)
    index = Index([(0, " ".join(x))], 0.2, 0.9999, 6, 8)
    assert index.whole == {0}
    texts = [" ".join(words(draw, 20) + changed(draw, x, 6) + words(draw, 20)) for _ in range(20)]
    assert {d for d, _, _ in decontaminate._matcher(index)(pa.array(texts))} == set(range(20))


def test_stage_with_a_long_item(spark):
    draw = np.random.default_rng(9)
    x = words(draw, 5000)
    docs = spark.createDataFrame([(1, " ".join(words(draw, 100))), (2, " ".join(changed(draw, x, 900))), (3, " ".join(x[:3000]))], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(x)), (2, "eight words in a row that are short")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, benchmark).collect()} == {1, 3}
