"""Findings of round 3 on the corpus operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import boosting, pii


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(5)
    word = lambda n, signs="abcdefghkmnpqrstuvwxyz": "".join(rng.choice(signs) for _ in range(n))
    texts = []
    for _ in range(60):
        texts += [f"write to {word(8)}@{word(6)}.org today", f"prices {word(5)} @ {word(4)} each", f"order {rng.randint(10**7, 10**8 - 1)} came", f"api_key = '{word(32, '0123456789abcdef')}' is set", f"so {word(24)} ends"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(docs).withColumn("base", pii.checked())
    return pii._within(found.where(F.col("base") | (F.col("kind") >= len(pii.BASE)))).localCheckpoint()


def test_every_labelled_span_counts(spans):
    """whatever the limit, which only bounds the bins of a feature, no span is left out of the sums that the model is made of."""
    want = pii._forms(spans).agg(F.count(F.lit(1)), F.sum("n"), F.sum("free")).first()
    for limit in (4, 48):
        cells, edges = pii.cells(spans, limit)
        assert tuple(cells.agg(F.sum("forms"), F.sum("n"), F.sum("free")).first()) == tuple(want)
        assert max(map(len, edges)) < limit


def test_trees_of_sums_are_those_of_rows(spark):
    """trees that grow by Spark's sums over a table separate as those do that a driver grows from all rows."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, (900, 3)).astype(float)
    y = ((x[:, 0] > 11) ^ (x[:, 1] > 20)).astype(int)
    rows = spark.createDataFrame([(int(k % 3), int(y[k]), 1, 1, bytes(x[k].astype(np.uint8))) for k in range(900)], "fold int, label int, n long, forms long, bins binary")
    edges = [np.arange(29) + 0.5] * 3
    bias, trees = boosting.boost_table(rows.repartition(5), edges, 3, 6, 2, 0.3)[3]
    own = (bias, [boosting.unbinned(t, edges) for t in trees])
    assert np.array_equal(boosting.margin(own, x), boosting.binned_margin((bias, trees), x.astype(np.uint8)))
    whole = boosting.boost(x, y, trees=6, depth=2, rate=0.3)
    assert np.abs(boosting.margin(own, x) - boosting.margin(whole, x)).max() < 0.05


def test_trees_grow_without_python_on_executors(spark, spans, monkeypatch):
    """op4_pii: bins, sums and margins are expressions; no batch goes through Python."""
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(0)), name, None)
    assert pii.learn(spans) is not None


def test_bins_and_margins_as_columns(spark):
    """op4_pii: bytes, bins and margins by expressions are those of arrays."""
    rng = np.random.default_rng(3)
    edges = [np.arange(250) + 0.5, np.array([]), np.array([0.25])]
    x = np.column_stack([rng.integers(0, 251, 300), rng.integers(0, 9, 300), rng.choice([0.0, 0.25, 0.5], 300)]).astype(float)
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, a double, b double, c double")
    model = (0.5, [({1: (0, 99), 3: (2, 0)}, {2: 0.25, 6: -1.0, 7: 2.0}), ({}, {1: 0.125})])
    own = df.select("k", boosting.packed([pii._binned(F.col(c), e) for c, e in zip("abc", edges)]).alias("raw")).withColumn("bins", boosting.unpacked(F.col("raw"), 3))
    rows = own.withColumn("z", boosting.margin_column(model)).orderBy("k").collect()
    want = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)
    assert [bytes(r.raw) for r in rows] == [w.tobytes() for w in want] and [r.bins for r in rows] == want.tolist()
    assert [r.z for r in rows] == boosting.binned_margin(model, want).tolist()
