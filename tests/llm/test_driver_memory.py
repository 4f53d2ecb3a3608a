"""What the driver holds and plans: it stays small, and so do the steps of the pipeline."""

from __future__ import annotations

import tracemalloc
from contextlib import contextmanager

import numpy as np
import pytest

from tallywright.llm import components as links
from tallywright.llm.features import SIZE
from tallywright.llm.linear import Linear, Rows, fit
from tallywright.llm.mixing import fit_domains


@contextmanager
def most_held():
    """A list that gets the most bytes Python held meanwhile, beyond what it held before."""
    found = []
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        yield found
        found.append(tracemalloc.get_traced_memory()[1] - before)
    finally:
        tracemalloc.stop()


@pytest.fixture
def written(monkeypatch):
    """The tables that components write."""
    tables, stage = [], links.stage
    monkeypatch.setattr(links, "stage", lambda df, name: (tables.append(df), stage(df, name))[1])
    return tables


def test_links_that_are_stars_take_no_round(spark, written):
    edges = spark.createDataFrame([(1, 2), (1, 3), (7, 5), (9, 9)], "a long, b long").coalesce(1)
    assert dict(links.components(edges).collect()) == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5}
    assert len(written) == 1


def test_a_round_plans_what_comes_before_once(spark, written):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").repartition(8)
    assert set(links.components(edges).collect()) == {(i, 0) for i in range(61)}
    assert len(written) > 1
    for table in written[1:]:
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        # The links, and each of the two minima, with what the latter needs.
        assert plan.count("Relation") == 4 and "Union" not in plan


def test_a_root_that_is_a_node_and_a_node_of_two_roots_are_not_settled(spark):
    for stars, settled in (
        ([], True), ([(2, 1), (3, 1)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False),
    ):
        assert links._settled(spark.createDataFrame(stars, "node long, root long")) is settled


def test_fitting_holds_the_products_of_some_rows_at_a_time():
    rng = np.random.default_rng(3)
    width, count = 3000, 1000
    features = rng.integers(0, SIZE, width * count).astype(np.int32)
    rows = Rows(features, rng.random(width * count).astype(np.float32), np.arange(count + 1) * width)
    targets = rng.random(count).round()
    with most_held() as held:
        model = fit(rows, targets, SIZE, rounds=2)
        margins = model.margins(rows)
    assert held[0] < rows.features.nbytes + rows.values.nbytes
    whole = (model.weights[features] * rows.values).reshape(count, width).sum(axis=1)
    assert np.allclose(margins, whole)


def test_rows_without_features_and_no_rows_have_margins():
    rows = Rows.of([(np.array([1, 2]), np.array([0.5, 2.0])), (np.empty(0, int), np.empty(0)), (np.array([2]), np.ones(1))])
    weights = np.array([9.0, 2.0, 3.0])
    assert Linear(weights).margins(rows).tolist() == [7.0, 0.0, 3.0]
    assert Linear(weights).margins(Rows.of([])).tolist() == []
    assert fit(Rows.of([]), np.empty(0), 3).weights.tolist() == [0.0, 0.0, 0.0]


def test_counts_of_domains_reach_the_driver_as_columns(spark):
    rng = np.random.default_rng(5)
    names = ["de", "en", "es", "fr"]
    texts = [(i, " ".join(f"w{n}" for n in rng.integers(0, 10**9, 400)), names[i % 4]) for i in range(800)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, domain string").repartition(8)
    with most_held() as held:
        domains = fit_domains(rows.drop("domain"), rows.drop("text"), names)
    # A model of 2 MB. Rows of Python objects took 40 MB and more.
    assert held[0] < 20e6
    assert domains.logs.shape == (4, SIZE)
    assert np.allclose(np.exp(domains.logs).sum(axis=1), 1)
