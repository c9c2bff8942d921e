import numpy as np

from tickforge.llm.mixing import budgets, mix, pivot, reachable, thin


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 60).astype(float)
    p = rng.random(60)
    mean = np.zeros(60)
    for i in range(400):
        q = pivot(p, size, np.random.default_rng(i))
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 1
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6
        mean += q / 400
    assert np.abs(mean - p).max() < 0.12


def test_thin_keeps_mass_and_expectation():
    rng = np.random.default_rng(3)
    size = np.concatenate([[900.0, 0.0], np.exp(rng.normal(3, 1.5, 60)).round() + 1])
    for p in (0.03, 0.4, 0.91):
        mean, n = np.zeros(len(size)), 4000
        for k in range(n):
            q = thin(p, size, np.random.default_rng(k))
            odd = (q > 1e-9) & (q < 1 - 1e-9)
            assert odd.sum() <= 1 and abs((q * size).sum() - p * size.sum()) < 1e-6
            at_root = thin(p, size, np.random.default_rng(k), True)
            assert set(at_root) <= {0.0, 1.0} and abs((at_root * size).sum() - p * size.sum()) < 6
            mean += q / n
        assert np.abs(mean - p).max() < 4.5 * np.sqrt(p * (1 - p) / n)
    assert set(thin(1.0, size, rng)) == {1.0} and set(thin(0.0, size, rng)) == {0.0} and len(thin(0.5, size[:0], rng)) == 0


def test_budgets():
    targets = {"a": (0.5, 1), "b": (0.5, 10), "c": (0.0, 3)}
    got = budgets(targets, {"a": 100, "b": 100, "c": 50}, 1000)
    assert got == {"a": 100.0, "b": 900.0, "c": 0.0}
    assert reachable(targets, {"a": 100, "b": 100}) == 200.0
    assert reachable(targets, {}) == 0.0


def _items(spark, n=3000):
    rows = [(i, "big" if i % 3 else "small" if i % 2 else "odd", 1 + (i * 7919) % 120) for i in range(n)]
    return rows + [(n, None, 5), (n + 1, "big", None), (n + 2, "other", 9), (n + 3, "big", 0)]


def test_mix_meets_shares(spark):
    rows = _items(spark)
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.2, 1), ("small", 0.5, 4), ("odd", 0.3, 3), ("empty", 0.0, 2)], "source string, target_share double, max_repeats int")
    selection, report = mix(items, targets, all_met=True, fan_in=100)
    sel, rep = selection.toPandas(), report.toPandas().set_index("source")
    assert abs(rep.reached_share - rep.target_share).max() < 0.002
    tokens = {i: n for i, _, n in rows}
    assert (sel.copies <= sel.source.map({"big": 1, "small": 4, "odd": 3})).all() and (sel.copies > 0).all()
    assert sel.doc_id.is_unique and not set(sel.doc_id) & {3000, 3001, 3002}
    assert (sel.n_tokens == sel.doc_id.map(tokens)).all()
    assert (sel.n_tokens * sel.copies).sum() == rep.tokens.sum()
    again = mix(items.repartition(9), targets, all_met=True, fan_in=100)[0].toPandas()
    assert set(map(tuple, again.values.tolist())) == set(map(tuple, sel.values.tolist()))


def test_a_source_that_cannot_reach_its_share(spark):
    items = spark.createDataFrame(_items(spark), "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 0.1, 1), ("small", 0.9, 2)], "source string, target_share double, max_repeats int")
    report = mix(items, targets, total=150_000.0, fan_in=100)[1].toPandas().set_index("source")
    assert report.held_back["small"] and not report.held_back["big"]
    assert report.most_copies["small"] == 2 and report.reached_share.sum() > 0.999


def test_expectations_and_copies(spark):
    """Every document's expected copies, over many seeds, with one document that is a third of all rows."""
    rows = [(7, "a", 30)] * 200 + [(100 + i, "a", 1 + i % 90) for i in range(400)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").repartition(3)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    total, n, copies = 0.3 * sum(r[2] for r in rows), 12, 0
    for seed in range(n):
        s = mix(items, targets, total=total, seed=seed, fan_in=50)[0].toPandas()
        assert abs((s.n_tokens * s.copies).sum() - total) <= 90  # an item
        copies += s[s.doc_id == 7].copies.sum()
    assert abs(copies / n / 200 - 0.3) < 4 * np.sqrt(0.21 / 200 / n)


def test_empty(spark):
    items = spark.createDataFrame([], "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    selection, report = mix(items, targets)
    assert selection.count() == 0 and report.collect()[0]["tokens"] == 0
