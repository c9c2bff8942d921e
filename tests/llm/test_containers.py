import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickforge.llm.containers import difference, fill, fill_report, pack


@given(st.lists(st.integers(0, 100), max_size=80))
@settings(max_examples=60, deadline=None)
def test_fill_never_exceeds(sizes):
    sizes = np.array(sizes, np.int64)
    w = fill(sizes, 100)
    assert len(w) == len(sizes)
    if len(sizes):
        assert np.bincount(w, sizes).max() <= 100


def test_difference_balances():
    assert sorted(np.bincount(difference(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    rng = np.random.default_rng(2)
    s = rng.integers(1, 100, 400)
    load = np.bincount(difference(s, 20), s)
    assert load.max() - load.min() <= 2


def test_pack_is_whole(spark):
    rows = [(i, (i * 37) % 300) for i in range(400)] + [(1000, 5000), (1001, 256), (1002, 257), (1003, 0), (1004, None), (1001, 256)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    kinds = spark.createDataFrame([("short", 256), ("long", 4096), ("none", 0), (None, 10)], "container_kind string, capacity_tokens int")
    packed = pack(items, kinds, windows=16)
    p = packed.toPandas()
    for kind, cap in (("short", 256), ("long", 4096)):
        x = p[p.container_kind == kind]
        assert x.n_tokens.sum() == sum(n or 0 for _, n in rows)
        assert x.groupby("container_id").n_tokens.sum().max() <= cap
        pieces = x[x.doc_id == 1000].sort_values("piece_no")
        assert pieces.n_tokens.sum() == 5000 and (pieces.n_tokens[:-1] == cap).all() and list(pieces.start) == [cap * i for i in range(len(pieces))]
        whole = x[(x.doc_id < 400)].groupby("doc_id").size()
        assert (whole[[i for i, n in rows[:400] if n <= cap]] == 1).all()
        assert len(x[x.doc_id == 1001]) == 2 and len(x[x.doc_id == 1003]) == 1 and not len(x[x.doc_id == 1004])
    report = {r["container_kind"]: r for r in fill_report(packed, kinds).collect()}
    assert report["long"]["utilisation"] > 0.9
    blocks = pack(items, kinds, windows=4, most_items=40)  # several levels
    assert blocks.groupBy("container_kind", "container_id").agg({"n_tokens": "sum"}).filter("container_kind = 'short' and `sum(n_tokens)` > 256").count() == 0
    assert sorted(blocks.select("container_kind", "doc_id", "piece_no", "start", "n_tokens").collect()) == sorted(packed.select("container_kind", "doc_id", "piece_no", "start", "n_tokens").collect())
    assert set(p.container_kind) == {"short", "long"}
    assert pack(items.limit(0), kinds).count() == 0 and pack(items, kinds.limit(0)).count() == 0


def test_containers_are_full(spark):
    """Heavy-tailed sizes like those of texts: as good as the least number of containers."""
    rng = np.random.default_rng(3)
    sizes = np.minimum(np.exp(rng.normal(4.75, 1.0, 10_000)).astype(int) + 1, 12_000)
    items = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(sizes)), "n_tokens": sizes}))
    kinds = spark.createDataFrame([(str(c), c) for c in (256, 1024, 4096)], "container_kind string, capacity_tokens int")
    for r in fill_report(pack(items, kinds), kinds).collect():
        assert r["utilisation"] > 0.995 and r["tokens"] == sizes.sum() and r["fullest"] <= r["capacity_tokens"]


def test_copies_and_multiples_do_not_gather(spark):
    """A third of all rows is one item, and another is a multiple of the capacity: blocks stay bounded."""
    rows = [(7, 100)] * 600 + [(8, 256 * 500)] + [(i, 50) for i in range(1000, 1600)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    kinds = spark.createDataFrame([("short", 256)], "container_kind string, capacity_tokens int")
    p = pack(items, kinds, windows=32).toPandas()
    assert p.groupby("container_id").n_tokens.sum().max() == 256 and len(p[p.doc_id == 7]) == 600 and p[p.doc_id == 8].container_id.nunique() == 500


def test_bad_sizes_are_no_items(spark):
    items = spark.createDataFrame([(1, -5), (2, None)], "doc_id long, n_tokens int")
    kinds = spark.createDataFrame([("short", 256)], "container_kind string, capacity_tokens int")
    assert pack(items, kinds).count() == 0


def test_long_text_tokens(spark):
    from tickforge.llm.tokens import VOCABULARY, encoder, with_sizes

    try:
        enc = encoder(VOCABULARY)
    except OSError:
        pytest.skip("no vocabulary here")
    text = "Der Hund läuft. " * 20_000
    rows = [(1, text), (2, ""), (3, None), (4, "<|endoftext|> it's 12")]
    got = {r[0]: r[1] for r in with_sizes(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert got == {1: len(enc.encode_ordinary(text)), 2: 0, 4: len(enc.encode_ordinary(rows[3][1]))}
    assert enc.decode(enc.encode_ordinary(text)) == text
