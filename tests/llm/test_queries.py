"""Queries for language-model data on small fixtures."""

from tickforge.llm import queries


def test_mix_at_corpus_size_is_not_bound_by_one_source(spark, tmp_path):
    d = str(tmp_path)
    docs = [(i, "large" if i < 40 else "small", f"price {i} rises again today", "en") for i in range(42)]
    spark.createDataFrame(docs, "doc_id long, source string, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("large", 0.5, 2.0), ("small", 0.5, 2.0)], "source string, target_share double, max_repeats double").write.parquet(f"{d}/mix_targets.parquet")
    tokens = lambda df: df.selectExpr("sum(n_tokens * copies)").first()[0]
    whole, bound = queries.p9_mix(spark, d), queries.p9_mix_all_met(spark, d)
    assert tokens(whole) > 2 * tokens(bound)
    report = queries.p9_shares(spark, d)
    assert tokens(whole) == report.selectExpr("sum(tokens)").first()[0]


def _mix_tables(spark, d):
    docs = [(i, "a" if i < 20 else "b", f"price {i} rises again today", "en") for i in range(40)]
    docs += [docs[1], (1, "b", "price again", "en"), (None, "a", "price none", "en"), (2, "b", None, "en")]
    spark.createDataFrame(docs, "doc_id long, source string, text string, lang string").write.parquet(f"{d}/documents.parquet")
    targets = [("a", 0.5, 2), ("b", 0.5, 2), ("c", 0.0, None), ("d", 0.0, -1)]
    spark.createDataFrame(targets, "source string, target_share double, max_repeats int").write.parquet(f"{d}/mix_targets.parquet")


def test_mix_checks_of_odd_tables_equal_their_sql(spark, tmp_path):
    d = str(tmp_path)
    _mix_tables(spark, d)
    assert sorted(map(tuple, queries.p9_checks(spark, d).collect())) == [(s, False, 0) for s in "abcd"]


def test_mix_checks_find_faults(spark, tmp_path, monkeypatch):
    """A document used too often over several rows of the selection, one of another source, one without text, one that is no document."""
    d = str(tmp_path)
    _mix_tables(spark, d)
    rows = [(3, "a", 5, 2), (3, "a", 5, 1), (1, "a", 5, 2), (1, "a", 5, 2), (30, "a", 5, 1), (2, "b", 5, 1), (99, "b", 5, 1), (31, "b", 5, 2)]
    faulty = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies int")

    def found(selection):
        monkeypatch.setattr(queries, "_mixed", lambda *_: (selection, None))
        return {r["source"]: (r["above"], r["foreign"]) for r in queries.p9_checks(spark, d).collect()}

    assert found(faulty) == {"a": (True, 1), "b": (False, 2), "c": (False, 0), "d": (False, 0)}
    assert found(faulty.filter("doc_id <> 3"))["a"] == (False, 1)  # document 1 has two rows of its own


def test_mix_checks_take_each_row_and_the_largest_repeats_of_a_source(spark, tmp_path, monkeypatch):
    """One of two equal documents is used too often while the other makes up for it; a source is listed twice; a selected source is not listed."""
    d = str(tmp_path)
    _mix_tables(spark, d)
    listed = [("a", 0.5, 2), ("a", 0.1, 1), ("b", 0.5, 2), (None, 0.1, 2)]
    spark.createDataFrame(listed, "source string, target_share double, max_repeats int").write.mode("overwrite").parquet(f"{d}/mix_targets.parquet")
    sql = [("a", False, 0), ("a", False, 0), ("b", False, 0), (None, False, 0)]
    assert sorted(map(tuple, queries.p9_checks(spark, d).collect()), key=str) == sorted(sql, key=str)

    def found(rows):
        selection = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies int")
        monkeypatch.setattr(queries, "_mixed", lambda *_: (selection, None))
        return {tuple(r) for r in queries.p9_checks(spark, d).collect()}

    good = [(1, "a", 5, 2), (1, "a", 5, 2), (30, "b", 5, 2)]
    assert found(good) == set(sql)
    assert found([(1, "a", 5, 3), (1, "a", 5, 1)]) == {("a", True, 0), *sql[2:]}
    assert found([*good, (31, "z", 5, 1)]) == {*sql, ("z", True, 1)}
