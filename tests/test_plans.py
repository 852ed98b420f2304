"""Plans of queries that once moved much more than their input, or held more of it than a task should."""

from lectern.plans import catalog, papers


def plan(spark, sf, name):
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_authors_are_not_copied_for_each_count(spark, sf):
    assert "Expand" not in plan(spark, sf, "author_validation")


def test_words_of_a_text_are_counted_in_its_row(spark, sf):
    assert "Exchange" not in plan(spark, sf, "keyword_coverage")


def test_references_are_not_copied_for_each_count(spark, sf):
    assert "Expand" not in plan(spark, sf, "reference_scores")


def test_tasks_of_characters_grow_with_their_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(papers, "TASK_ROWS", 500)
    df = catalog.queries()["words_of_characters"](spark, sf)
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort ") == 1
    assert df.rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() // 500


def test_texts_are_counted_once_for_all_scores_of_an_abstract(spark, sf):
    p = catalog.queries()["abstract_quality"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("lower(") == 1 and p.count(r"\S+") == 1 and "split(" not in p
