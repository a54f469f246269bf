"""What the join leaves on disk and sends while it runs."""

from docketlake.llm import ngram_join as J

from .test_llm import brute_components, brute_sets, docs_of, near_copies


def files(spark) -> int:
    return spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().length()


def test_shuffle_files_go_while_it_runs(spark):
    rows = near_copies(5, 20, 6)
    before = files(spark)
    out = J.similar_components(docs_of(spark, rows))
    left = files(spark) - before
    assert left < 20
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == brute_components(brute_sets(rows))


def test_tokens_go_only_for_sets_in_pairs(spark):
    sets = spark.range(20_000).selectExpr("id", "id AS n")
    pairs = spark.createDataFrame([(3, 9), (3, 17_000)], "a long, b long")
    kept = [r["id"] for r in J._sets_of(pairs, sets).collect()]
    assert {3, 9, 17_000} <= set(kept) and len(kept) < 200
    assert J._sets_of(pairs.limit(0), sets).count() == 0
