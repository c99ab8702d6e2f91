"""What stands late in a long document is found."""

from veinwork.plans import catalog
from veinwork.plans.base import PLACES


def test_late_terms_are_found(spark, tmp_path):
    long = "filler words of no use\n" * 400
    docs = [(1, long + "zeppelin quartz", "en", "s1", 0), (2, long, "en", "s2", 0), (3, long + "other ending", "en", "s3", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "zeppelin quartz")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    df = {r["term"]: r["df"] for r in run("term_idf_whole")}
    assert 1 in df.values()
    assert 1 in {r["df"] for r in run("term_idf")}  # over chunks, of which the last has the term
    for name in ("lexical_topk", "weighted_coverage", "phrase_coverage", "exact_match"):
        best = min(run(name), key=lambda r: r["rank"])
        assert best["ord"] // PLACES == 1 and best["ord"] % PLACES > 5, name
    for name in ("lexical_topk_whole", "weighted_coverage_whole", "phrase_coverage_whole", "exact_match_whole"):
        score = {r["ord"]: r["score"] for r in run(name)}
        assert score[1] > score.get(2, 0.0) and score[1] > score.get(3, 0.0), name
