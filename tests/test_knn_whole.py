from strandloom.plans import catalogue


def test_knn_levenshtein_predicts_all_documents(spark, tmp_path):
    docs = [(i, "acgt" * (i % 7) + "tt" * (i % 3)) for i in range(90, 130)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(90, 130, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = catalogue.queries()["knn_levenshtein"](spark, str(tmp_path)).collect()
    assert sorted(r.seq_id for r in got) == [i for i, _ in docs]
    assert "% 100" not in catalogue.oracle_sql()["knn_levenshtein"] and "% 100" in catalogue.oracle_sql()["knn_proba"]
