from threadloom.llm.plans import once_each, p5_pieces

COLUMNS = "point_id string, ticket_id long, article_id long, article_position int, chunk_index int, text string"


def test_rows_without_point_id_stay(spark, tmp_path):
    rows = [("a", 1, 1, 0, 0, "eins"), ("a", 1, 1, 0, 0, "eins"), (None, 1, 1, 0, 1, "zwei"), (None, 1, 1, 0, 2, "drei " * 500)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(r["text"] for r in once_each(df, "point_id").collect()) == ["drei " * 500, "eins", "zwei"]
    df.write.parquet(f"{tmp_path}/points.parquet")
    texts = [r["text"] for r in p5_pieces(spark, str(tmp_path)).orderBy("chunk_index").collect()]
    assert texts[:2] == ["eins", "zwei"] and len(texts) == 4 and texts[2].startswith("drei")
