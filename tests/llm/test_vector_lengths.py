from meterloom.llm import embeddings


def test_every_length_is_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.05]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.1]), (6, [1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (2, 1)}
