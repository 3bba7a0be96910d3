from tessera.plans import evaluation


def test_integrity_finds_what_differs(spark, tmp_path):
    q = spark.createDataFrame([(1, "a?", True, ["c1"]), (2, "b?", None, None), (3, "c?", False, [])], "q_key long, question string, answerable boolean, gold_chunk_ids array<string>")
    rows = [
        (1, 1, "a?", True, ["c1"], ["c1"], "see c1"), (2, 1, "A?", True, ["c1"], [], ""), (3, 1, "a?", None, ["c1"], [], ""), (4, 1, "a?", True, None, [], ""), (5, 9, "z?", True, [], [], ""),
        (6, 1, "a?", True, ["c1"], ["c1", "c2"], "see c1"), (7, 2, "b?", None, None, None, None), (8, 3, "c?", False, [], ["x"], None), (8, 3, "c?", False, [], ["x"], None),
    ]
    r = spark.createDataFrame(rows, "review_id long, q_key long, question string, answerable boolean, gold_chunk_ids array<string>, cited_chunk_ids array<string>, generated_answer string")
    q.write.parquet(str(tmp_path / "questions.parquet")), r.write.parquet(str(tmp_path / "reviews.parquet"))
    got = {x.review_id: x.issue for x in evaluation.review_integrity(spark, str(tmp_path)).collect()}
    assert got == {2: "question", 3: "answerable", 4: "gold", 5: "no question", 6: "citations", 8: "citations"}


def test_structure_classes(spark, tmp_path):
    rec = {"neutral": (10, 10, 5, 5), "split": (10, 20, 4, 2), "merge": (20, 10, 2, 4), "both": (10, 20, 4, 4)}
    rows = [(f"{r}{v}{i}", r, v, i, " ".join(["w"] * w)) for r, (n2, n3, w2, w3) in rec.items() for v, n, w in (("v2", n2, w2), ("v3", n3, w3)) for i in range(n)]
    df = spark.createDataFrame([(k, *x) for k, (_, *x) in enumerate(rows)] + [(10_000, "only", "v3", 0, "w")], "seg_key long, recording string, version string, seq int, text string")
    df.write.parquet(str(tmp_path / "segments.parquet"))
    got = {x.recording: x.structure for x in evaluation.structure_classes(spark, str(tmp_path)).collect()}
    assert got == {r: r for r in rec} | {"only": "none"}
