import numpy as np

from tessera.llm import pairs as P

ROWS = []
for i in range(40):
    ROWS.append((f"What is lesson {i}?", f"The lesson {i} explains the market of the river clearly.", True))
    ROWS.append((f"What is page {i}?", "I'm sorry, but I cannot answer this from the notes.", False))


def frame(spark, rows):
    return spark.createDataFrame([(i, q, a, ok, 1) for i, (q, a, ok) in enumerate(rows)], "review_id long, q string, a string, ok boolean, defect int")


def test_defects(spark, documents):
    cases = [
        ("What is it?", None, True, "empty"), ("What is it?", "<think>x</think>\n", True, "empty"), ("What is it?", "(R_chunk_0001)", True, "empty"), ("What is it?", "...", False, "empty"),
        ("What did the speaker say about the next page?", "I'm sorry, but I cannot answer this from the notes", True, "refusal"), ("What did the speaker say about the next page?", "I'm sorry, but I cannot answer this from the notes.", None, None),
        ("What did the speaker say about the next page?", "Question: what did the speaker say about the next page?", True, "copy"), ("What did the speaker say about the next page?", "What did the speaker say about the next page? What did the speaker say about the next page?", False, "copy"),
        ("What did the speaker say about the next page?", "The lesson explains the market of the", True, "truncated"), ("What did the speaker say about the next page?", "The lesson explains the market of the river clearly", True, None),
        ("What did the speaker say about the next page?", "The lesson explains the market of the river clearly. (R_chunk_00", True, "truncated"), ("What did the speaker say about the next page?", "The lesson explains the market of the (river", True, "truncated"),
        ("What did the speaker say about the class?", "نعيد النقطة الأخيرة ببطء. شرح المتحدث كيف يرتبط الدرس مع السوق.", True, "other_language"),
        ("What did the speaker say about the next page?", "The lesson explains the market of the river clearly. «كل يوم درس»", True, None), (None, "The lesson explains the market of the river clearly.", True, None),
    ]
    df = frame(spark, ROWS + [c[:3] for c in cases] + [("a", "b.", None)])
    df = df.unionByName(df.limit(3))
    got = {r.review_id: r.defect for r in P.defects(df, "review_id", "q", "a", "ok", documents).collect()}
    for i, c in enumerate(cases):
        assert got.get(len(ROWS) + i) == c[3], c


def test_empty_table(spark, documents):
    assert P.defects(frame(spark, ROWS[:1]).limit(0), "review_id", "q", "a", "ok", documents).count() == 0


def test_vector_counts_equal_plain_ones():
    parts = [["a", "b", "c", "b"], ["b", "c"]]
    h, of = P._flat(parts)
    plain = []
    for ws in parts:
        hs = P._hashes(ws)
        for i in range(len(ws)):
            for d in range(1, P.NEAR + 1):
                if i - d >= 0:
                    plain.append(int(P._mix(hs[i - d : i - d + 1], hs[i : i + 1], 20 + P._distance(d))[0] & np.uint64(P.ENDS - 1)))
    got = [int(k) for at, keys in P._end_keys(h, of)[2:] for k in keys]
    assert sorted(plain) == sorted(got)


def test_very_long_answer(spark, documents):
    df = frame(spark, [*ROWS, ("What did the speaker say about the next page?", "The lesson explains the market of the river clearly. " * 20_000, True)])
    assert P.defects(df, "review_id", "q", "a", "ok", documents).where("review_id = 80").count() == 0


def test_long_refusal(spark, documents):
    assert [len(w) for w in P.windows(["a"] * 131)] == [60, 60, 60, 41] and P.windows(["a"] * 60) == [["a"] * 60]
    q = "What did the speaker say about the next page?"
    plea, lesson = "I'm sorry, but I cannot answer this from the notes. ", "The lesson explains the market of the river clearly. "
    df = frame(spark, [*ROWS * 6, (q, plea * 8, True), (q, plea * 8, False), (q, lesson * 12, True), (q, lesson * 12 + plea * 8, True)])
    got = {r.review_id: r.defect for r in P.defects(df, "review_id", "q", "a", "ok", documents).where("review_id >= 480").collect()}
    assert got == {480: "refusal", 483: "refusal"}


def test_other_citation_forms_and_marks(spark, documents):
    q = "What did the speaker say about the next page?"
    said = "The lesson explains the market of the river clearly."
    cases = [("[source=DOC_17, DOC_18]", "empty"), ("[DOC_17", "empty"), (said + " [DOC_17; DOC_18]", None), (said + " (see_" + "x" * 90, "truncated"), ("The lesson explains «the market", "truncated")]
    df = frame(spark, [*ROWS * 3, *[(q, a, True) for a, _ in cases]])
    got = {r.review_id: r.defect for r in P.defects(df, "review_id", "q", "a", "ok", documents).collect()}
    assert [got.get(len(ROWS) * 3 + i) for i in range(len(cases))] == [d for _, d in cases]


def test_cells_are_the_counts(spark):
    answers = [("The river is long. It ended", True), ("No answer here.", False), (None, True), ("Two. Three four.", None)]
    df = spark.createDataFrame(answers * 3, "a string, ok boolean").repartition(3)
    m = P.train(df, "a", "ok")
    at = [int(P._mark_keys([x])[0]) for x in (".", "!")]
    assert m.ends[at[0]].tolist() == [9.0, 0.0] and m.ends[at[1]].tolist() == [0.0, 0.0]
    assert P.end_score(m, ["long"], ".") > 0 and P.train(df.limit(0), "a", "ok").ends.sum() == 0
