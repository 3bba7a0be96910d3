from tessera.llm import langid


def test_labels_in_any_notation(spark):
    from pyspark.sql import functions as F

    given = {"en": "en", "English": "en", "eng": "en", "en-GB": "en", " UR ": "ur", "zh_CN": "zh", "Farsi": "fa", "xx": None, "unknown": None, "??": None, "": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in given.items()], "k string, v string").withColumn("got", langid.label_code(F.col("k")))
    assert all(r.v == r.got for r in df.collect())


def test_languages_and_edges(spark, matrix):
    rows = [(1, "We read the lesson and the class ended."), (2, "Hum ne yeh sabaq mein baat ki thi."), (3, "ผู้บรรยายอธิบายบทเรียน"), (4, None), (5, ""), (6, " \n"), (7, "123 ... 45"), (1, "We read the lesson and the class ended."), (8, "Ｗｅ ｒｅａｄ the les​son aloud")]
    got = langid.detect(spark.createDataFrame(rows, "k long, text string").selectExpr("k", "text", "1 AS lang"), "k", "text", matrix)
    by = {r.k: r for r in got.collect()}
    assert got.count() == 9
    assert [by[k].lang for k in (1, 2, 3, 4, 5, 6, 7, 8)] == ["en", "ur", "th", None, None, None, None, "en"]
    assert by[4].confidence == 0 and 0.5 < by[1].confidence <= 1


def test_long_text_and_mix(matrix):
    en, ar = "We read the next page of the lesson aloud. ", "نعيد النقطة الأخيرة ببطء. شرح المتحدث الدرس. "
    x = langid.shares([en * 30_000, (en + ar) * 20, en * 9 + ar], matrix)
    best = [langid._best(r) for r in x]
    assert best[0][0] == "en" and best[0][2] is None
    assert {best[1][0], best[1][2]} == {"en", "ar"} and best[1][3] >= langid.MIXED_SHARE
    assert best[2][0] == "en" and best[2][3] < langid.MIXED_SHARE


def test_stretches_cover_the_languages(spark, matrix):
    df = spark.createDataFrame([(1, "We read the next page of the lesson aloud. نعيد النقطة الأخيرة ببطء. شرح المتحدث كيف يرتبط الدرس.", "x"), (2, None, "x"), (3, "", "x")], "k long, text string, lang string")
    got = sorted(langid.detect_stretches(df, "k", "text", matrix).collect(), key=lambda r: r.start_pos)
    assert [(r.k, r.lang) for r in got] == [(1, "en"), (1, "ar")] and got[0].end_pos <= got[1].start_pos


def test_empty_tables(spark, matrix):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.detect(empty, "doc_id", "text", matrix).count() == 0
    assert langid.train(empty, "text", "lang").shape == matrix.shape
    none = langid.found_items(spark, empty, spark.createDataFrame([], "q_key long, question string, question_language string"), spark.createDataFrame([], "seg_key long, version string, text string"))
    assert none.count() == 0


def test_found_items(spark, documents):
    en, ar = "We read the next page of the lesson aloud. ", "نعيد النقطة الأخيرة ببطء. شرح المتحدث كيف يرتبط الدرس. "
    more = spark.createDataFrame([(100, en, None), (101, en, "ar"), (102, en, "en-US"), (103, None, "en"), (104, en + ar, "en")], "doc_id long, text string, lang string")
    q = spark.createDataFrame([(1, "What did the speaker say about the lesson and the class?", "turkish"), (2, None, None)], "q_key long, question string, question_language string")
    s = spark.createDataFrame([(7, "v2", en + ar), (7, "v2", en + ar), (8, "v3", en + ar)], "seg_key long, version string, text string")
    got = {(r.item_kind, r.item_key, r.found_lang) for r in langid.found_items(spark, documents.unionByName(more), q, s).collect()}
    assert {("document", 100, "en"), ("document", 101, "en"), ("mixed_document", 104, "ar+en"), ("question", 1, "en"), ("mixed_segment", 7, "ar+en")} <= got
    assert not [x for x in got if x[1] in (102, 103, 8) or x[:2] == ("question", 2)]


def test_stretches_and_languages_of_every_item(spark, documents):
    mixed = "The river is long and the lesson ended today. یہ بات پچھلے سبق میں بھی آئی تھی۔"
    segments = spark.createDataFrame([(7, "v2", mixed), (7, "v2", mixed), (8, "v1", mixed), (9, "v2", None)], "seg_key long, version string, text string")
    got = langid.stretches_of_items(documents, segments).where("item_kind = 'segment'").collect()
    assert [(r.item_key, r.lang) for r in sorted(got, key=lambda r: r.start_pos)] == [(7, "en"), (7, "ur")] and all(0 < r.confidence <= 1 for r in got)
    questions = spark.createDataFrame([(1, "The speaker explained the lesson."), (2, None)], "q_key long, question string")
    found = {(r.item_kind, r.item_key): (r.lang, r.confidence) for r in langid.languages_of_items(documents, questions).collect()}
    assert len(found) == documents.count() + 2
    assert found["question", 1][0] == "en" and found["question", 1][1] > 0 and found["question", 2] == (None, 0.0)


def test_many_rows_at_once(matrix):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.integers(0, 4, (200, len(langid.LANGUAGES) + 1)).astype(float)
    rows[:5, :-1] = 0
    first, conf, second, share, n = langid.best(rows)
    got = list(zip(langid.named(first).to_pylist(), conf.tolist(), langid.named(second).to_pylist(), share.tolist(), n.tolist()))
    assert got == [langid._best(r) for r in rows]
    assert all(len(x) == 0 for x in langid.best(np.zeros((0, len(langid.LANGUAGES) + 1))))
