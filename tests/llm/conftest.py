import pytest

DOCS = [
    ("The speaker explained how the lesson is connected with the market and the river.", "en"), ("We read the next page aloud and then the class ended.", "English"),
    ("Yeh baat pichle sabaq mein bhi aai thi aur sab log khush thay.", "ur"), ("Aaj hum is kitaab par tafseel se baat karein ge.", "urdu"),
    ("یہ بات پچھلے سبق میں بھی آئی تھی۔ ہم نے بہت کچھ پڑھا۔", "ur"), ("شرح المتحدث كيف يرتبط الدرس مع السوق. نعيد النقطة الأخيرة ببطء.", "ar"),
    ("امروز می‌خواهیم دربارهٔ درس گفت‌وگو کنیم. خب، نکتهٔ پیشین را بشنوید.", "fa"), ("Bugün bu konu üzerinde uzun uzun duracağız. Lütfen oturun da başlayalım.", "tr"),
    ("Hari ini kita membahas pelajaran dengan lebih teliti. Silakan duduk supaya kita bisa mulai.", "id"), ("आज हम पाठ पर विस्तार से बात करेंगे। कृपया बैठ जाइए।", "hi"), ("今天我们仔细谈谈这一课。请大家坐好。", "zh-CN"),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(DOCS * 3)], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def matrix(documents):
    from tessera.llm import langid

    return langid.train(documents, "text", "lang")
