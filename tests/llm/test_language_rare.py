"""A language of few documents is learned in a table of any size."""

from nestra.llm import language

TEXTS = {"en": "the quick brown fox jumps over the lazy dog", "el": "Πρώτο το μικρό καράβι που ήταν αταξίδευτο", "ka": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი"}


def test_few_documents_are_kept_beside_many(spark):
    rows = [(i, TEXTS["en"] + f" number {i} and more words", "en", "http://a.com/x") for i in range(200)]
    rows += [(1000 + i, TEXTS["el"], "el", None) for i in range(4)] + [(2000, TEXTS["ka"], "ka", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language.fit(docs).languages == ["el", "en", "ka", language.UNKNOWN]
    assert language.keep(docs).count() == 205 and language.identify(docs).where("language <> declared").count() == 0


def test_more_than_64_languages_of_one_document(spark):
    rows = [(i, TEXTS["en"], f"l{i}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language.fit(docs).languages) == 71
