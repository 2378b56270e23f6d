"""Long lines in two documents, and lines without spaces, in the pipeline."""

import corpus_pipeline

LONG = "a passage which stands word for word in exactly two of all the documents " * 4
CJK = "本网站的所有内容均受版权保护" * 9


def test_the_stage_drops_long_lines_of_two_documents(spark):
    texts = {1: f"{LONG}\none alone\nshort pair", 2: f"{LONG}\ntwo alone\nshort pair", 3: f"{CJK}2019年\nthree alone", 4: f"{CJK}2020年\nfour alone",
             5: "https://x.y\nfive", 6: "https://x.y\nsix", 7: "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15\nseven", 8: "9 8 7 6 5 4 3 2 1 0 11 12 13 14 15\neight"}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_recurring_lines(spark, docs, "unused").collect()}
    expected = texts | {2: "two alone\nshort pair", 4: "four alone"}
    assert got == {i: (t, len(t)) for i, t in expected.items()}
