"""Places and small tables for the tests of this folder."""

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, first=0):
    rows = [(first + k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)
