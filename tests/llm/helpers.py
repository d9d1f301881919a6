"""Small tables with awkward rows: nulls, empties, ties, repeats, and extra columns whose names clash with results."""

AWKWARD = [None, "", " ", "\n\n", "one", "one", "É è 😀   x", "a" * 3000, "word " * 4000, "\0nul", "tab\tand  two"]


def documents(spark, texts, first=0):
    rows = [(None if i == 0 and t is None else first + i, t, 7, "clash", 1.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, component_id string, score double, spans string")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
