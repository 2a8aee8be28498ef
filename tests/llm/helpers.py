"""Awkward tables that every operator has to take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with columns whose names clash with what operators add.
CLASHING = DOCS + ", size string, shard string, slot string, score string, row string, fp string, node string, k1 string, bundle string, text_key string, labels string, spans string, block string, path string, count string"


def documents(spark, texts, schema=DOCS):
    extra = len(schema.split(", ")) - 5
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) + ("x",) * extra for i, t in texts]
    return spark.createDataFrame(rows, schema)


AWKWARD = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (None, "zeta eta theta"), (None, None), (4, "é" * 50 + " ß    x"), (5, "w " * 30_000), (6, "  \n\t "), (7, "&&& !!! ...")]


def awkward(spark):
    return documents(spark, AWKWARD, CLASHING)


def empty(spark):
    return documents(spark, [])
