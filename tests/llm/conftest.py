import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A function that makes a documents table from (doc_id, text[, lang, source]) rows, with columns whose names clash with working ones."""

    def make(rows, extra=True):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], DOCS)
        if extra:
            for name in ("fp", "size", "key", "bucket", "target", "label", "score", "piece", "_order", "epoch", "component", "a", "b", "m", "node", "start", "skey", "x"):
                df = df.selectExpr("*", f"'clash' AS `{name}`")
        return df

    return make
