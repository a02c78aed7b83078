import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or give their results.
CLASH = ["key", "kind", "score", "text_key", "n_lines", "lang_pred", "w0", "node", "component_id", "sequence_id"]


@pytest.fixture
def docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``, with an extra column for each clashing name."""

    def build(*rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", None if r[1] is None else len(r[1])) for r in rows]
        frame = spark.createDataFrame(full, DOC)
        return frame.selectExpr("*", *[f"'x' AS {c}" for c in CLASH]) if extra else frame

    return build
