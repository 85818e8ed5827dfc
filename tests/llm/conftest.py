import pytest

from emberline.llm.store import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _settings(spark):
    session(spark)


@pytest.fixture
def odd_docs(spark):
    """Null, empty and blank texts, a very long one, ties, repeated rows and columns of clashing names."""
    passage = "one two three four five six seven eight nine ten. "
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 60_000), (5, passage * 12), (5, passage * 12), (6, passage * 12),
            (7, "Short."), (8, "héé 中文 👍 <|endoftext|> x\u00a0y\r\nz  end"), (9, "%%% ### " * 60), (None, "no id here")]
    extra = [f"7 AS {c}" for c in (
        "component_id", "kept", "n_tokens", "topic", "removed", "score", "label", "id", "key", "n_words", "base_failed", "probability",
        "text_a", "digest", "row", "held_out", "start", "n_lines", "failed_rule", "_id", "first_doc")]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    return frame.selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'en' END AS lang", "'s' AS source",
                            "length(text) AS n_chars", *extra)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
