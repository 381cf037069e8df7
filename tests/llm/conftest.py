import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given texts, doc_id counting from 0; extra columns have names that operators might use."""

    def make(texts, **columns):
        names = ["doc_id", "text", "lang", "source", "n_chars", "score", "kept", "start"]
        rows = [(k, t, columns.get("lang", {}).get(k), columns.get("source", {}).get(k), None if t is None else len(t), None, None, None) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))

    return make
