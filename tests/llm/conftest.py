import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a very long text, repeated rows and clashing extra columns."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \n\t ", "en", "a", 4),
        (4, LONG, "en", "b", len(LONG)),
        (5, "The cat sat on the mat and the dog sat by the door of the house", "en", "a", 10),
        (5, "The cat sat on the mat and the dog sat by the door of the house", "en", "a", 10),
        (6, "123 456 !!", "fr", "b", 10),
        (7, "Le chat est sur la table et le chien est dans la maison avec nous", "fr", "b", 10),
        (None, "no id at all here", "fr", None, 3),
    ]
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA + ", score string, n long, id string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
