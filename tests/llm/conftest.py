import pytest
from pyspark.sql import functions as F

CLASHING = ["row", "node", "key", "size", "low", "bytes", "k1", "k_id", "_norm", "_part", "start", "window", "turns", "which", "payload", "n"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n=60):
    return " ".join(WORDS[(seed * 7 + k * (seed % 5 + 1) + k * k) % len(WORDS)] + str((seed * 31 + k) % 97) for k in range(n))


BASE = prose(1)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE + "  "), (4, BASE.replace(" ", "\n")), (5, BASE + " extra words here"), (6, "first " + BASE),
    (7, None), (8, ""), (9, " \t\n"), (10, None), (11, "one two"), (12, "one two"), (13, "ONE two"), (14, "éà ñ 日本 😀 ▁ x"),
    (15, prose(2, 4000)), (16, prose(3)), (17, prose(4)), (18, prose(4)), (18, prose(4)), (18, prose(5)), (None, prose(6)), (None, None),
    (20, prose(7) + " same"), (21, prose(7) + " other"), (22, "1234 5678 !!"), (23, "x" * 5000),
] + [(100 + k, "the same short text for many") for k in range(40)]


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, None if k % 7 == 0 else "en" if k % 2 else "de", None if k % 5 == 0 else "s", None) for k, (i, t) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(5)
    return docs.withColumns({c: F.lit(None).cast("int") if k % 2 else F.lit(c) for k, c in enumerate(CLASHING)})


@pytest.fixture(scope="session")
def none(messy):
    return messy.where("false")
