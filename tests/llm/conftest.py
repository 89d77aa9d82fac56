import pytest
from pyspark.sql import Row

DATA = "/root/testdata/sf0.001"
#: Columns of documents, and names that the operators use themselves.
CLASHES = "row text_hash gone spans _id _none _n _k _c _t _th _d _s _text _copy h1 h2 d1 d2 size taken quota label head y".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, rank int, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) with columns whose names the operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), None, 1, 2, *CLASHES) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows."""
    long_text = " ".join(f"word{k % 7000} filler" for k in range(12_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a short text"), (4, "a short text"), (None, "a text without a name"), (5, long_text), (6, "É ß 漢字 \x1c odd\x0b space"), (7, "a short text")]


def rows_of(df):
    return [r.asDict(recursive=True) if isinstance(r, Row) else r for r in df.collect()]
