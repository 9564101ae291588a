import os

import pytest

SF = "/root/testdata/sf0.001"
PASSAGE = "The river ran past the old mill, and the miller's daughter counted every wagon that crossed the narrow bridge before dusk; nobody else did so. "
WORDS = [f"word{i}" for i in range(40)]
#: Columns whose names the operators use themselves.
CLASHES = ["id", "digest", "n", "bucket", "part", "score", "file", "row", "band", "size", "_b_text", "length", "rank"]
TEXTS = [
    (1, " ".join(WORDS)),
    (2, " ".join(WORDS[:-1])),  # near copy of 1
    (3, "\t".join(WORDS)),  # equal to 1 up to white space
    (4, None),
    (5, ""),
    (6, "   \n"),
    (7, "Three short words"),
    (8, "three  SHORT words"),
    (9, "one " + PASSAGE + " alpha"),
    (10, "two " + PASSAGE + PASSAGE + " beta"),
    (11, "Łódź ünïcode 日本語 のテキスト 🙂🙃 'tis don't we'll it'd 12345 ١٢٣  x"),
    (12, "Łódź ünïcode 日本語 のテキスト 🙂🙃 'tis don't we'll it'd 12345 ١٢٣  x"),
    (13, "ab" * 400),
    (14, "<|endoftext|> </s> <unk> ▁ under_score"),
    (15, " ".join(f"long{i % 997} tail{i % 31}" for i in range(20_000))),
    (16, " ".join(f"long{i % 997} tail{i % 31}" for i in range(20_000)) + " end"),
    (17, " ".join(WORDS)),  # equal to 1
    (18, "a\x00b \x1c c\x85d e　f"),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def table_of(spark, tmp_path_factory):
    """Writes rows (doc_id, text) with columns whose names clash, and reads them back."""

    def make(rows):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        spark.createDataFrame([(i, t, *("x" for _ in CLASHES)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def odd(table_of, texts):
    return table_of(texts)


@pytest.fixture(scope="session")
def none(table_of):
    return table_of([])


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
