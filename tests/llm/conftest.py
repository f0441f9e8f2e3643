from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


#: Texts that the operators must survive: null, empty, white space, one word, odd characters.
ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "a b c d", "a b c d e", "'s 'S don't I'll we've", "é́ ñ 漢字 🙂👍🏽  x\x85y\x1cz",
    "<|endoftext|> inside <|endoftext|>", "x" * 5000, ("same line here\n" * 400), "\U00050000 unassigned \U0010ffff end",
    " leading and trailing  ", "1234 5 ½ ٣", "ΑΣ ΣΑΣ İ ǅ",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a repeated row, a null id, and extra columns with clashing names."""
    rows = [(i, t, "src0", None, i, "x") for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "\n\n", "src0", None, 3, "x"), (None, "null id text", None, "en", None, None)]
    clashing = ["in_0", "in_1", "_slot", "_before", "_gone", "text_", "node", "rep", "removed"]
    schema = "doc_id long, text string, source string, lang string, batch long, h string" + "".join(f", {c} string" for c in clashing)
    return spark.createDataFrame([(*r, *("y" for _ in clashing)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
