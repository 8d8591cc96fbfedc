"""Small awkward tables for the operators."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use inside.
EXTRA = "score double, n long, ids string, rep string, _d string, _h long, _base int, y string"
FILL = (0.5, 7, "ids", "rep", "d", 3, 1, "y")


def documents(spark, texts, ids=None):
    """documents with clashing extra columns; ids default to the positions."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, None, None, *FILL) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


AWKWARD = [None, "", " \n\t", "one", "one two", "a b c d e f g", "a b c d e f g", "é 漢字 🙂 ▁ \x00 \u00a0", "x" * 5_000,
           "to be or not " * 3_000, "a  b   c\n\n\n d", "line one\nline one\nline one", "<|endoftext|> it's 12.5"]
