"""references_removed against its SQL on texts that the sample tables lack."""

import duckdb
import pytest
from litspark.operators import references
from litspark.plans import catalogue

from .oracle import compare

BLANK = {"space": " ", "tab": "\t", "line": "\n", "feed": "\f", "return": "\r", "vertical": "\x0b", "unit": "\x1f", "next": "\x85", "no-break": "\xa0", "wide": "　", "separator": " "}
TEXTS = {"empty": ["", "\n\n", " \t\r\f "], "null": [None]} | {k: ["body" + c, c + "body", c, c + "a" + c + "b\n" + c] for k, c in BLANK.items()}


@pytest.mark.parametrize("kind", TEXTS)
def test_odd_texts(spark, tmp_path, kind):
    rows = [(5 * i + k, t) for i, t in enumerate(TEXTS[kind]) for k in range(5)]  # of five, the first keeps its list
    rows.append((None, "no article"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = compare(catalogue.QUERIES["references_removed"](spark, str(tmp_path)), con, catalogue.ORACLE_SQL["references_removed"])
    assert len(got) == 3 * (len(rows) - 1)


def test_operator_drops_emptied_pages_unless_told(spark):
    refs = "References\n" + "\n".join(f"[{i}] A ({1990 + i})" for i in range(6))
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "\xa0\n" + refs)], "article_id string, page int, text string")
    rows = lambda **more: sorted((r.page, r.text) for r in references.remove_references(pages, **more).collect())
    assert rows() == [(1, "x")]
    assert rows(keep_emptied=True) == [(1, "x"), (2, "")]
    assert rows(blank="[ \n]") == [(1, "x"), (2, "\xa0")]
