"""The registered queries against their SQL, on the driver's small tables."""

import pytest
from support import SF, spark_rows

from swirlframe.llm import queries as q


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, duck, name):
    cols, rows = spark_rows(q.QUERIES[name](spark, SF))
    assert rows
    if name in q.SQL:
        assert (cols, rows) == duck(q.SQL[name])


def test_paragraphs(spark, duck):
    from swirlframe.llm.substring_dedup import repeated_paragraphs

    assert spark_rows(repeated_paragraphs(q.table(spark, SF, "documents"))) == duck(q.PARAGRAPHS_SQL)


def test_lines_and_passages_of_40_words(spark, duck):
    from support import SF, spark_rows

    got = q.QUERIES["op10_substring_dedup"](spark, SF).filter("kind = 'paragraph'").select("doc_id", "first", "component_doc", "removed")
    cols, rows = duck(q.PARAGRAPHS_SQL.replace("len(ws) >= 50", "len(ws) >= 40"))
    at = [cols.index(c) for c in ("component_doc", "doc_id", "para", "removed")]
    assert sorted(spark_rows(got)[1]) == sorted(tuple(r[k] for k in at) for r in rows)
