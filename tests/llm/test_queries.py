"""The queries on the smallest tables: against SQL where there is one, else their columns."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from compare import plain
from loomqa.llm import queries as Q

COLUMNS = {
    "p1_found": "question_id bigint, rnk int", "p2_found": "question_id bigint, defect string", "p3_found": "question_id_a bigint, question_id_b bigint", "p5_found": "first_rel_id bigint, rel_id bigint",
    "p6_found": "table_name string, article_id bigint, section_n int, chunk_n int", "p7_ids": "doc_id bigint, ids array<int>", "p8_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    df = Q.queries()[name](spark, data)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
        assert df.count() == df.distinct().count() > 0
    sql = Q.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        rel = con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert Counter(tuple(plain(v) for v in r) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    else:
        df.count()


def test_labels_of_real_ids(spark, data):
    from pyspark.sql import functions as F

    from loomqa.plans import pipeline

    ids = {r.doc_id: r.ids for r in Q.p7_ids(spark, data).collect()}
    got = {r.doc_id: r.label_ids for r in Q.x16_document_labels(spark, data, 8).collect()}
    assert spark.range(1).select(pipeline.labels(F.array(F.lit(0), F.lit(5)), 3, pad=-1).alias("l")).first().l == [0, 5, -100]
    assert got == {k: (v + [-100] * 8)[:8] for k, v in ids.items()}
