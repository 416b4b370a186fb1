"""Reports of materials hold all their sentences."""

import duckdb

from docketry import registry
from tests.compare import plain


def test_reports_have_every_sentence_of_long_materials(spark, tmp_path):
    said = [f"word{i} and common{i % 3} here" for i in range(30)]
    spark.createDataFrame([(1, 0, ". ".join(said[:25])), (1, 1, ". ".join(said[25:])), (2, 0, said[29])], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    docs = [(i, f"{'common0 ' * i} word{i + 20} and") for i in range(1, 10)] + [(10, ""), (11, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["sentence_reports"](spark, str(tmp_path)).collect()
    assert len(rows) == 31 and {r.sentence for r in rows} == set(said)
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    wanted = con.sql(registry.oracle_sql()["sentence_reports"])
    got = [[plain(r[c]) for c in wanted.columns] for r in rows]
    assert sorted(map(repr, got)) == sorted(repr([plain(v) for v in r]) for r in wanted.fetchall())
