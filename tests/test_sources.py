import json

import pytest
from pyspark.sql import functions as F

from loomqa.operators import qa_eval
from loomqa.sources import readers, writers

REPORT = "Q:Why?\nA:So.\n" + "-" * 50 + "\nQ:How?\nA:Thus.\n" + "-" * 50
FULL = "(0)TAKEN?True RQUGE:2.5\nQ1:Why?\nQ2:Why so?\nBest ans: So.\n['A0: So.']\nText:Some text.\n\n\n\n(1)TAKEN?False RQUGE:1.0\nQ1:How?\nQ2:x\nBest ans: Thus.\n[]\nText:More."


def test_squad_files(spark, tmp_path):
    data = {"data": [{"title": "t", "paragraphs": [{"context": " c ", "qas": [{"id": "1", "question": "q?", "answers": [{"text": "a"}]}, {"id": "2", "question": "r?", "answers": []}]}]}]}
    (tmp_path / "d.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "p.json").write_text(json.dumps({"1": "the a", "2": ""}))
    (tmp_path / "n.json").write_text(json.dumps({"1": 0.2, "2": 0.9}))
    q, p = readers.squad(spark, str(tmp_path / "d.json")), readers.predictions(spark, str(tmp_path / "p.json"))
    assert {r.qid: r.golds for r in q.collect()} == {"1": ["a"], "2": []}
    s = qa_eval.with_na_probs(qa_eval.raw_scores(q, p), readers.na_probs(spark, str(tmp_path / "n.json"), p))
    assert {r.qid: (r.exact, r.na_prob) for r in s.collect()} == {"1": (1.0, 0.2), "2": (1.0, 0.9)}
    assert {r.na_prob for r in readers.na_probs(spark, None, p).collect()} == {0.0}
    writers.write_metrics(qa_eval.metrics(s), str(tmp_path / "m"))
    assert {r.metric for r in spark.read.json(str(tmp_path / "m")).collect()} >= {"exact", "HasAns_f1"}
    row = q.where("qid = '1'").select(*readers.training_row(F.col("context"), F.array("question"))).first()
    assert tuple(row) == ("generate questions: c", "q? {sep_token}")


def test_reports(spark):
    df = spark.createDataFrame([(REPORT, FULL)], "r string, f string")
    r = df.select(readers.report_pairs(F.col("r")).alias("p"), readers.full_report_blocks(F.col("f")).alias("b")).first()
    assert [tuple(x) for x in r.p] == [("Why?", "So."), ("How?", "Thus.")]
    assert [(x.taken, x.score, x.question, x.answer) for x in r.b] == [("True", "2.5", "Why?", "So."), ("False", "1.0", "How?", "Thus.")]
    assert r.b[0].text == "Some text."
    line = df.select(writers.question_lines(F.lit("Why?"), F.lit("So.")).alias("l")).first().l
    assert REPORT.startswith(line)
    assert df.select(readers.wiki_sections(F.lit("a == B c == d")).alias("s")).first().s == ["a", "d"]
    assert df.select(readers.without_text_lines(F.lit("a\nTEXT: b\nc")).alias("s")).first().s == "a\nc"


def test_labelled_lines(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a b,0.5\nc,1\n")
    assert [tuple(r) for r in readers.labelled_lines(spark, str(tmp_path / "l.txt")).collect()] == [("a b", 0.5), ("c", 1.0)]
    (tmp_path / "bad.txt").write_text("a,b,1\n")
    with pytest.raises(Exception, match="one comma"):
        readers.labelled_lines(spark, str(tmp_path / "bad.txt")).collect()


def test_lines_and_checkpoints(spark, tmp_path):
    df = spark.range(200).selectExpr("199 - id as k", "concat('line ', 199 - id) as line")
    writers.write_lines(df, "line", ["k"], str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines() == [f"line {i}" for i in range(200)]
    writers.checkpoint_write(df, str(tmp_path / "stage"))
    assert readers.checkpoint_read(spark, str(tmp_path / "stage")).count() == 200


def test_streaming_merge(spark, tmp_path):
    from loomqa.streaming import merge

    src = tmp_path / "in"
    one = spark.sql("select 1L rel_id, 'h' head, 't' type, 'l' tail, cast(null as string) record, 'u' url, 0 span_start, 128 span_end, timestamp'2025-01-01 00:00:00' seen_at, timestamp'2025-01-01 00:00:00' ingested_at")
    one.unionByName(one).write.mode("append").parquet(str(src))
    store, check = str(tmp_path / "store"), str(tmp_path / "check")
    merge.start_merge(merge.read_spans(spark, str(src)), store, check).awaitTermination()
    one.withColumn("span_start", F.lit(119)).unionByName(one).write.mode("append").parquet(str(src))
    merge.start_merge(merge.read_spans(spark, str(src)), store, check).awaitTermination()
    rows = merge.merged(spark, store).collect()
    assert len(rows) == 1 and rows[0].meta == {"u": [[0, 128], [119, 128]]}
