"""The merge of spans that come late."""

from loomqa.streaming import merge


def test_late_spans_are_kept(spark, tmp_path):
    src, store, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    row = "select {k}L rel_id, {head} head, {head} type, {head} tail, {record} record, 'u' url, {k} span_start, 128 span_end, timestamp'{seen} 00:00:00' seen_at, timestamp'2025-06-01 00:00:00' ingested_at"
    now = spark.sql(row.format(k=1, head="'h'", record="cast(null as string)", seen="2025-06-01"))
    late = spark.sql(row.format(k=2, head="'h'", record="cast(null as string)", seen="2025-01-01"))
    labelled = spark.sql(row.format(k=3, head="cast(null as string)", record="'head=h; type=h; tail=h'", seen="2024-01-01"))
    for batch in (now, late.unionByName(now), labelled):
        batch.write.mode("append").parquet(src)
        merge.start_merge(merge.read_spans(spark, src), store, check).awaitTermination()
    (r,) = merge.merged(spark, store).collect()
    assert (r.head, r.type, r.tail, r.meta) == ("h", "h", "h", {"u": [[1, 128], [2, 128], [3, 128]]})
