from loomqa.llm import neardup as N


def test_sets_of_very_many_rare_words(spark):
    long = [f"w{i}" for i in range(70_000)]
    df = spark.createDataFrame([(1, " ".join(long)), (2, "a b")], "key long, t string")
    got = {r.key: N.decode_set(bytes(r.enc)) for r in N.encoded_sets(df, "key", ["t"], 1, {"b": (7, 1)}).collect()}
    assert got == {1: tuple(sorted(map(N._rare, long))), 2: (N._rare("a"), 7)}
