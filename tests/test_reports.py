from pyspark.sql import functions as F

from loomqa.sources import readers


def test_empty_sections_are_removed(spark):
    texts = ["section 0 - q\nTEXT: x\n['a']\nsection 1 - r\n[]\nTEXT: y\n [] \nsection 2 - s\n['b']\n[]\nsection 3\n[]", "head\n[]\n[]\nsection 1\nx", "[]", None, "", "section 1\n[]\n[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", readers.without_text_lines(F.col("t")).alias("v")).collect()}
    assert got == {0: "section 0 - q\n['a']\nsection 2 - s\n['b']\n[]\nsection 3\n[]", 1: " 1\nx", 2: "[]", 3: None, 4: "", 5: ""}
