from loomqa.llm.canonical import canonical_copies

SCHEMA = "rel_id long, head string, type string, tail string, record string, root string, salt int, whole string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return {r.rel_id: (r.first_rel_id, r.n_copies) for r in canonical_copies(df).collect()}


def test_renderings_of_one_relation(spark):
    rows = [
        (5, "Ann Lee", "part of", "The  Club", None), (2, "ann-lee", "PartOf", "the club!", None), (9, None, None, None, '{"tail": "The Club", "type": "part of", "head": "Ann \\"Lee\\""}'),
        (11, None, None, None, "HEAD: Ann Lee | TAIL: The Club | TYPE: part of"), (12, None, None, None, "type=part of; head=Ann Lee; tail=The Club"), (13, None, None, None, "Tail : The Club\nHead : Ann​ Lee\nType : part of"),
        (20, "The Club", "part of", "Ann Lee", None), (21, "Ánn Lee", "part of", "The Club", None),
        (30, None, "part of", "The Club", None), (31, " ", "part of", "x", None), (32, None, None, None, "head=; type=a; tail=b"),
    ]
    got = run(spark, rows + [rows[0]])
    assert {k: v for k, v in got.items() if v[0] == 2} == {k: (2, 6) for k in (2, 5, 9, 11, 12, 13)}
    assert got[20] == (20, 1) and got[21] == (21, 1) and not {30, 31, 32} & set(got)


def test_a_class_with_a_third_of_all_rows(spark):
    df = spark.range(6000).selectExpr("id as rel_id", "case when id % 3 = 1 then upper('same head') else concat('h', id) end as head", "'t' as type", "'l' as tail", "cast(null as string) as record")
    got = canonical_copies(df, 2)
    assert got.count() == 2000 and {r.first_rel_id for r in got.select("first_rel_id").distinct().collect()} == {1}


def test_empty(spark):
    assert run(spark, []) == {}


def test_accents_however_they_are_written(spark):
    rows = [(1, "café", "t", "x", None), (2, "café", "t", "x", None), (3, "cafe", "t", "x", None), (4, "की", "t", "x", None), (5, "कि", "t", "x", None), (6, None, None, None, "head=Café; type=T; tail=X")]
    assert run(spark, rows) == {1: (1, 3), 2: (1, 3), 6: (1, 3), 3: (3, 1), 4: (4, 1), 5: (5, 1)}


def test_records_of_any_shape(spark):
    from loomqa.llm.canonical import record_copies

    s = "k long, name string, tags array<string>, meta map<string,struct<b:int,a:string>>, parts array<struct<x:string,y:double>>, root string"
    r = lambda k, name, tags, meta, parts: (k, name, tags, meta, parts, "clash")
    rows = [
        r(7, "Ann Lee", ["a", "b"], {"u": {"a": "Hello, world", "b": 1}, "v": None}, [{"x": "p", "y": 1.0}]), r(3, "ann-lee", ["A ", "B."], {"v": None, "u": {"a": "HELLO WORLD", "b": 1}}, [{"x": "P!", "y": 1.0}]),
        r(4, "Ann Lee", ["b", "a"], {"u": {"a": "Hello, world", "b": 1}, "v": None}, [{"x": "p", "y": 1.0}]), r(5, "Ann Lee", ["ab"], {"u": {"a": "Hello, world", "b": 1}, "v": None}, [{"x": "p", "y": 1.0}]),
        r(6, "Ann Lee", ["a", "b"], {"u": {"a": "Hello, world", "b": 2}, "v": None}, [{"x": "p", "y": 1.0}]), r(8, None, None, None, None), r(9, None, None, None, None), r(10, "", [], {}, []), r(None, "x", None, None, None), r(7, "Ann Lee", ["a", "b"], {"u": {"a": "Hello, world", "b": 1}, "v": None}, [{"x": "p", "y": 1.0}]),
    ]
    df = spark.createDataFrame(rows, s)
    got = {x.k: (x.first_key, x.n_copies) for x in record_copies(df, "k", ["name", "tags", "meta", "parts"]).collect()}
    assert got == {7: (3, 2), 3: (3, 2), 4: (4, 1), 5: (5, 1), 6: (6, 1), 8: (8, 2), 9: (8, 2), 10: (10, 1)}
    assert record_copies(df.limit(0), "k", ["name"]).count() == 0
