"""Deeply nested records as flat tables, by higher-order projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_LEAF = "array<struct<kind:string,item_pos:int,item_key:string,child_pos:int,leaf_pos:int,value:string>>"
_QUESTION = "struct<pos:int,question:string,answer:string,score:string,distractors:array<string>>"
_SECTION = f"struct<pos:int,key:string,summary:string,original:string,questions:array<{_QUESTION}>>"


def _leaf(kind: str, item_pos: Column, item_key: Column, child_pos: Column, leaf_pos: Column, value: Column) -> Column:
    names = ("kind", "item_pos", "item_key", "child_pos", "leaf_pos", "value")
    return F.struct(*[c.cast(t).alias(n) for n, c, t in zip(names, (F.lit(kind), item_pos, item_key, child_pos, leaf_pos, value), ("string", "int", "string", "int", "int", "string"))])


def _some(array: Column, kind: str) -> Column:
    """An array, or an empty one for null."""
    return F.coalesce(array, F.array().cast(kind))


def _inner(text: Column) -> Column:
    """The content of a JSON text: a JSON string's own text, or the text itself; null if it is not valid."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]


def _object(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def _side(raw: Column) -> Column:
    """Text of a section's side: its ``text`` if it is an object, else the bare text."""
    fields = F.when(F.ltrim(raw).startswith("{"), _object(raw))
    return F.when(fields.isNotNull(), fields["text"]).otherwise(raw)


def _list(raw: Column) -> Column:
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))


def _questions(raw: Column) -> Column:
    """Questions of a section in stored order; a null entry stays as a null element."""

    def one(q: Column, i: Column) -> Column:
        f = F.from_json(q, "struct<question:string,answer:string,score:string,distractors:string>")
        return F.when(q.isNotNull(), F.struct(i.cast("int").alias("pos"), f.question.alias("question"), f.answer.alias("answer"), f.score.alias("score"), _some(_list(f.distractors), "array<string>").alias("distractors")))

    return _some(F.transform(_list(raw), one), f"array<{_QUESTION}>")


def parsed_articles(df: DataFrame, record: str = "article_id", payload: str = "payload") -> DataFrame:
    """record_id, sections: array<struct<pos, key, summary, original, questions>>.

    A payload may be a JSON string that holds the JSON text; ``sections`` may lie
    in ``result`` or at the top, as an object or as a list whose items name
    themselves in ``key``. Null elements stay as null elements, so positions are
    those stored. A null or an invalid payload has null sections."""
    once = F.when(F.length(F.trim(F.col(payload))) > 0, _inner(F.col(payload)))
    x = df.select(F.col(record).alias("record_id"), once.alias("text"))
    x = x.select("record_id", F.when(F.ltrim("text").startswith('"'), _inner(F.col("text"))).otherwise(F.col("text")).alias("text"))
    x = x.select("record_id", _object(F.col("text")).alias("top"))
    x = x.select("record_id", F.coalesce(F.when(F.ltrim(F.col("top")["result"]).startswith("{"), _object(F.col("top")["result"]))["sections"], F.col("top")["sections"]).alias("raw"))
    body = "struct<key:string,summary:string,original:string,questions:string>"
    named = F.transform(F.map_entries(F.when(F.ltrim("raw").startswith("{"), _object(F.col("raw")))), lambda e, i: F.struct(i.cast("int").alias("pos"), e.key.alias("key"), F.from_json(e.value, body).alias("b")))
    listed = F.transform(_list(F.col("raw")), lambda e, i: F.struct(i.cast("int").alias("pos"), F.from_json(e, body).key.alias("key"), F.from_json(e, body).alias("b")))
    x = x.select("record_id", F.coalesce(named, listed).alias("s"))
    section = lambda s: F.struct(s.pos.alias("pos"), s.key.alias("key"), _side(s.b.summary).alias("summary"), _side(s.b.original).alias("original"), _questions(s.b.questions).alias("questions"))
    return x.select("record_id", F.transform("s", section).cast(f"array<{_SECTION}>").alias("sections"))


def article_leaves(df: DataFrame, record: str = "article_id", payload: str = "payload") -> DataFrame:
    """kind, record_id, item_pos, item_key, child_pos, leaf_pos, value: one row for each leaf of each article.

    Nested transforms attach the ancestors' positions and keys, flatten combines
    the arrays and one inline emits the rows: no shuffle, and each payload is
    parsed once. Payloads delivered twice give their rows twice."""

    def leaves(s: Column) -> Column:
        zero = F.lit(0)
        sides = F.filter(F.array(_leaf("summary", s.pos, s.key, zero, zero, s.summary), _leaf("original", s.pos, s.key, zero, zero, s.original)), lambda x: x.value.isNotNull())
        asked = F.transform(F.filter(s.questions, lambda q: q.isNotNull()), lambda q: _leaf("question", s.pos, s.key, q.pos, zero, F.coalesce(q.question, F.lit(""))))
        wrong = F.flatten(F.transform(F.filter(s.questions, lambda q: q.isNotNull()), lambda q: F.filter(F.transform(q.distractors, lambda d, k: _leaf("distractor", s.pos, s.key, q.pos, k, d)), lambda x: x.value.isNotNull())))
        return F.concat(sides.cast(_LEAF), asked.cast(_LEAF), wrong.cast(_LEAF))

    x = parsed_articles(df, record, payload)
    return x.select("record_id", F.inline(F.flatten(F.transform("sections", leaves)))).select("kind", "record_id", "item_pos", "item_key", "child_pos", "leaf_pos", "value")


def article_sections(df: DataFrame, record: str = "article_id", payload: str = "payload") -> DataFrame:
    """Table of sections: record_id, pos, key, summary, original."""
    return parsed_articles(df, record, payload).select("record_id", F.inline(F.transform("sections", lambda s: F.struct(s.pos.alias("pos"), s.key.alias("key"), s.summary.alias("summary"), s.original.alias("original")))))


def article_questions(df: DataFrame, record: str = "article_id", payload: str = "payload") -> DataFrame:
    """Table of questions: record_id, section_pos, section_key, pos, question, answer, score, distractors."""
    rows = F.flatten(F.transform("sections", lambda s: F.transform(F.filter(s.questions, lambda q: q.isNotNull()), lambda q: F.struct(s.pos.alias("section_pos"), s.key.alias("section_key"), q.pos.alias("pos"), q.question.alias("question"), q.answer.alias("answer"), q.score.cast("double").alias("score"), q.distractors.alias("distractors")))))
    return parsed_articles(df, record, payload).select("record_id", F.inline(rows))


def kb_spans(df: DataFrame, record: str = "kb_id") -> DataFrame:
    """kind ('span'), record_id, item_pos, item_key, child_pos, leaf_pos, head, type, tail, span: one row
    for each non-null span of each relation, with the relation's position and the url it hangs on."""

    def spans(r: Column, i: Column) -> Column:
        one = lambda e: F.filter(F.transform(_some(e.value.spans, "array<array<int>>"), lambda s, k: F.struct(F.lit("span").alias("kind"), i.cast("int").alias("item_pos"), e.key.alias("item_key"), k.cast("int").alias("child_pos"), F.lit(0).alias("leaf_pos"), r.head.alias("head"), r.type.alias("type"), r.tail.alias("tail"), s.alias("span"))), lambda x: x.span.isNotNull())
        meta = F.map_entries(r.meta)
        return F.flatten(F.transform(F.coalesce(meta, F.slice(F.map_entries(F.from_json(F.lit("{}"), "map<string,struct<spans:array<array<int>>>>")), 1, 0)), one))

    x = df.select(F.col(record).alias("record_id"), F.inline(F.flatten(F.transform("relations", spans))))
    return x.select("kind", "record_id", "item_pos", "item_key", "child_pos", "leaf_pos", "head", "type", "tail", "span")


def kb_relations(df: DataFrame, record: str = "kb_id") -> DataFrame:
    """Table of relations: record_id, pos, head, type, tail, n_urls."""
    rows = F.filter(F.transform("relations", lambda r, i: F.when(r.isNotNull(), F.struct(i.cast("int").alias("pos"), r.head.alias("head"), r.type.alias("type"), r.tail.alias("tail"), F.coalesce(F.size(F.map_keys(r.meta)), F.lit(0)).alias("n_urls")))), lambda x: x.isNotNull())
    return df.select(F.col(record).alias("record_id"), F.inline(rows))


def kb_entities(df: DataFrame, record: str = "kb_id") -> DataFrame:
    """Table of entities: record_id, title, url, summary."""
    return df.select(F.col(record).alias("record_id"), F.explode(F.map_entries("entities")).alias("e")).select("record_id", F.col("e.key").alias("title"), F.col("e.value.url").alias("url"), F.col("e.value.summary").alias("summary"))


def nested_leaves(articles: DataFrame, kb: DataFrame) -> DataFrame:
    """The leaf rows of both kinds of record, distinct: kind, record_id, item_pos, item_key, child_pos, leaf_pos."""
    names = ["kind", "record_id", "item_pos", "item_key", "child_pos", "leaf_pos"]
    return article_leaves(articles).select(*names).unionByName(kb_spans(kb).select(*names)).distinct()
