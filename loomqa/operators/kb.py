"""Knowledge bases: triplet parsing, merging and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def triplets(linear: Column) -> Column:
    """array<struct<head, type, tail>> of a linearised text ``<triplet> head <subj> tail <obj> type ...``.

    A head holds until the next ``<triplet>``; each ``<subj>`` under it opens
    another tail. Incomplete ones are left out. Split and projected by built-in
    functions: one part for each ``<triplet>``, in it one for each ``<subj>``."""
    t = F.regexp_replace(linear, "<s>|<pad>|</s>", "")
    words = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    parts = F.slice(F.split(t, r"(?<!\S)<triplet>(?!\S)"), 2, 1 << 20)

    def of(part: Column) -> Column:
        pieces = F.split(part, r"(?<!\S)<subj>(?!\S)")
        ends = lambda p: F.split(p, r"(?<!\S)<obj>(?!\S)")
        one = lambda p: F.struct(words(pieces[0]).alias("head"), words(F.element_at(ends(p), -1)).alias("type"), words(F.when(F.size(ends(p)) > 1, ends(p)[0]).otherwise(F.lit(""))).alias("tail"))
        return F.transform(F.slice(pieces, 2, 1 << 20), one)

    return F.filter(F.flatten(F.transform(parts, of)), lambda r: (r.head != "") & (r.type != "") & (r.tail != ""))


def labelled_field(record: Column, name: str) -> Column:
    """The value of ``name`` in a labelled record text, with its own blanks but without its layout's.

    Known layouts: a JSON object, ``name=value; ...``, ``NAME: value | ...`` and
    one ``Name : value`` a line. The order of the fields is free; null if the
    label is missing."""
    in_json = F.get_json_object(record, f"$.{name}")
    label = r"\s*(?:head|type|tail)\s*[:=]"
    by_line = F.nullif(F.regexp_extract(record, rf"(?is)(?:^|[\n|;])\s*{name}\s*[:=]((?:(?! ?\|{label}|[\n;]{label}).)*)", 0), F.lit(""))
    value = F.regexp_replace(by_line, rf"(?is)^[\n|;]?\s*{name}\s*(?:: ?|=)", "")
    return F.when(F.ltrim(record).startswith("{"), in_json).otherwise(value)


def read_records(spans: DataFrame) -> DataFrame:
    """Relation spans whose head, type and tail are read from ``record`` where the columns are null.

    The generator keeps a later filter from reading the records a second time."""
    names = ["head", "type", "tail"]
    read = [F.coalesce(F.col(n), labelled_field(F.col("record"), n)).alias(n) for n in names]
    return spans.select(*[c for c in spans.columns if c not in [*names, "record"]], F.inline(F.array(F.struct(*read))))


SPAN = ["head", "type", "tail", "url", "span_start", "span_end"]


def merged_spans(spans: DataFrame) -> DataFrame:
    """head, type, tail, url, span_start, span_end: each complete span of each relation once.

    One row a span, so a relation with a third of all spans is never gathered in one row;
    :func:`merged_relations` makes the nested form where it is wanted."""
    return spans.select(*SPAN).dropna().distinct()


def merged_relations(spans: DataFrame) -> DataFrame:
    """head, type, tail, meta: the nested form of :func:`merged_spans`, map of url -> distinct spans in order.

    A relation is one row then, so this is for bases whose relations are known to be of bounded size."""
    by_url = merged_spans(spans).groupBy("head", "type", "tail", "url").agg(F.sort_array(F.collect_list(F.array("span_start", "span_end"))).alias("spans"))
    return by_url.groupBy("head", "type", "tail").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("url", "spans")))).alias("meta"))


def new_spans(known: DataFrame, more: DataFrame) -> DataFrame:
    """Distinct complete spans of ``more`` that ``known`` does not hold: what appending adds."""
    return merged_spans(more).join(merged_spans(known), SPAN, "left_anti")


def last_entities(entities: DataFrame) -> DataFrame:
    """title, url, summary: the last written of each title."""
    return entities.groupBy("title").agg(F.max_by(F.struct("url", "summary"), F.struct("seq", "url", "summary")).alias("e")).select("title", "e.url", "e.summary")


def first_sources(sources: DataFrame) -> DataFrame:
    """url, article_title, article_publish_date: the first registered of each url."""
    return sources.groupBy("url").agg(F.min_by(F.struct("article_title", "article_publish_date"), F.struct("registered_at", F.coalesce("article_title", F.lit("")))).alias("s")).select("url", "s.article_title", "s.article_publish_date")


def resolved_relations(relations: DataFrame, alias: DataFrame) -> DataFrame:
    """Relations whose head and tail both resolve, under canonical titles. ``alias`` has candidate and title."""
    h = alias.select(F.col("candidate").alias("head"), F.col("title").alias("__h"))
    t = alias.select(F.col("candidate").alias("tail"), F.col("title").alias("__t"))
    return relations.join(h, "head").join(t, "tail").withColumns({"head": F.col("__h"), "tail": F.col("__t")}).drop("__h", "__t")


def union_kbs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Relations of two bases merged, with the spans of all urls; both as span tables."""
    return merged_relations(united_spans(a, b))


def united_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """The spans of both bases, each once; both as span tables."""
    return merged_spans(a.select(*SPAN).unionByName(b.select(*SPAN)))


def attributed(predictions: DataFrame, windows: DataFrame, sequences: int = 3) -> DataFrame:
    """Prediction i of a document belongs to window i // ``sequences``."""
    return predictions.withColumn("window_n", F.floor(F.col("prediction_n") / sequences).cast("int")).join(windows, ["doc_id", "window_n"])


def neighbourhood(edges: DataFrame, node: str, degree: int = 1) -> DataFrame:
    """node, distance of everything within ``degree`` undirected steps of a node, without itself."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a <> b").distinct()
    seen = both.where(F.col("a") == node).select(F.col("b").alias("node"), F.lit(1).alias("distance"))
    front = seen
    for k in range(2, degree + 1):
        step = both.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).where(F.col("node") != node).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("distance", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def edges_with(edges: DataFrame, condition: Column) -> DataFrame:
    """node: both ends of the edges that meet a condition."""
    return edges.where(condition).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def graph_html(vertices: DataFrame, edges: DataFrame, most: int = 2000) -> str:
    """A page with the graph as JSON for a viewer; refuses more than ``most`` edges."""
    import json

    rows = edges.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges: filter the graph first")
    ends = {x for r in rows for x in (r.src, r.dst)}
    names = [r.node for r in vertices.where(F.col("node").isin(list(ends))).collect()] if ends else []
    data = {"nodes": [{"id": n, "label": n, "shape": "circle"} for n in sorted(names)], "edges": [{"from": r.src, "to": r.dst, "label": r.label, "arrows": "to"} for r in rows]}
    return f"<html><body><div id='graph'></div><script>const data = {json.dumps(data)};</script></body></html>"

