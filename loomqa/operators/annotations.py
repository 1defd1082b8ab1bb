"""Operators over injected annotations: entities, noun phrases, coreference clusters and sense neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomqa.runtime import shuffle_width

#: Pronouns of several things.
PLURAL_PRONOUNS = ("they", "them", "their", "theirs", "themselves", "these", "those", "we", "us", "our", "ours", "ourselves")


def sentence_of(sentences: Column, start: Column, end: Column) -> Column:
    """Index of the first sentence, of array<struct<start, end>>, that holds a span; null for none."""
    holds = F.transform(sentences, lambda s: (start >= s.start) & (end <= s.end))
    at = F.array_position(holds, True)
    return F.when(at > 0, (at - 1).cast("int"))


def spans_by_sentence(df: DataFrame, doc: str, spans: str, sentences: str) -> DataFrame:
    """doc, sentence_n, spans in order: a document's spans grouped by the sentence that holds them."""
    each = df.select(doc, F.col(sentences).alias("__s"), F.posexplode(spans).alias("pos", "span"))
    each = each.withColumn("sentence_n", sentence_of(F.col("__s"), F.col("span.start"), F.col("span.end"))).where("sentence_n is not null")
    return each.groupBy(doc, "sentence_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "span"))), lambda x: x.span).alias("spans"))


def sentence_distance(ranks: Column, held: Column) -> Column:
    """Distance of a sentence to the text's phrases: root of the squared normalised ranks of those it does not hold."""
    total = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x)
    missing = F.zip_with(ranks, held, lambda r, h: F.when(h, 0.0).otherwise(r / total))
    return F.sqrt(F.aggregate(missing, F.lit(0.0), lambda a, x: a + x * x))


def cluster_head(mentions: Column, pronoun: Column) -> Column:
    """The mention, of array<struct<text, plural>>, that stands for a pronoun: the shortest of its number, else the shortest of all."""
    plural = F.lower(pronoun).isin(*PLURAL_PRONOUNS)
    fit = F.filter(mentions, lambda m: m.plural == plural)
    pool = F.when(F.size(fit) > 0, fit).otherwise(mentions)
    return F.array_min(F.transform(pool, lambda m, i: F.struct(F.char_length(m.text).alias("n"), i.alias("i"), m.text.alias("text")))).text


def resolved_sentence(tokens: Column, at: Column, head: Column) -> Column:
    """The sentence with the token at a place replaced by the head, with 's for a possessive pronoun; its first letter a capital."""
    owner = F.lower(F.get(tokens, at)).isin("his", "her", "hers", "its", "their", "theirs", "my", "our", "your")
    put = F.when(owner & ~head.endswith("s"), F.concat(head, F.lit("'s"))).when(owner, F.concat(head, F.lit("'"))).otherwise(head)
    text = F.array_join(F.transform(tokens, lambda t, i: F.when(i == at, put).otherwise(t)), " ")
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def similar_entities(pairs: DataFrame, n: int, low: float, high: float) -> DataFrame:
    """answer_id, text, score, rnk: the best ``n`` entities of the answer's label, not the answer itself, within a similarity range.

    ``pairs`` has answer_id, answer, answer_label, text, label, score, pos: the
    scored candidates of each answer's own document."""
    fit = pairs.where((F.col("label") == F.col("answer_label")) & (F.lower("text") != F.lower("answer")) & (F.col("score") > low) & (F.col("score") < high))
    one = fit.groupBy("answer_id", F.lower("text").alias("__t")).agg(F.min_by(F.struct("text", "score", "pos"), "pos").alias("r")).select("answer_id", "r.*")
    w = Window.partitionBy("answer_id").orderBy(F.desc("score"), "pos")
    return one.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n).select("answer_id", "text", "score", "rnk")


def sense_neighbours(terms: DataFrame, neighbours: DataFrame, n: int) -> DataFrame:
    """term, neighbour, score: the nearest terms of the same sense.

    ``terms`` has term and sense; ``neighbours`` term, sense, neighbour, score and
    is_best_sense, of which only best senses count."""
    x = terms.join(neighbours.where("is_best_sense"), ["term", "sense"])
    w = Window.partitionBy("term", "sense").orderBy(F.desc("score"), "neighbour")
    return x.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n).select("term", "sense", "neighbour", "score", "rnk")


def number_variants(answer: Column, part: Column, variants: Column) -> Column:
    """The answer with one of its words replaced by each variant."""
    return F.transform(variants, lambda v: F.array_join(F.transform(F.split(answer, r"\s+"), lambda w: F.when(w == part, v).otherwise(w)), " "))


def relevant_sentences(df: DataFrame, doc: str, low: int, high: int, n: int) -> DataFrame:
    """The ``n`` highest ranked sentences of each document with ``low`` to ``high`` tokens.

    ``df`` has doc, sentence_n, tokens and rank."""
    w = Window.partitionBy(doc).orderBy(F.desc("rank"), "sentence_n")
    return df.where(F.col("tokens").between(low, high)).withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= n)


def chosen_phrases(df: DataFrame, doc: str, low: int, high: int, n: int, sparse: bool = True, labels: tuple[str, ...] = ("NP",)) -> DataFrame:
    """doc, sentence_n, phrase, rnk: phrases to ask about, taken sentence by sentence.

    ``df`` has doc, sentence_n, tokens, rank, text and ents (array<struct<phrase, label,
    rank>>). Sentences with ``low`` to ``high`` tokens go by rank descending; of each, entities
    with rank 0, another label, a phrase taken before or one in brackets are skipped; one a
    sentence is taken if ``sparse``, and a document ends at ``n``. What was taken decides on what
    follows, so a document streams through one task in order, which holds at most ``n`` phrases."""
    slim = df.where(F.col("tokens").between(low, high) & F.col(doc).isNotNull() & F.col("rank").isNotNull())
    from loomqa.functions.text import in_brackets

    free = F.filter("ents", lambda e: (e["rank"] != 0) & e.label.isin(*labels) & e.phrase.isNotNull() & ~F.coalesce(in_brackets(e.phrase, F.col("text")), F.lit(False)))
    slim = slim.select(F.col(doc).alias("doc"), "sentence_n", "rank", F.transform(free, lambda e: e.phrase).alias("phrases"))
    kinds = [slim.schema[c].dataType.simpleString() for c in ("doc", "sentence_n")]
    ordered = slim.repartition(shuffle_width(df.sparkSession), "doc").sortWithinPartitions("doc", F.desc("rank"), "sentence_n")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, taken = None, True, []
        for batch in batches:
            at, phrases, places = [], [], []
            for i, (d, ps) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                if first or d != current:
                    current, first, taken = d, False, []
                for p in ps or ():
                    if len(taken) >= n:
                        break
                    if p not in taken:
                        taken.append(p)
                        at.append(i)
                        phrases.append(p)
                        places.append(len(taken))
                        if sparse:
                            break
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(phrases, pa.string()), pa.array(places, pa.int32())], names=["doc", "sentence_n", "phrase", "rnk"])

    out = ordered.mapInArrow(walk, f"doc {kinds[0]}, sentence_n {kinds[1]}, phrase string, rnk int")
    return out.withColumnRenamed("doc", doc)
