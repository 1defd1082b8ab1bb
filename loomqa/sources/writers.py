"""Reports and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomqa.sources.readers import RULE


def question_lines(question: Column, answer: Column) -> Column:
    """``Q:...`` and ``A:...`` and a rule of 50 dashes."""
    return F.concat(F.lit("Q:"), question, F.lit("\nA:"), answer, F.lit("\n" + RULE))


def question_block(question: Column, new_question: Column, answer: Column, options: Column, text: Column) -> Column:
    """The block of a question: Q1, Q2, the best answer, its options in a list, the text."""
    shown = F.array_join(F.transform(options, lambda o, i: F.concat(F.lit("'A"), i.cast("string"), F.lit(": "), o, F.lit("'"))), ", ")
    return F.concat(F.lit("Q1:"), question, F.lit("\nQ2:"), new_question, F.lit("\nBest ans: "), answer, F.lit("\n["), shown, F.lit("]\nText:"), text, F.lit("\n\n"))


def full_line(number: Column, taken: Column, score: Column, block: Column) -> Column:
    """``(n)TAKEN?True RQUGE:x`` with the block after it; the score rounded half to even to 4 places."""
    return F.concat(F.lit("("), number.cast("string"), F.lit(")TAKEN?"), F.when(taken, "True").otherwise("False"), F.lit(" RQUGE:"), F.bround(score, 4).cast("string"), F.lit("\n"), block)


def distractor_line(section: Column, number: Column, question: Column, answer: Column, distractors: Column) -> Column:
    """``section n - (k) question --- answer`` and the list of distractors."""
    shown = F.array_join(F.transform(distractors, lambda d: F.concat(F.lit("'"), d, F.lit("'"))), ", ")
    return F.concat(F.lit("section "), section.cast("string"), F.lit(" - ("), number.cast("string"), F.lit(") "), question, F.lit(" --- "), answer, F.lit("\n["), shown, F.lit("]"))


def without_distractors(df: DataFrame, distractors: str) -> DataFrame:
    """Rows for which no distractor was found."""
    return df.where(F.col(distractors).isNull() | (F.size(distractors) == 0))


def write_lines(df: DataFrame, line: str, order: list[str], path: str) -> None:
    """Lines as text files, sorted over all files (ranges of the order, no single task)."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(line).alias("value")).write.text(path)


def write_metrics(metrics: DataFrame, path: str | None = None) -> None:
    """One JSON object a metric; without a path one object of all metrics to standard output."""
    if path is None:
        import json

        print(json.dumps({r.metric: r.value for r in metrics.select("metric", "value").limit(1000).collect()}, indent=2))  # a handful of rows
        return
    metrics.select(F.to_json(F.struct("metric", "value")).alias("value")).coalesce(1).write.text(path)  # a handful of rows


def checkpoint_write(df: DataFrame, path: str) -> None:
    """A stage of the pipeline, for :func:`loomqa.sources.readers.checkpoint_read`."""
    df.write.mode("overwrite").parquet(path)


def kb_write(entities: DataFrame, relation_spans: DataFrame, sources: DataFrame, path: str) -> None:
    """A knowledge base as its three tables."""
    for name, df in (("entities", entities), ("relation_spans", relation_spans), ("sources", sources)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
