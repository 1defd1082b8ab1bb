"""Readers of the formats the pipeline takes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomqa.functions.text import strip

SQUAD = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string>>>>>>>>"
RULE = "-" * 50


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Article files, one JSON text each: path, payload (for :mod:`loomqa.operators.nested`)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))


def squad(spark: SparkSession, path: str) -> DataFrame:
    """qid, context, question, golds of an evaluation file; a question without answers has no golds."""
    d = spark.read.schema(SQUAD).json(path, multiLine=True)
    p = d.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    return p.select("p.context", F.explode("p.qas").alias("q")).select(F.col("q.id").alias("qid"), "context", "q.question", F.coalesce(F.transform("q.answers", lambda a: a.text), F.array().cast("array<string>")).alias("golds"))


def squad_rows(text: Column) -> Column:
    """array<struct<context, qid, question, golds>> of an evaluation data set held as JSON text; null if it is not valid."""
    d = F.from_json(text, SQUAD)
    questions = lambda p: F.transform(p.qas, lambda q: F.struct(p.context.alias("context"), q.id.alias("qid"), q.question.alias("question"), F.coalesce(F.transform(q.answers, lambda a: a.text), F.array().cast("array<string>")).alias("golds")))
    return F.flatten(F.transform(F.flatten(F.transform(d.data, lambda x: x.paragraphs)), questions))


def labelled_line(line: Column) -> Column:
    """struct<text, label> of a ``text,label`` line; a line without exactly one comma is an error."""
    parts = F.split(line, ",", -1)
    good = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not one comma: "), line)))
    return F.struct(good[0].alias("text"), good[1].cast("float").alias("label"))


def _map_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{kind}>")))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """qid, prediction of a JSON object."""
    return _map_file(spark, path, "string").toDF("qid", "prediction")


def na_probs(spark: SparkSession, path: str | None, predicted: DataFrame) -> DataFrame:
    """qid, na_prob of a JSON object; without a file 0 for each predicted id."""
    if path is None:
        return predicted.select("qid", F.lit(0.0).alias("na_prob"))
    return _map_file(spark, path, "double").toDF("qid", "na_prob")


def training_row(context: Column, questions: Column, mark: str = "{sep_token}") -> list[Column]:
    """context and questions of a question-generation row: a prompt, and the questions each followed by the mark."""
    joined = F.array_join(F.transform(questions, lambda q: F.concat(q, F.lit(f" {mark}"))), " ")
    return [F.concat(F.lit("generate questions: "), strip(context)).alias("context"), joined.alias("questions")]


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """text, label of a file of ``text,label`` lines."""
    return spark.read.text(path).select(labelled_line(F.col("value")).alias("p")).select("p.text", "p.label")


def report_pairs(text: Column) -> Column:
    """array<struct<question, answer>> of a report of ``Q:``/``A:`` blocks between rules of 50 dashes."""
    blocks = F.split(text, RULE)
    pairs = F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"(?:^|\n)Q:([^\n]*)\nA:", 1).alias("question"), F.regexp_extract(b, r"(?:^|\n)Q:[^\n]*\nA:([^\n]*)", 1).alias("answer")))
    return F.filter(pairs, lambda p: p.question != "")


def full_report_blocks(text: Column) -> Column:
    """array<struct<taken, score, question, answer, text>> of a full report, whose blocks four newlines part."""
    one = lambda b: F.struct(
        F.regexp_extract(b, r"TAKEN\?(True|False)", 1).alias("taken"), F.regexp_extract(b, r"RQUGE:([0-9.]+)", 1).alias("score"), F.regexp_extract(b, r"Q1:([^\n]*)", 1).alias("question"),
        F.regexp_extract(b, r"Best ans: ([^\n]*)", 1).alias("answer"), F.when(b.contains("\nText:"), F.substring_index(b, "\nText:", -1)).otherwise(F.lit("")).alias("text"),
    )
    return F.filter(F.transform(F.split(text, "\n\n\n\n"), one), lambda x: x.question != "")


def without_text_lines(text: Column) -> Column:
    """A report without its ``TEXT:`` lines and without sections whose last two lines are empty lists.

    A section starts at a line that starts with ``section``; lines before the first are one too."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.startswith(x, F.lit("TEXT:")))
    sections = F.split(F.array_join(lines, "\n"), "\nsection")
    return F.array_join(F.filter(sections, lambda s: ~s.rlike(r"(?:^|\n)[^\S\n]*\[\][^\S\n]*\n[^\S\n]*\[\][^\S\n]*\z")), "\nsection")


def wiki_sections(text: Column) -> Column:
    """Sections of a wiki text, cut at its headings."""
    return F.transform(F.split(text, "=+ [A-Z0-9].{0,100} =+"), strip)


def links(df: DataFrame, url: str, most: int) -> DataFrame:
    """Distinct links, the first ``most`` by url: the limit is the source's feature."""
    return df.select(url).distinct().orderBy(url).limit(most)


def kb_read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables written by :func:`loomqa.sources.writers.kb_write`."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("entities", "relation_spans", "sources")}


def checkpoint_read(spark: SparkSession, path: str) -> DataFrame:
    """A stage written by :func:`loomqa.sources.writers.checkpoint_write`."""
    return spark.read.parquet(path)


#: Fields of a multiple-choice reading record.
RACE = "example_id string, article string, question string, answer string, options array<string>"


def race(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice reading records, one JSON object a line; fields that are missing are null."""
    return spark.read.schema(RACE).json(path)


def race_record(text: Column) -> Column:
    """struct of :data:`RACE` of a record held as JSON text; null if it is not valid."""
    return F.from_json(text, RACE)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated questions of a CSV file with a header: its columns as texts; quoted fields may hold line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
