"""The question pipeline as one lazy chain, with its models injected.

A model is a function from a pandas Series (or several) to a Series; it runs in
Arrow batches. No model is bundled: tests inject deterministic stand-ins that
are named as such."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomqa.functions import similarity as S, text as T
from loomqa.operators import chunking
from loomqa.operators.select import greedy_diverse

Model = Callable[..., pd.Series]
_LOADED: dict[tuple[str, str], object] = {}


def load_once(kind: str, name: str, load: Callable[[], object]) -> object:
    """A model kept for the life of a Python worker."""
    key = (kind, name)
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def model_column(load: Callable[[], Model], returns: str, *inputs: Column, key: tuple[str, str] | None = None) -> Column:
    """A column computed by an injected model, loaded once a worker and fed Arrow batches."""

    @F.pandas_udf(returns)
    def one(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_once(*key, load) if key else load()
        for s in it:
            yield model(s)

    @F.pandas_udf(returns)
    def many(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load_once(*key, load) if key else load()
        for cols in it:
            yield model(*cols)

    return one(*inputs) if len(inputs) == 1 else many(*inputs)


def padded_ids(ids: Column, length: int, pad: int = 0) -> Column:
    """Token ids cut or padded to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention_mask(ids: Column, length: int) -> Column:
    return F.slice(F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), length)), 1, length)


def labels(ids: Column, length: int, pad: int = 0, ignored: int = -100) -> Column:
    """Padded ids where padding is marked as not to be learned."""
    return F.transform(padded_ids(ids, length, pad), lambda x: F.when(x == pad, ignored).otherwise(x))


def generated_questions(sections: DataFrame, generate: Callable[[], Model], budget: int = 487, least_words: int = 40) -> DataFrame:
    """article_id, section_n, chunk_n, text, question, ppl: cleaned questions of each chunk with enough words.

    ``generate`` yields a model from prompts to arrays of (text, log-likelihood).
    The score stays with its text when copies are dropped: exp(mean
    log-likelihood by words), ascending is better."""
    c = chunking.section_chunks(sections, ["article_id", "section_n"], "text", budget).where(chunking.enough_words(F.col("chunk"), least_words))
    out = c.withColumn("out", model_column(generate, "array<struct<text:string,ll:double>>", F.concat(F.lit("generate question: "), "chunk")))
    each = out.select("article_id", "section_n", "chunk_n", F.col("chunk").alias("text"), F.posexplode("out").alias("pos", "o"))
    each = each.select("article_id", "section_n", "chunk_n", "text", T.clean_question(F.col("o.text")).alias("question"), T.perplexity(F.col("o.ll"), F.col("o.text")).alias("ppl"), "pos")
    keys = ["article_id", "section_n", "chunk_n", "question"]
    first = each.where("question <> ''").groupBy(*keys).agg(F.min_by(F.struct("text", "ppl"), "pos").alias("r"))
    return first.select(*keys, "r.text", "r.ppl")


def selected_answers(questions: DataFrame, choose: Callable[[], Model]) -> DataFrame:
    """Adds selected_ans and details, and drops questions whose answer says nothing.

    ``choose`` yields a model from (context, question with options) to a text; of
    the options the one most like it is taken, the first on a tie."""
    options = [F.coalesce(F.get("answers", i), F.lit("")) for i in range(4)] + [F.coalesce(F.get("short_answers", i), F.lit("")) for i in range(4)]
    x = questions.withColumn("opts", F.array(*options)).withColumn("generated_selected_ans", model_column(choose, "string", F.col("text"), T.option_prompt(F.col("question"), options)))
    low = lambda c: F.lower(F.trim(c))
    scored = F.transform("opts", lambda o, i: F.struct(S.string_score(low(F.col("generated_selected_ans")), low(o)).alias("s"), (-i).alias("neg"), o.alias("o")))
    x = x.withColumn("best", F.array_max(scored))
    x = x.withColumns({"selected_ans": F.col("best.o"), "details": F.when(F.col("best.neg") >= -3, "ANSWER: long .").otherwise("ANSWER: short .")}).drop("opts", "best")
    return x.where(~T.bad_answer(F.col("selected_ans")))


def regenerated_questions(questions: DataFrame, negative: Callable[[], Model], regenerate: Callable[[], Model]) -> DataFrame:
    """Adds new_question: a question asked of the answer, or the old one where it is negated or all new words are in it."""
    x = questions.withColumns({"neg": model_column(negative, "string", F.col("question")), "made": model_column(regenerate, "string", F.concat(F.col("selected_ans"), F.lit(" \\n "), F.col("text")))})
    same = F.forall(T.words(F.lower("made")), lambda w: F.contains(F.lower(F.col("question")), w))
    x = x.withColumn("new_question", F.when(F.col("neg").isNotNull() | F.coalesce(same, F.lit(True)), F.col("question")).otherwise(F.col("made")))
    return x.withColumn("details", F.when(F.col("neg").isNotNull(), F.concat("details", F.lit(" NEGATIVE: "), "neg")).otherwise(F.col("details"))).drop("neg", "made")


def variant_scores(questions: DataFrame, score: Callable[[], Model]) -> DataFrame:
    """question_id, kind (long or short), pos, variant, score: a score of each answer variant that is not null.

    ``score`` yields a model of (context, question, answer)."""
    of = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("variant")))
    each = questions.select("question_id", "text", "question", F.inline(F.concat(of("answers", "long"), of("short_answers", "short")))).where("variant is not null")
    return each.select("question_id", "kind", "pos", "variant", model_column(score, "double", F.col("text"), F.col("question"), F.col("variant")).alias("score"))


def causal_distractors(questions: DataFrame, generate: Callable[[], Model], encode: Callable[[], Model], prefix: str = "The answer is not", k: int = 3, top_n: int = 5, diversity: float = 0.7) -> DataFrame:
    """question_id, distractor, rnk: continuations of a prompt that may stand for wrong answers.

    The prompt is ``prefix`` and the answer's first ``k`` words. ``generate`` yields a
    model of (prompt, context) to an array of texts that begin with the prompt; the prompt is taken off,
    the text is cut at the author line, and what holds odd characters, is empty, equals the answer or
    came before is dropped. The rest is ranked by maximal marginal relevance to the answer,
    row by row, as a question has few candidates. ``encode`` yields a text encoder."""
    prompt = F.concat_ws(" ", F.lit(prefix), F.array_join(F.slice(T.words(F.col("selected_ans")), 1, k), " "))
    x = questions.withColumn("prompt", prompt).withColumn("made", model_column(generate, "array<string>", F.col("prompt"), F.col("text")))
    bare = F.transform("made", lambda t: T.without_prefix(T.generated_text(t), F.col("prompt")))
    fit = F.array_distinct(F.filter(bare, lambda t: T.plain_characters(t) & (F.lower(t) != F.lower(F.col("selected_ans")))))
    each = x.select("question_id", "selected_ans", F.posexplode(fit).alias("pos", "distractor"))
    vector = lambda c: model_column(encode, "array<double>", c)
    each = each.withColumns({"v": vector(F.col("distractor")), "a": vector(F.col("selected_ans"))})
    rows = each.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("pos", "distractor", "v", "a"))).alias("c"))  # a handful a question
    near = F.transform("c", lambda c: S.dot(c.v, c.a))

    @F.pandas_udf("array<int>")
    def ranked(vs: pd.Series, near: pd.Series) -> pd.Series:
        import numpy as np

        def one(v, n):
            m, n = np.stack([np.asarray(x, dtype="f8") for x in v]), np.asarray(n, dtype="f8")
            taken = [int(np.argmax(n))]
            while len(taken) < min(top_n, len(n)):
                score = (1 - diversity) * n - diversity * (m @ m[taken].T).max(axis=1)
                score[taken] = -np.inf
                taken.append(int(np.argmax(score)))
            return taken

        return pd.Series([one(v, n) for v, n in zip(vs, near)], dtype=object)

    out = rows.select("question_id", "c", ranked(F.transform("c", lambda c: c.v), near).alias("order"))
    return out.select("question_id", "c", F.posexplode("order").alias("rnk", "at")).select("question_id", F.get("c", F.col("at")).distractor.alias("distractor"), (F.col("rnk") + 1).alias("rnk"))


def diversified(questions: DataFrame, encode: Callable[[], Model], score: Callable[[], Model], n: int = 35, least_score: float | None = None) -> DataFrame:
    """Adds rquge and use_question: the best questions of each article, unlike one another.

    ``encode`` yields a text encoder, ``score`` a model of (context, question, answer)."""
    vector = lambda c: model_column(encode, "array<double>", c)
    x = questions.withColumn("rquge", model_column(score, "double", F.col("text"), F.col("question"), F.col("selected_ans")))
    v = x.where(~T.discarded_question(F.col("new_question"))).withColumns({"qv": vector(F.col("new_question")), "av": vector(F.concat("new_question", F.lit(" "), "selected_ans"))})
    taken = greedy_diverse(v, "article_id", "question_id", "rquge", ["qv", "av"], [0.93, 0.75], n, least_score)
    return x.join(taken.select("article_id", "question_id", F.lit(True).alias("use_question")), ["article_id", "question_id"], "left").withColumn("use_question", F.coalesce("use_question", F.lit(False)))
