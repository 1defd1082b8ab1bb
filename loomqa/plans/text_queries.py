"""Cleaning, predicates and string similarity over the question table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomqa.functions import similarity as S, text as T
from loomqa.functions.constants import ANSWER_BLACKLIST, ANSWER_PREFIXES, ANTONYMS, PUNCTUATION, STOP_WORDS
from loomqa.plans.registry import query
from loomqa.plans.sqltext import Q, edits, f1, items, lit, norm, overlap, sentences, strip, sub, tokens, words
from loomqa.runtime import table


def questions(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "questions_df").select("question_id", *cols).dropDuplicates(["question_id"])


def column(name: str, make, cols: tuple[str, ...], sql: str | None, out: str = "value") -> None:
    """A query of one computed column beside question_id."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return questions(spark, d, *cols).select("question_id", make(*[F.col(c) for c in cols]).alias(out))

    query(Q + f"select question_id, {sql} {out} from q" if sql else None, name)(run)


def kept(name: str, condition, cols: tuple[str, ...], sql: str | None) -> None:
    """A query of the question_ids that meet a condition."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return questions(spark, d, *cols).where(condition(*[F.col(c) for c in cols])).select("question_id")

    query(Q + f"select question_id from q where {sql}" if sql else None, name)(run)


_CLEAN = strip(f"replace({sub(sub(sub(sub(strip('question'), chr(92) + '.+', '.'), chr(92) + '?+', '?'), '_+$'), '(' + chr(92) + '?)' + chr(92) + 's*' + chr(92) + 'S*$', chr(92) + '1')}, '? -', '?')")
column("f01_clean_questions", T.clean_question, ("question",), _CLEAN)
_FINAL = r"[Tt]he final answer(?::| is: |s are:| is) ?\([A-Za-z]\)\.?$"
column("f02_clean_answers", T.clean_answer, ("selected_ans",), strip(sub(sub(strip("selected_ans"), r"^(?:\([a-zA-Z]\)|[a-zA-Z]\))"), _FINAL)))
column("f03_normalize_answer", T.normalize_answer, ("selected_ans",), norm("selected_ans"))
column("f04_answer_tokens", T.answer_tokens, ("selected_ans",), tokens("selected_ans"))
_WORD_END = r"[^\p{L}\p{N}\p{M}_]"
_ABBREVIATED = "question"
for _short, _long in (("PSD", "pasture"), ("CPC", "compass")):
    _ABBREVIATED = f"regexp_replace({sub(sub(_ABBREVIATED, f'(?i){_long} [(]{_short}[)]', _short), f'(?i){_long}', _short)}, {lit(f'(^|{_WORD_END}){_short}($|{_WORD_END})')}, {lit(chr(92) + f'1{_long} ({_short})' + chr(92) + '2')})"
column("f05_abbreviations", lambda c: T.replace_abbreviations(c, [("PSD", "pasture"), ("CPC", "compass")], "full"), ("question",), _ABBREVIATED)
column("f06_uppercase_share", lambda c: F.round(T.uppercase_share(c), 6), ("selected_ans",), "case when length(selected_ans) > 0 then round(len(list_filter(string_split(selected_ans, ''), lambda x: x <> '' and x = upper(x))) / length(selected_ans), 6) end")
column("f06_capitalised_long_form", T.capitalised, ("details",), f"array_to_string(list_transform({words('details')}, lambda w: case when list_contains({items(STOP_WORDS)}, w) then w else upper(w[1]) || lower(w[2:]) end), ' ')")
_PRE = "|".join(sorted(ANSWER_PREFIXES, key=lambda p: (-len(p), p)))
_ASKED = r"regexp_split_to_array(lower(replace(question, '?', '')), '\s+')"
_DROP = items([*STOP_WORDS, *PUNCTUATION])
column(
    "f07_content_words", T.content_words, ("selected_ans", "question"),
    f"array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(selected_ans, {lit('(?i)^(?:' + _PRE + ') ')}, '')), {lit(chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}]+|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's]')}), lambda w: not list_contains({_DROP}, w) and not list_contains({_ASKED}, w)), ' ')",
)
_TABLE = "map {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in ANTONYMS.items()) + "}"
column(
    "f08_flip_negation", lambda t: T.flip_negation(t, F.nullif(F.regexp_extract(t, r"\b(?:was|is|are|were|did|does|has|have|no|could|can) not\b|\bnot\b", 0), F.lit(""))), ("text",),
    rf"replace(text, nullif(regexp_extract(text, '\b(?:was|is|are|were|did|does|has|have|no|could|can) not\b|\bnot\b'), ''), {_TABLE}[lower(nullif(regexp_extract(text, '\b(?:was|is|are|were|did|does|has|have|no|could|can) not\b|\bnot\b'), ''))])",
)
column("f09_substitute_span", lambda a: T.substitute_span(a, F.lit("THE"), F.lit("$1 \\ that")), ("selected_ans",), "replace(regexp_replace(selected_ans, '(?i)the', chr(1), 'g'), chr(1), '$1 \\ that')")
_LOW = lambda x: f"lower({strip(x)})"
_A, _B = _LOW("selected_ans"), _LOW("question")
_SHORT = f"replace(case when length({_A}) < length({_B}) then {_A} else {_B} end, '.', '')"
_FULL = f"list_filter({words(f'case when length({_A}) < length({_B}) then {_B} else {_A} end')}, lambda w: not list_contains({items(STOP_WORDS)}, w))"
column("f10_is_abbreviation", T.is_abbreviation, ("selected_ans", "question"), f"case when selected_ans is null or question is null then false when length({_SHORT}) >= 2 and len({_FULL}) >= 2 then {_SHORT}[1] = ({_FULL})[1][1] and {_SHORT}[2] = ({_FULL})[2][1] else false end")
column("f12_remove_prefix", T.without_prefix, ("selected_ans", "details"), strip("substring(selected_ans, length(details) + 1)"))
column("f13_generated_text", T.generated_text, ("text",), "replace(case when contains(text, chr(10) || 'Authors') then string_split(text, chr(10) || 'Authors')[1] else text end, chr(10), ' ')")
column("f14_clean_for_selector", lambda c: T.without_odd_characters(T.without_quotes(c)), ("selected_ans",), sub("translate(selected_ans, '\"''', '')", "[{}^\\\\`⁇<]", " "))
column("f15_lower_for_selector", F.lower, ("selected_ans",), "lower(selected_ans)")
column("f16_prefix_length", T.prefix_length, ("selected_ans", "question"), f"""case when selected_ans is null or question is null then null else 1 + coalesce(list_position(list_transform(list_append(({words('selected_ans')})[2:], chr(0)), lambda w: not (list_contains({_DROP}, lower(w)) or list_contains({_ASKED}, lower(w)))), true) - 1, 0) end""")
column("f17_authors", T.authors, ("text",), "array_to_string(list_transform(string_split(text, ' '), lambda w: case w when 'we' then 'the authors' when 'We' then 'The authors' when 'our' then 'the authors''' when 'Our' then 'The authors''' else w end), ' ')")
column("f19_sentences", lambda c: F.size(T.sentences(c)), ("text",), f"cast(len({sentences('text')}) as integer)")
_OUT = f"list_filter(list_transform(flatten(list_transform(answers, lambda x: string_split(x, '<sep>'))), lambda x: {strip('x')}), lambda x: x <> '')"
column("f20_split_outputs", T.split_outputs, ("answers",), f"list_filter({_OUT}, lambda x, i: list_position({_OUT}, x) = i)")

kept("prj04_chunk_min_words", lambda c: T.word_count(c) > 40, ("text",), f"len({words('text')}) > 40")
kept("prj07_discarded_questions", T.discarded_question, ("question",), r"regexp_matches(question, '^(?:[Ww]ho|WHO .*)') or regexp_matches(question, '^(?:[Ww]hat is|are the final answer|answers to the question|questions)') or not contains(question, '?')")
_BLACK = f"list_contains({items(ANSWER_BLACKLIST)}, {strip('lower(' + sub(chr(114) + 'eplace(selected_ans, ' + lit('_') + ', ' + lit('') + ')', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 'p{M}_' + chr(92) + 's' + chr(92) + 'p{Z}' + chr(92) + 'x1c-' + chr(92) + 'x1f' + chr(92) + 'x{85}]') + ')')})"
kept("prj08_blacklisted_answers", lambda c: T.blacklisted_answer(F.substring_index(c, " ", 1)), ("selected_ans",), _BLACK.replace("selected_ans", "string_split(selected_ans, ' ')[1]"))
kept("prj09_kept_by_answers", lambda c: ~T.bad_answer(c), ("selected_ans",), f"not ({_BLACK} or ends_with({strip('selected_ans')}, ':'))")
kept("prj11_plain_characters", T.plain_characters, ("selected_ans",), r"regexp_matches(selected_ans, '^[\p{L}\p{N}\p{M}_\s\p{Z}\x1c-\x1f\x{85}.,%=+:()\-]+$')")
kept("prj12_no_long_word", lambda c: ~T.has_long_word(c, 12), ("selected_ans",), f"selected_ans is not null and len(list_filter({words('selected_ans')}, lambda w: length(w) > 12)) = 0")
kept("prj13_in_brackets", lambda t: T.in_brackets(F.lit("e"), t), ("text",), r"len(list_filter(list_concat(regexp_extract_all(text, '\(.*?\)'), regexp_extract_all(text, '\[.*?\]')), lambda m: contains(m, 'e'))) > 0")
column("prj15_longer", T.longer, ("selected_ans", "generated_selected_ans"), "case when length(selected_ans) >= length(generated_selected_ans) then selected_ans else generated_selected_ans end")
column("prj15_cloze", T.cloze, ("text", "selected_ans"), "replace(text, selected_ans, '___???___')")
column("prj17_details", lambda a, f: F.when(F.array_contains(F.slice(f, 1, 4), a), "ANSWER: long .").otherwise("ANSWER: short ."), ("selected_ans", "answers"), "case when list_contains(answers[1:4], selected_ans) then 'ANSWER: long .' else 'ANSWER: short .' end")
column("prj19_generation_prompt", lambda t: F.concat(F.lit("generate question: "), t), ("text",), "'generate question: ' || text")
column("prj19_answer_prompt", lambda q, t: F.concat(F.lit("answer to the question, step by step: "), q, F.lit(" </s> context: "), t), ("question", "text"), "'answer to the question, step by step: ' || question || ' </s> context: ' || text")
column("prj19_option_prompt", lambda q, a: T.option_prompt(q, [F.coalesce(F.get(a, i), F.lit("")) for i in range(8)]), ("question", "answers"), "question || ' \n' || " + " || ".join(f"' ({chr(97 + i)}){'' if i == 4 else ' '}' || coalesce(answers[{i + 1}], '')" for i in range(8)) + " || ' \n '")
column("prj19_np_prompt", lambda a, t: F.format_string("answer: %s  context: %s </s>", a, t), ("selected_ans", "text"), "'answer: ' || coalesce(selected_ans, 'null') || '  context: ' || coalesce(text, 'null') || ' </s>'")
column("prj19_answer_context", lambda a, t: F.concat(a, F.lit(" \\n "), t), ("selected_ans", "text"), "selected_ans || ' \\n ' || text")
column("prj20_race_prompt", lambda q, t, a: F.format_string("question: %s options: %s article: %s", q, F.array_join(a, " | "), t), ("question", "text", "answers"), "'question: ' || coalesce(question, 'null') || ' options: ' || coalesce(array_to_string(list_filter(answers, lambda x: x is not null), ' | '), 'null') || ' article: ' || coalesce(text, 'null')")
column("prj21_training_row", lambda q: F.replace(F.concat(q, F.lit(" {sep_token} </s>")), F.lit("{sep_token}"), F.lit("<sep>")), ("question",), "replace(question || ' {sep_token} </s>', '{sep_token}', '<sep>')")
column("x03_keep_original", lambda q, n: F.when(F.forall(T.words(F.lower(n)), lambda w: F.contains(F.lower(q), w)), q).otherwise(n), ("question", "new_question"), f"case when len(list_filter({words('lower(new_question)')}, lambda w: not contains(lower(question), w))) = 0 then question else new_question end")
column("x05_score_prompt", T.score_prompt, ("question", "selected_ans", "generated_selected_ans", "text"), f"{norm('question')} || ' <q> ' || {norm('selected_ans')} || ' <r> ' || {norm('generated_selected_ans')} || ' <c> ' || {norm('text')}")

_G, _N = "generated_selected_ans", "selected_ans"
_TG, _TN = tokens(_G), tokens(_N)
_LISTS = f"with q as (select distinct on (question_id) * from questions_df), t as (select question_id, {_TG} g, {_TN} a from q) "


def pair(name: str, make, sql: str, out: str = "value") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return questions(spark, d, _G, _N).select("question_id", make(F.col(_G), F.col(_N)).alias(out))

    query(sql, name)(run)


pair("m01_exact_match", S.exact_match, Q + f"select question_id, cast({norm(_G)} = {norm(_N)} as integer) as value from q")
pair("m02_token_f1", lambda g, a: F.round(S.token_f1(g, a), 6), _LISTS + f"select question_id, case when g is not null and a is not null then round({f1(overlap('g', 'a'), 'g', 'a')}, 6) end as value from t")
pair("m03_multiset_overlap", lambda g, a: S.let([T.answer_tokens(g), T.answer_tokens(a)], S.multiset_overlap), _LISTS + f"select question_id, case when g is null or a is null then null else cast({overlap('g', 'a')} as integer) end as value from t")
pair("m04_set_f1", lambda g, a: F.round(S.set_f1(g, a), 6), _LISTS + f"select question_id, case when g is not null and a is not null then round({f1('len(list_intersect(g, a))', 'g', 'a')}, 6) end as value from t")
_EDITS = edits(_G, _N)
pair("m05_levenshtein", F.levenshtein, Q + f"select question_id, case when {_G} is not null and {_N} is not null then cast({_EDITS} as integer) end as value from q")
pair("m06_normalized_levenshtein", lambda g, a: F.round(S.normalized_levenshtein(g, a), 6), Q + f"select question_id, case when {_G} is null or {_N} is null then null when greatest(length({_G}), length({_N})) = 0 then 0.0 else round({_EDITS} / greatest(length({_G}), length({_N})), 6) end as value from q")
pair("m07_one_edit", S.one_edit, Q + f"select question_id, case when {_G} is not null and {_N} is not null then {edits(_G, _N, 'damerau_levenshtein')} <= 1 end as value from q")
pair("m08_shares_word", S.shares_word, Q + f"select question_id, len(list_intersect({words(_G)}, {words(_N)})) > 0 as value from q where {_G} is not null and {_N} is not null union all select question_id, null from q where {_G} is null or {_N} is null")
_X, _Y = (sub(f"translate({c}, '\"''', '')", "[{}^\\\\`⁇<]", " ") for c in (_G, _N))
pair(
    "m09_string_score", lambda g, a: F.round(S.string_score(g, a), 6),
    Q + f", t as (select question_id, {_G} g, {_N} a, {_X} x, {_Y} y from q) select question_id, case when g is null or a is null then null when g = a then 3.0 when x = y then 2.0 when contains(x, ' ') or contains(y, ' ') then round(len(list_intersect(string_split(x, ' '), string_split(y, ' '))) / greatest(len(string_split(x, ' ')), len(string_split(y, ' '))), 6) else 0.0 end as value from t",
)


_PLAIN = lambda c: sub(f"translate({c}, '\"''', '')", "[{}^\\\\`⁇<]", " ")


@query(Q + f""", a as (select question_id, unnest(answers) w, generate_subscripts(answers, 1) p, generated_selected_ans g from q), s as (select question_id, w, p, lower(regexp_replace(g, '^ +| +$', '', 'g')) x, lower(regexp_replace(w, '^ +| +$', '', 'g')) y from a where w is not null and g is not null),
t as (select *, {_PLAIN('x')} px, {_PLAIN('y')} py from s),
z as (select question_id, w, p, case when x = y then 3.0 when px = py then 2.0 when contains(px, ' ') or contains(py, ' ') then len(list_intersect(string_split(px, ' '), string_split(py, ' '))) / greatest(len(string_split(px, ' ')), len(string_split(py, ' '))) else 0.0 end v from t)
select question_id, w best, round(v, 6) score from (select *, row_number() over (partition by question_id order by v desc, p) k from z) where k = 1""")
def t09_closest_answer(spark: SparkSession, d: str) -> DataFrame:
    """The answer most like the selector's output, the first on a tie."""
    x = questions(spark, d, "answers", "generated_selected_ans").select("question_id", "generated_selected_ans", F.posexplode("answers").alias("p", "w")).where("w is not null and generated_selected_ans is not null")
    x = x.withColumn("v", S.string_score(F.lower(F.trim("generated_selected_ans")), F.lower(F.trim("w"))))
    return x.groupBy("question_id").agg(F.max_by("w", F.struct("v", (-F.col("p")).alias("p"))).alias("best"), F.round(F.max("v"), 6).alias("score"))


@query(Q + ", t as (select question_id, list_filter(answers, lambda x: x is not null) a from q) select question_id, list_filter(a, lambda x, i: list_position(a, x) = i) as kept from t")
def a05_first_of_copies(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d, "answers").select("question_id", F.array_distinct(F.filter("answers", lambda x: x.isNotNull())).alias("kept"))



@query(Q + ", t as (select question_id, coalesce(answers, []) a, coalesce(short_answers, []) s from q), k as (select *, greatest(5 - len(a), 5 - len(s), 0) more from t) select question_id, list_concat(a, ['','','','',''][1:more]) a, list_concat(s, ['','','','',''][1:more]) s from k")
def t12_padded_answers(spark: SparkSession, d: str) -> DataFrame:
    a, s = T.padded_together(F.col("answers"), F.col("short_answers"))
    return questions(spark, d, "answers", "short_answers").select("question_id", a.alias("a"), s.alias("s"))


@query(Q + ", t as (select question_id, list_filter(answers, lambda x: x is not null and regexp_replace(x, '^ +| +$', '', 'g') <> '' and lower(regexp_replace(x, '^ +| +$', '', 'g')) <> lower(regexp_replace(selected_ans, '^ +| +$', '', 'g'))) a from q where selected_ans is not null) select question_id, list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(regexp_replace(y, '^ +| +$', '', 'g'))), lower(regexp_replace(x, '^ +| +$', '', 'g'))) = i) as kept from t")
def prj10_checked_candidates(spark: SparkSession, d: str) -> DataFrame:
    from loomqa.operators.select import checked_candidates

    return questions(spark, d, "answers", "selected_ans").where("selected_ans is not null").select("question_id", checked_candidates(F.col("answers"), F.col("selected_ans")).alias("kept"))


@query(Q + ", t as (select question_id, list_filter(list_concat(coalesce(answers, []), coalesce(short_answers, [])), lambda x: x is not null) c from q) select question_id, c[1:4] as first_four, len(c) as n from t")
def t11_u07_concatenated_candidates(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    c = F.filter(F.concat(some(F.col("answers")), some(F.col("short_answers"))), lambda x: x.isNotNull())
    return questions(spark, d, "answers", "short_answers").select("question_id", c.alias("c")).select("question_id", F.slice("c", 1, 4).alias("first_four"), F.size("c").cast("long").alias("n"))

