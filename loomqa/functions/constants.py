"""Fixed values that results depend on, in their natural order."""

from __future__ import annotations

#: White space as Python's str.strip() sees it, as a regex class body for Java and RE2.
SPACE = r"\s\p{Z}\x1c-\x1f\x{85}"

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Answers that name nobody.
ANSWER_BLACKLIST = ("we", "they", "the authors", "authors", "author", "the author", "you", "you are", "we are", "the speaker", "speaker", "the lecturer", "lecturer", "he", "he is", "she", "she is", "i", "these", "those", "they are", "we do", "it")

#: Openings of an answer that say nothing.
ANSWER_PREFIXES = (
    "according to", "as far as", "as for", "as regards", "as to", "based on", "concerning", "in answer to", "in connection with", "in consideration of", "in light of",
    "in occurrence of", "in order to", "in reference to", "in regard to", "in regards to", "in relation to", "in response to", "in terms of", "in the case of",
    "in the matter of", "in view of", "on account of", "on the grounds of", "pertaining to", "relating to", "with reference to", "with regard to", "with regards to", "with respect to",
)

#: Negated form -> positive form.
ANTONYMS = {
    "am not": "am", "is not": "is", "are not": "are", "was not": "was", "were not": "were", "haven't been": "have been", "hasn't been": "has been", "hadn't been": "had been",
    "will not be": "will be", "would not be": "would be", "should not be": "should be", "could not be": "could be", "must not be": "must be", "might not be": "might be",
    "don't": "do", "does not": "does", "did not": "did", "has not": "has", "have not": "have", "had not": "had", "can not": "can", "could not": "could", "shall not": "shall",
    "should not": "should", "will not": "will", "would not": "would", "may not": "may", "might not": "might", "must not": "must", "ought not": "ought", "need not": "need",
    "dare not": "dare", "used not": "used", "needn't": "need", "daren't": "dare", "mustn't": "must", "shouldn't": "should", "wouldn't": "would", "couldn't": "could",
    "wasn't": "was", "weren't": "were", "isn't": "is", "aren't": "are", "didn't": "did", "doesn't": "does", "hasn't": "has", "haven't": "have", "hadn't": "had", "can't": "can",
    "we're not": "we're", "they're not": "they're", "you're not": "you're", "i'm not": "i'm", "he's not": "he's", "she's not": "she's", "it's not": "it's",
    "we are not": "we're", "they are not": "they're", "you are not": "you're", "i am not": "i'm", "he is not": "he's", "she is not": "she's", "it is not": "it's",
    "not": "", "n't": "n", "dont": "do",
}

#: English stop words.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself "
    "they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the "
    "and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't".split()
)

#: First person of a paper -> its authors.
AUTHORS = {"we": "the authors", "We": "The authors", "our": "the authors'", "Our": "The authors'"}
