"""loomqa: a Spark-native engine for question/answer and document corpora.

Operators are pure ``DataFrame -> DataFrame`` and ``Column -> Column``
functions. The subpackage ``llm`` holds the training-data operators; nothing
outside it imports it.
"""
