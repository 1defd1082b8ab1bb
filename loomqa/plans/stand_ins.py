"""Deterministic stand-ins for the pipeline's models, for queries over whole tables.

They are no language models, and what they yield says nothing of any model's quality."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

from loomqa.plans.pipeline import Model


def stand_in_scorer() -> Model:
    """(context, question, answer) -> 1 to 5 by the share of the answer's words that are in the context; null without an answer."""

    def score(context: str | None, answer: str | None) -> float | None:
        if answer is None:
            return None
        words = answer.lower().split()
        held = set((context or "").lower().split())
        return 1.0 + 4.0 * sum(w in held for w in words) / max(1, len(words))

    return lambda context, question, answer: pd.Series([score(c, a) for c, a in zip(context, answer)], dtype="float64")


def stand_in_generator() -> Model:
    """prompt -> three questions of its longest words, with a log-likelihood by their length."""

    def ask(prompt: str | None) -> list[dict]:
        words = dict.fromkeys(w.strip(".,;:!?()\"'") for w in (prompt or "").partition(": ")[2].split())
        longest = sorted(words, key=lambda w: (-len(w), w))[:3]
        return [{"text": f"What is said here of {w}?", "ll": -float(len(w))} for w in longest if w]

    return lambda prompts: prompts.map(ask)


def stand_in_chooser() -> Model:
    """(context, question with options) -> the first option that is not blank, lower-cased."""

    def first(prompt: str | None) -> str:
        rest = (prompt or "").partition("(a)")[2]
        for nxt in "bcdefgh":
            option, _, rest = rest.partition(f"({nxt})")
            if option.strip():
                return option.strip().lower()
        return rest.strip().lower()

    return lambda context, prompt: pd.Series([first(p) for p in prompt], dtype=object)


def stand_in_negation() -> Model:
    """question -> its word of negation, or null."""
    return lambda q: q.map(lambda t: next((w for w in (t or "").lower().rstrip("?").split() if w in ("no", "not", "never", "without")), None)).astype(object)


def stand_in_regenerator() -> Model:
    """(answer and context in one prompt) -> a question that names the answer; null without a prompt."""
    return lambda p: p.map(lambda t: None if t is None else f"What does the text say of {t.partition(chr(92) + 'n')[0].strip().rstrip('.')}?").astype(object)


def stand_in_encoder(width: int = 32) -> Model:
    """text -> unit vector of signed word hashes; null for a null text."""

    def vector(text: str | None) -> list[float] | None:
        if text is None:
            return None
        v = np.zeros(width)
        for w in text.lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=4).digest()
            v[h[0] % width] += 1.0 if h[1] & 1 else -1.0
        n = float(np.sqrt(v @ v))
        return (v / n if n else v).tolist()

    return lambda texts: texts.map(vector)


def stand_in_continuation() -> Model:
    """(prompt, context) -> six texts: the prompt and runs of the context's words from six places."""

    def go(prompt: str | None, context: str | None) -> list[str]:
        words = (context or "").split()
        return [f"{prompt} {' '.join(words[i : i + 4])}" for i in range(0, len(words), max(1, len(words) // 6))][:6]

    return lambda prompt, context: pd.Series([go(p, c) for p, c in zip(prompt, context)], dtype=object)
