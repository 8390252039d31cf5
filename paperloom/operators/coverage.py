"""Summaries that cover a text without repeating it: budgeted submodular choice of sentences (after Lin and Bilmes, 2011).

A choice is worth how far it covers every sentence, up to a share of what the whole text would, and how many of the text's frequent words
it has, each counting once; both have diminishing returns. Sentences are taken by gain for their length, and all gains are
worked out together after each; the best single sentence wins if it is worth more alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import split_sentences

#: Words that a summary has at least, if the text does, and at most; length of a run of words that may not be repeated.
LEAST_WORDS, MOST_WORDS, REPEAT = 100, 200, 3
#: Share of full coverage beyond which covering a sentence further is worth nothing; weight of words; power of a sentence's length.
SATURATION, WORDS_WEIGHT, LENGTH_POWER = 0.25, 0.5, 1.0


class Text:
    """Sentences as bags of words, and what a choice of them is worth."""

    def __init__(self, sentences: list[str]):
        self.words = [re.findall(r"\w+", s.lower()) for s in sentences]
        self.size = [len(s.split()) for s in sentences]
        self.known = {w: i for i, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        flat = [self.known[w] for ws in self.words for w in ws]
        at = np.repeat(np.arange(len(sentences)), [len(ws) for ws in self.words]) * len(self.known) + np.array(flat, int)
        bags = np.bincount(at, minlength=len(sentences) * len(self.known)).astype(float).reshape(len(sentences), len(self.known))
        rare = np.log(1 + len(sentences) / np.maximum((bags > 0).sum(0), 1))
        unit = bags * rare
        unit /= np.maximum(np.sqrt((unit * unit).sum(1, keepdims=True)), 1e-12)
        self.alike = unit @ unit.T
        self.full = SATURATION * self.alike.sum(1)
        self.has = bags > 0
        self.counts = self.has.astype(float)  # as numbers once, not at every product
        self.weight = bags.sum(0) * rare
        self.weight = WORDS_WEIGHT * self.full.sum() * self.weight / max(self.weight.sum(), 1e-12)

    def worth(self, chosen: list[int]) -> float:
        if not chosen:
            return 0.0
        return float(np.minimum(self.alike[:, chosen].sum(1), self.full).sum() + self.weight[self.has[chosen].any(0)].sum())

    def gains(self, covered: np.ndarray, had: np.ndarray) -> np.ndarray:
        """What each sentence adds to a choice that covers each so far and has these words."""
        reach = covered + self.alike
        np.minimum(reach, self.full, out=reach)
        most = np.add.reduce(np.minimum(covered, self.full))
        return np.add.reduce(reach, 1) - most + self.counts @ (self.weight * ~had)

    def first_best(self, covered: np.ndarray, had: np.ndarray, others: list[int]) -> int:
        """Of these the one that adds most for its length to such a choice, the first of equals: each choice's worth is summed up as `worth` does it."""
        before = float(np.minimum(covered, self.full).sum() + self.weight[had].sum())
        reach = np.minimum(covered + self.alike[others], self.full).sum(1).tolist()
        after = [r + float(self.weight[had | self.has[j]].sum()) for r, j in zip(reach, others, strict=True)]
        return min(zip(others, after, strict=True), key=lambda x: (-(x[1] - before) / self.size[x[0]] ** LENGTH_POWER, x[0]))[0]

    def runs(self, i: int) -> list[tuple[str, ...]]:
        w = self.words[i]
        return [tuple(w[k : k + REPEAT]) for k in range(len(w) - REPEAT + 1)]


def choose(sentences: list[str], least: int = LEAST_WORDS, most: int = MOST_WORDS) -> list[int]:
    """The sentences of a summary, in text order: at most `most` words, no run of three words twice. Past `least` words only what
    adds worth is taken."""
    text = Text(sentences)
    size = np.array(text.size)
    length = np.maximum(size, 1) ** LENGTH_POWER
    runs = [text.runs(i) if 0 < n <= most else [] for i, n in enumerate(text.size)]
    sets = [set(own) for own in runs]
    # those that repeat none of their own runs; what each is worth alone
    able = np.array([0 < n <= most and len(sets[i]) == len(runs[i]) for i, n in enumerate(text.size)], bool)
    worth = text.gains(np.zeros(len(size)), np.zeros(len(text.weight), bool)) if len(size) else np.zeros(0)
    alone = int(np.argmax(np.where(able, worth, -1.0))) if able.any() else None
    best = worth[alone] if alone is not None else 0.0
    chosen: list[int] = []
    seen: set[tuple[str, ...]] = set()
    left, total = most, 0.0
    covered, had, rest, gains = np.zeros(len(size)), np.zeros(len(text.weight), bool), text.weight.copy(), worth
    reach = np.empty_like(text.alike)
    # how far all are covered with each sentence more; the longest sentence that may be taken
    after = np.add.reduce(np.minimum(text.alike, text.full, out=reach), 1)
    longest = max((n for i, n in enumerate(text.size) if able[i]), default=0)
    rate = np.where(able, gains / length, -np.inf)
    while len(rate) and (top := float(rate[rate.argmax()])) > -np.inf:
        near = (rate >= top - 1e-9 * abs(top) - 1e-12).nonzero()[0].tolist()
        fit = [j for j in near if seen.isdisjoint(sets[j])]
        if len(fit) < len(near):
            gone = [j for j in near if not seen.isdisjoint(sets[j])]
            able[gone], rate[gone] = False, -np.inf
            if not fit:
                continue
        i = fit[0]
        gain = float(gains[i])
        if len(fit) > 1 and gain > 1e-12:  # what rounding could decide is worked out alike for all, and the first of equals is taken
            i = text.first_best(covered, had, list({sentences[j]: j for j in reversed(fit)}.values()))
            gain = float(gains[i])
        if gain <= 1e-12 and most - left >= least:
            break
        chosen.append(i)
        seen |= sets[i]
        left, total = left - text.size[i], total + gain
        able[i] = False
        if left < longest:
            able &= size <= left
        now = after[i]
        covered += text.alike[i]
        had |= text.has[i]
        rest[text.has[i]] = 0.0
        np.add(covered, text.alike, out=reach)
        after = np.add.reduce(np.minimum(reach, text.full, out=reach), 1)
        gains = after - now + text.counts @ rest
        rate = np.where(able, gains / length, -np.inf)
    if alone is not None and best > total:
        chosen = [alone]
    return sorted(chosen)


def beginning(sentences: list[str], most: int = MOST_WORDS) -> str:
    """Of the first sentence so many words that none of its runs repeats: for texts that have no sentence that fits."""
    words, seen = sentences[0].split()[:most], set()
    for k in range(len(words) - REPEAT + 1):
        run = tuple(w.lower() for w in words[k : k + REPEAT])
        if run in seen:
            return " ".join(words[: k + REPEAT - 1])
        seen.add(run)
    return " ".join(words)


def coverage_summary(least: int = LEAST_WORDS, most: int = MOST_WORDS) -> Callable[[Column], Column]:
    """A summariser as `operators.summarize` takes it: column to column, for texts of some hundred words, as it hands on. Null and
    empty texts give an empty one; of a text whose every sentence is too long or repeats itself the `beginning` is taken."""

    def picked(sentences: list[str]) -> str:
        return " ".join(sentences[i] for i in choose(sentences, least, most)) or (beginning(sentences, most) if sentences else "")

    @F.pandas_udf("string")
    def pick(parts: pd.Series) -> pd.Series:
        return pd.Series(["" if p is None else picked(list(p)) for p in parts])

    return lambda text: pick(F.coalesce(split_sentences(text), F.array().cast("array<string>")))
