"""Language identification by known words, backing off to shorter n-grams (operator 2)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import cut

#: Letters, number signs and letters among them; ``_words`` takes the number signs out.
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Distinct labels beyond which a column is no language column.
MOST_LANGUAGES = 10_000


def _words(text: str) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass(frozen=True)
class LanguageModel:
    """``words`` and ``grams`` map a string to its log frequency in each language, in the
    order of ``languages``; ``longest`` is the longest n-gram."""

    languages: list[str]
    longest: int
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows_per_language: int = 1500, longest: int = 4) -> LanguageModel:
    """Counts words and n-grams of a sample of about ``rows_per_language`` labelled rows of
    each language, drawn by a hash of ``key`` and text (the documented bound; a language with fewer
    rows gives them all). Rows without language or text teach nothing. Counting is a Spark
    aggregation. Every string of the sample is kept, so the driver gets as many as the sample has.
    More than ``MOST_LANGUAGES`` distinct labels are refused.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rows:
        return LanguageModel([], longest, {}, {})
    languages = sorted(rows)
    at = {name: i for i, name in enumerate(languages)}
    shares = F.map_from_entries(F.array(*[F.struct(F.lit(name), F.lit(min(1.0, rows_per_language / rows[name]))) for name in languages]))
    draw = F.shiftrightunsigned(F.xxhash64("key", "text"), 11) / F.lit(float(1 << 53))
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")
    words = cut(known.filter(draw < shares[F.col("lang")]).select("lang", word).filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n")))
    padded = F.concat(F.lit("<"), "word", F.lit(">"))

    def cut_up(size: int) -> Column:
        last = F.length("word") + 3 - size
        places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
        return F.transform(places, lambda i: padded.substr(i, F.lit(size)))

    every = [cut_up(size) for size in range(1, longest + 1)]
    grams = words.select("lang", "n", F.explode(F.concat(*every)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def table(counts: DataFrame) -> dict[str, np.ndarray]:
        held: dict[str, np.ndarray] = {}
        for one, name, n in zip(*counts.toPandas().to_numpy().T.tolist()) if not counts.isEmpty() else ():
            held.setdefault(one, np.zeros(len(languages)))[at[name]] = n
        return held

    def logs(held: dict[str, np.ndarray]) -> dict[str, tuple[float, ...]]:
        """Log shares among the strings of one kind, half a count added to each."""
        totals = np.maximum(sum(held.values(), np.zeros(len(languages))), 1.0)
        return {w: tuple(np.log((n + 0.5) / totals).tolist()) for w, n in held.items()}

    counted = table(grams.select("gram", "lang", "n"))
    by_size = [{g: n for g, n in counted.items() if len(g) == size} for size in range(1, longest + 1)]
    return LanguageModel(languages, longest, logs(table(words.select("word", "lang", "n"))), {g: v for held in by_size for g, v in logs(held).items()})


class _Scorer:
    """Scores texts with a model; remembers the scores of unseen words up to a bound."""

    CACHE = 200_000

    def __init__(self, model: LanguageModel):
        self.model, self.unseen = model, {}
        self.none = (0.0,) * len(model.languages)

    def _back_off(self, word: str) -> tuple[float, ...]:
        """Cuts the word into known n-grams, at each place the longest one there; the sum of
        their log frequencies over their number, so that an unseen word weighs as one."""
        grams, padded, at, found = self.model.grams, f"<{word}>", 0, []
        while at < len(padded):
            for size in range(min(self.model.longest, len(padded) - at), 0, -1):
                if (score := grams.get(padded[at : at + size])) is not None:
                    found.append(score)
                    at += max(1, size - 1)
                    break
            else:
                at += 1
        return tuple(sum(x) / len(found) for x in zip(*found)) if found else self.none

    def score(self, text: str) -> tuple[str, float]:
        counts: dict[str, int] = {}
        for word in _words(text):
            counts[word] = counts.get(word, 0) + 1
        if not counts or not self.model.languages:
            return UNDETERMINED, 0.0
        if len(self.unseen) > self.CACHE:
            self.unseen.clear()
        seen, unseen, total, n = self.model.words, self.unseen, [0.0] * len(self.none), 0
        for word, times in counts.items():
            own = seen.get(word)
            if own is None:
                own = unseen.get(word)
                if own is None:
                    own = unseen[word] = self._back_off(word)
            n += times
            for i, x in enumerate(own):
                total[i] += times * x
        best = max(total)
        # words of one text are far from independent: the evidence is that of at most 50 words
        scale = min(1.0, 50.0 / n)
        odds = [math.exp((x - best) * scale) for x in total]
        return self.model.languages[total.index(best)], 1.0 / sum(odds)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` (a learned language) and ``score`` (0 to 1).

    Each distinct word counts as often as it occurs, by its log frequency in each language if
    any language knows it, else by the longest known n-grams it can be cut into. The score is
    the posterior of the predicted language. A null text, a text without letters, and any text
    if nothing was learned give ``und`` with score 0. Ties go to the first language by name.
    Only the text is read; whole texts of any length; repeated rows give repeated results.
    """
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTED)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(held.value)
        for texts in batches:
            yield pd.DataFrame([scorer.score(t) if isinstance(t, str) else (UNDETERMINED, 0.0) for t in texts], columns=PREDICTED.names)

    made = docs.select(*[F.col(c) for c in keep], predicted(F.col(text)).alias("predicted__"))
    return made.select(*keep, "predicted__.*")
