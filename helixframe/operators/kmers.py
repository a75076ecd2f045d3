"""A scorer to which the order of letters matters: the mean weight of a sequence's k-letter windows.

Weights are one number for each of the 4 ** k windows, by their code (A, C, G, T as digits 0 to 3, the first letter
first). A window with another letter weighs 0. Whole sequences are scored in Arrow batches; nothing is
shuffled, and a substitution rescores the windows that hold it and no other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.sequence import Comparison, compare
from helixframe.schema import BASES

Weights = Mapping[str, Sequence[float]]


def _k(weights: Weights) -> int:
    sizes = {len(w) for w in weights.values()}
    k = next((k for k in range(1, 7) if sizes == {4**k}), None)
    if k is None:
        raise ValueError("every task needs 4 ** k weights, with one k from 1 to 6 for all")
    return k


#: Code of a letter that is none of A, C, G and T, or not there: less than any sum of others.
NO_LETTER = -(4**8)


def letter_codes(seq: Column) -> Column:
    letter = lambda c: F.when(F.length(c) == 1, F.coalesce(F.nullif(F.instr(F.lit(BASES), c), F.lit(0)) - 1, F.lit(NO_LETTER))).otherwise(F.lit(NO_LETTER))
    return F.transform(F.split(seq, ""), letter)


def kmer_codes(seq: Column, k: int) -> Column:
    """The codes of a sequence's windows in order; negative for a window with a letter other than A, C, G and T."""
    codes = one = letter_codes(seq)
    for j in range(1, k):
        rest = F.greatest(F.size(one) - j, F.lit(0))
        codes = F.zip_with(F.slice(codes, 1, rest), F.slice(one, j + 1, rest), lambda a, b: a * 4 + b)
    return codes


#: Letters that are looked up at a time.
SLICE = 1 << 18


def kmer_totals(seq: Column, weights: Weights) -> dict[str, Column]:
    """Sum of the weights of a sequence's windows for each task, in their order; null for null.

    The sequences of a batch are laid end to end: windows are codes of one long array, and their weights are added up by
    sequence. All tasks come from one pass.
    """
    k, held = _k(weights), [np.array([float(x) for x in w]) for w in weights.values()]
    code = np.full(256, NO_LETTER, "int64")
    code[[ord(b) for b in BASES]] = range(len(BASES))

    def added(texts: list[str]) -> np.ndarray:
        letters = [t.encode("ascii", "replace") for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(x) for x in letters])
        flat = code[np.frombuffer(b"".join(letters), "uint8")]
        n = len(flat) - k + 1
        if n < 1:
            return np.zeros((len(texts), len(held)))
        codes = flat[:n]
        for j in range(1, k):
            codes = codes * 4 + flat[j : n + j]
        whole = (codes >= 0) & (row[:n] == row[k - 1 :])
        codes, row = codes[whole], row[:n][whole]
        # bincount adds one after the other, from the first window to the last
        return np.stack([np.bincount(row, w[codes], len(texts)) for w in held], 1)

    @F.pandas_udf(", ".join(f"t{i} double" for i in range(len(held))))
    def totals(seqs: pd.Series) -> pd.DataFrame:
        out = np.full((len(seqs), len(held)), np.nan)
        texts, places, letters = [], [], 0
        for i, text in enumerate(seqs):
            if text is not None:
                texts.append(text)
                places.append(i)
                letters += len(text)
            if texts and (letters >= SLICE or i == len(seqs) - 1):
                out[places] = added(texts)
                texts, places, letters = [], [], 0
        if texts:
            out[places] = added(texts)
        return pd.DataFrame(out, columns=[f"t{i}" for i in range(len(held))])

    made = totals(seq)
    return {task: made[f"t{i}"] for i, task in enumerate(weights)}


def scorer(weights: Weights):
    """A function from a sequence column to one score column a task, as ``scoring`` takes it: the mean weight of the
    windows, null for a sequence shorter than one."""
    k = _k(weights)
    return lambda seq: {task: F.when(F.length(seq) >= k, total / (F.length(seq) - k + 1)) for task, total in kmer_totals(seq, weights).items()}


def substitution_scores(df: DataFrame, weights: Weights, positions: Sequence[int] | None = None, drop_ref: bool = False) -> DataFrame:
    """(id, task, pos, base, own, value): each substitution's score and the sequence's own.

    A substitution at a place changes the k windows that hold it, so only the 2k - 1 letters around it are read
    again: a sequence of n letters costs n * 4 * k windows, not n * 4 * n. Sequences shorter than a window have no rows.
    """
    k, size = _k(weights), F.length("seq")
    totals = [t.alias(f"total__{i}") for i, t in enumerate(kmer_totals(F.col("seq"), weights).values())]
    held = ["id", "n__", *[f"total__{i}" for i in range(len(weights))]]
    # totals and letters are columns before rows are multiplied, or each row would make them again
    made = df.filter(size >= k).select("id", (size - k + 1).alias("n__"), *totals, letter_codes(F.col("seq")).alias("letters__"))
    places = F.sequence(F.lit(0), F.size("letters__") - 1) if positions is None else F.filter(F.array(*map(F.lit, positions)), lambda p: p < F.size("letters__"))
    # the outer form: with the other, Spark adds a filter that computes the letters a second time
    made = made.select(*held, "letters__", F.explode_outer(places).alias("pos")).filter("pos IS NOT NULL")
    at = lambda o: F.coalesce(F.when(F.col("pos") + o >= 0, F.get("letters__", F.col("pos") + o)), F.lit(NO_LETTER))
    firsts = range(1 - k, 1)

    def weight(code: Column, w: Sequence[float]) -> Column:
        return F.when(code >= 0, F.get(F.array(*[F.lit(float(x)) for x in w]), code)).otherwise(0.0)

    # of the k windows that hold the place: their codes without the letter there, and their weights with it
    made = made.select(*held, "pos", *[at(o).alias(f"at{o}") for o in range(1 - k, k)])
    rest = [sum((F.col(f"`at{o}`") * 4 ** (first + k - 1 - o) for o in range(first, first + k) if o != 0), F.lit(0)).alias(f"rest{-first}") for first in firsts]
    made = made.select(*held, "pos", "at0", *rest)
    code = lambda first, letter: F.col(f"rest{-first}") + F.col(letter) * 4 ** (first + k - 1)
    old = [weight(code(first, "at0"), w).alias(f"old{-first}_{i}") for first in firsts for i, w in enumerate(weights.values())]
    made = made.select("*", *old).withColumn("to__", F.explode(F.array(*map(F.lit, range(len(BASES))))))
    if drop_ref:
        made = made.filter("to__ <> at0")

    each = []
    for i, (task, w) in enumerate(weights.items()):
        changed = sum((weight(code(first, "to__"), w) - F.col(f"old{-first}_{i}") for first in firsts), F.lit(0.0))
        each.append(F.struct(F.lit(task).alias("task"), (F.col(f"total__{i}") / F.col("n__")).alias("own"), ((F.col(f"total__{i}") + changed) / F.col("n__")).alias("value")))
    base = F.substring(F.lit(BASES), F.col("to__") + 1, F.lit(1)).alias("base")
    return made.select("id", "pos", base, F.explode(F.array(*each)).alias("s")).select("id", "s.task", "pos", "base", "s.own", "s.value")


def ism_scores(df: DataFrame, weights: Weights, how: Comparison = "subtract", positions: Sequence[int] | None = None) -> DataFrame:
    """(id, task, pos, base, effect): each substitution's score against the sequence's own."""
    return substitution_scores(df, weights, positions).select("id", "task", "pos", "base", compare(F.col("value"), F.col("own"), how).alias("effect"))
