"""DNA strings as Column expressions. Positions are 0-based; nulls give nulls."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.schema import BASES, CODES

End = str  # "both", "left" or "right"


def _col(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def _end(end: End) -> None:
    if end not in ("both", "left", "right"):
        raise ValueError("end must be both, left or right")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C among all letters, N included; null for an empty string."""
    return (F.length(seq) - F.length(F.translate(seq, "GC", ""))) / F.nullif(F.length(seq), F.lit(0))


def seq_length(seq: Column) -> Column:
    return F.length(seq)


def all_equal_length(seq: Column) -> Column:
    """An aggregate: whether all sequences have one length; null without any."""
    return F.min(F.length(seq)) == F.max(F.length(seq))


def valid_dna(seq: Column) -> Column:
    return seq.rlike("^[ACGTN]*$")


def pad(seq: Column, size: Column | int, end: End = "both") -> Column:
    """N added at the named end up to ``size``; of an odd number, the extra one on the right."""
    _end(end)
    lack = F.greatest(_col(size) - F.length(seq), F.lit(0))
    left = F.floor(lack / 2).cast("int") if end == "both" else lack if end == "left" else F.lit(0)
    return F.concat(F.repeat(F.lit("N"), left), seq, F.repeat(F.lit("N"), lack - left))


def trim(seq: Column, size: Column | int, end: End = "both") -> Column:
    """Letters cut at the named end down to ``size``; of an odd number, the extra one on the right."""
    _end(end)
    over = F.greatest(F.length(seq) - _col(size), F.lit(0))
    left = F.floor(over / 2).cast("int") if end == "both" else over if end == "left" else F.lit(0)
    return F.substring(seq, left + 1, F.length(seq) - over)


def resize(seq: Column, size: Column | int, end: End = "both") -> Column:
    return F.when(F.length(seq) < _col(size), pad(seq, size, end)).otherwise(trim(seq, size, end))


def mutate(seq: Column, allele: Column, pos: Column | int | None = None) -> Column:
    """``allele`` written over the letters at ``pos``; in the middle if None."""
    at = F.floor(F.length(seq) / 2 - F.length(allele) / 2).cast("int") if pos is None else _col(pos).cast("int")
    return F.overlay(seq, allele, at + 1)


def insert(seq: Column, added: Column, pos: Column | int | None = None, keep_len: bool = False, end: End = "both") -> Column:
    """``added`` put in before ``pos`` (half way if None); cut back to the old length if asked."""
    at = F.floor(F.length(seq) / 2).cast("int") if pos is None else _col(pos).cast("int")
    made = F.overlay(seq, added, at + 1, F.lit(0))
    return trim(made, F.length(seq), end) if keep_len else made


def delete(seq: Column, size: Column | int, pos: Column | int | None = None, keep_len: bool = False, end: End = "both") -> Column:
    """``size`` letters from ``pos`` on (the middle ones if None) taken out; padded back if asked."""
    size = _col(size)
    at = F.floor(F.length(seq) / 2 - size / 2).cast("int") if pos is None else _col(pos).cast("int")
    made = F.concat(F.substring(seq, F.lit(1), at), F.substring(seq, at + size + 1, F.length(seq)))
    return pad(made, F.length(seq), end) if keep_len else made


def differences(left: Column, right: Column) -> Column:
    """Positions at which two strings of one length differ."""
    apart = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: ~a.eqNullSafe(b))
    places = F.transform(F.slice(apart, F.lit(1), F.length(left)), lambda x, i: F.when(x, i))
    found = F.when(right.isNotNull(), F.filter(places, lambda i: i.isNotNull()))
    return F.when(F.length(left) > 0, found).otherwise(F.expr("cast(array() as array<int>)"))


def count_overlapping(seq: Column, pattern: str) -> Column:
    """Places where the literal pattern starts, overlapping ones too."""
    return F.regexp_count(seq, F.lit(f"(?=\\Q{pattern}\\E)"))


def pattern_score(seq: Column, patterns: Sequence[str], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, (count_overlapping(seq, p) * float(w) for p, w in zip(patterns, weights, strict=True)))


def encode(seq: Column) -> Column:
    """Codes 0 to 4 for A, C, G, T, N; -1 for any other letter."""
    codes = F.transform(F.split(seq, ""), lambda x: (F.instr(F.lit(CODES), x) - 1).cast("int"))
    return F.when(F.length(seq) > 0, codes).otherwise(F.expr("cast(array() as array<int>)"))


def phase_counts(seq: Column, period: int) -> Column:
    """Counts of A, C, G and T at the places whose remainder modulo ``period`` is 0, 1, …: one array for each
    remainder; null for null. All is counted within the row."""

    @F.pandas_udf("array<long>")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [t[r::period].count(b) for r in range(period) for b in BASES] for t in texts], dtype="object")

    made = counted(seq)
    return F.when(seq.isNotNull(), F.array(*[F.slice(made, r * 4 + 1, 4) for r in range(period)]))


def decode(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(CODES), c + 1, F.lit(1))), "")


#: subtract, divide or log2FC, or a function of two columns.
Comparison = str | Callable[[Column, Column], Column]


def compare(left: Column, right: Column, how: Comparison = "subtract") -> Column:
    """``left`` against ``right``; null where it has no value."""
    ratio = left / F.nullif(right, F.lit(0.0))
    if callable(how):
        return how(left, right)
    if how == "subtract":
        return left - right
    if how == "divide":
        return ratio
    if how == "log2FC":
        return F.log2(ratio)
    raise ValueError("how must be subtract, divide, log2FC or a function")


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))


def label_transform(value: Column, low: float | None = None, high: float | None = None, how: str | Callable[[Column], Column] | None = None) -> Column:
    """Clipped, then as it is, its log or log1p, or what a function makes of it."""
    named = {None: lambda x: x, "log": F.ln, "log1p": F.log1p}
    return (how if callable(how) else named[how])(clip(value, low, high))
