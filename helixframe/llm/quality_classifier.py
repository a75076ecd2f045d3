"""Quality classifier from weak labels (operator 1)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import Scratch, unit_hash, words

GOOD, BAD, ABSTAIN = 1, 0, -1
#: log2 of the buckets that words are hashed to.
BITS = 15
#: Rows whose features are put together at a time.
SLICE = 500


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, BAD)
    return (vote if good is None else vote.when(good, GOOD)).otherwise(ABSTAIN).cast("byte")


def labellers(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` plus one byte column for each of the overlapping heuristics, and their names.
    A heuristic votes 0 (bad), 1 (good) or -1 (no opinion) on the whole text."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.length(body)
    rest = lambda pattern: n - F.length(F.regexp_replace(body, pattern, ""))
    tokens, lines, count = F.col("tokens__"), F.col("lines__"), F.size("tokens__")
    counted = docs.withColumn("tokens__", words(F.col(text))).withColumn("lines__", F.split(body, "\n"))
    counted = counted.withColumns({"letters__": rest(r"\p{L}+"), "symbols__": rest(r"[#*$%&|<>!=~^]+"), "capitals__": rest(r"\p{Lu}+"), "ends__": rest(r"[.?]+"), "shouts__": rest("!!+"), "distinct__": F.size(F.array_distinct(tokens))})
    less = F.greatest(count - 1, F.lit(0))
    echoes = F.size(F.filter(F.zip_with(F.slice(tokens, 1, less), F.slice(tokens, 2, less), lambda a, b: a == b), lambda same: same))
    bare = F.size(F.filter(tokens, lambda t: (F.length(t) < 4) & ~t.rlike(r"[\p{L}\p{N}]")))
    distinct, letters, capitals = F.col("distinct__"), F.greatest("letters__", F.lit(1)), F.col("capitals__")
    votes = {
        "symbols": _vote(F.col("symbols__") > 0.05 * n),
        "letters": _vote(F.col("letters__") < 0.68 * n),
        "capitals": _vote((count > 5) & (capitals > 0.3 * letters)),
        "shouts": _vote(F.col("shouts__") > 0.02 * n),
        "bare": _vote((count > 5) & (bare > 0.1 * count)),
        "variety": _vote((count > 20) & (distinct < 0.12 * count), (count > 10) & (distinct > 0.35 * count)),
        "echoes": _vote((count > 5) & (echoes > 0.2 * count)),
        "lines": _vote((F.size(lines) > 4) & (F.size(F.array_distinct(lines)) < 0.5 * F.size(lines))),
        "sentences": _vote((count > 40) & (F.col("ends__") == 0), (F.col("ends__") > 0.003 * n) & (F.col("ends__") < 0.2 * n)),
    }
    return counted.withColumns({f"vote__{k}": v for k, v in votes.items()}).drop("tokens__", "lines__", "letters__", "symbols__", "capitals__", "ends__", "shouts__", "distinct__"), [f"vote__{k}" for k in votes]


@dataclass(frozen=True)
class Accuracies:
    """What expectation-maximisation found: the share of good texts, and each labeller's
    distribution of votes (0, 1, none) on bad and on good texts."""

    names: list[str]
    prior: float
    votes: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        at = np.where(votes < 0, 2, votes)
        logs = np.log(np.maximum(self.votes, 1e-12))
        scores = sum(logs[:, i, at[:, i]] for i in range(votes.shape[1])) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(scores[0] - scores[1]))

    def posterior_column(self, votes: Column) -> Column:
        """P(good) as an expression over an array of votes."""
        logs = np.log(np.maximum(self.votes, 1e-12))
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for i, (bad, good, none) in enumerate((logs[1] - logs[0]).tolist()):
            vote = F.get(votes, F.lit(i))
            odds = odds + F.when(vote == BAD, bad).when(vote == GOOD, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


#: Labellers that may vote either way; the others vote bad or not at all.
TWO_SIDED = ("vote__variety", "vote__sentences")
#: Votes (0, 1, none) expected on bad and on good texts of a labeller of each kind before any is seen.
PRIOR_TWO_SIDED = ((0.40, 0.10, 0.50), (0.01, 0.49, 0.50))
PRIOR_BAD_ONLY = ((0.40, 0.0, 0.60), (0.01, 0.0, 0.99))


def priors(names: list[str]) -> np.ndarray:
    """(class, labeller, vote): what each labeller is expected to vote; 0 for votes it can't cast."""
    return np.array([PRIOR_TWO_SIDED if n in TWO_SIDED else PRIOR_BAD_ONLY for n in names]).transpose(1, 0, 2)


def estimate(names: list[str], votes: np.ndarray, counts: np.ndarray, rounds: int = 500, prior_rows: float = 20.0, expected: np.ndarray | None = None) -> Accuracies:
    """Expectation-maximisation over distinct vote rows and how many texts have each.

    It starts from any bad vote: texts with one count as bad, since most labellers vote on what
    is wrong alone. ``expected`` (see ``priors``) counts as ``prior_rows``
    texts of each class, however many texts there are, so data outweigh it; it tells the
    classes apart, and a vote that a labeller can't cast keeps probability 0.
    """
    expected = priors(names) if expected is None else expected
    at = np.where(votes < 0, 2, votes)
    good = np.where((votes == BAD).any(1), 0.05, 0.95)
    model = None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = float(np.clip(weight[1].sum() / max(weight.sum(), 1e-9), 0.01, 0.99))
        table = np.zeros((2, len(names), 3))
        for i in range(len(names)):
            for vote in range(3):
                table[:, i, vote] = weight[:, at[:, i] == vote].sum(1)
        seen = table.sum(2, keepdims=True)
        model = Accuracies(names, prior, (table + prior_rows * expected) / np.maximum(seen + prior_rows, 1e-9))
        before, good = good, model.posterior(votes)
        if np.abs(good - before).max(initial=0.0) < 1e-6:
            break
    return model


def _buckets(names: list[str]) -> np.ndarray:
    """The buckets of tokens and shapes; 0 is that of texts without words."""
    try:
        coded = list(map(zlib.crc32, map(str.encode, names)))
    except UnicodeEncodeError:
        coded = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in names]
    return 1 + np.array(coded, "int64") % ((1 << BITS) - 2)


def _shape(token: str) -> str:
    """Kinds of a token's first and last characters, and its case."""
    if token.isalpha() and token.islower():  # most are
        return "\x00ala"
    end = token[-2:] if not token[-1].isalnum() else "a" if token[-1].isalpha() else "0"
    return f"\x00{'a' if token[0].isalpha() else token[0]}{'U' if token.isupper() and len(token) > 1 else 'l'}{end}"


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets and their weights: each distinct token, and its shape (see ``_shape``) and
    whether it equals the token before, by square root of its share."""
    tokens = text.split()
    if not tokens:
        return np.zeros(1, "int64"), np.ones(1)
    counts = Counter(tokens)
    shapes = {"\x00same": sum(map(eq, tokens, tokens[1:]))}
    for shape, n in zip(map(_shape, counts), counts.values()):
        shapes[shape] = shapes.get(shape, 0) + n
    both = [*counts.values(), *shapes.values()]
    return _buckets([*counts, *shapes]), np.sqrt(np.asarray(both, "float64") / len(tokens))


def _vectors(texts: list[str]) -> pa.StructArray:
    """The features of each text as a sparse vector in the form that Spark stores it."""
    found = [features(t) for t in texts]
    own = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
    keys, back = np.unique((own << BITS) | np.concatenate([at for at, _ in found]), return_inverse=True)
    values = np.bincount(back, np.concatenate([x for _, x in found]), len(keys))
    ends = pa.array(np.searchsorted(keys, np.arange(len(found) + 1) << BITS), "int32")
    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((keys & ((1 << BITS) - 1)).astype("int32"), values)]
    return pa.StructArray.from_arrays([pa.array(np.zeros(len(found), "int8")), pa.array(np.full(len(found), 1 << BITS, "int32")), *lists], ["type", "size", "indices", "values"])


def voted_vectors(docs: DataFrame, store: Scratch, text: str = "text", drawn: Column | None = None, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """(votes, drawn, features) of every row, written once, and the labellers' names: what the accuracies and
    the scorer are fitted on, and what is scored. Texts are read, voted on and hashed in this one pass. The columns
    ``keep`` are written beside: the text as ``text``, the others in the struct ``kept``."""
    others = [F.struct(*[F.col(c) for c in keep if c != text]).alias("kept")] if set(keep) - {text} else []
    voted, names = labellers(docs.select(F.col(text).alias("text"), (F.lit(True) if drawn is None else drawn).alias("drawn"), *others))
    made = voted.select("text", "drawn", F.array(*names).alias("votes"), *(["kept"] if others else []))
    through = ["votes", "drawn", *(["kept"] if others else []), *(["text"] if text in keep else [])]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                found = _vectors([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in through], found], [*through, "features"])

    fields = lambda kind: T.StructType([T.StructField(c, made.schema[c].dataType) for c in through] + [T.StructField("features", kind)])
    return store.cut(made.mapInArrow(hashed, fields(VectorUDT.sqlType())), fields(VectorUDT())), names


def fit_labellers(voted: DataFrame, names: list[str]) -> Accuracies:
    """The accuracies over all rows of ``voted``. The driver gets one row for each pattern
    of votes, of which there are at most three to the power of the number of labellers."""
    patterns = voted.groupBy("votes").count().collect()
    votes = np.array([r["votes"] for r in patterns], "int64").reshape(-1, len(names))
    return estimate(names, votes, np.array([r["count"] for r in patterns], "float64"))


def fit_scorer(voted: DataFrame, model: Accuracies, rounds: int = 40, decay: float = 1e-4) -> np.ndarray:
    """Weights of a linear scorer over hashed features, the bias last: logistic regression on the posterior
    labels of all rows of ``voted``. A label between bad and good is a row of each class, weighted by its posterior
    (to four digits, so that a sure one is one row). Spark fits it; the driver gets sums by bucket alone. Weights are
    rounded to six digits, as sums of doubles depend on the order of tasks."""
    good = F.round(model.posterior_column(F.col("votes")), 4)
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), good.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - good).alias("weight"))))
    rows = voted.select("features", sides.alias("side")).select("features", "side.label", "side.weight").filter("weight > 0")
    if rows.isEmpty():
        return np.zeros((1 << BITS) + 1)
    # each round's gradients are as many as partitions, so these don't grow with the input
    rows = rows.coalesce(4 * voted.sparkSession.sparkContext.defaultParallelism)
    fitted = LogisticRegression(weightCol="weight", maxIter=rounds, regParam=decay, standardization=False).fit(rows)
    # with one class alone the bias is infinite
    return np.clip(np.round(np.append(fitted.coefficients.toArray(), fitted.intercept), 6), -500, 500)


def classify(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5, sample_rows: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` plus ``quality_score`` (0 to 1) and ``quality_kept`` (score at least ``threshold``).

    Accuracies of overlapping heuristic labellers are estimated over all rows, without any
    labels given; the posterior labels of all rows train a hashed linear scorer, which scores
    every whole text. A null text counts as empty; texts without words have a bucket of their own as
    their feature and so a defined score. Repeated rows get equal scores; an empty table gives an
    empty one. Columns of the two names are replaced.

    Texts are hashed once: the features that the scorer is trained on are written and scored, with the columns of
    docs that are in ``keep`` (all if it is None).

    Only a caller who names ``sample_rows`` gets a scorer trained on about so many rows, drawn by a hash of
    ``key`` and text; the queries train on all.
    """
    store = Scratch(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("quality_score", "quality_kept")]
    drawn = None if sample_rows is None else F.coalesce(unit_hash(F.col(key).cast("string"), F.col(text)) < sample_rows / max(docs.count(), 1), F.lit(False))
    voted, names = voted_vectors(docs, store, text, drawn, keep)
    weights = fit_scorer(voted.filter("drawn"), fit_labellers(voted, names))
    store.tidy()
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(at: pa.Array, x: pa.Array) -> pa.Array:
        w = held.value
        own = np.repeat(np.arange(len(at)), at.value_lengths())
        sums = np.bincount(own, w[at.flatten()] * x.flatten().to_numpy(), len(at)) + w[-1]
        return pa.array(1 / (1 + np.exp(-sums)))

    vector = F.unwrap_udt("features")
    scored = voted.withColumn("quality_score", score(vector["indices"], vector["values"])).withColumn("quality_kept", F.col("quality_score") >= threshold)
    return scored.select(*[F.col("text").alias(c) if c == text else F.col("kept")[c].alias(c) for c in keep], "quality_score", "quality_kept")
