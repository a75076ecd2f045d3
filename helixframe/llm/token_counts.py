"""Token counts with a whole-token shortcut (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import piece_model

#: Pre-tokens whose count a Python worker remembers, at most.
CACHE = 400_000


def single_tokens(path: str) -> frozenset[str]:
    """Proves which vocabulary strings the library encodes alone as one token: once, on the driver.

    Every normal piece that starts with the space marker is given to the library as a text
    of its own; those that come back as exactly that one id are single.
    """
    import sentencepiece

    model = piece_model.parse(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [(p[1:].replace(piece_model.MARK, " "), i) for i, p in enumerate(model.pieces) if model.kinds[i] == piece_model.NORMAL and len(p) > 1 and p[0] == piece_model.MARK]
    encoded = library.encode([text for text, _ in own], num_threads=1)
    return frozenset(text for (text, i), ids in zip(own, encoded) if ids == [i])


#: In a Python worker: the proved single tokens by model path, as the driver sent them.
_SINGLE: dict[str, frozenset[str]] = {}


def _counter(path: str, held: Broadcast):
    if path not in _SINGLE:
        _SINGLE[path] = held.value
    return _make_counter(path)


@lru_cache(maxsize=2)
def _make_counter(path: str):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    cut = piece_model.parse(path).can_cut
    known = dict.fromkeys(_SINGLE[path], 1) if cut else {}
    room = len(known) + CACHE

    def count(texts: list[str]) -> list[int]:
        if not cut:
            return [len(ids) for ids in library.encode(texts, num_threads=1)]
        if len(known) > room:
            for key in list(known)[room - CACHE :]:
                del known[key]
        split = [piece_model.units(text) for text in texts]
        rest = list({unit for own in split for unit in own if unit not in known})
        # an empty unit is a marker alone: the library gives nothing for an empty text
        plain = [unit for unit in rest if unit]
        known.update(zip(plain, map(len, library.encode(plain, num_threads=1))))
        if "" in rest:
            known[""] = len(library.encode("a ")) - len(library.encode("a"))
        get = known.__getitem__
        return [sum(map(get, own)) for own in split]

    return count


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens", slice_chars: int = 4_000_000) -> DataFrame:
    """``docs`` plus the long column ``out``: tokens of the whole text without special ones.

    A pre-token that the vocabulary proves to be one token counts as one at once; only the
    others are merged, by the library itself, each distinct one once a batch. A null or empty
    text has 0 tokens. Special strings inside a text are ordinary text. A text of any length
    is counted whole; batches are cut so that at most about ``slice_chars`` characters are
    held as pre-tokens at a time, a single longer text aside. Repeated rows count each on
    its own, an empty table gives an empty one, and a column named ``out`` is replaced.
    """
    # as many strings as the vocabulary has at most
    held = docs.sparkSession.sparkContext.broadcast(single_tokens(model_path))

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(model_path, held)
        for texts in batches:
            found: list[int] = []
            own: list[str] = []
            chars = 0
            for value in texts:
                own.append(value if isinstance(value, str) else "")
                chars += len(own[-1])
                if chars >= slice_chars:
                    found += count(own)
                    own, chars = [], 0
            yield pd.Series(found + (count(own) if own else []), dtype="int64")

    return docs.withColumn(out, counts(F.col(text)))
