"""SentencePiece encoding and decoding through the tokenizers library (operator 3)."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import piece_model
from helixframe.llm.piece_model import MARK, NORMAL, USER

#: Units whose tokens a Python worker remembers, at most, and units that are joined to one text of a batch.
CACHE, AT_ONCE = 300_000, 2_000
#: Threads that a Python worker encodes batches with; set ``RAYON_NUM_THREADS`` in the executors' environment for more.
THREADS = 2


def rebuild(path: str):
    """A tokenizers.Tokenizer that encodes and decodes as the model file says.

    Normaliser: the model's character map, its squeezing of spaces, the marker put first and
    every space made a marker. Model: unigram scores, or the merges that a BPE vocabulary
    implies (every split of a piece into two pieces, best piece first), with byte fallback.
    """
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    model = piece_model.parse(path)
    if model.unigram:
        # a piece of the user costs a little more than as many of the likeliest piece, so it is taken where it fits
        likeliest = max((s for s, k in zip(model.scores, model.kinds) if k == NORMAL), default=0.0)
        scores = [len(p.encode()) * likeliest - 0.1 if k == USER else s for p, s, k in zip(model.pieces, model.scores, model.kinds)]
        core = models.Unigram(list(zip(model.pieces, scores)), model.unknown, model.byte_fallback)
    else:
        ids = {piece: i for i, piece in enumerate(model.pieces)}
        ranked = []
        for piece, score, kind in zip(model.pieces, model.scores, model.kinds):
            if kind not in (NORMAL, USER):
                continue
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                if left in ids and right in ids:
                    ranked.append((-score, ids[piece], ids[left], ids[right], left, right))
        ranked.sort()
        core = models.BPE(vocab=ids, merges=[x[-2:] for x in ranked], unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    back = [decoders.Metaspace(replacement=MARK, prepend_scheme="never"), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if model.prefix else back)
    if not model.unigram:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p, k in zip(model.pieces, model.kinds) if k == USER])
    return tokenizer


def _split_at(starts: np.ndarray, flat: np.ndarray) -> list[bytes]:
    """The bytes of ``flat`` cut before each place of ``starts``, the first of which is 0."""
    data, ends = flat.tobytes(), np.append(starts[1:], len(flat))
    return [data[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist())]


@lru_cache(maxsize=2)
def _codec(path: str):
    """A function from texts to (ids, decoded text, parity) of each."""
    # read by the tokenizers library when it encodes its first batch
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    threads = int(os.environ["RAYON_NUM_THREADS"])
    import sentencepiece

    fast, slow, model = rebuild(path), sentencepiece.SentencePieceProcessor(model_file=path), piece_model.parse(path)
    cut = model.can_cut
    marked = np.array([p.startswith(MARK) for p in model.pieces])
    known: dict[str, bytes] = {}  # a unit's ids as 32-bit integers
    unlike: set[str] = set()  # units that the two libraries encode differently

    def alone(texts: list[str]) -> None:
        mine = [x.ids for x in fast.encode_batch_fast(texts, add_special_tokens=False)]
        for text, a, b in zip(texts, mine, slow.encode(texts, num_threads=threads)):
            if a != b:
                unlike.add(text)
            known[text] = np.array(a if a == b else b, "int32").tobytes()

    def learn(texts: list[str]) -> None:
        """Encodes a batch of texts that each join many units, on several threads: a unit begins with a marker,
        where its ids are told apart."""
        plain = [t for t in texts if " " not in t and MARK not in t] if cut else []
        batch = [plain[i : i + AT_ONCE] for i in range(0, len(plain), AT_ONCE)]
        joined = [" ".join(own) for own in batch]
        if batch:
            mine = [x.ids for x in fast.encode_batch_fast(joined, add_special_tokens=False)]
            for own, ids, theirs in zip(batch, mine, slow.encode(joined, num_threads=threads)):
                flat = np.array(ids, "int32")
                starts = np.flatnonzero(marked[flat])
                if ids == theirs and len(starts) == len(own) and starts[0] == 0:
                    known.update(zip(own, _split_at(starts, flat)))
                else:
                    alone(own)
        if len(plain) < len(texts):
            alone([t for t in texts if t not in known])

    def run(texts: list[str]) -> Iterator[tuple[np.ndarray, str, bool]]:
        if len(known) > CACHE:  # the first ones learned are the commonest, and stay
            for unit in list(known)[CACHE // 2 :]:
                del known[unit]
        split = [piece_model.units(t) if cut else [t] for t in texts]
        new = [u for u in set().union(*split) if u and u not in known]
        learn(new)
        if "" not in known:
            # the lone marker can only be encoded after something
            mine, theirs = ([x("a ")[len(x("a")) :] if cut else [] for x in (lambda t: fast.encode(t, add_special_tokens=False).ids, slow.encode)])
            if mine != theirs:
                unlike.add("")
            known[""] = np.array(mine if mine == theirs else theirs, "int32").tobytes()
        coded = [np.frombuffer(b"".join(map(known.__getitem__, own)), "int32") for own in split]
        said = fast.decode_batch([ids.tolist() for ids in coded], skip_special_tokens=False)
        for own, ids, back in zip(split, coded, said):
            yield ids, back, not unlike or unlike.isdisjoint(own)

    return run


CODED = T.StructType([T.StructField("input_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())])


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), slice_chars: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns, then

    * ``input_ids`` array<int>: the tokens of the whole text, no special ones added;
    * ``n_tokens`` long;
    * ``round_trip`` boolean: the rebuilt tokenizer's decoding of the document's ids gives the
      text back, but for a marker character in it, which the format itself turns into a space;
    * ``parity`` boolean: the rebuilt tokenizer gave the ids that the SentencePiece library
      gives. Where it did not, the library's ids are returned, so ids are right in any case.

    Each batch is cut into units (see ``piece_model``); units not seen before are encoded by
    both libraries, and texts are put together from the rebuilt tokenizer's ids. A null text
    counts as empty and has no ids. Texts of any length are coded whole. Repeated rows give repeated
    results and an empty table an empty one. Other columns are ignored, so none can clash.
    """
    held = docs.select(*[F.col(c).alias(f"keep__{i}") for i, c in enumerate(keep)], F.col(text).alias("text__"))
    schema = T.StructType([*held.schema.fields[:-1], *CODED.fields])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _codec(model_path)
        kinds = [pa.list_(pa.field("element", pa.int32(), False)), pa.int64(), pa.bool_(), pa.bool_()]

        def done(batch: pa.RecordBatch, at: int, texts: list[str]) -> pa.RecordBatch:
            rows = list(run(texts))
            sizes = np.array([len(ids) for ids, _, _ in rows], "int64")
            ends = np.append(0, sizes.cumsum()).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([ids for ids, _, _ in rows])), type=kinds[0])
            same = [back == (said.replace(MARK, " ") if MARK in said else said) for said, (_, back, _) in zip(texts, rows)]
            kept = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
            own = [lists, pa.array(sizes), pa.array(same, kinds[2]), pa.array([p for _, _, p in rows], kinds[3])]
            return pa.RecordBatch.from_arrays([*kept, *own], names=schema.names)

        # results go out slice by slice, so that a batch of long texts is never held twice
        for batch in batches:
            at, texts, chars = 0, [], 0
            for value in batch.column(len(keep)):
                texts.append(value.as_py() or "")
                chars += len(texts[-1])
                if chars >= slice_chars:
                    yield done(batch, at, texts)
                    at, texts, chars = at + len(texts), [], 0
            if texts:
                yield done(batch, at, texts)

    made = held.mapInArrow(coded, schema)
    return made.select(*[F.col(f"keep__{i}").alias(c) for i, c in enumerate(keep)], *CODED.names)


def decode(coded: DataFrame, model_path: str, ids: str = "input_ids", out: str = "decoded") -> DataFrame:
    """``coded`` plus the string column ``out``: the text of each id list, null for null."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = rebuild(model_path)
        for lists in batches:
            there = lists.notna()
            said = iter(tokenizer.decode_batch([list(map(int, x)) for x in lists[there]], skip_special_tokens=False))
            yield pd.Series([next(said) if t else None for t in there], dtype="object")

    return coded.withColumn(out, texts(F.col(ids)))
