"""The parts of a SentencePiece model file that both tokenizer operators need.

Texts are cut into units before they are encoded: a unit is a run of space markers and
what follows it up to the next one. The cut changes no token if no piece of the vocabulary
holds a marker after another character, since then no merge can cross a cut; ``can_cut``
proves that from the vocabulary.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


@dataclass(frozen=True)
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    byte_fallback: bool
    charsmap: bytes
    prefix: bool
    squeeze: bool

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    @property
    def can_cut(self) -> bool:
        plain = not self.charsmap and self.prefix and not self.squeeze
        crossing = re.compile(f"[^{MARK}]{MARK}")
        return plain and not self.unigram and not any(crossing.search(p) for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER))


def parse(path: str) -> PieceModel:
    """Reads the protobuf's pieces, trainer and normaliser settings."""
    pieces, scores, kinds = [], [], []
    trainer: dict = {}
    normaliser: dict = {}
    with open(path, "rb") as file:
        data = file.read()
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models can be rebuilt")
    return PieceModel(pieces, scores, kinds, kind == 1, bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))


def units(text: str) -> list[str]:
    """The units of a text, each as the text that encodes to it alone: without the marker
    that the model puts before any text."""
    if not text:
        return []
    parts = text.split(" ")
    if MARK not in text and "" not in parts:
        return parts
    return [unit[1:].replace(MARK, " ") for unit in UNIT.findall(MARK + text.replace(" ", MARK))]
