"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text once; at each position its output links give
every piece that ends there, and each relaxes the best score of the position: a single-pass Viterbi.
Characters that no piece holds become byte pieces, at a cost below any path of real pieces.

No piece has the word mark anywhere but in its leading marks (a model that has one is refused), so the best path of a text is made of
the best paths of its words, each with the marks before it. Distinct words are therefore solved once
and kept in a table of bounded size, and a text is put together from them.

The piece table comes from a model file. A unigram model's scores are log probabilities and are used
as they are. In a BPE model they are merge ranks, no probabilities, so a piece of rank r gets the
score -ln(r + 2.7) of a Zipf law, which prefers few and frequent pieces.

Encoding turns each space into a mark after one mark is put in front. A mark that the text itself
holds is written in byte pieces, so decoding is exact: decode(encode(t)) = t for every text.

Defined cases. A null text gives null ids, an empty text no ids. Texts of any length are encoded
whole. Rows are independent of each other: repeated rows, empty tables and other columns need no rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from evspark.llm.common import TOKENIZERS, in_worker, numbered, resident, slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Distinct words that a worker remembers. Beyond that the table starts anew; results don't change.
REMEMBERED = 250_000
#: A byte piece's score, below that of any piece.
BYTE_SCORE = -40.0


class Pieces(NamedTuple):
    score: dict[str, tuple[int, float]]  # piece: id, score
    byte_ids: tuple[int, ...]  # id of the piece for each byte
    text: tuple[bytes, ...]  # by id, what the piece stands for


def load(path: str = f"{TOKENIZERS}/{MODEL}") -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    own = [model.get_score(i) for i in range(len(names))]
    bytes_ = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
    real = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranks = all(own[i] == int(own[i]) for i in real)
    score = {names[i]: (i, -math.log(2.7 + min(-own[i], len(names))) if ranks else own[i]) for i in real}
    if inner := [n for n in score if MARK in n.lstrip(MARK)]:
        raise ValueError(f"pieces with a mark inside: {inner[:3]}")
    back = {i: b for b, i in bytes_.items()}
    text = _texts(names, back, set(real))
    return Pieces(score, tuple(bytes_[b] for b in range(256)), text)


def _texts(names: list[str], back: dict[int, int], real: set[int]) -> tuple[bytes, ...]:
    return tuple(bytes([back[i]]) if i in back else n.replace(MARK, " ").encode() if i in real else b"" for i, n in enumerate(names))


def automaton(pieces: Pieces):
    import ahocorasick

    a = ahocorasick.Automaton()
    for piece, (i, score) in pieces.score.items():
        a.add_word(piece, (len(piece), i, score))
    a.make_automaton()
    return a


def viterbi(a, pieces: Pieces, text: str) -> list[int]:
    """Ids of the best path through a text in which marks stand for spaces."""
    n = len(text)
    best = [0.0] + [-math.inf] * n
    via: list = [None] * (n + 1)
    at = 0  # positions below have their final score

    def settle(upto: int) -> None:
        """Positions that no path of pieces has reached are reached by a character's bytes."""
        nonlocal at
        while at < upto:
            at += 1
            here = best[at - 1] + BYTE_SCORE * len(text[at - 1].encode())
            if here > best[at]:
                best[at], via[at] = here, (1, -1)

    for end, (length, i, score) in a.iter(text):
        settle(end)
        if (new := best[end + 1 - length] + score) > best[end + 1]:
            best[end + 1], via[end + 1] = new, (length, i)
    settle(n)
    out: list[int] = []
    while n:
        length, i = via[n]
        if i < 0:
            out += [pieces.byte_ids[b] for b in reversed(text[n - 1].encode())]
        else:
            out.append(i)
        n -= length
    return out[::-1]


class Encoder:
    def __init__(self, pieces: Pieces):
        self.pieces, self.automaton, self.known = pieces, automaton(pieces), {}

    def word(self, word: str) -> list[int]:
        """Ids of one word with the spaces before it."""
        if MARK not in word:
            return viterbi(self.automaton, self.pieces, word.replace(" ", MARK))
        own, out = [self.pieces.byte_ids[b] for b in MARK.encode()], []
        for k, part in enumerate(word.split(MARK)):
            out += own * (k > 0) + (viterbi(self.automaton, self.pieces, part.replace(" ", MARK)) if part else [])
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        full = pc.binary_join_element_wise(pa.array([" "] * len(texts)), texts, "")
        lists = _split_words(full)
        code, words = numbered(lists.flatten())
        if len(self.known) + len(words) > REMEMBERED:
            self.known = {}
        parts = []
        for w in words.to_pylist():
            got = self.known.get(w)
            if got is None:
                got = np.asarray(self.word(w), dtype=np.int32).tobytes()  # an array takes three times as much
                if len(w) <= 64:
                    self.known[w] = got
            parts.append(got)
        sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        flat = np.frombuffer(b"".join(parts), np.int32)
        starts = np.cumsum(sizes) - sizes
        n = sizes[code]
        ends = np.cumsum(n)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[code] - (ends - n), n)
        per_text = np.zeros(len(texts) + 1, np.int64)
        per_text[1:] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], ends])[np.cumsum(per_text)]
        return flat[where], np.diff(edges)

    def encode(self, text: str) -> list[int]:
        return self.ids(pa.array([text]))[0].tolist() if text else []


def _split_words(full: pa.Array) -> pa.ListArray:
    """Each text cut before every run of spaces."""
    data = np.frombuffer(full.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(full.buffers()[1], dtype=np.int32)[full.offset : full.offset + len(full) + 1]
    data = data[: offsets[-1]]
    space = data == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first).astype(np.int32)
    starts = starts[starts >= offsets[0]]
    values = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int32).tobytes()), full.buffers()[2]])
    rows = np.searchsorted(starts, offsets).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), values)


def decode(pieces: Pieces, ids) -> str:
    """The text that encode() was given: the pieces' bytes less the space that was put in front."""
    return b"".join([pieces.text[i] for i in ids])[1:].decode("utf-8", "replace")


def encode_column(docs: DataFrame, text: str = "text", into: str = "ids", model: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """docs with the ids of a text column. Map-only. The driver reads the model file and broadcasts its
    pieces, whose number the vocabulary fixes."""
    return with_ids(docs, lambda encoder, ids, ends, batch: [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=pc.is_null(batch.column(text)))], [StructField(into, ArrayType(IntegerType()))], text, model)


def with_ids(docs: DataFrame, derive, fields: list[StructField], text: str = "text", model: str = f"{TOKENIZERS}/{MODEL}") -> DataFrame:
    """docs with columns that derive(encoder, ids, ends, batch) makes of each slice's ids; a column of
    docs with the name of one gives way."""
    docs = docs.drop(*[f.name for f in fields])
    sent = docs.sparkSession.sparkContext.broadcast(tuple(load(model)))
    key = hash(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident("spm", key, lambda: Encoder(Pieces(*sent.value)))
        for batch in slices(batches, text):
            col = pc.fill_null(batch.column(text), "")
            ids, n = encoder.ids(col)
            lengths = pc.binary_length(col).to_numpy(zero_copy_only=False)
            if (lengths == 0).any():  # an empty text has no mark in front
                keep = np.repeat(lengths > 0, n)
                ids, n = ids[keep], np.where(lengths > 0, n, 0)
            ends = np.concatenate([[0], np.cumsum(n)])
            for field, values in zip(fields, derive(encoder, ids, ends, batch), strict=True):
                batch = batch.append_column(field.name, values)
            yield batch

    return docs.mapInArrow(in_worker("spm", work), StructType([*docs.schema.fields, *fields]))
