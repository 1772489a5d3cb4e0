"""Tokeniser fertility: quality rules from what public vocabularies make of a text.

A vocabulary that knows a language well spends few tokens on it. Three measures of the tokens of a
whole text are held against the band of its language, or of its script where the language has no
band: characters per token, the share of byte-fallback tokens (tokens that aren't whole characters)
and the entropy of the token distribution in bits. A text outside any of them is rejected, and so is
one that fails the base rules (too few words, or too many in repeated 3-word windows).

Defined cases. A null text counts as an empty one; a text without words has no tokens, measures 0
and base_failed true. A null or unknown language is judged by script, an unknown script by the
widest band. A text with more byte fallback than its language's band allows fails, unless it is mixed: MIXED_SHARE
of its characters or more stand in sentences that its language's limits allow. It is then held against the
band "mixed", which is narrower than that of a script. Repeated
rows give repeated rows, an empty table an empty one, and columns of the input besides id and text don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm.common import TOKENIZERS, in_worker, numbered, per_row, resident, slices, utf8, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

#: The pretokeniser pattern that byte-level vocabularies of this kind publish. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: White space as the pattern knows it, in runs so long that the pattern's look-ahead could outgrow its stack.
_LONG_GAP = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


class Band(NamedTuple):
    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


#: Vocabulary by language; "" is for all others.
VOCABULARIES = {"en": "byte_bpe_50k.tiktoken", "": "byte_bpe_multi_50k.tiktoken"}

#: By language, for texts in a language and others beside it ("mixed"), by script, then "" for the rest.
BANDS = {
    "en": Band(2.30, 8.0, 0.03, 4.2),
    "de": Band(2.20, 8.0, 0.05, 4.2),
    "fr": Band(1.95, 8.0, 0.05, 4.2),
    "es": Band(2.00, 8.0, 0.05, 4.2),
    "mixed": Band(2.00, 8.0, 0.10, 5.6),
    "latin": Band(1.50, 8.0, 0.15, 4.0),
    "cyrillic": Band(1.50, 8.0, 0.10, 4.0),
    "greek": Band(1.00, 8.0, 0.20, 4.0),
    "arabic": Band(1.00, 8.0, 0.15, 4.0),
    "hebrew": Band(0.90, 8.0, 0.20, 4.0),
    "devanagari": Band(0.50, 8.0, 0.70, 4.0),
    "thai": Band(0.70, 8.0, 0.30, 4.0),
    "hangul": Band(0.80, 8.0, 0.60, 4.0),
    "cjk": Band(0.60, 8.0, 0.45, 4.0),
    "": Band(0.40, 8.0, 0.70, 3.5),
}
SCRIPTS = {
    "latin": ((0x0, 0x250), (0x1E00, 0x1F00)),
    "cyrillic": ((0x400, 0x530),),
    "greek": ((0x370, 0x400), (0x1F00, 0x2000)),
    "arabic": ((0x600, 0x700), (0x750, 0x780), (0x8A0, 0x900), (0xFB50, 0xFE00), (0xFE70, 0xFF00)),
    "hebrew": ((0x590, 0x600),),
    "devanagari": ((0x900, 0x980),),
    "thai": ((0xE00, 0xE80),),
    "hangul": ((0x1100, 0x1200), (0x3130, 0x3190), (0xAC00, 0xD7B0)),
    "cjk": ((0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)),
}
#: Least share of a mixed text's characters in sentences of its own language, and the part of its band's
#: characters per token that a sentence needs, which varies more than a text.
MIXED_SHARE, SENTENCE_SLACK = 0.3, 0.8
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, token_entropy double, reason string"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_START = (np.arange(256) & 0xC0) != 0x80
_WORD_START = _START & ~_SPACE
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, exactly, by whole-batch array operations."""
    data, offsets = utf8(texts)
    words, n = words_of(texts)
    out = {"n_words": n, "word_chars": per_row(_WORD_START[data], offsets), "n_symbols": per_row(_SYMBOL[data], offsets)}

    lines = pc.split_pattern(texts, "\n")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    flat = lines.flatten()
    real = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    code, known = numbered(flat.filter(pa.array(real)))
    doc = doc[real]
    seen = pd.unique(doc * max(1, len(known)) + code) // max(1, len(known))
    out["n_dup_lines"] = np.bincount(doc, minlength=len(texts)) - np.bincount(seen, minlength=len(texts))

    code, known = numbered(words)
    doc = np.repeat(np.arange(len(texts)), n)
    covered = np.zeros(len(code), bool)
    if len(code) > 2:
        pair, _ = pd.factorize(code[:-2] * len(known) + code[1:-1])
        window, _ = pd.factorize(pair * len(known) + code[2:])
        inside = doc[:-2] == doc[2:]
        at = np.flatnonzero(inside)
        key, _ = pd.factorize(doc[at] * (len(code) + 1) + window[at])
        at = at[np.bincount(key)[key] > 1] if len(key) else at
        for k in range(3):
            covered[at + k] = True
    edges = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=edges[1:])
    out["n_repeat_words"] = per_row(covered, edges)
    return out


def base_fails(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _encoder(file: bytes):
    """The encoder of a ranks file, and for each id whether its bytes aren't whole characters. By content: a
    worker builds each encoder once."""
    import tiktoken

    key = hashlib.sha256(file).hexdigest()

    def build() -> tuple:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        partial = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                partial[i] = True
        return tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), partial

    return resident("fertility", key, build)


def tokens(encoder, text: str) -> np.ndarray:
    """The ids of the whole text. A long run of white space before a word is one pretoken but for its last
    character, which the word may take; cutting there changes no id."""
    parts, start = [], 0
    for gap in _LONG_GAP.finditer(text):
        if gap.end() < len(text):
            parts += [text[start : gap.start()], text[gap.start() : gap.end() - 1]]
            start = gap.end() - 1
    ids = [np.asarray(encoder.encode_ordinary(p), dtype=np.int64) for p in [*parts, text[start:]]]
    return ids[0] if len(ids) == 1 else np.concatenate(ids)


def measures(encoder, partial: np.ndarray, text: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of tokens that aren't whole characters, entropy in bits."""
    ids = tokens(encoder, text)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1]
    p = counts / len(ids)
    return len(ids), len(text) / len(ids), float(partial[ids].mean()), float(-(p * np.log2(p)).sum())


def script_of(text: str) -> str:
    """latin if half of the letters of the text are Latin, otherwise the script of most of them, or other."""
    letters = Counter(c for c in text if c.isalpha())
    count = {name: sum(n for c, n in letters.items() if any(a <= ord(c) < b for a, b in spans)) for name, spans in SCRIPTS.items()}
    if 2 * count["latin"] >= (total := letters.total()):
        return "latin"
    name = max(count, key=count.get)
    return name if 2 * count[name] >= total else "other"


def mixed(encoder, partial: np.ndarray, band: Band, text: str) -> bool:
    """Whether MIXED_SHARE of the text or more stands in sentences that the band's limits on characters
    per token (less the slack) and byte fallback allow."""
    own = 0
    for sentence in _SENTENCE.findall(text):
        _, chars_per_token, byte_share, _ = measures(encoder, partial, sentence)
        if byte_share <= band.max_byte_share and chars_per_token >= SENTENCE_SLACK * band.min_chars_per_token:
            own += len(sentence)
    return own >= MIXED_SHARE * len(text)


def band_for(bands: dict[str, Band], text: str, lang: str | None, byte_share: float, encoder, partial: np.ndarray) -> Band:
    """The band of the text's language, or that of its script where the language has none; "mixed" for
    a text with more byte fallback than its language allows, of which enough is in its language."""
    band = bands.get(lang) if lang else None
    if band is None:
        return bands.get(script_of(text)) or bands[""]
    if byte_share > band.max_byte_share and "mixed" in bands and mixed(encoder, partial, band, text):
        return bands["mixed"]
    return band


def verdict(band: Band, chars_per_token: float, byte_share: float, entropy: float) -> str:
    """The first measure outside the band, or nothing."""
    if chars_per_token < band.min_chars_per_token:
        return "few characters per token"
    if chars_per_token > band.max_chars_per_token:
        return "many characters per token"
    if byte_share > band.max_byte_share:
        return "byte fallback"
    if entropy < band.min_entropy:
        return "low entropy"
    return ""


def _judged(sent, bands: dict[str, Band], texts: pa.Array, langs: list) -> dict[str, np.ndarray]:
    encoders = {lang: _encoder(bytes(f)) for lang, f in sent.value.items()}
    out = base_counts(texts)
    failed = base_fails(out["n_words"], out["n_repeat_words"])
    rows = []
    for text, lang, n in zip(texts.to_pylist(), langs, out["n_words"].tolist(), strict=True):
        encoder = encoders.get(lang) or encoders[""]
        got = measures(*encoder, text) if n else (0, 0.0, 0.0, 0.0)
        rows.append((*got, verdict(band_for(bands, text, lang, got[2], *encoder), *got[1:])))
    n_tokens, chars, share, entropy, reason = zip(*rows, strict=True)
    reason = [("few words" if n < MIN_WORDS else "repeated windows") if f else r for f, n, r in zip(failed, out["n_words"], reason, strict=True)]
    return out | {"base_failed": failed, "kept": np.array([not r for r in reason], dtype=bool), "n_tokens": n_tokens, "chars_per_token": chars, "byte_share": share, "token_entropy": entropy, "reason": [r or None for r in reason]}


def _sent(spark: SparkSession, tokenizers: str, vocabularies: dict[str, str]):
    """The vocabulary files, of a few hundred kB each, for the workers."""
    files = {}
    for lang, name in vocabularies.items():
        with open(f"{tokenizers}/{name}", "rb") as f:
            files[lang] = f.read()
    return spark.sparkContext.broadcast(files)


def score(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabularies: dict[str, str] = VOCABULARIES, bands: dict[str, Band] = BANDS) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): base counts, fertility measures and verdict.

    Map-only: nothing is shuffled."""
    sent = _sent(docs.sparkSession, tokenizers, vocabularies)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = _judged(sent, bands, pc.fill_null(batch.column("text"), ""), batch.column("lang").to_pylist())
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
            names, types = zip(*(x.split() for x in SCHEMA.split(", ")[1:]), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[c], kinds[k]) for c, k in zip(names, types, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(in_worker("fertility", work), SCHEMA)


def keep(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabularies: dict[str, str] = VOCABULARIES, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The rows of docs that score() keeps, with the columns that they have. The verdict is made beside
    the row, so that no join on an id that may repeat is needed."""
    sent = _sent(docs.sparkSession, tokenizers, vocabularies)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = _judged(sent, bands, pc.fill_null(batch.column("text"), ""), batch.column("lang").to_pylist())
            yield batch.filter(pa.array(out["kept"]))

    return docs.mapInArrow(in_worker("fertility", work), docs.schema)
