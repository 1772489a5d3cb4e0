"""Functions on bytes that column expressions can't tell: Arrow-batched UDFs."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Characters that a resource name's first part may not hold in a member's name. Fixed values.
FORBIDDEN = set('<>"{}|\\^`')


def escape_component_text(text: str) -> str:
    """Percent escapes, in upper-case hex of UTF-8 bytes, for controls, forbidden characters, : / and %."""
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if ord(c) < 32 or 127 <= ord(c) < 160 or c in FORBIDDEN or c in ":/%" else c for c in text)


def unescape_text(text: str) -> str:
    """Percent escapes undone on bytes; a bad escape stands as it is, bad UTF-8 is replaced."""
    data, out, i = text.encode(), bytearray(), 0
    while i < len(data):
        pair = data[i + 1 : i + 3]
        if data[i] == 0x25 and len(pair) == 2 and all(c in b"0123456789abcdefABCDEF" for c in pair):
            out.append(int(pair, 16))
            i += 3
        else:
            out.append(data[i])
            i += 1
    return out.decode("utf-8", "replace")


def needs_raw(data: bytes) -> bool:
    """Whether a name needs its raw form: bad UTF-8, a control character or a percent sign."""
    try:
        data.decode()
    except UnicodeDecodeError:
        return True
    return any(b <= 0x1F or b in (0x25, 0x7F) for b in data)


def display_text(data: bytes) -> str:
    """A name as it is if it needs no raw form, else with each byte outside 0x20-0x7e, and %, escaped."""
    if not needs_raw(data):
        return data.decode()
    return "".join(f"%{b:02X}" if b <= 0x1F or b == 0x25 or b >= 0x7F else chr(b) for b in data)


@F.pandas_udf(StringType())
def escape_component(s: pd.Series) -> pd.Series:
    return s.map(escape_component_text, na_action="ignore")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(unescape_text, na_action="ignore")


@F.pandas_udf(StringType())
def display_form(s: pd.Series) -> pd.Series:
    return s.map(lambda b: display_text(bytes(b)), na_action="ignore")


def digest_udf(algorithm: str):
    """Hex digest of binary values by a hashlib algorithm."""
    length = {"shake_128": (32,), "shake_256": (64,)}.get(algorithm, ())

    @F.pandas_udf(StringType())
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda b: hashlib.new(algorithm, bytes(b)).hexdigest(*length), na_action="ignore")

    return digest


# -- codecs of chunks

CODECS = ("stored", "snappy", "zlib", "lz4")


def encode_chunk(codec: str, data: bytes, chunk_size: int) -> bytes:
    """A chunk as it is stored: compressed only if that saves 16 bytes or more."""
    if codec == "zlib":
        out = zlib.compress(data)
    elif codec == "snappy":
        out = pa.Codec("snappy").compress(data, asbytes=True)
    elif codec == "lz4":
        out = pa.Codec("lz4_raw").compress(data, asbytes=True)
    else:
        return data
    return out if len(out) < chunk_size - 16 else data


def decode_chunk(codec: str, data: bytes, chunk_size: int) -> bytes:
    """A chunk's bytes. One of chunk_size bytes is stored as it is."""
    if chunk_size > 64 << 20:
        raise ValueError("a chunk size beyond 64 MiB is refused")
    if codec == "stored" or len(data) == chunk_size:
        return data
    if codec == "zlib":
        d = zlib.decompressobj()
        out = d.decompress(data, chunk_size + 1)
    elif codec == "snappy":
        size, shift = 0, 0
        for b in data[:5]:  # the block's own length, seven bits a byte
            size |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                break
        if size > chunk_size:
            raise ValueError("a chunk is larger than the chunk size")
        out = pa.Codec("snappy").decompress(data, size, asbytes=True)
    elif codec == "lz4":
        out = _lz4_block(data, chunk_size)
    else:
        raise ValueError(f"codec {codec} isn't supported")
    if not out or len(out) > chunk_size:
        raise ValueError("a chunk is empty or larger than the chunk size")
    return out


def _lz4_block(data: bytes, most: int) -> bytes:
    """A raw LZ4 block, whose length nothing states: it is summed over the block's sequences, and the codec does the rest."""
    size, i, end = 0, 0, len(data)

    def more(n: int, i: int) -> tuple[int, int]:
        while n >= 15:
            n, i = n + data[i], i + 1
            if data[i - 1] != 255:
                break
        return n, i

    while i < end:
        token = data[i]
        literals, i = more(token >> 4, i + 1)
        size, i = size + literals, i + literals
        if i >= end:
            break
        matched, i = more(token & 15, i + 2)
        size += matched + 4
    if size > most:
        raise ValueError("a chunk is larger than the chunk size")
    return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)


def decode_udf(codec: str, chunk_size: int):
    """Decoded chunks; null for what can't be decoded, which is a finding, not a failure."""

    @F.pandas_udf(BinaryType())
    def decode(s: pd.Series) -> pd.Series:
        def one(b):
            try:
                return decode_chunk(codec, bytes(b), chunk_size)
            except (ValueError, OSError, IndexError, zlib.error):
                return None

        return s.map(one, na_action="ignore")

    return decode
