from __future__ import annotations

import random

import pytest

from evspark.api import Image
from evspark.sources import container as K
from evspark.sources.turtle import XSD
from evspark.sources.writer import ContainerWriter


def test_image(spark, tmp_path):
    random.seed(5)
    path, data = str(tmp_path / "i.aff4"), random.randbytes(5000)
    w = ContainerWriter(path, chunk_size=512, per_segment=3, codec="zlib")
    stream, _ = w.stream([data])
    name = w.image([(0, 3000, 0, 0), (3000, 1000, 0, 1), (4000, 2000, 3000, 0)], [stream, K.SCHEMA_NS + "SymbolicStreamFF"], 6000)
    w.state(name, "acquired", "true", XSD + "boolean")
    w.state(name, "serial", "QUJD", XSD + "string")
    w.close()
    whole = data[:3000] + b"\xff" * 1000 + data[3000:]
    image = Image(spark, [path])
    assert (image.arn, image.role, image.size) == (name, "DiskImage", 6000)
    for offset, length in ((0, 6000), (2990, 20), (3999, 2), (5990, 100), (6000, 5), (511, 2)):
        assert image.read(offset, length) == whole[offset : offset + length]
    assert image.boolean("acquired") is True and image.binary("serial") == b"ABC" and image.integer("size") == 6000 and image.text("none") is None
    with pytest.raises(ValueError):
        Image(spark, [path], stream)
    with pytest.raises(ValueError):
        image.read(-1, 5)
