"""A handle on the image of a set of containers: open, size, read, properties."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evspark.functions import scalars as S
from evspark.plans import containers as P

#: Roles that a handle may open, the first that there is being taken. Fixed values.
OPENABLE = ("DiskImage", "DiscontiguousImage", "ContiguousImage")
#: Bytes that one read may ask for; longer ranges are DataFrames of P.read_image().
MOST_READ = 256 << 20


class UnknownRegion(ValueError):
    """A read that begins where the image's content isn't known."""


class Image:
    """The one image of the most specific role, or the one named."""

    def __init__(self, spark: SparkSession, paths: list[str], arn: str | None = None):
        self.spark, self.paths = spark, paths
        rows = P.info(spark, paths).filter(F.col("subject") == arn if arn else F.col("role").isin(*OPENABLE)).collect()
        for role in OPENABLE:
            found = {r["subject"]: r for r in rows if r["role"] == role}
            if len(found) > 1:
                raise ValueError(f"several images are a {role}: {sorted(found)}")
            if found:
                break
        else:
            raise ValueError("no image to open")
        row = next(iter(found.values()))
        self.arn, self.role, self.size = row["subject"], row["role"], row["size"]
        self._properties = {p["name"]: p["value"] for p in reversed(row["properties"])}
        self.map = self._properties.get("dataStream", self.arn)

    def read(self, offset: int, length: int, unknown: str = "fill") -> bytes:
        """The bytes of [offset, offset + length), fewer at the end of the image. Of regions whose content is unknown
        "fill" gives the placeholder; "report" stops before one, and raises UnknownRegion at the start of one."""
        stop = min(offset + length, self.size)
        if offset < 0 or length < 0 or length > MOST_READ:
            raise ValueError(f"{length} bytes at {offset}")
        if stop <= offset:
            return b""
        rows = P.read_image(self.spark, self.paths, self.map, offset, stop).orderBy("at").collect()
        out, at = [], offset
        for r in rows:
            if unknown == "report" and r["kind"] == "unknown":
                if at == offset:
                    raise UnknownRegion(f"{r['length']} bytes at {at} are unknown")
                return b"".join(out)
            if r["at"] != at or r["data"] is None:
                raise ValueError(f"no bytes at {at}")
            out.append(bytes(r["data"]))
            at += len(out[-1])
        if at != stop:
            raise ValueError(f"no bytes at {at}")
        return b"".join(out)

    def text(self, name: str) -> str | None:
        """A property by its name or IRI; the first one stated."""
        return str(self.size) if name == "size" else self._properties.get(name.rsplit("#", 1)[-1].rsplit("/", 1)[-1])

    def integer(self, name: str) -> int | None:
        value = self.text(name)
        return int(value) if value is not None and value.lstrip("+-").isdigit() else None

    def boolean(self, name: str) -> bool | None:
        return {"true": True, "1": True, "false": False, "0": False}.get((self.text(name) or "").lower())

    def binary(self, name: str, most: int = 10 << 20) -> bytes | None:
        """A property in strict base 64, of so many bytes at most."""
        value = self.text(name)
        if value is None:
            return None
        row = self.spark.createDataFrame([(value,)], "v string").select(S.strict_base64(F.col("v")).alias("b")).head()
        return None if row["b"] is None or len(row["b"]) > most else bytes(row["b"])
