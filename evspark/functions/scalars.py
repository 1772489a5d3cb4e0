"""Scalar functions as column expressions, all inside generated code but for those in `raw`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that Windows keeps. Fixed values.
RESERVED = ["CON", "PRN", "AUX", "NUL", "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9", "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9"]
#: Hex digits of each digest. Fixed values.
DIGEST_DIGITS = {"md5": 32, "sha1": 40, "sha256": 64, "sha384": 96, "sha512": 128, "blake2b": 128, "sha3-256": 64, "sha3-384": 96, "sha3-512": 128, "shake128": 64, "shake256": 128, "blake3": 64}

# -- resource names


def name_part(name: Column, part: str) -> Column:
    """scheme, authority, path (with its slash), or range_start and range_length of a name such as
    scheme://authority/path[0x10:32]; null where it has none."""
    pattern = {"scheme": r"^([A-Za-z][A-Za-z0-9+.-]*)://", "authority": r"^[A-Za-z][A-Za-z0-9+.-]*://([^/\[]*)", "path": r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\[]*(/[^\[]*)", "range_start": r"\[(0[xX][0-9A-Fa-f]+|[0-9]+):(?:0[xX][0-9A-Fa-f]+|[0-9]+)\]$", "range_length": r"\[(?:0[xX][0-9A-Fa-f]+|[0-9]+):(0[xX][0-9A-Fa-f]+|[0-9]+)\]$"}[part]
    found = F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return offset(found) if part.startswith("range") else found


def offset(text: Column) -> Column:
    """A hexadecimal (0x) or decimal offset; null for other text, and beyond a long."""
    hexed = F.when(F.length(text) <= 17, F.conv(F.substring(text, 3, 16), 16, 10).cast("decimal(20,0)"))
    plain = F.when(text.rlike("^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    wide = F.when(text.rlike("^0[xX][0-9A-Fa-f]{1,16}$"), hexed).otherwise(plain)
    return F.when(wide <= F.lit("9223372036854775807").cast("decimal(20,0)"), wide.cast("long"))


def local_name(iri: Column) -> Column:
    """What follows the last # or /."""
    return F.regexp_extract(iri, r"[^#/]*$", 0)


def namespace(iri: Column) -> Column:
    return F.left(iri, F.length(iri) - F.length(local_name(iri)))


def has_percent_escape(text: Column) -> Column:
    return text.rlike("%[0-9A-Fa-f]{2}")


def has_lowercase_escape(text: Column) -> Column:
    return text.rlike("%([a-f][0-9A-Fa-f]|[0-9A-F][a-f])")


def guid_case(text: Column) -> Column:
    """lower, upper, mixed or none, for 8-4-4-4-12 hex digits."""
    guid = text.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
    return F.when(~guid, "none").when(text == F.lower(text), "lower").when(text == F.upper(text), "upper").otherwise("mixed")


# -- text forms


def turtle_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tsv_escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strict_base64(text: Column) -> Column:
    """The bytes of standard base 64 with full padding; null for anything else."""
    return F.when(text.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.unbase64(text))


def bytes_about(n: Column) -> Column:
    """A byte count in binary units, one digit after the point, ties to even."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, name in ((1 << 10, "KiB"), (1 << 20, "MiB"), (1 << 30, "GiB"), (1 << 40, "TiB")):
        tenths, rest = _div(n * 10, unit), (n * 10) % unit
        up = F.when((rest * 2 > unit) | ((rest * 2 == unit) & (tenths % 2 == 1)), 1).otherwise(0)
        t = tenths + up
        out = F.when(n >= unit, F.concat(_div(t, 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(f" {name}"))).otherwise(out)
    return out


def bytes_cut(n: Column) -> Column:
    """A byte count in binary units, tenths cut off."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for unit, name in ((1 << 10, "KiB"), (1 << 20, "MiB"), (1 << 30, "GiB")):
        out = F.when(n >= unit, F.concat(_div(n, unit).cast("string"), F.lit("."), _div((n % unit) * 10, unit).cast("string"), F.lit(f" {name}"))).otherwise(out)
    return out


def _div(a: Column, b: int) -> Column:
    """Whole quotient of a count."""
    return ((a - a % b) / b).cast("long")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def utc_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def algorithm_list(text: Column) -> Column:
    """Names separated by commas, in lower case, each once, in the order first named."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def strong_enough(names: Column) -> Column:
    """Whether a list has an algorithm besides MD5 and SHA-1."""
    return F.exists(names, lambda x: ~x.isin("md5", "sha1"))


def digest_length_right(algorithm: Column, hexed: Column) -> Column:
    """Whether a digest has its algorithm's length; null for algorithms without a known one."""
    want = F.element_at(F.create_map(*[F.lit(x) for kv in DIGEST_DIGITS.items() for x in kv]), F.lower(algorithm))
    return F.length(hexed) == want


# -- names of parts


def natural_key(text: Column) -> Column:
    """Sorts as people sort names: runs of digits by value, then by width, all else by character."""
    run = lambda x: F.concat(F.lit("0"), F.lpad(F.regexp_replace(x, "^0+", ""), 40, "0"), F.lpad(F.length(x).cast("string"), 4, "0"))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9])"), 1), lambda x: F.when(x.rlike("^[0-9]"), run(x)).otherwise(x)), "")


def part_number(name: Column, extensions: str = "aff4|af4") -> Column:
    """The place of a file in a numbered set: a number after the container's extension; 0 for a
    container's name without one; else the digits that end the stem, if a separator or nothing stands
    before them; null where there is no number, or one beyond 32 bits."""
    after = F.regexp_extract(name, rf"(?i)\.(?:{extensions})\.([0-9]+)$", 1)
    is_container = name.rlike(rf"(?i)\.(?:{extensions})$")
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
    trailing = F.nullif(F.regexp_extract(stem, r"(?:^|[-_. ])([0-9]+)[^0-9]*$", 1), F.lit(""))
    number = F.when(after != "", after).when(is_container & trailing.isNull(), F.lit("0")).otherwise(trailing)
    value = number.try_cast("long")
    return F.when(value < F.lit(1 << 32), value)


# -- paths for export


def safe_path(path: Column) -> Column:
    """A recorded path as one that any system can hold below a target folder."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda p: ~p.isin("", ".", ".."))

    def safe(p: Column) -> Column:
        p = F.when((F.length(p) == 2) & F.endswith(p, F.lit(":")), F.left(p, F.lit(1))).otherwise(p)
        p = F.regexp_replace(F.regexp_replace(p, r'[<>:"|?*\x00-\x1f]', "_"), r"[ .]+$", "")
        p = F.when(p == "", F.lit("_")).otherwise(p)
        return F.when(F.upper(F.regexp_extract(p, r"^[^.]*", 0)).isin(*RESERVED), F.concat(p, F.lit("_"))).otherwise(p)

    out = F.array_join(F.transform(parts, safe), "/")
    return F.when(out == "", F.lit("_")).otherwise(out)


# -- pairs of display and raw names


def name_pair_rule(display: Column, raw: Column) -> Column:
    """The rule that a display name and its raw form (base 64, or null) break, or null."""
    needs = display.rlike(r"[\x00-\x1f\x7f]") | has_percent_escape(display)
    data = strict_base64(raw)
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    clean = text.isNotNull() & ~text.rlike(r"[\x00-\x1f%\x7f]")
    return (
        F.when(raw.isNull() & needs, "MissingRawName")
        .when(raw.isNull(), None)
        .when(data.isNull(), "MalformedRawName")
        .when(clean & (text == display), "RedundantRawName")
        .when(clean, "ContradictoryRawName")
        .when(has_lowercase_escape(display), "LowercaseNameEscape")
    )
