"""Which version's rules hold for a file: by what the caller says, what the file says, or what its code looks like.

Everything is an expression over columns, so that a table of files picks its versions in one pass. A version
is a struct (major, minor), which orders as versions do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The versions that rules exist for, how a caller may spell them, and where a runtime's version
# belongs (the last row whose start it reaches; none between 8 and 8.x, 13 and 16, or below 6).
VERSIONS = [(6, 0), (7, 0), (9, 0), (10, 0), (11, 0), (12, 0), (12, 5), (17, 0), (19, 0), (22, 0)]
SPELLINGS = {
    "6": (6, 0), "6.0": (6, 0), "7": (7, 0), "7.0": (7, 0), "9": (9, 0), "9.0": (9, 0), "10": (10, 0), "10.0": (10, 0), "11": (11, 0), "11.0": (11, 0),
    "12": (12, 0), "12.0": (12, 0), "12.5": (12, 5), "2017": (17, 0), "17": (17, 0), "17.0": (17, 0), "2019": (19, 0), "19": (19, 0), "19.0": (19, 0),
    "2022": (22, 0), "22": (22, 0), "22.0": (22, 0), "22.1": (22, 0),
}
RUNTIMES = [((6, 0), (6, 0)), ((7, 0), (7, 0)), ((8, 0), None), ((9, 0), (9, 0)), ((10, 0), (10, 0)), ((11, 0), (11, 0)), ((12, 0), (12, 0)), ((12, 5), (12, 5)), ((13, 0), None), ((17, 0), (17, 0)), ((19, 0), (19, 0)), ((22, 0), (22, 0))]
DEFAULT = (12, 0)
#: Envelopes of compiled objects of version 22, as their first two bytes in hexadecimal.
ENVELOPES = ("5201", "5301")
SNIFFED = 1024

_TYPE = "struct<major: int, minor: int>"


def version(major: int, minor: int) -> Column:
    return F.struct(F.lit(major).alias("major"), F.lit(minor).alias("minor"))


def _none() -> Column:
    return F.lit(None).cast(_TYPE)


def spelled_version(text: Column) -> Column:
    """The version that a caller's spelling names, else null."""
    out = _none()
    for spelling, found in SPELLINGS.items():
        out = F.when(text == spelling, version(*found)).otherwise(out)
    return out


def _number(part: Column) -> Column:
    """A part of a dotted version as an unsigned 16-bit number, else null."""
    value = F.when(part.rlike(r"^\+?[0-9]+$"), F.regexp_replace(part, r"^\+", "").try_cast("long"))
    return F.when(value < 1 << 16, value).cast("int")


def runtime_version(text: Column) -> Column:
    """The version whose rules a runtime of this dotted version takes, else null."""
    parts = F.split(text, r"\.", -1)
    own = F.struct(_number(F.get(parts, F.lit(0))).alias("major"), F.coalesce(_number(F.get(parts, F.lit(1))), F.lit(0)).alias("minor"))
    out = _none()
    for start, found in RUNTIMES:
        out = F.when(own >= version(*start), version(*found) if found else _none()).otherwise(out)
    return F.when(own["major"].isNotNull(), out)


def payload_version(content: Column) -> Column:
    """22.0 for bytes that begin with an envelope of its compiled objects, else null."""
    return F.when(F.hex(F.substring(content, 1, 2)).isin(*ENVELOPES), version(22, 0))


def code_version(content: Column) -> Column:
    """12.0 where the first kilobyte has a word of 0x100 to 0x246 at an even place, else 6.0; null for less
    than a word."""
    wide = F.hex(F.substring(content, 1, SNIFFED)).rlike("^(?:[0-9A-F]{4})*?(?:[0-9A-F]{2}01|(?:[0-3][0-9A-F]|4[0-6])02)")
    return F.when(F.octet_length(content) >= 2, F.when(wide, version(12, 0)).otherwise(version(6, 0)))


def library_version(header: Column) -> Column:
    """The version in a library's first bytes: 12.5 for block-structured ones, the tenths in the fifth byte
    for older ones; null for others."""
    tenths = F.conv(F.hex(F.substring(header, 5, 1)), 16, 10).cast("int")
    older = F.struct(F.floor(tenths / 10).cast("int").alias("major"), (tenths % 10).alias("minor"))
    start = F.hex(F.substring(header, 1, 4))
    return F.when(start == "4844522A", version(12, 5)).when(start.startswith("50424C") & tenths.isNotNull(), older)


def select_version(files: DataFrame, explicit: str = "explicit", runtime: str = "runtime", content: str = "content") -> DataFrame:
    """files with version and basis: the caller's spelling (explicit), else the runtime's version (runtime), else
    the content's envelope (payload), else its code (code), else the default. A spelling that is none
    gives no version, and the basis `unsupported`."""
    asked = F.col(explicit).isNotNull()
    ways = [("runtime", runtime_version(F.col(runtime))), ("payload", payload_version(F.col(content))), ("code", code_version(F.col(content))), ("default", version(*DEFAULT))]
    # Each way is computed once, under a name of its own.
    named = files.withColumns({"_explicit": spelled_version(F.col(explicit))} | {f"_{name}": found for name, found in ways})
    chosen = F.when(asked, F.col("_explicit")).otherwise(F.coalesce(*[F.col(f"_{name}") for name, _ in ways]))
    basis = F.when(asked, F.when(F.col("_explicit").isNull(), "unsupported").otherwise("explicit"))
    for name, _ in ways:
        basis = basis.when(F.col(f"_{name}").isNotNull(), name)
    return named.select(*files.columns, chosen.alias("version"), basis.alias("basis"))


def decoder_version(own: Column) -> Column:
    """The version whose decoder reads a version's code: that of 6.0 up to 9, else its own; null for versions
    without rules."""
    out = _none()
    for major, minor in VERSIONS:
        out = F.when(own == version(major, minor), version(6, 0) if major < 10 else version(major, minor)).otherwise(out)
    return out


def features(own: Column) -> Column:
    """struct(has_unicode, has_dotnet, has_generics, opcode_set, max_string_length) of a version."""
    major = own["major"]
    sets = F.when(major >= 12, "DotNet").when(major >= 10, "Extended").otherwise("Classic")
    return F.struct((major >= 10).alias("has_unicode"), (major >= 12).alias("has_dotnet"), (major >= 17).alias("has_generics"), sets.alias("opcode_set"), F.when(major >= 10, 32767).otherwise(16383).alias("max_string_length"))


def spelled(own: Column) -> Column:
    """major.minor as text."""
    return F.concat_ws(".", own["major"], own["minor"])
