"""The opcode table as a dimension with validity ranges, joined as of a version.

The table itself (some 600 rows: opcode, mnemonic, words_old, words, hint, rule) is a parameter, read from
Parquet or from a Markdown table. `dimension` spreads it over the ranges of versions that differ. An opcode
has 16 bits and there are four ranges, so that the dimension has 262,144 rows at most: it is always
broadcast, and code is never shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# From which major version on, up to which opcode, and which column has the operand words (up to
# and beyond the opcode that version 22 begins at).
LAST_COMMON = 0x246
RANGES = [(0, 7, 0xFF, "words_old"), (7, 11, LAST_COMMON, "words_old"), (11, 22, LAST_COMMON, "words"), (22, None, 0x266, "words")]

COLUMNS = "opcode int, mnemonic string, words_old int, words int, hint string, rule string"


def read_opcodes(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS of a Parquet table, or of the rows of a Markdown table whose first cell is an opcode in
    hexadecimal: opcode, mnemonic, words before version 11, words from it on, hint, rule. Empty cells are null;
    a rule UNRESOLVED is none."""
    if not path.endswith((".md", ".txt")):
        return spark.read.schema(COLUMNS).parquet(path)
    cells = F.transform(F.split("value", r"\|"), lambda c: F.nullif(F.trim(c), F.lit("")))
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\| *0x[0-9A-Fa-f]{4} *\|")).select(cells.alias("c"))
    number = lambda k: F.regexp_extract(F.get("c", F.lit(k)), "[0-9]+", 0).try_cast("int")
    return rows.select(
        F.conv(F.substring(F.get("c", F.lit(1)), 3, 4), 16, 10).cast("int").alias("opcode"), F.get("c", F.lit(2)).alias("mnemonic"), number(3).alias("words_old"), number(4).alias("words"),
        F.get("c", F.lit(5)).alias("hint"), F.nullif(F.get("c", F.lit(6)), F.lit("UNRESOLVED")).alias("rule"),
    )


def dimension(table: DataFrame) -> DataFrame:
    """opcode, mnemonic, hint, rule, words, major_from, major_to (null: open): a row for each opcode and range of
    versions that has it. Beyond the old range, the words are those of the old column. Of rows with equal
    opcodes the smallest holds."""
    ranges = F.explode(F.array(*[F.struct(F.lit(a).alias("major_from"), F.lit(z).cast("int").alias("major_to"), F.lit(last).alias("last"), F.lit(words == "words").alias("new")) for a, z, last, words in RANGES]))
    one = table.groupBy("opcode").agg(F.min(F.struct("mnemonic", "words_old", "words", "hint", "rule")).alias("o")).select("opcode", "o.*")
    spread = one.select("*", ranges.alias("r")).where(F.col("opcode").between(0, F.col("r.last")))
    words = F.when(F.col("r.new") & (F.col("opcode") <= LAST_COMMON), F.coalesce("words", "words_old")).otherwise(F.col("words_old"))
    return spread.select("opcode", "mnemonic", "hint", "rule", words.alias("words"), "r.major_from", "r.major_to")


def of_version(dim: DataFrame, major: int) -> DataFrame:
    """The opcodes of one version."""
    return dim.where((F.col("major_from") <= major) & (F.col("major_to").isNull() | (F.col("major_to") > major))).drop("major_from", "major_to")


def as_of(rows: DataFrame, dim: DataFrame, opcode: str = "opcode", major: str = "major") -> DataFrame:
    """rows with mnemonic, hint, rule and words of their opcode as of their version; null where that version has
    no such opcode. Rows have no columns of these names."""
    ranged = F.broadcast(dim.select(F.col("opcode").alias("_opcode"), "mnemonic", "hint", "rule", "words", "major_from", "major_to"))
    held = (F.col(opcode) == F.col("_opcode")) & (F.col(major) >= F.col("major_from")) & (F.col("major_to").isNull() | (F.col(major) < F.col("major_to")))
    return rows.join(ranged, held, "left").drop("_opcode", "major_from", "major_to")


def immediate(operands: Column, hint: Column, major: Column) -> Column:
    """struct(kind, value) of an instruction's operand words by its hint: a signed word for the named hints,
    whether a byte is set for byte_value; without a hint a signed number of one, two or (from version 10
    on) four words, and the first byte of others. Null without operands. Words are 0 to 65535."""
    word = lambda k: F.get(operands, F.lit(k)).cast("long")
    n = F.size(operands)
    one = word(0) - F.when(word(0) >= 1 << 15, 1 << 16).otherwise(0)
    two = word(0) + F.shiftleft(word(1), 16) - F.when(word(1) >= 1 << 15, F.lit(1 << 32)).otherwise(0)
    four = word(0).bitwiseOR(F.shiftleft(word(1), 16)).bitwiseOR(F.shiftleft(word(2), 32)).bitwiseOR(F.shiftleft(word(3), 48))
    byte = word(0).bitwiseAND(F.lit(255))
    kind = F.when(hint == "byte_value", "bool").when(hint.isin("int16", "var_index", "field_index", "string_index", "relative_offset"), "i32").when((n == 4) & (major >= 10), "i64").otherwise("i32")
    value = F.when(hint == "byte_value", (byte != 0).cast("long")).when(hint.isin("int16", "var_index", "field_index", "string_index", "relative_offset"), one)
    value = value.when(n == 1, one).when(n == 2, two).when((n == 4) & (major >= 10), four).otherwise(byte)
    return F.when(n > 0, F.struct(kind.alias("kind"), value.alias("value")))


def assemble(instructions: DataFrame, keys: list[str], order: list[str], name: str = "pcode") -> DataFrame:
    """`keys` and a binary column: the instructions (opcode, operands array<int>) of each region in order, as code of
    little-endian words. A region, which is a function's code, is put together in one task."""
    word = lambda w: F.concat(F.lpad(F.hex(w.bitwiseAND(F.lit(255))), 2, "0"), F.lpad(F.hex(F.shiftright(w, 8).bitwiseAND(F.lit(255))), 2, "0"))
    code = F.array_join(F.transform(F.concat(F.array(F.col("opcode").cast("int")), F.coalesce("operands", F.array().cast("array<int>"))), word), "")
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col("_code"))))
    return instructions.withColumn("_code", code).groupBy(*keys).agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["_code"]), "")).alias(name))
