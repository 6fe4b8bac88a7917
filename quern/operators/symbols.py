"""Names of compiled constants in statements, replaced by their literals where they are unique.

Statements are cut to tokens by one pattern, so that joining a statement's tokens gives it back. What a name
means is looked up for the distinct names of a body, not for every place: qualifiers by the body's
identifiers, bare names by its owner and then the globals, each in a table of the constants that are unique
both by name and by value. A body's literals are gathered to one row and put in the tokens' places as one pass over
its statements; no token is a row but for the distinct names that are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.relational import ascii_lower
from quern.sources.places import stored

#: A string (an open one runs to the end, ~ escapes), a dotted identifier, or anything else up to one of these.
TOKEN = r"""'(?:~[\s\S]|[^'~])*+(?:'|~?\z)|"(?:~[\s\S]|[^"~])*+(?:"|~?\z)|[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*|[^A-Za-z_'"]+"""
_token = re.compile(TOKEN.replace(r"\z", r"\Z"))
#: Literals that are sent to every task at most; more are joined by shuffles.
SENT = 100_000
IDENTIFIERS = "array<struct<name: string, type_name: string, shadows: boolean, rank: int>>"


def tokens(statement: Column) -> Column:
    return F.regexp_extract_all(statement, F.lit(TOKEN), F.lit(0))


def names_of(statements: Iterable[str | None], wanted: set[str] | None = None) -> list[str]:
    """The distinct names in statements; of `wanted` ones, in lower case and without qualifiers, only these."""
    found: set[str] = set()
    for s in statements:
        found.update(_token.findall(s or ""))
    return [t for t in found if (t[0] == "_" or (t[0].isascii() and t[0].isalpha())) and (wanted is None or t.rpartition(".")[2].lower() in wanted)]


def literal(value: Column) -> Column:
    """A constant's value (struct kind, i, s) as it stands in source; null for characters, unresolved values, and
    strings with quotes, ~ or control characters."""
    plain = ~value["s"].rlike(r"[\x00-\x1f\x7f-\x9f~'\"]")
    return (
        F.when(value["kind"].isin("signed", "unsigned"), value["i"].cast("string"))
        .when(value["kind"] == "boolean", F.when(value["i"] != 0, "true").otherwise("false"))
        .when((value["kind"] == "string") & plain, F.concat(F.lit('"'), F.lower(value["s"]), F.lit('"')))
    )


def unique_literals(constants: DataFrame) -> DataFrame:
    """owner, name (both in ASCII lower case) and literal of the constants (owner, name, type_ref, value) that no
    other one shares the owner and name with, nor the owner, type and value. Rows that are equal in all of
    these are one constant; a null owner is the global one."""
    one = stored(constants.select(F.coalesce("owner", F.lit("")).alias("owner"), "name", "type_ref", "value").distinct().withColumns({"owner": ascii_lower(F.col("owner")), "name": ascii_lower(F.col("name"))}), "constants")
    by_name = one.groupBy("owner", "name").agg(F.count("*").alias("n"), F.first("type_ref").alias("type_ref"), F.first("value").alias("value")).where("n = 1").drop("n")
    by_value = one.groupBy("owner", "type_ref", "value").agg(F.count("*").alias("n")).where("n = 1").drop("n")
    # Null types and values are equal to each other here.
    same = (F.col("a.owner") == F.col("b.owner")) & F.col("a.type_ref").eqNullSafe(F.col("b.type_ref")) & F.col("a.value").eqNullSafe(F.col("b.value"))
    return by_name.alias("a").join(by_value.alias("b"), same, "left_semi").select("owner", "name", literal(F.col("value")).alias("literal"))


def substituted(bodies: DataFrame, keys: list[str], columns: list[str], constants: DataFrame, identifiers: str = "identifiers", owner: str = "owner") -> DataFrame:
    """bodies (one row for each of `keys`) with the array columns of statements rewritten, as <column>_symbols, and
    the number of replacements in all of them, as substitutions.

    `owner` is the type that bare names belong to, `identifiers` an array of what names mean in the body
    (IDENTIFIERS; of equal names the highest rank holds, and any that shadows hides the bare constant). A
    name before `(` is a call and stays. A qualified name belongs to its qualifier's type, or to the owner
    of constants that all before the last dot names.
    """
    # Names are compared in lower case; a token is ASCII.
    known = F.transform(F.coalesce(F.col(identifiers), F.array().cast(IDENTIFIERS)), lambda v: v.withField("name", ascii_lower(v["name"])))
    literals = stored(unique_literals(constants).select(F.col("owner").alias("_of"), F.col("name").alias("_name"), "literal"), "literals")
    wanted = None
    if literals.count() <= SENT:
        # Most names are no constant's: they end where they are read.
        literals, wanted = F.broadcast(literals), {r[0] for r in literals.select("_name").distinct().limit(SENT).collect()}
    names = F.udf(lambda *bodies: names_of((s for body in bodies for s in body or []), wanted), "array<string>", useArrow=False)
    named = bodies.select(*keys, ascii_lower(F.coalesce(F.col(owner), F.lit(""))).alias("_owner"), known.alias("_known"), F.explode(names(*columns)).alias("_token"))
    named = named.withColumn("_name", F.lower(F.substring_index("_token", ".", -1)))
    cut = F.length("_token") - F.length("_name") - 1
    before = F.when(cut > 0, F.lower(F.left(F.col("_token"), cut)))
    named = named.withColumns({"_before": before, "_qualifier": F.substring_index(before, ".", -1)})
    meant = F.filter("_known", lambda v: v["name"] == F.coalesce(F.col("_qualifier"), F.col("_name")))
    best = F.array_max(F.transform(meant, lambda v: F.struct(v["rank"].alias("rank"), v["type_name"].alias("type_name"))))["type_name"]
    named = named.withColumns({"_type": F.when(F.col("_qualifier").isNotNull(), best), "_hidden": F.col("_qualifier").isNull() & F.exists(meant, lambda v: v["shadows"])}).where("NOT _hidden")
    # Owners that a name may belong to, the first that has it holds: a bare name's own, then the global one.
    owners = F.when(F.col("_qualifier").isNull(), F.array("_owner", F.lit(""))).otherwise(F.array(ascii_lower(F.coalesce("_type", "_before"))))
    asked = named.select(*keys, "_token", "_name", F.posexplode(owners).alias("_place", "_of"))
    found = asked.join(literals, ["_of", "_name"]).groupBy(*keys).agg(F.collect_list(F.struct("_token", "_place", "literal")).alias("_found"))
    out = bodies.join(found, keys, "left")
    put = F.udf(lambda statements, found: None if statements is None else rewritten(statements, found), "statements array<string>, n long", useArrow=False)
    for column in columns:
        out = out.withColumn(f"_{column}", put(F.when(F.col("_found").isNotNull(), F.col(column)), "_found"))
    count = sum((F.coalesce(f"_{c}.n", F.lit(0)) for c in columns), F.lit(0))
    return out.select(*bodies.columns, *[F.coalesce(f"_{c}.statements", c).alias(f"{c}_symbols") for c in columns], count.cast("int").alias("substitutions"))


def rewritten(statements: list[str | None], found: list) -> tuple[list[str | None], int]:
    """The statements with literals in place of names, and how many. `found` has (token, place, literal): of a token's
    the first place holds; a constant that is unique but has no literal hides the global one of its name."""
    first: dict[str, tuple[int, str | None]] = {}
    for token, place, text in found:
        if token not in first or place < first[token][0]:
            first[token] = place, text
    literals = {token: text for token, (_, text) in first.items() if text is not None}
    out, n = [], 0
    for statement in statements:
        if statement and literals:
            ts = _token.findall(statement)
            for i in [i for i, t in enumerate(ts) if t in literals]:
                if i + 1 == len(ts) or ts[i + 1][0] != "(":
                    ts[i] = literals[ts[i]]
                    n += 1
            statement = "".join(ts)
        out.append(statement)
    return out, n
