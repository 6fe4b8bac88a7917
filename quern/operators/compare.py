"""Comparison of previews with source routines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.source_text import alignment, canonical_body, preview_body, routine_identity, source_routines
from quern.operators.relational import ascii_lower
from quern.operators.symbols import substituted
from quern.sources.places import stored


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source files under a path: object (the file's stem in lower case), path, text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[sS][rR][aAfFmMuUwW]")
    place = F.col("_metadata.file_path")
    stem = F.regexp_replace(F.element_at(F.split(place, "/"), -1), r"\.[^.]*$", "")
    return files.select(ascii_lower(stem).alias("object"), place.alias("path"), F.col("value").alias("text"))


def routines(sources: DataFrame) -> DataFrame:
    """object, position, name, parameter_types, source_reference, body of every routine of (object, path,
    text). A null text has none."""
    kinds = [("object", pa.string()), ("position", pa.int32()), ("name", pa.string()), ("parameter_types", pa.list_(pa.string())), ("source_reference", pa.string()), ("body", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"object": r["object"], "position": i} | x for r in batch.to_pylist() for i, x in enumerate(source_routines(r["text"] or "", r["path"] or ""))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    return sources.select("object", "path", "text").mapInArrow(run, "object string, position int, name string, parameter_types array<string>, source_reference string, body array<string>")


def prepared(previews: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, object, name, parameter_types, complete, body and canonical (comparable statements) of
    previews with entry_name, signature, statements, complete."""
    kinds = [("object", pa.string()), ("name", pa.string()), ("parameter_types", pa.list_(pa.string())), ("complete", pa.bool_()), ("body", pa.list_(pa.string())), ("canonical", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.select(range(len(keys), len(keys) + 4)).to_pylist():
                name, types = routine_identity(r["signature"] or "") or (None, None)
                body = preview_body(r["statements"] or [])
                entry = (r["entry_name"] or "").lower()
                rows.append((entry.rpartition(".")[0] or entry, name, types, r["complete"], body, canonical_body(body)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)]], [*keys, *[n for n, _ in kinds]])

    source = previews.select(*keys, "entry_name", "signature", "statements", "complete")
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{schema}, object string, name string, parameter_types array<string>, complete boolean, body array<string>, canonical array<string>")


def canonical(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the canonical statements of an array column."""

    @F.arrow_udf("array<string>")
    def run(bodies: pa.Array) -> pa.Array:
        return pa.array([canonical_body(b or []) for b in bodies.to_pylist()], pa.list_(pa.string()))

    return rows.withColumn(out, run(F.col(column)))


def compare(previews: DataFrame, known: DataFrame, keys: list[str], order: list[str], constants: DataFrame | None = None) -> DataFrame:
    """`keys`, result, basis, source_reference of each preview, against routines of the same object and name
    whose parameter types are equal or not given. One candidate serves every occurrence; of several the
    n-th serves the n-th (by `order`), and beyond them the match is ambiguous.

    Results: source_file_not_found, source_routine_not_found, ambiguous_source_routine,
    semantic_rules_incomplete, verified (basis normalized_equality, safe_semantic_canonicalization or
    compiled_symbol_equivalence), normalized_body_mismatch.

    With `constants` (owner, name, type_ref, value), what both canonical forms still differ in is compared with
    the names of constants replaced (quern.operators.symbols), by the previews' object_type_name and
    identifiers; equal forms count if anything was replaced. `keys` are then to be unique.
    """
    scope = [] if constants is None else ["object_type_name", "identifiers"]
    mine = prepared(previews, [*keys, *[o for o in order if o not in keys], *scope])
    occurrence = Window.partitionBy("object", "name", "parameter_types").orderBy(*order)
    mine = mine.withColumn("_n", F.row_number().over(occurrence) - 1)
    source = canonical(known, "body", "s_canonical")
    candidates = F.array_sort(F.collect_list(F.struct("position", "parameter_types", "source_reference", "body", "s_canonical")))
    grouped = source.groupBy("object", "name").agg(candidates.alias("_candidates"))
    files = known.select("object").distinct().withColumn("_file", F.lit(True))
    both = mine.join(grouped, ["object", "name"], "left").join(files, "object", "left")
    fit = F.filter("_candidates", lambda c: (c["parameter_types"] == F.col("parameter_types")) | (F.size(c["parameter_types"]) == 0))
    both = both.withColumn("_fit", F.coalesce(fit, F.array().cast(grouped.schema["_candidates"].dataType)))
    chosen = F.when(F.size("_fit") == 1, F.get("_fit", F.lit(0))).otherwise(F.get("_fit", F.col("_n")))
    both = both.withColumn("_c", chosen)
    result = (
        F.when(F.col("_file").isNull(), "source_file_not_found")
        .when(F.size("_fit") == 0, "source_routine_not_found")
        .when(F.col("_c").isNull(), "ambiguous_source_routine")
        .when(~F.col("complete"), "semantic_rules_incomplete")
        .when((F.col("_c.body") == F.col("body")) | (F.col("_c.s_canonical") == F.col("canonical")), "verified")
        .otherwise("normalized_body_mismatch")
    )
    basis = F.when(F.col("_c.body") == F.col("body"), "normalized_equality").otherwise("safe_semantic_canonicalization")
    judged = [result.alias("result"), F.when(result == "verified", basis).alias("basis"), F.col("_c.source_reference").alias("source_reference")]
    if constants is None:
        return both.select(*keys, *judged)
    differing = lambda c: F.when(result == "normalized_body_mismatch", F.col(c))
    found = stored(both.select(*keys, *judged, F.col("object_type_name").alias("owner"), "identifiers", differing("canonical").alias("canonical"), differing("_c.s_canonical").alias("source")), "compared")
    left = found.where("result = 'normalized_body_mismatch'")
    equal = substituted(left, keys, ["canonical", "source"], constants).where((F.col("canonical_symbols") == F.col("source_symbols")) & (F.col("substitutions") > 0))
    joined = found.join(equal.select(*keys, F.lit(True).alias("_equal")), keys, "left")
    return joined.select(*keys, F.when(F.col("_equal"), "verified").otherwise(F.col("result")).alias("result"), F.when(F.col("_equal"), "compiled_symbol_equivalence").otherwise(F.col("basis")).alias("basis"), "source_reference")


_CATCHES = "array<struct<exception_type: string, variable_name: string>>"


_MANIFEST = f"report_version int, functions array<struct<oracle_id: string, entry_name: string, signature: string, source_reference: string, try_catch: array<struct<catches: {_CATCHES}>>, normalized_body_fragments: array<string>>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """position, oracle_id, entry_name, signature, source_reference, try_catch, fragments of the functions that JSON
    manifests (a file each) declare. Positions are the order in the file, files by their names; what a
    function leaves out is empty. A file that is no manifest raises an error when it is read."""
    files = spark.read.schema(_MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).select("functions", F.col("_metadata.file_path").alias("file"))
    rows = files.select("file", F.posexplode("functions").alias("at", "f"))
    fields = F.col("f.try_catch"), F.col("f.normalized_body_fragments")
    empty = [F.array().cast(f"array<struct<catches: {_CATCHES}>>"), F.array().cast("array<string>")]
    return rows.select(F.struct("file", "at").alias("position"), "f.oracle_id", "f.entry_name", "f.signature", "f.source_reference", F.coalesce(fields[0], empty[0]).alias("try_catch"), F.coalesce(fields[1], empty[1]).alias("fragments"))


def construct_evidence(previews: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, oracle_id, status (verified, mismatch), fragments: a row for each structure that a known source declares
    for a preview (entry_name, signature, statements, try_catch) and that was looked at.

    manifest: position, oracle_id, entry_name, signature, try_catch (array of struct catches), fragments; the
    first row by position that has a preview's names, without regard to ASCII case, holds. The structures
    are those declared, in order, each with the same catches in order (types and variables without regard
    to ASCII case), or the first that differs is a mismatch and the rest is not looked at; another number
    of them makes all a mismatch. If all agree, all of the fragments are to be in the normalised text, or all
    are a mismatch; fragments counts those that were compared.
    """
    at = lambda c: ascii_lower(F.col(c))
    wanted = manifest.groupBy(at("entry_name").alias("_e"), at("signature").alias("_s")).agg(F.min(F.struct("position", "oracle_id", "try_catch", "fragments")).alias("_m"))
    found = previews.withColumns({"_e": at("entry_name"), "_s": at("signature")}).join(wanted, ["_e", "_s"])
    plain = lambda structures: F.transform(F.coalesce(structures, F.array().cast(f"array<struct<catches: {_CATCHES}>>")), lambda x: F.transform(x["catches"], lambda c: F.struct(ascii_lower(c["exception_type"]).alias("t"), ascii_lower(c["variable_name"]).alias("v"))))
    structures = F.transform(F.coalesce("try_catch", F.array().cast(f"array<struct<catches: {_CATCHES}>>")), lambda x: F.struct(x["catches"].alias("catches")))
    bare = lambda text: F.regexp_replace(F.lower(text), r'("[^"]*")|\s+', "$1")
    found = found.select(*keys, "_m", plain(structures).alias("_mine"), plain(F.col("_m.try_catch")).alias("_theirs"), bare(F.array_join("statements", "\n")).alias("_text"))
    fragments = F.coalesce("_m.fragments", F.array().cast("array<string>"))
    wrong = F.array_position(F.zip_with("_mine", "_theirs", lambda a, b: a == b), False)
    found = found.withColumns({"_n": F.size("_theirs"), "_same": F.size("_mine") == F.size("_theirs"), "_fragments": fragments})
    found = found.withColumns({"_wrong": F.when(F.col("_same"), wrong), "_held": F.forall("_fragments", lambda f: F.contains(F.col("_text"), bare(f)))})
    last = F.when(F.col("_same") & (F.col("_wrong") > 0), F.col("_wrong").cast("int")).otherwise(F.col("_n"))
    number = F.explode(F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")))
    each = found.withColumn("_k", number)
    agreed = F.col("_same") & (F.col("_wrong") == 0)
    status = F.when(~F.col("_same"), "mismatch").when(agreed, F.when(F.col("_held"), "verified").otherwise("mismatch")).when(F.col("_k") == F.col("_wrong"), "mismatch").otherwise("verified")
    compared = F.when(agreed, F.size("_fragments")).otherwise(0).cast("long")
    return each.select(*keys, F.concat(F.col("_m.oracle_id"), F.lit("#try_catch_"), F.col("_k")).alias("oracle_id"), status.alias("status"), compared.alias("fragments"))


def oracle_constructs(previews: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Previews that a manifest row (entry_name, signature, oracle_id, fragments) names, without regard to
    ASCII case, with whether all of its normalised fragments are in the preview's text. Of several rows for
    a preview, the one with the smallest oracle_id holds."""
    at = lambda c: ascii_lower(F.col(c))
    wanted = manifest.groupBy(at("entry_name").alias("_e"), at("signature").alias("_s")).agg(F.min(F.struct("oracle_id", "fragments")).alias("_m"))
    # White space goes outside strings only.
    bare = lambda text: F.regexp_replace(F.lower(text), r'("[^"]*")|\s+', "$1")
    text = bare(F.array_join("statements", "\n"))
    found = previews.withColumns({"_e": at("entry_name"), "_s": at("signature"), "_t": text}).join(wanted, ["_e", "_s"])
    held = F.forall("_m.fragments", lambda f: F.contains(F.col("_t"), bare(f)))
    return found.select(*keys, F.col("_m.oracle_id").alias("oracle_id"), held.alias("verified"))


def differences(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """`keys`, only_a, only_b, matched of two array columns, by a longest common subsequence."""
    kinds = [("only_a", pa.list_(pa.string())), ("only_b", pa.list_(pa.string())), ("matched", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [alignment(x or [], y or []) for x, y in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)]], [*keys, *[n for n, _ in kinds]])

    source = pairs.select(*keys, a, b)
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{schema}, only_a array<string>, only_b array<string>, matched long")
