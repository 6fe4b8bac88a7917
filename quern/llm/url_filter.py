"""URL filters by a cascade of Bloom filters, exact over the corpus's own keys.

A rule is ``host`` + ``path prefix`` (``example.org/es/``). It fits its host and every
subdomain of it when the URL's path starts with the rule's path; of the rules that fit, the
longest wins (of equally long ones, that with the longer host).

The listed keys of one verdict are held in level 1 of a cascade, the keys of the corpus that
level 1 takes by mistake in level 2, the listed keys that level 2 takes in level 3, and so on
until no mistake is left. Level 1 is sized from the number of keys in the corpus, so that its
mistakes are about as many as the listed keys: the whole cascade stays in proportion to the
list, whatever the corpus's size, and lookups are bit tests in a literal. No key outside the
corpus is ever looked up, so membership is exact, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import fresh, stored

#: Listed keys that one cascade holds: at 2.2 bytes a key and level, under 32 MB. Longer lists are dealt to several
#: cascades by a hash of the key.
MAX_LISTED = 4_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """`host` in lower case without a leading dot, `path` empty or with its first slash."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: bytes
    n_bits: int
    n_hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        """Whether all of the key's bits are set."""
        bits = F.lit(bytearray(self.bits))

        def one(j: int) -> Column:
            at = F.pmod(F.xxhash64(key, F.lit(self.seed + j)), F.lit(self.n_bits))
            byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (at % 8).cast("int")) == 1

        test = one(0)
        for j in range(1, self.n_hashes):
            test = test & one(j)
        return test


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first ``://`` to ``/``, ``?``, ``#`` or the end with A-Z in
    lower case, path from there to ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    pattern = r"://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(whole, pattern, 1), _UPPER, _LOWER), F.regexp_extract(whole, pattern, 2)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule key that could fit, longest first: each host suffix at a label's start with the
    path's prefix of each length that some rule has."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    pairs = F.flatten(
        F.transform(
            hosts,
            lambda h: F.transform(cut, lambda n: F.struct((-(F.length(h) + n)).alias("l"), (-F.length(h)).alias("h"), F.concat(h, F.substring(path, F.lit(1), n)).alias("key"))),
        )
    )
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def pack_bits(size: int, places: list[int], values: list[int]) -> bytes:
    bits = bytearray(size)
    for place, value in zip(places, values, strict=True):
        bits[place] = value
    return bytes(bits)


def _level(keys: DataFrame, count: int, share: float, seed: int) -> Level:
    """A Bloom filter of `count` keys that takes about `share` of other keys. Its bits come to the
    driver by bytes, n_bits / 8 rows at most."""
    n_hashes = max(1, round(math.log2(1 / share)))
    n_bits = max(64, 8 * math.ceil(1.45 * count * n_hashes / 8))
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.col("key"), F.lit(seed + j)), F.lit(n_bits)) for j in range(n_hashes)]))
    rows = keys.select(at.alias("at")).groupBy((F.col("at") / 8).cast("int").alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))).alias("bits")).toArrow()
    bits = pack_bits(n_bits // 8, rows.column(0).to_pylist(), rows.column(1).to_pylist())
    return Level(bits, n_bits, n_hashes, seed)


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys it was built over."""

    levels: tuple[Level, ...]

    def has(self, key: Column) -> Column:
        inside: Column = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            inside = F.when(level.has(key), inside).otherwise(F.lit(i % 2 == 1))
        return inside


@dataclass(frozen=True)
class Cascades:
    """A list's keys, dealt to cascades by a hash."""

    parts: tuple[Cascade, ...]

    def has(self, key: Column) -> Column:
        if len(self.parts) == 1:
            return self.parts[0].has(key)
        part, inside = part_of(key, len(self.parts)), F.lit(False)
        for i, own in enumerate(self.parts):
            inside = F.when(part == i, own.has(key)).otherwise(inside)
        return inside


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def build_cascades(listed: DataFrame, universe: DataFrame, n_universe: int, most: int = MAX_LISTED) -> Cascades:
    """Cascades of `most` listed keys each, about, otherwise as build_cascade."""
    parts = max(1, -(-listed.count() // most))
    if parts == 1:
        return Cascades((build_cascade(listed, universe, n_universe),))
    return Cascades(tuple(build_cascade(listed.where(part_of(F.col("key"), parts) == i), universe.where(part_of(F.col("key"), parts) == i), n_universe // parts + 1) for i in range(parts)))


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> Cascade:
    """Cascade of the distinct ``key`` in `listed`, exact over `universe` (column ``key``; rows may
    repeat, listed keys may be among them). An empty list gives no level: nothing is a member. Null keys are
    left out on both sides."""
    listed = listed.where(F.col("key").isNotNull()).select("key").distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    levels = [_level(listed, n, min(0.5, n / max(n_universe, 1)), 1000)]
    passed = universe.where(F.col("key").isNotNull() & levels[0].has(F.col("key"))).select("key").distinct()
    tested, encoded = listed, stored(passed.join(listed, "key", "left_anti"), "bloom")
    while count := encoded.count():
        levels.append(_level(encoded, count, 0.5, 1000 * (len(levels) + 1)))
        tested, encoded = encoded, stored(tested.where(levels[-1].has(F.col("key"))), "bloom")
    return Cascade(tuple(levels))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per row of `pages`: the `keep` columns, host, path, rule (null if none fits), verdict
    (the rule's, else `default`).

    Null URLs and URLs without ``://`` have an empty host and path and fit no rule with a path or
    host. Rows that repeat are judged each; other columns are not read. Two rules of one key and
    unlike verdicts raise ValueError. No rules: all rows get `default`.
    """
    verdicts: dict[str, str] = {}
    for rule in rules:
        if verdicts.setdefault(rule.key, rule.verdict) != rule.verdict:
            raise ValueError(f"two verdicts for {rule.key}")
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("string")
    if not verdicts:
        return parts.select("*", none.alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted({len(rule.path) for rule in rules})
    universe = parts.select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    n_universe = universe.agg(F.approx_count_distinct("key")).first()[0]
    cascades = {}
    for verdict in sorted(set(verdicts.values())):
        listed = [(key,) for key, v in verdicts.items() if v == verdict]
        others = [(key,) for key, v in verdicts.items() if v != verdict]
        also = spark.createDataFrame(others, "key string") if others else None
        cascades[verdict] = build_cascades(spark.createDataFrame(listed, "key string"), universe.unionByName(also) if also else universe, n_universe + len(others))

    def verdict_of(key: Column) -> Column:
        found = none
        for verdict, cascade in cascades.items():
            found = F.when(cascade.has(key), F.lit(verdict)).otherwise(found)
        return found

    fits = F.filter(
        F.transform(candidate_keys(F.col("host"), F.col("path"), lengths), lambda k: F.struct(k.alias("rule"), verdict_of(k).alias("verdict"))),
        lambda x: x["verdict"].isNotNull(),
    )
    hit = fresh(parts, "hit")
    judged = parts.withColumn(hit, F.get(fits, F.lit(0)))
    return judged.select(*parts.columns, F.col(hit)["rule"].alias("rule"), F.coalesce(F.col(hit)["verdict"], F.lit(default)).alias("verdict"))
