"""Event catalogue and symbol index bound to the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.index import locations, write_index
from quern.plans.queries import _t, registry
from quern.sources.places import scratch
from quern.streaming.catalogue import KINDS, metrics, progress, typed

QUERIES, ORACLE_SQL, bound = registry()

_NAMES = [*KINDS, "Retired", "Renamed"]
_SUBJECTS, _AMOUNTS = ({k: f[which] for k, f in KINDS.items()} for which in (0, 1))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of twelve kinds, two of them unknown, with VARIANT payloads; some lack their subject or amount."""
    i, kind = F.col("event_id"), F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % 12).cast("int"))
    named = lambda fields, other: F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in fields.items() if v], F.lit(other))
    subject = F.when(i % 50 > 0, F.concat(F.lit("s"), "user_id"))
    amount = F.when(i % 70 > 0, F.floor("value").cast("string"))
    text = F.concat(F.lit("{"), F.array_join(F.filter(F.array(F.concat(F.lit('"'), named(_SUBJECTS, "subject"), F.lit('": "'), subject, F.lit('"')), F.concat(F.lit('"'), named(_AMOUNTS, "amount"), F.lit('": '), amount)), lambda x: x.isNotNull()), ", "), F.lit("}"))
    return _t(spark, sf_dir, "events").select(kind.alias("kind"), "ts", F.parse_json(text).alias("payload"))


_LOG_SQL = f"""e AS (SELECT ({_NAMES})[event_id % 12 + 1] AS kind, ts, CASE WHEN event_id % 50 > 0 THEN 's' || user_id END AS subject, CASE WHEN event_id % 70 > 0 THEN floor(value)::BIGINT END AS n, event_id % 12 NOT IN (1, 9, 10, 11) AS counts FROM events),
    f AS (SELECT kind, ts, subject, CASE WHEN counts THEN n END AS amount, kind NOT IN ('Retired', 'Renamed') AND subject IS NOT NULL AND (NOT counts OR n IS NOT NULL) AS sound FROM e)"""


@bound(f"WITH {_LOG_SQL} SELECT count(*) FILTER (sound AND kind = 'LibraryImported') AS total_libraries, count(*) FILTER (sound AND kind = 'ArtifactDiscovered') AS total_artifacts, 0::BIGINT AS total_functions, count(*) FILTER (NOT sound) AS faults FROM f")
def event_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(typed(_log(spark, sf_dir)))


@bound(f"""WITH {_LOG_SQL}, p AS (SELECT subject, count(*) AS events, coalesce(sum(amount), 0)::BIGINT AS amount, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, min(ts) AS first_ts, max(ts) AS last_ts FROM f WHERE sound GROUP BY subject)
    SELECT subject, events, amount, kinds, first_ts, last_ts, last_ts + INTERVAL 1 DAY <= (SELECT max(last_ts) FROM p) AS closed FROM p""")
def event_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress(typed(_log(spark, sf_dir))).withColumn("kinds", F.array_join("kinds", ","))


@bound("""WITH s AS (SELECT p_brand AS name, p_type AS file, p_size::BIGINT AS line, p_partkey AS col FROM part), n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT 'Supplier ' || s_suppkey FROM supplier)
    SELECT n.name, count(file)::INT AS n_places, coalesce(sha256(string_agg(file || ':' || line || ':' || col, ';' ORDER BY file, line, col)), sha256('')) AS places_sha256 FROM n LEFT JOIN s USING (name) GROUP BY n.name""")
def symbol_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as symbols that stand in their parts; names of suppliers stand nowhere."""
    part, table = _t(spark, sf_dir, "part"), f"quern_symbols_{uuid.uuid4().hex}"
    symbols = part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("file"), F.col("p_size").alias("line"), F.col("p_partkey").alias("column"))
    write_index(symbols, table, 16, scratch(spark, "index"))
    asked = part.select(F.col("p_brand").alias("name")).unionByName(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier "), "s_suppkey").alias("name")))
    text = F.array_join(F.transform("locations", lambda x: F.concat_ws(":", x["file"], x["line"], x["column"])), ";")
    return locations(spark, table, asked).select("name", F.size("locations").alias("n_places"), F.sha2(text.cast("binary"), 256).alias("places_sha256"))
