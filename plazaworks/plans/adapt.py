"""The model's tables as views of the driver's tables, for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaworks.operators.mutations import latest_wins
from plazaworks.plans.registry import table

#: The moment the queries take place, and where the viewer is.
AS_OF = "1996-01-01 00:00:00"
CENTER = (50.0683, 19.9917)

_LAT = "49.15e0 + ((c_custkey * 37) % 1000) / 1e3 * 1.37e0"
_LON = "19.05e0 + ((c_custkey * 91) % 1000) / 1e3 * 2.45e0"
_KIND = "CASE c_mktsegment WHEN 'FURNITURE' THEN 'cafe' WHEN 'HOUSEHOLD' THEN 'park' WHEN 'BUILDING' THEN 'hall' WHEN 'AUTOMOBILE' THEN 'square' ELSE 'other_public' END"
_CAPACITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 4 WHEN '5-LOW' THEN NULL ELSE 5 END"
_TAG = "CASE o_orderkey % 5 WHEN 0 THEN 'Paddle tournament' WHEN 1 THEN 'coffee' WHEN 2 THEN 'Golf' WHEN 3 THEN 'board games' ELSE 'Running club' END"
_TAG2 = "CASE o_orderkey % 3 WHEN 0 THEN 'evening' WHEN 1 THEN 'walks' ELSE 'tea' END"
_AGE = "CASE {k} % 7 WHEN 0 THEN '18-24' WHEN 1 THEN '25_34' WHEN 2 THEN '35-44' WHEN 3 THEN '45_54' WHEN 4 THEN '55-64' WHEN 5 THEN '65+' ELSE NULL END"
_SPORT = "CASE WHEN {k} % 5 = 4 THEN NULL ELSE {k} % 5 END"
_LIKE = "CASE {k} % 4 WHEN 0 THEN 'walks' WHEN 1 THEN 'Coffee' WHEN 2 THEN 'golf' ELSE 'wants company' END"
_LIKE2 = "CASE {k} % 3 WHEN 0 THEN 'paddle' WHEN 1 THEN 'tea' ELSE 'I feel lonely' END"


def places(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("place_name"), F.expr(_KIND).alias("kind"), F.expr(_LAT).alias("lat"), F.expr(_LON).alias("lon"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("host_id"),
        F.col("o_custkey").alias("place_id"),
        F.col("o_orderpriority").alias("title"),
        F.expr("o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT))").alias("starts_at"),
        F.expr(_CAPACITY).alias("capacity"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'cancelled' ELSE 'scheduled' END").alias("status"),
        F.expr("o_totalprice > 250000").alias("promoted"),
        F.expr("o_orderkey % 7 = 0").alias("women_only"),
        F.expr(f"array({_TAG}, {_TAG2})").alias("tags"),
    )


def attendances(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """The latest status of each (event, user), or of those of a table of event_ids, to which the log is reduced first.

    Statuses are three, so the log holds their number: all its columns are of
    fixed width then, and the aggregate hashes.
    """
    code = F.expr("CASE l_returnflag WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END").alias("code")
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").alias("user_id"), code, "l_linenumber", "l_partkey")
    if of is not None:
        log = log.join(of, "event_id", "left_semi")
    latest = latest_wins(log, ["event_id", "user_id"], ["l_linenumber", "l_partkey"])
    return latest.select("event_id", "user_id", F.expr("CASE code WHEN 0 THEN 'going' WHEN 1 THEN 'cancelled' ELSE 'completed' END").alias("status"))


def people(spark: SparkSession, d: str) -> DataFrame:
    k = "s_suppkey"
    return table(spark, d, "supplier").select(
        F.col(k).alias("user_id"),
        F.col("s_name").alias("first_name"),
        F.expr(_AGE.format(k=k)).alias("age_band"),
        F.expr(f"CAST({_SPORT.format(k=k)} AS INT)").alias("sportiness"),
        F.expr(f"array({_LIKE.format(k=k)}, {_LIKE2.format(k=k)})").alias("tags"),
        F.expr(f"{k} % 6 = 0").alias("women_only"),
        F.expr(f"CAST(CASE WHEN {k} % 4 = 0 THEN NULL ELSE ({k} * 7) % 1440 END AS INT)").alias("start_minute"),
        F.expr(f"CAST(CASE WHEN {k} % 4 = 0 THEN NULL ELSE ({k} * 13) % 1440 END AS INT)").alias("end_minute"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    read = table(spark, d, "conversations").filter(F.col("role") != "system")
    return read.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("user_id"), "role", F.col("text").alias("body"), F.col("turn").alias("created"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Library documents are labels, their chunks vectors."""
    return table(spark, d, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("chunk"), "embedding")


CTES = {
    "places": f"SELECT c_custkey AS place_id, c_name AS place_name, {_KIND} AS kind, {_LAT} AS lat, {_LON} AS lon FROM customer",
    "evs": f"SELECT o_orderkey AS event_id, o_custkey AS host_id, o_custkey AS place_id, o_orderpriority AS title, o_orderdate + to_minutes(o_orderkey % 1440) AS starts_at, {_CAPACITY} AS capacity, CASE o_orderstatus WHEN 'F' THEN 'cancelled' ELSE 'scheduled' END AS status, o_totalprice > 250000 AS promoted, o_orderkey % 7 = 0 AS women_only, [{_TAG}, {_TAG2}] AS tags FROM orders",
    "attendances": "SELECT l_orderkey AS event_id, l_suppkey AS user_id, CASE l_returnflag WHEN 'N' THEN 'going' WHEN 'R' THEN 'cancelled' ELSE 'completed' END AS status FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1",
    "people": f"SELECT s_suppkey AS user_id, s_name AS first_name, {_AGE.format(k='s_suppkey')} AS age_band, CAST({_SPORT.format(k='s_suppkey')} AS INT) AS sportiness, [{_LIKE.format(k='s_suppkey')}, {_LIKE2.format(k='s_suppkey')}] AS tags, s_suppkey % 6 = 0 AS women_only, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey * 7) % 1440 END AS start_minute, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey * 13) % 1440 END AS end_minute FROM supplier",
    "messages": "SELECT conv_id * 1000 + turn AS id, conv_id AS user_id, role, text AS body, turn AS created FROM conversations WHERE role <> 'system'",
    "signed": "SELECT event_id, count(*) AS n FROM attendances WHERE status = 'going' GROUP BY 1",
    "live": f"SELECT * FROM evs JOIN places USING (place_id) WHERE status = 'scheduled' AND starts_at + INTERVAL 24 HOURS > TIMESTAMP '{AS_OF}'",
}

#: Scalars of the model as DuckDB macros would have them; {a}, {b} and so on are expressions.
HAVERSINE = "2 * 6371000 * asin(sqrt(least(1, greatest(0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"
WORDS = r"regexp_extract_all(lower({a}), '([\p{{L}}\p{{N}}]+)', 1)"


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in names) + " "


def distance(lat: str = "lat", lon: str = "lon") -> str:
    return HAVERSINE.format(a=lat, b=lon, c=f"{CENTER[0]}", d=f"{CENTER[1]}")


def warsaw(t: str) -> str:
    last = lambda month: f"(last_day(make_date(year({t}), {month}, 1)) - CAST(dayofweek(last_day(make_date(year({t}), {month}, 1))) AS INT) + INTERVAL 1 HOUR)"
    return f"((hour({t}) * 60 + minute({t}) + CASE WHEN {t} >= {last(3)} AND {t} < {last(10)} THEN 120 ELSE 60 END) % 1440)"


def tokens(text: str) -> str:
    return f"list_transform(list_filter({WORDS.format(a=text)}, lambda w: length(w) >= 2), lambda w: CASE WHEN w = 'paddle' THEN 'padel' ELSE w END)"


def canon(text: str) -> str:
    return f"CASE WHEN lower(trim({text})) = 'paddle' THEN 'padel' ELSE lower(trim({text})) END"


def tag_set(tags: str) -> str:
    return f"list_distinct(list_transform({tags}, lambda t: {canon('t')}))"


def contains(start: str, end: str, minute: str) -> str:
    return f"(CASE WHEN {start} > 1440 OR {end} > 1440 THEN false WHEN {start} = {end} THEN true WHEN {start} < {end} THEN {minute} >= {start} AND {minute} < {end} ELSE {minute} >= {start} OR {minute} < {end} END)"


def age_index(band: str) -> str:
    n = f"regexp_replace(replace(lower(trim({band})), '-', '_'), '\\+$', 'plus')"
    return f"CASE {n} WHEN '18_24' THEN 0 WHEN '25_34' THEN 1 WHEN '35_44' THEN 2 WHEN '45_54' THEN 3 WHEN '55_64' THEN 4 WHEN '65_plus' THEN 5 WHEN '65plus' THEN 5 END"


def age_similarity(a: str, b: str) -> str:
    gap = f"abs(({age_index(a)}) - ({age_index(b)}))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {gap} IS NULL THEN CASE WHEN {canon(a)} = {canon(b)} THEN 1 ELSE 0 END WHEN {gap} = 0 THEN 1 WHEN {gap} = 1 THEN 0.5 ELSE 0 END"


def sport_similarity(a: str, b: str) -> str:
    level = lambda x: f"greatest(0, least(3, {x}))"
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 - abs({level(a)} - {level(b)}) / 3e0 END"


def tag_jaccard(a: str, b: str) -> str:
    x, y = tag_set(a), tag_set(b)
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE END"
