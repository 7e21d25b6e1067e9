"""Landed JSON snapshots and evidence rows, parsed and validated field by field.

Dirty values never fail a query: casts are tried, and rows that can't be used are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings

#: Everything as text or number that may be either: a snapshot's values are coerced, not trusted.
ENTRY = (
    "hex string, flight string, r string, t string, category string, lat string, lon string, alt_baro string, alt_geom string, gs string, track string,"
    " baro_rate string, squawk string, nic string, nac_p string, sil string, rssi string, seen_pos string"
)
SNAPSHOT = f"now double, total long, ac array<struct<{ENTRY.replace(' string', ':string')}>>"
# Metres to feet, metres a second to knots and to feet a minute.
FT, KT, FPM = 3.280839895, 1.943844492, 196.8503937


def number(x: Column) -> Column:
    """A finite double, or null."""
    v = x.try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def integer(x: Column) -> Column:
    """An int; a JSON number with a fraction loses it, other text gives null."""
    return F.coalesce(x.try_cast("int"), F.when(x.rlike(r"^-?\d+\.\d+$"), x.try_cast("double").cast("int")))


def text(x: Column) -> Column:
    """Trimmed, and null if blank."""
    return F.nullif(F.trim(x), F.lit(""))


def read_snapshots(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(SNAPSHOT).json(path)


def from_polls(polls: DataFrame) -> DataFrame:
    """Polled texts (received_us, value; see ``poll``) as snapshots."""
    return polls.select("received_us", F.from_json("value", SNAPSHOT).alias("s")).select("received_us", "s.*")


def parse_snapshots(snapshots: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """One row a usable aircraft entry. ``now`` is in milliseconds, or when the snapshot was received (``received_us``, or the clock) if missing; positions without an age or too old are left out."""
    received = F.col("received_us") if "received_us" in snapshots.columns else F.unix_micros(F.current_timestamp())
    e = snapshots.select(F.coalesce(F.col("now") / 1000.0, received / 1e6).alias("now_s"), F.explode("ac").alias("e")).select("now_s", "e.*")
    seen = number(F.col("seen_pos"))
    hex_ = F.lower(F.trim("hex"))
    e = e.withColumns({"icao24": hex_, "seen": seen, "lat_": number(F.col("lat")), "lon_": number(F.col("lon"))})
    good = (F.col("icao24") != "") & ~F.col("icao24").startswith("~") & F.col("lat_").isNotNull() & F.col("lon_").isNotNull() & (F.col("seen") <= s.max_position_age_seconds)
    ground = F.coalesce(F.col("alt_baro") == "ground", F.lit(False))
    return e.where(good).select(
        "icao24", ((F.col("now_s") - F.col("seen")) * 1e6).cast("long").alias("us"), F.col("lat_").alias("lat"), F.col("lon_").alias("lon"),
        F.when(~ground, number(F.col("alt_baro"))).alias("alt_baro_ft"), number(F.col("alt_geom")).alias("alt_geom_ft"), number(F.col("gs")).alias("gs_kt"),
        number(F.col("track")).alias("track_deg"), number(F.col("baro_rate")).alias("baro_rate_fpm"), ground.alias("on_ground"), text(F.col("squawk")).alias("squawk"),
        integer(F.col("nic")).alias("nic"), integer(F.col("nac_p")).alias("nac_p"), integer(F.col("sil")).alias("sil"), number(F.col("rssi")).alias("rssi"),
        text(F.col("flight")).alias("callsign"), text(F.col("r")).alias("registration"), text(F.col("t")).alias("type_code"), text(F.col("category")).alias("category"),
    )


def parse_state_vectors(rows: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Rows of (snapshot_s, v: array of text) in positional order, at least 17 long; integrity is unknown in this source."""
    at = lambda i: F.get("v", F.lit(i))
    pos, icao = number(at(3)), F.lower(F.trim(at(0)))
    age = F.col("snapshot_s") - pos
    ground = F.coalesce(at(8).try_cast("boolean"), F.lit(False))
    good = (F.size("v") >= 17) & (icao != "") & number(at(5)).isNotNull() & number(at(6)).isNotNull() & (age >= -5) & (age <= s.max_position_age_seconds)
    return rows.where(good).select(
        icao.alias("icao24"), text(at(1)).alias("callsign"), (pos * 1e6).cast("long").alias("us"), number(at(6)).alias("lat"), number(at(5)).alias("lon"),
        F.when(~ground, number(at(7)) * FT).alias("alt_baro_ft"), (number(at(13)) * FT).alias("alt_geom_ft"), (number(at(9)) * KT).alias("gs_kt"), number(at(10)).alias("track_deg"),
        (number(at(11)) * FPM).alias("baro_rate_fpm"), ground.alias("on_ground"), text(at(14)).alias("squawk"), F.lit(None).cast("int").alias("nic"), F.lit(None).cast("int").alias("nac_p"),
        F.lit(None).cast("int").alias("sil"), F.concat(F.lit("OS"), integer(at(17)).cast("string")).alias("category"),
    )


EVIDENCE = "doc_id string, title string, source string, reliability string, credibility string, summary string, published string, url string, detector string, lat string, lon string, zone string"


def parse_evidence(rows: DataFrame, lane: str, api_url: str) -> DataFrame:
    """Evidence items with an id, a title, a time and a place; the rest gets defaults."""
    # A bare date or time without a zone is UTC; a zone is applied.
    zone = F.regexp_extract("published", r"(Z|[+-]\d{2}:?\d{2})$", 1)
    naive = F.regexp_replace(F.trim("published"), r"(Z|[+-]\d{2}:?\d{2})$", "")
    shift = F.when(zone.rlike(r"^[+-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (F.substring(zone, 2, 2).cast("int") * 60 + F.right(zone, F.lit(2)).cast("int"))).otherwise(0)
    e = rows.withColumns({"_ts": naive.try_cast("timestamp_ntz"), "lat_": number(F.col("lat")), "lon_": number(F.col("lon"))})
    good = (F.trim("doc_id") != "") & (F.trim("title") != "") & F.col("_ts").isNotNull() & F.col("lat_").between(-90, 90) & F.col("lon_").between(-180, 180)
    url = F.when(text(F.col("url")).isNotNull(), F.concat(F.rtrim(F.lit(api_url), F.lit("/")), F.lit("/"), F.ltrim(F.trim("url"), F.lit("/"))))
    credible = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(number(F.col("credibility")).cast("int"), F.lit(6))))
    return e.where(good).select(
        F.lit(lane).alias("lane"), F.trim("doc_id").alias("doc_id"), F.trim("title").alias("title"), F.coalesce(text(F.col("source")), F.lit(lane)).alias("source"),
        F.coalesce(F.upper(F.left(text(F.col("reliability")), F.lit(1))), F.lit("F")).alias("reliability"), credible.alias("credibility"),
        F.coalesce(text(F.col("summary")), F.trim("title")).alias("summary"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', _ts)") - shift.cast("long") * 60_000_000).alias("us"),
        url.alias("url"), F.coalesce(text(F.col("detector")), F.lit("unknown")).alias("detector"), F.col("lat_").alias("lat"), F.col("lon_").alias("lon"), text(F.col("zone")).alias("zone"),
    )


def lane(spark: SparkSession, path: str, name: str, api_url: str) -> tuple[DataFrame, DataFrame]:
    """A lane's landed evidence as (items, rows that aren't JSON)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", EVIDENCE + ", _corrupt string", options).alias("e")).select("e.*")
    return parse_evidence(raw.where("_corrupt is null"), name, api_url), raw.where("_corrupt is not null")


def lane_status(items: DataFrame, corrupt: DataFrame, name: str) -> DataFrame:
    """One row: the lane, its usable items and its rows that aren't JSON, and whether it can be used."""
    rows = items.select(F.lit(1).alias("good"), F.lit(0).alias("bad")).unionByName(corrupt.select(F.lit(0).alias("good"), F.lit(1).alias("bad")))
    out = rows.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("items"), F.coalesce(F.sum("bad"), F.lit(0)).alias("corrupt"))
    return out.select(F.lit(name).alias("lane"), "items", "corrupt", F.when(F.col("items") > 0, "ok").when(F.col("corrupt") > 0, "unreadable").otherwise("empty").alias("status"))
