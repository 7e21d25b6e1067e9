"""A labelled hour of traffic: staged events that detectors should find, and benign look-alikes that they shouldn't.

Everything is an expression of a seed, an aircraft's role and number and the step, so any number of ordinary
aircraft is made in the cluster, each row on its own, and a run again gives the same rows. Chance comes
from ``chance``, a linear congruential generator started from those numbers.

Staged by construction, scores on it are a ceiling and no claim about real traffic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.sources.positions import EPOCH_US

# The scenario's clock, the area of lost integrity and its window (steps), and what is staged.
STEP_S, STEPS = 30, 120
JAM_LAT, JAM_LON, JAM_RADIUS, JAM_FROM, JAM_UNTIL = 1.15, 103.90, 0.35, 40, 80
SQUAWK_FROM, SQUAWK_UNTIL = 30, 33
DARK_FROM, DARK_UNTIL = 40, 80
DROPOUT_FROM, DROPOUT_UNTIL = 50, 70
KM_PER_DEG = 111.0
HEADINGS = (70.0, 110.0, 250.0, 290.0)
TRANSIT_HEADINGS = (70.0, 110.0, 250.0, 290.0, 90.0, 270.0)
MODULUS, FACTOR = 2_147_483_647, 48_271


def chance(seed: int, role: int, i: str, k: str) -> str:
    """A number in [0, 1) that depends on the seed, a role, an aircraft's number and a further number (SQL text)."""
    start = f"{seed}L * 7919L + {role}L * 104729L + ({i}) * 1299709L + ({k}) * 15485863L + 12345L"
    x = f"(({start}) % {MODULUS}L)"
    for _ in range(3):
        x = f"(({x} * {FACTOR}L + 11L) % {MODULUS}L)"
    return f"({x} / {MODULUS}.0D)"


def _step_deg(gs: str, heading: str, lat0: str) -> tuple[str, str]:
    """Degrees of latitude and longitude in a step."""
    km = f"({gs}) * 1.852D * {STEP_S}.0D / 3600.0D"
    north = f"({km} / {KM_PER_DEG}D * cos(radians({heading})))"
    return north, f"({km} / ({KM_PER_DEG}D * greatest(0.2D, cos(radians({lat0})))) * sin(radians({heading})))"


def _pick(values: tuple[float, ...], index: str) -> str:
    return f"element_at(array({', '.join(f'{v}D' for v in values)}), cast({index} as int) + 1)"


def flights(spark: SparkSession, seed: int = 7, n_cruise: int = 24, n_low: int = 5) -> DataFrame:
    """One row an aircraft: role, i, icao24, lat0, lon0, heading, gs_kt, alt_ft."""

    def rows(role: str, number: int, n: int, icao24: str, lat0: str, lon0: str, heading: str, gs: str, alt: str) -> str:
        c = lambda k: chance(seed, number, "i", str(k))
        fill = lambda x: x.format(*map(c, range(6)))
        return (
            f"SELECT '{role}' AS role, i, {icao24} AS icao24, cast({fill(lat0)} as double) AS lat0, cast({fill(lon0)} as double) AS lon0,"
            f" cast({fill(heading)} as double) AS heading, cast({fill(gs)} as double) AS gs_kt, cast({fill(alt)} as double) AS alt_ft FROM (SELECT id AS i FROM range({n}))"
        )

    def numbered(prefix: str, digits: int) -> str:
        return f"concat('{prefix}', lpad(lower(hex(i)), {digits}, '0'))"

    cruise = _pick(HEADINGS, "floor({2} * 4)") + " + {3} * 16D - 8D"
    transit = _pick(TRANSIT_HEADINGS, "i")
    north, east = _step_deg("430 + 10 * i", transit, f"{JAM_LAT}D")
    parts = [
        rows("cruise", 1, n_cruise, numbered("a", 5), "0.6D + {0} * 1.3D", "102.9D + {1} * 1.8D", cruise, "420D + {4} * 60D", "30000D + {5} * 10000D"),
        # Each crosses the middle of the area within its window.
        rows("transit", 2, 6, numbered("aa", 4), f"{JAM_LAT}D - {north} * (48 + 4 * i)", f"{JAM_LON}D - {east} * (48 + 4 * i)", transit, "430 + 10 * i", "30000D + {5} * 10000D"),
        rows("dip", 3, 1, "'b00d1f'", "2.0D", "103.0D", "120D", "450D", "36000D"),
        rows("low", 4, n_low, numbered("c", 5), "1.2D + {0} * 0.25D", "103.3D + {1}", "if({2} < 0.5D, 90D, 270D) + {3} * 4D - 2D", "140D + {4} * 80D", "1500D + {5} * 5500D"),
        rows("dark", 5, 2, "concat('d0000', i + 1)", "0.7D + 0.2D * i", "102.9D", "75D", "470D", "37000D"),
        rows("border", 6, 1, "'e00001'", "1.35D", "104.2D", "185D", "160D", "1800D"),
        rows("spoof", 7, 1, "'f00bad'", "1.2D", "103.6D", "90D", "450D", "35000D"),
        rows("orbit", 8, 2, "concat('ab000', i + 1)", "1.05D + 0.1D * i", "103.6D + 0.5D * i", "0D", "250D", "12000D"),
    ]
    return spark.sql(" UNION ALL ".join(parts))


def positions(spark: SparkSession, seed: int = 7, n_cruise: int = 24, n_low: int = 5, region: str = "synthetic") -> DataFrame:
    """The scenario's reports, in the engine's columns (and callsign, registration, type_code, category)."""
    steps = flights(spark, seed, n_cruise, n_low).selectExpr("*", f"explode(sequence(0, {STEPS - 1})) AS step")
    silent = f"(role = 'dark' AND step >= {DARK_FROM} AND step < {DARK_UNTIL}) OR (role = 'low' AND i % 2 = 0 AND step >= {DROPOUT_FROM} AND step < {DROPOUT_UNTIL}) OR (role = 'spoof' AND step % 2 = 1)"
    north, east = _step_deg("gs_kt", "heading", "lat0")
    number = "CASE role WHEN 'cruise' THEN 1 WHEN 'transit' THEN 2 WHEN 'dip' THEN 3 WHEN 'low' THEN 4 WHEN 'dark' THEN 5 ELSE 6 END"
    luck = lambda k: chance(seed, 97, f"({number}) * 1000003L + i", f"step * 8 + {k}")
    noise = lambda k: f"0.0004D * sqrt(-2D * ln(1D - {luck(k)})) * cos(2D * pi() * {luck(k + 1)})"
    placed = steps.where(f"NOT ({silent})").selectExpr("*", f"lat0 + {north} * step AS lat_", f"lon0 + {east} * step AS lon_")
    jammed = f"(role IN ('cruise', 'transit') AND step >= {JAM_FROM} AND step < {JAM_UNTIL} AND abs(lat_ - {JAM_LAT}D) <= {JAM_RADIUS}D AND abs(lon_ - {JAM_LON}D) <= {JAM_RADIUS}D)"
    staged = placed.selectExpr("*", f"{jammed} AS jammed", f"(role = 'dip' AND step = {STEPS // 2}) AS dipped")
    us = f"{EPOCH_US} + cast(step as bigint) * {STEP_S * 1_000_000}"
    lat = f"CASE role WHEN 'spoof' THEN if(step % 4 = 0, 1.2D, 3.9D) WHEN 'orbit' THEN lat0 + 0.08D * sin(step * 0.35D) ELSE lat_ + {noise(0)} END"
    lon = f"CASE role WHEN 'spoof' THEN if(step % 4 = 0, 103.6D, 104.4D) WHEN 'orbit' THEN lon0 + 0.08D * cos(step * 0.35D) ELSE lon_ + {noise(2)} END"
    return staged.selectExpr(
        # Ids in the order of time, then aircraft.
        "cast(step as bigint) * 1000000000000 + cast(conv(icao24, 16, 10) as bigint) AS id",
        "icao24",
        f"cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ({us}) / 1000000) as timestamp_ntz) AS ts",
        f"{us} AS us",
        f"{lat} AS lat",
        f"{lon} AS lon",
        "alt_ft AS alt_baro_ft",
        "0.0D AS baro_rate_fpm",
        "gs_kt",
        f"if(icao24 = 'a00000' AND step BETWEEN {SQUAWK_FROM} AND {SQUAWK_UNTIL}, '7700', '2000') AS squawk",
        "false AS on_ground",
        f"CASE WHEN jammed THEN element_at(array(0, 1, 2, 4), cast(floor({luck(4)} * 4) as int) + 1) WHEN dipped THEN 2 ELSE 8 END AS nic",
        f"CASE WHEN jammed THEN element_at(array(0, 2, 4), cast(floor({luck(5)} * 3) as int) + 1) WHEN dipped THEN 3 ELSE 9 END AS nac_p",
        "'synthetic' AS source",
        f"'{region}' AS region",
        "concat('SYN', upper(right(icao24, 3))) AS callsign",
        "cast(NULL AS string) AS registration",
        "'A320' AS type_code",
        "'A3' AS category",
    )


def labels(spark: SparkSession) -> DataFrame:
    """What is staged: kind, icao24 (null for the area), start_us, end_us, lat, lon."""
    at = lambda step: EPOCH_US + step * STEP_S * 1_000_000
    rows = [
        ("squawk", "a00000", SQUAWK_FROM, SQUAWK_UNTIL, None, None),
        ("jamming", None, JAM_FROM, JAM_UNTIL, JAM_LAT, JAM_LON),
        ("gap", "d00001", DARK_FROM, DARK_UNTIL, None, None),
        ("gap", "d00002", DARK_FROM, DARK_UNTIL, None, None),
        ("incursion", "e00001", 30, STEPS, 0.9, 104.2),
        ("spoof", "f00bad", 0, STEPS, None, None),
        ("anomaly", "ab0001", 0, STEPS, None, None),
        ("anomaly", "ab0002", 0, STEPS, None, None),
    ]
    values = ", ".join(f"({', '.join('NULL' if v is None else repr(v) for v in (k, i))}, {at(a)}L, {at(b)}L, {'NULL' if c is None else f'{c}D'}, {'NULL' if d is None else f'{d}D'})" for k, i, a, b, c, d in rows)
    return spark.sql(f"SELECT kind, cast(icao24 AS string) AS icao24, start_us, end_us, cast(lat AS double) AS lat, cast(lon AS double) AS lon FROM VALUES {values} AS t(kind, icao24, start_us, end_us, lat, lon)")
