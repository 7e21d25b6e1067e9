"""DuckDB twins of the registered queries, put together from common table expressions.

A query names the expressions it needs; they and what they need are placed before it.
"""

from __future__ import annotations

import re

from ..settings import EARTH_RADIUS_KM
from ..sources.ledger import LATE_OUTAGES, outage_rows, run_rows
from ..sources.positions import EPOCH_US
from ..zones import PRIORITY, REGISTRY


def km(a: str, b: str, c: str, d: str) -> str:
    inner = f"pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)"
    return f"(CASE WHEN {a}+{b}+{c}+{d} IS NOT NULL THEN 2*{EARTH_RADIUS_KM}::DOUBLE*asin(sqrt(least({inner},1.0::DOUBLE))) END)"


def _zone_cases(zones, lat: str = "lat", lon: str = "lon") -> list[tuple[str, str]]:
    return [(z.zone_id, f"({lat}>={z.lat[0]}::DOUBLE AND {lat}<{z.lat[1]}::DOUBLE AND {lon}>={z.lon[0]}::DOUBLE AND {lon}<{z.lon[1]}::DOUBLE)") for z in zones]


ZONE = "CASE " + " ".join(f"WHEN {c} THEN '{z}'" for z, c in _zone_cases(PRIORITY)) + " END"
SEVERITY = "CASE WHEN score>=0.85 THEN 'critical' WHEN score>=0.65 THEN 'high' WHEN score>=0.4 THEN 'moderate' ELSE 'low' END"
GRADE = "CASE WHEN n>=8 THEN 'B' WHEN n>=4 THEN 'C' WHEN n>=2 THEN 'D' ELSE 'E' END"


def values(rows: list[tuple], kinds: list[str]) -> str:
    cell = lambda v, k: f"CAST({'NULL' if v is None else repr(v)} AS {k})"
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows) + ")"


RUN_KINDS = ["BIGINT"] * 4 + ["VARCHAR", "VARCHAR", "DOUBLE", "DOUBLE", "DOUBLE", "BIGINT"]
OUT_KINDS = ["BIGINT", "BIGINT", "BIGINT", "VARCHAR", "BIGINT"]
ISO = r"regexp_replace(strftime({}, '%Y-%m-%dT%H:%M:%S.%f'), '\.000000$', '')"

CTE = {
    "base": """SELECT event_id AS id, user_id AS u, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, (epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01')) // 720 AS rel,
      ((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01')) // 720) / 1000000.0::DOUBLE AS t, event_type, user_id % 10 AS cls FROM events""",
    "placed": """SELECT *, CASE WHEN cls=6 THEN 0.8::DOUBLE WHEN cls=8 AND id%2=0 THEN 3.9::DOUBLE WHEN cls=8 THEN 1.2::DOUBLE ELSE 0.6::DOUBLE+(u%13)::DOUBLE*0.1::DOUBLE END AS lat,
      CASE WHEN cls=6 THEN 104.2::DOUBLE+(k-50)::DOUBLE*0.0001::DOUBLE WHEN cls=8 AND id%2=0 THEN 104.4::DOUBLE WHEN cls=8 THEN 103.6::DOUBLE
      ELSE 102.9::DOUBLE+(u%17)::DOUBLE*0.1::DOUBLE+(CASE WHEN u%2=0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)*0.002::DOUBLE*(t-1800.0::DOUBLE) END AS lon
      FROM base WHERE NOT (cls=7 AND t>=1200 AND t<2400)""",
    "boxed": """SELECT *, (abs(lat-1.15::DOUBLE)<=0.36::DOUBLE AND abs(lon-103.9::DOUBLE)<=0.36::DOUBLE AND t>=1200 AND t<2400 AND cls<>8) AS jam FROM placed""",
    "positions": f"""SELECT id, 'a'||lpad(CAST(u AS VARCHAR),5,'0') AS icao24, TIMESTAMP '2026-07-01'+to_microseconds(rel) AS ts, {EPOCH_US}+rel AS us, lat, lon,
      CASE WHEN k=17 THEN NULL WHEN cls=6 THEN (1800+k)::DOUBLE ELSE (30000+(u%7)*1500)::DOUBLE END AS alt,
      CASE WHEN k=23 THEN NULL WHEN cls=6 AND u%20=16 THEN -1400.0::DOUBLE WHEN cls=7 AND u%30=17 THEN -1800.0::DOUBLE ELSE 0.0::DOUBLE END AS rate,
      CASE WHEN k=29 THEN NULL ELSE 450.0::DOUBLE END AS gs,
      CASE WHEN event_type='signup' THEN NULL WHEN cls=9 AND t>=600 AND t<900 THEN '7700' ELSE '2000' END AS squawk,
      (event_type='purchase' AND cls=5 AND t<300) AS on_ground,
      CASE WHEN k=13 THEN NULL WHEN jam THEN CASE k%4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END ELSE 8 END AS nic,
      CASE WHEN k=13 THEN NULL WHEN jam THEN CASE k%3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 4 END ELSE 9 END AS nac,
      'synthetic' AS source, CASE WHEN u%2=0 THEN 'north' ELSE 'south' END AS region FROM boxed""",
    "runs": f"SELECT * FROM {values(run_rows(), RUN_KINDS)} r(id,started_us,last_message_us,stopped_us,status,region,center_lat,center_lon,radius_nm,report_count)",
    "outages": f"SELECT * FROM {values(outage_rows(), OUT_KINDS)} o(id,opened_us,closed_us,reason,run_id)",
    "late_outages": f"SELECT * FROM {values(outage_rows(LATE_OUTAGES), OUT_KINDS)} o(id,opened_us,closed_us,reason,run_id)",
    "pairs": """SELECT *, lag(us) OVER w AS p_us, lag(id) OVER w AS p_id, lag(ts) OVER w AS p_ts, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(alt) OVER w AS p_alt, lag(rate) OVER w AS p_rate,
      lag(gs) OVER w AS p_gs, lag(region) OVER w AS p_region FROM positions WINDOW w AS (PARTITION BY icao24 ORDER BY us, id)""",
    "dist": f"SELECT *, (us-p_us)/1000000.0::DOUBLE AS seconds, {km('p_lat', 'p_lon', 'lat', 'lon')} AS km FROM pairs WHERE p_us IS NOT NULL",
    "steps": "SELECT *, CASE WHEN seconds<=0 THEN 0.0::DOUBLE ELSE km/1.852::DOUBLE/(seconds/3600.0::DOUBLE) END AS speed FROM dist",
    "hits": "SELECT * FROM steps WHERE speed>1400",
    "spoofed": f"""SELECT 'spoof:'||icao24||':'||{ISO.format('arg_min(ts,us)')} AS incident_id, icao24, 'spoof' AS detector, 'kinematic impossibility / identity anomaly' AS incident_type,
      least(1.0::DOUBLE, 0.6::DOUBLE+0.1::DOUBLE*count(*)) AS score, 'C' AS reliability, min(us) AS start_us, max(us) AS end_us, arg_min(lat,us) AS lat, arg_min(lon,us) AS lon,
      CAST(NULL AS BIGINT) AS affected_count, 'AT-KINEMATIC-SPOOF' AS technique, arg_min(region,us) AS region, count(*) AS violations, max(speed) AS max_speed FROM hits GROUP BY icao24 HAVING count(*)>=3""",
    "air": "SELECT * FROM positions WHERE NOT on_ground",
    "cut": "SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY icao24 ORDER BY us, id)>900000000 THEN 1 ELSE 0 END AS fresh FROM air",
    "seg": "SELECT *, sum(fresh) OVER (PARTITION BY icao24 ORDER BY us, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM cut",
    "segstep": f"SELECT *, {km('plat', 'plon', 'lat', 'lon')} AS step_km FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM seg WINDOW w AS (PARTITION BY icao24, island ORDER BY us, id))",
    "tracks": f"""SELECT icao24||':'||{ISO.format('arg_min(ts,us)')} AS track_id, icao24, count(*) AS point_count, sum(step_km) AS distance_km, min(us) AS start_us, max(us) AS end_us, arg_min(region,us) AS region,
      arg_min(lat,us) AS start_lat, arg_min(lon,us) AS start_lon, arg_max(lat,us) AS end_lat, arg_max(lon,us) AS end_lon FROM segstep GROUP BY icao24, island HAVING count(*)>=10""",
    "silences": """SELECT icao24, seconds/60.0::DOUBLE AS gap_minutes, km, p_id AS id, p_ts, p_us AS start_us, us AS end_us, p_region AS region, p_lat, p_lon, lat AS n_lat, lon AS n_lon, p_gs AS gs
      FROM steps WHERE us-p_us>=600000000 AND km>=50 AND coalesce(p_alt,0)>=10000 AND coalesce(p_rate,0)>=-300""",
    "quiet": "SELECT * FROM silences s WHERE NOT EXISTS (SELECT 1 FROM outages o WHERE o.opened_us<=s.end_us AND (o.closed_us IS NULL OR s.start_us<=o.closed_us))",
    "ranked": """SELECT s.*, r.id AS run_id, r.center_lat, r.center_lon, r.radius_nm, row_number() OVER (PARTITION BY s.id ORDER BY r.started_us DESC NULLS LAST) AS rn FROM silences s
      LEFT JOIN runs r ON r.region IS NOT DISTINCT FROM s.region AND r.center_lat IS NOT NULL AND s.start_us>=r.started_us-60000000 AND (coalesce(r.last_message_us,r.stopped_us) IS NULL OR s.start_us<=coalesce(r.last_message_us,r.stopped_us))""",
    "bounded": """SELECT *, coalesce(center_lat,1.35::DOUBLE) AS c_lat, coalesce(center_lon,103.82::DOUBLE) AS c_lon, coalesce(radius_nm,250.0::DOUBLE) AS c_radius,
      CASE WHEN run_id IS NULL THEN 'config-fallback' ELSE 'collector-run:'||run_id END AS c_source FROM ranked WHERE rn=1""",
    "off": "SELECT *, sqrt(pow((p_lat-c_lat)*60.0::DOUBLE,2)+pow((p_lon-c_lon)*60.0::DOUBLE*cos(radians(c_lat)),2)) AS nm FROM bounded",
    "exits": "SELECT *, coalesce(gs>0 AND nm<=c_radius AND gap_minutes>=2*(c_radius-nm)/gs*60.0::DOUBLE, false) AS could_have_left FROM off",
    "gapped": f"""SELECT 'gap:'||icao24||':'||{ISO.format('p_ts')} AS incident_id, icao24, 'gap' AS detector, 'dark aircraft (transponder gap)' AS incident_type,
      least(1.0::DOUBLE, 0.4::DOUBLE+0.3::DOUBLE*gap_minutes/30.0::DOUBLE+0.3::DOUBLE*km/300.0::DOUBLE) AS score, CASE WHEN gap_minutes<30 THEN 'D' ELSE 'C' END AS reliability, start_us, end_us,
      (p_lat+n_lat)/2 AS lat, (p_lon+n_lon)/2 AS lon, CAST(NULL AS BIGINT) AS affected_count, 'AT-DARK-AIRCRAFT' AS technique, region, gap_minutes, km, c_source
      FROM exits WHERE NOT could_have_left AND id IN (SELECT id FROM quiet)""",
    "low": "SELECT *, 'riau-border-watch' AS zone FROM air WHERE coalesce(alt,0)<5000 AND lat>=0.50::DOUBLE AND lat<1.10::DOUBLE AND lon>=103.80::DOUBLE AND lon<104.70::DOUBLE",
    "lowcut": "SELECT *, CASE WHEN us-lag(us) OVER (PARTITION BY icao24, zone ORDER BY us, id)>900000000 THEN 1 ELSE 0 END AS fresh FROM low",
    "lowseg": "SELECT *, sum(fresh) OVER (PARTITION BY icao24, zone ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM lowcut",
    "visits": """SELECT icao24, zone, min(us) AS start_us, max(us) AS end_us, count(*) AS samples, arg_min(ts,us) AS ts0, arg_min(region,us) AS region, median(abs(rate)) AS median_rate,
      min(coalesce(alt,0)) AS min_alt, max(coalesce(alt,0)) AS max_alt, (max(us)-min(us))/60000000.0::DOUBLE AS dwell,
      list(lat ORDER BY us, id)[count(*)//2+1] AS lat, list(lon ORDER BY us, id)[count(*)//2+1] AS lon FROM lowseg GROUP BY icao24, zone, island HAVING count(*)>=3""",
    "level": "SELECT * FROM visits WHERE median_rate IS NULL OR median_rate<500",
    "entered": f"""SELECT 'incursion:'||icao24||':'||zone||':'||{ISO.format('ts0')} AS incident_id, icao24, 'incursion' AS detector, 'low-level watch-box incursion' AS incident_type,
      least(1.0::DOUBLE, 0.5::DOUBLE+0.02::DOUBLE*dwell) AS score, 'C' AS reliability, start_us, end_us, lat, lon, CAST(NULL AS BIGINT) AS affected_count, 'AT-ZONE-INCURSION' AS technique, region, dwell FROM level""",
    "sqcut": """SELECT *, CASE WHEN us-lag(us) OVER w>900000000 OR squawk<>lag(squawk) OVER w THEN 1 ELSE 0 END AS fresh FROM positions WHERE squawk IS NOT NULL WINDOW w AS (PARTITION BY icao24 ORDER BY us, id)""",
    "sqseg": "SELECT *, sum(fresh) OVER (PARTITION BY icao24 ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM sqcut",
    "squawked": f"""SELECT 'squawk:'||icao24||':'||min(squawk)||':'||{ISO.format('arg_min(ts,us)')} AS incident_id, icao24, 'squawk' AS detector, 'emergency squawk '||min(squawk) AS incident_type, 0.55::DOUBLE AS score,
      'C' AS reliability, min(us) AS start_us, max(us) AS end_us, arg_max(lat,us) AS lat, arg_max(lon,us) AS lon, CAST(NULL AS BIGINT) AS affected_count, 'AT-EMERGENCY-SQUAWK' AS technique, arg_max(region,us) AS region, count(*) AS samples
      FROM sqseg WHERE squawk IN ('7500','7600','7700') GROUP BY icao24, island HAVING count(*)>=2""",
    "integ": "SELECT *, floor(lat/0.5::DOUBLE)::BIGINT AS fi, floor(lon/0.5::DOUBLE)::BIGINT AS fj, us // 600000000 AS bucket FROM positions WHERE nic IS NOT NULL AND NOT on_ground",
    "l0": "SELECT fi, fj, bucket FROM integ GROUP BY ALL HAVING count(DISTINCT icao24)>=4",
    "left1": "SELECT *, floor(lat/1.0::DOUBLE)::BIGINT AS ci, floor(lon/1.0::DOUBLE)::BIGINT AS cj FROM integ WHERE (fi,fj,bucket) NOT IN (SELECT (fi,fj,bucket) FROM l0)",
    "l1": "SELECT ci, cj, bucket FROM left1 GROUP BY ALL HAVING count(DISTINCT icao24)>=4",
    "left2": "SELECT * EXCLUDE (ci,cj), floor(lat/2.0::DOUBLE)::BIGINT AS ci, floor(lon/2.0::DOUBLE)::BIGINT AS cj FROM left1 WHERE (ci,cj,bucket) NOT IN (SELECT (ci,cj,bucket) FROM l1)",
    "l2": "SELECT ci, cj, bucket FROM left2 GROUP BY ALL HAVING count(DISTINCT icao24)>=4",
    "celled": """SELECT 0 AS level, true AS scoreable, fi AS ci, fj AS cj, bucket, icao24, nic, alt, nac, us, id, region FROM integ WHERE (fi,fj,bucket) IN (SELECT (fi,fj,bucket) FROM l0)
      UNION ALL SELECT 1, true, ci, cj, bucket, icao24, nic, alt, nac, us, id, region FROM left1 WHERE (ci,cj,bucket) IN (SELECT (ci,cj,bucket) FROM l1)
      UNION ALL SELECT 2, true, ci, cj, bucket, icao24, nic, alt, nac, us, id, region FROM left2 WHERE (ci,cj,bucket) IN (SELECT (ci,cj,bucket) FROM l2)
      UNION ALL SELECT 0, false, fi, fj, bucket, icao24, nic, alt, nac, us, id, region FROM left2 WHERE (ci,cj,bucket) NOT IN (SELECT (ci,cj,bucket) FROM l2)""",
    "perplane": """SELECT level, scoreable, ci, cj, bucket, icao24, min(nic) AS nic, min(nac) AS nac, arg_min_null(alt, nic*100000000000+id) AS alt, min(us) AS start_us, max(us) AS end_us, min(id) AS id0, arg_min(region,id) AS region FROM celled GROUP BY ALL""",
    "cells": """SELECT level, scoreable, ci, cj, bucket, 0.5::DOUBLE*pow(2,level) AS cell_deg, count(*) AS n, count(*) FILTER (nic<=5) AS degraded, count(*) FILTER (nic<=0 AND coalesce(nac,0)<=0) AS hard,
      min(start_us) AS start_us, max(end_us) AS end_us, arg_min(region,id0) AS region, list(round_even(alt,-2) ORDER BY alt) FILTER (nic<=5 AND alt IS NOT NULL) AS alts FROM perplane GROUP BY ALL""",
    "fired": "SELECT *, degraded/n::DOUBLE AS frac, hard/n::DOUBLE AS hard_frac FROM cells WHERE scoreable AND degraded/n::DOUBLE>=0.5",
    "jammed": f"""SELECT 'jam:L'||level||':'||ci||':'||cj||':'||bucket AS incident_id, CAST(NULL AS VARCHAR) AS icao24, 'jamming' AS detector, 'GNSS interference' AS incident_type,
      0.5::DOUBLE+0.4::DOUBLE*frac+0.1::DOUBLE*hard_frac AS score, {GRADE} AS reliability, start_us, end_us, (ci+0.5::DOUBLE)*cell_deg AS lat, (cj+0.5::DOUBLE)*cell_deg AS lon, degraded AS affected_count, 'AT-GNSS-JAM' AS technique, region,
      n, hard, len(coalesce(alts,[])) AS alt_known, alts[1] AS alt_min, alts[len(alts)//2+1] AS alt_median, alts[len(alts)] AS alt_max, len(list_filter(coalesce(alts,[]), lambda x: x<10000)) AS terminal FROM fired""",
    "incidents": " UNION ALL ".join(
        f"SELECT incident_id, icao24, detector, incident_type, score, reliability, start_us, end_us, lat, lon, affected_count, technique, region FROM {t}" for t in ("jammed", "gapped", "entered", "spoofed", "squawked")
    ),
    "graded": f"SELECT *, {SEVERITY} AS severity, {ZONE} AS zone_id FROM incidents",
    "sensitive": "SELECT *, coalesce(zone_id IN (" + ",".join(f"'{z.zone_id}'" for z in REGISTRY if z.sensitive) + "), false) AS sens FROM graded",
    "hours": "SELECT us - us%3600000000 AS hour_us, count(*) AS reports, count(DISTINCT icao24) AS aircraft FROM positions GROUP BY 1",
}
FLAT = "incident_id, icao24, detector, incident_type, round(score,6) AS score, severity, reliability, start_us, end_us, round(lat,6) AS lat, round(lon,6) AS lon, zone_id, affected_count, technique, region"


def one(table: str, more: str = "") -> str:
    """A detector's incidents with severity, zone and further columns."""
    return f"SELECT {FLAT}{', ' + more if more else ''} FROM (SELECT *, {SEVERITY} AS severity, {ZONE} AS zone_id FROM {table})"


def with_ctes(sql: str) -> str:
    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in CTE:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(CTE[name])
                need[name] = None

    visit(sql)
    ctes = ", ".join(f"{n} AS ({CTE[n]})" for n in CTE if n in need)
    return f"WITH {ctes} {sql}" if ctes else sql


QUERY: dict[str, str] = {
    "positions_view": "SELECT id, icao24, us, round(lat,6) AS lat, round(lon,6) AS lon, alt AS alt_baro_ft, squawk, on_ground, nic, nac AS nac_p, region FROM positions",
    "pair_steps": "SELECT icao24, id, p_id AS prev_id, round(seconds,6) AS seconds, round(km,6) AS km, round(speed,4) AS speed_kt FROM steps",
    "spoof_pairs": "SELECT icao24, id, round(speed,4) AS speed_kt FROM hits",
    "spoof_incidents": one("spoofed", "violations, round(max_speed,4) AS max_speed_kt"),
    "track_segments": "SELECT icao24, island, count(*) AS points, min(us) AS start_us, max(us) AS end_us FROM seg GROUP BY ALL",
    "haversine_steps": "SELECT icao24, island, round(sum(step_km),6) AS distance_km, round(max(step_km),6) AS longest_km FROM segstep GROUP BY ALL HAVING count(*)>1",
    "tracks": "SELECT track_id, icao24, point_count, round(distance_km,6) AS distance_km, start_us, end_us, region, round(start_lat,6) AS start_lat, round(start_lon,6) AS start_lon, round(end_lat,6) AS end_lat, round(end_lon,6) AS end_lon FROM tracks",
    "squawk_incidents": one("squawked", "samples"),
    "worst_nic": """SELECT fi, fj, bucket, icao24, min(nic) AS nic, arg_min_null(alt, nic*100000000000+id) AS alt_ft, min(nac) AS nac_p, min(us) AS start_us, max(us) AS end_us FROM integ GROUP BY ALL""",
    "coverage_levels": "SELECT level, scoreable, ci, cj, bucket, n AS aircraft FROM cells",
    "jamming_incidents": one("jammed", "n AS aircraft_observed, hard AS aircraft_hard_loss, alt_known, alt_min, alt_median, alt_max, terminal AS degraded_in_terminal_phase"),
    "jamming_stats": """SELECT (SELECT count(*) FROM (SELECT DISTINCT fi,fj,bucket FROM integ)) AS cells_seen, (SELECT count(*) FROM cells WHERE NOT scoreable) AS cells_unscoreable, (SELECT count(*) FROM fired) AS incidents""",
    "coverage_cells": "SELECT (ci+0.5)*cell_deg AS lat, (cj+0.5)*cell_deg AS lon, cell_deg, level, n AS aircraft_observed, scoreable, CASE WHEN scoreable THEN round(degraded/n::DOUBLE,6) END AS degraded_fraction, hard AS hard_loss, start_us, end_us FROM cells",
    "coverage_map": """SELECT (ci+0.5)*cell_deg AS lat, (cj+0.5)*cell_deg AS lon, cell_deg, count(*) AS windows, max(n) AS aircraft_observed, max(hard) AS hard_loss, bool_or(scoreable) AS scoreable,
      round(max(CASE WHEN scoreable THEN degraded/n::DOUBLE END),6) AS degraded_fraction FROM cells GROUP BY 1,2,3""",
    "coverage_totals": """WITH m AS (SELECT ci, cj, cell_deg, bool_or(scoreable) AS s, max(CASE WHEN scoreable THEN degraded/n::DOUBLE END) AS f FROM cells GROUP BY ALL)
      SELECT CASE WHEN NOT s THEN 'unscoreable' WHEN f>=0.5 THEN 'degraded' WHEN f>0 THEN 'partial' ELSE 'clear' END AS state, count(*) AS cells FROM m GROUP BY 1""",
    "gap_incidents": one("gapped", "round(gap_minutes,6) AS gap_minutes, round(km,6) AS km, c_source AS boundary_source"),
    "gap_outage_antijoin": "SELECT icao24, start_us, end_us FROM silences s WHERE NOT EXISTS (SELECT 1 FROM late_outages o WHERE o.opened_us<=s.end_us AND (o.closed_us IS NULL OR s.start_us<=o.closed_us))",
    "collection_boundary_asof": "SELECT id, c_source AS boundary_source, c_lat, c_lon, c_radius FROM bounded",
    "gap_coverage_exit": "SELECT id, round(nm,6) AS off_nm, could_have_left FROM exits",
    "incursion_incidents": one("entered"),
    "incursion_visits": "SELECT icao24, zone, samples, start_us, end_us, median_rate, min_alt, max_alt, round(dwell,6) AS dwell_minutes FROM visits",
    "zone_membership": " UNION ALL ".join(f"SELECT id, '{z}' AS zone_id FROM positions WHERE {c}" for z, c in _zone_cases(REGISTRY)),
    "zone_attribution": f"SELECT zone_id, count(*) AS reports FROM (SELECT {ZONE} AS zone_id FROM positions) GROUP BY 1",
    "zone_kind_semi": "SELECT DISTINCT icao24 FROM positions WHERE lat>=0.50::DOUBLE AND lat<1.10::DOUBLE AND lon>=103.80::DOUBLE AND lon<104.70::DOUBLE",
    "all_incidents": f"SELECT {FLAT} FROM graded",
    "top_incidents": "SELECT incident_id, round(score,6) AS score FROM graded ORDER BY score DESC, incident_id LIMIT 20",
    "filtered_incidents": "SELECT incident_id, round(score,6) AS score FROM graded WHERE detector='gap' AND score>=0.62 ORDER BY graded.score DESC, incident_id LIMIT 1000",
    "grade_tones": """SELECT icao24, grade, CASE WHEN grade='B' THEN 'strong' WHEN grade='C' THEN 'fair' ELSE 'weak' END AS tone, CASE WHEN n%10>=8 THEN 'alert' WHEN n%10>=6 THEN 'warn' ELSE 'calm' END AS risk_tone FROM
      (SELECT icao24, n, CASE WHEN high AND n//7>=8 THEN 'B' WHEN n//7>=8 OR (high AND n//7>=4) THEN 'C' WHEN n//7>=4 OR (high AND n//7>=2) THEN 'D' ELSE 'E' END AS grade FROM (SELECT icao24, count(*) AS n, coalesce(max(alt)>=33000,false) AS high FROM positions GROUP BY 1))""",
    "air_picture_aircraft": """SELECT icao24, string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques, min(reliability) AS reliability,
      string_agg(incident_id, ',' ORDER BY incident_id) AS incidents, min(start_us) AS start_us, bool_or(sens) AS in_sensitive,
      round(least(1.0::DOUBLE, max(score)+0.15::DOUBLE*(count(DISTINCT detector)-1)+(CASE WHEN bool_or(sens) THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)),3) AS risk FROM sensitive WHERE icao24 IS NOT NULL GROUP BY 1""",
    "air_picture_areas": "SELECT incident_id, round(score,6) AS score, zone_id FROM graded WHERE icao24 IS NULL",
    "stats_by_detector": "SELECT d AS detector, (SELECT count(*) FROM incidents i WHERE i.detector=d) AS incidents FROM (VALUES ('jamming'),('gap'),('incursion'),('spoof'),('squawk'),('anomaly')) v(d)",
    "stats_counts": "SELECT (SELECT count(DISTINCT icao24) FROM positions) AS aircraft, (SELECT count(*) FROM positions) AS positions, (SELECT count(*) FROM tracks) AS tracks, (SELECT count(*) FROM incidents) AS incidents, (SELECT max(us) FROM positions) AS newest_us",
    "evidence_feed": """SELECT incident_id AS doc_id, reliability, CASE WHEN score>=0.85 THEN 2 WHEN score>=0.65 THEN 3 WHEN score>=0.45 THEN 4 WHEN score>=0.25 THEN 5 ELSE 6 END AS credibility,
      phrase || ' - ' || coalesce('aircraft '||icao24, z.name, 'area') AS title, 'air domain awareness' AS source, 'geoint-air' AS kind, detector, icao24,
      phrase || ': ' || coalesce('aircraft '||icao24, 'area-level signal') || coalesce(' in the '||z.name, '') || coalesce(detail, '') || '. Human-review decision support, not a verdict.' || CASE WHEN detector='gap' THEN ' A gap may be benign coverage loss.' ELSE '' END AS summary,
      '/incidents/'||incident_id AS url, z.name AS zone, start_us AS published_us, round(lat,6) AS lat, round(lon,6) AS lon, affected_count, technique, region, round(score,6) AS score
      FROM (SELECT *, CASE detector WHEN 'jamming' THEN 'GNSS interference' WHEN 'gap' THEN 'Dark aircraft (transponder gap)' WHEN 'incursion' THEN 'Low-level watch-box incursion' WHEN 'spoof' THEN 'Kinematic impossibility / identity anomaly' ELSE incident_type END AS phrase FROM graded) graded
      LEFT JOIN (SELECT incident_id AS did, ' — '||affected_count||'/'||n||' aircraft degraded (worst-NIC cluster)' AS detail FROM jammed
        UNION ALL SELECT incident_id, ' — silent '||round_even(gap_minutes,1)||' min at altitude, reappearing '||round_even(km,1)||' km displaced' FROM gapped
        UNION ALL SELECT incident_id, ' — dwelling '||round_even(dwell,1)||' min below the altitude floor' FROM entered
        UNION ALL SELECT incident_id, ' — implied speed '||round_even(max_speed,0)||' kt (impossible)' FROM spoofed) details ON did=incident_id
      LEFT JOIN (VALUES """
    + ",".join(f"('{z.zone_id}','{z.name}')" for z in REGISTRY)
    + """) z(zid,name) ON z.zid=zone_id ORDER BY graded.score DESC, incident_id LIMIT 100""",
    "latest_before": f"SELECT icao24, id, us FROM (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY us DESC, id DESC) AS rn FROM positions WHERE us<{EPOCH_US + 1_800_000_000}) WHERE rn=1",
    "dirty_aircraft": f"SELECT DISTINCT icao24 FROM positions WHERE us>{EPOCH_US + 3_590_000_000}",
    "dirty_semi": f"SELECT icao24, count(*) AS reports FROM positions WHERE icao24 IN (SELECT icao24 FROM positions WHERE us>{EPOCH_US + 3_590_000_000}) GROUP BY 1",
    "tracks_incremental": "SELECT track_id, point_count, round(distance_km,6) AS distance_km, start_us, end_us FROM tracks",
    "gap_incremental": f"SELECT incident_id FROM gapped WHERE end_us>={EPOCH_US + 2_400_000_000}",
    "spoof_incremental": f"SELECT incident_id, violations FROM spoofed WHERE end_us>={EPOCH_US + 3_000_000_000}",
    "incursion_incremental": f"SELECT incident_id FROM entered WHERE end_us>={EPOCH_US + 3_000_000_000}",
    "squawk_incremental": f"SELECT incident_id, samples FROM squawked WHERE end_us>={EPOCH_US + 800_000_000}",
    "track_geometry": "SELECT t.track_id, count(*) AS points, round(sum(p.lat),5) AS sum_lat, round(sum(p.lon),5) AS sum_lon, min(p.us) AS first_us, max(p.us) AS last_us FROM tracks t JOIN positions p ON p.icao24=t.icao24 AND p.us BETWEEN t.start_us AND t.end_us AND (t.region IS NULL OR p.region=t.region) GROUP BY 1",
    "integrity_series": "SELECT icao24, us - us%86400000000 AS day_us, count(*) AS points, count(nic) AS known, string_agg(coalesce(CAST(nic AS VARCHAR),'-'), ' ' ORDER BY us, id) AS nics FROM positions GROUP BY 1, 2",
    "integrity_runs": """WITH k AS (SELECT *, CASE WHEN (nic IS NULL) <> lag(nic IS NULL) OVER w THEN 1 ELSE 0 END AS fresh FROM positions WINDOW w AS (PARTITION BY icao24 ORDER BY us, id)),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY icao24 ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS island FROM k)
      SELECT icao24, count(*) AS points, min(us) AS start_us, max(us) AS end_us, min(nic) AS min_nic FROM g WHERE nic IS NOT NULL GROUP BY icao24, island""",
    "speed_sensitivity": """SELECT t AS threshold_kt, sum(n)::BIGINT AS steps, count(*) FILTER (n>0) AS aircraft, count(*) FILTER (n>=3) AS candidates FROM
      (SELECT icao24, t, count(*) FILTER (speed>t) AS n FROM steps, (VALUES (750.0::DOUBLE),(1000.0::DOUBLE),(1200.0::DOUBLE),(1400.0::DOUBLE)) v(t) GROUP BY 1,2) GROUP BY 1""",
    "speed_histogram": """SELECT lo AS low_kt, (SELECT count(*) FROM steps WHERE speed>=lo AND speed<hi) AS steps FROM (VALUES (0.0::DOUBLE,250.0::DOUBLE),(250.0::DOUBLE,500.0::DOUBLE),(500.0::DOUBLE,750.0::DOUBLE),
      (750.0::DOUBLE,1000.0::DOUBLE),(1000.0::DOUBLE,1200.0::DOUBLE),(1200.0::DOUBLE,1400.0::DOUBLE),(1400.0::DOUBLE,2000.0::DOUBLE),(2000.0::DOUBLE,5000.0::DOUBLE),(5000.0::DOUBLE,'inf'::DOUBLE)) v(lo,hi)""",
    "speed_percentiles": "SELECT round(quantile_cont(speed,0.5),4) AS p50, round(quantile_cont(speed,0.9),4) AS p90, round(quantile_cont(speed,0.99),4) AS p99, round(quantile_cont(speed,0.999),3) AS p999, round(max(speed),3) AS max_kt FROM steps",
    "speed_tail_clues": "SELECT count(*) AS steps, count(*) FILTER (seconds<=10 AND km<=10) AS short_and_near, count(*) FILTER (seconds<=120 AND km>=25) AS fast_and_far, count(*) FILTER (gs<=650) AS plausible_reported FROM hits",
    "hourly_activity": "SELECT hour_us, reports, aircraft FROM hours",
    "hourly_scoreability": """SELECT hour_us, max(seen) AS cell_windows, max(left_) AS unscoreable FROM (
      SELECT bucket*600000000 - (bucket*600000000)%3600000000 AS hour_us, count(*) AS seen, 0 AS left_ FROM (SELECT DISTINCT fi,fj,bucket FROM integ) GROUP BY 1
      UNION ALL SELECT bucket*600000000 - (bucket*600000000)%3600000000, 0, count(*) FILTER (NOT scoreable) FROM cells GROUP BY 1) GROUP BY 1""",
    "hourly_incidents": "SELECT start_us - start_us%3600000000 AS hour_us, "
    + ", ".join(f"count(*) FILTER (detector='{d}') AS {d}" for d in ("jamming", "gap", "incursion", "spoof", "squawk"))
    + " FROM incidents GROUP BY 1",
    "clock_hour_profile": """SELECT (hour_us//3600000000+8)%24 AS local_hour, count(*) AS samples, round(avg(reports),6) AS reports_mean, round(stddev_pop(reports),6) AS reports_spread, round(avg(100.0::DOUBLE*unscoreable/cell_windows),6) AS unscoreable_mean,
      round(stddev_pop(100.0::DOUBLE*unscoreable/cell_windows),6) AS unscoreable_spread FROM (SELECT epoch_us(ts)-epoch_us(ts)%3600000000 AS hour_us, count(*) AS reports, count(DISTINCT user_id) AS cell_windows, count(*) FILTER (event_type='purchase') AS unscoreable FROM events GROUP BY 1) x
      WHERE coalesce((SELECT minutes FROM region_outage_hours q WHERE q.hour_us=x.hour_us), 0) < 5 AND cell_windows>=5 AND hour_us>=(SELECT min(epoch_us(ts)) FROM events) AND hour_us+3600000000<=(SELECT max(epoch_us(ts)) FROM events) GROUP BY 1""",
    "missing_clock_hours": """SELECT h AS local_hour FROM range(24) r(h) WHERE h NOT IN (SELECT (epoch_us(ts)//3600000000+8)%24 FROM events)""",
    "missing_report_hours": """SELECT h AS local_hour FROM range(24) r(h) WHERE h NOT IN (SELECT (us//3600000000+8)%24 FROM positions)""",
    "busiest_hours": """WITH h AS (SELECT (epoch_us(ts)-epoch_us(ts)%3600000000) AS hour_us, count(*) AS reports, count(DISTINCT user_id) AS cells FROM events GROUP BY 1),
      m AS (SELECT (hour_us//3600000000+8)%24 AS local_hour, avg(reports) AS mean FROM h WHERE coalesce((SELECT minutes FROM region_outage_hours q WHERE q.hour_us=h.hour_us), 0) < 5 AND cells>=5 AND hour_us>=(SELECT min(epoch_us(ts)) FROM events) AND hour_us+3600000000<=(SELECT max(epoch_us(ts)) FROM events) GROUP BY 1)
      SELECT (SELECT local_hour FROM m ORDER BY mean DESC, local_hour LIMIT 1) AS busiest, (SELECT local_hour FROM m ORDER BY mean, local_hour LIMIT 1) AS quietest""",
    "hourly_table": """SELECT hour_us, reports, aircraft, coalesce(cell_windows,0) AS cell_windows, coalesce(unscoreable,0) AS unscoreable, """
    + ", ".join(f"coalesce({d},0) AS {d}" for d in ("jamming", "gap", "incursion", "spoof", "squawk"))
    + f""", round(coalesce(minutes,0),6) AS outage_minutes FROM hours
      LEFT JOIN (SELECT bucket*600000000 - (bucket*600000000)%3600000000 AS hour_us, count(*) AS cell_windows FROM (SELECT DISTINCT fi,fj,bucket FROM integ) GROUP BY 1) c USING (hour_us)
      LEFT JOIN (SELECT bucket*600000000 - (bucket*600000000)%3600000000 AS hour_us, count(*) FILTER (NOT scoreable) AS unscoreable FROM cells GROUP BY 1) l USING (hour_us)
      LEFT JOIN (SELECT start_us - start_us%3600000000 AS hour_us, {", ".join(f"count(*) FILTER (detector='{d}') AS {d}" for d in ("jamming", "gap", "incursion", "spoof", "squawk"))} FROM incidents GROUP BY 1) i USING (hour_us)
      LEFT JOIN (SELECT s - s%3600000000 AS hour_us, sum((e-s)/60000000.0::DOUBLE) AS minutes FROM (SELECT greatest(opened_us, (SELECT min(us) FROM positions)) AS s, least(coalesce(closed_us, (SELECT max(us)+1 FROM positions)), (SELECT max(us)+1 FROM positions)) AS e FROM outages) WHERE e>s GROUP BY 1) o USING (hour_us)""",
    "merge_intervals": """WITH v AS (SELECT o_custkey, epoch_us(o_orderdate::TIMESTAMP) AS s, epoch_us(o_orderdate::TIMESTAMP)+(o_orderkey%90)*86400000000 AS e FROM orders),
      m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
      g AS (SELECT *, sum(CASE WHEN before IS NULL OR s>before THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS i FROM m)
      SELECT o_custkey AS customer, min(s) AS start_us, max(e) AS end_us FROM g GROUP BY o_custkey, i""",
    "detector_mix": "SELECT detector, count(*) AS incidents, round(count(*)/(1/24.0::DOUBLE),6) AS per_day FROM incidents GROUP BY 1",
    "lane_summary": "SELECT region, count(*) AS reports, count(DISTINCT icao24) AS aircraft, round((max(us)-min(us))/60000000.0::DOUBLE,6) AS span_minutes, count(*) FILTER (nic<=5) AS degraded_reports, count(*) FILTER (nic=0 AND coalesce(nac,0)=0) AS hard_loss_reports FROM positions WHERE nic IS NOT NULL GROUP BY 1",
    "nic_histogram": "SELECT region, nic, count(*) AS reports FROM positions WHERE nic IS NOT NULL GROUP BY ALL",
    "lane_overlap": "SELECT max(lo) AS start_us, min(hi) AS end_us FROM (SELECT region, min(us) AS lo, max(us) AS hi FROM positions WHERE nic IS NOT NULL GROUP BY 1)",
    "calibration_crosstab": """SELECT detector, reliability, plausibility, count(*) AS n FROM (SELECT 'gap' AS detector, reliability, CASE WHEN least(round_even(gap_minutes,1)/10,round_even(km,1)/50)<=1.5 THEN 'less plausible' WHEN least(round_even(gap_minutes,1)/10,round_even(km,1)/50)>=2 THEN 'more plausible' ELSE 'unclear' END AS plausibility FROM gapped
      UNION ALL SELECT 'jamming', reliability, CASE WHEN n<=4 THEN 'less plausible' WHEN n>=8 THEN 'more plausible' ELSE 'unclear' END FROM jammed
      UNION ALL SELECT 'incursion', reliability, CASE CAST(substr(icao24,2) AS BIGINT)%40 WHEN 6 THEN 'less plausible' WHEN 26 THEN 'more plausible' ELSE 'unclear' END FROM entered) GROUP BY ALL""",
    "plausibility_class": """SELECT plausibility, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(c,'^(A2|A3|AT7|B3|B6|B7|B8|CRJ|DH8|E1|E2|F7|MD)') THEN 'less plausible' WHEN regexp_matches(c,'^(A139|BE|C1|C2|C3|C4|DA|EC|H|P28|P32|PC|R44|R66|SR)') THEN 'more plausible' ELSE 'unclear' END AS plausibility
      FROM (SELECT upper(trim(substr(p_name,1,3))) AS c FROM part)) GROUP BY 1""",
    "coverage_compare": """WITH c AS (SELECT floor(lat/0.5::DOUBLE) AS i, floor(lon/0.5::DOUBLE) AS j, count(DISTINCT CASE WHEN region='north' THEN icao24 END) AS l, count(DISTINCT CASE WHEN region='south' THEN icao24 END) AS r, count(DISTINCT icao24) AS u FROM positions GROUP BY 1,2)
      SELECT 'left_aircraft' AS measure, (SELECT count(DISTINCT icao24) FROM positions WHERE region='north') AS n UNION ALL SELECT 'right_aircraft', (SELECT count(DISTINCT icao24) FROM positions WHERE region='south') UNION ALL SELECT 'shared_aircraft', 0
      UNION ALL SELECT 'left_cells', count(*) FILTER (l>0) FROM c UNION ALL SELECT 'right_cells', count(*) FILTER (r>0) FROM c UNION ALL SELECT 'shared_cells', count(*) FILTER (l>0 AND r>0) FROM c UNION ALL SELECT 'left_dense', count(*) FILTER (l>=4) FROM c
      UNION ALL SELECT 'right_dense', count(*) FILTER (r>=4) FROM c UNION ALL SELECT 'union_dense', count(*) FILTER (u>=4) FROM c UNION ALL SELECT 'density_gain', count(*) FILTER (l<4 AND u>=4) FROM c""",
    "eval_scores": """WITH w AS (SELECT DISTINCT icao24, CASE CAST(substr(icao24,2) AS BIGINT)%10 WHEN 6 THEN 'incursion' WHEN 7 THEN 'gap' WHEN 8 THEN 'spoof' WHEN 9 THEN 'squawk' END AS detector FROM positions),
      g AS (SELECT DISTINCT icao24, detector FROM incidents WHERE detector IN ('gap','incursion','spoof','squawk')),
      b AS (SELECT coalesce(w.detector,g.detector) AS detector, w.icao24 AS wi, g.icao24 AS gi FROM (SELECT * FROM w WHERE detector IS NOT NULL) w FULL JOIN g ON w.icao24=g.icao24 AND w.detector=g.detector)
      SELECT detector, count(*) FILTER (wi IS NOT NULL AND gi IS NOT NULL) AS tp, count(wi) AS wanted, count(gi) AS found, round(count(*) FILTER (wi IS NOT NULL AND gi IS NOT NULL)/nullif(count(wi),0)::DOUBLE,6) AS recall,
      round(count(*) FILTER (wi IS NOT NULL AND gi IS NOT NULL)/nullif(count(gi),0)::DOUBLE,6) AS precision FROM b GROUP BY 1""",
    "eval_jam_match": f"SELECT incident_id, {km('lat', 'lon', '1.15::DOUBLE', '103.9::DOUBLE')}<=88.8 AND start_us<={EPOCH_US + 2_400_000_000} AND end_us>={EPOCH_US + 1_200_000_000} AS in_label FROM jammed",
    "collector_health": """SELECT count(*) AS positions, count(DISTINCT icao24) AS aircraft, min(us) AS first_us, max(us) AS last_us, (SELECT count(*) FROM outages) AS outages, (SELECT count(*) FROM outages WHERE closed_us IS NULL) AS open_outages,
      round(count(*)/((max(us)-min(us))/3600000000.0::DOUBLE),4) AS reports_per_hour FROM positions""",
    "dedup_positions": "SELECT min(id) AS id, icao24, us//1000000 AS second, region FROM positions GROUP BY icao24, us//1000000, source, region",
    "dedup_append": f"""WITH s AS (SELECT DISTINCT icao24, us//1000000 AS second, region FROM positions WHERE id%3=0)
      SELECT min(id) AS id FROM positions p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.icao24=p.icao24 AND s.second=p.us//1000000 AND s.region=p.region) GROUP BY icao24, us//1000000, region""",
    "aircraft_identity": "SELECT icao24, " + ", ".join(f"arg_max({c}, id) FILTER ({c} IS NOT NULL) AS {c}" for c in ("callsign", "registration", "type_code", "category"))
    + """, min(us) AS first_us, max(us) AS last_us FROM (SELECT *, squawk AS callsign, CASE WHEN id%5=0 THEN '9V-'||(id%13) END AS registration, CASE WHEN id%7=0 THEN 'B73'||(id%3) END AS type_code,
      CASE WHEN id%11=0 THEN 'A'||(id%6) END AS category FROM positions) GROUP BY 1""",
    "retention_prune": f"SELECT count(*) AS kept, min(us) AS oldest_us FROM positions WHERE us>={EPOCH_US + 1_800_000_000}",
    "outage_from_heartbeats": """WITH b AS (SELECT user_id%5 AS region, epoch_us(ts) AS us, event_type<>'click' AS ok FROM events),
      r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY region ORDER BY us) AS run FROM b),
      f AS (SELECT *, row_number() OVER (PARTITION BY region, run ORDER BY us) AS nth FROM r WHERE NOT ok), c AS (SELECT region, run-1 AS run, min(us) AS closed_us FROM r WHERE ok GROUP BY ALL)
      SELECT f.region, f.us AS opened_us, c.closed_us FROM f LEFT JOIN c USING (region, run) WHERE nth=3""",
    "air_sea_correlate": f"""WITH e AS (SELECT incident_id, lat, lon, start_us AS us, detector FROM incidents WHERE lat BETWEEN 0.5 AND 2.0 AND lon BETWEEN 102.5 AND 104.8)
      SELECT a.incident_id AS air_doc_id, s.incident_id AS sea_doc_id, round(abs(a.us-s.us)/60000000.0::DOUBLE,6) AS delta_minutes, round({km('a.lat', 'a.lon', 's.lat', 's.lon')},6) AS distance_km FROM e a JOIN e s
      ON floor(a.lat/0.5::DOUBLE)=floor(s.lat/0.5::DOUBLE) AND floor(a.lon/0.5::DOUBLE)=floor(s.lon/0.5::DOUBLE) AND abs(a.us-s.us)<=1200000000 WHERE a.detector IN ('spoof','squawk','gap') AND s.detector IN ('jamming','incursion')""",
    "rate_limit": """SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21600000000-1 PRECEDING AND CURRENT ROW) AS in_window FROM events""",
}
def _number(x: float) -> str:
    return repr(float(x))


def _feature(z) -> str:
    ring = [*z.ring, z.ring[0]]
    at = ",".join(f"[{_number(b)},{_number(a)}]" for a, b in ring)
    country = "" if z.country is None else f'"country":"{z.country}",'
    return (
        f'{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[{at}]]}},"properties":{{"zone_id":"{z.zone_id}","name":"{z.name}","kind":"{z.kind}",{country}"sensitive":{str(z.sensitive).lower()}}}}}'
    )


def _crossed(a: tuple[float, float], b: tuple[float, float]) -> str:
    return f"(({b[1]}::DOUBLE-{a[1]}::DOUBLE)*(lat-{a[0]}::DOUBLE)-({b[0]}::DOUBLE-{a[0]}::DOUBLE)*(lon-{a[1]}::DOUBLE)>0)"


RING = [(0.55, 102.95), (2.05, 103.77), (0.57, 104.61)]
_SIDES = [_crossed(a, b) for a, b in zip(RING, RING[1:] + RING[:1], strict=True)]
_AT = "epoch_us(ts)//1000000"

CTE |= {
    "spans": "SELECT icao24, island, count(*) AS n, min(us) AS s, max(us) AS e, arg_min(ts,us) AS ts0 FROM seg GROUP BY ALL HAVING count(*)>=10",
    "knots": """SELECT * FROM (SELECT seg.icao24, seg.island, (us-s)/1000000.0::DOUBLE AS t, lat, lon, coalesce(alt,0)/1000.0::DOUBLE AS alt, (lead(us) OVER w - s)/1000000.0::DOUBLE AS nt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, lead(coalesce(alt,0)/1000.0::DOUBLE) OVER w AS nalt
      FROM seg JOIN spans ON spans.icao24=seg.icao24 AND spans.island=seg.island WINDOW w AS (PARTITION BY seg.icao24, seg.island ORDER BY us, id)) WHERE nt IS NULL OR nt>t""",
    "grid": "SELECT icao24, island, n, ts0, k, ((e-s)/1000000.0::DOUBLE)*k/63 AS g FROM spans, range(64) r(k)",
    "resampled": f"""SELECT g.icao24||':'||{ISO.format('ts0')} AS track_id, n, k, CASE WHEN nt IS NULL THEN lat ELSE lat+(nlat-lat)*(g-t)/(nt-t) END AS lat, CASE WHEN nt IS NULL THEN lon ELSE lon+(nlon-lon)*(g-t)/(nt-t) END AS lon,
      CASE WHEN nt IS NULL THEN alt ELSE alt+(nalt-alt)*(g-t)/(nt-t) END AS alt FROM grid g ASOF JOIN knots p ON g.icao24=p.icao24 AND g.island=p.island AND g.g>=p.t""",
    "moved": """SELECT track_id, n, k, (lead(lat) OVER w - lat)*111.0::DOUBLE AS north, (lead(lon) OVER w - lon)*111.0::DOUBLE*cos(radians((lat+lead(lat) OVER w)/2)) AS east, lead(alt) OVER w - alt AS climb FROM resampled WINDOW w AS (PARTITION BY track_id ORDER BY k)""",
    "turned": "SELECT *, atan2(east,north) - lag(atan2(east,north)) OVER (PARTITION BY track_id ORDER BY k) AS turn FROM moved WHERE k<63",
}
QUERY |= {
    "track_resample": "SELECT track_id, k, round(lat,6) AS lat, round(lon,6) AS lon, round(alt,6) AS alt_kft FROM resampled",
    "track_sequence": """SELECT track_id, n AS point_count, 63 AS steps, 315 AS width, round(sum(north),4) AS north_km, round(sum(east),4) AS east_km, round(sum(sqrt(north*north+east*east)),4) AS length_km,
      round(coalesce(sum(abs(atan2(sin(turn),cos(turn)))),0),4) AS turned, round(sum(climb),4) AS climb_kft FROM turned GROUP BY 1,2""",
    "parse_snapshot": """SELECT 'a'||user_id AS icao24, trunc(((epoch_us(ts)//1000)::DOUBLE/1000.0::DOUBLE-(event_id%90)::DOUBLE)*1000000.0::DOUBLE)::BIGINT AS us, CASE WHEN event_id%17>0 THEN 'F'||user_id END AS callsign, (user_id%180-90)::DOUBLE AS lat, (user_id%360-180)::DOUBLE AS lon,
      CASE WHEN event_id%5<>0 THEN (event_id%40000)::DOUBLE END AS alt_baro_ft, CASE WHEN event_id%7<>0 THEN (event_id%500)::DOUBLE END AS gs_kt, event_id%5=0 AS on_ground, CASE event_id%3 WHEN 0 THEN 7 WHEN 1 THEN 8 END AS nic
      FROM events WHERE event_id%11<>0 AND event_id%19<>0 AND event_id%13<>0 AND event_id%90<=60""",
    "parse_state_vectors": f"""SELECT 'b'||user_id AS icao24, 'C'||user_id AS callsign, ({_AT}-event_id%70+3)*1000000 AS us, (user_id%180-90)::DOUBLE AS lat, (user_id%360-180)::DOUBLE AS lon, CASE WHEN event_id%9<>0 THEN round((event_id%1000)*3.280839895::DOUBLE,4) END AS alt_baro_ft,
      round((event_id%250)*1.943844492::DOUBLE,4) AS gs_kt, round((event_id%20-10)*196.8503937::DOUBLE,4) AS baro_rate_fpm, event_id%9=0 AS on_ground, 'OS'||(event_id%8) AS category FROM events WHERE event_id%23<>0 AND event_id%70<=63""",
    "parse_evidence": f"""SELECT 'doc'||event_id AS doc_id, 'Title '||(event_id%7) AS title, 'sea' AS source, CASE WHEN event_id%4>0 THEN 'B' ELSE 'F' END AS reliability, greatest(1,least(6,event_id%9))::INT AS credibility, 'Title '||(event_id%7) AS summary,
      ({_AT})*1000000 - CASE WHEN event_id%3=1 THEN 28800000000 ELSE 0 END AS us, CASE WHEN event_id%2=0 THEN 'http://a/x/'||event_id END AS url, 'unknown' AS detector, (event_id%100)::DOUBLE AS lat, (event_id%200)::DOUBLE AS lon FROM events
      WHERE event_id%29>0 AND event_id%100<=90 AND event_id%200<=180""",
    "poll_pauses": """SELECT region, opened_us, us AS closed_us FROM (SELECT user_id%5 AS region, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id%5 ORDER BY epoch_us(ts)) AS opened_us FROM events) WHERE us-opened_us>1200000000""",
    "phase_notes": "SELECT incident_id, CASE WHEN alt_known=0 THEN 'unknown' WHEN terminal=0 THEN 'all above' WHEN terminal=alt_known THEN 'all below' ELSE 'mixed' END AS phase FROM jammed",
    "ring_membership": f"SELECT id FROM positions WHERE ({' AND '.join(_SIDES)}) OR NOT ({' OR '.join(_SIDES)})",
    "jamming_incremental": f"SELECT incident_id, affected_count FROM jammed WHERE start_us>={EPOCH_US + 1_200_000_000}",
    "squawk_stays": "SELECT icao24, squawk, count(*) AS samples, min(us) AS start_us, max(us) AS end_us FROM sqseg GROUP BY icao24, island, squawk",
    "track_list": "SELECT track_id, start_us FROM tracks ORDER BY start_us, track_id LIMIT 50",
    "aircraft_list": "SELECT icao24, min(us) AS first_us, max(us) AS last_us FROM positions GROUP BY 1 ORDER BY icao24 LIMIT 100",
    "incident_lookup": f"""SELECT incident_id, icao24, detector, round(score,6) AS score, {ISO.format('make_timestamp(start_us)')} AS ts_start, {ISO.format('make_timestamp(end_us)')} AS ts_end, zone_id AS zone FROM graded
      WHERE incident_id=(SELECT min(incident_id) FROM incidents WHERE detector='spoof')""",
    "track_features": "SELECT t.track_id, count(*) AS points, round(arg_min(p.lon,p.us),6) AS first_lon, round(arg_max(p.lat,p.us),6) AS last_lat FROM tracks t JOIN positions p ON p.icao24=t.icao24 AND p.us BETWEEN t.start_us AND t.end_us AND (t.region IS NULL OR p.region=t.region) GROUP BY 1",
    "aircraft_track": f"SELECT us, {ISO.format('make_timestamp(us)')} AS ts, round(lon,6) AS lon, round(lat,6) AS lat, coalesce(alt,0.0::DOUBLE) AS alt_ft, nic, nac AS nac_p, region FROM positions WHERE icao24='a00007'",
}
_INSIDE = " UNION ALL ".join(f"SELECT '{z}' AS zone_id FROM positions WHERE {c}" for z, c in _zone_cases(REGISTRY))
CTE["zoned"] = _INSIDE
CTE["day_runs"] = """SELECT epoch_us(ts)//86400000000*5 + user_id%5 AS id, min(epoch_us(ts)) AS started_us, max(epoch_us(ts)) AS last_message_us, user_id%5 AS region, count(*) AS report_count FROM events GROUP BY user_id%5, epoch_us(ts)//86400000000"""
CTE["beaten"] = QUERY["outage_from_heartbeats"]


def _outage_hours(region: str) -> str:
    return f"""WITH span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts))+1 AS hi FROM events), o AS (SELECT greatest(opened_us, lo) AS s, least(coalesce(closed_us, hi), hi) AS e FROM beaten, span WHERE least(coalesce(closed_us, hi), hi) > opened_us AND {region}),
      k AS (SELECT *, max(e) OVER (ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o), g AS (SELECT *, sum((before IS NULL OR s>before)::INT) OVER (ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS i FROM k),
      m AS (SELECT min(s) AS s, max(e) AS e FROM g GROUP BY i), h AS (SELECT s, e, unnest(range(s - s%3600000000, e+1, 3600000000)) AS hour_us FROM m)
      SELECT hour_us, sum((least(e,hour_us+3600000000)-greatest(s,hour_us))/60e6::DOUBLE) AS minutes FROM h GROUP BY 1 HAVING sum(least(e,hour_us+3600000000)-greatest(s,hour_us))>0"""


CTE["outage_hours"], CTE["region_outage_hours"] = _outage_hours("true"), _outage_hours("region=0")
QUERY |= {
    "last_runs": "SELECT id, region, report_count FROM day_runs ORDER BY id DESC LIMIT 12",
    "bridge_runs": "SELECT id AS run_id, region, before AS opened_us, started_us AS closed_us FROM (SELECT *, lag(last_message_us) OVER (PARTITION BY region ORDER BY id) AS before FROM day_runs) WHERE started_us-before>120000000",
    "zones_table": "SELECT v.*, coalesce(n,0) AS reports FROM (VALUES " + ",".join(f"('{z.zone_id}','{z.kind}',{str(z.sensitive).lower()},{z.lat[0]}::DOUBLE,{z.lon[0]}::DOUBLE,{z.lat[1]}::DOUBLE,{z.lon[1]}::DOUBLE)" for z in REGISTRY)
    + ") v(zone_id,kind,sensitive,min_lat,min_lon,max_lat,max_lon) LEFT JOIN (SELECT zone_id, count(*) AS n FROM zoned GROUP BY 1) z USING (zone_id)",
    "zones_geojson": "SELECT * FROM (VALUES " + ",".join(f"('{z.zone_id}','{_feature(z)}')" for z in REGISTRY) + ") v(zone_id,feature) SEMI JOIN zoned USING (zone_id)",
    "hourly_outage": "SELECT hour_us, round(minutes,6) AS outage_minutes FROM outage_hours",
}
# One region's grid since an aligned time: the same expressions over its reports alone.
_SINCE = EPOCH_US + 1_200_000_000
_GRID = ["integ", "l0", "left1", "l1", "left2", "l2", "celled", "perplane", "cells", "fired", "jammed"]
CTE["north_positions"] = f"SELECT * FROM positions WHERE region='north' AND us>={_SINCE}"
for _name in _GRID:
    CTE[f"north_{_name}"] = re.sub(r"\b(" + "|".join(["positions", *_GRID]) + r")\b", lambda m: f"north_{m[1]}", CTE[_name])
QUERY["refreshed_incidents"] = f"""SELECT incident_id, detector, region, CASE WHEN region='north' AND end_us>={_SINCE} THEN round(score,6) ELSE 0.0::DOUBLE END AS score FROM incidents WHERE detector<>'jamming'
  UNION ALL SELECT incident_id, 'jamming', 'north', round(score,6) FROM north_jammed
  UNION ALL SELECT incident_id, detector, region, 0.0::DOUBLE FROM jammed j WHERE NOT (region IS NOT DISTINCT FROM 'north' AND start_us>={_SINCE})
    AND NOT EXISTS (SELECT 1 FROM north_jammed n WHERE n.incident_id=j.incident_id AND j.region IS NOT DISTINCT FROM 'north')"""

QUERY["rank_stability"] = """m AS (SELECT track_id, k, CASE k WHEN 0 THEN point_count::DOUBLE WHEN 1 THEN round(distance_km,3) ELSE round((end_us-start_us)/60e6::DOUBLE,3) END AS score FROM tracks, range(3) r(k)),
  rk AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1)/2.0::DOUBLE AS rk, row_number() OVER (PARTITION BY k ORDER BY score DESC, track_id) AS place FROM m),
  c AS (SELECT a.k AS i, b.k AS j, corr(a.rk, b.rk) AS c, count(*) FILTER (a.place <= 10 AND b.place <= 10)/count(*) FILTER (a.place <= 10 OR b.place <= 10)::DOUBLE AS o FROM rk a JOIN rk b ON a.track_id = b.track_id AND a.k < b.k GROUP BY ALL),
  s AS (SELECT k, quantile_cont(score, 0.9)/greatest(quantile_cont(score, 0.5), 1e-12::DOUBLE) AS s FROM m GROUP BY k)
  SELECT round((SELECT avg(c) FROM c),6) AS spearman, round((SELECT avg(o) FROM c),6) AS top_overlap, round((SELECT avg(s) FROM s),6) AS separation"""
QUERY["rank_stability"] = "WITH " + QUERY["rank_stability"]

# A stream, however it is cut and out of order, has the rows of the table; so has what is written and read back.
QUERY |= {streamed: QUERY[batch] for streamed, batch in {"grid_streamed": "coverage_levels", "squawk_streamed": "squawk_incidents", "outages_streamed": "outage_from_heartbeats", "pauses_streamed": "poll_pauses", "tracks_streamed": "tracks", "track_features_stored": "track_features"}.items()}
QUERY["jamming_streamed"] = one("jammed")

ORACLES = {name: with_ctes(sql) if not sql.lstrip().upper().startswith("WITH") else with_ctes(sql).replace(" WITH ", ", ", 1) for name, sql in QUERY.items()}
