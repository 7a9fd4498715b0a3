"""Plain DuckDB SQL with the results the registered queries must have.

Written without grids, cells or copies: pairs come from a join on time alone, so
the algorithms are independent of the ones they check.
"""

from __future__ import annotations

from trackspark.plans import derived

# Fixed values, once more as SQL, so that the check does not share them.
_CENTRE = (55.225, 14.245)
_STATUSES = (
    "'At anchor', 'Moored', 'Aground', 'Not under command', 'Reserved for future use',"
    " 'Unknown value', 'Restricted maneuverability'"
)
_KEYWORDS = ("PILOT", "KBV", "RESCUE", "SAR", "SVITZER", "TUG")
_SHIP_TYPES = "'Pilot', 'Pilot vessel', 'Tug', 'SAR', 'Search and rescue', 'Law enforcement', 'Port tender'"
_PAIR = "mmsi1, mmsi2"
_TRACK = "event_id, role, mmsi"


def _stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str, diameter: str) -> str:
    return (
        f"{diameter} * asin(sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2), 2)))"
    )


def _box(kind: str) -> str:
    lat, lon = (f"{x}e0" for x in _CENTRE)
    if kind == "reference":
        height, width = "92.6e0 / 111.32e0", f"92.6e0 / (111.32e0 * cos(radians({lat})))"
    else:
        height, width = "degrees(92.6e0 / 6371e0) + 1e-9", f"degrees(asin(sin(92.6e0 / 6371e0) / cos(radians({lat})))) + 1e-9"
    return f"abs(lat - {lat}) <= {height} AND abs(lon - {lon}) <= {width}"


_KM = _haversine("lat", "lon", "55.225e0", "14.245e0", "12742e0")
_CIRCLE = f"{_KM} <= 92.6e0"
_SERVICE_NAME = " OR ".join(f"contains(upper(coalesce(name, '')), '{k}')" for k in _KEYWORDS)
_RULES = [
    ("mobile_class", "Type_of_mobile IN ('Class A', 'Class B')"),
    ("period", "month(ts) = 12 AND year(ts) = 2021"),
    ("valid_coordinates", "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)"),
    ("sar_aircraft", "NOT (MMSI LIKE '111%' AND length(MMSI) = 9)"),
    ("bbox", _box("reference")),
    ("radius", _CIRCLE),
    ("moving", "sog >= 0.5e0"),
    ("nav_status", f"Navigational_status NOT IN ({_STATUSES})"),
    ("sog_anomaly", "sog <= 102e0"),
    ("identity", "mmsi_no IS NOT NULL AND ts IS NOT NULL"),
]


def _pairs(source: str, same_time: str) -> str:
    dist = _haversine("a.lat", "a.lon", "b.lat", "b.lon", "12742000e0")
    return f"""SELECT * FROM (
  SELECT a.mmsi AS mmsi1, b.mmsi AS mmsi2, a.ts AS ts1, b.ts AS ts2,
    a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, a.name AS name1, b.name AS name2,
    a.sog AS sog1, b.sog AS sog2, abs(a.sec - b.sec) AS dt_sec, {dist} AS dist_m,
    (a.lat + b.lat) / 2e0 AS collision_lat, (a.lon + b.lon) / 2e0 AS collision_lon,
    least(a.ts, b.ts) AS collision_ts
  FROM {source} a JOIN {source} b ON {same_time} AND a.mmsi < b.mmsi
  WHERE a.sog >= 2e0 AND b.sog >= 2e0 AND abs(a.sec - b.sec) <= 30)
WHERE dist_m > 1e0 AND dist_m <= 300e0"""


_BUCKET = "a.sec // 60 = b.sec // 60"
_WINDOW = "a.sec BETWEEN b.sec - 30 AND b.sec + 30"
_SEC = "CAST(floor(epoch(ts)) AS BIGINT) AS sec"


def _ctes() -> str:
    parts = {
        **derived.duckdb_ctes(),
        "typed": """SELECT *, try_strptime(Timestamp, '%d/%m/%Y %H:%M:%S') AS ts,
  TRY_CAST(Latitude AS DOUBLE) AS lat, TRY_CAST(Longitude AS DOUBLE) AS lon, TRY_CAST(SOG AS DOUBLE) AS sog_no,
  TRY_CAST(COG AS DOUBLE) AS cog_no, TRY_CAST(Heading AS DOUBLE) AS heading_no,
  TRY_CAST(MMSI AS BIGINT) AS mmsi_no FROM reports""",
        "kept": "SELECT * FROM (SELECT * REPLACE (sog_no AS SOG) FROM typed) WHERE "
        + " AND ".join(f"({rule})" for _, rule in _RULES),
        "cleaned": """SELECT mmsi_no AS mmsi, ts, lat, lon, SOG AS sog, cog_no AS cog, heading_no AS heading,
  Navigational_status AS nav_status, Name AS name, Ship_type AS ship_type, event_id FROM kept""",
        "uniq": f"""SELECT * EXCLUDE (rn), {_SEC} FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi, ts ORDER BY event_id) AS rn FROM cleaned) WHERE rn = 1""",
        "ufix": f"""SELECT * EXCLUDE (rn), {_SEC} FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi, ts ORDER BY event_id) AS rn FROM fixes) WHERE rn = 1""",
        "civil": f"SELECT * FROM uniq WHERE NOT ({_SERVICE_NAME}) AND coalesce(ship_type, '') NOT IN ({_SHIP_TYPES})",
        "close": _pairs("ufix", _BUCKET),
        "close_exact": _pairs("ufix", _WINDOW),
        "cand": _pairs("civil", _BUCKET),
        "cand_exact": _pairs("civil", _WINDOW),
        "obs": f"SELECT {_PAIR}, count(*) AS n_obs FROM cand GROUP BY ALL",
        "ranked": f"""SELECT * EXCLUDE (rn) FROM (
  SELECT cand.*, n_obs, row_number() OVER (PARTITION BY {_PAIR} ORDER BY dist_m, ts1, ts2) AS rn
  FROM cand JOIN obs USING ({_PAIR})) WHERE rn = 1""",
        "modal": """SELECT mmsi, name AS modal_name FROM (
  SELECT mmsi, name, row_number() OVER (PARTITION BY mmsi ORDER BY count(*) DESC, name) AS rn
  FROM uniq WHERE name IS NOT NULL AND name NOT IN ('', 'Unknown') GROUP BY mmsi, name) WHERE rn = 1""",
        "roles": """SELECT concat(mmsi1, '-', mmsi2) AS event_id, 'vessel1' AS role, mmsi1 AS vessel, collision_ts
  FROM ranked WHERE n_obs <= 5 UNION ALL
  SELECT concat(mmsi1, '-', mmsi2), 'vessel2', mmsi2, collision_ts FROM ranked WHERE n_obs <= 5""",
        # Sailing, lying and silent vessels: the rules but for speed and status.
        "lying": "SELECT mmsi_no AS mmsi, ts, lat, lon, sog_no AS sog, Navigational_status AS nav_status, event_id FROM typed WHERE "
        + " AND ".join(f"({rule})" for name, rule in _RULES if name not in ("moving", "nav_status", "sog_anomaly")) + " AND sog_no <= 102e0",
        "heard": f"""SELECT * EXCLUDE (rn), {_SEC},
    CASE WHEN nav_status IN ({_STATUSES}) OR sog < 0.5e0 THEN 'stopped' ELSE 'under way' END AS state FROM (
  SELECT *, row_number() OVER (PARTITION BY mmsi, ts ORDER BY event_id) AS rn FROM lying) WHERE rn = 1""",
        "told": """SELECT *, lag(sec) OVER w AS before, lag(ts) OVER w AS before_ts, lag(state) OVER w AS was FROM heard WINDOW w AS (PARTITION BY mmsi ORDER BY sec)""",
        "stretches": """SELECT mmsi, state, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS n_fixes FROM (
    SELECT *, count(*) FILTER (was IS NULL OR was <> state OR sec - before > 600) OVER (PARTITION BY mmsi ORDER BY sec) AS stretch FROM told)
  GROUP BY mmsi, state, stretch
  UNION ALL SELECT mmsi, 'silent', before_ts, ts, 0 FROM told WHERE sec - before > 600""",
        "track": """SELECT event_id, role, mmsi, ts, lat, lon, sog, cog
  FROM roles JOIN (SELECT * EXCLUDE (event_id) FROM uniq) ON mmsi = vessel
   AND ts BETWEEN collision_ts - INTERVAL 10 MINUTE AND collision_ts + INTERVAL 10 MINUTE""",
    }
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in parts.items()) + "\n"


def _candidates(source: str, extra: str = "") -> str:
    return f"""SELECT mmsi1, mmsi2, {_stamp('ts1')} AS ts1, {_stamp('ts2')} AS ts2,
  round(lat1, 8) AS lat1, round(lon1, 8) AS lon1, round(lat2, 8) AS lat2, round(lon2, 8) AS lon2, name1, name2,
  round(sog1, 8) AS sog1, round(sog2, 8) AS sog2, dt_sec, round(dist_m, 3) AS dist_m,
  round(collision_lat, 8) AS collision_lat, round(collision_lon, 8) AS collision_lon,
  {_stamp('collision_ts')} AS collision_ts{extra} FROM {source}"""


def _events(source: str, stamp: str, name1: str = "name1", name2: str = "name2") -> str:
    return f"""SELECT mmsi1, mmsi2, {name1} AS name1, {name2} AS name2, {stamp} AS collision_ts,
  round(collision_lat, 8) AS collision_lat, round(collision_lon, 8) AS collision_lon,
  round(dist_m, 3) AS min_distance_m FROM {source}"""


def _named(source: str) -> str:
    def name(i: int) -> str:
        return (
            f"CASE WHEN name{i} IS NOT NULL AND trim(name{i}) NOT IN ('', 'Unknown', 'None') THEN name{i}"
            f" ELSE coalesce(m{i}.modal_name, concat('MMSI ', mmsi{i})) END"
        )
    joined = f"{source} LEFT JOIN modal m1 ON m1.mmsi = mmsi1 LEFT JOIN modal m2 ON m2.mmsi = mmsi2"
    return _events(joined, _stamp("collision_ts"), name(1), name(2))


def _fix_columns(extra: str = "") -> str:
    return (
        f"mmsi, {_stamp('ts')} AS ts, round(lat, 8) AS lat, round(lon, 8) AS lon, round(sog, 8) AS sog,"
        f" round(cog, 8) AS cog, round(heading, 8) AS heading, nav_status, name, ship_type{extra}"
    )


def _waterfall() -> str:
    lines = ["SELECT 0 AS stage_no, 'raw' AS stage, count(*) AS n FROM typed"]
    for i, (stage, _) in enumerate(_RULES, 1):
        passed = " AND ".join(f"({rule})" for _, rule in _RULES[:i])
        lines.append(
            f"SELECT {i}, '{stage}', count(*) FROM (SELECT * REPLACE (sog_no AS SOG) FROM typed) WHERE {passed}"
        )
    return "\nUNION ALL ".join(lines)


_POINT = "round(lat, 8) AS Latitude, round(lon, 8) AS Longitude"
_WORDS = "|".join(_KEYWORDS)
_TRANSIENT = "(SELECT * FROM ranked WHERE n_obs <= 5)"
_KEY = f"mmsi1, mmsi2, {_stamp('ts1')} AS ts1, {_stamp('ts2')} AS ts2"


def _jumps() -> str:
    far = _haversine("r.y", "r.x", "n.lat", "n.lon", "12742000e0") + " > 25e0 * 1852e0 / 3600e0 * greatest(n.sec - r.s, 1)"
    return f""", numbered AS (SELECT mmsi, ts, lat, lon, sec, row_number() OVER (PARTITION BY mmsi ORDER BY sec) AS i FROM ufix),
steps AS (
  SELECT mmsi, ts, lat, lon, i, true AS plausible, sec AS s, lat AS y, lon AS x, 0 AS refused FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.mmsi, n.ts, n.lat, n.lon, n.i, NOT bad, if(bad, r.s, n.sec), if(bad, r.y, n.lat), if(bad, r.x, n.lon), if(bad, r.refused + 1, 0)
  FROM steps r JOIN numbered n ON n.mmsi = r.mmsi AND n.i = r.i + 1, LATERAL (SELECT r.refused < 2 AND {far} AS bad))
SELECT mmsi, {_stamp('ts')} AS ts, round(lat, 8) AS lat, round(lon, 8) AS lon, plausible FROM steps"""


def _bodies() -> dict[str, str]:
    return {
        "coerce_fix_types": f"""SELECT event_id, {_POINT}, round(sog_no, 8) AS SOG, round(cog_no, 8) AS COG,
  round(heading_no, 8) AS Heading FROM typed""",
        "parse_fix_timestamp": f"SELECT event_id, Timestamp, {_stamp('ts')} AS ts FROM typed",
        "canonical_fixes": f"""SELECT {_fix_columns(', event_id')} FROM (
  SELECT mmsi_no AS mmsi, ts, lat, lon, sog_no AS sog, cog_no AS cog, heading_no AS heading,
    Navigational_status AS nav_status, Name AS name, Ship_type AS ship_type, event_id FROM typed)""",
        "fixes_per_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM uniq GROUP BY 1",
        "filter_mobile_class": "SELECT event_id, Type_of_mobile FROM reports WHERE Type_of_mobile IN ('Class A', 'Class B')",
        "filter_month": f"""SELECT o_orderkey AS event_id, {_stamp('o_orderdate')} AS ts FROM orders
  WHERE month(o_orderdate) = 12""",
        "filter_year_month": f"""SELECT o_orderkey AS event_id, {_stamp('o_orderdate')} AS ts FROM orders
  WHERE month(o_orderdate) = 12 AND year(o_orderdate) = 1997""",
        "filter_valid_coordinates": f"SELECT event_id, {_POINT} FROM typed WHERE {dict(_RULES)['valid_coordinates']}",
        "filter_sar_aircraft": f"SELECT event_id, MMSI FROM reports WHERE {dict(_RULES)['sar_aircraft']}",
        "filter_bbox": f"SELECT event_id, {_POINT} FROM typed WHERE {_box('reference')}",
        "filter_radius": f"SELECT event_id, {_POINT} FROM typed WHERE {_box('reference')} AND {_CIRCLE}",
        "filter_radius_enclosing": f"SELECT event_id, {_POINT} FROM typed WHERE {_CIRCLE}",
        "filter_moving": "SELECT event_id, round(sog_no, 8) AS SOG FROM typed WHERE sog_no >= 0.5e0",
        "filter_nav_status": f"SELECT event_id, Navigational_status FROM reports WHERE Navigational_status NOT IN ({_STATUSES})",
        "filter_sog_anomaly": "SELECT event_id, round(sog_no, 8) AS SOG FROM typed WHERE sog_no <= 102e0",
        "filter_service_names": f"SELECT event_id, name FROM fixes WHERE NOT ({_SERVICE_NAME})",
        "filter_service_names_word": f"""SELECT event_id, name FROM fixes
  WHERE NOT regexp_matches(upper(coalesce(name, '')), '\\b({_WORDS})\\b')""",
        "filter_ship_types": f"SELECT event_id, ship_type FROM fixes WHERE coalesce(ship_type, '') NOT IN ({_SHIP_TYPES})",
        "clean_fixes": f"SELECT {_fix_columns(', event_id')} FROM cleaned",
        "clean_waterfall": _waterfall(),
        "dedupe_fixes": f"SELECT {_fix_columns(', event_id')} FROM uniq",
        "trig_functions": """SELECT event_id, round(radians(lat), 8) AS rad, round(sin(radians(lat)), 8) AS sine,
  round(cos(radians(lat)), 8) AS cosine, round(asin(sin(radians(lat))), 8) AS arcsine,
  round(sqrt(lat), 8) AS root, round(pow(sin(radians(lat)), 2), 8) AS square FROM fixes""",
        "haversine_to_point": f"SELECT event_id, round({_KM}, 6) AS dist_km FROM fixes",
        "haversine_pair": "SELECT event_id, round("
        + _haversine("lat", "lon", "lat + sog / 1000", "lon - cog / 1000", "12742000e0") + ", 3) AS dist_m FROM fixes",
        "time_bucket": "SELECT event_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS time_bucket FROM fixes",
        "grid_cell": """SELECT event_id, CAST(floor(lat / 0.01e0) AS INTEGER) AS grid_x,
  CAST(floor(lon / 0.01e0) AS INTEGER) AS grid_y FROM fixes""",
        "normalise_headers": """SELECT event_id, Timestamp, Type_of_mobile, MMSI, Latitude, Longitude, SOG, COG, Heading,
  Navigational_status, Name, Ship_type FROM reports""",
        "neighbour_cells": """SELECT event_id, CAST(floor(lat / 0.01e0) AS INTEGER) + x.d AS join_gx,
  CAST(floor(lon / 0.01e0) AS INTEGER) + y.d AS join_gy
  FROM fixes, (VALUES (-1), (0), (1)) x(d), (VALUES (-1), (0), (1)) y(d)""",
        "proximity_pairs": _candidates("close"),
        "proximity_pairs_exact": _candidates("close_exact"),
        "pair_time_gap": f"SELECT {_KEY}, dt_sec AS gap_s FROM close",
        "pair_midpoint": f"""SELECT {_KEY}, round((lat1 + lat2) / 2e0, 8) AS mid_lat,
  round((lon1 + lon2) / 2e0, 8) AS mid_lon FROM close""",
        "pair_first_ts": f"SELECT {_KEY}, {_stamp('CASE WHEN ts1 <= ts2 THEN ts1 ELSE ts2 END')} AS first_ts FROM close",
        "find_candidates": _candidates("cand"),
        "find_candidates_exact": _candidates("cand_exact"),
        "dedupe_candidates": _candidates("close_exact"),
        "union_daily_candidates": _candidates("cand"),
        "pair_days": f"""SELECT {_PAIR}, strftime(collision_ts, '%Y-%m-%d') AS day, count(*) AS n_obs, round(min(dist_m), 3) AS dist_m,
  {_stamp('arg_min(ts1, dist_m)')} AS ts1, {_stamp('arg_min(ts2, dist_m)')} AS ts2 FROM cand GROUP BY mmsi1, mmsi2, day""",
        "approaches_of_stored_days": _candidates(_TRANSIENT, ", n_obs"),
        "stored_reports": f"""SELECT {_stamp('ts')} AS ts, MMSI, {_POINT}, round(sog_no, 8) AS SOG, round(cog_no, 8) AS COG,
  round(heading_no, 8) AS Heading, Type_of_mobile FROM typed""",
        "stored_fixes": f"SELECT {_fix_columns()}, strftime(ts, '%Y-%m-%d') AS day FROM uniq",
        "stored_fixes_of_days": f"SELECT {_fix_columns()}, strftime(ts, '%Y-%m-%d') AS day FROM uniq WHERE day(ts) IN (1, 2)",
        "clustered_box": f"""SELECT {_fix_columns()}, strftime(ts, '%Y-%m-%d') AS day FROM uniq
  WHERE lat BETWEEN 54.753e0 AND 54.8e0 AND lon BETWEEN 13.4515e0 AND 13.454e0""",
        "pairs_of_stored_cells": _candidates("close"),
        "replaced_days": f"SELECT {_fix_columns()}, strftime(ts, '%Y-%m-%d') AS day FROM uniq WHERE day(ts) <> 1 OR sog > 10",
        "stored_candidates": _candidates("cand", ", strftime(collision_ts, '%Y-%m-%d') AS day"),
        "written_rows": "SELECT 'fixes' AS name, count(*) AS n FROM uniq UNION ALL SELECT 'candidates', count(*) FROM cand",
        "flag_jumps": _jumps(),
        "collapse_repeats": f"""SELECT mmsi, {_stamp('arg_min(ts, sec)')} AS ts, round(arg_min(lat, sec), 8) AS lat, round(arg_min(lon, sec), 8) AS lon,
  round(arg_min(sog, sec), 8) AS sog, min(struct_pack(s := sec, name := name)).name AS name, count(*) AS n_reports FROM (
    SELECT *, count(*) FILTER (coalesce(sec - s0 > 20 OR {_haversine('y0', 'x0', 'lat', 'lon', '12742000e0')} > 200, true)) OVER (PARTITION BY mmsi ORDER BY sec) AS run FROM (
      SELECT *, lag(sec) OVER w AS s0, lag(lat) OVER w AS y0, lag(lon) OVER w AS x0 FROM ufix WINDOW w AS (PARTITION BY mmsi ORDER BY sec)))
  GROUP BY mmsi, run""",
        "movement_states": f"SELECT mmsi, state, {_stamp('from_ts')} AS from_ts, {_stamp('to_ts')} AS to_ts, n_fixes FROM stretches",
        "track_endings": """SELECT event_id, role, vessel AS mmsi,
  CASE WHEN max(to_ts) FILTER (from_ts <= ends) IS NULL OR ends - arg_max(to_ts, (from_ts, to_ts)) FILTER (from_ts <= ends) > INTERVAL 600 SECOND THEN 'silent'
    ELSE arg_max(state, (from_ts, to_ts)) FILTER (from_ts <= ends) END AS ending
  FROM (SELECT *, collision_ts + INTERVAL 600 SECOND AS ends FROM roles) r LEFT JOIN stretches s ON s.mmsi = r.vessel GROUP BY event_id, role, vessel, ends""",
        "pair_observation_counts": "SELECT * FROM obs",
        "transient_pairs": "SELECT * FROM obs WHERE n_obs <= 5",
        "persistent_pairs": "SELECT * FROM obs WHERE n_obs > 5",
        "candidates_of_transient_pairs": _candidates(f"cand JOIN obs USING ({_PAIR}) WHERE n_obs <= 5"),
        "closest_approach": _candidates(_TRANSIENT, ", n_obs"),
        "closest_event": _named(
            f"(SELECT * FROM ranked WHERE n_obs <= 200 ORDER BY dist_m, {_PAIR}, ts1, ts2 LIMIT 1)"
        ),
        "top_k_events": _events(
            f"(SELECT * FROM {_TRANSIENT} ORDER BY dist_m, {_PAIR}, ts1, ts2 LIMIT 20)", _stamp("collision_ts")
        ),
        "modal_name": "SELECT * FROM modal",
        "resolve_names": _named(_TRANSIENT),
        "event_json_fields": _events(_TRANSIENT, "strftime(collision_ts, '%Y-%m-%dT%H:%M:%SZ')"),
        "event_display_fields": f"""SELECT {_PAIR}, name1, name2,
  strftime(collision_ts, '%Y-%m-%d %H:%M:%S UTC') AS time_text, printf('%.6f', collision_lat) AS lat_text,
  printf('%.6f', collision_lon) AS lon_text, printf('%.1f', dist_m) AS distance_text FROM {_TRANSIENT}""",
        "trajectories": f"""SELECT {_TRACK}, {_stamp('ts')} AS ts, round(lat, 8) AS lat, round(lon, 8) AS lon,
  round(sog, 8) AS sog, round(cog, 8) AS cog FROM track""",
        "trajectory_counts": f"SELECT {_TRACK}, count(*) AS n_fixes FROM track GROUP BY ALL",
        "trajectory_segments": f"""SELECT {_TRACK}, {_stamp('ts')} AS from_ts, round(lat, 8) AS from_lat,
  round(lon, 8) AS from_lon, {_stamp('ts2')} AS to_ts, round(lat2, 8) AS to_lat, round(lon2, 8) AS to_lon,
  round(0.3e0 + 0.7e0 * (i - 1) / greatest(n - 1, 1), 8) AS alpha FROM (
    SELECT *, lead(ts) OVER w AS ts2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2,
      row_number() OVER w AS i, count(*) OVER (PARTITION BY {_TRACK}) AS n
    FROM track WINDOW w AS (PARTITION BY {_TRACK} ORDER BY ts)) WHERE ts2 IS NOT NULL""",
        "trajectory_age_ramp": f"""SELECT {_TRACK}, {_stamp('ts')} AS ts,
  round(0.3e0 + 0.7e0 * (i - 1) / greatest(n - 1, 1), 8) AS alpha FROM (
    SELECT *, row_number() OVER (PARTITION BY {_TRACK} ORDER BY ts) AS i,
      count(*) OVER (PARTITION BY {_TRACK}) AS n FROM track)""",
        "trajectory_endpoints": f"""SELECT {_TRACK}, {_stamp('min(ts)')} AS start_ts,
  round(arg_min(lat, ts), 8) AS start_lat, round(arg_min(lon, ts), 8) AS start_lon, {_stamp('max(ts)')} AS end_ts,
  round(arg_max(lat, ts), 8) AS end_lat, round(arg_max(lon, ts), 8) AS end_lon FROM track GROUP BY {_TRACK}""",
        "trajectory_polyline": f"""SELECT {_TRACK}, count(*) AS n_points,
  string_agg(printf('%.6f %.6f', lat, lon), ',' ORDER BY ts) AS line_text FROM track GROUP BY {_TRACK}""",
        "trajectory_popup_fields": f"""SELECT {_TRACK}, {_stamp('ts')} AS ts, round(lat, 8) AS lat, round(lon, 8) AS lon,
  strftime(ts, '%H:%M:%S') AS time_text, printf('%.1f', sog) AS sog_text, printf('%.1f', cog) AS cog_text FROM track""",
        "speed_series": f"SELECT {_TRACK}, {_stamp('ts')} AS ts, round(sog, 8) AS sog FROM track",
    }


def oracle_sql() -> dict[str, str]:
    ctes = _ctes()
    return {name: _with(ctes, body) for name, body in _bodies().items()}


def _with(ctes: str, body: str) -> str:
    """A body that starts with a comma goes on with tables of its own, which may refer to themselves."""
    return ctes.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + body if body.startswith(",") else ctes + body
