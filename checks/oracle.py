"""The registered queries as SQL over the given tables.

Written independently of the DataFrame code: distinct-then-count instead of bit masks, row
numbers instead of range partitions, joins instead of array searches.
"""

from __future__ import annotations

import re

ORACLE: dict[str, str] = {}

# Fragments ----------------------------------------------------------------------------------

CTE: dict[str, str] = {}

CTE["cdr"] = """
    SELECT event_id,
           CAST(user_id AS VARCHAR) AS user_id,
           lpad(json_extract_string(props, '$.k'), 5, '0') || '_' || event_type AS start_cell,
           ts AS "date",
           strftime(ts, '%H%M%S') AS "time",
           event_type AS cdr_type,
           CAST(isoyear(ts) AS INTEGER) AS iso_year,
           CAST(weekofyear(ts) AS INTEGER) AS iso_week
    FROM events"""

CTE["cells"] = """
    SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS cell_id,
           CAST(n_regionkey AS VARCHAR) AS region
    FROM nation"""

CTE["full_cells"] = """
    SELECT cell_id || '_' || kind AS cell_id, region
    FROM cells, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS k(kind)"""

CTE["placed"] = """
    SELECT c.*, z.region
    FROM cdr c JOIN cells z ON substr(c.start_cell, 1, 5) = z.cell_id"""

# Study weeks 2024-W01 .. 2024-W05 in windows of four.
CTE["weeks"] = """
    SELECT CAST(isoyear(d) AS INTEGER) AS iso_year,
           CAST(weekofyear(d) AS INTEGER) AS iso_week,
           CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS pos
    FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 7 DAY) AS g(d)"""

CTE["windows"] = """
    SELECT w.iso_year, w.iso_week,
           f.iso_year AS window_year, f.iso_week AS window_week,
           CAST(w.pos % 4 AS INTEGER) AS week_idx,
           CAST(count(*) OVER (PARTITION BY f.pos) AS INTEGER) AS n_weeks
    FROM weeks w JOIN weeks f ON f.pos = w.pos - w.pos % 4"""

CTE["complete"] = """
    SELECT iso_year, iso_week FROM cdr
    GROUP BY iso_year, iso_week HAVING count(DISTINCT isodow("date")) = 7"""

CTE["ranked_complete"] = """
    SELECT *, row_number() OVER (ORDER BY iso_year, iso_week) - 1 AS pos FROM complete"""

CTE["sliding"] = """
    SELECT w.iso_year, w.iso_week,
           f.iso_year AS window_year, f.iso_week AS window_week,
           CAST(w.pos - f.pos AS INTEGER) AS week_idx,
           CAST(count(*) OVER (PARTITION BY f.pos) AS INTEGER) AS n_weeks
    FROM ranked_complete w JOIN ranked_complete f ON w.pos BETWEEN f.pos AND f.pos + 1"""


def _entries(windows: str) -> str:
    return f"""
    SELECT window_year, window_week, n_weeks, region, user_id, week_idx, is_we, slot,
           CAST(count(*) AS INTEGER) AS n_days,
           count(*) / CASE WHEN is_we = 1 THEN 2.0 ELSE 5.0 END AS "value"
    FROM (
        SELECT DISTINCT window_year, window_week, n_weeks, region, user_id, week_idx,
               CASE WHEN isodow("date") IN (7, 1) THEN 1 ELSE 0 END AS is_we,
               CASE WHEN CAST(substr("time", 1, 2) AS INTEGER) <= 8 THEN 0
                    WHEN CAST(substr("time", 1, 2) AS INTEGER) <= 18 THEN 1 ELSE 2 END AS slot,
               isodow("date") AS dow
        FROM placed JOIN {windows} USING (iso_year, iso_week)
    ) days
    GROUP BY window_year, window_week, n_weeks, region, user_id, week_idx, is_we, slot"""


CTE["entries"] = _entries("windows")
CTE["sliding_entries"] = _entries("sliding")


def _dense(index: str) -> str:
    return f"""
    SELECT u.window_year, u.window_week, u.region, u.user_id, CAST(s.i AS INTEGER) AS i,
           coalesce(e."value", 0.0) AS v
    FROM (SELECT DISTINCT window_year, window_week, n_weeks, region, user_id FROM entries) u
    JOIN range(24) AS s(i) ON s.i < 6 * u.n_weeks
    LEFT JOIN entries e
      ON e.window_year = u.window_year AND e.window_week = u.window_week
     AND e.region = u.region AND e.user_id = u.user_id
     AND {index} * 6 + e.is_we * 3 + e.slot = s.i"""


CTE["dense"] = _dense("((e.week_idx - 1 + e.n_weeks) % e.n_weeks)")
CTE["dense_plain"] = _dense("e.week_idx")

# Ordinal, label, then work-day and weekend level of each of the four weeks.
CTE["typical"] = """
    SELECT * FROM (VALUES
        (0, 'resident', [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0]),
        (1, 'resident', [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5]),
        (2, 'resident', [0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]),
        (3, 'dynamic_resident', [0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0]),
        (4, 'dynamic_resident', [0.0, 0.5, 0.0, 0.5, 0.0, 0.5, 0.0, 0.5]),
        (5, 'dynamic_resident', [0.0, 0.1, 0.0, 0.1, 0.0, 0.1, 0.0, 0.1]),
        (6, 'commuter', [1.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0]),
        (7, 'commuter', [0.5, 0.0, 0.5, 0.0, 0.5, 0.0, 0.5, 0.0]),
        (8, 'commuter', [0.1, 0.0, 0.1, 0.0, 0.1, 0.0, 0.1, 0.0]),
        (9, 'visitor', [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]),
        (10, 'visitor', [0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]),
        (11, 'visitor', [0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]),
        (12, 'resident', [1.0, 1.0, 0.5, 0.5, 0.1, 0.1, 0.0, 0.0]),
        (13, 'resident', [0.5, 0.5, 0.1, 0.1, 0.0, 0.0, 0.0, 0.0]),
        (14, 'visitor', [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]),
        (15, 'visitor', [0.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    ) AS t(ordinal, label, levels)"""

CTE["typical_values"] = """
    SELECT ordinal, label, s.i AS i, CAST(levels[s.i // 3 + 1] AS DOUBLE) AS a
    FROM typical, range(24) AS s(i)"""

CTE["distances"] = """
    SELECT window_year, window_week, region, user_id, ordinal, label,
           sum((v - a) * (v - a)) AS d2
    FROM dense JOIN typical_values USING (i)
    GROUP BY ALL"""

CTE["sums"] = """
    SELECT window_year, window_week, region, user_id,
           CAST(count(*) FILTER (WHERE v <> 0) AS INTEGER) AS n_active, sum(v) AS total
    FROM dense GROUP BY ALL"""

CTE["classified"] = """
    SELECT window_year, window_week, region, user_id,
           CASE WHEN n_active = 1 AND total < 0.5 THEN 'passing by' ELSE label END AS user_class
    FROM sums JOIN (
        SELECT *, row_number() OVER (
                   PARTITION BY window_year, window_week, region, user_id
                   ORDER BY round(d2, 9), ordinal) AS nearness
        FROM distances
    ) d USING (window_year, window_week, region, user_id)
    WHERE nearness = 1"""

CTE["shares"] = """
    SELECT window_year, window_week, region, user_class,
           count(*) / sum(count(*)) OVER (PARTITION BY window_year, window_week, region) AS share
    FROM classified GROUP BY window_year, window_week, region, user_class"""

CTE["annotations"] = """
    SELECT user_id, region, user_class FROM (
        SELECT user_id, region, user_class,
               row_number() OVER (PARTITION BY user_id, region
                                  ORDER BY count(*) DESC,
                                           min(window_year * 100 + window_week)) AS place
        FROM classified GROUP BY user_id, region, user_class
    ) ranked WHERE place = 1"""


def _presence(date: str, labels: str = "annotations") -> str:
    return f"""
    SELECT region, "date", coalesce(user_class, 'not classified') AS user_class,
           count(DISTINCT user_id) AS n_users
    FROM (SELECT region, {date} AS "date", user_id FROM placed) p
    LEFT JOIN {labels} USING (user_id, region)
    GROUP BY ALL"""


DAY = "date_trunc('day', \"date\")"
CTE["presence"] = _presence(f"CAST({DAY} AS TIMESTAMP)")
CTE["presence_full"] = _presence('"date"')
CTE["type_labels"] = "SELECT DISTINCT user_id, region, cdr_type AS user_class FROM placed"

CTE["od"] = f"""
    SELECT coalesce(h.region, 'outbound') AS origin, p.region AS destination, p."date",
           count(DISTINCT p.user_id) AS n_users
    FROM (SELECT region, CAST({DAY} AS TIMESTAMP) AS "date", user_id FROM placed) p
    LEFT JOIN (SELECT user_id, region FROM annotations
               WHERE user_class IN ('resident', 'dynamic_resident')) h USING (user_id)
    GROUP BY ALL"""

CTE["calls"] = """
    SELECT {cell} AS id, CAST(hour("date") AS INTEGER) AS "hour",
           CAST(isodow("date") AS INTEGER) AS dow, CAST(dayofyear("date") AS INTEGER) AS doy
    FROM cdr"""
CTE["cell_calls"] = CTE["calls"].format(cell="start_cell")
CTE["calls"] = CTE["calls"].format(cell="cdr_type")

CTE["study"] = "SELECT DISTINCT id AS nidt FROM calls ORDER BY nidt LIMIT 10"
CTE["cell_study"] = "SELECT cell_id AS nidt FROM full_cells"

for _calls, _study, _p in (("calls", "study", ""), ("cell_calls", "cell_study", "cell_")):
    CTE[f"{_p}counts"] = f"""
    SELECT id, "hour", dow, doy, count(*) AS num FROM {_calls} GROUP BY ALL"""
    CTE[f"{_p}base"] = f"""
    SELECT id AS rid, "hour", dow, avg(num) AS num FROM {_p}counts
    WHERE doy BETWEEN 1 AND 21 AND id IN (SELECT nidt FROM {_study}) GROUP BY ALL"""
    CTE[f"{_p}analysis"] = f"""
    SELECT id AS rid, "hour", doy, dow, num FROM {_p}counts
    WHERE doy >= 22 AND id IN (SELECT nidt FROM {_study})"""
    CTE[f"{_p}ratios"] = f"""
    SELECT a.rid, a."hour", a.doy, a.dow,
           (a.num / d.total) / (b.num / w.total) - 1 AS ratio, a.num AS anum, b.num AS bnum
    FROM {_p}analysis a
    JOIN {_p}base b ON a.rid = b.rid AND a."hour" = b."hour" AND a.dow = b.dow
    JOIN (SELECT doy, CAST(sum(num) AS DOUBLE) AS total FROM {_p}analysis GROUP BY doy) d
      ON a.doy = d.doy
    JOIN (SELECT dow, sum(num) AS total FROM {_p}base GROUP BY dow) w ON a.dow = w.dow"""


def _peaks(ratios: str, condition: str) -> str:
    return f"""
    SELECT rid, "hour", doy, dow,
           round(round(round(abs(r / 0.1) - 0.5) * 0.1 * sign(r), 12), 6) AS ratio,
           round(round(abs(ratio), 12), 6) AS abs_ratio, round(round(abs(anum - bnum), 12), 6) AS abs_diff
    FROM (SELECT *, round(ratio, 12) AS r FROM {ratios}) x
    WHERE abs(r) >= 0.2 AND {condition}"""


CTE["obs_presence"] = """
    SELECT 'presence-' || (row_number() OVER (ORDER BY region, "date", user_class) - 1) AS _id,
           CAST(n_users AS VARCHAR) AS "value", strftime("date", '%Y-%m-%d %H:%M:%S') AS "date",
           region AS region_id, user_class AS description,
           'area_presence' AS indicator_id, 'area_presence' AS indicator_name
    FROM presence"""

CTE["obs_od"] = """
    SELECT 'od-' || (row_number() OVER (ORDER BY destination, "date", origin) - 1) AS _id,
           CAST(n_users AS VARCHAR) AS "value", strftime("date", '%Y-%m-%d %H:%M:%S') AS "date",
           origin AS region_id, destination AS description,
           'origin_destination' AS indicator_id, 'origin_destination' AS indicator_name
    FROM od"""

CTE["lines"] = """
    SELECT event_id,
           CASE WHEN cdr_type = 'signup' AND site >= 90
                THEN array_to_string(fields[1:7], ';') ELSE array_to_string(fields, ';') END AS "value",
           cdr_type = 'signup' AND site >= 90 AS cut,
           cdr_type = 'error' AND site < 50 AS broken
    FROM (
        SELECT *, [' ' || user_id, '', '',
                   CASE WHEN cdr_type = 'error' AND site < 50 THEN '2024-02-30 00:00:00'
                        ELSE strftime("date", '%Y-%m-%d %H:%M:%S') END,
                   "time" || chr(9), '0', '', '', '', start_cell, '', cdr_type] AS fields
        FROM (SELECT *, CAST(substr(start_cell, 1, 5) AS INTEGER) AS site FROM cdr) c
    ) f"""

CTE["dense_user"] = """
    SELECT window_year, window_week, user_id, i, avg(v) AS v FROM dense GROUP BY ALL"""
CTE["user_distances"] = """
    SELECT window_year, window_week, user_id, ordinal, label, sum((v - a) * (v - a)) AS d2
    FROM dense_user JOIN typical_values USING (i) GROUP BY ALL"""
CTE["dense_region"] = """
    SELECT window_year, window_week, CAST(region AS INTEGER) AS centroid_id, i, avg(v) AS v
    FROM dense GROUP BY ALL"""
CTE["region_distances"] = """
    SELECT window_year, window_week, centroid_id, ordinal, label,
           count(*) AS n_values, sum(v) AS total, sum((v - a) * (v - a)) AS d2
    FROM dense_region JOIN typical_values USING (i) GROUP BY ALL"""


def _needed(sql: str, order: list[str] | None = None) -> list[str]:
    """Fragments a text reads from, each after those it needs itself."""
    order = [] if order is None else order
    for name in re.findall(r"\b(?:FROM|JOIN)\s+([a-z_]+)", sql):
        if name in CTE and name not in order:
            _needed(CTE[name], order)
            order.append(name)
    return order


def oracle(name: str, sql: str) -> None:
    parts = _needed(sql)
    with_clause = ",\n".join(f"{part} AS ({CTE[part]})" for part in parts)
    ORACLE[name] = (f"WITH {with_clause}\n" if parts else "") + sql


# Queries ------------------------------------------------------------------------------------

PARSED = """user_id, start_cell, '' AS end_cell,
    CAST(strftime("date", '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS "date", """

oracle("cdr_parse", f"""
    SELECT c.event_id, {PARSED} "time", cdr_type, iso_year, iso_week
    FROM cdr c JOIN lines l ON c.event_id = l.event_id WHERE NOT l.cut AND NOT l.broken""")
oracle("cdr_parse_strict", """
    SELECT event_id, user_id, start_cell, cdr_type AS end_cell,
           CAST(strftime("date", '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS "date",
           CAST("time" AS INTEGER) AS "time", iso_year, iso_week
    FROM cdr""")
oracle("cdr_quarantine", 'SELECT event_id, "value" FROM lines WHERE cut OR broken')
oracle("cells_dim", """
    SELECT start_cell AS cell_id, arg_max(user_id, event_id) AS region FROM cdr GROUP BY ALL""")
oracle("sites_dim", """
    SELECT substr(start_cell, 1, 5) AS cell_id, arg_max(user_id, event_id) AS region
    FROM cdr GROUP BY 1""")
oracle("annot_legacy", """
    SELECT user_id, start_cell AS region, cdr_type AS user_class FROM cdr""")
oracle("weeks_in_path", "SELECT DISTINCT iso_year, iso_week FROM cdr")

oracle("calendar_cols", """
    SELECT event_id, iso_year, iso_week, CAST(year("date") AS INTEGER) AS "year",
           CAST(isodow("date") - 1 AS INTEGER) AS dow0, CAST(isodow("date") AS INTEGER) AS dow1,
           CASE WHEN isodow("date") IN (1, 7) THEN 1 ELSE 0 END AS we_mon_sun,
           CASE WHEN isodow("date") >= 6 THEN 1 ELSE 0 END AS we_sat_sun,
           CASE WHEN isodow("date") < 6 THEN 1 ELSE 0 END AS we_mon_fri,
           CASE WHEN hour("date") < 9 THEN 0 WHEN hour("date") < 19 THEN 1 ELSE 2 END AS slot,
           CASE WHEN hour("date") < 8 THEN 1 WHEN hour("date") < 19 THEN 2 ELSE 3 END AS slot_sql,
           CAST(dayofyear("date") AS INTEGER) AS doy, CAST(hour("date") AS INTEGER) AS hour_of_day,
           CAST(date_trunc('day', "date") AS TIMESTAMP) AS "day",
           CAST(date_trunc('hour', "date") AS TIMESTAMP) AS full_hour
    FROM cdr""")
oracle("site_prefix", """
    SELECT left(start_cell, 5) AS site, left(cdr_type, 5) AS kind,
           CASE WHEN length(cdr_type) < 5 THEN 'invalid' ELSE left(cdr_type, 5) END AS kind_strict,
           count(*) AS n
    FROM cdr GROUP BY ALL""")
oracle("region_exact", """
    SELECT event_id, user_id, start_cell, region
    FROM cdr c JOIN full_cells z ON c.start_cell = z.cell_id""")
for _name in ("region_prefix", "region_prefix_shuffled", "region_prefix_prefiltered"):
    oracle(_name, "SELECT event_id, user_id, start_cell, region FROM placed")

oracle("week_calendar", """
    SELECT CAST(row_number() OVER (ORDER BY d) - 1 AS INTEGER) AS pos,
           CAST(date_trunc('week', d) AS DATE) AS monday,
           CAST(isoyear(d) AS INTEGER) AS iso_year, CAST(weekofyear(d) AS INTEGER) AS iso_week
    FROM (SELECT unnest(generate_series(date_trunc('day', min(o_orderdate)),
                                        date_trunc('day', max(o_orderdate)), INTERVAL 7 DAY)) AS d
          FROM orders) s""")
for _name in ("windows_tumbling", "windows_tumbling_joined"):
    oracle(_name, """
    SELECT event_id, window_year, window_week, n_weeks, week_idx
    FROM cdr JOIN windows USING (iso_year, iso_week)""")
oracle("windows_sliding", """
    SELECT event_id, window_year, window_week, n_weeks, week_idx
    FROM cdr JOIN sliding USING (iso_year, iso_week)""")
oracle("complete_weeks", "SELECT * FROM complete")
oracle("weeks_available", "SELECT DISTINCT iso_year, iso_week FROM cdr")

oracle("user_profile_sql", """
    SELECT user_id, region, iso_week AS week,
           CASE WHEN isodow("date") >= 6 THEN 1 ELSE 0 END AS weekday,
           CASE WHEN hour("date") < 8 THEN 1 WHEN hour("date") < 19 THEN 2 ELSE 3 END AS time_slot,
           count(DISTINCT CAST("date" AS DATE)) AS n_days
    FROM placed WHERE iso_week BETWEEN 1 AND 4 GROUP BY ALL""")
ENTRY = """window_year, window_week, region, user_id, week_idx, is_we, slot, n_days,
    CAST("value" AS DOUBLE) AS "value\""""
oracle("user_profile", f"SELECT {ENTRY} FROM entries")
oracle("user_profile_sliding", f"SELECT {ENTRY} FROM sliding_entries")
VECTOR = "string_agg(printf('%.1f', CAST(v AS DOUBLE)), ' ' ORDER BY i) AS profile"
oracle("user_profile_vector", f"""
    SELECT window_year, window_week, region, user_id, {VECTOR} FROM dense GROUP BY ALL""")
oracle("user_profile_vector_documented", f"""
    SELECT window_year, window_week, region, user_id, {VECTOR} FROM dense_plain GROUP BY ALL""")
oracle("archetype_distance", """
    SELECT window_year, window_week, region, user_id, ordinal, label, round(sqrt(d2), 6) AS distance
    FROM distances""")
oracle("passing_by", """
    SELECT window_year, window_week, region, user_id, n_active,
           round(CAST(total AS DOUBLE), 6) AS total,
           CASE WHEN n_active = 1 AND total < 0.5 THEN 1 ELSE 0 END AS passing_by
    FROM sums""")
oracle("label_centroids", """
    SELECT window_year, window_week, user_id, label FROM (
        SELECT *, row_number() OVER (PARTITION BY window_year, window_week, user_id
                                     ORDER BY round(d2, 9), ordinal) AS nearness
        FROM user_distances) d
    WHERE nearness = 1""")
oracle("classify", "SELECT * FROM classified")
ORACLE["classify_joined"] = ORACLE["classify"]
oracle("sociometer", """
    SELECT window_year, window_week, region, user_class, round(CAST(share AS DOUBLE), 6) AS share
    FROM shares""")
oracle("annotation_mode", "SELECT * FROM annotations")

_FITTED = f"""
    SELECT window_year, window_week, {{centers}} AS n_centers, count(*) AS n_profiles,
           CAST(count(DISTINCT profile) > 1 AS INTEGER) AS below_mean
    FROM (SELECT window_year, window_week, region, user_id, {VECTOR} FROM dense GROUP BY ALL) v
    GROUP BY ALL"""
oracle("kmeans", _FITTED.format(centers="least(20, count(DISTINCT profile))"))
oracle("kmeans_sampled", _FITTED.format(centers="1"))
oracle("sociometer_trained", """
    SELECT window_year, window_week, region, count(*) AS n_users, CAST(1 AS DOUBLE) AS total, 1 AS known
    FROM classified GROUP BY ALL""")

oracle("presence_users", f"""
    SELECT DISTINCT user_id, region, CAST({DAY} AS TIMESTAMP) AS "date" FROM placed""")
oracle("presence", "SELECT * FROM presence")
oracle("presence_merged", "SELECT * FROM presence")
oracle("presence_all_regions", f"""
    SELECT CAST({DAY} AS TIMESTAMP) AS "date", coalesce(user_class, 'not classified') AS user_class,
           count(DISTINCT user_id) AS n_users
    FROM placed LEFT JOIN annotations USING (user_id, region)
    GROUP BY ALL""")
oracle("presence_full_time", "SELECT * FROM presence_full")
oracle("presence_repeated_labels", _presence(f"CAST({DAY} AS TIMESTAMP)", "type_labels"))
oracle("od_matrix", "SELECT * FROM od")
HOURLY = """count(DISTINCT user_id || ' ' || start_cell) AS n_calls,
    array_to_string(list_sort(list(DISTINCT start_cell)), ' ') AS cells"""
oracle("hourly_activity", f"""
    SELECT region, CAST({DAY} AS TIMESTAMP) AS "date", substr("time", 1, 2) AS "hour", {HOURLY}
    FROM placed GROUP BY 1, 2, 3""")
oracle("hourly_activity_full_time", f"""
    SELECT region, "date", substr("time", 1, 2) AS "hour", {HOURLY} FROM placed GROUP BY 1, 2, 3""")

oracle("study_cells", "SELECT DISTINCT id AS nidt FROM cell_calls ORDER BY nidt LIMIT 10")
oracle("peak_counts", "SELECT * FROM counts")
oracle("peak_base", 'SELECT rid, "hour", dow, round(num, 6) AS num FROM base')
oracle("peak_analysis", "SELECT * FROM analysis")
oracle("peak_ratio", """
    SELECT rid, "hour", doy, dow, round(round(ratio, 12), 6) AS ratio, anum, round(bnum, 6) AS bnum FROM ratios""")
oracle("peaks", _peaks("ratios", "r > 0 AND abs(anum - bnum) >= 2"))
oracle("peaks_by_cell", _peaks("cell_ratios", "abs(anum - bnum) >= 0"))



def _yearly_peaks(source: str, condition: str = "true") -> str:
    """Peaks of all cells in both directions, each year against its own base."""
    return f"""
    SELECT rid, "hour", doy, dow, "year",
           round(round(round(abs(r / 0.1) - 0.5) * 0.1 * sign(r), 12), 6) AS ratio,
           round(round(abs(raw), 12), 6) AS abs_ratio,
           round(round(abs(anum - bnum), 12), 6) AS abs_diff
    FROM (
        SELECT *, round(raw, 12) AS r FROM (
            SELECT a.id AS rid, a."hour", a.doy, a.dow, a."year", a.num AS anum, b.num AS bnum,
                   (a.num / a.total) / (b.num / b.total) - 1 AS raw
            FROM (SELECT *, CAST(sum(num) OVER (PARTITION BY "year", doy) AS DOUBLE) AS total
                  FROM yearly_{source} WHERE doy >= 22 AND {condition}) a
            JOIN (SELECT *, sum(num) OVER (PARTITION BY "year", dow) AS total FROM (
                      SELECT id, "hour", dow, "year", avg(num) AS num FROM yearly_{source}
                      WHERE doy BETWEEN 1 AND 21 AND {condition} GROUP BY ALL) m) b
              USING (id, "hour", dow, "year")) x) y
    WHERE abs(r) >= 0.2"""


for _name, _from in (
    ("one", 'SELECT start_cell, "date" FROM cdr'),
    ("two", """SELECT start_cell, "date" FROM cdr UNION ALL
               SELECT start_cell, "date" + INTERVAL 1 YEAR FROM cdr
               WHERE CAST(user_id AS BIGINT) % 2 = 0"""),
):
    CTE[f"yearly_{_name}"] = f"""
    SELECT start_cell AS id, CAST("hour"("date") AS INTEGER) AS "hour",
           CAST(isodow("date") AS INTEGER) AS dow, CAST(dayofyear("date") AS INTEGER) AS doy,
           CAST("year"("date") AS INTEGER) AS "year", count(*) AS num
    FROM ({_from}) c GROUP BY ALL"""
oracle("peaks_all_cells", _yearly_peaks("one", "doy BETWEEN 3 AND 28"))
oracle("peaks_split_clock", _yearly_peaks("one"))
oracle("peaks_two_years", _yearly_peaks("two"))

oracle("obs_presence", "SELECT * FROM obs_presence")
oracle("obs_od", "SELECT * FROM obs_od")
SOCIO_ID = """'sociometer-' || (row_number() OVER (
    ORDER BY window_year, window_week, region, user_class) - 1) AS _id"""
ISO_SUNDAY = """strftime(date_trunc('week', make_date(window_year, 1, 4))
    + to_days(CAST((window_week - 1) * 7 + 6 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS "date\""""
oracle("obs_sociometer", f"""
    SELECT {SOCIO_ID}, round(CAST(share AS DOUBLE), 6) AS "value", {ISO_SUNDAY}, region AS region_id,
           user_class AS description, 'category_percentage' AS indicator_id,
           'category_percentage' AS indicator_name
    FROM shares""")
# 2024 starts on a Monday: weeks counted from the first Monday are the ISO weeks.
oracle("obs_sociometer_legacy", f"SELECT {SOCIO_ID}, {ISO_SUNDAY}, region AS region_id FROM shares")

oracle("obs_sociometer_legacy_years", f"""
    SELECT {SOCIO_ID}, strftime(d, '%Y-%m-%d %H:%M:%S') AS "date", region AS region_id
    FROM (SELECT y AS window_year, window_week, region, user_class
          FROM shares, (VALUES (2014), (2015), (2019), (2020)) AS v(y)) s
    JOIN (SELECT CAST(d AS TIMESTAMP) AS d
          FROM generate_series(DATE '2014-01-01', DATE '2020-12-31', INTERVAL 1 DAY) AS g(d)) c
      ON year(d) = window_year AND isodow(d) = 7
      AND CAST(strftime(d, '%W') AS INTEGER) = window_week""")

API = """'{i}_' || _id AS _id, '{i}' AS indicator_id, '{i}' AS indicator_name,
    'http://example.com/{i}/{i}_' || _id AS uri, '1700000000' AS added_date,
    CAST(CAST(epoch(CAST("date" AS TIMESTAMP)) AS BIGINT) AS VARCHAR) AS "date",
    "value", description, region_id AS location_id"""
oracle("api_records", f"SELECT {API.format(i='AreaPresence')} FROM obs_presence")
oracle("api_records_json", f"""
    SELECT CAST(to_json({{'_id': _id, 'indicator_id': indicator_id, 'indicator_name': indicator_name,
        'uri': uri, 'added_date': added_date, 'date': "date", 'value': "value",
        'description': description, 'location_id': location_id}}) AS VARCHAR) AS "value"
    FROM (SELECT {API.format(i='Flows')} FROM obs_od) r""")

oracle("sink_profiles", f"""
    SELECT window_year, window_week, region, user_id, {VECTOR} FROM dense GROUP BY ALL""")
oracle("sink_two_tags", """
    SELECT DISTINCT tag, window_year, window_week, region, user_id
    FROM dense, (VALUES ('1'), ('01')) AS t(tag) WHERE tag = '01' OR region <> '0'""")
oracle("sink_rewritten_window", """
    SELECT DISTINCT window_year, window_week, region, user_id FROM dense WHERE window_week <> 5""")
oracle("profile_rejects", """
    SELECT event_id, user_id, start_cell, 'n/a' AS "time"
    FROM cdr JOIN lines l USING (event_id) WHERE event_id % 7 = 0 AND NOT l.cut AND NOT l.broken""")
oracle("weeks_required", "SELECT * FROM complete")
oracle("sink_centroids", """
    SELECT window_year, window_week, centroid_id, label, CAST(n_values AS INTEGER) AS n_values,
           round(CAST(total AS DOUBLE), 6) AS total
    FROM (SELECT *, row_number() OVER (PARTITION BY window_year, window_week, centroid_id
                                       ORDER BY round(d2, 9), ordinal) AS nearness
          FROM region_distances) d
    WHERE nearness = 1""")
ORACLE["sink_sociometer"] = ORACLE["sociometer"]
ORACLE["sink_annotations"] = ORACLE["annotation_mode"]
DATE_TEXT = "strftime(\"date\", '%Y-%m-%d %H:%M:%S') AS \"date\""
oracle("sink_presence_series", f"SELECT region, {DATE_TEXT}, user_class, n_users FROM presence")
oracle("sink_od_series", f"SELECT destination, {DATE_TEXT}, origin, n_users FROM od")
oracle("sink_hourly_series", f"""
    SELECT region, {DATE_TEXT}, "hour", n_calls, cells FROM (
        SELECT region, CAST({DAY} AS TIMESTAMP) AS "date", substr("time", 1, 2) AS "hour", {HOURLY}
        FROM placed GROUP BY 1, 2, 3) h""")
for _name in ("sink_by_week", "sink_by_week_rebalanced"):
    oracle(_name, "SELECT event_id, user_id, start_cell, iso_year, iso_week FROM cdr")
ORACLE["sink_observations"] = ORACLE["obs_presence"]
ORACLE["table_lifecycle"] = ORACLE["peak_counts"]
