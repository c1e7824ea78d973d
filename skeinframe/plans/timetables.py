"""Queries of timetable feeds, made from the star tables: regions as archives, nations as agencies, parts as routes, orders as trips, lines as stops on the way, suppliers as stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timetables
from .registry import Tables, plain, query

OPERATOR = "n_1"
_CLOCK = "lpad(CAST({h} AS VARCHAR(3)), 2, '0') || ':' || lpad(CAST({m} AS VARCHAR(3)), 2, '0') || ':00'"
_AGENCY = "SELECT 'f' || n_regionkey AS archive, 'x' || lower(n_name) AS agency_id, CASE WHEN n_regionkey < 3 THEN n_name ELSE 'Ferries' END AS agency_name FROM {nation}"
_ROUTES = "SELECT 'f' || n_regionkey AS archive, 'r' || p_partkey AS route_id, 'x' || lower(n_name) AS agency_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'R' || p_size END AS route_short_name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS route_long_name FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25"
_TRIPS = "SELECT 'f' || n_regionkey AS archive, 'r' || p_partkey AS route_id, 's' || o_orderkey % 12 AS service_id, 't' || o_orderkey AS trip_id FROM {orders} JOIN {part} ON p_partkey = 1 + o_custkey % 190 JOIN {nation} ON n_nationkey = p_partkey % 25"
_TIMES = f"""SELECT 'f' || n_regionkey AS archive, 't' || l_orderkey AS trip_id, 'p' || l_suppkey % 40 AS stop_id, CAST(l_linenumber * 2 AS VARCHAR(4)) AS stop_sequence, {_CLOCK.format(h="5 + o_orderkey % 6 * 3 + l_linenumber", m="l_partkey % 60")} AS arrival_time,
 CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 31 = 0 THEN 'soon' ELSE {_CLOCK.format(h="5 + o_orderkey % 6 * 3 + l_linenumber", m="(l_partkey + 5) % 60")} END AS departure_time
 FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{part}} ON p_partkey = 1 + o_custkey % 190 JOIN {{nation}} ON n_nationkey = p_partkey % 25"""
_STOPS = "SELECT 'f' || r_regionkey AS archive, 'p' || c_custkey AS stop_id, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Pier ' || c_custkey % 9 END AS stop_name, CASE WHEN c_custkey % 13 = 0 THEN 'x' ELSE CAST(56 + c_custkey % 8 * 0.003 AS VARCHAR(30)) END AS stop_lat, CAST(-6 + CAST(r_regionkey AS DOUBLE) / 2 + c_custkey % 5 * 0.05 AS VARCHAR(30)) AS stop_lon FROM {customer} JOIN {region} ON c_custkey < 40 AND c_custkey <> 7"
_CALENDAR = "SELECT 'f' || r_regionkey AS archive, 's' || n_nationkey AS service_id, " + ", ".join(f"CASE WHEN (n_nationkey + {i}) % {2 + i % 3} = 0 THEN '1' ELSE '0' END AS {d}" for i, d in enumerate(timetables.DAYS)) + ", CASE WHEN n_nationkey = 3 THEN '' ELSE '202601' || lpad(CAST(1 + n_nationkey AS VARCHAR(2)), 2, '0') END AS start_date, CASE WHEN n_nationkey = 4 THEN '2026' ELSE '202606' || lpad(CAST(1 + n_nationkey AS VARCHAR(2)), 2, '0') END AS end_date FROM {nation} JOIN {region} ON n_nationkey < 10"
_KNOWN = "SELECT 'k' || s_suppkey AS terminal, 'Quay ' || s_suppkey AS name, 56 + s_suppkey % 3 * 0.0061 AS lat, -6 + s_suppkey % 4 * 0.05 AS lng FROM {supplier} WHERE s_suppkey <= 12"


def feed(t: Tables):
    names = dict(agency=_AGENCY, routes=_ROUTES, trips=_TRIPS, stop_times=_TIMES, stops=_STOPS, calendar=_CALENDAR)
    return {k: t.sql(v) for k, v in names.items()}


def _table(sql: str) -> str:
    return f"({plain(sql)})"


_MINUTES = "CASE WHEN regexp_matches({0}, '^\\s*\\d+:\\d\\d') THEN CAST(split_part({0}, ':', 1) AS INTEGER) % 24 * 60 + CAST(substr(split_part({0}, ':', 2), 1, 2) AS INTEGER) END"
_ISO = "CASE WHEN length({0}) = 8 THEN substr({0}, 1, 4) || '-' || substr({0}, 5, 2) || '-' || substr({0}, 7, 2) END"
_SEQ = "seq, stop_id, dep NULLS FIRST, arr NULLS FIRST"
_WEEKLY = f"""WITH ag AS (SELECT DISTINCT archive, agency_id FROM {_table(_AGENCY)} x WHERE contains(lower(agency_name), '{OPERATOR}')), ro AS (SELECT * FROM {_table(_ROUTES)} r WHERE (archive, agency_id) IN (SELECT archive, agency_id FROM ag) OR (archive NOT IN (SELECT archive FROM ag) AND contains(lower(agency_id), '{OPERATOR}'))),
 st AS (SELECT *, CAST(stop_sequence AS INTEGER) AS seq, {_MINUTES.format("coalesce(nullif(departure_time, ''), arrival_time)")} AS dep, {_MINUTES.format("coalesce(nullif(arrival_time, ''), departure_time)")} AS arr FROM {_table(_TIMES)} x),
 en AS (SELECT archive, trip_id, first(stop_id ORDER BY {_SEQ}) AS origin, last(stop_id ORDER BY {_SEQ}) AS destination, first(dep ORDER BY {_SEQ}) AS dep, (1440 + last(arr ORDER BY {_SEQ}) - first(dep ORDER BY {_SEQ})) % 1440 AS took FROM st GROUP BY ALL HAVING count(*) > 1),
 ru AS (SELECT t.archive, t.route_id, service_id, origin, destination, dep, took FROM {_table(_TRIPS)} t JOIN ro ON t.archive = ro.archive AND t.route_id = ro.route_id JOIN en ON t.archive = en.archive AND t.trip_id = en.trip_id WHERE (t.archive, origin) IN (SELECT archive, stop_id FROM {_table(_STOPS)} s) AND (t.archive, destination) IN (SELECT archive, stop_id FROM {_table(_STOPS)} s)),
 se AS (SELECT ru.*, c.* EXCLUDE (archive, service_id) FROM ru JOIN {_table(_CALENDAR)} c ON ru.archive = c.archive AND ru.service_id = c.service_id WHERE dep IS NOT NULL),
 da AS (SELECT archive, route_id, origin, destination, d, string_agg(DISTINCT lpad(CAST(dep // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(dep % 60 AS VARCHAR), 2, '0'), ',' ORDER BY lpad(CAST(dep // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(dep % 60 AS VARCHAR), 2, '0')) AS times FROM ({" UNION ALL ".join(f"SELECT *, {i} AS d FROM se WHERE {d} = '1'" for i, d in enumerate(timetables.DAYS))}) q GROUP BY ALL),
 we AS (SELECT archive, route_id, origin, destination, string_agg(substr(['{"', '".join(timetables.DAYS)}'][d + 1], 1, 3) || ' ' || times, '; ' ORDER BY d) AS weekly FROM da GROUP BY ALL), sp AS (SELECT archive, route_id, origin, destination, min(nullif(start_date, '')) AS s, max(nullif(end_date, '')) AS e FROM se GROUP BY ALL), tk AS (SELECT archive, route_id, origin, destination, CAST(round_even(avg(took), 0) AS INTEGER) AS minutes FROM ru GROUP BY ALL),
 routes AS (SELECT we.*, coalesce(nullif(route_short_name, ''), route_long_name) AS code, coalesce(route_long_name, nullif(route_short_name, ''), we.route_id) AS name, {_ISO.format("s")} AS valid_from, {_ISO.format("e")} AS valid_to, minutes FROM we JOIN sp USING (archive, route_id, origin, destination) JOIN tk USING (archive, route_id, origin, destination) JOIN ro ON we.archive = ro.archive AND we.route_id = ro.route_id)"""


def _text(c: str = "weekly"):
    return F.array_join(F.transform(c, lambda x: F.concat(x["day"], F.lit(" "), F.array_join(x["departures"], ","))), "; ")


@query(f"{_WEEKLY} SELECT archive, route_id, origin, destination, code, name, weekly, valid_from, valid_to, minutes FROM routes")
def weekly_departures(t):
    """An operator's routes with their weekly departures, from feeds (S-07, A-16)."""
    return timetables.weekly_routes(feed(t), OPERATOR).withColumn("weekly", _text())


_DISTANCE = "2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))"
_PLACED = f"""s AS (SELECT archive, stop_id, trim(stop_name) AS nm, TRY_CAST(stop_lat AS DOUBLE) AS lat, TRY_CAST(stop_lon AS DOUBLE) AS lng FROM {_table(_STOPS)} x WHERE TRY_CAST(stop_lat AS DOUBLE) IS NOT NULL), k AS (SELECT terminal, name, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM {_table(_KNOWN)} x),
 ol AS (SELECT archive, stop_id, first(terminal ORDER BY {_DISTANCE.format(a="s", b="k")}, terminal) AS terminal FROM s JOIN k ON {_DISTANCE.format(a="s", b="k")} <= 0.4 GROUP BY archive, stop_id), fr AS (SELECT * FROM s WHERE (archive, stop_id) NOT IN (SELECT archive, stop_id FROM ol)),
 ld AS (SELECT unnest(list_reduce(list([{{'archive': archive, 'stop_id': stop_id, 'lat': lat, 'lng': lng}}] ORDER BY archive, stop_id), lambda taken, x: CASE WHEN len(list_filter(taken, lambda y: {_DISTANCE.format(a="x[1]", b="y")} <= 0.4)) > 0 THEN taken ELSE list_concat(taken, x) END)) AS l FROM fr),
 le AS (SELECT l.archive AS archive, l.stop_id AS stop_id, l.lat AS lat, l.lng AS lng FROM ld), nw AS (SELECT le.*, 'term-gtfs-' || trim(regexp_replace(lower(nm), '[^a-z0-9]+', '-', 'g'), '-') || '-' || le.stop_id AS terminal, coalesce(nullif(nm, ''), 'GTFS ' || le.stop_id) AS name FROM le JOIN fr USING (archive, stop_id)),
 fo AS (SELECT fr.archive, fr.stop_id, first(nw.terminal ORDER BY {_DISTANCE.format(a="fr", b="nw")}, nw.archive, nw.stop_id) AS terminal, first(nw.name ORDER BY {_DISTANCE.format(a="fr", b="nw")}, nw.archive, nw.stop_id) AS name FROM fr JOIN nw ON (nw.archive, nw.stop_id) < (fr.archive, fr.stop_id) AND {_DISTANCE.format(a="fr", b="nw")} <= 0.4 WHERE (fr.archive, fr.stop_id) NOT IN (SELECT archive, stop_id FROM le) GROUP BY fr.archive, fr.stop_id),
 placed AS (SELECT archive, stop_id, terminal, name, false AS is_new FROM ol JOIN k USING (terminal) UNION ALL SELECT archive, stop_id, terminal, name, true FROM nw UNION ALL SELECT archive, stop_id, terminal, name, true FROM fo)"""


@query(f"WITH {_PLACED} SELECT archive, stop_id, terminal, name, is_new FROM placed")
def feed_terminals(t):
    """The terminals that a feed's stops mean: known ones near by, or new ones in order (S-07, J-12)."""
    return timetables.stop_terminals(t.sql(_STOPS), t.sql(_KNOWN).selectExpr("terminal", "name", "double(lat) lat", "double(lng) lng")).select("archive", "stop_id", "terminal", "name", "is_new")


@query(
    f"""{_WEEKLY}, {_PLACED}, j AS (SELECT r.*, a.terminal AS a, a.name AS an, b.terminal AS b, b.name AS bn FROM routes r JOIN placed a ON r.archive = a.archive AND r.origin = a.stop_id JOIN placed b ON r.archive = b.archive AND r.destination = b.stop_id),
 i AS (SELECT *, 'gtfs-' || trim(substr(trim(regexp_replace(lower(concat_ws('-', 'own', an, bn)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-') AS id, row_number() OVER (PARTITION BY 'gtfs-' || trim(substr(trim(regexp_replace(lower(concat_ws('-', 'own', an, bn)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-') ORDER BY archive DESC, route_id DESC, origin DESC, destination DESC) AS k FROM j)
 SELECT id, route_id, a AS origin_terminal, b AS destination_terminal, code, name, weekly, valid_from, valid_to, minutes FROM i WHERE k = 1"""
)
def imported_routes(t):
    """Route records from feeds, one an id (S-07, U-02)."""
    placed = timetables.stop_terminals(t.sql(_STOPS), t.sql(_KNOWN).selectExpr("terminal", "name", "double(lat) lat", "double(lng) lng"))
    return timetables.route_records(timetables.weekly_routes(feed(t), OPERATOR), placed, "own").withColumn("weekly", _text())
