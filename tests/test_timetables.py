"""Timetable feeds read from zip archives that the test writes, and what is made of them."""

import zipfile

import pytest

from skeinframe.operators import timetables
from skeinframe.sources import archives

WEEK = "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
ONE = {
    # a byte-order mark, columns in another order, a column too many, a quoted comma
    "agency.txt": "﻿agency_name,agency_id,agency_url\nOrran Ferries,A1,x\n\"Coaches, Ltd\",A2,y\n",
    "routes.txt": "route_id,agency_id,route_short_name,route_long_name\nR1,A1,7,Skarva - Tolm\nR2,A1,,Tolm - Hesker\nR3,A2,9,By road\nR4,A1,,\n",
    "trips.txt": "route_id,service_id,trip_id\nR1,S1,T1\nR1,S1,T2\nR1,S2,T3\nR1,S9,T4\nR2,S1,T5\nR3,S1,T6\nR1,S1,T7\nR4,S1,T8\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\n" + "\n".join(
        ["T1,,08:00:00,P1,1", "T1,09:00:00,,P2,2", "T2,25:10:00,25:10:00,P2,1", "T2,26:40:00,26:40:00,P1,9", "T3,,10:00:00,P1,1", "T3,10:30:00,,P3,5", "T3,11:10:00,11:10:00,P2,10", "T4,,12:00:00,P1,1", "T4,12:31:00,,P2,2",
         "T5,,07:15:00,P2,1", "T5,08:00:00,,P4,2", "T6,,07:15:00,P2,1", "T6,08:00:00,,P1,2", "T7,,09:00:00,P1,1", "T8,,09:00:00,P1,1", "T8,09:40:00,,PX,2"]) + "\n",
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nP1,Skarva Pier,56.0,-6.0\nP2, Tolm Pier ,56.2,-6.0\nP3,,56.1,-6.0\nP4,Hesker,56.3,-6.0\nP5,Lost,,\n",
    "calendar.txt": WEEK + "S1,1,0,0,0,1,0,0,20260301,20260930\nS2,1,1,0,0,0,0,0,20260201,20261030\n",
}
TWO = {
    "agency.txt": "agency_id,agency_name\nX,Other\n", "routes.txt": "route_id,agency_id,route_short_name,route_long_name\nR1,ORRAN FERRIES,1,One\nR2,X,2,Two\n", "trips.txt": "route_id,service_id,trip_id\nR1,S1,T1\nR2,S1,T2\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,,23:50:00,P1,1\nT1,00:20:00,,P2,2\nT2,,08:00:00,P1,1\nT2,08:20:00,,P2,2\n", "stops.txt": "stop_id,stop_name,stop_lat,stop_lon\nP1,Near Skarva,56.001,-6.0\nP2,Brenna,57.0,-6.0\n",
    "calendar.txt": WEEK + "S1,0,0,0,0,0,0,1,bad,20261231\n",
}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    for name, members in (("one.zip", ONE), ("two.zip", TWO), ("three.zip", {"readme.txt": "nothing"})):
        with zipfile.ZipFile(folder / name, "w", zipfile.ZIP_DEFLATED) as z:
            for member, body in members.items():
                z.writestr(member, body)
    (folder / "notes.txt").write_text("no archive")
    return folder


def test_members_of_archives(spark, feed):
    got = archives.zipped_csv(spark, str(feed), "agency.txt", ("agency_id", "agency_name", "agency_phone"))
    assert sorted(map(tuple, got.collect())) == [("one.zip", "A1", "Orran Ferries", None), ("one.zip", "A2", "Coaches, Ltd", None), ("two.zip", "X", "Other", None)]
    assert got.rdd.getNumPartitions() == 2
    assert archives.zipped_csv(spark, f"file://{feed}/t*.zip", "stops.txt", ("stop_id",)).count() == 2
    assert archives.zipped_csv(spark, str(feed), "fares.txt", ("fare_id",)).count() == 0


def test_many_rows_come_in_batches(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        z.writestr("stops.txt", "stop_id\n" + "".join(f"{i}\n" for i in range(20_000)))
    got = archives.zipped_csv(spark, str(tmp_path / "big.zip"), "stops.txt", ("stop_id",))
    assert got.selectExpr("count(distinct stop_id)").first()[0] == 20_000


def test_weekly_routes(spark, feed):
    got = {(r.archive[:3], r.route_id, r.origin, r.destination): ([(w.day, list(w.departures)) for w in r.weekly], r.valid_from, r.valid_to, r.minutes, r.code, r.name) for r in timetables.weekly_routes(archives.feed_archive(spark, str(feed)), "orran ferries").collect()}
    assert got == {
        # T4's service is unknown: no departure, but its 31 minutes count for the mean of 60, 70 and 31
        ("one", "R1", "P1", "P2"): ([("mon", ["08:00", "10:00"]), ("tue", ["10:00"]), ("fri", ["08:00"])], "2026-02-01", "2026-10-30", 54, "7", "Skarva - Tolm"),
        # the other direction, at ten past one the next day
        ("one", "R1", "P2", "P1"): ([("mon", ["01:10"]), ("fri", ["01:10"])], "2026-03-01", "2026-09-30", 90, "7", "Skarva - Tolm"),
        ("one", "R2", "P2", "P4"): ([("mon", ["07:15"]), ("fri", ["07:15"])], "2026-03-01", "2026-09-30", 45, "Tolm - Hesker", "Tolm - Hesker"),
        # no agency of that name: by the agency's id; over midnight; a date that is none
        ("two", "R1", "P1", "P2"): ([("sun", ["23:50"])], None, "2026-12-31", 30, "1", "One"),
    }


def test_terminals_and_records(spark, feed):
    tables = archives.feed_archive(spark, str(feed))
    known = spark.createDataFrame([("k1", "Skarva", 56.0005, -6.0), ("k2", "Far", 58.0, -6.0)], "terminal string, name string, lat double, lng double")
    placed = timetables.stop_terminals(tables["stops"], known)
    got = {(r.archive[:3], r.stop_id): (r.terminal, r.name, r.is_new) for r in placed.collect()}
    assert got == {
        ("one", "P1"): ("k1", "Skarva", False), ("two", "P1"): ("k1", "Skarva", False), ("one", "P2"): ("term-gtfs-tolm-pier-P2", "Tolm Pier", True), ("one", "P3"): ("term-gtfs--P3", "GTFS P3", True),
        ("one", "P4"): ("term-gtfs-hesker-P4", "Hesker", True), ("two", "P2"): ("term-gtfs-brenna-P2", "Brenna", True),
    }
    routes = timetables.weekly_routes(tables, "orran ferries")
    assert {r.id: (r.origin_terminal, r.minutes) for r in timetables.route_records(routes, placed, "orran").collect()} == {
        "gtfs-orran-skarva-tolm-pier": ("k1", 54), "gtfs-orran-tolm-pier-skarva": ("term-gtfs-tolm-pier-P2", 90), "gtfs-orran-tolm-pier-hesker": ("term-gtfs-tolm-pier-P2", 45), "gtfs-orran-skarva-brenna": ("k1", 30),
    }
    assert {r.terminal: r.routes for r in timetables.served_terminals(routes, placed).collect()} == {"k1": 3, "term-gtfs-tolm-pier-P2": 3, "term-gtfs-hesker-P4": 1, "term-gtfs-brenna-P2": 1}


def test_chains_of_new_stops(spark):
    # 0.3 km apart: the third is too far from the first, so it begins a terminal of its own
    stops = spark.createDataFrame([("z", f"p{i}", f"S{i}", str(56 + i * 0.0027), "-6") for i in range(4)], "archive string, stop_id string, stop_name string, stop_lat string, stop_lon string")
    known = spark.createDataFrame([], "terminal string, name string, lat double, lng double")
    got = {r.stop_id: r.terminal for r in timetables.stop_terminals(stops, known).collect()}
    assert got == {"p0": "term-gtfs-s0-p0", "p1": "term-gtfs-s0-p0", "p2": "term-gtfs-s2-p2", "p3": "term-gtfs-s2-p2"}
    assert timetables.stop_terminals(stops.limit(0), known).count() == 0
