"""Routes and weekly departures of timetable feeds, and the terminals they serve (survey S-07, A-16, W-14).

All tables have the archive that their rows are from, and ids are joined within it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import clock_minutes, compact_date
from ..functions.text import ascii_slug
from .graph import first_come
from .joins import within_km
from .tables import durable

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
TERMINAL_KM = 0.4


def _filled(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))


def operator_routes(feed: Mapping[str, DataFrame], operator: str) -> DataFrame:
    """The routes of an operator: of agencies whose name has ``operator``, or, in an archive without such an agency, of agency ids that have it."""
    wanted = operator.lower()
    named = feed["agency"].filter(F.contains(F.lower(F.coalesce("agency_name", F.lit(""))), F.lit(wanted))).select("archive", "agency_id").distinct()
    routes = feed["routes"].dropDuplicates(["archive", "route_id"])
    by_name = routes.join(named, ["archive", "agency_id"], "left_semi")
    others = routes.join(named.select("archive").distinct(), "archive", "left_anti")
    return by_name.unionByName(others.filter(F.contains(F.lower(F.coalesce("agency_id", F.lit(""))), F.lit(wanted))))


def weekly_routes(feed: Mapping[str, DataFrame], operator: str) -> DataFrame:
    """A row for each route, first and last stop of an operator's trips: archive, route_id, origin, destination, code, name, weekly (array of day and departures, days in order), valid_from, valid_to and minutes.

    A trip of one stop, or between stops that are not known, counts for nothing; of
    stops with one number the least id is the first, the greatest the last. A
    departure is the first stop's time of departure, or of arrival; hours run on past
    24. It is in the week for each day of the trip's service; without a known service
    it is left out, but counts for the mean duration (modulo a day, halves to even).
    Routes without any departure are left out. Times of a day are distinct and sorted.
    """
    routes = operator_routes(feed, operator)
    trips = feed["trips"].dropDuplicates(["archive", "trip_id"]).join(routes.select("archive", "route_id"), ["archive", "route_id"], "left_semi")
    # only the stops of these trips are grouped, to the first and the last
    seq = F.coalesce(F.col("stop_sequence").try_cast("int"), F.lit(0))
    stop = F.struct(seq.alias("seq"), "stop_id", clock_minutes(_filled("departure_time", "arrival_time")).alias("dep"), clock_minutes(_filled("arrival_time", "departure_time")).alias("arr"))
    ends = feed["stop_times"].join(trips.select("archive", "trip_id"), ["archive", "trip_id"], "left_semi").groupBy("archive", "trip_id").agg(F.min(stop).alias("a"), F.max(stop).alias("b"), F.count("*").alias("n")).filter("n > 1")
    runs = trips.join(ends, ["archive", "trip_id"]).select("archive", "route_id", "service_id", F.col("a.stop_id").alias("origin"), F.col("b.stop_id").alias("destination"), F.col("a.dep").alias("dep"), F.pmod(F.col("b.arr") - F.col("a.dep"), F.lit(1440)).alias("took"))
    known = feed["stops"].select("archive", "stop_id").distinct()
    runs = runs.join(known.withColumnRenamed("stop_id", "origin"), ["archive", "origin"], "left_semi").join(known.withColumnRenamed("stop_id", "destination"), ["archive", "destination"], "left_semi")
    key = ["archive", "route_id", "origin", "destination"]
    # calendar days as rows
    calendar = feed["calendar"].dropDuplicates(["archive", "service_id"]).select("archive", "service_id", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in ("start_date", "end_date")), F.array_compact(F.array(*(F.when(F.col(d) == "1", F.lit(i)) for i, d in enumerate(DAYS)))).alias("days"))
    served = runs.filter("dep is not null").join(calendar, ["archive", "service_id"])
    span = served.groupBy(*key).agg(F.min("start_date").alias("start"), F.max("end_date").alias("end"))
    clock = F.format_string("%02d:%02d", F.floor(F.col("dep") / 60), F.pmod("dep", F.lit(60)))
    days = served.withColumn("d", F.explode("days")).groupBy(*key, "d").agg(F.array_sort(F.collect_set(clock)).alias("departures"))
    weekly = days.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("d", "departures"))).alias("w"))
    weekly = weekly.select(*key, F.transform("w", lambda x: F.struct(F.element_at(F.array(*(F.lit(d[:3]) for d in DAYS)), x["d"] + 1).alias("day"), x["departures"].alias("departures"))).alias("weekly"))
    took = runs.groupBy(*key).agg(F.bround(F.avg("took"), 0).cast("int").alias("minutes"))
    iso = lambda c: F.date_format(compact_date(F.col(c)), "yyyy-MM-dd")
    named = routes.select("archive", "route_id", _filled("route_short_name", "route_long_name").alias("code"), F.coalesce(_filled("route_long_name", "route_short_name"), F.col("route_id")).alias("name"))
    return weekly.join(span, key).join(took, key).join(named, ["archive", "route_id"]).select(*key, "code", "name", "weekly", iso("start").alias("valid_from"), iso("end").alias("valid_to"), "minutes")


def stop_terminals(stops: DataFrame, terminals: DataFrame, max_km: float = TERMINAL_KM) -> DataFrame:
    """(archive, stop_id, terminal, name, lat, lng, is_new): the terminal that a stop means.

    The nearest known one within ``max_km``, of equals the least; else a new one: in
    order of archive and stop, a stop becomes a terminal if none that became one
    before is within ``max_km``, and else means the nearest of those. Stops without
    coordinates mean none. stops: archive, stop_id, stop_name, stop_lat, stop_lon;
    terminals: terminal, name, lat, lng.
    """
    s = stops.select("archive", "stop_id", F.trim(F.coalesce("stop_name", F.lit(""))).alias("stop_name"), F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lng")).filter("lat is not null and lng is not null").dropDuplicates(["archive", "stop_id"])
    s = durable(s.withColumn("stop", F.struct("archive", "stop_id")), "stops")
    hit = within_km(s.select("stop", "lat", "lng"), terminals.select("terminal", "lat", "lng"), max_km)
    old = durable(hit.groupBy("stop").agg(F.min(F.struct("km", "terminal"))["terminal"].alias("terminal")), "known-stops")
    fresh = s.join(old.select("stop"), "stop", "left_anti")
    near = durable(within_km(fresh.select("stop", "lat", "lng"), fresh.select(F.col("stop").alias("other"), "lat", "lng"), max_km).filter("other < stop"), "near-stops")
    follows = first_come(near.select(F.col("stop").alias("u"), F.col("other").alias("v")))
    lead = fresh.join(follows.select(F.col("node").alias("stop")), "stop", "left_anti")
    begun = lead.select("stop", F.concat(F.lit("term-gtfs-"), ascii_slug(F.col("stop_name")), F.lit("-"), F.col("stop_id")).alias("terminal"), F.coalesce(F.nullif(F.col("stop_name"), F.lit("")), F.concat(F.lit("GTFS "), F.col("stop_id"))).alias("name"), "lat", "lng", F.lit(True).alias("is_new"))
    joins = near.join(lead.select(F.col("stop").alias("other")), "other").groupBy("stop").agg(F.min(F.struct("km", "other"))["other"].alias("lead"))
    following = joins.join(begun.withColumnRenamed("stop", "lead"), "lead").drop("lead")
    there = old.join(terminals.select("terminal", "name", "lat", "lng"), "terminal").withColumn("is_new", F.lit(False))
    columns = ["stop", "terminal", "name", "lat", "lng", "is_new"]
    whole = there.select(*columns).unionByName(begun.select(*columns)).unionByName(following.select(*columns))
    return whole.select("stop.archive", "stop.stop_id", *columns[1:])


def route_records(routes: DataFrame, placed: DataFrame, operator_id: str) -> DataFrame:
    """One record an id gtfs-operator-from-to: id, route_id, origin and destination terminals, code, name, weekly, valid_from, valid_to, minutes. Of routes with one id the last by archive, route and stops counts. routes: of ``weekly_routes``; placed: of ``stop_terminals``."""
    end = lambda c: placed.select("archive", F.col("stop_id").alias(c), F.col("terminal").alias(f"{c}_terminal"), F.col("name").alias(f"{c}_name"))
    j = routes.join(end("origin"), ["archive", "origin"]).join(end("destination"), ["archive", "destination"])
    slug = ascii_slug(F.concat_ws("-", F.lit(operator_id), "origin_name", "destination_name"))
    fields = ["archive", "route_id", "origin", "destination", "origin_terminal", "destination_terminal", "code", "name", "weekly", "valid_from", "valid_to", "minutes"]
    last = j.withColumn("id", F.concat(F.lit("gtfs-"), slug)).groupBy("id").agg(F.max(F.struct(*fields)).alias("r"))
    return last.select("id", *(f"r.{f}" for f in fields if f not in ("archive", "origin", "destination")))


def served_terminals(routes: DataFrame, placed: DataFrame) -> DataFrame:
    """(terminal, name, lat, lng, is_new, routes) of the terminals that routes begin or end at, with how many."""
    stops = routes.select("archive", "route_id", "origin", "destination", F.explode(F.array("origin", "destination")).alias("stop_id"))
    return stops.join(placed, ["archive", "stop_id"]).groupBy("terminal").agg(F.min("name").alias("name"), F.min("lat").alias("lat"), F.min("lng").alias("lng"), F.bool_or("is_new").alias("is_new"), F.countDistinct("archive", "route_id", "origin", "destination").alias("routes"))
