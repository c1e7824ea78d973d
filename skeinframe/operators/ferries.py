"""Terminals, routes, causeways and what a route touches (survey J-23, J-29, J-31, P-49, W-18, X-22, S-09)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .joins import nearest

# Ports that mean a place, and ranks of routes
PORTS = {"craignure": "mull", "fionnphort": "mull", "fishnish": "mull", "tobermory": "mull", "iona": "iona", "armadale": "isle-of-skye", "brodick": "arran", "portaskaig": "islay", "port ellen": "islay", "portellen": "islay", "portavadie": "bute", "rathlin": "rathlin", "lundy": "lundy"}
TYPE_RANK = {"car-and-foot": 0, "foot-only": 1, "passenger-only": 1, "charter": 2}
SEASON_RANK = {"year-round": 0, "seasonal": 1, "summer-only": 1, "on-demand": 2}
FREQUENCY_RANK = {"several-daily": 0, "daily": 1, "weekly": 2, "on-demand": 3}


def _rank(c: Column, table: Mapping[str, int], unknown: int, rest: int = 9) -> Column:
    out = F.when(c.isNull(), unknown).otherwise(rest)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def route_rank(kind: Column, season: Column, frequency: Column) -> Column:
    """The order in which routes are shown: cars before feet, all the year before summer, often before seldom."""
    return _rank(kind, TYPE_RANK, 9) * 1000 + _rank(season, SEASON_RANK, 9) * 100 + _rank(frequency, FREQUENCY_RANK, 4) * 10


def ferry_type(motor: Column, foot: Column, name: Column) -> Column:
    """Cars and feet, or feet only: by what motor vehicles may do, then by words for the vessel, then by the path for feet."""
    m = F.lower(F.coalesce(motor, F.lit("")))
    return F.when(m.isin("yes", "designated", "permissive"), "car-and-foot").when((m == "no") | F.lower(F.coalesce(name, F.lit(""))).rlike("hovercraft|passenger") | F.coalesce(F.lower(foot) == "designated", F.lit(False)), "foot-only").otherwise("car-and-foot")


def seasonality(opening: Column) -> Column:
    return F.when(F.lower(F.coalesce(opening, F.lit(""))).rlike("apr-oct|mar-oct|may-sep|summer"), "summer-only").otherwise("year-round")


def terminal_places(terminals: DataFrame, places: DataFrame, aliases: DataFrame, ports: Mapping[str, str] = PORTS, max_km: float = 25.0) -> DataFrame:
    """(terminal, place, how): a port's name in the terminal's or route's id, else the id that it gives by the aliases, else its name, else the nearest sea place. terminals: terminal, route, given, name, lat, lng; places: place, name, type, lat, lng, area; aliases: alias, place."""
    words = lambda c: F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+")
    known = places.select(F.col("place").cast("string").alias("_known"), "place")
    hits = [F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(p)) if " " in p else F.array_contains(words(c), p), F.struct(F.lit(n).alias("n"), F.lit(to).alias("_known"))) for n, (c, p, to) in enumerate((c, p, to) for c in ("terminal", "route") for p, to in ports.items())]
    marked = terminals.withColumn("_p", F.explode(F.array_compact(F.array(*hits)))).select("terminal", "_p.*").join(known, "_known")
    ported = marked.groupBy("terminal").agg(F.min(F.struct("n", "place"))["place"].alias("place")).withColumn("how", F.lit("port"))
    rest = terminals.join(ported.select("terminal"), "terminal", "left_anti")
    given = rest.join(aliases.select(F.col("alias").alias("given"), "place"), "given").groupBy("terminal").agg(F.min("place").alias("place")).withColumn("how", F.lit("id"))
    rest = rest.join(given.select("terminal"), "terminal", "left_anti")
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(fold(F.col(c)), r"\b(?:the|isle of|island of)\s+", ""), "[^a-z0-9]+", " "))
    # of places of one name only the first is joined
    first = places.groupBy(bare("name").alias("_k")).agg(F.min(F.struct((-F.coalesce("area", F.lit(0.0))).alias("a"), "place")).alias("_f"))
    named = rest.select("terminal", bare("name").alias("_k")).filter("_k <> ''").join(first, "_k")
    named = named.groupBy("terminal").agg(F.min("_f")["place"].alias("place")).withColumn("how", F.lit("name"))
    rest = rest.join(named.select("terminal"), "terminal", "left_anti")
    near = nearest(rest, places.filter("type = 'sea'"), "terminal", "place", max_km).select("terminal", "place").withColumn("how", F.lit("near"))
    return ported.unionByName(given).unionByName(named).unionByName(near)


def missing_drives(terminals: DataFrame, origins: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(terminal, city, lat, lng, city_lat, city_lng) of drive times that are not known yet. terminals: terminal, lat, lng, minutes (a map by city); origins: a few cities."""
    cities = F.array(*(F.struct(F.lit(c).alias("city"), F.lit(a).alias("city_lat"), F.lit(b).alias("city_lng")) for c, (a, b) in origins.items()))
    long = terminals.filter("lat is not null and lng is not null").withColumn("_c", F.explode(cities)).select("*", "_c.*")
    return long.filter(F.try_element_at("minutes", F.col("city")).isNull()).select("terminal", "city", "lat", "lng", "city_lat", "city_lng")


def causeways_of(places: DataFrame, causeways: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, causeway): the one that names the place's id, else the first in order with a hint in its name. causeways: causeway, ord, place, hints (array)."""
    direct = places.select(id_col).join(causeways.select(F.col("place").alias(id_col), "ord", "causeway"), id_col).groupBy(id_col).agg(F.min(F.struct("ord", "causeway"))["causeway"].alias("causeway"))
    rest = places.join(direct.select(id_col), id_col, "left_anti").select(id_col, F.lower("name").alias("_n"))
    hints = causeways.select("ord", "causeway", F.explode("hints").alias("_h")).filter("_h <> ''").withColumn("_h", F.lower("_h"))
    # names meet hints over the hint's letters: all runs of that length of a name
    sizes = sorted(r[0] for r in hints.select(F.length("_h")).distinct().collect())
    starts = lambda k: F.when(F.length("_n") >= k, F.sequence(F.lit(1), F.length("_n") - k + 1)).otherwise(F.array().cast("array<int>"))
    runs_of = lambda k: F.transform(starts(k), lambda i: F.substring(F.col("_n"), i, F.lit(k)))
    runs = [runs_of(k) for k in sizes] or [F.array().cast("array<string>")]
    hit = rest.withColumn("_h", F.explode(F.array_distinct(F.concat(*runs)))).join(hints, "_h")
    return direct.unionByName(hit.groupBy(id_col).agg(F.min(F.struct("ord", "causeway"))["causeway"].alias("causeway")))


def routes_touching(routes: DataFrame, terminals: DataFrame, places: DataFrame, test: Column) -> DataFrame:
    """Routes of which one end's place, or the terminal itself, passes a test over name, archipelago, nation, terminal_name and country. routes: route, start, end; terminals: terminal, place, terminal_name, country."""
    ends = routes.select("route", F.explode(F.array("start", "end")).alias("terminal")).join(terminals, "terminal", "left").join(places.select("place", "name", "archipelago", "nation"), "place", "left")
    return ends.filter(F.coalesce(test, F.lit(False))).select("route").distinct()


def parse_ferries(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routes, stops) of map elements: ways and relations tagged as ferries with a name and two ends at least. elements: type, id, tags (map), nodes (array of struct(ref, lat, lng)). Relations take the nodes of their members' order."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    found = elements.filter((tag("route") == "ferry") & (F.size("nodes") >= 2)).withColumn("route", F.concat_ws("-", F.lit("osm"), "type", "id"))
    motor = F.coalesce(tag("motor_vehicle"), tag("motorcar"), tag("vehicle"))
    routes = found.select("route", F.coalesce(tag("name"), F.lit("")).alias("name"), ferry_type(motor, tag("foot"), tag("name")).alias("kind"), seasonality(tag("opening_hours")).alias("season"), tag("operator").alias("operator"), tag("duration").alias("duration"))
    ends = found.select("route", F.explode(F.array(F.struct(F.lit("start").alias("end"), F.element_at("nodes", 1).alias("n")), F.struct(F.lit("end").alias("end"), F.element_at("nodes", -1).alias("n")))).alias("e"))
    return routes, ends.select("route", F.col("e.end").alias("end"), F.col("e.n.ref").alias("node"), F.round("e.n.lat", 5).alias("lat"), F.round("e.n.lng", 5).alias("lng"))
