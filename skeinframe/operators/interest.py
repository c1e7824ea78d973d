"""Rank models of cited items and places (survey R-04 to R-15).

Items: item, place, slug, title, summary, facet and picture ('subject' shows what
is cited, 'stand-in' only the place, null none), and tie if there is one. Places:
place, name, type, area, population, elevation and has_image.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, squeeze
from .scores import atlas_score, best_and_more, interest_share, richness

# Words of names that say nothing; countries whose list a name may stand in; patterns and points of the models
NAME_SKIP = ("isle", "island", "islands", "isles", "the", "of", "and", "unnamed")
COUNTRIES = r"\b(?:ireland|wales|scotland|england|cornwall|britain|france|europe|normandy)\b"
THIN = r"musicbrainz|wikidata q\d+|commons category|in the musicbrainz area"
NEWS = (
    (r"declared|principality|sovereign|anthrax|vanished|left hirta|last 36|castaway|forty days|\b40 days\b|feudal|politician|whisky from the wreck|beach is the runway|cable car", 5),
    (r"\bking\b|\bprince\b|crowned|parliament|puffin coin|chessmen|dinosaur|rocket|people's republic|bought their island", 4),
    (r"\bfire\b|\bwreck\b|fossil|mermaid|haggis|prisoners of war|chapel|wallab", 3),
)
NEWS_REST = 2
CASTLE_BELOW, CASTLE_LARGE = ((0.05, 8), (1, 6), (8, 3)), (200, -5)
PLAIN_CASTLE = r"mansion|country house|gothic revival"
FAMOUS_CASTLE = r"eilean donan|dunvegan|lindisfarne castle|castle rushen|duart|kisimul|caisteal chiosmuil|lochleven|loch leven|carisbrooke|beaumaris|castle stalker|castle tioram|brodick castle|scalloway|peel castle|mont orgueil|rothesay|piel castle|gylen|noltland|st michael"
CASTLE_MISTAKE = "oxford"
ENDEMIC, SUBSPECIES, ONLY_HERE, EXTINCT, COMMONPLACE = r"\bendemic\b", r"subspecies|subsp\.|race of|own unique", r"found only|only known|restricted to|confined to|only native|stronghold|the largest", r"\bextinct\b", r"european hedgehog|red squirrel \(sciurus vulgaris\)"
WHISKY = {"distillery": 16, "silent": 7, "story": 5, "planned": 2}
FAMOUS_STILL = r"laphroaig|lagavulin|ardbeg|bowmore|bruichladdich|caol ila|bunnahabhain|port charlotte|talisker|highland park|\bscapa\b|jura distillery|tobermory|ledaig|arran distillery|harris distillery|abhainn dearg|raasay distillery|torabhaig|ardnahoe"
WHISKY_STORY, WHISKY_HINTS = r"whisky galore|politician|loch shiel", r"oldest|founded|established|peated|northernmost|classic malt|\bonly\b"
BOOK_FORM = r"\bnovel\b|\bmemoir\b"
FAMOUS_BOOK = r"kidnapped|to the lighthouse|potato peel|whisky galore|the blackhouse|the outrun|catriona|peveril of the peak|mr pye|toilers of the sea|the deemster|the manxman|where the world ends"
GREAT_TRADITION, KNOWN_TRADITION = r"up helly aa|tynwald|sword dance|guga|mailboat|st kilda parliament|\bthe ba\b", r"hop-tu-naa|harris tweed|fair isle knitting|clameur|battle of flowers|stone skimming|fèis|king of "
FAMOUS_WALK = r"lindisfarne|holy island|michael's mount|burgh island|cramond|lihou|hilbre|brough of birsay|hestan|northey|oronsay|erraid|omey|davaar|worms head|gateholm|chapel island"
CULTURE = {"film": 10, "music": 7, "artwork": 5}
FAMOUS_WORK = r"fingal|the hebrides|whisky galore|highlander|father ted|macbeth|edge of the world|skye boat|wet leg|mendelssohn"
DWELLINGS, WHOLE_ISLANDS = r"bungalow|\bresidence\b|\bapartment\b|\bhomes\b|waters edge|croft and house", r"private island|whole island|acre estate|private islands online|\(vladi\)"
OUTPOST = r"rockall|north rona|st kilda|staffa|sula sgeir|sùla sgeir"
# What every further item of a slug adds, and up to how many
MORE = {"unusual-news": (0.75, 2), "island-castles": (0.4, 3), "unusual-wildlife": (0.7, 3), "island-books": (0.35, 4), "local-traditions": (0.2, 2), "film-art-music": (0.4, 3), "whisky-distilleries": (1.2, 5)}


def points(*rules: tuple[Column, float]) -> Column:
    """The sum of the points whose test holds; a null test does not."""
    return sum((F.when(t, F.lit(float(p))).otherwise(0.0) for t, p in rules), F.lit(0.0))


def first_points(rules: Sequence[tuple[Column, float]], rest: float = 0.0) -> Column:
    out = F.lit(float(rest))
    for t, p in reversed(list(rules)):
        out = F.when(t, F.lit(float(p))).otherwise(out)
    return out


def of_table(c: Column, table: Mapping[str, int], rest: int) -> Column:
    return first_points([(c == k, v) for k, v in table.items()], rest)


def bare_name(name: Column) -> Column:
    """A folded name without what stands in brackets."""
    return squeeze(F.regexp_replace(fold(name), r"\([^)]*\)", " "))


def mentions(folded: Column, bare: Column) -> Column:
    """Whether a folded text names a place: by the whole name or without 'isle of' (4 letters at least), or by a word of 5 letters that says something."""
    short = F.regexp_replace(bare, "^isle of ", "")
    words = F.filter(F.split(bare, "[^a-z0-9]+"), lambda w: (F.length(w) >= 5) & ~w.isin(*NAME_SKIP))
    text = F.concat(F.lit(" "), F.regexp_replace(folded, "[^a-z0-9_]+", " "), F.lit(" "))
    long = lambda n: (F.length(n) >= 4) & F.contains(folded, n)
    return long(bare) | long(short) | F.exists(words, lambda w: F.contains(text, F.concat(F.lit(" "), w, F.lit(" "))))


def around(folded: Column, start: Column, length: Column, reach: int) -> Column:
    """The text from ``reach`` before a place (from 1) to ``reach`` after its end."""
    first = F.greatest(F.lit(1), start - reach)
    return F.substring(folded, first, start + length + reach - first)


def phrase_near(folded: Column, bare: Column, pattern: str) -> Column:
    """Whether a text has a phrase, and names the place within 90 characters of where it first stands."""
    at = F.regexp_instr(folded, F.lit(pattern))
    return (at > 0) & mentions(around(folded, at, F.length(F.regexp_substr(folded, F.lit(pattern))), 90), bare)


def listed_among_countries(folded: Column, bare: Column) -> Column:
    at = F.instr(folded, bare)
    return (bare != "") & (at > 0) & around(folded, at, F.length(bare), 48).rlike(COUNTRIES)


@dataclass
class Item:
    """Columns of an item, and what is made of them."""

    title: Column
    summary: Column
    facet: Column
    picture: Column
    tie: Column
    name: Column
    area: Column

    def __post_init__(self):
        self.text = fold(F.concat_ws(" ", self.title, self.summary, self.tie))
        self.pictured, self.stand_in = self.picture.eqNullSafe("subject"), self.picture.eqNullSafe("stand-in")
        self.thin, self.bare = self.text.rlike(THIN), bare_name(self.name)

    def has(self, pattern: str) -> Column:
        return self.text.rlike(pattern)

    def told(self, cap: int) -> Column:
        return richness(self.summary, cap)

    def photo(self, yes: float, no: float = 0.0) -> Column:
        return F.when(self.pictured, float(yes)).otherwise(float(no))

    def news(self) -> Column:
        return 8 * first_points([(self.has(p), v) for p, v in NEWS], NEWS_REST) + self.photo(4) + self.told(2)

    def castle(self) -> Column:
        size = first_points([(self.area.isNull(), 1), *((self.area < below, p) for below, p in CASTLE_BELOW), (self.area > CASTLE_LARGE[0], CASTLE_LARGE[1])])
        return self.photo(14) + size + points((self.has(PLAIN_CASTLE), -8), (self.has(FAMOUS_CASTLE), 7), (self.has("tower house") & ~self.pictured, -5), (self.bare == CASTLE_MISTAKE, -20)) + self.told(4)

    def wildlife(self) -> Column:
        opening = fold(F.concat(F.coalesce(self.title, F.lit("")), F.lit(". "), F.substring(F.coalesce(self.summary, F.lit("")), 1, 320)))
        named, alone = mentions(opening, self.bare), ~listed_among_countries(self.text, self.bare)
        near = lambda p: phrase_near(self.text, self.bare, p)
        return self.photo(8, 1) + points(
            (alone & ((named & self.has(ENDEMIC)) | near(ENDEMIC)), 10), (named & alone & self.has(SUBSPECIES), 5), (mentions(fold(self.title), self.bare), 6),
            (alone & near(ONLY_HERE), 5), (self.has(EXTINCT), -8), (~named & self.has(COMMONPLACE), -6),
        ) + self.told(3)

    def whisky(self) -> Column:
        still, story = self.facet.eqNullSafe("distillery"), self.facet.eqNullSafe("story")
        hints = F.least(F.regexp_count(self.text, F.lit(WHISKY_HINTS)), F.lit(2))
        return of_table(self.facet, WHISKY, 1) + points((self.pictured & still, 8), (self.pictured & ~still, 3), (still & self.has(FAMOUS_STILL), 5), (story & self.has(WHISKY_STORY), 3)) + 2.0 * hints

    def book(self) -> Column:
        return points((self.pictured, 12), (self.stand_in, 4), (self.has(BOOK_FORM), 3), (self.has(FAMOUS_BOOK), 6)) + self.told(4)

    def tradition(self) -> Column:
        return points((self.pictured, 6), (self.stand_in, 2)) + first_points([(self.has(GREAT_TRADITION), 14), (self.has(KNOWN_TRADITION), 6)]) + self.told(4)

    def culture(self) -> Column:
        return F.when(self.thin, self.photo(3, 1)).otherwise(of_table(self.facet, CULTURE, 3) + self.photo(6) + points((self.has(FAMOUS_WORK), 6)) + self.told(4))

    def score(self, slug: Column) -> Column:
        models = {"unusual-news": self.news(), "island-castles": self.castle(), "unusual-wildlife": self.wildlife(), "whisky-distilleries": self.whisky(), "island-books": self.book(), "local-traditions": self.tradition(), "film-art-music": self.culture()}
        out = self.photo(2, 1)
        for name, model in models.items():
            out = F.when(slug == name, model).otherwise(out)
        return out


def river_plot(name: Column, kind: Column) -> Column:
    return F.coalesce(kind == "river", F.lit(False)) | fold(name).rlike(r"\beyot\b|\bait\b")


def tidal_score(name: Column, kind: Column, has_image: Column, others: Column, population: Column, area: Column) -> Column:
    """Tidal islands: pictures, famous walks, other interests, few people; river plots and large ones lose."""
    a = F.coalesce(area, F.lit(0.0))
    return points((has_image, 8), (bare_name(name).rlike(FAMOUS_WALK), 12), ((population > 0) & (population < 3000), 2), (river_plot(name, kind), -8)) + 5.0 * F.least(others, F.lit(2)) + first_points([(a.between(0.02, 20), 2), (a > 30, -3)])


def for_sale_score(name: Column, kind: Column, has_image: Column, area: Column, population: Column, titles: Column) -> Column:
    a, t = F.coalesce(area, F.lit(0.0)), fold(titles)
    base = first_points([(kind == "lake", 2), (river_plot(name, kind), -8)], 6)
    size = first_points([(a.between(0.02, 15), 4), ((a > 0) & (a < 0.02), 2), (a > 40, -4)])
    people = first_points([(population.isNull() | (population <= 30), 3), (population > 400, -4)])
    return base + points((has_image, 5), (t.rlike(DWELLINGS), -6), (t.rlike(WHOLE_ISLANDS), 5)) + size + people


def remote_score(name: Column, area: Column, has_image: Column, cited: Column, news: Column, elevation: Column) -> Column:
    """Uninhabited sea islands without a ferry. cited: how many interests but those for sale; news: whether one of them is news."""
    a = F.coalesce(area, F.lit(0.0))
    return points((a > 8000, -40), (has_image, 10), (news, 4), (elevation >= 100, 2), (bare_name(name).rlike(OUTPOST), 8)) + 4.0 * F.least(cited, F.lit(3)) + first_points([(a.between(0.05, 40), 4), (a > 100, -4)])


def scored_items(items: DataFrame, places: DataFrame) -> DataFrame:
    """Items with their place's columns, score, thin and pictured."""
    tie = F.col("tie") if "tie" in items.columns else F.lit(None).cast("string")
    it = Item(*(F.col(c) for c in ("title", "summary", "facet", "picture")), tie, F.col("name"), F.col("area"))
    return items.join(places, "place").withColumns({"score": it.score(F.col("slug")).cast("double"), "thin": it.thin, "pictured": it.pictured})


def place_scores(items: DataFrame, places: DataFrame, counted_sale: bool = True) -> DataFrame:
    """(place, slug, score): the best item of each interest and a little for every further one; tidal walks and islands for sale by the place itself. counted_sale: whether an offer is another interest of a tidal island."""
    j = scored_items(items, places)
    real = ~F.col("thin") | (F.col("slug") != "film-art-music")
    working = F.count(F.when(F.col("facet") == "distillery", 1))
    offers = F.collect_list(F.when(F.col("slug") == "for-sale", F.struct("item", "title")))  # only their titles are looked at as a whole
    best = j.groupBy("place", "slug").agg(
        F.max(F.when(real, F.col("score"))).alias("real_best"), F.max("score").alias("any_best"), F.count("*").alias("n"), F.count(F.when(real, 1)).alias("n_real"), working.alias("working"),
        F.countDistinct(F.when(real, F.col("facet"))).alias("facets"), F.array_join(F.transform(F.array_sort(offers), lambda x: x["title"]), " ").alias("titles"),
    ).join(places, "place")
    slugs = items.select("place", "slug").distinct().groupBy("place").agg(F.count("*").alias("slugs"), F.count(F.when(F.col("slug") == "for-sale", 1)).alias("sale"))
    s, c = F.col("slug"), F.col
    others = c("slugs") - 1 - (F.lit(0) if counted_sale else c("sale"))
    variety = F.when(s == "film-art-music", first_points([(c("facets") >= 3, 4), (c("facets") == 2, 2)])).otherwise(0.0)
    more = F.lit(0.0)
    for slug, (each, cap) in MORE.items():
        n = c("working") if slug == "whisky-distilleries" else c("n_real")
        more = F.when(s == slug, best_and_more(F.lit(0.0), n, each, cap)).otherwise(more)
    of_place = F.when(s == "for-sale", for_sale_score(c("name"), c("type"), c("has_image"), c("area"), c("population"), c("titles"))).when(s == "tidal-islands", tidal_score(c("name"), c("type"), c("has_image"), others, c("population"), c("area")))
    return best.join(slugs, "place").select("place", "slug", F.coalesce(of_place, F.coalesce("real_best", "any_best") + variety + more).alias("score"))


def atlas_ranking(items: DataFrame, places: DataFrame) -> DataFrame:
    """Places with their atlas score: shares of all interests but those for sale, pictures of what is cited, size."""
    shares = place_scores(items, places, False).filter("slug <> 'for-sale'").groupBy("place").agg(F.collect_list(interest_share(F.col("slug"), F.col("score"))).alias("shares"))
    subject = scored_items(items, places).filter("pictured and not thin and slug <> 'for-sale'").select("place", F.lit(True).alias("subject")).distinct()
    j = places.join(shares, "place", "left").join(subject, "place", "left")
    none = F.array().cast("array<double>")
    return j.select("place", atlas_score(F.coalesce("area", F.lit(0.0)), F.coalesce("shares", none), F.coalesce("subject", F.lit(False)), F.coalesce("has_image", F.lit(False))).alias("score"))


def remote_ranking(items: DataFrame, places: DataFrame) -> DataFrame:
    """(place, score) by what is cited of each place."""
    cited = items.filter("slug <> 'for-sale'").groupBy("place").agg(F.countDistinct("slug").alias("n"), F.max(F.col("slug") == "unusual-news").alias("news"))
    c = F.col
    return places.join(cited, "place", "left").select("place", remote_score(c("name"), c("area"), c("has_image"), F.coalesce("n", F.lit(0)), F.coalesce("news", F.lit(False)), c("elevation")).alias("score"))
