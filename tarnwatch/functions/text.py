"""Text helpers: number formatting, search input, place names, region tags, chunk ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """Fixed-point text, rounded by the exact binary value with ties to even.

    Spark rounds by the shortest decimal text of a double, so it takes 1.005 for a tie although the
    double lies below it. The side of the closest half step a value lies on is found exactly (the
    product is taken in two halves that fit a double) and the value moved a little that way.
    """
    x = value.cast("double")
    size = F.abs(x)
    scale = 10.0 ** (digits + 1)
    upper = size * 134217729.0 - (size * 134217729.0 - size)
    side = F.signum((upper * scale - F.rint(size * scale)) + (size - upper) * scale)
    rounded = F.bround(size * (1.0 + side * 1e-12), digits)
    # Negation keeps the sign of values that round to zero.
    return F.format_string(f"%.{digits}f", F.when(x < 0, -rounded).otherwise(rounded))


# Words that mark a place name as a water body (matched anywhere in the name).
WATER_WORDS = [
    "lake", "river", "bay", "gulf", "sea", "ocean", "reservoir", "pond", "creek", "strait",
    "delta", "marsh", "lagoon", "estuary", "canal", "harbor", "harbour", "inlet", "cove", "sound",
    "fjord", "dam", "basin", "waterway", "falls", "spring", "stream", "wetland", "swamp", "coast",
    "shore", "beach", "port", "channel", "loch", "lac", "lago", "rio", "meer",
]

# Keywords that place a text chunk in a region, in tie-breaking order.
REGION_KEYWORDS = {
    "lake_erie": [
        "lake erie", "toledo", "maumee", "western basin", "ohio", "davis-besse", "bp husky",
        "collins park", "cuyahoga", "sandusky", "portage river", "great lakes",
    ],
    "lake_victoria": [
        "lake victoria", "kisumu", "mwanza", "entebbe", "kagera", "winam gulf", "nzoia", "yala",
        "nile perch", "uganda", "kenya", "tanzania", "victoria nile", "east africa",
    ],
    "mekong_delta": [
        "mekong", "can tho", "hau river", "tien river", "vietnam", "mekong delta", "my tho",
        "ca mau", "shrimp", "rang dong", "monsoon", "south china sea", "saigon",
    ],
}


def is_water_name(name: Column) -> Column:
    return F.lower(name).rlike("|".join(WATER_WORDS))


def place_title(name: Column) -> Column:
    """Part before the first comma; a name without a comma is kept as it is."""
    comma = F.instr(name, ",")
    return F.when(comma == 0, name).otherwise(F.trim(F.substring(name, F.lit(1), comma - 1)))


def place_context(name: Column) -> Column:
    comma = F.instr(name, ",")
    return F.when(comma == 0, F.lit("")).otherwise(
        F.trim(F.substring(name, comma + 1, F.length(name)))
    )


def parse_coordinates(text: Column) -> Column:
    """``struct<lat, lon>`` from free text, or NULL.

    Degree signs and hemisphere letters are dropped without changing the sign. The first number is
    the latitude unless only the swapped reading is in range.
    """
    cleaned = F.regexp_replace(F.trim(text), "[°NSEWnsew]", "")
    pattern = r"^(-?\d+\.?\d*)[,\s]+(-?\d+\.?\d*)$"
    first = F.regexp_extract(cleaned, pattern, 1).try_cast("double")
    second = F.regexp_extract(cleaned, pattern, 2).try_cast("double")

    def point(lat: Column, lon: Column) -> Column:
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.when((F.abs(first) <= 90) & (F.abs(second) <= 180), point(first, second)).when(
        (F.abs(second) <= 90) & (F.abs(first) <= 180), point(second, first)
    )


def compose_place_name(place: Column, fallback: Column) -> Column:
    """Name, then city, town, county, state, country: the first three distinct non-empty parts."""
    address = place["address"]
    parts = F.array(
        place["name"], *[address[f] for f in ("city", "town", "county", "state", "country")]
    )
    kept = F.slice(F.array_distinct(F.filter(parts, lambda p: p.isNotNull() & (p != ""))), 1, 3)
    return F.coalesce(F.nullif(F.array_join(kept, ", "), F.lit("")), fallback)


def keyword_hits(lowered: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur in the text (each counts once)."""
    hits = [F.contains(lowered, F.lit(k)).cast("int") for k in keywords]
    return sum(hits[1:], hits[0])


def infer_region(text: Column, regions: Mapping[str, Sequence[str]] = REGION_KEYWORDS) -> Column:
    """Region with the most keyword hits; the first listed wins ties, no hit gives ``global``."""
    lowered = F.lower(text)
    scores = F.array(*[keyword_hits(lowered, words) for words in regions.values()])
    best = F.array_max(scores)
    names = F.array(*[F.lit(name) for name in regions])
    return F.when(best == 0, F.lit("global")).otherwise(
        F.element_at(names, F.array_position(scores, best).cast("int"))
    )


def chunk_id(source: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", F.replace(source, F.lit("."), F.lit("_")), index.cast("int"))
