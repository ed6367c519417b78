"""Classification of mapped facilities from their tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags kept as context on a facility.
CONTEXT_TAGS = [
    "operator", "product", "industrial", "landuse", "man_made", "amenity", "capacity", "website",
    "description",
]
# Per group the most zones kept for one event (nearest first).
GROUP_CAPS = {3: 20, 4: 10}


def present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def facility_type(tags: Column) -> Column:
    """Source type by the first matching tag rule."""
    craft, industrial = tags["craft"], tags["industrial"]
    return (
        F.when(tags["man_made"] == "wastewater_plant", "wastewater_plant")
        .when(tags["amenity"] == "waste_disposal", "waste_disposal")
        .when(industrial == "chemical", "chemical_plant")
        .when(industrial == "slaughterhouse", "slaughterhouse")
        .when(tags["man_made"] == "works", "industrial_works")
        .when(tags["landuse"] == "farmland", "farmland")
        .when(tags["landuse"] == "industrial", "industrial_zone")
        .when(present(craft), F.concat(F.lit("craft_"), craft))
        .when(tags["building"] == "industrial", "industrial_building")
        .when(present(industrial), F.concat(F.lit("industrial_"), industrial))
        .otherwise("industrial")
    )


def facility_name(tags: Column, kind: Column) -> Column:
    """Best available name, else the type in title case."""
    named = [F.nullif(tags[k], F.lit("")) for k in ("name", "name:en", "official_name", "operator")]
    return F.coalesce(*named, F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def source_category(kind: Column) -> Column:
    return (
        F.when(kind.isin("wastewater_plant", "waste_disposal"), "municipal")
        .when(kind == "farmland", "agricultural")
        .otherwise("industrial")
    )


def context_tags(tags: Column) -> Column:
    """The non-empty context tags, in the order they are listed above."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), tags[k].alias("value")) for k in CONTEXT_TAGS])
    return F.map_from_entries(F.filter(entries, lambda e: present(e["value"])))


def search_groups(element_type: Column, tags: Column) -> Column:
    """Priority groups an element belongs to, as an array of group numbers.

    1 named point sources, 2 named industry and any craft, 3 industrial zones, 4 farmland. Zones
    are ways; the other rules take nodes and ways alike.
    """
    way = element_type == "way"
    mapped = element_type.isin("node", "way")
    industrial, landuse = tags["industrial"], tags["landuse"]
    point_source = mapped & (
        tags["man_made"].isin("wastewater_plant", "works")
        | industrial.isin("chemical", "slaughterhouse")
        | (tags["amenity"] == "waste_disposal")
    )
    named_industry = tags["name"].isNotNull() & (
        industrial.isNotNull()
        | (way & (landuse == "industrial"))
        | (tags["building"] == "industrial")
    )
    rules = [
        point_source,
        mapped & (named_industry | tags["craft"].isNotNull()),
        way & (landuse == "industrial"),
        way & (landuse == "farmland"),
    ]
    numbered = F.array(*[F.when(rule, number) for number, rule in enumerate(rules, start=1)])
    return F.array_compact(numbered)


def identity(name: Column, kind: Column, lat: Column, lon: Column) -> Column:
    """Identity of a facility for duplicate removal: name, type and position to 3 decimals.

    Kept as two independent 64-bit hashes, so that ranking candidates need not carry the texts.
    """
    parts = name, kind, F.round(lat * 1000).cast("long"), F.round(lon * 1000).cast("long")
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))
