"""Tag text ("key"=>"value" pairs) and the map-feature rules that read it."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pair pattern, road classes, shop chains and tag values of the published definitions.
PAIR = r'"((?:[^"\\]|\\.)*)"=>"((?:[^"\\]|\\.)*)"'
WALKING_STREETS = ["residential", "living_street", "unclassified", "tertiary", "tertiary_link", "secondary",
                   "secondary_link", "primary", "primary_link", "trunk", "trunk_link", "pedestrian"]
CHAIN_WORDS = ["aldi", "coles", "foodworks", "iga", "woolworths"]
FOOT_ALLOWED = ["yes", "designated", "permissive"]
AMENITIES = ["toilets", "drinking_water"]
SHOP_KINDS = ["supermarket", "convenience", "newsagent", "grocery"]


def tag_map(text: Column) -> Column:
    """Tag text as a map. Escapes are kept as written, a later pair with the same key wins, missing text is an empty map."""
    keys = F.coalesce(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.array().cast("array<string>"))
    values = F.coalesce(F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)), F.array().cast("array<string>"))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    # Position from the end of the last pair with this key, so duplicates go without a session-wide map setting.
    last = F.filter(pairs, lambda pair, i: i == F.size(keys) - F.array_position(F.reverse(keys), pair["key"]))
    return F.map_from_entries(last)


def _value(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def walkable(tags: Column) -> Column:
    """Open to people on foot: no foot ban, not a motor road, and not closed unless foot traffic is allowed."""
    foot, access = _value(tags, "foot"), _value(tags, "access")
    banned = F.coalesce(foot == "no", F.lit(False)) | F.coalesce(_value(tags, "motorroad") == "yes", F.lit(False))
    closed = F.coalesce(access.isin("no", "private"), F.lit(False))
    allowed = F.coalesce(foot.isin(FOOT_ALLOWED), F.lit(False))
    return ~banned & (~closed | allowed)


def shop_kind(shop: Column, amenity: Column, text: Column) -> Column:
    """"supermarket", "convenience" or missing, from the shop tag, the amenity tag and the name with the brand."""
    chain = F.coalesce(text, F.lit("")).rlike(r"(?i)\b(" + "|".join(CHAIN_WORDS) + r")\b")
    return (F.when(shop == "supermarket", "supermarket")
            .when(shop.isin("convenience", "grocery") & chain, "supermarket")
            .when(shop.isin("convenience", "newsagent"), "convenience")
            .when(amenity == "fuel", "convenience"))


def zebra(*tags: Column) -> Column:
    found = F.lit(False)
    for tag in tags:
        found = found | F.coalesce(tag == "zebra", F.lit(False))
    return found
