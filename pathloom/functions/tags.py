"""Way tags and units as column expressions: access, oneway, speed, length and weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAR, BIKE, FOOT = 1, 2, 4
ALL = CAR | BIKE | FOOT

# The access classes, speeds and units that road tags stand for.
ACCESS = {
    ALL: ["trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "road", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "service"],
    CAR: ["motorway", "motorway_link"],
    BIKE | FOOT: ["path", "track"],
    FOOT: ["footway", "pedestrian", "steps"],
    BIKE: ["cycleway"],
}
OVERRIDES = [("access", ALL), ("foot", FOOT), ("vehicle", CAR | BIKE), ("bicycle", BIKE), ("motor_vehicle", CAR), ("motorcar", CAR)]
SPEEDS = {
    130.0: ["motorway"],
    80.0: ["motorway_link"],
    30.0: ["cycleway"],
    50.0: ["residential", "trunk", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "unclassified", "tertiary_link"],
}
ONEWAY_CLASSES = ["motorway", "motorway_link", "trunk"]
TRUE_WORDS = ["yes", "true", "1", "designated"]
SPEED_UNITS = {1.0: ["", "km/h", "kph", "kmph", "km", "kmh", "km/hour", "kmp", "km/hr"], 1.609344: ["mph"], 1.852: ["knots", "knoten", "kt"]}
LENGTH_UNITS = {1.0: ["", "m", "metre", "metres", "meter"], 0.01: ["cm"], 1000.0: ["km", "kilometre", "kilometres", "kilometer", "kilometers"], 1609.344: ["mi", "mile", "miles"]}
WEIGHT_UNITS = {1.0: ["", "t", "tons", "tonnes", "to", "ton", "te"], 0.001: ["kg"], 0.4536 / 1000: ["lb", "lbs"]}


def tag(tags: Column, key: str) -> Column:
    """A tag's value, null if the way hasn't the tag."""
    return F.try_element_at(tags, F.lit(key))


def parse_bool(value: Column) -> Column:
    """True for yes, true, 1 and designated in any case; else, and for null, false."""
    return F.coalesce(F.lower(value).isin(*TRUE_WORDS), F.lit(False))


def parse_number(value: Column) -> Column:
    """A number with a decimal point or comma (the first comma counts); null if it is none."""
    return F.regexp_replace(value, "^([^,]*),", "$1.").try_cast("double")


def _measure(value: Column, units: dict[float, list[str]]) -> Column:
    """A number (a plus before it is skipped) and the word that follows it, blanks between or none."""
    plain = F.regexp_replace(F.lower(F.ltrim(F.regexp_replace(value, "[\\t\\n\\r]", " "))), "^[+]", "")
    digits = F.regexp_extract(plain, "^[0-9]+(?:[,.][0-9]+)?", 0)
    number = parse_number(digits)
    unit = F.regexp_extract(F.ltrim(F.substr(plain, F.length(digits) + 1)), "^[a-z0-9_/]+", 0)
    out = F.lit(None).cast("double")
    for factor, names in units.items():
        out = F.when(unit.isin(*names), number if factor == 1.0 else number * factor).otherwise(out)
    return out


def parse_speed(value: Column) -> Column:
    """km/h, or null for what isn't a speed."""
    return _measure(value, SPEED_UNITS)


def parse_weight(value: Column) -> Column:
    """Metric tons, or null for what isn't a weight."""
    return _measure(value, WEIGHT_UNITS)


def parse_length(value: Column) -> Column:
    """Metres, or null for what isn't a length; feet and inches are tried first."""
    plain = F.ltrim(F.regexp_replace(value, "[\\t\\n\\r]", " "))
    begun = F.regexp_extract(plain, "^[0-9]+(?:ft|feet|')", 0)
    rest = F.regexp_replace(F.ltrim(F.substr(plain, F.length(begun) + 1)), "^- *", "")
    feet = F.regexp_extract(begun, "^[0-9]+", 0)
    inches = F.regexp_extract(F.regexp_extract(rest, "^[0-9]+(?:in|\")", 0), "^[0-9]+", 0)
    number = lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when((feet != "") | (inches != ""), (number(feet) * 12 + number(inches)).cast("double") * 0.0254).otherwise(_measure(value, LENGTH_UNITS))


def is_road(tags: Column) -> Column:
    return F.map_contains_key(tags, "highway") | F.map_contains_key(tags, "junction") | F.coalesce(tag(tags, "route") == "ferry", F.lit(False))


def is_ferry(tags: Column) -> Column:
    return F.coalesce(tag(tags, "route") == "ferry", F.lit(False))


def under_construction(tags: Column) -> Column:
    return parse_bool(tag(tags, "construction"))


def default_access(tags: Column) -> Column:
    """Modes that a way's class admits, as a mask of CAR, BIKE and FOOT."""
    out = F.when(parse_bool(tag(tags, "motorroad")), CAR)
    for mask, classes in ACCESS.items():
        out = out.when(tag(tags, "highway").isin(*classes), mask)
    return out.when(is_ferry(tags), BIKE | FOOT).otherwise(0)


def access_mask(tags: Column) -> Column:
    """Modes that a way admits: its class's, overridden by access tags from the general to the special.

    For each mode the most special tag that is present decides, so the expression grows with the tags only.
    """
    base, mask = default_access(tags), F.lit(0)
    for mode in (CAR, BIKE, FOOT):
        said = [F.when(tag(tags, key).isNotNull(), parse_bool(tag(tags, key))) for key, modes in reversed(OVERRIDES) if modes & mode]
        mask = mask + F.when(F.coalesce(*said, base.bitwiseAND(mode) > 0), mode).otherwise(0)
    return F.when(~is_road(tags) | under_construction(tags), 0).otherwise(mask)


def oneway_state(tags: Column) -> Column:
    """``forward``, ``reversed``, ``both``, or ``unsafe`` for a tag that can't be read."""
    value = tag(tags, "oneway")
    implied = F.coalesce(tag(tags, "junction") == "roundabout", F.lit(False)) | F.coalesce(tag(tags, "highway").isin(*ONEWAY_CLASSES), F.lit(False))
    return F.when(value.isin("yes", "true", "1"), "forward").when(value == "-1", "reversed").when(value.isin("no", "false", "0"), "both").when(implied, "forward").when(value.isNotNull(), "unsafe").otherwise("both")


def default_speed(tags: Column) -> Column:
    out = F.when(parse_bool(tag(tags, "motorroad")), 130.0).when(tag(tags, "bicycle") == "designated", 30.0).when(is_ferry(tags), 12.0)
    for speed, classes in SPEEDS.items():
        out = out.when(tag(tags, "highway").isin(*classes), speed)
    return out.otherwise(10.0)


def max_speed(tags: Column) -> Column:
    """km/h: what the tag says, 130 for none, the class's where the tag is missing or can't be read, 0 off roads."""
    value = tag(tags, "maxspeed")
    read = F.when(value == "none", 130.0).when(value == "signals", default_speed(tags)).otherwise(F.coalesce(parse_speed(value), default_speed(tags)))
    return F.when(~is_road(tags) | under_construction(tags), 0.0).otherwise(read)
