"""Lines of a briefing from the figures of its sources, and the labels and gates around them. Native expressions throughout.

A clause is left out where one of its figures is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clause(*parts: Column | str) -> Column:
    """Text and figures one after the other; null where a figure is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def line(*clauses: Column) -> Column:
    """The clauses that are there, one after the other."""
    return F.concat(*[F.coalesce(c, F.lit("")) for c in clauses])


# ---------------------------------------------------------------- lines

# The wording of the lines.


def gauge_line(name: Column, number: Column, km: Column, stage: Column, discharge: Column, observed: Column) -> Column:
    """Observed is an ISO time, shown to the minute."""
    when = F.replace(F.substring(observed, 1, 16), F.lit("T"), F.lit(" "))
    return line(clause("Nearest USGS stream gauge, ", name, " (", number, ", ", km, " km away): stage ", stage, " ft"), clause(", discharge ", discharge, " ft³/s"), clause(", observed ", when, "."))


def zone_line(zone: Column, special: Column, panel: Column, year: Column) -> Column:
    return line(clause("This address sits in FEMA flood zone ", zone), F.when(special, " (a Special Flood Hazard Area)"), clause(", per NFHL FIRM panel ", panel, ", effective ", year), F.lit("."))


def terrain_line(elevation: Column, percentile: Column, hand: Column, wetness: Column, relief: Column) -> Column:
    """Elevation, HAND and wetness to two places, the percentile to one."""
    two = lambda c: F.round(c, 2)
    return line(
        clause("Elevation ", two(elevation), " m"), clause("; this point sits at the ", F.round(percentile, 1), "th percentile of elevation within a 200 m window (lower percentile = topographic low)"),
        clause("; HAND ", two(hand), " m above nearest drainage"), clause("; TWI ", two(wetness)), clause(". Local basin relief: ", two(relief), " m."),
    )


def extent_line(inside: Column, nearest_m: Column, close: Column) -> Column:
    """The storm's water polygons seen by satellite: inside or not, how far the nearest is, and how many are within 500 m."""
    where = F.when(inside, "sits inside").otherwise("is outside")
    return line(
        clause("this address ", where, " the empirical post-event water polygon"), F.when(~inside, clause(" (nearest mask ", nearest_m, " m away)")),
        F.when(close > 0, clause("; ", close, " distinct flood polygons within 500 m")), F.lit("."),
    )


def water_line(percent: Column, day: Column, cloud: Column) -> Column:
    scene = line(clause(" Sentinel-2 scene from ", day), clause(" (", F.round(cloud, 1), "% cloud cover)"), F.lit("."))
    return line(clause(F.round(percent, 1), "% water within 500 m of this address."), F.when(day.isNotNull(), scene))


def marks_line(n: Column, radius: int, elevation: Column, above: Column, site: Column, distance: Column) -> Column:
    """High-water marks within a radius; without any, the nearest one."""
    metres = distance.cast("long")
    some = line(
        clause("USGS surveyed ", n, f" Hurricane Ida high-water mark(s) within {radius} m of this address"), clause("; the highest observed water elevation was ", elevation, " ft"),
        clause(" (up to ", above, " ft above ground)"), clause(". Nearest mark: ", site, " (", metres, " m away)"), F.lit("."),
    )
    none = line(F.lit(f"No Hurricane Ida (Sept 2021) high-water marks were surveyed within {radius} m of this address."), clause(" Nearest USGS-surveyed mark: ", site, " (", metres, " m away)."))
    return F.when(n > 0, some).otherwise(none)


def position(percentile: Column) -> Column:
    """Where a point stands among its surroundings."""
    return F.when(percentile < 25, "low point").when(percentile > 75, "high ground").otherwise("mid-slope")


# Labels of depth classes.
DEPTHS = {0: "outside", 1: "Nuisance (>4 in to 1 ft)", 2: "Deep & Contiguous (1-4 ft)", 3: "Deep Contiguous (>4 ft)"}


def depth_label(depth: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DEPTHS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, depth.cast("int")), F.lit(DEPTHS[0]))


# ---------------------------------------------------------------- labels


def site_name(raw: Column) -> Column:
    """A name in capitals as a title; the state at its end, two letters, stays in capitals."""
    runs = F.regexp_extract_all(raw, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    words = F.filter(F.split(F.array_join(F.transform(runs, F.initcap), ""), r"\s+"), lambda w: w != "")
    title = F.array_join(words, " ")
    return F.when(F.length(F.try_element_at(words, F.lit(-1))) == 2, F.concat(F.substr(title, F.lit(1), F.length(title) - 2), F.upper(F.right(title, F.lit(2))))).otherwise(title)


def entrance_label(name: Column, north_south: Column, east_west: Column, corner: Column) -> Column:
    """Station, crossing and corner, those that are not blank."""
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    crossing = F.nullif(F.concat_ws(" & ", known(north_south), known(east_west)), F.lit(""))
    return F.concat_ws(", ", known(name), crossing, clause("(", known(corner), ")"))


def heading(tagline: Column, name: Column) -> Column:
    """A section's heading: the tagline (or name) without a leading "the", with a capital and a full stop."""
    tag = F.regexp_replace(F.trim(F.coalesce(F.nullif(tagline, F.lit("")), name)), "(?i)^the ", "")
    return F.concat(F.upper(F.left(tag, F.lit(1))), F.substring(tag, 2, 1_000_000), F.lit("."))


def cell_number(cell: Column) -> Column:
    """12U is 12 and 3D is -3; so are 12R and 3L."""
    n = F.regexp_extract(cell, "^([0-9]+)", 1).try_cast("long")
    return F.when(F.right(cell, F.lit(1)).isin("U", "R"), n).otherwise(-n)


def hardware(url: Column, label: Column, hosted: Column) -> Column:
    """The kind of machine a call ran on: by an operator's label, else by where it went."""
    # Parts of labels in order of precedence, and their kinds.
    kinds = [("mi300x", "amd_mi300x"), ("amd", "amd_mi300x"), ("a100", "nvidia_a100"), ("l4", "nvidia_l4"), ("t4", "nvidia_t4"), ("nvidia", "nvidia_l4"), ("apple", "apple_m"), ("m3", "apple_m"), ("m4", "apple_m")]
    named, to = F.lower(F.coalesce(label, F.lit(""))), F.coalesce(url, F.lit(""))
    remote = (to != "") & ~to.contains("localhost") & ~to.contains("127.0.0.1")
    out = F.when(named.contains(kinds[0][0]), kinds[0][1])
    for part, kind in kinds[1:]:
        out = out.when(named.contains(part), kind)
    return out.when(remote & to.contains(".modal.run") & to.contains("-vllm"), "nvidia_a100").when(remote, "nvidia_l4").when(hosted, "nvidia_t4").otherwise("apple_m")


# ---------------------------------------------------------------- gates

# Words after a comma or space that name a place elsewhere: states, cities of other states, countries, cities abroad.
STATES = "AL|AK|AZ|AR|CA|CO|CT|DE|DC|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY"
CITIES = (
    "chicago|los angeles|san francisco|seattle|boston|philadelphia|philly|houston|dallas|austin|miami|atlanta|denver|portland|"
    "san diego|phoenix|minneapolis|detroit|baltimore|washington dc"
)
COUNTRIES = (
    "japan|china|korea|mexico|canada|uk|united kingdom|france|germany|italy|spain|portugal|netherlands|belgium|sweden|norway|denmark|"
    "australia|new zealand|india|brazil|argentina|chile|colombia|russia|poland|turkey|egypt|south africa|israel|prefecture|province|kingdom of"
)
ABROAD = (
    "london|paris|tokyo|beijing|shanghai|mumbai|delhi|toronto|vancouver|sydney|melbourne|berlin|rome|madrid|amsterdam|dublin|"
    "seoul|hong kong|singapore|dubai|cairo|lagos|nairobi|mexico city|sao paulo|buenos aires|moscow|istanbul"
)
ELSEWHERE = rf"(?i)(?:,|\s)\s*(?:{STATES}|{CITIES}|{COUNTRIES})\b"
FOREIGN = rf"(?i)(?:,|\s)\s*(?:{COUNTRIES}|{ABROAD})\b"
# The box that the city's own steps are limited to, as (min_lon, min_lat, max_lon, max_lat).
CITY_BOX = (-74.27, 40.49, -73.69, 40.92)


def in_city(lat: Column, lon: Column) -> Column:
    """False also without coordinates."""
    west, south, east, north = CITY_BOX
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def policy_query(address: Column, borough: Column, storm: Column, scenarios: Column) -> Column:
    """What policy documents are searched for: null, and so no search, where neither an address nor a point is known."""
    inside = F.transform(scenarios, lambda label: clause("in ", label, " pluvial scenario"))
    tail = F.lit("flood resilience plan, vulnerability, hardening, mitigation")
    return F.concat_ws("; ", clause("address ", address), clause("in ", borough), F.when(storm, "inside Hurricane Sandy 2012 inundation zone"), inside, tail)


def bound(spec: dict | object, columns: dict[str, Column]) -> Column:
    """The column an argument stands for: {"const": value}, {"source": name}, or a plain value."""
    if not isinstance(spec, dict):
        return F.lit(spec)
    if "const" in spec:
        return F.lit(spec["const"])
    if spec.get("source") not in columns:
        raise ValueError(f"unknown source {spec.get('source')!r}")
    return columns[spec["source"]]


def bound_all(arguments: dict, inject: dict, columns: dict[str, Column]) -> dict[str, Column]:
    """All arguments; injected constants stand above them."""
    return {name: bound(spec, columns) for name, spec in arguments.items()} | {name: F.lit(v) for name, v in inject.items()}


def traced(value: Column, names: dict[str, str]) -> list[Column]:
    """Fields of a result under the names of its trace; "__value__" is the whole of it."""
    return [(value if field == "__value__" else value[field]).alias(name) for name, field in names.items()]
