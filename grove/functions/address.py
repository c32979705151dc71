"""Canonical addresses: states and departments by one name, street words in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.operators.blocking import US_STATES

# Street words and what they stand for, by country; an empty one is dropped.
STREET = {
    "US": {
        "st": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "hwy": "highway", "pkwy": "parkway", "cir": "circle", "ter": "terrace", "trl": "trail",
        "sq": "square", "ste": "suite", "apt": "apartment", "fl": "floor", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "mt": "mount", "ft": "fort",
    },
    "India": {"rd": "road", "st": "street", "nr": "near", "opp": "opposite", "bldg": "building", "flr": "floor", "fl": "floor", "apt": "apartment", "sec": "sector", "ph": "phase", "ngr": "nagar", "extn": "extension", "ext": "extension", "dist": "district", "no": "", "hno": "", "h": ""},
    "France": {
        "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "boul": "boulevard", "all": "allee", "imp": "impasse", "rte": "route", "pl": "place", "q": "quai", "fbg": "faubourg", "ch": "chemin", "chem": "chemin", "sq": "square",
        "pass": "passage", "crs": "cours", "res": "residence", "st": "saint", "ste": "sainte", "ndeg": "", "no": "", "n": "",
    },
}
# Whole address components that name a state or region, and its one name.
STATES = {
    "US": US_STATES,
    "India": {
        "up": "uttar pradesh", "mh": "maharashtra", "ka": "karnataka", "tn": "tamil nadu", "gj": "gujarat", "wb": "west bengal", "ts": "telangana", "tg": "telangana", "hr": "haryana", "kl": "kerala", "rj": "rajasthan", "br": "bihar", "mp": "madhya pradesh",
        "ap": "andhra pradesh", "od": "orissa", "or": "orissa", "odisha": "orissa", "pb": "punjab", "dl": "delhi", "jh": "jharkhand", "cg": "chhattisgarh", "uk": "uttarakhand", "hp": "himachal pradesh", "jk": "jammu and kashmir", "as": "assam", "ga": "goa",
    },
    "France": {
        "nord": "hauts de france", "pas de calais": "hauts de france", "somme": "hauts de france", "aisne": "hauts de france", "oise": "hauts de france", "hdf": "hauts de france", "gironde": "nouvelle aquitaine", "landes": "nouvelle aquitaine",
        "dordogne": "nouvelle aquitaine", "lot et garonne": "nouvelle aquitaine", "pyrenees atlantiques": "nouvelle aquitaine", "charente": "nouvelle aquitaine", "charente maritime": "nouvelle aquitaine", "naq": "nouvelle aquitaine",
        "loire atlantique": "pays de la loire", "vendee": "pays de la loire", "maine et loire": "pays de la loire", "sarthe": "pays de la loire", "mayenne": "pays de la loire", "pdl": "pays de la loire",
    },
}


def flat(words: dict[str, dict[str, str]]) -> dict[str, str]:
    """country|word to word."""
    return {f"{country}|{a}": b for country, own in words.items() for a, b in own.items()}


def _named(words: dict[str, dict[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for kv in flat(words).items() for x in kv])


def canonical(country: Column, parts: Column) -> Column:
    """The address components as one text: states by one name, street words in full, order kept. Null or no parts: empty."""
    of = lambda words, x: F.coalesce(F.try_element_at(_named(words), F.concat(country, F.lit("|"), x)), x)
    whole = F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda p: of(STATES, p))
    words = F.transform(F.flatten(F.transform(whole, lambda p: F.split(p, " "))), lambda w: of(STREET, w))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def canonical_addresses(df: DataFrame) -> DataFrame:
    """entity_id, canon of a normalised table (entity_id, country, parts)."""
    return df.select("entity_id", canonical(F.col("country"), F.col("parts")).alias("canon"))
