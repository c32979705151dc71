"""Made-up labelled records for training and tests: three sources of noisy copies, distractors and their truth.

Every draw is a hash of an id, a purpose and the seed, so tables are made in parallel and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.sources.records import Dataset

COUNTRIES = ("US", "India", "France")
PLACES = {
    "US": [("Salem", "OR"), ("Austin", "TX"), ("Albany", "NY"), ("Dayton", "OH"), ("Fresno", "CA"), ("Macon", "GA")],
    "India": [("Pune", "Maharashtra"), ("Mysuru", "Karnataka"), ("Jaipur", "Rajasthan"), ("Kochi", "Kerala"), ("Surat", "Gujarat")],
    "France": [("Lille", "Nord"), ("Angers", "Maine et Loire"), ("Bordeaux", "Gironde"), ("Nantes", "Loire Atlantique")],
}
STREETS = {"US": ["Street", "Road", "Avenue", "Drive", "Lane"], "India": ["Road", "Street", "Nagar", "Sector"], "France": ["rue", "avenue", "boulevard", "place"]}
SHORT = {"Street": "St", "Road": "Rd", "Avenue": "Ave", "Drive": "Dr", "Lane": "Ln", "avenue": "av", "boulevard": "bd", "place": "pl"}
FORMS = {"US": ["LLC", "Inc.", "Corp", "Co"], "India": ["Pvt Ltd", "Limited", "LLP", "Private Limited"], "France": ["SARL", "SAS", "SA", "EURL"]}
FIRST = "Silver Golden Northern Southern Royal Modern Bright Rapid Urban Coastal Prime Green Blue Summit River Garden Crystal Pioneer Classic Global".split()
SECOND = "Harbor Maple Falcon Lotus Cedar Orion Tiger Banyan Saffron Willow Granite Meadow Anchor Comet Ember Juniper Lantern Marble Nimbus Quartz".split()
THIRD = "Traders Foods Motors Textiles Pharmacy Bakery Logistics Studio Hardware Jewellers Printing Electronics Furniture Travels Consulting Opticians".split()
WAYS = "Mill Oak Station Temple Market Lake Church Park College Hill Bridge Garden Palace Forest Spring Windsor".split()
#: Latin letters and how a record in another script writes them.
DEVANAGARI = ("abcdefghijklmnoprstuvyz", "ाबचदेफगहिजकलमनोपरसतुवयज")


@dataclass(frozen=True)
class World:
    """Shares are of entities, but noise, which scales the chance of every change of a copy."""

    entities: int = 8000
    seed: int = 42
    singletons: float = 0.06
    copies: float = 2.4
    most_copies: int = 10
    fakes: float = 0.18
    colocated: float = 0.05
    chains: float = 0.06
    background: float = 0.08
    other_script: float = 0.1
    noise: float = 0.85


def synthesize(spark: SparkSession, world: World = World()) -> Dataset:
    """Source 1 (one record an entity), sources 2 and 3 (noisy copies, near neighbours of entities, unrelated records), truth.

    Entities of a chain share their name, co-located ones their address; singletons have no copy. Copies number 1 and a
    Poisson draw, at most most_copies."""

    def u(*salt) -> Column:
        return F.pmod(F.xxhash64(F.lit(world.seed), *[x if isinstance(x, Column) else F.lit(x) for x in salt]), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def pick(words: list[str], *salt) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.floor(u(*salt) * len(words)) + 1).cast("int"))

    def of_country(words: dict[str, list[str]], *salt) -> Column:
        out = F.lit("")
        for c in COUNTRIES:
            out = F.when(F.col("country") == c, pick(words[c], *salt)).otherwise(out)
        return out

    n = F.col("n")

    def base(ids: DataFrame, kind: str) -> DataFrame:
        """n, country, first, form, hn, way, street, place of made-up businesses."""
        chain = F.when(u(n, kind, "chain") < world.chains, F.floor(u(n, kind, "brand") * max(1, world.entities // 50))).otherwise(n + 1_000_000_000)
        where = F.when(u(n, kind, "shared") < world.colocated, F.floor(n / 2)).otherwise(n + 1_000_000_000)
        d = ids.select("n", chain.alias("brand"), where.alias("where"), u(F.floor(n / 2), kind, "country").alias("c"))
        d = d.withColumn("country", F.when(F.col("c") < 0.5, "US").when(F.col("c") < 0.85, "India").otherwise("France"))
        b, w = F.col("brand"), F.col("where")
        places = {c: [f"{city}, {state}" for city, state in PLACES[c]] for c in COUNTRIES}
        return d.select(
            "n", "country", F.concat_ws(" ", pick(FIRST, b, kind, 1), pick(SECOND, b, kind, 2), pick(THIRD, b, kind, 3)).alias("name"), of_country(FORMS, n, kind, 4).alias("form"),
            (F.floor(u(w, kind, 5) * 2000) + 1).cast("int").alias("hn"), pick(WAYS, w, kind, 6).alias("way"), of_country(STREETS, w, kind, 7).alias("street"), of_country(places, w, kind, 8).alias("place"),
        )

    def line(hn: Column, street: Column, place: Column) -> Column:
        return F.concat_ws(", ", F.concat_ws(" ", F.when(hn.isNotNull(), hn.cast("string")), F.col("way"), street), place)

    entities = base(spark.range(world.entities).select(F.col("id").alias("n")), "e")
    s1_id = F.concat(F.lit("S1-"), n.cast("string"))
    s1 = entities.select(s1_id.alias("entity_id"), F.concat_ws(" ", "name", "form").alias("business_name"), line(F.col("hn"), F.col("street"), F.col("place")).alias("business_address"), "country")

    steps, mass, total = [], 2.718281828459045**-world.copies, 0.0
    for i in range(world.most_copies):
        total += mass
        steps.append(total)
        mass *= world.copies / (i + 1)
    many = F.lit(1)
    for step in steps[: world.most_copies - 1]:
        many = many + (u(n, "copies") > step).cast("int")
    many = F.when(u(n, "single") < world.singletons, 0).otherwise(many)
    copies = entities.withColumn("k", F.explode(F.when(many > 0, F.sequence(F.lit(1), many)).otherwise(F.array().cast("array<int>")))).withColumn("kind", F.lit("c"))
    fakes = entities.where(u(n, "fake") < world.fakes).withColumn("hn", F.col("hn") + 2 + F.floor(u(n, "beside") * 40).cast("int")).withColumn("k", F.lit(0)).withColumn("kind", F.lit("f"))
    others = base(spark.range(int(world.entities * world.background)).select(F.col("id").alias("n")), "b").withColumn("k", F.lit(0)).withColumn("kind", F.lit("b"))
    every = copies.unionByName(fakes).unionByName(others)

    def chance(p: float, what: str) -> Column:
        return u(n, F.col("k"), F.col("kind"), what) < p * world.noise

    at = F.floor(u(n, F.col("k"), F.col("kind"), "at") * (F.length("name") - 2)).cast("int") + 1
    typo = F.concat(F.substr("name", F.lit(1), at), F.substr("name", at + 2, F.lit(1)), F.substr("name", at + 1, F.lit(1)), F.substr("name", at + 3, F.lit(100)))
    name = F.when(chance(0.15, "typo"), typo).when(chance(0.08, "drop"), F.substring_index("name", " ", 2)).otherwise(F.col("name"))
    name = F.concat_ws(" ", name, F.when(~chance(0.35, "form"), F.col("form")))
    name = F.when(chance(0.2, "upper"), F.upper(name)).otherwise(name)
    foreign = (F.col("country") == "India") & (u(n, F.col("k"), F.col("kind"), "script") < world.other_script)
    name = F.when(foreign, F.translate(F.lower(name), *DEVANAGARI)).otherwise(name)
    abbreviated = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    street = F.when(chance(0.4, "short"), F.coalesce(F.try_element_at(abbreviated, F.col("street")), F.col("street"))).otherwise(F.col("street"))
    place = F.when(chance(0.1, "stateless"), F.substring_index("place", ",", 1)).otherwise(F.col("place"))
    whole = F.when(chance(0.03, "empty"), F.lit("")).otherwise(line(F.when(~chance(0.06, "number"), F.col("hn")), street, place))
    source = F.when(u(n, F.col("k"), F.col("kind"), "source") < 0.5, 2).otherwise(3)
    rec = F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.md5(F.concat_ws("|", F.lit(str(world.seed)), "kind", n.cast("string"), F.col("k").cast("string"))))
    all_ = every.select("n", "kind", rec.alias("entity_id"), name.alias("business_name"), whole.alias("business_address"), "country", source.cast("byte").alias("source"))
    truth = all_.where("kind = 'c'").select(s1_id.alias("s1"), F.col("entity_id").alias("rec"))
    return Dataset(s1, all_.drop("n", "kind"), truth, f"synthetic-{world.seed}")
