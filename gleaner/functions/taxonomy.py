"""The three-level label taxonomy: valid triples, recovery of invalid ones, and overrides for famous sights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first level of labels.
VALID_L1 = ["Visit Intelligence", "Attention Intelligence", "Discovery Intelligence", "Culinary Intelligence", "Operational Intelligence"]
#: Fixed triples that every taxonomy holds.
EXTRA_COMBOS = [
    ("Operational Intelligence", "Pricing", "Entrance Fee"),
    ("Operational Intelligence", "Pricing", "Add-on Cost"),
    ("Operational Intelligence", "Pricing", "Third-party Markup"),
    ("Operational Intelligence", "Policy & Booking", "Refund Policy"),
    ("Operational Intelligence", "Policy & Booking", "Reservation Required"),
    ("Operational Intelligence", "Policy & Booking", "Age Restriction"),
    ("Operational Intelligence", "Facilities", "Restroom"),
    ("Operational Intelligence", "Facilities", "Climate Control"),
    ("Operational Intelligence", "Facilities", "Seating"),
    ("Operational Intelligence", "Third-party Operator", "Tour Operator"),
    ("Operational Intelligence", "Third-party Operator", "Reseller Platform"),
    ("Attention Intelligence", "Iconic Artwork", "Painting"),
    ("Attention Intelligence", "Iconic Artwork", "Sculpture"),
    ("Attention Intelligence", "Iconic Landmark", "Monument"),
]
#: Fixed overrides: place, anchor, l2, l3; the first that fits a cluster holds.
FAMOUS_ANCHORS = [
    ("Louvre Museum", "mona lisa", "Iconic Artwork", "Painting"),
    ("Louvre Museum", "la joconde", "Iconic Artwork", "Painting"),
    ("Louvre Museum", "venus de milo", "Iconic Artwork", "Sculpture"),
    ("Louvre Museum", "winged victory", "Iconic Artwork", "Sculpture"),
    ("Louvre Museum", "winged victory of samothrace", "Iconic Artwork", "Sculpture"),
    ("Louvre Museum", "liberty leading the people", "Iconic Artwork", "Painting"),
    ("Louvre Museum", "louvre pyramid", "Iconic Landmark", "Monument"),
    ("Louvre Museum", "the pyramid", "Iconic Landmark", "Monument"),
    ("Colosseum", "colosseum", "Iconic Landmark", "Monument"),
    ("Colosseum", "arch of constantine", "Iconic Landmark", "Monument"),
]
_COMBO = "ord int, l1 string, l2 string, l3 string"


def combos(spark: SparkSession, approved: DataFrame | None = None) -> DataFrame:
    """ord, l1, l2, l3: the approved triples without blanks, then the fixed ones that are not among them."""
    rows = [] if approved is None else [tuple(x.strip() for x in r) for r in approved.select("l1", "l2", "l3").collect() if all(r)]
    rows += [c for c in EXTRA_COMBOS if c not in rows]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], _COMBO)


def lookups(taxonomy: DataFrame) -> DataFrame:
    """l1, l2s and l3s: the values under each, in order of first appearance."""
    pairs = taxonomy.groupBy("l1", "l2").agg(F.min("ord").alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "l3"))), lambda x: x["l3"]).alias("l3s"))
    return pairs.groupBy("l1").agg(F.array_sort(F.collect_list(F.struct("ord", "l2", "l3s"))).alias("under"))


def recover(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``labels`` (l1, l2, l3, ...) with ``label_valid`` and, for invalid triples, the nearest valid one: l1 stays, l2 and
    l3 are kept if they fit and else are the first there is.  An unknown l1 leaves the triple as it is, invalid."""
    own = F.broadcast(lookups(taxonomy).withColumnRenamed("l1", "known"))
    df = labels.join(own, F.col("l1") == F.col("known"), "left")
    same = F.filter("under", lambda u: u["l2"] == F.col("l2"))
    pick = F.when(F.size(same) > 0, same[0]).otherwise(F.get("under", F.lit(0)))
    l3 = F.when(F.array_contains(pick["l3s"], F.col("l3")), F.col("l3")).otherwise(F.array_min(F.transform(pick["l3s"], lambda x, i: F.struct(i, x.alias("x"))))["x"])
    df = df.withColumns({"_l2": pick["l2"], "_l3": l3})
    valid = F.coalesce((F.col("l2") == F.col("_l2")) & (F.col("l3") == F.col("_l3")), F.lit(False))
    moved = F.col("known").isNotNull() & ~valid
    return df.withColumns(
        {"label_valid": valid, "label_recovered": moved, "l2": F.when(moved, F.col("_l2")).otherwise(F.col("l2")), "l3": F.when(moved, F.col("_l3")).otherwise(F.col("l3"))}
    ).drop("known", "under", "_l2", "_l3")


def override_famous(clusters: DataFrame) -> DataFrame:
    """Clusters labelled a hidden highlight that carry a famous anchor of their place, or its name, become iconic."""
    spark = clusters.sparkSession
    rules = spark.createDataFrame([(k, *r) for k, r in enumerate(FAMOUS_ANCHORS)], "ord int, poi string, anchor string, to_l2 string, to_l3 string")
    rules = rules.groupBy("poi").agg(F.array_sort(F.collect_list(F.struct("ord", "anchor", "to_l2", "to_l3"))).alias("rules"))
    df = clusters.join(F.broadcast(rules), F.col("poi_name") == F.col("poi"), "left").drop("poi")
    anchors = F.transform(F.coalesce("anchor_entities", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    name = F.lower(F.coalesce("name", F.lit("")))
    fits = F.filter("rules", lambda r: F.array_contains(anchors, r["anchor"]) | F.contains(name, r["anchor"]))
    rule = F.get(fits, F.lit(0))
    hit = (F.col("l2") == "Hidden Highlight") & rule.isNotNull()
    return df.withColumns(
        {
            "l1": F.when(hit, "Attention Intelligence").otherwise(F.col("l1")),
            "l3": F.when(hit, rule["to_l3"]).otherwise(F.col("l3")),
            "l2": F.when(hit, rule["to_l2"]).otherwise(F.col("l2")),
        }
    ).drop("rules")


def post_process(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Overrides, then recovery; a recovered label's confidence is at most 0.5 and its reasoning says so."""
    df = recover(override_famous(labels), taxonomy)
    return df.withColumns(
        {
            "label_confidence": F.when(F.col("label_recovered"), F.least("label_confidence", F.lit(0.5))).otherwise(F.col("label_confidence")),
            "reasoning": F.when(F.col("label_recovered"), F.concat_ws(" ", "reasoning", F.lit("[auto-recovered to valid combo]"))).otherwise(F.col("reasoning")),
        }
    ).drop("label_recovered")


def prompt_lines(taxonomy: DataFrame) -> DataFrame:
    """l1 and its text for a prompt: a line for each l2 with its l3 values."""
    line = lambda u: F.concat(F.lit("  "), u["l2"], F.lit("  →  "), F.array_join(u["l3s"], ", "))
    return lookups(taxonomy).select("l1", F.concat(F.lit("=== "), "l1", F.lit(" ===\n"), F.array_join(F.transform("under", line), "\n")).alias("text"))
