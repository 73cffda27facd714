"""Filter interaction audit: what each of several filters removes in every order, from one CUBE over their failures.

1.  ``judged`` gives every document its failures as columns; copies of a smaller doc_id's text are found by digests of whole
    texts, first counted, so that only digests held by several ids are looked up.
2.  ``audit`` counts documents by part and failures, which leaves at most a row for each combination, then takes a SQL CUBE
    over the failure columns and the part.  A grouping-set row whose selected flags are all false counts the documents that
    survive this subset of filters; a subset without a row has no survivors.
3.  Each step of each order joins the survivors of two subsets, before and after its filter; what a filter removes over all
    orders is the weighted sum over the subsets that may stand before it.

The documents are scanned once and never shuffled: what travels is a row of an id, a digest and flags.

Edge cases: a null text is an empty one, a null part the part ''; rows with a null doc_id are nobody's copy and make no copies, and
have no labels; rows that repeat a doc_id and its text count one by one, none being a copy of the other; repeated labels of
an id count once, as 1 if any is; texts of any length are judged whole; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import forget, small, written

#: Words are parted by the six ASCII white spaces.
WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
#: Digests of repeated texts that are sent to every executor at most; more are joined by a shuffle.
SMALL_COPIES = 100_000
#: Filters at most: all their orders are listed.
MOST_FILTERS = 7


def text_failures() -> dict[str, Column]:
    """The failures that a text alone tells, over the columns ``text`` (not null) and ``words``."""
    n, distinct, chars = F.size("words"), F.size(F.array_distinct("words")), F.length("text")
    capitals = chars - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    return {"A": n < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT_PERCENT * n, "C": 100 * capitals > MAX_CAPITALS_PERCENT * chars, "D": F.col("text").rlike(MARKS)}


def judged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, the failures A to E, good and toxic (0 or 1), and ``n``, for how many rows of ``docs`` a row stands.

    A to D are those of ``text_failures``; E: the text is that of a smaller doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    # Rows without an id have no copies: without a digest they are combined before the shuffle.
    digest = F.when(F.col("doc_id").isNotNull(), F.unhex(F.sha2("text", 256)))
    flags = text_failures()
    own = rows.select("doc_id", "part", digest.alias("digest"), *[c.alias(k) for k, c in flags.items()])
    own = written(own.groupBy("doc_id", "digest", "part", *flags).agg(F.count(F.lit(1)).alias("n")), "judged")
    held = own.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    copies = written(held.filter("low < high").select("digest", "low"), "copied-texts")
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))]
    )
    both = own.join(said, "doc_id", "left").join(small(copies, SMALL_COPIES), "digest", "left")
    copied = F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))
    return both.select("part", *flags, copied.alias("E"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")], "n")


def survivors(rows: DataFrame, filters: list[str]) -> DataFrame:
    """part, ``chosen`` (bit k: filter k) and the survivors of every subset of the filters: n, good, toxic; zeros included.

    ``rows`` has part, a boolean column of failures for each filter, good, toxic and n."""
    kinds = rows.groupBy("part", *filters).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    kinds = written(kinds, "kinds-of-failures")  # at most 2^filters rows a part
    names = ", ".join(f"`{f}`" for f in filters)
    selected = " + ".join(f"(1 - grouping(`{f}`)) * {1 << k}" for k, f in enumerate(filters))
    # A flag that isn't selected is null; a selected one must be false.
    clean = " AND ".join(f"`{f}` IS NOT TRUE" for f in filters)
    cube = rows.sparkSession.sql(
        f"""SELECT part, chosen, n, good, toxic FROM (
          SELECT part, {names}, grouping(part) AS no_part, CAST({selected} AS INT) AS chosen, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic
          FROM {{kinds}} GROUP BY CUBE ({names}, part)) WHERE no_part = 0 AND {clean}""",
        kinds=kinds,
    )
    subsets = kinds.select("part").distinct().withColumn("chosen", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "good", "toxic")]
    return subsets.join(cube, ["part", "chosen"], "left").select("part", "chosen", *zero)


def _steps(filters: list[str]) -> list[tuple[str, int, str, int, int]]:
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for at, k in enumerate(order):
            out.append(("".join(filters[i] for i in order), at + 1, filters[k], before, 1 << k))
            before |= 1 << k
    return out


def audit(rows: DataFrame, filters: list[str]) -> DataFrame:
    """A row for each part, filter_order and step: its ``filter``, and the counts kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley.  ``rows`` as for ``survivors``; at most ``MOST_FILTERS`` filters, of one-character names."""
    if not 1 <= len(filters) <= MOST_FILTERS or any(len(f) != 1 for f in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters of one-character names")
    spark, n, every = rows.sparkSession, len(filters), (1 << len(filters)) - 1
    alive = written(survivors(rows, filters), "survivors")  # 2^filters rows a part
    # Each filter behind each subset that may stand before it, and in how many orders just this subset does.
    pairs = [(s, 1 << k, factorial(b := s.bit_count()) * factorial(n - 1 - b)) for k in range(n) for s in range(every + 1) if not s >> k & 1]
    pairs = F.broadcast(spark.createDataFrame(pairs, "before int, own int, orders long"))
    counts = ["n", "good", "toxic"]
    first = alive.select("part", F.col("chosen").alias("before"), *[F.col(c).alias(f"{c}_0") for c in counts])
    second = alive.select("part", F.col("chosen").alias("after"), *[F.col(c).alias(f"{c}_1") for c in counts])
    step = first.join(pairs, "before").withColumn("after", F.col("before") + F.col("own")).join(second, ["part", "after"])
    lost = {c: F.col(f"{c}_0") - F.col(f"{c}_1") for c in counts}
    step = written(step.select("part", "before", "own", "orders", F.col("n_1").alias("kept"), lost["n"].alias("removed"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost")), "steps")
    at = lambda subset: F.max(F.when(F.col("before") == subset, F.col("removed")))
    whole = step.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"), at(0).alias("fails"), at(every - F.col("own")).alias("unique_fails"))
    listed = F.broadcast(spark.createDataFrame(_steps(filters), "filter_order string, step int, filter string, before int, own int"))
    out = step.join(whole, ["part", "own"]).join(listed, ["before", "own"])
    out = out.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    forget(alive)
    return out
