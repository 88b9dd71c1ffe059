"""Names searched by their grams: all pairs above a similarity without meeting all names of a group.

The similarity is ``1 - distance / longer length`` of lower-cased trimmed names.  A name
within distance d of another lacks at most 2 d of its distinct two-letter grams (with an
edge mark on both sides), so the 2 d + 1 rarest of them hold one that both share: only
these are looked up in the inverted index of the other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import trimmed, truthy

FIRST_GRAMS, FIRST_MOST = 3, 256


def normal(name: Column) -> Column:
    """Lower-cased and trimmed; null where there is no name."""
    return F.lower(trimmed(truthy(name)))


def similarity(x: Column, y: Column) -> Column:
    """Of two normal names; 1 if equal, 0 if one is blank."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(F.lit(1.0) - F.levenshtein(x, y) / longest)


def grams(x: Column) -> Column:
    """Distinct two-letter grams of a name between edge marks."""
    edged = F.concat(F.lit("\x01"), x, F.lit("\x02"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.substring(edged, i, F.lit(2))))


def gram_postings(names: DataFrame, group: list[str], name: str) -> DataFrame:
    """The inverted index: ``group, gram, name``."""
    return names.select(*group, F.explode(grams(F.col(name))).alias("gram"), name)


def _ranked(asked: DataFrame, group: list[str], sizes: DataFrame) -> DataFrame:
    """Each gram of the asked names with its rank from the rarest; grams that the index lacks come first."""
    each = asked.withColumn("gram", F.explode(grams(F.col("x")))).join(sizes, [*group, "gram"], "left").fillna(0, ["df"])
    return each.withColumn("rank", F.row_number().over(W.partitionBy(*group, "x").orderBy("df", "gram")))


def _compared(pairs: DataFrame, group: list[str], least) -> DataFrame:
    return pairs.withColumn("sim", similarity(F.col("x"), F.col("y"))).filter(F.col("sim") >= least).select(*group, "x", "y", "sim")


def first_candidates(asked: DataFrame, postings: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """Some likely pairs ``group, x, y, sim`` of ``asked(group, x)``: those that share one of the rarest grams.

    They only give a bound for the search that follows, so common grams are left out.
    """
    few = _ranked(asked, group, sizes).filter(f"rank <= {FIRST_GRAMS} AND df BETWEEN 1 AND {FIRST_MOST}")
    return _compared(few.join(postings, [*group, "gram"]).select(*group, "x", "y").distinct(), group, 0.0)


def pairs_above(asked: DataFrame, names: DataFrame, postings: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """All pairs ``group, x, y, sim`` of ``asked(group, x, least)`` with names ``(group, y)`` whose similarity is ``least`` or more.

    Where ``least`` is so low that no gram need be shared, lengths alone prune.
    """
    least = F.col("least") - 1e-9
    x, y = F.length("x"), F.length("y")
    near = (y >= x * least) & (x >= y * least)
    # the longer of the two is at most x / least long
    need = F.when(F.col("least") > 0, 2 * F.floor((1 - least) * x / F.col("least") + 1e-9) + 1)
    asked = asked.withColumn("need", F.when(need <= F.size(grams(F.col("x"))), need))
    some = _ranked(asked.filter("need IS NOT NULL"), group, sizes).filter("rank <= need AND df > 0")
    found = some.join(postings, [*group, "gram"]).filter(near).select(*group, "x", "y", "least").distinct()
    rest = asked.filter("need IS NULL").join(names, group).filter(near | (F.col("least") <= 0)).select(*group, "x", "y", "least")
    return _compared(found.unionByName(rest), group, least)
