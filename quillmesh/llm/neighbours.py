"""From buckets of possibly similar rows to the links that join their components, with exact checks.

A bucket's rows are not paired with each other. First each is paired with one leader of the bucket, the row that shares
most buckets with others (of a text and its variants, the text); then what a bucket's largest component leaves is paired with
other rows of that component, one a turn, as long as that finds links. Buckets that then still hold rows of two components
are joined with themselves. That join carries a few words a row, not the sets: the size of its set and an odd
sketch of it (bit i is the parity of the elements that hash to i). The sketches of two sets differ in no more bits than the sets in elements, so a pair is
dropped only if it cannot be linked. What is left is checked on the full sets, once for each pair. No link between
components is lost, and pairs within a component are never made.

A bucket of many rows is dealt to several tasks: both sides of its join are cut into tiles, and every two tiles meet.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, key_filter, skew_join, thin
from .components import components

#: From two structs of a row's `facts` to whether the rows are linked.
Linked = Callable[[Column, Column], Column]
#: Rows of a tile of a bucket's smaller side; those of the other side have eight times as many.
DEALT = 4096
#: Turns of leaders at most, and how many rows of mixed buckets a link found may stand for to be worth another turn.
ROUNDS, WORTH = 6, 50


def shared_buckets(members: DataFrame) -> DataFrame:
    """Of members (id, bands) the rows (id, band, n) in buckets of n > 1 members."""
    rows = members.select("id", F.explode("bands").alias("band"))
    sizes = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    live = cut(skew_join(thin(rows, F.col("band"), key_filter(sizes, F.col("band"))), sizes, ["band"], "n", ready=True), "shared")
    drop(sizes)
    return live


def may_link(percent: int, words: int) -> Linked:
    """Whether two `small`, structs of n and bits, can belong to sets of a Jaccard similarity of percent: never wrong for those that do."""

    def may(x: Column, y: Column) -> Column:
        differ = reduce(lambda p, q: p + q, [F.bit_count(F.get(x["bits"], F.lit(i)).bitwiseXOR(F.get(y["bits"], F.lit(i)))) for i in range(words)])
        sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
        return sizes & (differ * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent))

    return may


def leaders_of(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b), a < b, distinct, of rows (id, band, comp, main) and their band's leader.

    In the first turn it is the row that is in most of the bands, later the one of the largest component that a hash
    deals to that turn. Rows of one component are not paired.
    """
    score = rows.groupBy("id").agg(F.count(F.lit(1)).alias("score"))
    best = F.struct("score", (-F.col("id")).alias("i")) if turn == 0 else F.struct((F.col("comp") == F.col("main")).cast("int").alias("score"), F.xxhash64("id", F.lit(turn)).alias("h"), (-F.col("id")).alias("i"))
    held = rows.join(score, "id") if turn == 0 else rows
    best = held.groupBy("band").agg(F.max(F.struct(best.alias("best"), F.col("comp").alias("comp"))).alias("best"), F.count(F.lit(1)).alias("many"))
    best = best.select("band", (-F.col("best.best.i")).alias("leader"), F.col("best.comp").alias("of"), "many")
    both = skew_join(rows, best, ["band"], "many").where("id <> leader AND comp <> of")
    return both.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def checked(pairs: DataFrame, sets: DataFrame, may: Linked, linked: Linked) -> DataFrame:
    """Those of the pairs (a, b) that are linked, checked on the full sets (id, small, facts)."""
    a, b = (sets.select(F.col("id").alias(s), F.col("small").alias(f"s{s}"), F.col("facts").alias(f"f{s}")) for s in "ab")
    small = pairs.join(a.drop("fa"), "a").join(b.drop("fb"), "b").where(may(F.col("sa"), F.col("sb"))).select("a", "b").distinct()
    whole = small.join(a.drop("sa"), "a").join(b.drop("sb"), "b")
    return whole.where(linked(F.col("fa"), F.col("fb"))).select("a", "b")


def merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """found (node, component_id) after links (a, b) between its components."""
    more = components(links)
    if found is None:
        return more
    # Components that were linked to others take over theirs.
    moved = more.select(F.col("node").alias("was"), F.col("component_id").alias("whole"))
    nodes = found.join(moved, found["component_id"] == moved["was"], "left").select("node", F.coalesce("whole", "component_id").alias("component_id"))
    return nodes.unionByName(more)


def tiles(rows: Column, most: int) -> Column:
    return F.greatest(F.ceil(rows / F.lit(most)), F.lit(1)).cast("int")


def mixed_buckets(live: DataFrame, found: DataFrame) -> DataFrame:
    """(id, band, comp, main, x_tiles, y_tiles): rows of the buckets that hold several components; main: the bucket's largest one."""
    rows = live.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "band", F.coalesce("component_id", "id").alias("comp"))
    parts = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("band")
    mixed = parts.agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("many")).where("k > 1")
    # In a bucket of its own main component's rows only the others look for links.
    mixed = mixed.select("band", F.col("main.comp").alias("main"), tiles(F.col("many") - F.col("main.n"), DEALT).alias("x_tiles"), tiles(F.col("many"), 8 * DEALT).alias("y_tiles"), "many")
    return skew_join(rows, mixed, ["band"], "many").drop("many")


def linked_components(live: DataFrame, sets: DataFrame, may: Linked, linked: Linked) -> DataFrame:
    """(node, component_id) for all rows of live that are linked and not their component's smallest.

    live: shared_buckets()' rows. sets: (id, small, facts) of the same ids; an id may have several. may and linked: say of
    two `small` whether their rows can be linked, and of two `facts` whether they are.
    """
    found, rows = None, live.select("id", "band", F.col("id").alias("comp"), F.lit(None).cast("long").alias("main"))
    for turn in range(ROUNDS):
        links = cut(checked(leaders_of(rows, turn), sets, may, linked), "links")
        news = links.count()
        if found is not None:
            for end in "ab":
                comp = found.select(F.col("node").alias(end), F.col("component_id").alias(f"c{end}"))
                links = links.join(comp, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
            links = links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        found = cut(merged(found, links), "components")
        rows = mixed = cut(mixed_buckets(live, found), "mixed")
        if turn and news * WORTH < mixed.count():
            break
    # A row's mixed bands, as many as it has bands at most, ride along: a pair is taken in the first that both have.
    at = F.struct("band", "main", "x_tiles", "y_tiles")
    left = mixed.groupBy("id", "comp").agg(F.collect_list(at).alias("at")).join(sets.select("id", "small"), "id")
    left = left.select("id", "comp", "small", F.transform("at", lambda s: s["band"]).alias("bands"), F.explode("at").alias("s")).select("id", "comp", "small", "bands", "s.*")
    own = lambda n, of: F.pmod(F.xxhash64("id", F.lit("deal")), F.col(n)).cast("int").alias(of)
    each = lambda n, of: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(of)
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("id", "comp", "small", "bands")]
    x = left.where("comp <> main").select("band", own("x_tiles", "i"), each("y_tiles", "j"), *side("x"))
    y = left.select("band", each("x_tiles", "i"), own("y_tiles", "j"), "main", *side("y"))
    # Two rows outside the largest component meet in both directions: one is enough. The right side, which the join holds, is the smaller one.
    once = (F.col("comp_y") == F.col("main")) | (F.col("id_x") < F.col("id_y"))
    here = F.get(F.filter("bands_x", lambda b: F.array_contains("bands_y", b)), F.lit(0)) == F.col("band")
    near = y.join(x, ["band", "i", "j"]).where((F.col("comp_x") != F.col("comp_y")) & once & may(F.col("small_x"), F.col("small_y")) & here)
    comp = F.when(F.col("id_x") < F.col("id_y"), F.struct(F.col("id_x").alias("a"), F.col("id_y").alias("b"), F.col("comp_x").alias("ca"), F.col("comp_y").alias("cb")))
    near = near.select(comp.otherwise(F.struct(F.col("id_y").alias("a"), F.col("id_x").alias("b"), F.col("comp_y").alias("ca"), F.col("comp_x").alias("cb"))).alias("p")).select("p.*")
    near = cut(near.distinct(), "near")
    links = checked(near.select("a", "b"), sets, may, linked).join(near, ["a", "b"])
    return merged(found, links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
