"""Consolidating pairwise links into groups: Boruvka hooking with pointer doubling.

In a round every component selects its smallest outgoing edge. Edges are ordered by
(smaller end, larger end), so the smallest edge of component c leads to its smallest
neighbour, and the only cycles of the chosen edges are pairs that chose each other. The
smaller of such a pair is the root of its tree; it is also the smallest component of the
tree, since two steps along chosen edges never lead to a larger component. The trees
collapse onto their roots by pointer doubling, the edges are renamed to the roots, loops
are dropped and repeats removed, until no edge remains. The number of components that still
have edges at least halves in a round, so all rounds together cost about as much as the first two.

The maps (component -> root) of the rounds are kept as tables in the shared folder, composed
from the last back to the first, and removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.workspace import discard, store


def _collapse(parent: DataFrame) -> DataFrame:
    """c -> p by pointer doubling to c -> root; roots are those with p = c."""
    while True:
        up = parent.select(F.col("c").alias("q"), F.col("p").alias("pp"))
        step = store(parent.join(up, F.col("p") == F.col("q")).select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "doubled")
        moved = not step.filter("moved").isEmpty()
        discard(parent)
        parent = step.select("c", "p")
        parent._stored_at = step._stored_at
        if not moved:
            return parent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, group_id (bigint both) of every node with an edge to another node; group_id is the smallest node of the group.

    Null ends, loops, repeats and either order of the ends make no difference; other columns are
    left aside. Without a proper edge the result is empty. A node may have any share of the edges:
    choosing edges combines in each task before the shuffle, repeats are dropped as soon as their
    ends fall together, and joins on a hot component are split by adaptive execution.
    """
    x, y = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    e = store(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).distinct(), "edges")
    empty = e.select(F.col("lo").alias("node"), F.col("lo").alias("group_id")).limit(0)
    maps: list[DataFrame] = []
    while not e.isEmpty():
        ends = e.select(F.explode(F.array(F.struct(F.col("lo").alias("c"), F.col("hi").alias("n")), F.struct(F.col("hi").alias("c"), F.col("lo").alias("n")))).alias("x")).select("x.*")
        chosen = store(ends.groupBy("c").agg(F.min("n").alias("p")), "chosen")
        back = chosen.select(F.col("c").alias("q"), F.col("p").alias("pp"))
        hooked = store(chosen.join(back, F.col("p") == F.col("q")).select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")), "hooked")
        discard(chosen)
        root = _collapse(hooked)
        maps.append(root)
        lo, hi = root.select(F.col("c").alias("lo"), F.col("p").alias("rl")), root.select(F.col("c").alias("hi"), F.col("p").alias("rh"))
        left = e.join(lo, "lo").join(hi, "hi").filter("rl <> rh").select(F.least("rl", "rh").alias("lo"), F.greatest("rl", "rh").alias("hi")).distinct()
        e, old = store(left, "edges"), e
        discard(old)
    discard(e)
    if not maps:
        return empty
    out = maps[-1]
    for m in reversed(maps[:-1]):
        later = out.select(F.col("c").alias("r"), F.col("p").alias("rp"))
        out = m.join(later, F.col("p") == F.col("r"), "left").select("c", F.coalesce("rp", "p").alias("p"))
    out = store(out.select(F.col("c").alias("node"), F.col("p").alias("group_id")), "groups")
    discard(*maps)
    return out
