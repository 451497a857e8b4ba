"""Mixing sources to target weights: min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of sources are one
pattern, and only patterns, with their tokens, enter the flow: capacity runs from the
start to a pattern once for every repetition, each dearer than the one before (the cost of using
a document r times is r squared), on to the sources of the pattern, at most `max_repeats` times
its tokens each, and from a source to the end as far as its quota goes. The cheapest largest
flow fills the quotas as far as tokens allow and repeats as little as possible. The flow of a
pattern is then laid along its documents in a seeded order, so that each source takes whole
documents whose tokens add up to its flow, to within one document.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.sampling import seeded
from foliant.operators.ranking import ranked
from foliant.plans.workspace import small, store

#: Tokens are counted in ten-thousandths, so that quotas are whole numbers.
UNIT = 10_000


def min_cost_flow(arcs: list[tuple[object, object, int, int]], start: object, end: object) -> list[int]:
    """Flow on each arc (from, to, capacity, cost >= 0) of the cheapest largest flow, by the primal-dual method.

    Shortest distances give potentials; then all arcs that lie on shortest paths are filled to a largest flow at once, so the distances
    are worked out once for each different cost of a path (a few for each repetition) and not once for each path.
    """
    number: dict = {}
    at = lambda x: number.setdefault(x, len(number))
    s, t = at(start), at(end)
    to, cap, cost, out = [], [], [], defaultdict(list)
    for u, v, c, w in arcs:
        for x, y, k, z in ((at(u), at(v), c, w), (at(v), at(u), 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(z)
    n = len(number)
    potential = [0] * n
    while True:
        far = [None] * n
        far[s], heap, done = 0, [(0, s)], [False] * n
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            for e in out[u]:
                if cap[e] > 0 and not done[to[e]]:
                    x = d + cost[e] + potential[u] - potential[to[e]]
                    if far[to[e]] is None or x < far[to[e]]:
                        far[to[e]] = x
                        heapq.heappush(heap, (x, to[e]))
        if far[t] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        for v in range(n):
            potential[v] += far[t] if far[v] is None else min(far[v], far[t])
        free = lambda u, e: cap[e] > 0 and cost[e] + potential[u] == potential[to[e]]
        while _blocking(s, t, to, cap, out, free, n):
            pass


def _blocking(s: int, t: int, to: list[int], cap: list[int], out: dict, free, n: int) -> bool:
    """Fill the free arcs along shortest paths by number of arcs; whether anything could be sent."""
    level = [-1] * n
    level[s], queue = 0, [s]
    for u in queue:
        for e in out[u]:
            if level[to[e]] < 0 and free(u, e):
                level[to[e]] = level[u] + 1
                queue.append(to[e])
    if level[t] < 0:
        return False
    nxt, path, u = [0] * n, [], s
    while True:
        if u == t:
            push = min(cap[e] for e in path)
            for e in path:
                cap[e] -= push
                cap[e ^ 1] += push
            full = next(i for i, e in enumerate(path) if cap[e] == 0)
            u = to[path[full] ^ 1]
            del path[full:]
            continue
        while nxt[u] < len(out[u]):
            e = out[u][nxt[u]]
            if level[to[e]] == level[u] + 1 and free(u, e):
                break
            nxt[u] += 1
        if nxt[u] < len(out[u]):
            path.append(out[u][nxt[u]])
            u = to[path[-1]]
        elif u == s:
            return True
        else:
            e = path.pop()
            u = to[e ^ 1]
            nxt[u] += 1


def route(patterns: dict[str, tuple[list[str], int]], quotas: dict[str, tuple[int, int]]) -> dict[tuple[str, str], int]:
    """Flow (pattern, source) in units of patterns {name: (sources, tokens)} to quotas {source: (quota in units, max_repeats)}."""
    arcs = []
    for name, (sources, tokens) in sorted(patterns.items()):
        mine = [s for s in sources if s in quotas]
        for r in range(sum(quotas[s][1] for s in mine)):
            arcs.append(("start", ("p", name), tokens * UNIT, 2 * r + 1))
        arcs += [(("p", name), ("s", s), tokens * UNIT * quotas[s][1], 0) for s in mine]
    arcs += [(("s", s), "end", q, 0) for s, (q, _) in sorted(quotas.items())]
    flow = min_cost_flow(arcs, "start", "end")
    return {(u[1], v[1]): f for (u, v, _, _), f in zip(arcs, flow) if f and u != "start" and v != "end"}


def mix(documents: DataFrame, targets: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) of documents (doc_id, sources array<string>, tokens) by targets (source, target_bp, max_repeats).

    chosen: doc_id, source, n_uses, tokens: how often a document is used for a source, 1 to max_repeats; documents without
    tokens are never used. report: for each target source, the tokens it has, its quota (target_bp / 10,000 of the tokens of all
    documents, those without a source included), what was routed to it, the tokens chosen, the share of all chosen tokens
    reached, the share of the tokens of all documents, to which the quota refers, and is_short, if its quota could not be filled. Null tokens count 0;
    repeated rows are rows; a target without documents is short unless its share is 0. Targets must be unique by source. They are
    parameters and come to the driver, as do the patterns: sets of targets that occur together, at most 2 to the number of targets.
    """
    spark = documents.sparkSession
    asked = targets.select("source", "target_bp", "max_repeats").collect()
    aimed = F.array(*(F.lit(r.source) for r in asked if r.source is not None)).cast("array<string>")
    # other sources take no part in the flow, so they make no patterns; their tokens count in the total
    key = F.concat_ws("\x1f", F.array_sort(F.array_intersect(F.coalesce(F.col("sources").cast("array<string>"), F.array().cast("array<string>")), aimed)))
    docs = store(documents.select("doc_id", key.alias("pattern"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")), "counted")  # texts are counted once
    sums = store(docs.groupBy("pattern").agg(F.sum("tokens").alias("tokens")), "patterns")
    patterns = {r.pattern: (r.pattern.split("\x1f"), r.tokens) for r in sums.collect()}
    all_tokens = sum(t for _, t in patterns.values())
    wanted = {r.source: (r.target_bp * all_tokens, r.max_repeats) for r in asked}
    flow = route({k: v for k, v in patterns.items() if k and v[1]}, wanted)

    spans, routed, at = [], dict.fromkeys(wanted, 0), defaultdict(int)
    for (pattern, source), f in sorted(flow.items()):
        spans.append((pattern, source, at[pattern], at[pattern] + f))
        at[pattern] += f
        routed[source] += f
    spans = small(spark.createDataFrame(spans, "pattern string, source string, lo bigint, hi bigint"), "spans")
    line = ranked(docs.filter("tokens > 0 AND pattern <> ''").withColumn("shuffled", seeded(seed, "doc_id")), ["pattern"], ["shuffled", "doc_id"], "tokens")
    line = line.join(spans, "pattern").withColumns({"b": F.col("before") * UNIT, "w": F.col("group_weight") * UNIT})
    # uses j = 0, 1, ... with lo <= j * w + b < hi; div rounds towards 0, what is below 0 counts 0
    upto = lambda x: F.expr(f"greatest(0L, ({x} - b + w - 1) div w)")
    chosen = line.withColumn("n_uses", upto("hi") - upto("lo")).filter("n_uses > 0").select("doc_id", "source", "n_uses", (F.col("n_uses") * F.col("tokens")).alias("tokens"))
    have = defaultdict(int)
    for sources, t in patterns.values():
        for s in sources:
            have[s] += t
    rows = [(s, int(q // all_tokens) if all_tokens else 0, r, have[s], q / UNIT, routed[s] / UNIT, routed[s] < q) for s, (q, r) in sorted(wanted.items())]
    report = spark.createDataFrame(rows, "source string, target_bp bigint, max_repeats bigint, tokens bigint, quota double, routed double, is_short boolean")
    per = chosen.groupBy("source").agg(F.sum("tokens").alias("chosen"), F.count(F.lit(1)).alias("n_documents"), F.max("n_uses").alias("most_uses"))
    report = report.join(per, "source", "left").fillna(0, ["chosen", "n_documents", "most_uses"])
    total = per.agg(F.coalesce(F.sum("chosen"), F.lit(0))).scalar()
    return chosen, report.withColumns({"share": F.col("chosen") / F.greatest(total, F.lit(1)), "share_of_all": F.col("chosen") / F.lit(max(all_tokens, 1))})
