"""Mixing overlapping sources to target weights by min-cost flow.

Documents with the same text may lie in several sources; the set of those sources is a text's membership pattern.
Capacity is aggregated by pattern. A flow routes words from patterns to source quotas; each further repetition of a
pattern's words costs more, so the flow first spreads over fresh text. The flow fixes a repetition rate for each
(pattern, source); a seeded order of documents turns rates into whole passes and, at each source's edge, one partial.
"""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import entered, keys_join, sized, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_PASSES = 2
SEED = 20
_WORDS = "[^\\x20\\x09-\\x0D]+"
_BITS, _LEVELS = 8, 3


def targets_of(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MAX_PASSES) -> dict:
    """Target words of each source: weights repeat over the sources by code point, null last; capped at ``most`` times
    a source's size, the excess shared again by weight until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in out]
    return out


class Flow:
    """Min-cost max-flow by primal-dual phases: all shortest paths of equal cost are filled at once."""

    def __init__(self, n: int):
        self.to, self.cap, self.cost, self.out = [], [], [], [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        n, total = len(self.out), 0
        high = [0] * n
        while True:
            dist = [None] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, x = heappop(heap)
                if d > dist[x]:
                    continue
                for e in self.out[x]:
                    if self.cap[e]:
                        y, z = self.to[e], d + self.cost[e] + high[x] - high[self.to[e]]
                        if dist[y] is None or z < dist[y]:
                            dist[y] = z
                            heappush(heap, (z, y))
            if dist[t] is None:
                return total
            high = [h + (dist[t] if d is None else min(d, dist[t])) for h, d in zip(high, dist, strict=True)]
            total += self._fill(s, t, high)

    def _fill(self, s: int, t: int, high: list[int]) -> int:
        total, flat = 0, lambda x, e: self.cap[e] and self.cost[e] + high[x] - high[self.to[e]] == 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                x = queue.popleft()
                for e in self.out[x]:
                    if flat(x, e) and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if t not in level:
                return total
            nexts = [0] * len(self.out)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    amount = min(self.cap[e] for e in path)
                    for e in path:
                        self.cap[e] -= amount
                        self.cap[e ^ 1] += amount
                    total += amount
                    keep = next(i for i, e in enumerate(path) if not self.cap[e])
                    x = self.to[path[keep] ^ 1]
                    del path[keep:]
                    continue
                arcs = self.out[x]
                while nexts[x] < len(arcs) and not (flat(x, arcs[nexts[x]]) and level.get(self.to[arcs[nexts[x]]]) == level[x] + 1):
                    nexts[x] += 1
                if nexts[x] < len(arcs):
                    path.append(arcs[nexts[x]])
                    x = self.to[path[-1]]
                elif path:
                    level.pop(x, None)
                    x = self.to[path.pop() ^ 1]
                else:
                    break


def route(cells: dict[tuple[str, int], int], unique: dict[str, int], quotas: dict[int, int], most: int = MAX_PASSES) -> dict:
    """Words that each (pattern, source) gives. cells: words of its rows; unique: words of a pattern's distinct texts."""
    patterns, sources = sorted(unique), sorted(quotas)
    at = {p: 1 + i for i, p in enumerate(patterns)} | {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(at)
    flow = Flow(sink + 1)
    room: dict[str, int] = {}
    for (p, _), words in cells.items():
        room[p] = room.get(p, 0) + most * words
    for p in patterns:
        left, passes, cost = room.get(p, 0), 1, 0
        while left > 0 and unique[p] > 0:  # passes 1, 2, 3-4, 5-8, ...: convex costs
            cap = min(left, unique[p] * passes)
            flow.arc(0, at[p], cap, cost)
            left, passes, cost = left - cap, passes if cost == 0 else passes * 2, cost + 1
    arcs = {(p, s): flow.arc(at[p], at[s], most * words) for (p, s), words in sorted(cells.items())}
    for s in sources:
        flow.arc(at[s], sink, quotas[s])
    flow.run(0, sink)
    return {k: flow.cap[e ^ 1] for k, e in arcs.items()}


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = SEED, rid_col: str | None = None) -> DataFrame:
    """rid, doc_id, size, source_size, target, taken, pattern for each row, repeated rows too.

    taken is at most MAX_PASSES times size; it adds up to the whole part of each source's target. Null texts have no
    words and are never taken; a null source is a source of its own. Only the three columns are read. An empty table
    gives an empty result. rid is rid_col if given (unique), else a new number.
    """
    spark = docs.sparkSession
    base = table(
        entered(docs.withColumn("__source", F.col(f"`{source_col}`").cast("string")), id_col, text_col, rid_col, "__source")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .select("rid", "doc_id", F.col("__source").alias("source"), F.regexp_count("text", F.lit(_WORDS)).cast("long").alias("size"), F.xxhash64("text").alias("same")),
        "mix-rows",
    )
    sizes = {r["source"]: r["size"] for r in base.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets_of(sizes)
    number = {s: i for i, s in enumerate(sorted(goal, key=lambda s: (s is None, s or "")))}
    known = spark.createDataFrame([(s, number[s], sizes[s], float(goal[s])) for s in goal], "name string, sid int, source_size long, target double")
    base = base.join(sized(known, len(goal), 64 + max([len(s or "") for s in goal], default=0)), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    texts = base.groupBy("same").agg(F.max("size").alias("words"), F.array_join(F.sort_array(F.collect_set("sid")), ",").alias("pattern"))
    texts = table(texts, "mix-texts")
    unique = {r["pattern"]: r["words"] for r in texts.groupBy("pattern").agg(F.sum("words").alias("words")).collect()}
    cellular = table(
        base.join(texts.select("same", "pattern"), "same").select("rid", "doc_id", "sid", "size", "source_size", "target", "same", "pattern"),
        "mix-cells",
    )
    cells = {(r["pattern"], r["sid"]): r["w"] for r in cellular.groupBy("pattern", "sid").agg(F.sum("size").alias("w")).collect()}
    quotas = {number[s]: int(goal[s]) for s in goal}
    routed = route(cells, unique, quotas)
    rates = spark.createDataFrame([(p, s, float(routed[p, s]) / w if w else 0.0) for (p, s), w in cells.items()], "pattern string, sid int, rate double")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "same"), 11) / float(1 << 53)
    whole = F.floor("rate")
    rated = (
        cellular.join(sized(rates, len(cells), 64 + max([len(p) for p, _ in cells], default=0)), ["pattern", "sid"])
        .withColumn("passes", whole.cast("long"))
        .withColumn("key", F.when(F.col("rate") > whole, u / (F.col("rate") - whole)))
        .withColumn("rank", F.least(F.col("key") * float(1 << 22), F.lit(float((1 << _BITS * _LEVELS) - 1))).cast("long"))
    )
    rated = table(rated, "mix-rated")
    sure = {r["sid"]: r["w"] for r in rated.groupBy("sid").agg(F.sum(F.col("passes") * F.col("size")).alias("w")).collect()}
    left = {s: q - sure.get(s, 0) for s, q in quotas.items()}
    # Each level reads one more byte of the rank: all before a source's edge are taken, only the edge goes on.
    edge = {s: 0 for s in quotas}
    schema = "sid int, edge long, left long"
    for depth in range(1, _LEVELS + 1):
        shift = _BITS * (_LEVELS - depth)
        edges = spark.createDataFrame([(s, edge[s], left[s]) for s in edge], schema)
        inside = rated.where("rank is not null").join(sized(edges, len(edge)), "sid").where(F.shiftright("rank", shift + _BITS) == F.col("edge"))
        hist: dict[int, list] = {}
        for r in inside.groupBy("sid", F.shiftright("rank", shift).alias("b")).agg(F.sum("size").alias("w")).collect():
            hist.setdefault(r["sid"], []).append((r["b"], r["w"]))
        for s in edge:
            edge[s] <<= _BITS
            for b, w in sorted(hist.get(s, [])):
                edge[s] = b
                if w > left[s]:
                    break
                left[s] -= w
            else:
                edge[s] = ((edge[s] >> _BITS) + 1 << _BITS) - 1 if s not in hist else edge[s] + 1
    edges = spark.createDataFrame([(s, edge[s], left[s]) for s in edge], schema)
    placed = rated.join(sized(edges, len(edge)), "sid")
    last = placed.where("rank = edge").select("rid", "sid", "size", "left", "key", "doc_id")
    before = F.coalesce(F.sum("size").over(W.partitionBy("sid").orderBy("key", "doc_id", "rid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = last.select("rid", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - before)).alias("part"))
    out = keys_join(placed, table(part, "mix-edge"), "rid", "left")
    extra = F.when(F.col("rank") < F.col("edge"), F.col("size")).otherwise(F.coalesce("part", F.lit(0)))
    return out.select("rid", "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + extra).cast("long").alias("taken"), "pattern")


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")
