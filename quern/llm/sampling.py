"""A sample with target proportions in several classifications at once.

Records are counted in the cells of the cross-classification; margins, floors
and availability then make a flow network over the cells, whose slack arcs show
what can't be met; integer quotas are drawn from the optimal fractional flow.
"""

from __future__ import annotations

import heapq
import json
import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.forms import consistent
from quern.plans.lineage import checkpoint


@dataclass(frozen=True)
class Target:
    dimension: str
    category: str
    share: float
    floor: int


def form(category: str | None) -> str | None:
    return None if category is None else consistent(category).strip().lower()


def read_targets(table: DataFrame) -> tuple[list[Target], int]:
    """Of (dimension, category, target_share, min_rows, sample_size): a row per category wanted, so it is small by what it is."""
    rows = [r for r in table.collect() if r["dimension"] is not None and r["category"] is not None]
    out = [Target(r["dimension"], r["category"], r["target_share"] or 0.0, r["min_rows"] or 0) for r in rows]
    return sorted(out, key=lambda t: (t.dimension, t.category)), max((r["sample_size"] or 0 for r in rows), default=0)


def needed(t: Target, size: int) -> int:
    """The larger of the floor and the share, rounded up; the share's binary error isn't rounded up."""
    return max(t.floor, math.ceil(round(t.share * size, 6)))


def cells(rows: DataFrame, id: Column, dims: list[str], targets: list[Target]) -> DataFrame:
    """(id, cell): one row per record; cell is the JSON array of its categories in consistent form, null for those without a target.

    Spellings are unified per different spelling, not per row: as many as people
    found ways to write the categories, whatever the number of rows.
    """
    spark = rows.sparkSession
    src = rows.select(id.cast("string").alias("id"), *(F.col(d).cast("string").alias(d) for d in dims)).where("id is not null")
    once = src.groupBy("id").agg(*(F.min(d).alias(d) for d in dims))
    wanted = {d: {form(t.category) for t in targets if t.dimension == d} for d in dims}

    def unify(it):
        for b in it:
            b["form"] = [f if (f := form(s)) in wanted[d] else None for d, s in zip(b["dim"], b["spelling"], strict=True)]
            yield b

    spelt = src.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("spelling")) for d in dims))).alias("x")).select("x.*").where("spelling is not null").distinct()
    forms = checkpoint(spelt.mapInPandas(unify, "dim string, spelling string, form string").where("form is not null"))
    for d in dims:
        once = once.join(forms.where(F.col("dim") == d).select(F.col("spelling").alias(d), F.col("form").alias(f"{d}_form")), d, "left")
    return once.select("id", F.to_json(F.struct(*(F.col(f"{d}_form").alias(d) for d in dims)), {"ignoreNullFields": "false"}).alias("cell"))


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], source: int, sink: int, amount: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) sending at most ``amount``: successive shortest paths with potentials."""
    to, cap, cost, adj = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        adj[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        adj[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    pot = [0.0] * n
    while amount > 0:
        far, via, heap = [math.inf] * n, [-1] * n, [(0.0, source)]
        far[source] = 0.0
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v] + 1e-12:
                continue
            if v == sink:  # nodes beyond aren't nearer
                break
            for e in adj[v]:
                if cap[e] > 0 and (x := d + cost[e] + pot[v] - pot[to[e]]) < far[to[e]] - 1e-9:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if far[sink] == math.inf:
            break
        for v in range(n):
            pot[v] += min(far[v], far[sink])
        push, v = amount, sink
        while v != source:
            push, v = min(push, cap[via[v]]), to[via[v] ^ 1]
        v = sink
        while v != source:
            cap[via[v]] -= push
            cap[via[v] ^ 1] += push
            v = to[via[v] ^ 1]
        amount -= push
    return [cap[2 * i + 1] for i in range(len(arcs))]


def shortfalls(counts: dict[tuple, int], dims: list[str], targets: list[Target], size: int) -> dict[tuple[str, str], int]:
    """What the slack arcs carry: each category's need flows through its cells, each as wide as its records, and the rest through slack. Per dimension alone: what the records can't meet whatever else is wanted."""
    keys = sorted((k for k, n in counts.items() if n > 0), key=str)
    out = {}
    for d in sorted({t.dimension for t in targets}):
        own = [t for t in targets if t.dimension == d]
        at = {form(t.category): 2 + i for i, t in enumerate(own)}
        arcs = [x for i, t in enumerate(own) for x in ((0, 2 + i, needed(t, size), 0.0), (2 + i, 1, needed(t, size), 1.0))]
        for j, k in enumerate(keys if d in dims else ()):
            if (c := at.get(k[dims.index(d)])) is not None:
                arcs += [(c, 2 + len(own) + j, counts[k], 0.0), (2 + len(own) + j, 1, counts[k], 0.0)]
        flow = min_cost_flow(2 + len(own) + len(keys), arcs, 0, 1, sum(needed(t, size) for t in own))
        out |= {(d, t.category): flow[2 * i + 1] for i, t in enumerate(own) if flow[2 * i + 1]}
    return out


def quotas(counts: dict[tuple, int], dims: list[str], targets: list[Target], size: int, *, seed: int = 0, rounds: int = 400) -> dict[tuple, int]:
    """Records to draw from each cell: ``size`` in all, as far as there are.

    Raking gives the fractional quotas nearest to the cells' own sizes; a
    min-cost flow (source - categories of the first dimension - cells -
    categories of the second - sink, with slack) makes a start that keeps two
    margins; residual cycles between pairs of cells then lower the sum of all
    margins' misses until none does; which of several equal moves is made, and
    how fractions are rounded, is drawn.
    """
    rng = random.Random(seed)
    keys = sorted((k for k, n in counts.items() if n > 0), key=str)
    if not keys or size <= 0:
        return {}
    avail = np.array([counts[k] for k in keys], np.int64)
    size = int(min(size, avail.sum()))
    want: list[dict] = []
    for i, d in enumerate(dims):
        w = {form(t.category): max(t.share * size, t.floor) for t in targets if t.dimension == d}
        have = {c: int(sum(n for k, n in counts.items() if k[i] == c)) for c in w}
        w = {c: min(x, have[c]) for c, x in w.items()}
        w[None] = max(size - sum(w.values()), 0.0)
        want.append(w)
    member = [[np.array([k[i] == c for k in keys]) for c in w] for i, w in enumerate(want)]
    goal = [np.array(list(w.values())) for w in want]
    q = avail * (size / avail.sum())
    for _ in range(rounds):
        for ms, g in zip(member, goal, strict=True):
            for m, x in zip(ms, g, strict=True):
                s = q[m].sum()
                if s > 0:
                    q[m] *= x / s
        q = np.minimum(q, avail)
    q *= min(1.0, size / max(q.sum(), 1e-9))
    whole = np.floor(q).astype(np.int64)
    first, second = (list(want[i]) if i < len(want) else [None] for i in (0, 1))
    arcs, at = [], {}
    for c, x in zip(first, goal[0], strict=True):
        arcs.append((0, 2 + first.index(c), max(round(x) - int(whole[[k[0] == c for k in keys]].sum()), 0), 0.0))
        arcs.append((0, 2 + first.index(c), size, 3.0))
    base = 2 + len(first) + len(keys)
    for i, k in enumerate(keys):
        extra = int(min(avail[i] - whole[i], max(math.ceil(q[i] * 0.2), 5)))
        at[i] = len(arcs) + 1
        arcs.append((2 + first.index(k[0]), 2 + len(first) + i, extra, 0.0))
        arcs.append((2 + len(first) + i, base + (second.index(k[1]) if len(dims) > 1 else 0), extra, rng.random() * 0.5 + 1.0 / (1.0 + q[i])))
    for j, c in enumerate(second):
        gap = round(goal[1][j]) - int(whole[[k[1] == c for k in keys]].sum()) if len(dims) > 1 else size
        arcs.append((base + j, 1, max(gap, 0), 0.0))
        arcs.append((base + j, 1, size, 3.0))
    flow = min_cost_flow(base + len(second), arcs, 0, 1, size - int(whole.sum()))
    for i in range(len(keys)):
        whole[i] += flow[at[i]]
    for i in sorted(range(len(keys)), key=lambda _: rng.random()):  # what the narrow arcs couldn't carry
        more = int(min(size - whole.sum(), avail[i] - whole[i]))
        whole[i] += max(more, 0)
    level = [np.array([list(w).index(k[i]) for k in keys]) for i, w in enumerate(want)]
    for _ in range(20 * len(keys)):
        gain_out, gain_in = np.zeros(len(keys)), np.zeros(len(keys))
        over = []
        for lv, g in zip(level, goal, strict=True):
            now = np.bincount(lv, weights=whole, minlength=len(g))
            over.append(now - g)
        for lv, o in zip(level, over, strict=True):
            gain_out += np.clip(np.minimum(o, 1.0), -1, 1)[lv]
            gain_in += np.clip(np.minimum(-o, 1.0), -1, 1)[lv]
        cost = gain_out[:, None] + gain_in[None, :]
        for lv, o in zip(level, over, strict=True):  # moves within a category leave its margin
            same = lv[:, None] == lv[None, :]
            cost -= np.where(same, np.clip(np.minimum(o, 1.0), -1, 1)[lv][:, None] + np.clip(np.minimum(-o, 1.0), -1, 1)[lv][None, :], 0)
        cost[whole <= 0, :] = -9
        cost[:, whole >= avail] = -9
        best = cost.max()
        if best <= 0.5:
            break
        a, b = divmod(int(rng.choice(np.flatnonzero(cost.ravel() >= best - 1e-9))), len(keys))
        step = min(int(whole[a]), int(avail[b] - whole[b]))
        for lv, o in zip(level, over, strict=True):
            if lv[a] != lv[b]:
                for gap in (o[lv[a]], -o[lv[b]]):
                    if gap >= 1:
                        step = min(step, int(gap))
        whole[a] -= max(step, 1)
        whole[b] += max(step, 1)
    return {k: int(x) for k, x in zip(keys, whole, strict=True) if x}


def draw(labelled: DataFrame, quota: dict[str, int], *, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """Of (id, cell) the quota of each cell, at random by hash. A cell's rows are counted in hash buckets; whole buckets are taken up to the quota and only the bucket across it is ranked, so a cell with a third of all rows is no large window."""
    spark: SparkSession = labelled.sparkSession
    d = labelled.withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(buckets)).cast("int"))
    counts = d.groupBy("cell", "bucket").agg(F.count("*").alias("n")).collect()  # cells x buckets at most
    cut, left = [], dict(quota)
    for r in sorted(counts, key=lambda r: (r["cell"], r["bucket"])):
        k = left.get(r["cell"], 0)
        if k > 0:
            cut.append((r["cell"], r["bucket"], min(k, r["n"]), k >= r["n"]))
            left[r["cell"]] = k - r["n"]
    table = F.broadcast(spark.createDataFrame(cut, "cell string, bucket int, k long, whole boolean"))
    d = d.join(table, ["cell", "bucket"])
    rank = F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("h", "id"))
    part = d.where("not whole").withColumn("r", rank).where("r <= k")
    return d.where("whole").select("id", "cell").unionByName(part.select("id", "cell"))


@dataclass
class Plan:
    labelled: DataFrame
    counts: dict[tuple, int]
    have: dict[tuple[str, str], int]
    targets: list[Target]
    size: int
    dims: list[str]


def plan(rows: DataFrame, id: Column, table: DataFrame) -> Plan:
    """Cells and counts. The driver gets one row per cell: at most the product of the numbers of target categories plus one."""
    targets, size = read_targets(table)
    dims = sorted({t.dimension for t in targets})
    labelled = checkpoint(cells(rows, id, dims, targets))
    counts = {tuple(json.loads(r["cell"]).get(d) for d in dims): r["n"] for r in labelled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    have: dict[tuple[str, str], int] = {}
    for k, n in counts.items():
        for d, c in zip(dims, k, strict=True):
            if c is not None:
                have[d, c] = have.get((d, c), 0) + n
    return Plan(labelled, counts, have, targets, size, dims)
