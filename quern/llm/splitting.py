"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import hash_to_min
from quern.plans.lineage import checkpoint


def draw_key(spread: str = "spread_id", ids: str = "card_ids", used: str = "cards_used") -> Column:
    """One string per spread and set of cards; null without a spread or without cards."""
    cards = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(ids), F.transform(F.col(used), lambda x: x["card_id"])))))
    return F.when(F.col(spread).isNotNull() & (F.size(cards) > 0), F.to_json(F.struct(F.col(spread).alias("s"), cards.alias("c"))))


def pair_key(category: str = "safety_category", pair: str = "matched_pair_id") -> Column:
    return F.when(F.col(category).isNotNull() & F.col(pair).isNotNull(), F.to_json(F.struct(F.col(category).alias("s"), F.col(pair).alias("p"))))


def related_groups(rows: DataFrame, id: Column, keys: dict[str, Column]) -> DataFrame:
    """(id, group_id): each record with the least id of its component; records share a component when one of the keys joins them, over any number of steps.

    Each key's group is a star around its least id, so that the graph has an
    edge only where a record joins two stars, and a hot key (a tenth of all
    rows) is one node, combined before the shuffle. Records of hot keys (more than
    a thousandth of all records each, so fewer than a thousand) get their head by
    broadcast, and those without a key by no join at all. Null keys join nothing; a
    record delivered again counts once; null ids give no row.
    """
    src = checkpoint(rows.select(id.cast("string").alias("id"), *(k.alias(n) for n, k in keys.items())).where("id is not null"))
    total, out = src.count(), src
    for n in keys:
        head = f"{n}_head"
        h = checkpoint(src.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("id").alias(head), F.count("*").alias("c")))
        hot = h.where(F.col("c") * 1000 > total).select(n, F.col(head).alias("hot"))
        j = out.join(F.broadcast(hot), n, "left")  # fewer than 1000 rows
        cold = F.col(n).isNotNull() & F.col("hot").isNull()
        out = j.where(~cold).withColumnRenamed("hot", head).unionByName(j.where(cold).drop("hot").join(h.select(n, head), n))
    many = checkpoint(out.select("id", F.array_distinct(F.array_compact(F.array(*(f"{n}_head" for n in keys)))).alias("heads")).distinct())
    edges = many.where(F.size("heads") > 1).select(F.get("heads", F.lit(0)).alias("a"), F.explode(F.slice("heads", 2, len(keys) + 1)).alias("b")).distinct()
    # deliveries of one record with different keys join their stars as well
    edges = edges.union(many.where(F.size("heads") > 0).select(F.col("id").alias("a"), F.get("heads", F.lit(0)).alias("b")).join(many.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("id").alias("a")), "a"))
    comp = hash_to_min(edges)
    star = many.select("id", F.coalesce(F.get("heads", F.lit(0)), F.col("id")).alias("node")).groupBy("id").agg(F.min("node").alias("node"))
    return star.join(comp, "node", "left").select("id", F.coalesce("component", "node").alias("group_id"))


def rendezvous(key: Column, shares: dict[str, float], seed: Column) -> Column:
    """Weighted rendezvous hashing: of the splits the one with the largest -weight/ln(u). A component keeps its split when others come or go; a changed share moves only what has to move."""
    names = sorted(s for s, w in shares.items() if w > 0)
    score = {s: -shares[s] / F.log((F.pmod(F.xxhash64(key, F.lit(s), seed), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)) for s in names}
    best = F.greatest(*score.values()) if len(names) > 1 else score[names[0]]
    out = F.when(score[names[0]] == best, names[0])
    for s in names[1:]:
        out = out.when(score[s] == best, s)
    return out


def assign_splits(rows: DataFrame, id: Column, keys: dict[str, Column], stratum: Column, shares: dict[str, float], *, seed: int = 0, large: float = 0.002, trials: int = 64) -> DataFrame:
    """(id, group_id, stratum, split): all records of a component in one split.

    Small components go by rendezvous hashing. The components with more than
    ``large`` of all records - fewer than 1/large of them, whatever the input's
    size - would upset the shares by chance, so the largest goes to the largest
    split and each other to the split that lacks most; the shares of the small
    ones are then what is left. ``trials`` seeds are compared by the sums per
    stratum and split; the one nearest to the shares within strata is used.
    """
    g = checkpoint(related_groups(rows, id, keys))
    s = rows.select(id.cast("string").alias("id"), F.coalesce(stratum, F.lit("")).alias("stratum")).where("id is not null").groupBy("id").agg(F.min("stratum").alias("stratum"))
    all_ = checkpoint(g.join(s, "id"))
    per = checkpoint(all_.groupBy("group_id").agg(F.count("*").alias("n")))
    n = per.agg(F.sum("n")).first()[0] or 0
    total = sum(shares.values()) or 1.0
    want = {k: v / total for k, v in shares.items() if v > 0}
    left = {k: v * n for k, v in want.items()}
    fixed: dict[str, str] = {}
    for r in sorted(per.where(F.col("n") > max(large * n, 1)).collect(), key=lambda r: (-r["n"], r["group_id"])):
        k = max(sorted(left), key=lambda k: left[k])
        fixed[r["group_id"]] = k
        left[k] -= r["n"]
    rest = {k: max(v, 0.0) for k, v in left.items()}
    rest = rest if sum(rest.values()) > 0 else want
    table = all_.sparkSession.createDataFrame(list(fixed.items()) or [("", "")], "group_id string, chosen string")  # fewer than 1/large rows
    all_ = all_.join(F.broadcast(table), "group_id", "left")
    small = all_.where("chosen is null")
    cells = checkpoint(small.groupBy("group_id", "stratum").agg(F.count("*").alias("n")))
    tried = cells.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    sums = tried.groupBy("stratum", "trial", rendezvous(F.col("group_id"), rest, F.col("trial") + seed).alias("split")).agg(F.sum("n").alias("n")).collect()  # strata x trials x splits
    base = {(r["stratum"], r["chosen"]): r["n"] for r in all_.where("chosen is not null").groupBy("stratum", "chosen").agg(F.count("*").alias("n")).collect()}
    by_trial: dict[int, dict] = {t: dict(base) for t in range(trials)}
    for r in sums:
        d = by_trial[r["trial"]]
        d[r["stratum"], r["split"]] = d.get((r["stratum"], r["split"]), 0) + r["n"]

    def off(d: dict) -> float:
        strata: dict[str, float] = {}
        for (a, _), m in d.items():
            strata[a] = strata.get(a, 0) + m
        inner = sum(abs(d.get((a, k), 0) - w * m) for a, m in strata.items() for k, w in want.items())
        return inner + 4 * sum(abs(sum(d.get((a, k), 0) for a in strata) - w * n) for k, w in want.items())

    best = min(range(trials), key=lambda t: (off(by_trial[t]), t))
    return all_.select("id", "group_id", "stratum", F.coalesce("chosen", rendezvous(F.col("group_id"), rest, F.lit(seed + best))).alias("split"))
