"""Near-duplicate records: exact set-similarity join in size-banded tiles, with hashed bitmap signatures.

Plan: one pass makes per record a node (hash of its words), the number n of
distinct shingles, a 384-bit parity signature (long texts: 640 bits more) and its *prefix*. Shingles that
nearly always follow one another (a phrase) form one class; which do is learnt
from counts, and any classes give the same result. A text's shingles are put in
order of class, rare and long ones first; the prefix are the classes that begin
among the first n - ceil(threshold n) + 1. Two sets whose likeness reaches the
threshold have a shingle in common, the first of which is in both prefixes,
whatever the length of the texts and wherever the edits are. Rows with the same
words become one node first. Classes are put in groups by hash; a node is sent
once to each group that has one of its classes, in blocks of at most ``block``
nodes. There the nodes of a class are sorted by size; a node is compared with
the band of sizes that its size and the place of the class allow, bit counts
bound the overlap from above, and what remains goes on to the exact
intersection of the sorted shingle arrays. Links are then joined into groups.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import hash_to_min, joined
from quern.llm.words import BITS, Batch, among, bitmap, by_runs, distinct, parities, per_batch, signatures, sliced, words
from quern.plans.lineage import checkpoint, stored

SIG = [f"s{i}" for i in range(BITS // 64)]
SIG_SCHEMA = ", ".join(f"{s} long" for s in SIG)
#: Prefix classes of a group, about, and the fewest groups; prefix classes that are shuffled at a time, in so many turns at most; rows of a block of comparisons; nodes up to which those of a class are compared offset by offset, many classes at once.
GROUP, GROUPS, ROUND, TURNS, ROWS, FEW = 600_000, 16, 12_000_000, 6, 64, 16
#: log2 of the places that shingles are counted in, one in how many rows is counted (all), and in how many of its occurrences a shingle follows another of its class. They only change classes and their order, never what is found.
COUNTERS, COUNTED, FOLLOWS = 20, 1, 0.7
#: Shingles above which a text has further bits of signature, and how many: so few as BITS are about as different for all long texts.
LONG, MORE = 200, 640


def chains(places: np.ndarray, follower: np.ndarray, size: int) -> np.ndarray:
    """Of each of ``size`` places the last one of its chain; each place has at most one follower and follows at most one."""
    last = np.arange(size)
    last[places] = follower
    for _ in range(size.bit_length()):  # a ring ends anywhere on it
        last = last[last]
    return last


def classes(rows: DataFrame, shingle: int):
    """Broadcast table over the low bits of a shingle's hash: twice the rank of its class, plus 1 if the class holds several places. 4 MB, whatever the rows (id, lead, text); the driver gets at most one row per place."""
    size = 1 << COUNTERS
    low = np.uint64(size - 1)

    def f(batches):
        for b in sliced(batches, 2000):
            lead, text = b.column(1).to_pylist(), b.column(2).to_pylist()
            full = Batch([words(q) + words(t) for q, t in zip(lead, text, strict=True)])
            ok = full.at + shingle <= full.n[full.doc]
            doc = full.doc[ok]
            at = (full.windows(shingle)[full.start[doc] + full.at[ok]] & low).astype(np.int64)
            after = np.full(len(at), -1)
            after[:-1] = np.where(doc[1:] == doc[:-1], at[1:], -1)
            pair, n = np.unique(at << 32 | after + 1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair >> 32), pa.array((pair & 0xFFFFFFFF) - 1), pa.array(n)], ["w", "after", "c"])

    counted = rows.mapInArrow(f, "w long, after long, c long")
    t = counted.groupBy("w", "after").agg(F.sum("c").alias("c")).groupBy("w").agg(F.sum("c").alias("n"), F.max(F.struct("c", "after")).alias("x")).select("w", "n", "x.c", "x.after").toArrow()
    w, n, c, after = (t.column(k).to_numpy() for k in ("w", "n", "c", "after"))
    count = np.zeros(size, np.int64)
    count[w] = n
    ok = (after >= 0) & (after != w) & (c > 1) & (c >= FOLLOWS * n) & (c >= FOLLOWS * count[after])
    last = chains(w[ok], after[ok], size)
    many = np.bincount(last[w], minlength=size)
    most = np.zeros(size, np.int64)
    np.maximum.at(most, last, count)
    rank = np.empty(size, np.int64)
    rank[np.lexsort((np.arange(size), most / np.maximum(many, 1)))] = np.arange(size)
    return rows.sparkSession.sparkContext.broadcast((rank[last] * 2 + (many[last] > 1)).astype(np.int32))


def prefixes(doc: np.ndarray, h: np.ndarray, n: int, table: np.ndarray, threshold: float) -> list[pa.ListArray]:
    """Per document, of at most 2^11, the classes of which one is in common with every set alike enough, as 32-bit keys (equal keys of different classes only add candidates), and how many shingles come before each."""
    size = np.bincount(doc, minlength=n)
    of = table[(h & np.uint64(len(table) - 1)).astype(np.int64)].astype(np.uint64)
    alone = np.where(of & np.uint64(1), np.uint64(0), h >> np.uint64(32))  # a place of one shingle may hold others too
    o = np.sort(doc.astype(np.uint64) << np.uint64(53) | of >> np.uint64(1) << np.uint64(32) | alone)
    new = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.array([], np.int64)
    o, doc = o[new], (o[new] >> np.uint64(53)).astype(np.int64)
    at = new - (np.cumsum(size) - size)[doc]
    ok = at <= (size - np.ceil(threshold * size - 1e-9))[doc]
    o, at = o[ok], at[ok]
    key = ((o >> np.uint64(32) & np.uint64((1 << 21) - 1)) * np.uint64(0x9E3779B1) ^ o) & np.uint64(0xFFFFFFFF)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(doc[ok], minlength=n), out=offsets[1:])
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (key.astype(np.uint32).view(np.int32), at.astype(np.int32))]


def further(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """Per document of more than LONG shingles MORE further bits of signature, of the other halves of the hashes."""
    long = size > LONG
    of = long[doc]
    bits = parities((np.cumsum(long) - 1)[doc[of]], h[of] & np.uint64(0xFFFFFFFF), int(long.sum()), MORE)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(long * (MORE // 64))].astype(np.int32)), pa.array(bits.ravel()))


def features(rows: DataFrame, shingle: int, least_words: int, threshold: float, table, more: bool = False) -> DataFrame:
    """(id, node, n, s0.., keys, at, with ``more`` the further bits of long texts) of rows (id, lead, text); lead is put before the text but not counted for least_words. Null texts and shorter ones give no row."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, lead, text = (b.column(i).to_pylist() for i in range(3))
        own = [words(t) for t in text]
        keep = [i for i, w in enumerate(own) if len(w) >= max(least_words, 1)]
        if not keep:
            return None
        full = Batch([words(lead[i]) + own[i] for i in keep])
        n = len(keep)
        doc, h = full.shingles(shingle)
        size = np.bincount(doc, minlength=n)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.string()), pa.array(full.nodes()), pa.array(size.astype(np.int32)), *map(pa.array, signatures(doc, h, n)), *prefixes(doc, h, n, table.value, threshold), *([further(doc, h, size)] * more)], ["id", "node", "n", *SIG, "keys", "at", *["more"] * more])

    return rows.mapInArrow(per_batch(f), f"id string, node long, n int, {SIG_SCHEMA}, keys array<int>, at array<int>" + ", more array<long>" * more)


def word_lists(rows: DataFrame, wanted) -> DataFrame:
    """(node, words) with the words, joined by blanks, of rows (id, lead, text, hash) whose hash may be among the wanted. Words take a third of the bytes of their hashes when shuffled."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        b = b.filter(pa.array(among(b.column(3).to_numpy(), wanted.value)))
        if not b.num_rows:
            return None
        lead, text = b.column(1).to_pylist(), b.column(2).to_pylist()
        all_ = [words(q) + words(t) for q, t in zip(lead, text, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(Batch(all_).nodes()), pa.array(map(" ".join, all_), pa.string())], ["node", "words"])

    return rows.mapInArrow(per_batch(f), "node long, words string")


def one_per_node(made: DataFrame) -> DataFrame:
    """Features of each node once. Only rows whose node may occur again are shuffled."""
    again = made.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
    held = bitmap(made.sparkSession, again)
    schema = made.schema

    def part(copies: bool):
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            maybe = among(b.column(b.schema.get_field_index("node")).to_numpy(), held.value)
            return b.filter(pa.array(maybe == copies))

        return made.mapInArrow(per_batch(f, 10_000), schema)

    return part(False).unionByName(part(True).dropDuplicates(["node"]))


def bounded_pairs(t: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Pairs of nodes of one tile (side 1 and 2, or any where both are 3) that have a prefix class in common and whose sizes, places and bit counts allow the likeness."""
    t = t.combine_chunks()
    split = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
    block, side, size, node = (t.column(c).to_numpy() for c in ("block", "side", "n", "node"))
    bits = np.stack([t.column(c).to_numpy().view(np.uint64) for c in SIG])
    keys, at = (t.column(c).combine_chunks() for c in ("keys", "at"))
    row = np.repeat(np.arange(len(node)), np.diff(keys.offsets.to_numpy()))
    key = keys.flatten().to_numpy()
    left = size[row] - at.flatten().to_numpy()  # shingles from this class on: no more are in common, if it is the first that is
    o = np.argsort(key.view(np.uint32).astype(np.uint64) << np.uint64(32) | size[row].astype(np.uint64))
    row, key, left = row[o], key[o], left[o]
    n = size[row].astype(np.int32)
    share, found, held = threshold / (1 + threshold), [], 0
    most = ((left + 1e-9) / share - n).astype(np.int32)  # size of the largest set that may be alike
    spare = (n * (1 - 2 * share)).astype(np.int16 if len(n) and n.max() < 30_000 else np.int64)  # bits that may differ, rounded down
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], np.int64)
    end = np.r_[start[1:], len(key)]
    further = "more" in t.column_names
    if further:
        more = t.column("more").combine_chunks()
        long = np.diff(more.offsets.to_numpy()) > 0
        place, more = np.cumsum(long) - 1, more.flatten().to_numpy().view(np.uint64).reshape(int(long.sum()), MORE // 64)

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal found, held
        a, b = row[i], row[j]
        ok = (a != b) & ((side[a] & 1 & side[b] >> 1) | (side[a] >> 1 & side[b] & 1)).astype(bool)
        if split:
            ok &= block[a] != block[b]
        if further:
            both = np.flatnonzero(ok & long[a] & long[b])
            for z in range(0, len(both), 100_000):
                k = both[z : z + 100_000]
                differ = np.bitwise_count(more[place[a[k]]] ^ more[place[b[k]]]).sum(axis=1, dtype=np.int64)
                ok[k] = differ <= spare[i[k]].astype(np.int64) + spare[j[k]] + 1
        a, b = a[ok], b[ok]
        found.append(np.minimum(a, b).astype(np.int64) * len(node) + np.maximum(a, b))
        held += len(a)
        if held > 4_000_000:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0]) // 2

    few = np.repeat(end - start <= FEW, end - start)
    i, d = np.flatnonzero(few), 1
    while len(i):
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        j = i + d
        near = (n[j] <= most[i]) & (n[i] <= most[j])
        a, b = i[near], j[near]
        differ = np.bitwise_count(bits[:, row[a]] ^ bits[:, row[b]]).sum(axis=0, dtype=np.int64)
        ok = differ <= spare[a].astype(np.int64) + spare[b] + 1
        keep(a[ok], b[ok])
        d += 1
    any_side = bool((side == 3).all())
    for s, e in zip(*(x[end - start > FEW] for x in (start, end)), strict=True):
        own = side[row[s:e]]
        for x, y in ((3, 3),) if any_side else ((1, 2), (2, 1)):
            one, other = np.flatnonzero((own & x > 0) & (most[s:e] >= n[s:e])) + s, np.flatnonzero(own & y) + s  # one: the smaller set of a pair
            if not (len(one) and len(other)):
                continue
            one = one[np.argsort((np.minimum(8 * (most[one] - n[one]) // np.maximum(n[one], 1), 8)).astype(np.int64) << 32 | n[one])]  # bands of a block begin and end together
            ns, ms, sp, of = n[other], most[other], spare[other] + 1, bits[:, row[other]]
            low, high = np.searchsorted(ns, n[one]), np.searchsorted(ns, most[one], "right")
            for a in range(0, len(one), ROWS):
                i = one[a : a + ROWS]
                c, d = low[a : a + ROWS].min(), high[a : a + ROWS].max()
                if c >= d:
                    continue
                differ = np.zeros((len(i), d - c), np.int16)
                for v, w in zip(bits[:, row[i]], of, strict=True):
                    differ += np.bitwise_count(v[:, None] ^ w[None, c:d])
                p, q = np.nonzero(differ <= spare[i, None] + sp[None, c:d])
                i, q = i[p], q + c
                ok = (ns[q] <= most[i]) & (n[i] <= ms[q])
                if ok.any():
                    keep(i[ok], other[q[ok]])
    if not any(map(len, found)):
        return None
    both = np.unique(np.concatenate(found))
    a, b = node[both // len(node)], node[both % len(node)]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def grouped(nodes: DataFrame, groups: int, rounds: int = 1, turn: int = 0) -> DataFrame:
    """(key, node, n, side, s0.., keys, at, and more of nodes that have it): nodes (node, n, side, s0.., keys, at) once for each group of classes whose turn it is, with those of the prefix that are in it."""
    more = ["more"] if "more" in nodes.columns else []

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        p, q = (b.column(b.schema.get_field_index(c)) for c in ("keys", "at"))
        key, at = p.flatten().to_numpy(), q.flatten().to_numpy()
        row = np.repeat(np.arange(b.num_rows), np.diff(p.offsets.to_numpy()))
        group = (key.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B1) % np.uint64(2**32) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)
        if rounds > 1:
            now = group % rounds == turn
            key, row, at, group = key[now], row[now], at[now], group[now]
        o = np.lexsort((group, row))
        key, row, at, group = key[o], row[o], at[o], group[o]
        if not len(key):
            return None
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (group[1:] != group[:-1])])
        offsets = pa.array(np.r_[first, len(key)].astype(np.int32))
        same = b.select([*more, "node", "n", "side", *SIG]).take(pa.array(row[first]))
        return pa.RecordBatch.from_arrays([pa.array(group[first]), *same.columns, pa.ListArray.from_arrays(offsets, pa.array(key)), pa.ListArray.from_arrays(offsets, pa.array(at))], ["key", *same.schema.names, "keys", "at"])

    return nodes.mapInArrow(per_batch(f), "key int, " + "more array<long>, " * len(more) + f"node long, n int, side int, {SIG_SCHEMA}, keys array<int>, at array<int>")


def group_sizes(nodes: DataFrame, groups: int) -> DataFrame:
    """(key, df): nodes of each group, counted per task first."""

    def f(batches):
        total = np.zeros(groups, np.int64)
        for b in sliced(batches, 10_000):
            p = b.column(0)
            row = np.repeat(np.arange(b.num_rows), np.diff(p.offsets.to_numpy()))
            group = (p.flatten().to_numpy().view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B1) % np.uint64(2**32) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            total += np.bincount(np.unique(row * groups + group) % groups, minlength=groups)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups, dtype=np.int32)), pa.array(total)], ["key", "df"])

    return nodes.select("keys").mapInArrow(f, "key int, df long").groupBy("key").agg(F.sum("df").alias("df"))


def candidates(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs (a, b), a < b, that hold all pairs of nodes (node, n, side, s0.., keys, at) of different words whose likeness reaches the threshold; one has side 1 or 3, the other 2 or 3. A group with more nodes than a block gets a tile for each pair of blocks, so that no task holds an unbounded group. Groups are far smaller than a block, so that only those of a hot class do: each block more is another copy of the nodes. Many groups take turns, so that the shuffle of one turn, not of all, is on disk."""
    nodes = stored(nodes)
    posts = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    groups = max(GROUPS, -(-posts // GROUP))
    nb = F.ceil(F.col("df") / block).cast("int")
    sizes = checkpoint(group_sizes(nodes, groups))
    rounds = min(max(-(-posts // ROUND), 1), TURNS, groups)

    def pairs(turn: int) -> DataFrame:
        p = grouped(nodes, groups, rounds, turn).join(F.broadcast(sizes), "key").withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        p = p.withColumn("other", F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))))
        p = p.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "n", "side", *SIG, "keys", "at", *[c for c in ["more"] if c in nodes.columns])
        p = p.repartition(4 * -(-groups // rounds), "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
        return p.mapInArrow(by_runs(lambda t: bounded_tiles(t, threshold), ["key", "bi", "bj"]), "a long, b long").distinct()

    if rounds == 1:
        return pairs(0)
    done = None
    for turn in range(rounds):
        new = checkpoint(pairs(turn))
        done = new if done is None else done.unionByName(new)
        gc.collect()  # nothing refers to the shuffle of this round now; Spark deletes its files when the driver's JVM collects garbage
        nodes.sparkSession._jvm.System.gc()
    return done.distinct()


def bounded_tiles(t: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """bounded_pairs of several tiles, one after another."""
    key = [t.column(c).to_numpy() for c in ("key", "bi", "bj")]
    cut = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0), True])
    out = [x for a, b in zip(cut[:-1], cut[1:], strict=True) if (x := bounded_pairs(t.slice(a, b - a), threshold)) is not None]
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def set_pairs(b: pa.RecordBatch, one: str, other: str, shingle: int) -> tuple[np.ndarray, list[list[str]], list[list[str]]]:
    """Likeness of each row's two word lists, and the lists."""
    x, y = ([w.split(" ") for w in b.column(c).to_pylist()] for c in (one, other))
    doc, h = Batch([w for both in zip(x, y, strict=True) for w in both]).shingles(shingle)
    n = np.bincount(doc, minlength=2 * b.num_rows).reshape(-1, 2).sum(axis=1)  # of both, those in common twice
    pair, all_ = distinct(doc >> 1, h)
    different = np.bincount(pair, minlength=b.num_rows)
    return (n - different) / np.maximum(different, 1), x, y


def exact_pairs(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes with their likeness, where it reaches the threshold."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        like, _, _ = set_pairs(b, "wa", "wb", shingle)
        ok = pa.array(like >= threshold - 1e-12)
        return pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(like).filter(ok)], ["a", "b", "likeness"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b")
    return both.select("a", "b", "wa", "wb").mapInArrow(per_batch(f), "a long, b long, likeness double").dropDuplicates(["a", "b"])


def near_links(rows: DataFrame, id: Column, text: Column, lead: Column | None = None, *, threshold: float = 0.6, shingle: int = 3, least_words: int = 30, block: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (id, node), a node for all rows with the same words; links has (a, b, likeness), the pairs of nodes whose likeness reaches the threshold.

    All such pairs are found, at any text size and wherever the edits are. No cap
    on partners. Nulls and texts under ``least_words`` words have no node; an
    empty table gives no rows; a repeated id counts once; other columns of
    ``rows`` aren't touched.
    """
    src = rows.select(id.cast("string").alias("id"), (F.lit(None).cast("string") if lead is None else lead.cast("string")).alias("lead"), text.cast("string").alias("text")).where("id is not null and text is not null")
    made = stored(features(src, shingle, least_words, threshold, classes(src, shingle), more=True))
    members = made.select("id", "node").distinct()
    pairs = checkpoint(candidates(one_per_node(made).select("node", "n", F.lit(3).alias("side"), *SIG, "keys", "at", "more"), threshold, block))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reps = made.groupBy("node").agg(F.min("id").alias("id")).join(ends, "node").select(F.xxhash64("id").alias("h"))
    texts = word_lists(src.withColumn("hash", F.xxhash64("id")), bitmap(rows.sparkSession, reps))
    return members, exact_pairs(pairs, texts, shingle, threshold)


def near_groups(rows: DataFrame, id: Column, text: Column, lead: Column | None = None, **how) -> DataFrame:
    """One row per record in a group of two or more: (id, group_id, links). group_id is the least id of the group; links counts the other texts that the record's text is linked to."""
    members, links = near_links(rows, id, text, lead, **how)
    links = checkpoint(links)
    members = checkpoint(members)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = checkpoint(hash_to_min(links).join(degree, "node"))
    size = members.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    nodes = checkpoint(size.join(linked, "node", "left").select("node", "id", "n", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    groups = nodes.groupBy("component").agg(F.min("id").alias("group_id"), F.sum("n").alias("size")).where("size > 1").select("component", "group_id")
    labelled = checkpoint(joined(nodes.select("node", "component", "links"), groups, "component").select("node", "group_id", "links"))
    return joined(members, labelled, "node").select("id", "group_id", "links")
