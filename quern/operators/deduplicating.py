"""Exact, structural and near-duplicate removal, and diverse selection.

Greedy removal keeps a row unless an earlier kept row is alike. Its result is
the lexicographically first maximal independent set of the graph of alike
pairs, so it is computed on that graph, in rounds, instead of row by row.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions.stats import lane_coefficients
from quern.functions.text import let
from quern.operators.batches import among, bitmap, by_runs, per_batch, sliced
from quern.plans.lineage import checkpoint, freed, stored

PRIME = (1 << 31) - 1


def exact(df: DataFrame, key: Column, position: Column) -> DataFrame:
    """First row of each key. Of a hot key only one row per task is shuffled."""
    first = df.select(key.alias("__k"), position.alias("__p")).groupBy("__k").agg(F.min("__p").alias("__p"))
    return df.withColumn("__k", key).withColumn("__p", position).join(first, ["__k", "__p"], "left_semi").drop("__k", "__p")


def structural(df: DataFrame, key: Sequence[Column], position: Column, protected: Column) -> DataFrame:
    """First unprotected row of each key, and all protected rows. Rows that go later on still hold their key."""
    k = F.sha2(F.to_json(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(key))), {"ignoreNullFields": "false"}), 256)
    d = df.withColumn("__k", F.when(~F.coalesce(protected, F.lit(False)), k)).withColumn("__p", position)
    first = d.where("__k is not null").groupBy("__k").agg(F.min("__p").alias("__first"))
    return d.join(first, "__k", "left").where("__k is null or __p = __first").drop("__k", "__p", "__first")


@lru_cache(maxsize=1)
def _crc_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def _char_crcs(code: np.ndarray, width: np.ndarray) -> np.ndarray:
    """CRC register after the UTF-8 of each character alone, from zero."""
    steps, x = _crc_steps(), np.zeros(len(code), np.uint32)
    for i in range(4):
        more = np.clip(6 * (width - 1 - i), 0, None).astype(np.uint32)  # bits of the bytes to come
        byte = code >> more
        byte = np.where(width == 1, byte, byte & 63 | 128) if i else np.where(width == 1, byte, byte | (0xF00 >> width) & 255)
        x = np.where(i < width, steps[(x ^ byte) & 255] ^ (x >> np.uint32(8)), x).astype(np.uint32)
    return x


def gram_crcs(texts: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, CRC-32 of the UTF-8) of each run of n characters, in order. A CRC is linear: that of a run is the sum of its characters', each carried on over the bytes after it."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row, runs = np.repeat(np.arange(len(texts)), np.maximum(size - n + 1, 0)), len(code) - n + 1
    if not len(row):
        return row, np.array([], np.int64)
    seen = np.zeros(int(code.max()) + 1, bool)
    seen[code] = True
    used = np.flatnonzero(seen).astype(np.uint32)
    place = np.zeros(len(seen), np.int32)
    place[used] = np.arange(len(used))
    steps, far = _crc_steps(), 4 * n
    width = (1 + (used >= 0x80) + (used >= 0x800) + (used >= 0x10000)).astype(np.int32)
    carried, start = [_char_crcs(used, width)], [np.array([0xFFFFFFFF], np.uint32)]
    for _ in range(far):
        for x in (carried, start):
            x.append(steps[x[-1] & np.uint32(255)] ^ (x[-1] >> np.uint32(8)))
    table, start = np.concatenate(carried), np.concatenate(start)
    code = place.take(code)
    end = np.zeros(len(code) + 1, np.int32)
    np.cumsum(width.take(code), out=end[1:])
    last = end[n:]
    out = ~start.take(last - end[:runs])
    for i in range(n):  # at all places, those across two texts as well
        out ^= table.take((last - end[i + 1 : i + 1 + runs]) * np.int32(len(used)) + code[i : i + runs])
    if len(row) < runs:
        within = np.ones(runs, bool)
        cut = np.cumsum(size)[:, None] - np.arange(1, n)
        within[cut[(cut >= 0) & (cut < runs)]] = False
        out = out[within]
    return row, out.astype(np.int64)


def minhash_lanes(texts: Sequence[str | None], k: int, shingle: int, seed: int) -> np.ndarray:
    """Lanes of ``minhash``, a row per text."""
    a, b = (np.array(x, np.int64)[None, :] for x in lane_coefficients(k, seed))
    out = np.full((len(texts), k), PRIME, np.int64)
    for z in range(0, len(texts), 200):
        row, x = gram_crcs([" ".join(t.lower().split()) if t else "" for t in texts[z : z + 200]], shingle)
        pair = np.unique(row << 32 | x)
        row, x = (pair >> 32) + z, pair & 0xFFFFFFFF
        for i in range(0, len(x), 1 << 17):  # long texts in portions
            value, of = np.unique(x[i : i + (1 << 17)], return_inverse=True)
            h = np.empty((len(value), k), np.int32)
            for j in range(0, len(value), 256):
                y = a * value[j : j + 256, None]
                y += b
                for _ in range(2):
                    high = y >> 31
                    y &= PRIME
                    y += high
                y[y >= PRIME] -= PRIME
                h[j : j + 256] = y
            r = row[i : i + (1 << 17)]
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for p, q, z0 in zip(first, np.r_[first[1:], len(r)], r[first], strict=True):
                np.minimum(out[z0], h[of[p:q]].min(axis=0), out=out[z0])
    out[(out == PRIME).all(axis=1)] = 0
    return out


def minhash(text: Column, k: int = 128, shingle: int = 5, seed: int = 7) -> Column:
    """k lanes of (a x + b) mod 2^31-1 over CRC-32 of the character shingles of the lower-cased text with single blanks; zeros for texts too short for one and for nulls.

    A vectorised UDF: as nested lambdas the shingles would be made anew for
    each lane, and lambdas aren't compiled.
    """

    @F.pandas_udf("array<long>")
    def lanes(texts: pd.Series) -> pd.Series:
        return pd.Series(list(minhash_lanes(texts.tolist(), k, shingle, seed)))

    return lanes(text)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def lane_features(df: DataFrame, id: str, text: str, words: str, agree: float, k: int = 128) -> DataFrame:
    """(id, node, words, s0, s1, bands) of texts: a hash of all lanes, one bit of each, and 32-bit keys of so many bands that two rows whose share of equal lanes reaches ``agree`` have one in common."""
    bands = k - math.ceil(agree * k - 1e-9) + 1
    width = k // bands
    odd = np.random.RandomState(1).randint(0, 1 << 62, k).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def f(batches):
        for b in sliced(batches):
            lanes = minhash_lanes(b.column(1).to_pylist(), k, 5, 7).astype(np.uint64)
            scaled = lanes * odd
            node = _mixed(scaled.sum(axis=1)).view(np.int64)
            keys = _mixed(scaled[:, : bands * width].reshape(-1, bands, width).sum(axis=2) + np.arange(bands, dtype=np.uint64) * odd[0])
            bits = np.packbits((lanes & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            keys = pa.array((keys >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * bands), keys)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), b.column(2), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(2)), keys], ["id", "node", "words", "s0", "s1", "bands"])

    rows = df.select(F.col(id).alias("id"), F.col(text), F.col(words).cast("int").alias("words"))
    return rows.mapInArrow(f, T.StructType([rows.schema["id"], *T._parse_datatype_string("node long, words int, s0 long, s1 long, bands array<int>")]))


def band_pairs(t: pa.Table, differ: int, window: float) -> pa.RecordBatch | None:
    """(a, b) of rows (key, id, words, s0, s1) that have a key in common, sizes within the window and few enough different bits."""
    t = t.combine_chunks()
    key, n, s0, s1 = (t.column(c).to_numpy() for c in ("key", "words", "s0", "s1"))
    o = np.lexsort((n, key))
    key, n, s0, s1 = key[o], n[o], s0[o].view(np.uint64), s1[o].view(np.uint64)
    found, i, d = [], np.arange(len(key)), 1
    while len(i):
        i = i[i + d < len(key)]
        i = i[(key[i] == key[i + d]) & (n[i] * window >= n[i + d])]  # sizes ascend
        j = i + d
        ok = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int16) + np.bitwise_count(s1[i] ^ s1[j]) <= differ
        found.append(o[i[ok]] << 32 | o[j[ok]])
        d += 1
    both = np.concatenate(found) if found else np.array([], np.int64)
    if not len(both):
        return None
    ids = t.column("id").combine_chunks()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(both >> 32)), ids.take(pa.array(both & 0xFFFFFFFF))], ["a", "b"])


def banded_pairs(df: DataFrame, id: str, text: str, words: str, within: DataFrame, *, agree: float = 0.85, window: float = 1.2) -> DataFrame:
    """(a, b), a < b: pairs of the texts, of the ids ``within``, whose share of equal MinHash lanes reaches ``agree``, sizes within the window either way.

    Rows with the same lanes are one node, with their least id, see ``with_copies``. So few lanes
    may differ that, with one band more than that, a band is the same: no pair is
    missed. Within a band rows are sorted by size and compared by one bit of
    each lane; only what remains is made anew from the texts and compared by lane, once.
    Shuffle files of a step are freed before the next.
    """
    k = 128
    spark = df.sparkSession
    freed(spark)
    made = stored(lane_features(df, id, text, words, agree, k))
    ids = within.select(F.col(within.columns[0]).alias("id"))
    one = checkpoint(made.select("id", "node", "words").join(ids, "id", "left_semi"))
    first = checkpoint(one.groupBy("node", "words").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"))
    copies = checkpoint(one.join(first, ["node", "words"]).where("id <> rep").select("rep", F.col("id").alias("copy")))
    nodes = made.drop("node").join(one.select("id").join(copies.select(F.col("copy").alias("id")), "id", "left_anti"), "id", "left_semi")

    def f(batches):
        for b in sliced(batches):
            bands = b.column(4)
            r = pa.array(np.repeat(np.arange(b.num_rows), np.diff(bands.offsets.to_numpy())))
            yield pa.RecordBatch.from_arrays([bands.flatten(), *(b.column(i).take(r) for i in range(4))], ["key", "id", "words", "s0", "s1"])

    kind = made.schema["id"]
    posts = nodes.select("id", "words", "s0", "s1", "bands").mapInArrow(f, T.StructType([T.StructField("key", T.IntegerType()), kind, *T._parse_datatype_string("words int, s0 long, s1 long")]))
    differ = k - math.ceil(agree * k - 1e-9)
    pair = T.StructType([T.StructField(c, kind.dataType) for c in "ab"])
    met = posts.repartition("key").sortWithinPartitions("key").mapInArrow(by_runs(lambda t: band_pairs(t, differ, window), ["key"]), pair)
    freed(spark)
    pairs = checkpoint(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    freed(spark)
    held = bitmap(spark, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select(F.xxhash64("id").alias("h")))

    def wanted(b: pa.RecordBatch) -> pa.RecordBatch | None:
        b = b.filter(pa.array(among(b.column(2).to_numpy(), held.value)))
        if not b.num_rows:
            return None
        lanes = pa.array(minhash_lanes(b.column(1).to_pylist(), k, 5, 7).astype(np.int32).reshape(-1))
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), lanes)], ["id", "lanes"])

    lanes = df.select(F.col(id).alias("id"), F.col(text), F.xxhash64(id).alias("h")).mapInArrow(per_batch(wanted), T.StructType([kind, *T._parse_datatype_string("lanes array<int>")]))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        return pd.Series((np.stack(x.to_numpy()) == np.stack(y.to_numpy())).mean(axis=1) >= agree - 1e-12)

    la, lb = lanes.toDF("a", "la"), lanes.toDF("b", "lb")
    found = checkpoint(pairs.join(la, "a").join(lb, "b").where(alike("la", "lb")).select("a", "b"))  # stands three times in what follows
    freed(spark)
    return with_copies(found, copies)


def with_copies(found: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives, and each representative with its own copies and with those of its partners. Copies aren't paired with copies: a later row is never kept beside an equal first one, so greedy removal needs no more where the representative is the first of its equals."""
    c = checkpoint(copies)
    both = found.select("a", "b").union(found.select("b", "a"))
    more = both.join(c.withColumnRenamed("rep", "b"), "b").select("a", F.col("copy").alias("b"))
    out = found.select("a", "b").union(more).union(c.select(F.col("rep").alias("a"), F.col("copy").alias("b")))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def greedy_keep(nodes: DataFrame, pairs: DataFrame, id: str, rank: str, protected: Column | None = None, most: int = 100) -> DataFrame:
    """(id, kept): the first maximal independent set by rank; protected rows are always kept and still block later rows.

    Rows in no pair are kept at once. Each round keeps the undecided rows
    without an undecided earlier neighbour and drops the neighbours after them;
    only pairs with an undecided end go on, checkpointed.
    """
    p = F.coalesce(protected, F.lit(False)) if protected is not None else F.lit(False)
    n = nodes.select(F.col(id).alias("id"), F.col(rank).alias("r"), p.alias("safe"))
    e = pairs.select("a", "b").distinct().join(n.select(F.col("id").alias("a"), F.col("r").alias("ra"), F.col("safe").alias("pa")), "a").join(n.select(F.col("id").alias("b"), F.col("r").alias("rb"), F.col("safe").alias("pb")), "b")
    swap = F.col("ra") > F.col("rb")
    e = e.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"), F.when(swap, F.col("pb")).otherwise(F.col("pa")).alias("px"), F.when(swap, F.col("pa")).otherwise(F.col("pb")).alias("py")).where("not py").select("x", "y")
    e = checkpoint(e)
    dropped = None
    for _ in range(most):
        if e.limit(1).count() == 0:
            break
        kept = e.select(F.col("x").alias("id")).distinct().join(e.select(F.col("y").alias("id")).distinct(), "id", "left_anti")
        out = checkpoint(e.join(kept, e["x"] == kept["id"], "left_semi").select(F.col("y").alias("id")).distinct())
        dropped = out if dropped is None else dropped.union(out)
        gone = out.withColumnRenamed("id", "gone")
        e = checkpoint(e.join(kept, e["x"] == kept["id"], "left_anti").join(gone, F.col("x") == F.col("gone"), "left_anti").join(gone, F.col("y") == F.col("gone"), "left_anti"))
    else:
        raise RuntimeError(f"undecided after {most} rounds")
    if dropped is None:
        return n.select(F.col("id").alias(id), F.lit(True).alias("kept"))
    return n.join(dropped.distinct().withColumn("__d", F.lit(True)), "id", "left").select(F.col("id").alias(id), F.col("__d").isNull().alias("kept"))


def hyperplanes(n: int, least: float, miss: float = 1e-4, most_bits: int = 24) -> tuple[int, int]:
    """(tables, bits) for n vectors: about as many buckets as vectors, so that what isn't alike seldom meets, and as many tables as find a pair at the cosine ``least`` but for a chance of ``miss``."""
    bits = min(max(math.ceil(math.log2(max(n, 2))), 8), most_bits)
    hit = (1 - math.acos(min(least, 1.0)) / math.pi) ** bits
    return max(math.ceil(math.log(miss) / math.log1p(-hit)), 1) if hit < 1 else 1, bits


@lru_cache(maxsize=2)
def _planes(dims: int, count: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).standard_normal((dims, count)).astype(np.float32)


def _bucket_keys(v: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    side = (v.astype(np.float32) @ _planes(v.shape[1], tables * bits, seed) > 0).reshape(len(v), tables, bits)
    return side @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << bits)


def cosine_pairs(vectors: DataFrame, id: str, vector: str, least: float, *, miss: float = 1e-4, seed: int = 7) -> DataFrame:
    """(a, b), a < b: pairs of dense vectors at least so alike, by random-hyperplane tables and an exact check.

    Vectors with the same numbers are one node first, see ``with_copies``. The
    number of tables and of their buckets follow from the number of nodes, see
    ``hyperplanes``. Neighbouring buckets aren't probed.
    """
    unit = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x))
    d = checkpoint(vectors.select(F.col(id).alias("id"), let(norm, lambda z: F.when(z > 0, F.transform(unit, lambda x: x / z))).alias("v")).where("v is not null"))
    keyed = checkpoint(d.groupBy(F.sha2(F.to_json("v"), 256).alias("h")).agg(F.min("id").alias("id"), F.first("v").alias("v")))
    tables, bits = hyperplanes(keyed.count(), least, miss)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def bucket_keys(v: pd.Series) -> pd.Series:
        return pd.Series(list(_bucket_keys(np.stack(v.to_numpy()), tables, bits, seed)) if len(v) else [])

    buckets = keyed.select("id", F.explode(bucket_keys("v")).alias("k"))
    pairs = buckets.select(F.col("id").alias("a"), "k").join(buckets.select(F.col("id").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    both = pairs.join(keyed.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(keyed.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    cos = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    found = both.where(cos >= least).select("a", "b")
    copies = d.select(F.sha2(F.to_json("v"), 256).alias("h"), F.col("id").alias("copy")).join(keyed.select("h", F.col("id").alias("rep")), "h").where("copy <> rep").select("rep", "copy")
    return with_copies(found, copies)


def gram_vector(text: str, n: int = 4, dims: int = 4096) -> np.ndarray:
    """L2-normalised counts of the hashed character n-grams of the lower-cased text, blanks added to a shorter one."""
    t = text.lower().ljust(n)
    v = np.bincount([zlib.crc32(t[i : i + n].encode("utf-8", "surrogatepass")) % dims for i in range(len(t) - n + 1)], minlength=dims).astype(np.float64)
    return v / np.sqrt(v @ v)


#: Dimensions of the sketches of gram vectors, those of the first comparison, rows of a block of comparisons, and what halves of a float lose at most.
SKETCH, FIRST, ROWS, LOST = 256, 64, 1024, 2e-3


def gram_matrix(texts: Sequence[str], n: int = 4, dims: int = 4096, rows: int = 100) -> np.ndarray:
    """``gram_vector`` of each text, as rows; some at a time, so that what is made on the way stays in the processor's cache."""
    out = np.empty((len(texts), dims), np.float32)
    for z in range(0, len(texts), rows):
        some = [t.lower().ljust(n) for t in texts[z : z + rows]]
        row, x = gram_crcs(some, n)
        v = np.bincount(row * dims + x % dims, minlength=len(some) * dims).reshape(len(some), dims).astype(np.float32)
        out[z : z + rows] = v / np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))[:, None].astype(np.float32)
    return out


def _directions(size: int, dims: int = 4096) -> np.ndarray:
    return np.random.RandomState(7).standard_normal((dims, size)).astype(np.float32)


def _axes(z: np.ndarray) -> np.ndarray:
    """Orthonormal axes of the span of the columns of z; any do, those along which the vectors vary most tell most apart."""
    return np.linalg.qr(z / max(np.abs(z).max(initial=0), 1e-30))[0].astype(np.float32)


def _rest(p: np.ndarray) -> np.ndarray:
    """Length of what isn't along the axes, never too short."""
    return np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", p, p), 0) + LOST)


def sketch_axes(texts: DataFrame, size: int = SKETCH, parts: int = 16) -> np.ndarray:
    """Axes for the sketches of all texts, by one step of subspace iteration over all of them; sums are made per task first."""

    def f(batches):
        o, z = _directions(size), np.zeros((4096, size), np.float64)
        for b in sliced(batches, 500):
            v = gram_matrix(b.column(0).to_pylist())
            z += v.T @ (v @ o)
        for i, x in enumerate(np.split(z, parts)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "z"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(x)
        for i, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "z"])

    t = texts.mapInArrow(f, "part int, z binary").repartition(parts, "part").mapInArrow(add, "part int, z binary").collect()  # one row per part
    z = np.concatenate([np.frombuffer(r["z"]) for r in sorted(t, key=lambda r: r["part"])]).reshape(4096, size) if t else np.zeros((4096, size))
    return _axes(z)


def sketch_tile(t: pa.Table, least: float) -> pa.RecordBatch | None:
    """(a, b) of one tile whose sketches allow the cosine: the product along the axes, and that of the lengths of the rests, bound it from above."""
    t = t.combine_chunks()
    node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
    v = np.frombuffer(t.column("v").combine_chunks().buffers()[2], np.float16)
    off = int(np.frombuffer(t.column("v").combine_chunks().buffers()[1], np.int32)[t.column("v").combine_chunks().offset]) // 2
    v = v[off : off + len(node) * SKETCH].reshape(len(node), SKETCH)
    one, other = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    p = v[:, :FIRST].astype(np.float32)
    some, rest = np.c_[p, _rest(p)], _rest(v.astype(np.float32))
    right, found = some[other].T.copy(), []
    for i in range(0, len(one), ROWS):
        x, y = np.nonzero(some[one[i : i + ROWS]] @ right >= least - LOST)
        x, y = one[i + x], other[y]
        ok = (x < y) | (side[x] != 3) | (side[y] != 3)
        x, y = x[ok], y[ok]
        for j in range(0, len(x), 100_000):
            a, b = x[j : j + 100_000], y[j : j + 100_000]
            ok = np.einsum("ij,ij->i", v[a].astype(np.float32), v[b].astype(np.float32)) + rest[a] * rest[b] >= least - LOST
            found.append((node[a[ok]], node[b[ok]]))
    if not any(len(a) for a, _ in found):
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])


def sketch_tiles(t: pa.Table, least: float) -> pa.RecordBatch | None:
    """sketch_tile of several tiles, one after another."""
    key = [t.column(c).to_numpy() for c in ("bi", "bj")]
    cut = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0), True])
    out = [x for a, b in zip(cut[:-1], cut[1:], strict=True) if (x := sketch_tile(t.slice(a, b - a), least)) is not None]
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def _blocks(n: int, most: int = 1 << 16) -> int:
    """For n vectors: blocks enough for some tasks, and of at most about 65,536."""
    return 1 if n < 4096 else max(6, -(-n // most))


def few_cosine_pairs(left: list[tuple], kind: T.StructField, right: DataFrame, id: str, text: str, least: float) -> DataFrame:
    """(a, b) of a few texts (id, text), at the driver, and each different text of a table, with its least id. The table is read once and no text is shuffled."""
    own = np.concatenate([gram_matrix([t for _, t in left[i : i + 500]]) for i in range(0, len(left), 500)])
    axes = _axes(own.T @ (own @ _directions(min(128, len(left)))))
    p = own @ axes
    sent = right.sparkSession.sparkContext.broadcast((own, axes, np.c_[p, _rest(p)].T.copy()))

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        own, axes, bound = sent.value
        texts = b.column(1).to_pylist()
        v = gram_matrix(texts)
        p = v @ axes
        x, y = np.nonzero(np.c_[p, _rest(p)] @ bound >= least - LOST)
        cos = np.concatenate([np.einsum("ij,ij->i", v[x[i : i + 1000]], own[y[i : i + 1000]], dtype=np.float64) for i in range(0, len(x), 1000)] or [np.array([])])
        x, y = x[cos >= least - 1e-6], y[cos >= least - 1e-6]
        hashes = {i: hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest() for i in set(x.tolist())}
        return pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array([hashes[i] for i in x.tolist()], pa.binary()), b.column(0).take(pa.array(x))], ["left", "h", "b"])

    rows = right.select(F.col(id).alias("b"), F.col(text)).where(F.col(text).isNotNull())
    met = rows.mapInArrow(per_batch(f, 500), T.StructType([*T._parse_datatype_string("left int, h binary"), rows.schema["b"]]))
    names = right.sparkSession.createDataFrame([(i, x) for i, (x, _) in enumerate(left)], T.StructType([T.StructField("left", T.IntegerType()), T.StructField("a", kind.dataType)]))
    return met.groupBy("left", "h").agg(F.min("b").alias("b")).join(F.broadcast(names), "left").select("a", "b")  # at most ``few`` rows


def text_cosine_pairs(left: DataFrame, id: str, text: str, least: float, right: DataFrame | None = None, few: int = 2048) -> DataFrame:
    """(a, b): texts whose hashed character 4-grams have at least that cosine; a < b of one table, or a of the left and b of the right one.

    Rows with the same text are one node first. All pairs of nodes are compared,
    in tiles, by sketches that bound their cosine from above: their vectors along some axes, and
    the length of the rest. The cosine itself is exact, and no pair is
    missed. A left table of at most ``few`` different texts is sent to the rows of the right one. Copies: of one table see
    ``with_copies``; between two tables each row of the left stands with one row of the right for each
    different text. Null texts are in no pair.
    """

    def nodes(df: DataFrame) -> DataFrame:
        return df.where(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("h")).agg(F.min(id).alias("id"), F.first(text).alias("t"))

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for i in range(0, len(x), 500):
            s, t = x[i : i + 500].tolist(), y[i : i + 500].tolist()
            place = {w: k for k, w in enumerate(dict.fromkeys([*s, *t]))}
            v = gram_matrix(list(place))
            out.append(np.einsum("ij,ij->i", v[[place[w] for w in s]], v[[place[w] for w in t]], dtype=np.float64))
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    one = nodes(left)
    rep = left.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("h"), F.col(id).alias("copy"))
    if right is not None:
        one = stored(one)
        held = one.select("id", "t").limit(few + 1).collect()  # at most ``few`` rows go on
        rep = rep.join(one.select("h", F.col("id").alias("rep")), "h")
        if not held:
            return rep.select(F.col("copy").alias("a"), F.col("rep").alias("b")).limit(0)
        if len(held) <= few:
            found = few_cosine_pairs([tuple(r) for r in held], one.schema["id"], right, id, text, least)
            return found.withColumnRenamed("a", "rep").join(rep.select("rep", "copy"), "rep").select(F.col("copy").alias("a"), "b")
    both = one.withColumn("side", F.lit(3)) if right is None else one.withColumn("side", F.lit(1)).unionByName(nodes(right).withColumn("side", F.lit(2)))
    n = stored(both.withColumn("node", F.xxhash64("h", "side")))
    sizes = dict(n.groupBy("side").count().collect())
    axes = n.sparkSession.sparkContext.broadcast(sketch_axes(n.select("t")))

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        v = (gram_matrix(b.column(2).to_pylist()) @ axes.value).astype(np.float16)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in v], pa.binary())], ["node", "side", "v"])

    p = n.select("node", "side", "t").mapInArrow(per_batch(f, 500), "node long, side int, v binary")
    own = lambda m: F.pmod("node", F.lit(m)).cast("int")
    every = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    if right is None:
        m = _blocks(sizes.get(3, 0))
        p = p.withColumn("own", own(m)).withColumn("other", F.explode(every(m)))
        # in a tile of two blocks one is on each side
        tile = p.select(F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "node", F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "v")
        tiles = m * (m + 1) // 2
    else:
        m, k = _blocks(sizes.get(1, 0)), _blocks(sizes.get(2, 0))
        a = p.where("side = 1").withColumn("bi", own(m)).withColumn("bj", F.explode(every(k)))
        b = p.where("side = 2").withColumn("bj", own(k)).withColumn("bi", F.explode(every(m)))
        tile, tiles = a.unionByName(b).select("bi", "bj", "node", "side", "v"), m * k
    met = tile.repartition(2 * tiles, "bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(by_runs(lambda t: sketch_tiles(t, least), ["bi", "bj"]), "a long, b long")
    pairs = checkpoint(met)
    held = bitmap(n.sparkSession, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def wanted(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(among(b.column(0).to_numpy(), held.value)))

    kind = n.schema["id"].dataType
    ends = n.select("node", "id", "t").mapInArrow(per_batch(wanted), T.StructType([T.StructField("node", T.LongType()), T.StructField("id", kind), T.StructField("t", T.StringType())]))
    ends = stored(ends)
    both = pairs.join(ends.toDF("a", "ia", "ta"), "a").join(ends.toDF("b", "ib", "tb"), "b")
    found = both.where(cosine("ta", "tb") >= least - 1e-6)
    if right is not None:
        return found.select(F.col("ia").alias("rep"), F.col("ib").alias("b")).join(rep.select("rep", "copy"), "rep").select(F.col("copy").alias("a"), "b")
    rep = rep.join(n.select("h", F.col("id").alias("rep")), "h")
    return with_copies(found.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")), rep.where("copy <> rep").select("rep", "copy"))


def remembered(batch: DataFrame, memory: DataFrame, id: str, text: str, least: float = 0.92) -> DataFrame:
    """(id, duplicate): whether the memory holds a row's text, or one with at least that cosine. Nothing is added to the memory. Null texts are no duplicates."""
    hit = text_cosine_pairs(batch, id, text, least, memory).select(F.col("a").alias(id)).distinct().withColumn("__d", F.lit(True))
    return batch.select(id).join(hit, id, "left").select(id, F.coalesce("__d", F.lit(False)).alias("duplicate"))


def replayed(df: DataFrame, id: str, text: str, position: Column, least: float = 0.92) -> DataFrame:
    """(id, duplicate) of a table read in order into an empty memory that takes what is no duplicate."""
    d = checkpoint(df.select(id, text, position.alias("__pos")))
    keep = greedy_keep(d, text_cosine_pairs(d, "__pos", text, least), "__pos", "__pos")
    return d.select(id, "__pos").join(keep, "__pos").select(id, (~F.col("kept")).alias("duplicate"))


def duplicate_rate(flags: DataFrame) -> DataFrame:
    """One row (n, dups, rate), the rate to four places; 0 without rows."""
    return flags.agg(F.count("*").alias("n"), F.count_if("duplicate").alias("dups"), F.coalesce(F.bround(F.avg(F.col("duplicate").cast("double")), 4), F.lit(0.0)).alias("rate"))


def ablation(batch: DataFrame, flags: DataFrame, id: str, text: str, phrases: list[str], grams: Callable[[Column], Column]) -> DataFrame:
    """(kept, n, distinct) of a batch as it is ("none"), without what is remembered ("memory"), and without texts that hold a listed phrase too ("all"); distinct: different n-grams by all, to four places. If the last keeps nothing, it is as the one before."""
    clean = ~F.coalesce(reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in phrases), F.lit(False)), F.lit(False))
    d = checkpoint(batch.join(flags, id).select(F.col(text).alias("t"), (~F.col("duplicate")).alias("memory"), (~F.col("duplicate") & clean).alias("all")))
    some = d.agg(F.max("all")).first()[0]
    d = d.withColumn("all", F.col("all") if some else F.col("memory"))
    sets = F.array_compact(F.array(F.lit("none"), F.when(F.col("memory"), "memory"), F.when(F.col("all"), "all")))
    n = d.select(F.explode(sets).alias("kept")).groupBy("kept").agg(F.count("*").alias("n"))
    g = d.select(F.explode(sets).alias("kept"), "t").select("kept", F.explode(grams(F.col("t"))).alias("g")).groupBy("kept", "g").agg(F.count("*").alias("c")).groupBy("kept").agg(F.bround(F.count("*") / F.sum("c"), 4).alias("distinct"))
    return n.join(g, "kept", "left").select("kept", "n", F.coalesce("distinct", F.lit(0.0)).alias("distinct"))


def cascade(df: DataFrame, id: str, text: str, key: Column, structure: Sequence[Column] | None, position: Column, protected: Column, agree: float = 0.85, cosine: float | None = None) -> DataFrame:
    """(id, stage): why each row went - exact, structural, near, or with a ``cosine`` embedding - or kept. Cheapest stages first, each on the survivors of the one before; the last two are one greedy removal, and near comes first where both hold. ``position`` is unique and orders the rows. Texts are read again for the last stages in place of being stored."""
    made = [c.alias(f"__k{i}") for i, c in enumerate(structure or ())]
    d = checkpoint(df.select(F.col(id), *made, position.alias("__pos"), key.alias("__key"), F.coalesce(protected, F.lit(False)).alias("__safe")))
    a = exact(d, F.col("__key"), F.col("__pos"))
    b = checkpoint(structural(a, [F.col(f"__k{i}") for i in range(len(made))], F.col("__pos"), F.col("__safe")) if structure else a)
    a = a if structure else b
    t = df.select(position.alias("__pos"), F.col(text).alias("__t")).where("__t is not null")
    near = banded_pairs(t.withColumn("__words", F.size(F.filter(F.split("__t", r"(?U)\s+"), lambda w: w != ""))), "__pos", "__t", "__words", b.select("__pos"), agree=agree)
    pairs = near
    if cosine is not None:
        near = checkpoint(near)
        pairs = near.union(text_cosine_pairs(t.join(b.select("__pos"), "__pos", "left_semi"), "__pos", "__t", cosine)).distinct()
    keep = greedy_keep(b, pairs, "__pos", "__pos", F.col("__safe"))
    if cosine is not None:
        keep = checkpoint(keep)
        alive = keep.where("kept").select(F.col("__pos").alias("a"))
        by_near = near.join(alive, "a", "left_semi").select(F.col("b").alias("__pos")).distinct().withColumn("__near", F.lit(True))
        keep = keep.join(by_near, "__pos", "left")
    else:
        keep = keep.withColumn("__near", F.lit(True))
    keep = keep.join(b.select("__pos", id), "__pos").select(id, "kept", "__near")
    mark = lambda x, c: x.select(F.col(id), F.lit(True).alias(c)).distinct()
    out = d.select(id).join(mark(a, "x"), id, "left").join(mark(b, "s"), id, "left").join(keep.distinct(), id, "left")
    return out.select(id, F.when(F.col("x").isNull(), "exact").when(F.col("s").isNull(), "structural").when(F.col("kept"), "kept").when(F.col("__near"), "near").otherwise("embedding").alias("stage"))


def latest(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Last-wins row per key; ``order`` must be unique within a key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("__r = 1").drop("__r")
