"""Cross-split overlap: evaluation texts cut into segments, matched in training texts, verified exactly.

With a likeness of word runs an edit is a lost run: of the n runs of an
evaluation text at most k = n - ceil(threshold n) may be lost. The segments are
runs, and any k + 1 of them hold one that the training text has too; the rarest
are taken (the prefixes of ``neardup``, where runs of one phrase form one
segment), at the places that sizes allow. Moves are single edits here, so a
distance in words can't decide; the verdict is the exact likeness. On request
banded dynamic programming gives the distance in words of the pairs found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.neardup import SIG, candidates, classes, features, set_pairs, word_lists
from quern.llm.words import Batch, bitmap, per_batch
from quern.plans.lineage import checkpoint, stored


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distances in words of many pairs at once; -1 where it is above the band."""
    m = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width, far = 2 * band + 1, np.int32(1 << 20)
    pa_ = np.zeros((m, max(la.max(initial=0), 1)), np.uint64)
    pb = np.zeros((m, int(lb.max(initial=0)) + 2 * band + int(la.max(initial=0)) + 2), np.uint64)
    for i in range(m):
        pa_[i, : la[i]] = a[i]
        pb[i, band : band + lb[i]] = b[i]
    offset = np.arange(width) - band  # column j of row i is place i + offset of b
    row = np.where(offset >= 0, offset, far).astype(np.int32) + np.zeros((m, 1), np.int32)
    row = np.where(offset[None, :] <= lb[:, None], row, far)
    out = np.where((la == 0) & (lb <= band), lb, -1)
    for i in range(1, int(la.max(initial=0)) + 1):
        j = i + offset
        other = pb[:, i - 1 : i - 1 + width]
        new = row + (other != pa_[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.where((j[None, :] == 0), i, new)
        new = np.where((j[None, :] < 0) | (j[None, :] > lb[:, None]), far, new)
        row = (np.minimum.accumulate(new - np.arange(width), axis=1) + np.arange(width)).astype(np.int32)
        row = np.where((j[None, :] < 0) | (j[None, :] > lb[:, None]), far, row)
        done = (la == i) & (np.abs(lb - i) <= band)
        out[done] = row[done, (lb - i + band)[done]]
    return np.where(out > band, -1, out)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float, band: int | None) -> DataFrame:
    """Pairs (e, t) of nodes with their exact likeness, where it reaches the threshold, and edit distance in words (null beyond the band, or without one)."""

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        like, x, y = set_pairs(b, "we", "wt", shingle)
        keep = np.flatnonzero(like >= threshold - 1e-12)
        if not len(keep):
            return None
        if band is None:
            far = np.full(len(keep), -1)
        else:
            full = Batch([x[i] for i in keep] + [y[i] for i in keep])
            codes = [full.code[a : a + n] for a, n in zip(full.start, full.n, strict=True)]
            far = banded_distance(codes[: len(keep)], codes[len(keep) :], band)
        at = pa.array(keep)
        return pa.RecordBatch.from_arrays([b.column("e").take(at), b.column("t").take(at), pa.array(like[keep]), pa.array(far.astype(np.int32), mask=far < 0)], ["e", "t", "likeness", "edit_distance"])

    both = pairs.join(texts.select(F.col("node").alias("e"), F.col("words").alias("we")), "e").join(texts.select(F.col("node").alias("t"), F.col("words").alias("wt")), "t")
    return both.select("e", "t", "we", "wt").mapInArrow(per_batch(f, 500), "e long, t long, likeness double, edit_distance int").dropDuplicates(["e", "t"])


def cross_split_pairs(rows: DataFrame, id: Column, text: Column, splits: DataFrame, *, train: str = "train", threshold: float = 0.6, shingle: int = 3, least_words: int = 30, band: int | None = None, block: int = 1 << 20) -> DataFrame:
    """Pairs (train_id, eval_id, split, likeness, edit_distance) of a train and an evaluation record alike.

    ``splits`` has (id, split), split already one of the labels; an id with
    several labels counts with each, ids without rows count for nothing, as do
    null ids, labels and texts, and texts under ``least_words`` words. All such
    pairs are found. Rows with the same words are compared once and joined again
    at the end. ``edit_distance`` is null without a ``band``, and beyond it.
    """
    spark = rows.sparkSession
    src = rows.select(id.cast("string").alias("id"), F.lit(None).cast("string").alias("lead"), text.cast("string").alias("text")).where("id is not null and text is not null")
    label = splits.where("id is not null and split is not null").select("id", "split").distinct()
    made = stored(features(src, shingle, least_words, threshold, classes(src, shingle)))
    of = made.select("id", "node").distinct()
    sides = label.groupBy("id").agg(F.bit_or(F.when(F.col("split") == train, 1).otherwise(2)).alias("side"))
    side = checkpoint(of.join(sides, "id").groupBy("node").agg(F.bit_or("side").alias("side")))
    nodes = made.dropDuplicates(["node"]).join(side, "node").select("node", "n", "side", *SIG, "keys", "at")
    both = F.explode(F.array(F.struct(F.col("a").alias("e"), F.col("b").alias("t")), F.struct(F.col("b").alias("e"), F.col("a").alias("t")))).alias("p")
    pairs = candidates(nodes, threshold, block).select(both).select("p.*")
    pairs = pairs.join(side.where("side in (2, 3)").select(F.col("node").alias("e")), "e", "left_semi").join(side.where("side in (1, 3)").select(F.col("node").alias("t")), "t", "left_semi").select("e", "t")
    pairs = checkpoint(pairs.union(side.where("side = 3").select(F.col("node").alias("e"), F.col("node").alias("t"))))
    ends = pairs.select(F.explode(F.array("e", "t")).alias("node")).distinct()
    reps = of.groupBy("node").agg(F.min("id").alias("id")).join(ends, "node").select(F.xxhash64("id").alias("h"))
    texts = word_lists(src.withColumn("hash", F.xxhash64("id")), bitmap(spark, reps))
    good = verified(pairs, texts, shingle, threshold, band)
    te = of.join(label.where(F.col("split") == train).select("id"), "id").select(F.col("node").alias("t"), F.col("id").alias("train_id"))
    es = of.join(label.where(F.col("split") != train), "id").select(F.col("node").alias("e"), F.col("id").alias("eval_id"), "split")
    return good.join(te, "t").join(es, "e").where("train_id <> eval_id").select("train_id", "eval_id", "split", "likeness", "edit_distance")


def split_labels(splits: DataFrame, id: str = "example_id", split: str = "split") -> DataFrame:
    """(id, split) with split one of train, val, test; other labels give null."""
    s = F.lower(F.trim(F.col(split)))
    return splits.select(F.col(id).cast("string").alias("id"), F.when(s.isin("val", "validation"), "val").when(s.isin("train", "test"), s).alias("split"))


def report(pairs: DataFrame, rows: DataFrame, id: Column, source: Column) -> DataFrame:
    """(split, source, eval_records, train_records, pairs, same, few_edits) per evaluation split and source; a missing source is null. same: pairs with the same words; few_edits: others within the band of edits in words."""
    src = rows.select(id.cast("string").alias("eval_id"), source.alias("source")).dropDuplicates(["eval_id"])
    return pairs.join(src, "eval_id", "left").groupBy("split", "source").agg(F.countDistinct("eval_id").alias("eval_records"), F.countDistinct("train_id").alias("train_records"), F.count("*").alias("pairs"), F.count_if(F.col("edit_distance") == 0).alias("same"), F.count_if(F.col("edit_distance") > 0).alias("few_edits"))
