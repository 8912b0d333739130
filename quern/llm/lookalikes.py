"""Visually identical text with different characters: one consistent form for a corpus."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import SUSPECT, LookalikeModel, symbols
from quern.llm.words import per_batch


def _suspect(text: str | None) -> bool:
    return text is not None and bool(SUSPECT.search(text) or not unicodedata.is_normalized("NFC", text))


def symbol_counts(texts: DataFrame) -> DataFrame:
    """(symbol, n) over all rows of the only column: each code point, and each letter with up to three marks. There are at most as many rows as symbols of writing, however large the corpus."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, piles = np.zeros(0x110000, np.int64), Counter()
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = [t for t in b.column(0).slice(i, 2000).to_pylist() if t]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                found = np.bincount(codes)
                points[: len(found)] += found
                for t in part:
                    if _suspect(t):
                        piles.update(s for s in symbols(t) if len(s) > 1)
        seen = np.flatnonzero(points)
        seen = seen[(seen < 0xD800) | (seen > 0xDFFF)]
        yield pa.RecordBatch.from_arrays([pa.array([*map(chr, seen.tolist()), *piles]), pa.array([*points[seen].tolist(), *piles.values()], pa.int64())], ["symbol", "n"])

    return texts.mapInArrow(f, "symbol string, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame) -> dict[str, int]:
    """Symbol counts for LookalikeModel. Only the symbols are brought to the driver."""
    t = symbol_counts(texts).toArrow()
    return dict(zip(t.column("symbol").to_pylist(), t.column("n").to_pylist(), strict=True))


def unify(rows: DataFrame, id: Column, text: Column, counts: dict[str, int], changed_only: bool = False) -> DataFrame:
    """(id, text, changed): each text in consistent form.

    The learnt classes rewrite a text; ``counts`` are those of ``learn`` over the
    same texts. That the result is the plain definition's is tested. Null and empty texts
    come out as they are, unchanged. Repeated rows come out as often as they come in.
    """
    held = rows.sparkSession.sparkContext.broadcast(counts)
    models: list[LookalikeModel] = []

    def f(b: pa.RecordBatch) -> pa.RecordBatch | None:
        if not models:
            models.append(LookalikeModel(held.value))
        ids, texts = b.column(0), b.column(1).to_pylist()
        out, flags = [], []
        for t in texts:
            if _suspect(t):
                form = models[0].rewrite(t)
                out.append(form)
                flags.append(form != t)
            else:
                out.append(None if changed_only else t)
                flags.append(False)
        made = pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string()), pa.array(flags, pa.bool_())], ["id", "text", "changed"])
        return made.filter(made.column("changed")) if changed_only else made

    src = rows.select(id.cast("string").alias("id"), text.cast("string").alias("text"))
    return src.mapInArrow(per_batch(f, 2000), "id string, text string, changed boolean")
