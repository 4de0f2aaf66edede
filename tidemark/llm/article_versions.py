"""Groups of rows whose pages carry versions of one article: the page model and the near-duplicate join in one.

Pages are parsed once, with their words; page matter is marked and the shingles of what is left are made in the same pass, so no
text is moved. Pages that hold no article are in no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import boilerplate as B
from tidemark.llm import near_duplicates as N
from tidemark.session import written


def grams(df: DataFrame, size: int = N.WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, print, grams) of the articles of (id, host, body, headline, url), and the ids of those that turned out as responses."""
    fitted = B.fit(df)
    shared = fitted.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = {n: batch.column(batch.schema.get_field_index(n)) for n in ("id", "forms", "tokens", "head_print")}
            marked = B.mark_batch(batch, shared.value)
            forms = [np.frombuffer(f, np.int32).reshape(len(B.FIELDS), -1) for f in named["forms"].to_pylist()]
            numbers, counts = np.concatenate([f[0] for f in forms]), np.concatenate([f[-1] for f in forms])
            lines = np.array([f.shape[1] for f in forms])
            page = np.repeat(np.arange(len(lines), dtype=np.int64), lines)
            gone = [(k << 32) | v for k, m in enumerate(marked) for v in m[0]]
            kept = ~np.isin((page << 32) | numbers, np.array(gone, np.int64))
            flags = np.array([m[2] for m in marked], np.int32)
            kept &= (flags[page] & B.NO_ARTICLE) == 0
            tokens = np.frombuffer(b"".join(named["tokens"].to_pylist()), np.int32)[np.repeat(kept, counts)]
            sizes = np.bincount(page[kept], weights=counts[kept], minlength=len(lines)).astype(np.int64)
            out, has = N.gram_batch(named["id"].to_numpy(zero_copy_only=False), tokens.view(np.uint32), sizes, size)
            extra = [pa.array(flags[has]), pa.array(np.array([m[3] for m in marked], np.int64)[has]), named["head_print"].filter(pa.array(has))]
            yield pa.RecordBatch.from_arrays([*out.columns, *extra], names=["id", "print", "grams", "flags", "response", "head_print"])

    pages = fitted.pages.drop("story")
    made = written(pages.mapInArrow(run, N.GRAMS + ", flags int, response bigint, head_print bigint"), "article-grams")
    maybe = made.where(F.col("flags").bitwiseAND(B.MAYBE) != 0)
    shown = maybe.groupBy("response").agg(F.countDistinct("head_print").alias("n")).where(F.col("n") >= B.RESPONSE_HEADLINES)
    return made.select("id", "print", "grams"), maybe.join(shown, "response", "left_semi").select("id")


def groups(df: DataFrame) -> DataFrame:
    """(id, group) of every row of (id, host, body, headline, url) that shares its article with another."""
    made, responses = grams(df)
    return N.groups_of(made, without=responses)
