"""Fields of a row that hold system output instead of text: the rows of problem "template residue".

Headline: an unfilled placeholder; or no word in common with the address slug and made of words that such headlines have and others
don't. Where the body doesn't side with the slug, those words must stand in several such headlines. Body: a placeholder in its own
text; or what is left after page matter is taken away is made of words that stand on pages without a word in common with address and
title, and hardly on others, or leans that way and stands under many different headlines (over all hosts).

Defined results: null and empty fields are never found; a row can be found for both fields; repeated rows are found alike; a
null address or headline only takes the evidence away that it would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import boilerplate as B
from tidemark.llm import residue as R

def found(df: DataFrame) -> DataFrame:
    """(id, field) for ``df`` (id, host, body, headline, url)."""
    x = B.judged(B.mark(df))
    has = lambda c, bit: F.col(c).bitwiseAND(bit) != 0
    body = x.where(F.col("no_article") | has("flags", B.PLACEHOLDER)).select("id", F.lit("body").alias("field"))
    odd = has("head", R.MISMATCHED) & (F.col("head_score") > B.HEAD_FROM) & (has("head", R.SIDES) | (F.col("head_again") > B.HEAD_FROM))
    head = x.where(has("head", R.HAS_PLACEHOLDER) | odd).select("id", F.lit("headline").alias("field"))
    return body.union(head)
