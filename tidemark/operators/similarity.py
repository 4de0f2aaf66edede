"""Headline similarity: near-duplicate marking within a day, and staleness against earlier items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.session import written

THRESHOLD, LOOKBACK = 0.72, 10


def prepared(news: DataFrame) -> DataFrame:
    return news.withColumns({"tokens": T.tokens(F.col("headline")), "bigrams": T.bigrams(F.col("headline"))})


def deduplicated(news: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(symbol, seq, survivor): within a symbol's day, items are taken by body length, longest first, then by seq; each joins the first
    survivor that is similar enough, else it survives. Undated items of a symbol share a day. ``survivor`` is null for survivors.

    Items of equal words are decided by their first one. Pairs that may be similar share one of their rarer tokens; on the graph of
    similar pairs an item is decided once all earlier neighbours are, round by round, so no task holds a symbol's day."""
    x = prepared(news.where("symbol is not null"))
    x = x.select("symbol", F.coalesce(F.col("published_local_date").cast("string"), F.lit("")).alias("day"), "seq", F.struct((-F.coalesce(F.length("body"), F.lit(0))).alias("down"), "seq").alias("place"), F.array_sort("tokens").alias("tokens"), F.array_sort("bigrams").alias("bigrams"))
    x = written(x, "headlines")
    keys = ["symbol", "day", "tokens", "bigrams"]
    worded = x.where(F.size("tokens") > 0)  # an item without a token is like none
    reps = written(worded.groupBy(*keys).agg(F.min("place").alias("place")), "wordings").withColumn("id", F.col("place.seq"))
    # similarity t needs a token similarity of (t - 0.4) / 0.6 =: j, so of the n tokens, taken by rarity, one of the first n - ceil(j n) + 1 is shared
    least = max(0.0, (threshold - 0.4) / 0.6)
    each = reps.select("symbol", "day", "id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rarity = each.groupBy("token").agg(F.count("*").alias("df"))
    ranked = each.join(rarity, "token").groupBy("symbol", "day", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_rarity"))
    posts = ranked.select("symbol", "day", "id", F.explode(F.slice("by_rarity", F.lit(1), F.col("n") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1)).alias("p")).select("symbol", "day", "id", "p.token")
    posts = written(posts, "posts")
    met = posts.withColumnRenamed("id", "a").join(posts.withColumnRenamed("id", "b"), ["symbol", "day", "token"]).where("a <> b").select("a", "b").distinct()
    side = lambda n: reps.select(F.col("id").alias(n), F.col("place").alias(f"{n}_place"), F.col("tokens").alias(f"{n}_t"), F.col("bigrams").alias(f"{n}_b"))
    near = met.join(side("a"), "a").join(side("b"), "b").where("a_place < b_place").where(T.similarity(F.col("a_t"), F.col("b_t"), F.col("a_b"), F.col("b_b")) >= threshold)
    edges = written(near.select("a", "a_place", "b"), "similar")
    # an item with an earlier survivor beside it joins the first of those once no undecided item lies before that one
    later = edges.select(F.col("b").alias("id")).distinct()
    decided = written(reps.select("id").join(later, "id", "left_anti").withColumn("survivor", F.lit(None).cast("bigint")), "decided")
    while True:
        told = edges.join(decided.select(F.col("id").alias("a"), F.lit(True).alias("known"), F.col("survivor").isNull().alias("survives")), "a", "left")
        state = told.join(decided.select(F.col("id").alias("b")), "b", "left_anti").groupBy("b").agg(
            F.min(F.when(F.col("survives"), F.struct("a_place", "a"))).alias("first"), F.min(F.when(F.col("known").isNull(), F.col("a_place"))).alias("open"))
        ready = state.where("open is null or first.a_place < open").select(F.col("b").alias("id"), F.col("first.a").alias("survivor"))
        ready = written(ready, "ready")
        if not ready.limit(1).count():
            break
        decided = written(decided.unionByName(ready), "decided")
    # the others of a wording join its survivor, or the wording's first item where that survives
    own = worded.join(reps.select(*keys, "id"), keys).join(decided, "id").select("symbol", "seq", F.when(F.col("seq") != F.col("id"), F.coalesce("survivor", "id")).otherwise(F.col("survivor")).alias("survivor"))
    return own.unionByName(x.where(F.size("tokens") == 0).select("symbol", "seq", F.lit(None).cast("bigint").alias("survivor")))


def against_previous(items: DataFrame, size: int = 100_000) -> DataFrame:
    """(symbol, seq, similarity) of each headline with the one collected before it by its symbol; a symbol's first has none. Windows hold
    a run of ``size`` seq; the last of an earlier run is carried over."""
    x = items.withColumn("run", F.floor(F.col("seq") / size))
    w = Window.partitionBy("symbol", "run").orderBy("seq")
    own = F.struct("tokens", "bigrams")
    last = x.groupBy("symbol", "run").agg(F.max_by(own, "seq").alias("last"))
    carried = last.withColumn("carried", F.lag("last").over(Window.partitionBy("symbol").orderBy("run"))).select("symbol", "run", "carried")  # one row a run
    x = x.withColumn("p", F.lag(own).over(w)).join(carried, ["symbol", "run"]).withColumn("p", F.coalesce("p", "carried")).where("p is not null")
    return x.select("symbol", "seq", T.similarity(F.col("tokens"), F.col("p.tokens"), F.col("bigrams"), F.col("p.bigrams")).alias("similarity"))


#: Rows of a symbol that one window holds at most, up to a day's.
CHUNK = 5_000


def _chunks(dated: DataFrame, lookback: int, size: int) -> DataFrame:
    """(symbol, day, chunk, own): which chunks each day's rows go to. A chunk is a run of days of about ``size`` rows; it also gets
    the days before it that hold its first rows' ``lookback`` predecessors. Only distinct days are sorted here."""
    days = dated.groupBy("symbol", "day").agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol").orderBy("day")
    days = days.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("chunk", F.floor(F.col("before") / size))
    first = days.groupBy("symbol", "chunk").agg(F.min("before").alias("chunk_before"))
    own = days.select("symbol", "day", "chunk", F.lit(True).alias("own"))
    # a day is carried into the next chunks while its last row is among the ``lookback`` before them
    carried = days.select("symbol", "day", "chunk", "before", "n").join(first.withColumnRenamed("chunk", "later"), "symbol")
    carried = carried.where((F.col("later") > F.col("chunk")) & (F.col("before") + F.col("n") > F.col("chunk_before") - lookback))
    return own.unionByName(carried.select("symbol", "day", F.col("later").alias("chunk"), F.lit(False).alias("own")))


def staleness(news: DataFrame, lookback: int = LOOKBACK, size: int = CHUNK) -> DataFrame:
    """(symbol, seq, staleness): the mean similarity of each dated item that is no duplicate to the ``lookback`` ones before it.

    A symbol's items are windowed in chunks of days, so a symbol with most of the rows is many tasks."""
    x = prepared(news.where("symbol is not null and published_at is not null and duplicate_of is null")).select("symbol", "seq", "published_at", F.to_date("published_at").alias("day"), "tokens", "bigrams")
    x = x.join(_chunks(x.select("symbol", "day"), lookback, size), ["symbol", "day"])
    w = Window.partitionBy("symbol", "chunk").orderBy("published_at", "seq").rowsBetween(-lookback, -1)
    x = x.withColumn("before", F.collect_list(F.struct("tokens", "bigrams")).over(w)).where("own")
    each = F.transform("before", lambda p: T.similarity(F.col("tokens"), p["tokens"], F.col("bigrams"), p["bigrams"]))
    mean = F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v) / F.size("before")
    return x.select("symbol", "seq", F.when(F.size("before") > 0, mean).alias("staleness"))
