"""A share without an exchange: its price revisions, the moves between them, and the news that lies inside each move."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import revisions as V

#: Sizes of a move by its change.
SIZES = ((0.25, "very large"), (0.10, "large"), (0.03, "moderate"))


def move_words(change: Column) -> tuple[Column, Column]:
    """(direction, size) of a move, in words."""
    size = None
    for least, word in SIZES:
        hit = F.abs(change) >= least
        size = F.when(hit, word) if size is None else size.when(hit, word)
    return F.when(change > 0, "rose").when(change < 0, "fell").otherwise("held"), size.otherwise("small")


def told(moves: DataFrame) -> DataFrame:
    """Adds ``direction``, ``size`` and ``pace`` (a move of more than 30 days is slow) to moves."""
    direction, size = move_words(F.col("change"))
    return moves.withColumns({"direction": direction, "size": size, "pace": F.when(F.datediff("end", "start") > 30, "slowly").otherwise("at once")})


def with_news(moves: DataFrame, news: DataFrame, most: int = 5) -> DataFrame:
    """(symbol, start, place, seq, headline): up to ``most`` items by strength inside each move's (start, end]."""
    days = moves.select("symbol", "start", F.explode(F.sequence(F.date_add("start", 1), "end")).alias("day"))
    n = news.where("symbol is not null").select("symbol", "seq", "headline", F.col("published_local_date").alias("day"), "sentiment_score", "relevance_score")
    w = Window.partitionBy("symbol", "start").orderBy(F.abs("sentiment_score").desc_nulls_last(), F.col("relevance_score").desc_nulls_last(), "seq")
    return n.join(days, ["symbol", "day"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("symbol", "start", "place", "seq", "headline")


def bundle(spark: SparkSession, frame: DataFrame, news: DataFrame, symbol: str, start: str, end: str) -> dict:
    """Revisions, overlapping moves by size and their news of one symbol: some hundreds of rows."""
    own = frame.where(F.col("symbol") == symbol)
    revised = V.revisions(own)
    moves = told(V.moves(revised)).where(F.col("end") >= F.lit(start).cast("date")).where(F.col("start") <= F.lit(end).cast("date"))
    items = with_news(moves, news.where(F.col("symbol") == symbol))
    rows = lambda df: [r.asDict() for r in df.collect()]
    headlines: dict = {}
    for r in rows(items.orderBy("start", "place")):
        headlines.setdefault(str(r["start"]), []).append(r["headline"] or "")
    found = rows(moves.orderBy(F.desc(F.abs("change")), "start"))
    return {"symbol": symbol, "start": start, "end": end, "revisions": revised.count(), "days": own.count(), "moves": [m | {"headlines": headlines.get(str(m["start"]), [])} for m in found]}


def narrative(result: dict) -> list[str]:
    """Sentences on what the timeline shows; coincidence in time, not cause."""
    out = [f"{result['symbol']} was revised {result['revisions']} times on {result['days']} recorded days."]
    for m in result["moves"][:5]:
        change = "" if m["change"] is None else f" by {abs(m['change']):.1%}"
        beside = f"{len(m['headlines'])} item(s) lie inside it" if m["headlines"] else "no item lies inside it"
        out.append(f"From {m['start']} to {m['end']} it {m['direction']}{change} ({m['size']}, {m['pace']}); {beside}.")
    return out


def html(result: dict) -> str:
    """The timeline as a page: the story, the moves and a flat table of news. All text is escaped."""
    cells = lambda values, tag="td": "<tr>" + "".join(f"<{tag}>{escape(str(v))}</{tag}>" for v in values) + "</tr>"
    moves = "".join(cells((m["start"], m["end"], m["start_close"], m["end_close"], "" if m["change"] is None else f"{m['change']:+.2%}", m["size"])) for m in result["moves"])
    news = "".join(cells((m["start"], h)) for m in result["moves"] for h in m["headlines"])
    story = "".join(f"<p>{escape(s)}</p>" for s in narrative(result))
    return f"<!doctype html><meta charset=utf-8><title>{escape(result['symbol'])}</title><h1>{escape(result['symbol'])}</h1>{story}<table>{cells(('from', 'to', 'before', 'after', 'change', 'size'), 'th')}{moves}</table><table>{cells(('move from', 'headline'), 'th')}{news}</table>"
