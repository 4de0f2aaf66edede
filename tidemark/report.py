"""One company's results as a bundle, a console table and a page with charts. Only one symbol's few hundred rows are collected."""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import market as M
from tidemark.operators import study as S
from tidemark.plans import market as P
from tidemark.session import table


def _rows(df: DataFrame) -> list[dict]:
    return [{k: (v if not isinstance(v, float) or math.isfinite(v) else None) for k, v in r.asDict().items()} for r in df.collect()]


def bundle(spark: SparkSession, sf_dir: str, symbol: str, top: int = 0) -> dict:
    """Incidents with their cumulative return and significance, headlines, daily table, diagnostics and model of one symbol."""
    own = lambda df: df.where(F.col("symbol") == symbol)
    aligned = own(P._aligned(spark, sf_dir))
    models = M.models(aligned, P.START, least=P.LEAST)
    abnormal = M.abnormal(aligned, models)
    news = own(table(spark, sf_dir, "news"))
    daily = S.daily(abnormal, S.coverage(news), P.START)
    flagged = S.flags(daily, M.thresholds(daily, S.RETURN_Z))
    incidents = S.incidents(flagged, top)
    events = incidents.select("symbol", F.col("date").alias("day"))
    cars = M.cumulative(abnormal, events)
    p = M.permutation(abnormal, flagged.where("candidate").select("symbol", F.col("date").alias("day")), cars)
    keys = ["symbol", "date"]
    more = cars.join(p, ["symbol", "day"], "left").withColumnRenamed("day", "date").select(*keys, "car", "days", "truncated", "t_stat", "windows", "p_value")
    cols = ["rank", "date", "score", "ar", "z", "coverage_z", "unique_count", "weighted_sentiment", "dominant_event_category", "dominant_emotion_label", "direction_agrees", "car", "t_stat", "p_value", "truncated"]
    return {
        "symbol": symbol, "model": _rows(models), "incidents": _rows(incidents.join(more, keys, "left").select(*cols).orderBy("rank")),
        "headlines": _rows(S.headlines(incidents, news).orderBy("trading_day", "place")), "diagnostics": _rows(S.diagnostics(flagged)),
        "daily": _rows(daily.select("date", "close", "ar", "z", "unique_count", "weighted_sentiment", "coverage_z", "volume_z").orderBy("date")),
    }


def _cell(v: object) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def table_text(rows: list[dict]) -> str:
    """A plain table with aligned columns."""
    if not rows:
        return "no rows"
    lines = [list(rows[0]), *[[_cell(v) for v in r.values()] for r in rows]]
    widths = [max(len(x[k]) for x in lines) for k in range(len(lines[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, widths, strict=True)).rstrip() for line in lines)


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """Round values that span a range."""
    if not high > low:
        return [low]
    raw = (high - low) / max(1, most - 1)
    power = 10 ** math.floor(math.log10(raw))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw)
    return [k * step for k in range(math.ceil(low / step), math.floor(high / step) + 1)]


def line_chart(points: list[float | None], width: int = 640, height: int = 160) -> str:
    """An SVG line through the points that are given, with a few labelled levels."""
    known = [v for v in points if v is not None]
    if len(known) < 2:
        return ""
    low, high = min(known), max(known)
    y = lambda v: height - 12 - (v - low) / ((high - low) or 1) * (height - 24)
    x = lambda i: 48 + i / max(1, len(points) - 1) * (width - 56)
    path = " ".join(f"{'M' if not k else 'L'}{x(i):.1f},{y(v):.1f}" for k, (i, v) in enumerate((i, v) for i, v in enumerate(points) if v is not None))
    grid = "".join(f'<line x1="48" x2="{width - 8}" y1="{y(t):.1f}" y2="{y(t):.1f}" stroke="#ddd"/><text x="44" y="{y(t) + 4:.1f}" font-size="10" text-anchor="end">{t:g}</text>' for t in ticks(low, high))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}" height="{height}" role="img">{grid}<path d="{path}" fill="none" stroke="#246" stroke-width="1.5"/></svg>'


def html(result: dict) -> str:
    """A self-contained page; every text is escaped."""
    def table_of(rows: list[dict]) -> str:
        if not rows:
            return "<p>None.</p>"
        head = "".join(f"<th>{escape(k)}</th>" for k in rows[0])
        body = "".join("<tr>" + "".join(f"<td>{escape(_cell(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
        return f"<table><tr>{head}</tr>{body}</table>"

    level, closes = [], [r["close"] for r in result["daily"]]
    for c in closes:
        level.append(100 * c / closes[0] if closes and closes[0] else None)
    parts = [f"<h1>{escape(result['symbol'])}</h1><p>Days on which coverage and the adjusted return were both unusual. Coincidence in time says nothing about cause.</p>", "<h2>Level</h2>", line_chart(level)]
    parts += [f"<h2>{name.title()}</h2>{table_of(result[name])}" for name in ("incidents", "headlines", "model", "diagnostics", "daily")]
    return "<!doctype html><meta charset='utf-8'><title>Event study</title><style>body{font:14px sans-serif}td,th{padding:2px 8px;text-align:left}</style>" + "".join(parts)
