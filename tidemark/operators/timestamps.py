"""Mixed timestamp texts to one instant: an ordered cascade of anchored patterns.

Each text is trimmed, its spaces are made plain and a leading label ("Published:", "Posted on") is cut. The patterns are then
tried in order; each is anchored at both ends, and the first that matches decides. A match whose parts are no calendar date or
time of day gives nothing; later patterns are not tried for it.

Zone: an offset or UTC/GMT in the text; else a zone abbreviation, taken as one of the source's home zone; else the home zone.
Ambiguous local times are the first of the two unless the abbreviation says which; nonexistent ones move on by the gap.

Defined results: null, empty, relative ("yesterday"), placeholder and impossible texts give no row; a text without zone from a
source that the lookup lacks (or with a null zone) gives no row; digits past microseconds are dropped; all-digit dates with
slashes follow the source's order, with dots they are day first; a two-digit year is 20xx.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names in English and German by their first letters.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}

_MON = r"(jan(?:uary|uar)?|feb(?:ruary|ruar)?|mar(?:ch)?|märz?|apr(?:il)?|may|mai|june?|juni|july?|juli|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|okt(?:ober)?|nov(?:ember)?|dec(?:ember)?|dez(?:ember)?)\.?"
_DAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+)?"
_HMS = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_OFF = r"(z|[+-]\d{2}(?::?\d{2})?|(?:utc|gmt)(?:[+-]\d{1,2}(?::?\d{2})?)?|[a-z]{2,5})"

#: (anchored pattern on the lower-cased text, the part that each group holds). Order matters.
CASCADE: list[tuple[str, tuple[str, ...]]] = [
    (r"^(\d{4})-(\d{2})-(\d{2})[t ]" + _HMS + r"\s*" + _OFF + r"?(?:\[[a-z_/+-]+\])?$", ("y", "m", "d", "h", "i", "s", "f", "o")),
    (r"^(\d{4})-(\d{2})-(\d{2})$", ("y", "m", "d")),
    (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})()" + _OFF + r"?$", ("y", "m", "d", "h", "i", "s", "f", "o")),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", ("y", "m", "d", "h", "i", "s")),
    (r"^(\d{4})(\d{2})(\d{2})$", ("y", "m", "d")),
    (r"^" + _DAY + r"(\d{1,2})[ -]" + _MON + r"[ -](\d{4}|\d{2})(?:,?\s+(?:at\s+)?" + _HMS + r"(?:\s*([ap])\.?m\.?)?(?:\s+uhr)?\s*" + _OFF + r"?)?$", ("d", "b", "y", "h", "i", "s", "f", "p", "o")),
    (r"^" + _DAY + r"(\d{1,2})\.\s*" + _MON + r"\s+(\d{4})(?:,?\s+(?:um\s+)?" + _HMS + r"(?:\s+uhr)?\s*" + _OFF + r"?)?$", ("d", "b", "y", "h", "i", "s", "f", "o")),
    (r"^" + _DAY + _MON + r"\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+(?:at\s+)?(\d{1,2})[:.](\d{2})(?::(\d{2}))?(?:\s*([ap])\.?m\.?)?\s*" + _OFF + r"?)?$", ("b", "d", "y", "h", "i", "s", "p", "o")),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+(\d{1,2})[:.](\d{2})(?::(\d{2}))?(?:\s*([ap])\.?m\.?)?\s*" + _OFF + r"?)?$", ("1", "2", "y", "h", "i", "s", "p", "o")),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,?\s+" + _HMS + r"(?:\s+uhr)?\s*" + _OFF + r"?)?$", ("d", "m", "y", "h", "i", "s", "f", "o")),
]

#: Digits of an epoch number and what one unit is in microseconds (a negative one divides).
EPOCHS = {10: 1_000_000, 13: 1_000, 16: 1, 19: -1_000}

_LABEL = r"^(?:first\s+published|last\s+updated|published|updated|posted)(?:\s+(?:on|at))?\s*(?::|-|–)?\s*"


def zone_abbreviations(zones: list[str], years: tuple[int, int] = (2000, 2036)) -> list[tuple[str, str, int]]:
    """(zone, lower-cased abbreviation, offset in minutes) for every abbreviation that the zone used in the years, from the
    system's zone table. The latest use wins; "et" and the like (no such abbreviation) are absent and mean the zone itself."""
    out: dict[tuple[str, str], int] = {}
    for name in zones:
        try:
            zone = ZoneInfo(name)
        except Exception:  # an unknown zone has no abbreviations; its texts without offset give no row
            continue
        at = datetime(years[0], 1, 1)
        while at.year < years[1]:
            local = at.replace(tzinfo=zone)
            if local.tzname() and local.tzname().isalpha():
                out[name, local.tzname().lower()] = int(local.utcoffset().total_seconds() // 60)
            at += timedelta(days=28)
    return [(z, a, m) for (z, a), m in sorted(out.items())]


def _parts(text: Column) -> Column:
    """The cascade: a struct of string parts, null when no pattern matches."""
    def of(pattern: str, names: tuple[str, ...]) -> Column:
        groups = {n: F.regexp_extract(text, pattern, k + 1) for k, n in enumerate(names)}
        return F.struct(*[groups.get(n, F.lit("")).alias(f"_{n}") for n in ("y", "m", "b", "d", "1", "2", "h", "i", "s", "f", "p", "o")])

    rules = [F.when(text.rlike(pattern), of(pattern, names)) for pattern, names in CASCADE]
    return F.coalesce(*rules)


def _number(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def normalize(df: DataFrame, outlets: DataFrame, text: str = "published_at", source: str = "source", zone: str = "home_zone", order: str = "date_order") -> DataFrame:
    """Add ``instant_us`` (bigint) and ``confidence`` ('exact' or 'date-only'); rows whose text gives neither are dropped.

    ``outlets`` is the lookup of a source's zone and date order, one row per source; it is joined by the planner's choice.
    Columns of ``df`` keep their names, whatever they are.
    """
    spark = df.sparkSession
    known = outlets.select(F.col(source).alias("__source"), F.col(zone).alias("__zone"), F.col(order).alias("__order")).dropDuplicates(["__source"])
    exist = spark.createDataFrame([(z,) for z in sorted(available_timezones())], "__zone string")  # the system's zones, some hundreds
    good = [r[0] for r in known.select("__zone").distinct().join(F.broadcast(exist), "__zone", "left_semi").collect()]
    offsets = spark.createDataFrame(zone_abbreviations(good) or [("", "", 0)], "__abbr_zone string, __abbr string, __abbr_min int")
    plain = F.lower(F.trim(F.regexp_replace(F.col(f"`{text}`"), r"[\s    ]+", " ")))
    x = df.join(known, F.col(f"`{source}`") == F.col("__source"), "left").withColumn("__zone", F.when(F.col("__zone").isin(good or [""]), F.col("__zone")))
    x = x.withColumn("__text", F.regexp_replace(plain, _LABEL, "")).withColumn("__p", _parts(F.col("__text")))
    p = {n: F.col(f"__p._{n}") for n in ("y", "m", "b", "d", "1", "2", "h", "i", "s", "f", "p", "o")}
    mdy = F.upper(F.col("__order")) == "MDY"
    year = F.when(F.length(p["y"]) == 2, F.lit(2000) + _number(p["y"])).otherwise(_number(p["y"]))
    by_name = reduce(lambda e, kv: e.when(F.substring(p["b"], 1, 3) == kv[0], kv[1]), MONTHS.items(), F.when(F.lit(False), 0))
    month = F.coalesce(_number(p["m"]), by_name, F.when(mdy, _number(p["1"])).when(F.upper(F.col("__order")) == "DMY", _number(p["2"])))
    day = F.coalesce(_number(p["d"]), F.when(mdy, _number(p["2"])).when(F.upper(F.col("__order")) == "DMY", _number(p["1"])))
    timed, half = p["h"] != "", p["p"] != ""
    h = _number(p["h"])
    hour = F.when(half, F.when(h.between(1, 12), h % 12 + F.when(p["p"] == "p", 12).otherwise(0))).when(timed, h).otherwise(0)
    minute, second = F.when(timed, _number(p["i"])).otherwise(0), F.coalesce(_number(p["s"]), F.lit(0))
    micros = F.when(p["f"] != "", F.rpad(F.substring(p["f"], 1, 6), 6, "0").cast("long")).otherwise(F.lit(0).cast("long"))
    x = x.withColumns({"__y": year, "__m": month, "__d": day, "__h": hour, "__i": minute, "__s": second, "__f": micros})
    o = p["o"]
    signed = F.regexp_extract(o, r"([+-])(\d{1,2}):?(\d{2})?$", 1)
    minutes = F.regexp_extract(o, r"([+-])(\d{1,2}):?(\d{2})?$", 2).try_cast("int") * 60 + F.coalesce(F.regexp_extract(o, r"([+-])(\d{1,2}):?(\d{2})?$", 3).try_cast("int"), F.lit(0))
    x = x.withColumn("__off", F.when(signed != "", F.when(signed == "-", -minutes).otherwise(minutes)).when(o.isin("z", "utc", "gmt"), 0))
    x = x.withColumn("__o", F.when(F.col("__off").isNull(), o))
    x = x.join(F.broadcast(offsets), (F.col("__zone") == F.col("__abbr_zone")) & (F.col("__o") == F.col("__abbr")), "left")  # at most a few rows a zone
    off = F.coalesce(F.col("__off"), F.col("__abbr_min"))
    ok = F.col("__s") < 60
    at = lambda z: F.unix_micros(F.try_make_timestamp(F.col("__y"), F.col("__m"), F.col("__d"), F.col("__h"), F.col("__i"), F.col("__s").cast("decimal(16,6)"), z))
    calendar = F.when(ok & off.isNotNull() & F.abs(off).between(0, 18 * 60), at(F.lit("UTC")) - off.cast("long") * 60_000_000).when(ok & off.isNull() & F.col("__zone").isNotNull(), at(F.col("__zone"))) + F.col("__f")
    epoch = reduce(
        lambda e, kv: e.when(F.col("__text").rlike(rf"^\d{{{kv[0]}}}$"), F.expr(f"try_cast(__text as bigint) {'*' if kv[1] > 0 else 'div'} {abs(kv[1])}")),
        EPOCHS.items(), F.when(F.lit(False), F.lit(0).cast("long")),
    )
    x = x.withColumn("__us", F.coalesce(epoch, calendar))
    kind = F.when(F.col("__p").isNull() | (F.col("__p._h") != ""), "exact").otherwise("date-only")
    out = x.where(F.col("__us").isNotNull())
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("instant_us", "confidence")], F.col("__us").alias("instant_us"), kind.alias("confidence"))
