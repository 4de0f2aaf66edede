"""Text expressions over columns: tokens, tags, excerpts, slugs, relevance."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that headlines are compared without (fixed values).
STOPWORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "as",
    "is", "are", "was", "were", "be", "by", "with", "from", "its", "it", "that",
    "this", "after", "over", "amid", "says", "say", "said", "will",
)
#: Event categories and their patterns; the first that matches decides (fixed values).
EVENTS = (
    ("earnings", r"\b(q[1-4]|quarter|quarterly|earnings|profit|revenue|ebitda|results|topline|bottom ?line|margin|guidance|net profit|pat)\b"),
    ("litigation", r"\b(lawsuit|litigation|court|tribunal|nclt|verdict|plea|petition|sued|arbitration|insolvency|bankrupt)\b"),
    ("regulatory", r"\b(sebi|rbi|cci|regulator|regulatory|probe|investigation|penalt|fine|notice|compliance|ruling|approval|licence|license|cbi|enforcement directorate|ed |raid)\b"),
    ("leadership", r"\b(resign\w*|steps? down|stepped down|quit\w*|ousted|sacked|succession|reshuffle)\b|\b(?:ceo|cfo|coo|managing director|chairman|chairperson|board)\b[^.]{0,40}\b(?:appoint|elevat|named|nominat|exits?|replace|takes over|steps? in)\b|\b(?:appoint|elevat|named|nominat)\w*\b[^.]{0,40}\b(?:ceo|cfo|coo|managing director|chairman|chairperson)\b"),
    ("mna", r"\b(acquisi|acquire|merger|merge|stake sale|takeover|divest|buyout|joint venture|open offer)\b"),
    ("capital", r"\b(fpo|ipo|rights issue|qip|fund ?rais|bond|debenture|placement|buyback|dividend|share sale|pledge)\b"),
    ("product", r"\b(launch|unveil|new product|expansion|capacity|plant|facility|contract win|order book|commission)\b"),
    ("macro", r"\b(inflation|gdp|repo rate|crude|rupee|fed |monetary policy|budget|tariff|sector-wide|global markets|nifty|sensex)\b"),
)
#: Headlines that mention many companies without being about one (fixed values).
ROUNDUP = r"(?i)\btop (?:gainers|losers|picks|stocks)\b|\bmarket wrap\b|\bclosing bell\b|\bopening bell\b|\bstocks to watch\b|\bbuzzing stocks\b|\btrade spotlight\b|\bsensex\b.*\bnifty\b|\bmarket live\b|\blive updates\b|\bwhat changed for the market\b|\bstocks in news\b"
#: Corporate suffixes, longest first (fixed values).
SUFFIXES = ("private limited", "pvt ltd", "limited", "ltd", "incorporated", "inc", "corporation", "corp", "company", "co", "llc", "plc")
#: Relevance weights (fixed values).
W_HEADLINE, W_BODY, W_DENSITY, W_EARLY, P_LATE, P_ROUNDUP, P_BODY_ONLY = 0.45, 0.30, 0.12, 0.10, 0.10, 0.40, 0.15


def words(text: Column) -> Column:
    """Lower-case letters and digits, in order, stopwords dropped."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) > 2))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbours; of fewer than two words the words themselves."""
    w = words(text)
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    return F.array_distinct(F.when(F.size(w) >= 2, pairs).otherwise(w))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def similarity(ta: Column, tb: Column, ba: Column, bb: Column) -> Column:
    """0.6 of the tokens' Jaccard similarity and 0.4 of the bigrams'; 0 where either has no token."""
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0).otherwise(0.6 * jaccard(ta, tb) + 0.4 * jaccard(ba, bb))


def event_tag(headline: Column, body: Column) -> Column:
    out = None
    for text in (headline, F.substring(body, 1, 1200)):
        for name, pattern in EVENTS:
            hit = F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def slug(name: Column) -> Column:
    """Lower-case words joined by underscores; 'company' where nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("company"))


def excerpt(text: Column, limit: int = 220) -> Column:
    """White space collapsed, cut at the last word that fits, with an ellipsis."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.regexp_replace(F.substring(t, 1, limit), r"\s+\S*$", "")), F.lit("…")))


def dedupe_key(headline: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(headline, F.lit(""))), "[^a-z0-9 ]+", " "), r"\s+", " ")
    return F.sha1(F.trim(plain))


_SUFFIX = r"(?i)[\s,]+(?:" + "|".join(r"\.?\s+".join(x.split()) for x in SUFFIXES) + r")\.?$"


def stripped_suffix(name: Column) -> Column:
    """The company name without a corporate suffix; null where it has none, or is nothing else."""
    cut = F.rtrim(F.regexp_replace(F.regexp_replace(F.trim(name), _SUFFIX, ""), r",+$", ""))
    return F.when(F.trim(name).rlike(_SUFFIX) & (cut != ""), cut)


def alias_list(names: Column) -> Column:
    """The names to look for, trimmed, the longest first (then in order), each spelling once whatever its case; blanks dropped."""
    placed = F.array_sort(F.transform(names, lambda n, i: F.struct((-F.length(n)).alias("down"), i.alias("i"), F.trim(n).alias("n"))))
    given = F.filter(F.transform(placed, lambda x: x["n"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.aggregate(given, F.array().cast("array<string>"), lambda acc, n: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(n)), acc).otherwise(F.concat(acc, F.array(n))))


@lru_cache(maxsize=100_000)
def alias_pattern(alias: str) -> re.Pattern:
    """A pattern for an alias as whole words in any case: white space runs, plural and possessive forms are allowed."""
    words = r"\s+".join(re.escape(w) for w in alias.split())
    return re.compile(rf"\b{words}(?:['’]s|s['’]|s)?\b", re.IGNORECASE)


HITS = "h int, b int, at int, words int, matched array<string>"


def _alias_hits(headlines: pd.Series, bodies: pd.Series, aliases: pd.Series) -> pd.DataFrame:
    """Matches in headline and body, the place of the first one in the body (null without), the body's words and the aliases met."""
    rows = []
    for headline, body, names in zip(headlines, bodies, aliases, strict=True):
        h, b, at, met = 0, 0, None, []
        low_h, low_b = headline.lower(), body.lower()
        for name in names:
            if len(name) < 3:
                continue
            first = name.split()[0].lower() if name.strip() else ""
            if not first or (first not in low_h and first not in low_b):
                continue  # much cheaper to see than by pattern
            p = alias_pattern(name)
            own_h = len(p.findall(headline))
            places = [m.start() for m in p.finditer(body)]
            if own_h or places:
                h, b = h + own_h, b + len(places)
                if places:
                    at = places[0] if at is None else min(at, places[0])
                if not any(name.lower() in m.lower() for m in met):
                    met.append(name)
        rows.append((h, b, at, len(body.split()), met))
    out = pd.DataFrame(rows, columns=["h", "b", "at", "words", "matched"])
    return out.astype({"h": "int32", "b": "int32", "at": "Int32", "words": "int32"})


def relevance(headline: Column, body: Column, aliases: Column) -> Column:
    """A struct (score, matched, headline_match) of a row for its array of aliases, longest first; aliases of fewer than three
    characters don't count. The score is rounded to four places. Patterns are compiled once an alias and worker."""
    h, b = F.coalesce(headline, F.lit("")), F.coalesce(body, F.lit(""))
    x = F.pandas_udf(_alias_hits, HITS)(h, b, aliases)
    nh, nb, first = x["h"], x["b"], x["at"]
    ratio = first / F.greatest(F.length(b), F.lit(1))
    score = (
        F.when(nh > 0, W_HEADLINE).otherwise(0.0)
        + F.when(nb > 0, W_BODY * (1 - F.exp(-nb / 3)) + F.least(F.lit(W_DENSITY), 0.06 * nb / F.greatest(x["words"] / 100, F.lit(1.0)))).otherwise(0.0)
        + F.when(first.isNull(), 0.0).when(ratio < 0.15, W_EARLY).when(ratio > 0.60, -P_LATE).otherwise(0.0)
        - F.when(h.rlike(ROUNDUP), P_ROUNDUP).otherwise(0.0)
        - F.when((nh == 0) & (nb > 0), P_BODY_ONLY).otherwise(0.0)
    )
    clamped = F.when((nh == 0) & (nb == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return F.struct(F.round(clamped, 4).alias("score"), x["matched"].alias("matched"), (nh > 0).alias("headline_match"))


def chunks(text: Column, size: int = 300) -> Column:
    """The text in pieces of ``size`` words."""
    w = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w), F.lit(size)), lambda i: F.array_join(F.slice(w, i, size), " ")))


def pick_emotions(scores: Column, threshold: float = 0.30, most: int = 2) -> Column:
    """A struct (label, score, secondary) of a map of emotion scores: neutral never counts, ties keep the map's order."""
    entries = F.filter(F.map_entries(scores), lambda e: e["key"] != "neutral")
    placed = F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("down"), i.alias("i"), e["key"].alias("label")))
    ranked = F.filter(F.array_sort(placed), lambda e: -e["down"] >= threshold)
    label = F.when(F.size(ranked) > 0, F.element_at(ranked, 1)["label"]).otherwise("")
    score = F.when(F.size(ranked) > 0, F.round(-F.element_at(ranked, 1)["down"], 4)).otherwise(0.0)
    return F.struct(label.alias("label"), score.alias("score"), F.transform(F.slice(ranked, 2, most), lambda e: e["label"]).alias("secondary"))
