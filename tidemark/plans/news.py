"""Queries over news items and candidates: attribution, similarity, tags, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scorers as C_
from tidemark.functions import text as T
from tidemark.operators import asof as A
from tidemark.operators import candidates as C
from tidemark.operators import market as M
from tidemark.operators import similarity as U
from tidemark.operators import study as S
from tidemark.plans.market import _PX
from tidemark.session import table
from tidemark.sources.pages import GATE


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return M.frame(table(spark, d, "prices")).select("symbol", "date")


def _items(spark: SparkSession, d: str) -> DataFrame:
    return A.attributed(table(spark, d, "news").where("symbol is not null"), _sessions(spark, d))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_feed").withColumnRenamed("feed_id", "seq")


def a2_next_session(spark, d):
    days = table(spark, d, "daily_coverage").select("symbol", F.col("day").alias("date"))
    return A.session_map(days, _sessions(spark, d), forward=True, strict=True)


def a3_same_or_next(spark, d):
    days = table(spark, d, "daily_coverage").select("symbol", F.col("day").alias("date"))
    return A.session_map(days, _sessions(spark, d), forward=True)


def a4_attribution(spark, d):
    return _items(spark, d).where("search_day is not null").select("symbol", "seq", "is_late", "session")


def a5_unattributed(spark, d):
    return _items(spark, d).where("session is null").groupBy("symbol").agg(F.count("*").alias("items"))


def a6_latest_session(spark, d):
    days = table(spark, d, "daily_coverage").select("symbol", F.col("day").alias("date"))
    same = A.session_map(days, _sessions(spark, d), forward=False)
    return same.join(A.session_map(days, _sessions(spark, d), forward=False, strict=True).withColumnRenamed("session", "prior"), ["symbol", "date"])


def u2_similarity(spark, d):
    """Each headline against the one collected before it by its symbol."""
    x = U.prepared(table(spark, d, "news").where("symbol is not null")).select("symbol", "seq", "tokens", "bigrams")
    return U.against_previous(x).withColumn("similarity", F.round("similarity", 6))


def u3_deduplicated(spark, d):
    return U.deduplicated(table(spark, d, "news"))


def u4_unique(spark, d):
    return table(spark, d, "news").where("duplicate_of is null").groupBy("source").agg(F.count("*").alias("items"))


def u5_cluster_sizes(spark, d):
    news = table(spark, d, "news").where("symbol is not null")
    return S.cluster_sizes(news).join(news.where("duplicate_of is null").select("symbol", "url"), ["symbol", "url"], "left_semi")


def u6_staleness(spark, d):
    x = U.staleness(table(spark, d, "news"))
    return x.select("symbol", "seq", F.round("staleness", 6).alias("staleness"))


def r2_relevance(spark, d):
    """Relevance to the row's own company: its name and the name without a corporate suffix."""
    q = table(spark, d, "quotes").where("name is not null").select(F.split("symbol", r"[.\-]")[0].alias("symbol"), "name").distinct()
    q = q.groupBy("symbol").agg(F.max("name").alias("name"))
    aliases = F.filter(F.array("name", T.stripped_suffix(F.col("name")), F.col("symbol")), lambda a: a.isNotNull())
    x = table(spark, d, "news").select("symbol", "seq", "headline", "body", "snippet").join(q.select("symbol", aliases.alias("aliases")), "symbol")
    x = x.select("seq", T.relevance(F.col("headline"), F.coalesce(F.nullif("body", F.lit("")), F.col("snippet")), F.col("aliases")).alias("r"))
    return x.select("seq", F.col("r.score").alias("score"), F.array_join("r.matched", "|").alias("matched"), F.col("r.headline_match").alias("headline_match"))


def r3_kept(spark, d):
    x = r2_relevance(spark, d)
    return x.groupBy((F.col("score") >= 0.35).alias("kept")).agg(F.count("*").alias("items"))


def r4_event_tag(spark, d):
    return table(spark, d, "news").select("seq", T.event_tag(F.col("headline"), F.col("body")).alias("tag"))


def r6_chunks(spark, d):
    return table(spark, d, "news").where("body is not null").select("seq", F.size(T.chunks(F.col("body"), 30)).alias("chunks"), F.try_element_at(T.chunks(F.col("headline"), 3), F.lit(1)).alias("first"))


def r5_tone(spark, d):
    """Tone and confidence of every headline, by the stand-in for a model."""
    x = table(spark, d, "news").select("seq", C_.tone(F.col("headline"), C_.WordTone()).alias("t"))
    return x.select("seq", F.round("t.score", 6).alias("score"), F.round("t.confidence", 6).alias("confidence"))


def r7_blend(spark, d):
    """Tone of headline (0.6) and body chunks (0.4, weighted by confidence), with the stand-in in the model's place."""
    return C_.blended(table(spark, d, "news").select("seq", "headline", F.coalesce("body", "snippet").alias("body")), C_.WordTone())


def r8_moods(spark, d):
    """The emotions of every headline, by the stand-in for a model, and the pick over them."""
    x = table(spark, d, "news").select("seq", T.pick_emotions(F.coalesce(C_.emotions(F.col("headline"), C_.WordMoods()), F.create_map().cast("map<string,double>"))).alias("e"))
    return x.select("seq", F.col("e.label").alias("label"), F.col("e.score").alias("score"), F.array_join("e.secondary", ",").alias("secondary"))


def r9_emotions(spark, d):
    """The pick over a map made of a row's own emotion and a fixed mood score."""
    scores = F.map_from_arrays(F.array(F.lit("neutral"), F.lit("approval_"), F.coalesce(F.nullif("emotion_label", F.lit("")), F.lit("none"))), F.array(F.lit(0.9), F.abs("sentiment_score"), F.coalesce("emotion_score", F.lit(0.0))))
    x = table(spark, d, "news").where("sentiment_score is not null").select("seq", T.pick_emotions(scores).alias("e"))
    return x.select("seq", F.col("e.label").alias("label"), F.col("e.score").alias("score"), F.array_join("e.secondary", ",").alias("secondary"))


def r10_valence(spark, d):
    return table(spark, d, "news").groupBy(S.valence(F.coalesce("emotion_label", F.lit(""))).alias("valence")).agg(F.count("*").alias("items"))


def r11_excerpt(spark, d):
    return table(spark, d, "news").where("snippet is not null").select("seq", T.excerpt(F.col("snippet"), 80).alias("excerpt"))


def r12_slug(spark, d):
    return table(spark, d, "quotes").where("name is not null").select("symbol", T.slug(F.col("name")).alias("slug"))


def c1_aliases(spark, d):
    return table(spark, d, "quotes").where("name is not null").select("symbol", T.stripped_suffix(F.col("name")).alias("alias"))


def c2_slug_tokens(spark, d):
    return table(spark, d, "quotes").where("name is not null").select("symbol", F.array_join(F.array_sort(C.slug_tokens(F.col("name"))), " ").alias("tokens"))


def _grouped(spark, d):
    q = table(spark, d, "quotes").where("name is not null").select(F.split("symbol", r"[.\-]")[0].alias("symbol"), C.slug_tokens(F.col("name")).alias("g")).groupBy("symbol").agg(F.collect_set("g").alias("groups"))
    return _feed(spark, d).join(q, "symbol")


def c3_prefilter(spark, d):
    return C.prefilter(_grouped(spark, d), "groups", 50).select("seq", "source")


def c4_interleaved(spark, d):
    return C.interleaved(_feed(spark, d).select("seq", "source")).select("seq", "source", "place")


def c5_capped(spark, d):
    return C.capped(C.interleaved(_feed(spark, d).select("seq", "source")), 100).select("seq", "place")


def c7_window(spark, d):
    day = F.to_date(A.local(F.col("published_at")))
    return table(spark, d, "news").where(F.col("published_at").isNull() | day.between("2024-02-01", "2024-02-15")).select("seq")


def c9_funnel(spark, d):
    """Counts of every stage by source."""
    x = table(spark, d, "news")
    return x.groupBy("source").agg(
        F.count("*").alias("collected"), F.count("published_at").alias("dated"), F.count_if(F.coalesce(F.col("relevance_score") >= 0.35, F.lit(False))).alias("relevant"),
        F.count_if(F.col("duplicate_of").isNull()).alias("unique"), F.count("trading_day").alias("attributed"), F.count_if(F.coalesce("after_close", F.lit(False))).alias("after_close"), F.count_if(F.coalesce("paywalled", F.lit(False))).alias("paywalled"),
    )


def d_dedupe_key(spark, d):
    """Items that share a normalised headline."""
    return table(spark, d, "news").where("headline is not null").groupBy(T.dedupe_key(F.col("headline")).alias("key")).agg(F.count("*").alias("items"), F.min("seq").alias("first_seq"))


def x2_timestamp(spark, d):
    """The strict reading of persisted timestamps: an instant, local where it names no offset; a bare or leading date is that day's
    local midnight; anything else is missing."""
    raw = F.regexp_replace(F.trim("published_at"), r"(\.\d{6})\d+", "$1")
    iso = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(Z|[+-]\d{2}:\d{2})?$"
    part = lambda k: F.regexp_extract(raw, iso, k)
    full = F.try_to_timestamp(F.when(raw.rlike(iso), F.concat(part(1), F.lit(" "), F.when(F.length(part(2)) == 5, F.concat(part(2), F.lit(":00"))).otherwise(part(2)), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("+05:30")))))
    day = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.concat(F.substring(raw, 1, 10), F.lit(" 00:00:00+05:30"))))
    bare = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    value = F.when(bare, day).otherwise(F.coalesce(full, day))
    kind = F.when(value.isNull(), "missing").when(~bare & full.isNotNull(), "exact").otherwise("date-only")
    return table(spark, d, "news_feed").select("feed_id", F.unix_micros(value).alias("instant_us"), F.coalesce(kind, F.lit("missing")).alias("confidence"))


def x7_paywalled(spark, d):
    """A gate counts only when it cost the text: a marker and a short body."""
    x = table(spark, d, "news").where("body is not null")
    return x.select("seq", (F.lower("body").rlike("|".join(GATE)) & (F.length("body") < 600)).alias("gated"))


QUERIES = {f.__name__: f for f in (
    a2_next_session, a3_same_or_next, a4_attribution, a5_unattributed, a6_latest_session, u2_similarity, u3_deduplicated, u4_unique, u5_cluster_sizes, u6_staleness,
    r2_relevance, r3_kept, r4_event_tag, r5_tone, r6_chunks, r7_blend, r8_moods, r9_emotions, r10_valence, r11_excerpt, r12_slug, c1_aliases, c2_slug_tokens, c3_prefilter, c4_interleaved, c5_capped, c7_window, c9_funnel, d_dedupe_key, x2_timestamp, x7_paywalled,
)}

_SES = f"WITH {_PX}, ses AS (SELECT symbol, date FROM px), dc AS (SELECT DISTINCT symbol, day AS date FROM daily_coverage WHERE symbol IS NOT NULL AND day IS NOT NULL)"
_IT = f"""WITH {_PX}, ses AS (SELECT symbol, date FROM px), it0 AS (SELECT symbol, seq, (published_at AT TIME ZONE 'UTC') + INTERVAL 330 MINUTE AS ts, coalesce(lower(timestamp_confidence), '') AS conf FROM news WHERE symbol IS NOT NULL),
    it1 AS (SELECT *, coalesce(conf <> 'date-only' AND ts::TIME >= TIME '15:30:00', FALSE) AS is_late FROM it0),
    it2 AS (SELECT *, ts::DATE + is_late::INT AS search_day FROM it1),
    it AS (SELECT symbol, seq, is_late, search_day, (SELECT min(date) FROM ses WHERE ses.symbol = it2.symbol AND ses.date >= it2.search_day) AS session FROM it2)"""
_STOP = ", ".join(repr(w) for w in T.STOPWORDS)
_W = f"list_filter(regexp_extract_all(lower(coalesce(headline, '')), '[a-z0-9]+'), lambda w: w NOT IN ({_STOP}))"
_HEAD = f"""h0 AS (SELECT symbol, seq, published_at, duplicate_of, {_W} AS w FROM news WHERE symbol IS NOT NULL),
    h AS (SELECT symbol, seq, published_at, duplicate_of, list_distinct(list_filter(w, lambda x: length(x) > 2)) AS t, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS b FROM h0)"""


def _sim(t0: str, b0: str) -> str:
    j = "coalesce(len(list_intersect({x}, {y}))::DOUBLE / nullif(len({x}) + len({y}) - len(list_intersect({x}, {y})), 0), 0)"
    return f"CASE WHEN len(t) = 0 OR len({t0}) = 0 THEN 0 ELSE 0.6*{j.format(x='t', y=t0)} + 0.4*{j.format(x='b', y=b0)} END"


_TAGS = "CASE " + " ".join(f"WHEN regexp_matches(coalesce({c}, ''), '(?i){p}') THEN '{n}'" for c in ("headline", "substr(body, 1, 1200)") for n, p in T.EVENTS) + " ELSE 'other' END"
_VAL = "CASE " + " ".join(f"WHEN emotion_label IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in S.VALENCE.items()) + " ELSE '' END"
_SUF = "CASE " + " ".join(
    "WHEN regexp_matches(trim(name), '{p}') AND rtrim(regexp_replace(regexp_replace(trim(name), '{p}', ''), ',+$', '')) <> '' THEN rtrim(regexp_replace(regexp_replace(trim(name), '{p}', ''), ',+$', ''))".format(p=r"(?i)[\s,]+" + r"\.?\s+".join(s.split()) + r"\.?$")
    for s in T.SUFFIXES
) + " END"
_TOK = f"list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(repr(w) for w in C.COMMON_WORDS)})))"
_ORD = "WITH r AS (SELECT feed_id AS seq, source, row_number() OVER (PARTITION BY source ORDER BY feed_id) AS rn, min(feed_id) OVER (PARTITION BY source) AS f FROM news_feed), p AS (SELECT seq, source, row_number() OVER (ORDER BY rn, f) AS place FROM r)"

_COUNT = r"len(regexp_extract_all(lower({t}), '\b({w})\b'))"
_G, _B = (lambda t, w=w: _COUNT.format(t=t, w="|".join(w)) for w in (C_.GOOD, C_.BAD))
_TONE = "CASE WHEN trim(coalesce({t}, ''), E' \\n\\t\\r') <> '' THEN {x} END"


def _tone_sql(t: str) -> tuple[str, str]:
    g, b = _G(t), _B(t)
    return _TONE.format(t=t, x=f"({g} - {b})/({g} + {b} + 1.0)"), _TONE.format(t=t, x=f"greatest({g}, {b}, 1)/({g} + {b} + 1.0)")


_ALIASES = rf"""q AS (SELECT string_split_regex(symbol, '[.-]')[1] AS symbol, max(name) AS name FROM quotes WHERE name IS NOT NULL GROUP BY 1),
    al AS (SELECT symbol, unnest([name, {_SUF}, symbol]) AS alias, unnest([1, 2, 3]) AS k FROM q),
    ap AS (SELECT symbol, alias, k, '(?i)\b' || regexp_replace(regexp_replace(alias, '([\\.^$|?*+()\[\]{{}}&-])', '\\\1', 'g'), '\s+', '\\s+', 'g') || '(?:[''’]s|s[''’]|s)?\b' AS p FROM al WHERE alias IS NOT NULL AND length(alias) >= 3)"""
_REL = rf"""WITH {_ALIASES},
    n AS (SELECT symbol, seq, coalesce(headline, '') AS h, coalesce(nullif(body, ''), snippet, '') AS b FROM news WHERE symbol IN (SELECT symbol FROM q)),
    m AS (SELECT n.seq, alias, k, len(regexp_extract_all(h, p)) AS nh, len(regexp_extract_all(b, p)) AS nb, CASE WHEN regexp_matches(b, p) THEN length(string_split_regex(b, p)[1]) END AS pos FROM n JOIN ap USING (symbol)),
    g AS (SELECT seq, sum(nh) AS nh, sum(nb) AS nb, min(pos) AS pos, list(alias ORDER BY k) FILTER (nh + nb > 0) AS l FROM m GROUP BY seq),
    s AS (SELECT n.seq, coalesce(nh, 0) AS nh, coalesce(nb, 0) AS nb, coalesce(array_to_string(list_filter(l, lambda a, i: len(list_filter(l[1:i - 1], lambda e: contains(lower(e), lower(a)))) = 0), '|'), '') AS matched,
        CASE WHEN nh > 0 THEN 0.45 ELSE 0 END + CASE WHEN nb > 0 THEN 0.30*(1 - exp(-nb/3.0)) + least(0.12, 0.06*nb/greatest(len(list_filter(string_split_regex(trim(b), '\s+'), lambda w: w <> ''))/100.0, 1)) ELSE 0 END
        + CASE WHEN pos IS NULL THEN 0 WHEN pos/greatest(length(b), 1)::DOUBLE < 0.15 THEN 0.10 WHEN pos/greatest(length(b), 1)::DOUBLE > 0.60 THEN -0.10 ELSE 0 END
        - CASE WHEN regexp_matches(h, '{T.ROUNDUP}') THEN 0.40 ELSE 0 END - CASE WHEN nh = 0 AND nb > 0 THEN 0.15 ELSE 0 END AS raw FROM n LEFT JOIN g USING (seq)),
    rel AS (SELECT seq, round(CASE WHEN nh + nb = 0 THEN 0 ELSE greatest(0, least(1, raw)) END, 4)::DOUBLE AS score, matched, nh > 0 AS headline_match FROM s)"""
_RD = r"""r AS (SELECT feed_id, regexp_replace(trim(published_at), '(\.\d{6})\d+', '\1') AS t FROM news_feed),
    i AS (SELECT *, regexp_extract(t, '^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$', ['d', 'm', 's', 'z']) AS x, regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') AS bare FROM r),
    j AS (SELECT feed_id, bare, epoch_us(TRY_CAST(x.d || ' ' || x.m || CASE WHEN x.s = '' THEN ':00' ELSE x.s END AS TIMESTAMP)) - CASE WHEN x.z IN ('Z', '') THEN 0 ELSE (x.z[1] || '1')::INT*(x.z[2:3]::INT*60 + x.z[5:6]::INT)::BIGINT*60000000 END - CASE WHEN x.z = '' THEN 19800000000 ELSE 0 END AS full_us,
        CASE WHEN regexp_matches(t, '^\d{4}-\d{2}-\d{2}') THEN epoch_us(TRY_CAST(t[1:10] AS DATE)::TIMESTAMP) - 19800000000 END AS day_us FROM i)"""
_GREEDY = f"""WITH RECURSIVE {_HEAD.replace("SELECT symbol, seq, published_at, duplicate_of,", "SELECT symbol, seq, coalesce(published_local_date::VARCHAR, '') AS day, coalesce(length(body), 0) AS size,").replace("SELECT symbol, seq, published_at, duplicate_of, list_distinct", "SELECT symbol, seq, list_distinct").replace("h AS (SELECT symbol, seq, coalesce(published_local_date::VARCHAR, '') AS day, coalesce(length(body), 0) AS size, list_distinct", "h AS (SELECT symbol, seq, day, size, list_distinct")},
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY size DESC, seq) AS rn FROM h),
    g AS (SELECT symbol, day, 1::BIGINT AS rn, seq, NULL::BIGINT AS survivor, [{{'s': seq, 't': t, 'b': b}}] AS kept FROM k WHERE rn = 1
        UNION ALL SELECT symbol, day, rn, seq, f, CASE WHEN f IS NULL THEN list_append(kept, {{'s': seq, 't': t, 'b': b}}) ELSE kept END FROM (
            SELECT k.symbol, k.day, k.rn, k.seq, k.t, k.b, g.kept, list_filter(g.kept, lambda o: {_sim('o.t', 'o.b').replace('len(t)', 'len(k.t)').replace('(t,', '(k.t,').replace('(b,', '(k.b,').replace('len(b)', 'len(k.b)')} >= 0.72)[1].s AS f FROM g JOIN k ON k.symbol = g.symbol AND k.day = g.day AND k.rn = g.rn + 1) z)"""
_MOODS = {m: f"1 - 0.6 ** {_COUNT.format(t='headline', w='|'.join(w))}" for m, w in C_.MOODS.items()}

ORACLES = {
    "a2_next_session": f"{_SES} SELECT symbol, date, (SELECT min(date) FROM ses WHERE ses.symbol = dc.symbol AND ses.date > dc.date) AS session FROM dc",
    "a3_same_or_next": f"{_SES} SELECT symbol, date, (SELECT min(date) FROM ses WHERE ses.symbol = dc.symbol AND ses.date >= dc.date) AS session FROM dc",
    "a4_attribution": f"{_IT} SELECT symbol, seq, is_late, session FROM it WHERE search_day IS NOT NULL",
    "a5_unattributed": f"{_IT} SELECT symbol, count(*) AS items FROM it WHERE session IS NULL GROUP BY symbol",
    "a6_latest_session": f"{_SES} SELECT symbol, date, (SELECT max(date) FROM ses WHERE ses.symbol = dc.symbol AND ses.date <= dc.date) AS session, (SELECT max(date) FROM ses WHERE ses.symbol = dc.symbol AND ses.date < dc.date) AS prior FROM dc",
    "u2_similarity": f"WITH {_HEAD}, p AS (SELECT *, lag(t) OVER w AS t0, lag(b) OVER w AS b0 FROM h WINDOW w AS (PARTITION BY symbol ORDER BY seq)) SELECT symbol, seq, round({_sim('t0', 'b0')}, 6) AS similarity FROM p WHERE t0 IS NOT NULL",
    "u4_unique": "SELECT source, count(*) AS items FROM news WHERE duplicate_of IS NULL GROUP BY source",
    "u5_cluster_sizes": "WITH c AS (SELECT symbol, coalesce(duplicate_of, url) AS url, count(*) AS carriers FROM news WHERE symbol IS NOT NULL GROUP BY ALL) SELECT * FROM c WHERE (symbol, url) IN (SELECT (symbol, url) FROM news WHERE symbol IS NOT NULL AND duplicate_of IS NULL)",
    "u6_staleness": f"WITH {_HEAD}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at, seq) AS rn FROM h WHERE published_at IS NOT NULL AND duplicate_of IS NULL), p AS (SELECT k.symbol, k.seq, k.t, k.b, o.t AS t0, o.b AS b0 FROM k LEFT JOIN k o ON o.symbol = k.symbol AND o.rn BETWEEN k.rn - 10 AND k.rn - 1) SELECT symbol, seq, round(avg(CASE WHEN t0 IS NOT NULL THEN {_sim('t0', 'b0')} END), 6) AS staleness FROM p GROUP BY symbol, seq",
    "r4_event_tag": f"SELECT seq, {_TAGS} AS tag FROM news",
    "r6_chunks": r"SELECT seq, ceil(len(list_filter(string_split_regex(trim(body, E' \n\t\r'), '\s+'), lambda w: w <> ''))/30.0)::INT AS chunks, nullif(array_to_string((list_filter(string_split_regex(trim(coalesce(headline, '')), '\s+'), lambda w: w <> ''))[1:3], ' '), '') AS first FROM news WHERE body IS NOT NULL",
    "r10_valence": f"SELECT {_VAL} AS valence, count(*) AS items FROM news GROUP BY 1",
    "r11_excerpt": r"WITH s AS (SELECT seq, trim(regexp_replace(snippet, '\s+', ' ', 'g')) AS t FROM news WHERE snippet IS NOT NULL) SELECT seq, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(regexp_replace(substr(t, 1, 80), '\s+\S*$', '')) || '…' END AS excerpt FROM s",
    "r12_slug": "SELECT symbol, coalesce(nullif(trim(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'company') AS slug FROM quotes WHERE name IS NOT NULL",
    "c1_aliases": f"SELECT symbol, {_SUF} AS alias FROM quotes WHERE name IS NOT NULL",
    "c2_slug_tokens": f"SELECT symbol, array_to_string(list_sort({_TOK}), ' ') AS tokens FROM quotes WHERE name IS NOT NULL",
    "c3_prefilter": f"WITH g AS (SELECT DISTINCT string_split_regex(symbol, '[.-]')[1] AS symbol, {_TOK} AS g FROM quotes WHERE name IS NOT NULL), f AS (SELECT feed_id AS seq, source, symbol, lower(url) AS url FROM news_feed WHERE symbol IN (SELECT symbol FROM g)), n AS (SELECT source, count(*) AS n FROM f GROUP BY source) SELECT seq, source FROM f JOIN n USING (source) WHERE n <= 50 OR EXISTS (SELECT 1 FROM g WHERE g.symbol = f.symbol AND len(g.g) > 0 AND len(list_filter(g.g, lambda t: contains(f.url, t))) >= least(2, len(g.g)))",
    "c4_interleaved": f"{_ORD} SELECT seq, source, place FROM p",
    "c5_capped": f"{_ORD} SELECT seq, place FROM p WHERE (SELECT count(*) FROM p) <= 100 OR place - 1 IN (SELECT CAST(floor(i * (SELECT count(*) FROM p)::DOUBLE / 100) AS BIGINT) FROM range(100) t(i))",
    "c7_window": "SELECT seq FROM news WHERE published_at IS NULL OR ((published_at AT TIME ZONE 'UTC') + INTERVAL 330 MINUTE)::DATE BETWEEN DATE '2024-02-01' AND DATE '2024-02-15'",
    "c9_funnel": "SELECT source, count(*) AS collected, count(published_at) AS dated, count(*) FILTER (relevance_score >= 0.35) AS relevant, count(*) FILTER (duplicate_of IS NULL) AS \"unique\", count(trading_day) AS attributed, count(*) FILTER (after_close) AS after_close, count(*) FILTER (paywalled) AS paywalled FROM news GROUP BY source",
    "d_dedupe_key": r"SELECT sha1(trim(regexp_replace(regexp_replace(lower(headline), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))) AS key, count(*) AS items, min(seq) AS first_seq FROM news WHERE headline IS NOT NULL GROUP BY 1",
    "x7_paywalled": f"SELECT seq, ({' OR '.join(f'contains(lower(body), {g!r})' for g in GATE)}) AND length(body) < 600 AS gated FROM news WHERE body IS NOT NULL",
    "r2_relevance": f"{_REL} SELECT * FROM rel",
    "r3_kept": f"{_REL} SELECT score >= 0.35 AS kept, count(*) AS items FROM rel GROUP BY 1",
    "r5_tone": f"SELECT seq, round({_tone_sql('headline')[0]}, 6) AS score, round({_tone_sql('headline')[1]}, 6) AS confidence FROM news",
    "r7_blend": rf"""WITH w AS (SELECT seq, headline, list_filter(string_split_regex(trim(coalesce(body, snippet, ''), E' \n\t\r'), '\s+'), lambda x: x <> '') AS w FROM news), c AS (SELECT seq, unnest(list_transform(range(0, len(w), 300), lambda i: array_to_string(w[i + 1:i + 300], ' '))) AS chunk FROM w),
        k AS (SELECT seq, {_tone_sql('chunk')[0]} AS s, {_tone_sql('chunk')[1]} AS c FROM c), b AS (SELECT seq, sum(s*c)/nullif(sum(c), 0) AS body_score FROM k GROUP BY seq), h AS (SELECT seq, coalesce({_tone_sql('headline')[0]}, 0) AS head FROM w),
        t AS (SELECT h.seq, round(CASE WHEN body_score IS NULL THEN head ELSE 0.6*head + 0.4*body_score END, 4)::DOUBLE AS score FROM h LEFT JOIN b USING (seq)) SELECT seq, score, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM t""",
    "r8_moods": f"""WITH e AS (SELECT seq, unnest([{', '.join(f"'{m}'" for m in _MOODS)}]) AS label, unnest([{', '.join(_MOODS.values())}]) AS p, unnest(range({len(_MOODS)})) AS i FROM news WHERE trim(coalesce(headline, ''), E' \\n\\t\\r') <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY p DESC, i) AS rn FROM e WHERE p >= 0.30)
        SELECT n.seq, coalesce(max(label) FILTER (rn = 1), '') AS label, coalesce(round(max(p) FILTER (rn = 1), 4), 0)::DOUBLE AS score, coalesce(string_agg(label, ',' ORDER BY rn) FILTER (rn IN (2, 3)), '') AS secondary FROM news n LEFT JOIN r USING (seq) GROUP BY n.seq""",
    "r9_emotions": """WITH e AS (SELECT seq, unnest(['approval_', coalesce(nullif(emotion_label, ''), 'none')]) AS label, unnest([abs(sentiment_score), coalesce(emotion_score, 0)]) AS p, unnest([1, 2]) AS i FROM news WHERE sentiment_score IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY p DESC, i) AS rn FROM e WHERE p >= 0.30 AND label <> 'neutral') SELECT n.seq, coalesce(max(label) FILTER (rn = 1), '') AS label, coalesce(round(max(p) FILTER (rn = 1), 4), 0)::DOUBLE AS score, coalesce(max(label) FILTER (rn = 2), '') AS secondary FROM news n LEFT JOIN r USING (seq) WHERE sentiment_score IS NOT NULL GROUP BY n.seq""",
    "u3_deduplicated": f"{_GREEDY} SELECT symbol, seq, survivor FROM g",
    "x2_timestamp": f"WITH {_RD} SELECT feed_id, CASE WHEN bare THEN day_us ELSE coalesce(full_us, day_us) END AS instant_us, CASE WHEN coalesce(CASE WHEN bare THEN day_us ELSE coalesce(full_us, day_us) END, 0) = 0 THEN 'missing' WHEN NOT bare AND full_us IS NOT NULL THEN 'exact' ELSE 'date-only' END AS confidence FROM j",
}
