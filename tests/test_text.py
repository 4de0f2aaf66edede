import difflib
import math
import re

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import candidates, similarity
from tidemark.plans import series


def test_similarity_matches_sets(spark):
    heads = ["Adani shares fall after report", "Adani stock falls after the report", "", "a the of", "Totally other words here"]
    rows = spark.createDataFrame(list(enumerate(heads)), "i int, headline string")
    x = similarity.prepared(rows)
    got = {(r.a, r.b): r.s for r in x.alias("l").join(x.alias("r"), F.lit(True)).select(F.col("l.i").alias("a"), F.col("r.i").alias("b"), T.similarity(F.col("l.tokens"), F.col("r.tokens"), F.col("l.bigrams"), F.col("r.bigrams")).alias("s")).collect()}

    def sets(h):
        w = [x for x in re.findall(r"[a-z0-9]+", h.lower()) if x not in T.STOPWORDS]
        return {x for x in w if len(x) > 2}, set(zip(w, w[1:])) if len(w) >= 2 else set(w)

    for (a, b), s in got.items():
        (ta, ba), (tb, bb) = sets(heads[a]), sets(heads[b])
        want = 0.0 if not ta or not tb else 0.6 * len(ta & tb) / len(ta | tb) + 0.4 * (len(ba & bb) / len(ba | bb) if ba | bb else 0)
        assert math.isclose(s, want, abs_tol=1e-9) and got[b, a] == s and 0 <= s <= 1


def test_deduplicate_is_greedy_by_length(spark):
    rows = [("A", None, 1, "Firm cuts output at main plant", "short"), ("A", None, 2, "Firm cuts output at main plant", "a longer body"), ("A", None, 3, "Another story entirely here", "x"), ("B", None, 4, "Firm cuts output at main plant", "x")]
    news = spark.createDataFrame(rows, "symbol string, published_local_date date, seq bigint, headline string, body string")
    got = {r.seq: r.survivor for r in similarity.deduplicated(news).collect()}
    assert got == {1: 2, 2: None, 3: None, 4: None}


def test_relevance_bands(spark):
    alias = F.array(F.lit("Adani Enterprises"), F.lit("Adani"), F.lit("AE"))
    cases = [
        ("Adani Enterprises shares plunge", "Adani Enterprises fell. " * 8, 0.7, 1.0, True),
        ("Markets close flat", "A long report. " * 40 + "Adani's stake came up once.", 0.0, 0.35, False),
        ("Nothing here", "Adanization is another word", 0.0, 0.0, False),
        ("Adanis dismiss the report", "", 0.4, 0.5, True),
        (None, None, 0.0, 0.0, False),
    ]
    rows = spark.createDataFrame([(h, b) for h, b, *_ in cases], "h string, b string").select(T.relevance(F.col("h"), F.col("b"), alias).alias("r")).collect()
    for row, (h, _, low, high, head) in zip(rows, cases, strict=True):
        assert low <= row.r.score <= high and row.r.headline_match == head, h


def test_event_tags_keep_stem_behaviour(spark):
    heads = {"Q2 profit rises": "earnings", "Court stays penalty": "litigation", "Acquisition talks": "other", "CEO steps down": "leadership", "IPO opens": "capital", "": "other", None: "other"}
    rows = spark.createDataFrame([(h,) for h in heads], "h string").select("h", T.event_tag(F.col("h"), F.lit(None).cast("string")).alias("t")).collect()
    assert {r.h: r.t for r in rows} == heads


def test_emotions_skip_neutral_and_keep_ties_in_order(spark):
    m = F.create_map(*[F.lit(x) for kv in {"neutral": 0.9, "joy": 0.4, "fear": 0.4, "anger": 0.31, "love": 0.1}.items() for x in kv])
    r = spark.range(1).select(T.pick_emotions(m).alias("e")).first().e
    assert (r.label, r.score, r.secondary) == ("joy", 0.4, ["fear", "anger"])
    low = spark.range(1).select(T.pick_emotions(F.create_map(F.lit("joy"), F.lit(0.1))).alias("e")).first().e
    assert (low.label, low.score, low.secondary) == ("", 0.0, [])


def test_interleave_and_cap(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate("aaabbc")], "seq bigint, source string")
    placed = candidates.interleaved(rows)
    order = [r.source for r in placed.orderBy("place").collect()]
    assert order == ["a", "b", "c", "a", "b", "a"]
    assert sorted(r.place for r in candidates.capped(placed, 4).collect()) == sorted(int(i * 6 / 4) + 1 for i in range(4))


def test_prefilter_needs_two_words(spark):
    rows = spark.createDataFrame([("s", "x/tata-steel"), ("s", "x/tata-consumer-gain"), ("t", "x/none")], "source string, url string").withColumn("groups", F.array(F.array(F.lit("tata"), F.lit("consumer"))))
    assert {r.url for r in candidates.prefilter(rows, "groups").collect()} == {"x/tata-consumer-gain"}
    assert candidates.prefilter(rows, "groups", skip=1).count() == 2


def test_staleness_in_chunks_equals_one_window(spark):
    rnd = __import__("random").Random(6)
    words = "gain fall plant court order profit bond bank steel port".split()
    rows = [("AB"[i % 7 == 0], i, f"2024-01-{rnd.randrange(1, 29):02d} {rnd.randrange(24):02d}:00:00", None, " ".join(rnd.choices(words, k=5))) for i in range(300)]
    news = spark.createDataFrame(rows, "symbol string, seq bigint, t string, duplicate_of string, headline string").withColumn("published_at", F.col("t").cast("timestamp"))
    whole = {(r.symbol, r.seq): r.staleness for r in similarity.staleness(news, size=10**9).collect()}
    for size in (1, 7, 40):
        got = {(r.symbol, r.seq): r.staleness for r in similarity.staleness(news, size=size).collect()}
        assert got.keys() == whole.keys() and all((a is None) == (whole[k] is None) and (a is None or math.isclose(a, whole[k], abs_tol=1e-12)) for k, a in got.items())


def test_name_match_meets_every_name(spark, tmp_path):
    """The best of all names, whatever their first word, as a search of the whole directory finds it."""
    names = ["Tata Motors", "Reliance Industries", "Infosys", "HDFC Bank Limited", "Bank of Baroda", "Asian Paints", "--", None, "Tata Steel", "Bajaj Auto"]
    queries = ["Motors", "Relaince Industries", "Imfosys", "Paints", "Tata", "the bank of baroda", "zzzz", "...", None, "Auto Bajaj"]
    rows = [(q, k, f"S{k}", n) for k, (q, n) in enumerate(zip(queries, names, strict=True))]
    spark.createDataFrame(rows, "query string, pos int, symbol string, name string").write.parquet(f"{tmp_path}/quotes.parquet")
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    want = {}
    for q in filter(None, queries):
        best = (0.0, None)
        for _, _, symbol, name in rows:
            a, b = plain(q), plain(name or "")
            score = 0.0 if not a or not b else 1.0 if a in b or b in a else difflib.SequenceMatcher(None, a, b).ratio()
            best = max(best, (score, symbol), key=lambda x: x[0])
        if best[0] >= 0.5:
            want[q] = (best[1], round(best[0], 4))
    assert want["Motors"] == ("S0", 1.0) and want["Relaince Industries"][0] == "S1"
    assert {r.query: (r.symbol, r.score) for r in series.s28_name_match(spark, str(tmp_path)).collect()} == want


def test_greedy_duplicates_equal_the_ordered_walk(spark):
    """Rounds on the graph of similar pairs give what a walk in order gives, whatever chains of similar headlines there are."""
    rnd = __import__("random").Random(8)
    pool = [f"word{k}" for k in range(10)]
    rows = [("A", None, k, " ".join(rnd.sample(pool, 6)) if rnd.random() < 0.9 else rnd.choice(["", "an of"]), "x" * rnd.randrange(4)) for k in range(160)]
    news = spark.createDataFrame(rows, "symbol string, published_local_date date, seq bigint, headline string, body string")

    def sets(h):
        w = [x for x in re.findall(r"[a-z0-9]+", h.lower()) if x not in T.STOPWORDS]
        return {x for x in w if len(x) > 2}, set(zip(w, w[1:])) if len(w) >= 2 else set(w)

    def alike(a, b):
        (ta, ba), (tb, bb) = sets(a), sets(b)
        return bool(ta and tb) and 0.6 * len(ta & tb) / len(ta | tb) + 0.4 * len(ba & bb) / len(ba | bb) >= 0.5

    kept, want = [], {}
    for _, _, k, h, b in sorted(rows, key=lambda r: (-len(r[4]), r[2])):
        want[k] = next((s for s, other in kept if alike(h, other)), None)
        if want[k] is None:
            kept.append((k, h))
    assert sum(v is not None for v in want.values()) > 20
    assert {r.seq: r.survivor for r in similarity.deduplicated(news, threshold=0.5).collect()} == want


def test_interleave_in_runs(spark):
    """Places by runs of seq equal those of one walk, for sources of very unequal sizes."""
    rnd = __import__("random").Random(4)
    rows = [(k, rnd.choices("abcdef", [50, 20, 10, 5, 2, 1])[0]) for k in range(400)]
    by = {}
    for k, s in rows:
        by.setdefault(s, []).append(k)
    order, want = sorted(by, key=lambda s: by[s][0]), []
    for rank in range(max(map(len, by.values()))):
        want += [by[s][rank] for s in order if rank < len(by[s])]
    df = spark.createDataFrame(rows, "seq bigint, source string")
    original = candidates.ranked
    candidates.ranked = lambda d, key, seq: original(d, key, seq, size=37)
    try:
        assert [r.seq for r in candidates.interleaved(df).orderBy("place").collect()] == want
    finally:
        candidates.ranked = original
