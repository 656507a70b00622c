"""Boolean full-text search, the fallback where the BM25 index is unavailable.

A query is words that must all be there, "phrases" in quotes, -words that must
not, and OR between alternatives. It is answered from postings with positions
(`retrieval.postings`, or kept by `write_positions`): a phrase is the
intersection of its terms' position lists, an alternative that of its phrases'
chunks. Scores are cover densities: every shortest stretch of a text that holds
all wanted terms adds more the less else it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analysis
from . import retrieval as R
from . import segments

_PART = regex.compile(r'(-?)"([^"]*)"|(\S+)')
_TERM = regex.compile(analysis.TERM)
#: What one term of a text without weights counts.
WEIGHT = 0.1


@dataclass(frozen=True)
class Clause:
    """One alternative: phrases (of one term or more) that must be there, and those that must not."""

    wanted: tuple[tuple[str, ...], ...]
    unwanted: tuple[tuple[str, ...], ...]


def parse(query: str) -> list[Clause]:
    """The alternatives of a query; those that want nothing match nothing."""
    clauses, wanted, unwanted = [], [], []
    for m in _PART.finditer(query):
        if m[3] is not None and m[3].lower() == "or":
            clauses.append(Clause(tuple(wanted), tuple(unwanted)))
            wanted, unwanted = [], []
            continue
        word = m[2] if m[3] is None else m[3]
        minus = m[1] == "-" if m[3] is None else word.startswith("-")
        terms = tuple(_TERM.findall(regex.sub(analysis.DIGIT_COMMA, "", word.lower())))
        if terms:
            (unwanted if minus else wanted).append(terms)
    clauses.append(Clause(tuple(wanted), tuple(unwanted)))
    return [c for c in clauses if c.wanted]


def _places(at: dict[str, list[int]], phrase: tuple[str, ...]) -> list[int]:
    """Where a phrase begins."""
    return [p for p in at.get(phrase[0], ()) if all(p + i in at.get(t, ()) for i, t in enumerate(phrase))]


def cover_density(terms: list[str], clauses: list[Clause]) -> float | None:
    """The definition, for one text's terms: the best alternative's score, or None if none matches."""
    at: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        at.setdefault(t, []).append(i)
    best = None
    for c in clauses:
        spots = [_places(at, p) for p in c.wanted]
        if not all(spots) or any(_places(at, p) for p in c.unwanted):
            continue
        events = sorted((p, k) for k, found in enumerate(spots) for p in found)
        last = [-1] * len(spots)
        total, begun = 0.0, -1
        for p, k in events:
            last[k] = p
            low = min(last)
            if low > begun:  # a stretch that no later one lies within begins anew
                width = p + len(c.wanted[k]) - low
                total += WEIGHT / (1 + max(width - sum(map(len, c.wanted)), 0))
                begun = low
        best = max(best or 0.0, total)
    return best


_PLAN = "query_id long, clause int, slot int, need int, wanted boolean, nth int, word string"


def planned(spark, queries: list[tuple[int, str]], config: str = "simple") -> DataFrame:
    """One row a term of a phrase of an alternative: `slot` numbers the wanted phrases (others follow), `off` is the term's place in its phrase, `n` how many terms it has and `span` how many places."""
    made = []
    for i, text in queries:
        for c, clause in enumerate(parse(text)):
            for s, phrase in enumerate((*clause.wanted, *clause.unwanted)):
                made += [(i, c, s, len(clause.wanted), s < len(clause.wanted), j, w) for j, w in enumerate(phrase)]
    rows = spark.createDataFrame(made, _PLAN)
    if config != "simple":
        rows = rows.filter(~F.col("word").isin(*analysis.STOP_WORDS)).withColumn("word", analysis.stem(F.col("word")))
    by = ["query_id", "clause", "slot"]
    own = rows.groupBy(*by).agg(F.first("wanted").alias("wanted"), F.collect_list(F.struct("nth", "word")).alias("ws"), F.min("nth").alias("low"), (F.max("nth") - F.min("nth") + 1).alias("span"))
    # phrases of stop words alone are gone: what is left is numbered anew
    left = own.groupBy("query_id", "clause").agg(F.array_sort(F.collect_list(F.struct(~F.col("wanted"), "slot", "wanted", "ws", "low", "span"))).alias("ps"))
    left = left.select("query_id", "clause", F.size(F.filter("ps", lambda p: p["wanted"])).alias("need"), F.posexplode("ps").alias("slot", "p")).filter("need > 0")
    flat = left.select("query_id", "clause", "need", "slot", "p.wanted", "p.span", F.size("p.ws").alias("n"), "p.low", F.explode("p.ws").alias("w"))
    return flat.select("query_id", "clause", "need", "slot", "wanted", "span", "n", (F.col("w.nth") - F.col("low")).alias("off"), F.col("w.word").alias("term"))


def density(slots: Column, need: Column) -> Column:
    """The cover density of an alternative whose wanted phrases (`slot`, `span`, `places`) are all there: one fold over their places in order."""
    events = F.array_sort(F.flatten(F.transform(slots, lambda s: F.transform(s["places"], lambda p: F.struct(p.alias("p"), s["slot"].alias("k"), s["span"].alias("span"))))))
    least = F.aggregate(slots, F.lit(0), lambda n, s: n + s["span"])
    start = F.struct(F.array_repeat(F.lit(-1), need).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("total"))

    def step(state, e):
        last = F.transform(state["last"], lambda x, i: F.when(i == e["k"], e["p"]).otherwise(x))
        moved = F.element_at(F.transform(F.array(F.struct(last.alias("last"), F.array_min(last).alias("low"))), lambda m: F.struct(m["last"].alias("last"), m["low"].alias("low"), (m["low"] > state["begun"]).alias("new"))), 1)
        gain = lambda m: F.lit(WEIGHT) / (1 + F.greatest(e["p"] + e["span"] - m["low"] - least, F.lit(0)))
        done = lambda m: F.struct(m["last"].alias("last"), F.when(m["new"], m["low"]).otherwise(state["begun"]).alias("begun"), (state["total"] + F.when(m["new"], gain(m)).otherwise(0.0)).alias("total"))
        return F.element_at(F.transform(F.array(moved), done), 1)

    return F.aggregate(events, start, step)["total"]


def _words(text: Column, config: str) -> Column:
    """A text's terms where they stand; stop words leave their places empty."""
    words = analysis.words(analysis.for_analysis(text))
    return words if config == "simple" else F.transform(words, lambda w: F.when(analysis.is_term(w, config), analysis.stem(w)))


def write_positions(chunks: DataFrame, path: str, keys: list[str], text_col: str = "text", config: str = "simple") -> None:
    """The places of every term of `chunks` as Parquet under `path`: rows of `term` and `entries` (`keys` and `at`), in sorted runs.

    A run is made where its chunks lie, so nothing is shuffled.
    """
    entry = T.StructType([*(chunks.schema[c] for c in keys), T.StructField("at", T.ArrayType(T.IntegerType()))])
    shape = T.StructType([T.StructField("term", T.StringType()), T.StructField("entries", T.ArrayType(entry))])
    own = chunks.select(*keys, _words(F.col(text_col), config).alias("ws"))
    segments.written(own.mapInArrow(segments.placed(keys), shape), path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """What `write_positions` wrote: `term`, `keys`, `at`."""
    return spark.read.parquet(path).select("term", F.inline("entries"))


def search_positions(post: DataFrame, queries: list[tuple[int, str]], keys: list[str], k: int | None = None, config: str = "simple") -> DataFrame:
    """`query_id`, `keys`, `score`, `rank` of the chunks that match; ties by key. `post` has `keys`, `term` and `at`, the term's places; `queries` is a stated list of (query_id, text)."""
    plan = planned(post.sparkSession, queries, config).persist()
    terms = [r["term"] for r in plan.select("term").distinct().limit(10_001).collect()]
    own = post.filter(segments.holds(terms)) if len(terms) <= 10_000 else post
    by = ["query_id", "clause", *keys]
    hits = own.select(*keys, "term", "at").join(R.sized_broadcast(plan, 100_000), "term").withColumn("p", F.transform("at", lambda x: x - F.col("off")))
    phrases = hits.groupBy(*by, "need", "slot", "wanted", "span", "n").agg(F.collect_list("p").alias("ps")).filter(F.size("ps") == F.col("n"))
    phrases = phrases.withColumn("places", F.aggregate("ps", F.element_at("ps", 1), lambda a, b: F.array_intersect(a, b))).filter(F.size("places") > 0)
    found = phrases.groupBy(*by, "need").agg(F.count_if(~F.col("wanted")).alias("bad"), F.collect_list(F.when(F.col("wanted"), F.struct("slot", "span", "places"))).alias("slots"))
    found = found.filter((F.col("bad") == 0) & (F.size("slots") == F.col("need"))).withColumn("score", F.round(density(F.col("slots"), F.col("need")), 9))
    return R.ranked(found.groupBy("query_id", *keys).agg(F.max("score").alias("score")), ["query_id"], [F.desc("score"), *keys], k)


def full_text(chunks: DataFrame, queries: list[tuple[int, str]], key: str | list[str], k: int | None = None, text_col: str = "text", config: str = "simple") -> DataFrame:
    """`search_positions` over chunks not indexed before, without moving any text.

    Of each alternative the term that fewest chunks hold is its anchor. A chunk
    meets the alternatives whose anchor it holds, and is held against them where
    it lies; only what matches is shuffled.
    """
    keys, spark = [key] if isinstance(key, str) else key, chunks.sparkSession
    plan = planned(spark, queries, config).persist()
    terms = R.sized_broadcast(plan.select("term").distinct(), 100_000)
    own = chunks.select(*keys, _words(F.col(text_col), config).alias("ws"))
    df = own.select(F.explode(F.array_distinct("ws")).alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("df"))
    phrase = F.struct("slot", "wanted", "span", "parts")
    by = ["query_id", "clause", "need"]
    told = plan.join(df, "term", "left").groupBy(*by, "slot", "wanted", "span").agg(F.collect_list(F.struct("off", "term")).alias("parts"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("rarest"))
    told = told.groupBy(*by).agg(F.collect_list(phrase).alias("phrases"), F.min(F.when(F.col("wanted"), F.col("rarest"))).alias("anchor")).filter("anchor.df > 0")
    asked = told.select("*", F.flatten(F.transform(F.filter("phrases", lambda p: p["wanted"]), lambda p: F.transform(p["parts"], lambda x: x["term"]))).alias("must")).withColumn("anchor", F.col("anchor.term"))
    rows = asked.collect()  # a stated list
    asked = F.broadcast(spark.createDataFrame(rows, asked.schema))
    anchors = F.array(*(F.lit(t) for t in sorted({r["anchor"] for r in rows}))) if rows else F.array().cast("array<string>")
    met = own.select(*keys, "ws", F.explode(F.array_intersect("ws", anchors)).alias("anchor")).join(asked, "anchor").filter(F.forall("must", lambda t: F.array_contains("ws", t)))

    def places(p: Column) -> Column:
        at = lambda x: F.filter(F.transform("ws", lambda w, i: F.when(w == x["term"], i - x["off"])), lambda i: i.isNotNull())
        each = F.transform(p["parts"], at)
        return F.aggregate(each, F.element_at(each, 1), lambda a, b: F.array_intersect(a, b))

    found = met.withColumn("slots", F.transform("phrases", lambda p: F.struct(p["slot"].alias("slot"), p["wanted"].alias("wanted"), p["span"].alias("span"), places(p).alias("places"))))
    found = found.filter(F.forall("slots", lambda s: s["wanted"] == (F.size(s["places"]) > 0))).withColumn("slots", F.filter("slots", lambda s: s["wanted"]))
    scored = found.select("query_id", *keys, F.round(density(F.col("slots"), F.col("need")), 9).alias("score"))
    return R.ranked(scored.groupBy("query_id", *keys).agg(F.max("score").alias("score")), ["query_id"], [F.desc("score"), *keys], k)
