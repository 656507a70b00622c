"""From retrieved passages to a decided answer: expansion to parents, checks of claims, the decision.

Claims are rows of `answer_id`, `claim`, `text`; citations of `answer_id`,
`claim`, `position`, `passage_id`; passages of `passage_id`, `span` (the cited
text, null or empty if there is none), `issuer`, `period`, `basis`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Scale words, and spellings of currencies with their codes.
SCALES = ("crore", "lakh", "thousand", "million", "billion", "trillion")
CURRENCIES = {"inr": "INR", "rs": "INR", "₹": "INR", "usd": "USD", "$": "USD", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP"}
#: Children shorter than this are shown as their parent.
FRAGMENT = 170


def expand(hits: DataFrame, parents: DataFrame, below: int = FRAGMENT) -> DataFrame:
    """Ranked hits (`query_id`, `chunk_id`, `rank`, `text`) as passages; fragments become their parent (`chunk_id`, `parent_id`, `parent_text`), and hits on one passage merge under the best rank."""
    found = hits.join(parents, "chunk_id", "left")
    widen = (F.length("text") < below) & F.col("parent_id").isNotNull()
    shown = found.select("query_id", "rank", "chunk_id", F.when(widen, F.col("parent_id")).otherwise(F.col("chunk_id")).alias("passage_id"), F.when(widen, F.col("parent_text")).otherwise(F.col("text")).alias("text"), widen.alias("expanded"))
    inside = F.array_sort(F.collect_set(F.struct("rank", "chunk_id")))
    return shown.groupBy("query_id", "passage_id").agg(F.min("rank").alias("best_rank"), F.min_by("text", "rank").alias("text"), F.min_by("expanded", "rank").alias("expanded"), F.transform(inside, lambda x: x["chunk_id"]).alias("stands_for"))


def _scales(text: Column) -> Column:
    """The scales a text names, in the singular or the plural, as words of their own."""
    named = lambda w: F.regexp_like(F.lower(text), F.concat(F.lit("(?<![a-z])"), w, F.lit("s?(?![a-z])")))
    return F.filter(F.array(*map(F.lit, SCALES)), named)


def _currencies(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+|[₹$€£])"), F.lit(1))
    known = F.create_map(*(F.lit(x) for pair in CURRENCIES.items() for x in pair))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.try_element_at(known, w)), lambda c: c.isNotNull()))


def _tag(items: Column, code: str) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(code).alias("code"), F.lit("remove").alias("severity"), x.cast("string").alias("detail")))


def findings(claims: DataFrame, citations: DataFrame, passages: DataFrame) -> DataFrame:
    """One row a claim: its `findings`, array<struct<code, severity, detail>> in check order; without support the later checks fall away."""
    cited = citations.join(passages.withColumn("__known", F.lit(True)), "passage_id", "left")
    known, spoken = F.coalesce("__known", F.lit(False)), F.trim(F.coalesce("span", F.lit(""))) != ""
    listed = lambda when, what: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("position", what.alias("x"))))), lambda y: y["x"])
    per = cited.groupBy("answer_id", "claim").agg(
        listed(~known, F.col("passage_id")).alias("unresolved"),
        listed(known & ~spoken, F.col("passage_id")).alias("textless"),
        listed(known & spoken, F.col("span")).alias("spans"),
        *(F.array_sort(F.collect_set(F.when(known & (F.col(c) != ""), F.col(c)))).alias(c) for c in ("issuer", "period", "basis")),
    )
    both = claims.join(per, ["answer_id", "claim"], "left")
    support = F.coalesce(F.size("spans"), F.lit(0)) > 0
    held = F.array_join("spans", "\n")
    none = F.array().cast("array<struct<code:string,severity:string,detail:string>>")
    some = lambda c: F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>"))
    alone = _tag(F.array(F.lit("no resolvable source")), "no_citation")
    mixed = [F.when(F.size(c) > 1, F.array(F.struct(F.lit(f"mixed_{c}").alias("code"), F.lit("disclose").alias("severity"), F.array_join(c, ", ").alias("detail")))).otherwise(none) for c in ("issuer", "period", "basis")]
    checks = F.concat(
        _tag(X.unsupported(F.col("text"), held), "unsupported_numeral"),
        _tag(F.array_sort(F.array_except(_scales(F.col("text")), _scales(held))), "scale_not_in_cited_span"),
        _tag(F.array_sort(F.array_except(_currencies(F.col("text")), _currencies(held))), "currency_not_in_cited_span"),
        *mixed,
    )
    out = F.concat(_tag(some("unresolved"), "citation_not_in_evidence"), _tag(some("textless"), "cited_span_has_no_text"), F.when(support, checks).otherwise(alone))
    return both.select("answer_id", "claim", "text", out.alias("findings"))


def decide(checked: DataFrame, answers: DataFrame) -> DataFrame:
    """One row an answer (`answer_id`, `answerable`, `degraded` array): `decision`, `support_band`, `reason_codes`, `released`, `withheld`."""
    out = checked.withColumn("removed", F.exists("findings", lambda f: f["severity"] == "remove"))
    codes = F.transform("findings", lambda f: f["code"])
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("removed")).alias("later"), "claim", codes.alias("codes")))), lambda x: x["codes"]))
    per = out.groupBy("answer_id").agg(F.count_if(~F.col("removed")).alias("released"), F.count_if("removed").alias("withheld"), F.coalesce(F.bool_or(~F.col("removed") & (F.size("findings") > 0)), F.lit(False)).alias("qualified"), ordered.alias("codes"))
    both = answers.join(per, "answer_id", "left").fillna(0, ["released", "withheld"]).fillna(False, ["qualified"])
    shown, kept_back, weak = F.col("released") > 0, F.col("withheld") > 0, F.size("degraded") > 0
    first = F.filter(F.array(F.when(~F.col("answerable") & ~shown, "model_reported_unanswerable"), F.when(kept_back & ~shown, "no_claim_survived_validation")), lambda x: x.isNotNull())
    band = F.when(~shown, "none").when(kept_back | (F.col("qualified") & weak), "weak").when(F.col("qualified") | weak, "moderate").otherwise("strong")
    return both.select("answer_id", F.when(~shown, "abstained").when(kept_back, "partial").otherwise("answered").alias("decision"), band.alias("support_band"), F.array_distinct(F.concat(first, F.coalesce("codes", F.array().cast("array<string>")))).alias("reason_codes"), "released", "withheld")


def neighbourhoods(hits: DataFrame, extents: DataFrame, by: list[str], place: str = "ordinal", radius: int = 1) -> DataFrame:
    """The regions around hits, overlapping or touching ones united: `by`, `first`, `last`, `hits`.

    `extents` has `by`, `low` and `high`, the places there are; a region ends
    where they do. Hits on one place count each, and are one for the ordering.
    """
    places = hits.groupBy(*by, place).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by).orderBy(place)
    apart = F.coalesce(F.col(place) - F.lag(place).over(w) > 2 * radius + 1, F.lit(True)).cast("int")
    islands = places.withColumn("__new", apart).withColumn("__island", F.sum("__new").over(w))
    own = islands.groupBy(*by, "__island").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.sum("__n").alias("hits")).join(extents.select(*by, "low", "high"), by)
    return own.select(*by, F.greatest(F.col("a") - radius, "low").alias("first"), F.least(F.col("z") + radius, "high").alias("last"), "hits")
