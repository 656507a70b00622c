"""I-Match document fingerprints, in DataFrame expressions only.

Terms are lower-cased words. A lexicon keeps the terms whose share of documents
lies in a band (that is, whose inverse document frequency does); a document's
terms in it are made distinct, sorted, and hashed once for each of several
random subsets of the lexicon. Two fingerprints are as alike as the share of
subsets on which they agree.

Document frequencies are counted exactly, by 64-bit term hash, over all
documents. The lexicon holds at most (mean distinct terms a document) /
BAND[0] terms, whatever the corpus; it travels inside the plan as literal
arrays, the terms by bucket, and where each bucket begins and its size.

Defined results: null and empty texts have no terms and share one fingerprint;
where a subset holds none of a text's terms, all its distinct terms are hashed
instead, so short texts agree only if their terms do; repeated rows get equal
fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, fresh_name, materialise, small, text_of, words_of

#: Shares of documents between which a term is kept.
BAND = (0.002, 0.25)
SUBSETS = 8
#: A subset keeps one term in so many.
KEEP_ONE_IN = 8
SEED = 2004
#: Ids to a bucket of the neighbour search.
IDS_A_BUCKET = 1_000_000


def _hashed_words(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


#: Terms to a bucket of the lexicon, on average at most.
IN_A_BUCKET = 8


@dataclass(frozen=True)
class Lexicon:
    """Terms by bucket (their low bits), and of each bucket its first place, from 1, and its size, as texts of numbers."""

    terms: str
    first: str
    size: str
    buckets: int


def lexicon_of(hashes: list[int]) -> Lexicon:
    buckets = 1 << max(4, (len(hashes) // IN_A_BUCKET).bit_length())
    held: list[list[int]] = [[] for _ in range(buckets)]
    for h in sorted(hashes):
        held[h & (buckets - 1)].append(h)
    sizes = [len(x) for x in held]
    firsts = itertools.accumulate([1, *sizes[:-1]])
    return Lexicon(*(",".join(map(str, x)) for x in (itertools.chain(*held), firsts, sizes)), buckets)


def build_lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND) -> Lexicon:
    """The terms whose share of documents lies in the band; with very few documents, also those of one document."""
    found = F.array_distinct(_hashed_words(text_of(F.col(f"`{text_col}`"))))
    counts = materialise(docs.select(F.explode(found).alias("h")).groupBy("h").agg(F.count("*").alias("df")), "df")
    n = docs.count()
    rows = counts.filter((F.col("df") >= F.lit(band[0] * n)) & (F.col("df") <= F.lit(max(band[1] * n, 1.0)))).collect()  # bounded as the lexicon is
    discard(counts)
    return lexicon_of([r["h"] for r in rows])


def signatures(text: Column, lexicon: Lexicon, names: dict[str, str], subsets: int = SUBSETS, keep_one_in: int = KEEP_ONE_IN) -> list[tuple[str, Column]]:
    """Columns to add one after the other, under `names`; the last, `sigs`, is the array of subset hashes."""
    width = keep_one_in.bit_length() - 1
    terms_of = F.split(F.lit(lexicon.terms), ",").try_cast("array<bigint>")
    # each literal is named once, so that plans hold it once
    first, size = (F.split(F.lit(x), ",").cast("array<int>") for x in (lexicon.first, lexicon.size))

    def listed(h: Column) -> Column:
        bucket = h.bitwiseAND(F.lit(lexicon.buckets - 1)).cast("int")
        return F.array_contains(F.slice(terms_of, F.get(first, bucket), F.get(size, bucket)), h)

    hashes, terms, dealt = (F.col(names[k]) for k in ("hashes", "terms", "dealt"))
    whole = F.xxhash64(F.array_sort(F.array_distinct(hashes)))

    def subset(k: int) -> Column:
        own = F.filter(dealt, lambda t: F.shiftrightunsigned(t["g"], width * k).bitwiseAND(F.lit(keep_one_in - 1)) == 0)
        return F.xxhash64(F.lit(k), F.when(F.exists(dealt, lambda t: F.shiftrightunsigned(t["g"], width * k).bitwiseAND(F.lit(keep_one_in - 1)) == 0), F.xxhash64(F.transform(own, lambda t: t["h"]))).otherwise(whole))

    return [
        ("hashes", _hashed_words(text)),
        ("terms", F.array_sort(F.array_distinct(F.filter(hashes, listed)))),
        ("dealt", F.transform(terms, lambda h: F.struct(h.alias("h"), F.xxhash64(F.lit(SEED), h).alias("g")))),
        ("sigs", F.array(*(subset(k) for k in range(subsets)))),
    ]


def with_fingerprint(df: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "sigs") -> DataFrame:
    """`df` with the subset hashes of its text in `out`, which takes the place of a column of that name; other columns stay."""
    keep = [c for c in df.columns if c.lower() != out.lower()]
    names = {k: fresh_name(f"__fp_{k}", [*df.columns, out]) for k in ("hashes", "terms", "dealt", "sigs")}
    for name, col in signatures(text_of(F.col(f"`{text_col}`")), lexicon, names):
        df = df.withColumn(names[name], col)
    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(names["sigs"]).alias(out))


def printed(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(s))), "-")


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets on which two fingerprints agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def next_lower(ids: DataFrame) -> DataFrame:
    """`doc_id`, `next_id`: the next lower id, after the lowest the highest. `ids` holds distinct ids and is a written table.

    Ids are cut into ranges of equal width and ordered within each; the highest
    id of each range, one row a range, links the ranges.
    """
    s = ids.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("n")).first()
    if not s["n"]:
        return ids.select("doc_id", F.col("doc_id").alias("next_id"))
    ranges = -(-s["n"] // IDS_A_BUCKET)
    width = (s["hi"] - s["lo"]) // ranges + 1
    placed = ids.filter("doc_id IS NOT NULL").withColumn("r", F.floor((F.col("doc_id") - s["lo"]) / width))
    own = placed.withColumn("next_id", F.lag("doc_id").over(Window.partitionBy("r").orderBy("doc_id")))
    tops = placed.groupBy("r").agg(F.max("doc_id").alias("top"))
    tops = tops.select(F.lead("r").over(Window.orderBy("r")).alias("r"), "top")
    return own.join(small(materialise(tops, "tops"), 100_000), "r", "left").select("doc_id", F.coalesce("next_id", "top", F.lit(s["hi"])).alias("next_id"))


def op3_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form.

    The text travels once by id: both sides of the second join read that one
    exchange, for which rows without an id go their own way. Its head travels
    once more. A repeated id lends its smallest text; a null id has no next
    document.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_of("text").alias("text"))
    lexicon = build_lexicon(docs)
    base = with_fingerprint(docs, lexicon)
    half = F.floor(F.length("text") / 2).cast("int")
    halves = docs.select("doc_id", half.alias("half")).groupBy("doc_id").agg(F.max("half").alias("half"), F.count("*").alias("rows"))
    halves = materialise(halves, "halves")
    known = base.filter("doc_id IS NOT NULL")
    lenders = known
    if halves.filter("rows > 1").limit(1).count():
        one = base.groupBy("doc_id").agg(F.min(F.struct("text", "sigs")).alias("one"))
        lenders = one.select("doc_id", "one.text", "one.sigs")
    nxt = next_lower(halves.select("doc_id")).join(halves.select("doc_id", "half"), "doc_id")
    nxt = nxt.select(F.col("doc_id").alias("to_id"), "half", "next_id")
    heads = lenders.join(nxt, F.col("doc_id") == F.col("next_id")).select("to_id", F.left("text", F.col("half")).alias("head"), F.col("sigs").alias("next_sigs"))
    both = known.join(heads, F.col("doc_id") == F.col("to_id"), "left").select("doc_id", "text", "sigs", "head", "next_sigs")
    unknown = base.filter("doc_id IS NULL").select("doc_id", "text", "sigs", F.lit(None).cast("string").alias("head"), F.lit(None).cast("array<bigint>").alias("next_sigs"))
    both = both.unionByName(unknown)
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("head", F.lit("")), half))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    both = with_fingerprint(both.withColumnRenamed("sigs", "own"), lexicon, "edited")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("sigs")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("sigs")).alias("near_edited"),
        F.coalesce(likeness(F.col("own"), F.col("next_sigs")), F.lit(0.0)).alias("near_next"),
    )
