"""Quality rules judged per document and per host, in DataFrame expressions only.

Each document gets counts and rule failures. Failures are summed by host
(`host_col`), each host's failure rate is shrunk towards an empirical beta
prior fitted to all hosts, and a host whose shrunk rate of any rule exceeds
`host_limit` is condemned: its documents are dropped too.

Defined results: a null text has no words (and so fails `short`); a null host
is a host of its own; repeated rows are judged row by row; an empty table gives
an empty result; extra columns, whatever they are called, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, fresh_name, materialise, small, text_of, words_of

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: rule -> SQL condition under which a document fails it.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "20 * n_dup_lines > n_words",
}
#: The rules that reject a document by themselves.
BASE = ("short", "repeats")


def text_counts(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add the five counts of `COUNTS` (each with `prefix`) to `df`.

    The 8-word windows are hashed by doubling (1, 2, 4, 8 words); only texts in
    which some window repeats are sorted to find which words repeats cover.
    """
    keep = df.columns
    at = {k: fresh_name(f"__bv_{k}", keep) for k in ("text", "words", "w1", "w2", "w4", "w8", "sorted", "places", "lines")}
    df = df.withColumn(at["text"], text_of(F.col(f"`{text_col}`")))
    df = df.withColumn(at["words"], words_of(F.col(at["text"])))
    df = df.withColumn(at["w1"], F.transform(at["words"], lambda w: F.xxhash64(w)))
    for had, new, step in (("w1", "w2", 1), ("w2", "w4", 2), ("w4", "w8", 4)):
        n = F.greatest(F.size(at[had]) - step, F.lit(0))
        df = df.withColumn(at[new], F.zip_with(F.slice(at[had], F.lit(1), n), F.slice(at[had], F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b)))
    repeats = F.size(F.array_distinct(at["w8"])) < F.size(at["w8"])
    df = df.withColumn(at["sorted"], F.when(repeats, F.array_sort(F.transform(at["w8"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    nothing = F.expr("array(cast(null as struct<h:bigint,i:int>))")
    m = F.size(at["sorted"])
    before = F.concat(nothing, F.slice(at["sorted"], F.lit(1), m - 1))
    after = F.concat(F.slice(at["sorted"], F.lit(2), m - 1), nothing)
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    marked = F.zip_with(F.zip_with(at["sorted"], before, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), same(a, b).alias("e"))), after, lambda a, b: F.when(a["e"] | same(a, b), a["i"]))
    df = df.withColumn(at["places"], F.when(F.col(at["sorted"]).isNotNull(), F.array_sort(F.array_compact(marked))))
    gaps = F.zip_with(at["places"], F.slice(at["places"], F.lit(2), F.greatest(F.size(at["places"]), F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))).cast("long"))
    lines = F.filter(F.split(F.col(at["text"]), "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    df = df.withColumn(at["lines"], lines)
    return df.select(
        *(F.col(f"`{c}`") for c in keep),
        F.size(at["words"]).cast("long").alias(prefix + "n_words"),
        F.length(F.regexp_replace(at["text"], SPACE, "")).cast("long").alias(prefix + "word_chars"),
        F.length(F.regexp_replace(at["text"], r"[^#*$%&|<>]+", "")).cast("long").alias(prefix + "n_symbols"),
        (F.size(at["lines"]) - F.size(F.array_distinct(at["lines"]))).cast("long").alias(prefix + "n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")).alias(prefix + "n_repeat_words"),
    )


def host_verdicts(judged: DataFrame, host_limit: float, host: str, fails: dict[str, str]) -> DataFrame:
    """One row per host: `host`, its documents, and whether any shrunk failure rate is above `host_limit`.

    The prior of each rule is a beta distribution fitted by moments to the
    hosts' rates, the binomial noise taken off their variance. It is one row of
    numbers, whatever the number of hosts.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), *(F.sum(F.col(fails[r]).cast("long")).alias(f"f_{r}") for r in RULES))
    hosts = materialise(hosts, "hosts")
    rate = {r: F.col(f"f_{r}") / F.col("n") for r in RULES}
    prior = hosts.agg(*(x for r in RULES for x in (F.avg(rate[r]).alias(f"m_{r}"), F.var_samp(rate[r]).alias(f"v_{r}"))), F.avg(1 / F.col("n")).alias("noise")).first()
    bad = F.lit(False)
    for r in RULES:
        m, v, noise = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0, prior["noise"] or 0.0
        spread = max(v - m * (1 - m) * noise, 1e-9)
        strength = min(max(m * (1 - m) / spread - 1, 1.0), 1e6)
        bad = bad | ((F.col(f"f_{r}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength)) > F.lit(host_limit))
    return hosts.select("host", F.col("n").alias("host_docs"), bad.alias("condemned"))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", carry: list[str] | None = None, host_limit: float = 0.5, prefix: str = "") -> DataFrame:
    """`carry` columns of `docs` (all by default), the counts, `base_failed` and `kept`.

    The counted rows are written once to the shared folder; the host summary
    and the verdict join both read them there. Only condemned hosts are joined
    back, so the join's small side holds the few that fail.
    """
    carry = docs.columns if carry is None else carry
    taken = [*docs.columns, *(prefix + c for c in (*COUNTS, "base_failed", "kept"))]
    if len({c.lower() for c in (*carry, *taken[len(docs.columns) :])}) < len(carry) + len(COUNTS) + 2:
        raise ValueError("a carried column is named like a result; give a prefix")
    inner = "__bv_n_"
    while any(c.lower().startswith(inner) for c in taken):
        inner = f"_{inner}"
    host = fresh_name("__bv_host", taken)
    fails = {r: fresh_name(f"__bv_fails_{r}", taken) for r in RULES}
    other, flag = fresh_name("__bv_other", taken), fresh_name("__bv_condemned", taken)
    counted = text_counts(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col, host_col]))), text_col, inner)
    judged = counted.select(*(F.col(f"`{c}`") for c in carry), *(F.col(inner + c).alias(prefix + c) for c in COUNTS), F.col(f"`{host_col}`").alias(host), *(F.expr(_named(cond, inner)).alias(fails[r]) for r, cond in RULES.items()))
    judged = materialise(judged, "judged")
    verdicts = host_verdicts(judged, host_limit, host, fails)
    condemned = materialise(verdicts.filter("condemned").select(F.col("host").alias(other), F.lit(True).alias(flag)), "condemned")
    joined = judged.join(small(condemned, 100_000), F.col(host).eqNullSafe(F.col(other)), "left")
    base = F.lit(False)
    for r in BASE:
        base = base | F.col(fails[r])
    kept = ~base & F.col(flag).isNull()
    return joined.select(*(F.col(f"`{c}`") for c in carry), *(prefix + c for c in COUNTS), base.alias(prefix + "base_failed"), kept.alias(prefix + "kept"))


def _named(cond: str, prefix: str) -> str:
    for c in COUNTS:
        cond = cond.replace(c, f"{prefix}{c}")
    return cond


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """The rows of `docs` that pass, with its own columns: what a filtering stage needs."""
    prefix = "__bv_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    judged = quality_rules(docs, text_col, host_col, host_limit=host_limit, prefix=prefix)
    return judged.filter(F.col(f"{prefix}kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality_rules(docs, carry=["doc_id"]).select("doc_id", *COUNTS, "base_failed", "kept")


_COUNTED_SQL = r"""
src AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM {docs}),
wordy AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM src),
win AS (SELECT rid, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') AS g FROM wordy, unnest(range(1, len(ws) - 6)) AS t(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c >= 2),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, unnest(range(0, 8)) AS t(k) GROUP BY rid),
lined AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS ls FROM wordy),
counted AS (
  SELECT w.rid, w.doc_id, w.source, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l.ls) - len(list_distinct(l.ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM wordy w JOIN lined l USING (rid) LEFT JOIN rep r USING (rid)),
failing AS (
  SELECT *, n_words < 20 AS f1, 100 * n_repeat_words > 30 * n_words AS f2, 10 * n_symbols > word_chars AS f3, 20 * n_dup_lines > n_words AS f4 FROM counted),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (f1) AS c1, count(*) FILTER (f2) AS c2, count(*) FILTER (f3) AS c3, count(*) FILTER (f4) AS c4 FROM failing GROUP BY source),
longer AS (SELECT source, n, u.r, u.c FROM hosts, unnest([{{'r': 1, 'c': c1}}, {{'r': 2, 'c': c2}}, {{'r': 3, 'c': c3}}, {{'r': 4, 'c': c4}}]) AS t(u)),
moments AS (SELECT r, avg(c / n) AS m, coalesce(var_samp(c / n), 0) AS v, avg(1 / n) AS noise FROM longer GROUP BY r),
prior AS (SELECT r, m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * noise, 1e-9) - 1, 1.0), 1e6) AS s FROM moments),
condemned AS (SELECT DISTINCT source FROM longer JOIN prior USING (r) WHERE (c + m * s) / (n + s) > 0.5),
judged AS (
  SELECT f.*, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT EXISTS (SELECT 1 FROM condemned c WHERE c.source IS NOT DISTINCT FROM f.source) AS kept FROM failing f)
"""

SQL = "WITH " + _COUNTED_SQL.format(docs="documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
