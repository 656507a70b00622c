"""Retrieval: BM25 postings and search, exact dense search, allocation, rank fusion, deduplication, budgets."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import analysed, for_analysis, is_term, stem, words

K1, B, AVGDL = 1.2, 0.75, 99.21


def blocks(docs: DataFrame) -> DataFrame:
    """Documents cut at line feeds: `doc_id`, `ordinal`, `text` and the metadata columns."""
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))


def occurrences(chunks: DataFrame, keys: list[str], text_col: str = "text", config: str = "simple") -> DataFrame:
    """`keys`, `len` (terms of the chunk), `at` and `term`: one row a term where it stands; stop words leave their places empty."""
    own = chunks.select(*keys, words(for_analysis(F.col(text_col))).alias("ws"))
    if config == "simple":
        return own.select(*keys, F.size("ws").alias("len"), F.posexplode("ws").alias("at", "term"))
    rows = own.select(*keys, F.size(F.filter("ws", lambda w: is_term(w, config))).alias("len"), F.posexplode("ws").alias("at", "word"))
    return rows.filter(is_term(F.col("word"), config)).select(*keys, "len", "at", stem(F.col("word")).alias("term"))


def runs_of(s: Column | str, same) -> Column:
    """Runs of a sorted array as structs of `a`, where one begins, and `n`, how long it is; `same` tells from two neighbours whether they are of one run."""
    s = F.col(s) if isinstance(s, str) else s
    begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | ~same(F.get(s, i), F.get(s, i - 1)))
    # the array of beginnings gets a name, so that it is worked out once
    named = F.transform(F.array(begins), lambda b: F.transform(b, lambda a, j: F.struct(a.alias("a"), (F.coalesce(F.get(b, j + 1), F.size(s)) - a).alias("n"))))
    return F.when(F.size(s) > 0, F.element_at(named, 1)).otherwise(F.array().cast("array<struct<a:int,n:int>>"))


def counted(chunks: DataFrame, keep: list[str], text_col: str = "text", config: str = "simple", positions: bool = False) -> DataFrame:
    """`keep`, `len` and `terms`: a chunk's terms with `tf` (and `at`, their places), sorted and counted where it lies."""
    own = chunks.select(*keep, words(for_analysis(F.col(text_col))).alias("ws"))
    placed = F.transform("ws", lambda w, i: F.struct((w if config == "simple" else F.when(is_term(w, config), stem(w))).alias("w"), i.alias("i")))
    rows = own.select(*keep, F.array_sort(F.filter(placed, lambda x: x["w"].isNotNull())).alias("s"))
    rows = rows.select(*keep, "s", F.size("s").alias("len"), runs_of("s", lambda x, y: x["w"] == y["w"]).alias("r"))
    places = lambda r: [F.transform(F.slice("s", r["a"] + 1, r["n"]), lambda x: x["i"]).alias("at")] if positions else []
    return rows.select(*keep, "len", F.transform("r", lambda r: F.struct(F.get("s", r["a"])["w"].alias("term"), r["n"].cast("long").alias("tf"), *places(r))).alias("terms"))


def weight(tf: Column, length: Column, avgdl: float = AVGDL) -> Column:
    """What a term of a chunk weighs: fixed by the chunk alone."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(avgdl)))


def postings(chunks: DataFrame, keys: list[str], text_col: str = "text", avgdl: float = AVGDL, config: str = "simple", positions: bool = False) -> DataFrame:
    """`keys`, `term`, `tf`, `len`, `weight`: one row a term of a chunk; with `positions` also `at`, its places. Nothing is shuffled."""
    rows = counted(chunks, keys, text_col, config, positions)
    # an expression, not the column: Spark would infer that the column isn't empty, and work it out once more to filter by that
    parts = F.transform("terms", lambda p: F.struct(p["term"].alias("term"), p["tf"].alias("tf"), *([p["at"].alias("at")] if positions else []), weight(p["tf"], F.col("len"), avgdl).alias("weight")))
    return rows.select(*keys, "len", F.explode(parts).alias("p")).select(*keys, "len", "p.*")


def inverse_frequencies(post: DataFrame, chunks: int) -> DataFrame:
    """`term`, `df`, `idf` over the whole collection."""
    return post.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(float(chunks)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))


def query_terms(queries: DataFrame, config: str = "simple") -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(analysed(F.col("text"), config))).alias("term"))


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """With a broadcast hint if there are at most `rows` rows; otherwise Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bm25_search(chunks: DataFrame, queries: DataFrame, keys: list[str], k: int | None = None, text_col: str = "text", avgdl: float = AVGDL, config: str = "simple") -> DataFrame:
    """`bm25` over chunks not indexed before, in one pass over their texts.

    Terms are reduced to the queries' own before anything is shuffled; document
    frequencies are counted over all chunks, for these terms alone.
    """
    wanted = query_terms(queries, config)
    own = sized_broadcast(wanted.select("term").distinct(), 100_000)
    tf = occurrences(chunks, keys, text_col, config).join(own, "term", "left_semi").groupBy(*keys, "len", "term").agg(F.count("*").alias("tf"))
    post = tf.withColumn("weight", weight(F.col("tf"), F.col("len"), avgdl))
    return bm25(post, inverse_frequencies(post, chunks.count()), queries, keys, k, config)


def _stated(chunks: DataFrame, queries: DataFrame, text_col: str, config: str) -> tuple[list, list[list[str]], dict[str, int], int]:
    """The stated queries' ids and terms, in how many chunks each term is, and how many chunks there are: one pass over the texts."""
    asked = queries.select("query_id", F.array_distinct(analysed(F.col("text"), config)).alias("ts")).collect()
    wanted = sorted({t for r in asked for t in r["ts"] or []})
    own = F.broadcast(chunks.sparkSession.createDataFrame([(t,) for t in wanted], "term string"))
    df = {r["term"]: r["df"] for r in chunks.select(F.explode(F.array_distinct(analysed(F.col(text_col), config))).alias("term")).join(own, "term").groupBy("term").agg(F.count("*").alias("df")).collect()}
    return [r["query_id"] for r in asked], [[t for t in r["ts"] or [] if t in df] for r in asked], df, chunks.count()


def bm25_best(chunks: DataFrame, queries: DataFrame, keys: list[str], k: int, scope: DataFrame | None = None, pool: str | None = None, kind: str | None = None, text_col: str = "text", avgdl: float = AVGDL, config: str = "simple") -> DataFrame:
    """The `k` best chunks of each query by BM25: `query_id`, `keys`, `score`, `rank`; ties by key.

    One pass counts the document frequencies of the queries' terms over all
    `chunks`; another scores `scope` (all, unless given) a batch at a time
    against every query, and only the k best of a query leave a task.
    With `pool`, chunks stand for their value of that column, which gets its
    best chunk's score; with `kind`, ranks restart for each of its values. The
    queries are a stated set: their terms are held by every task.
    """
    ids, terms, df, n = _stated(chunks, queries, text_col, config)
    keys = [pool] if pool else keys
    schema = T.StructType([chunks.schema[c] for c in keys] + ([chunks.schema[kind]] if kind else []))
    shape = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), *schema.fields, T.StructField("score", T.DoubleType())])
    work = _best_chunks(ids, terms, df, n, k, avgdl, len(keys), kind is not None, pool is not None)
    rows = (chunks if scope is None else scope).select(*keys, *([kind] if kind else []), analysed(F.col(text_col), config).alias("ts"))
    out = rows.mapInArrow(work, shape).withColumn("score", F.round("score", 9))
    if pool:
        out = out.groupBy("query_id", *schema.names).agg(F.max("score").alias("score"))
    return ranked(out, ["query_id", *([kind] if kind else [])], [F.desc("score"), *keys], k)


def _best_chunks(ids: list, terms: list[list[str]], df: dict[str, int], n: int, k: int, avgdl: float, width: int, by_kind: bool, pooled: bool):
    """The function that scores each batch of (keys, kind, terms) against every query."""
    import math

    vocabulary = sorted(df)
    place = {t: i for i, t in enumerate(vocabulary)}
    idf = [math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1.0) for t in vocabulary]
    asked = [(i, [place[t] for t in ts]) for i, ts in zip(ids, terms) if ts]

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def best(held, new):
            """The k best rows of each query (and kind), ties by key; of a pool only its best."""
            both = new if held is None else pa.concat_tables([held, new])
            groups = ["query_id", *both.column_names[1 + width : -1]]
            order = lambda t: t.take(pc.sort_indices(t, [*((g, "ascending") for g in groups), ("score", "descending"), *((c, "ascending") for c in t.column_names[1 : 1 + width])], null_placement="at_start"))

            def changes(t, columns):
                codes = [pc.fill_null(t[c].combine_chunks().dictionary_encode().indices, -1).to_numpy() for c in columns]
                return np.concatenate([[True], np.any([np.diff(c) != 0 for c in codes], axis=0)])

            both = order(both)
            if pooled:
                names = [*groups, *both.column_names[1 : 1 + width]]
                codes = np.stack([pc.fill_null(both[c].combine_chunks().dictionary_encode().indices, -1).to_numpy() for c in names])
                both = both.take(np.sort(np.unique(codes, axis=1, return_index=True)[1]))
            first = np.flatnonzero(changes(both, groups))
            place = np.arange(both.num_rows) - np.repeat(first, np.diff(np.append(first, both.num_rows)))
            return both.filter(pa.array(place < k))

        values, weights, held = pa.array(vocabulary, pa.string()), np.array(idf), None
        for b in batches:
            lists = b.column(b.num_columns - 1)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy()
            owner = np.repeat(np.arange(len(length)), length)[found >= 0]
            pair, tf = np.unique(found[found >= 0].astype(np.int64) * len(length) + owner, return_counts=True)
            term, owner = pair // max(len(length), 1), pair % max(len(length), 1)
            weight = weights[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / avgdl)))
            head = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            groups = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_inverse=True)[1] if pooled else np.arange(len(length))
            kinds = np.unique(pc.fill_null(b.column(width).cast(pa.string()), "").to_numpy(zero_copy_only=False), return_inverse=True)[1] if by_kind else np.zeros(len(length), int)
            rows, names, scores = [], [], []
            for i, own in asked:
                at = np.concatenate([np.arange(head[t], head[t + 1]) for t in own])
                if not len(at):
                    continue
                score = np.round(np.bincount(owner[at], weight[at], len(length)), 9)
                hits = np.flatnonzero(score > 0)
                if pooled and len(hits):  # of each group the best chunk, the first of equal ones
                    ordered = np.lexsort((hits, -score[hits], groups[hits]))
                    hits = hits[ordered][np.concatenate([[True], np.diff(groups[hits][ordered]) > 0])]
                for kind in np.unique(kinds[hits]):
                    mine = hits[kinds[hits] == kind]
                    if len(mine) > k:
                        mine = mine[score[mine] >= np.partition(score[mine], len(mine) - k)[len(mine) - k]]  # ties with the last stay
                    rows.append(mine)
                    names += [i] * len(mine)
                    scores.append(score[mine])
            if names:
                take = pa.array(np.concatenate(rows))
                columns = [b.column(c).take(take) for c in range(b.num_columns - 1)]
                held = best(held, pa.Table.from_arrays([pa.array(names), *columns, pa.array(np.concatenate(scores))], names=["query_id", *b.schema.names[:-1], "score"]))
        if held is not None:
            yield from held.combine_chunks().to_batches(max_chunksize=10_000)

    return work


def bm25_documents(docs: DataFrame, queries: DataFrame, key: str, k: int, text_col: str = "text", avgdl: float = AVGDL, config: str = "simple") -> DataFrame:
    """`query_id`, `key`, `best`, `total`: documents by BM25 of their blocks (lines), the best one's score and the sum of all.

    Of each query at least the `k` first by either (ties by key) are there. A
    document's blocks are scored together where it lies, and only these leave a
    task. The queries are a stated set.
    """
    import math

    chunks = docs.select(F.explode(F.split(text_col, "\n")).alias("text"))
    ids, terms, df, n = _stated(chunks, queries, "text", config)
    vocabulary = sorted(df)
    place = {t: i for i, t in enumerate(vocabulary)}
    idf = [math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1.0) for t in vocabulary]
    asked = [(i, [place[t] for t in ts]) for i, ts in zip(ids, terms) if ts]

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        values, weights, held = pa.array(vocabulary, pa.string()), np.array(idf), {}
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy())
            lists = b.column(1).flatten()
            length = pc.list_value_length(lists).to_numpy()
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=values), -1).to_numpy()
            owner = np.repeat(np.arange(len(length)), length)[found >= 0]
            pair, tf = np.unique(found[found >= 0].astype(np.int64) * len(length) + owner, return_counts=True)
            term, owner = pair // max(len(length), 1), pair % max(len(length), 1)
            weight = weights[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / avgdl)))
            head = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            for i, own in asked:
                at = np.concatenate([np.arange(head[t], head[t + 1]) for t in own])
                if not len(at):
                    continue
                score = np.round(np.bincount(owner[at], weight[at], len(length)), 9)
                best, total = np.zeros(b.num_rows), np.round(np.bincount(doc, score, b.num_rows), 6)
                np.maximum.at(best, doc, score)
                hits = np.flatnonzero(best > 0)
                rows = (keys[hits], best[hits], total[hits])
                rows = [np.concatenate(x) for x in zip(held[i], rows)] if i in held else rows
                keep = np.union1d(np.lexsort((rows[0], -rows[1]))[:k], np.lexsort((rows[0], -rows[2]))[:k])
                held[i] = tuple(x[keep] for x in rows)
        for i, (name, best, total) in held.items():
            yield pa.RecordBatch.from_pydict({"query_id": [i] * len(name), key: name.tolist(), "best": best, "total": total})

    shape = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), docs.schema[key], T.StructField("best", T.DoubleType()), T.StructField("total", T.DoubleType())])
    own = docs.filter(F.col(key).isNotNull()).select(key, F.transform(F.split(text_col, "\n"), lambda b: analysed(b, config)).alias("ts"))
    return own.mapInArrow(work, shape)


def part_of(term: str, buckets: int) -> int:
    """What Spark's `pmod(xxhash64(term), buckets)` is."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (h >> 63 << 64)) % buckets


def write_index(chunks: DataFrame, path: str, keys: list[str], text_col: str = "text", buckets: int = 64, config: str = "simple", positions: bool = False) -> None:
    """The postings of `chunks` (with `positions` also their places) as Parquet under `path`, in parts by term hash and sorted by term, with their idf.

    A search reads the parts of its terms alone, and of these the row groups
    whose statistics hold them.
    """
    post = postings(chunks, keys, text_col, config=config, positions=positions)
    part = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    idf = inverse_frequencies(post, chunks.count())
    post.join(idf, "term").withColumn("part", part).repartition("part", F.pmod(F.xxhash64(*keys), F.lit(16))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(path)


def search_index(index: DataFrame, queries: DataFrame, keys: list[str], k: int | None = None, buckets: int = 64, where: Column | None = None, config: str = "simple") -> DataFrame:
    """BM25 over what `write_index` wrote, with the same `config`. `queries` is a stated set: its terms (up to 10,000) become filters of the scan."""
    wanted = query_terms(queries, config)
    asked = wanted.limit(10_001).collect()
    if len(asked) <= 10_000:
        terms = sorted({r["term"] for r in asked})
        wanted = F.broadcast(index.sparkSession.createDataFrame(asked, wanted.schema))
        index = index.filter(F.col("part").isin(sorted({part_of(t, buckets) for t in terms})) & F.col("term").isin(terms))
    hits = index.select(*keys, "term", "weight", "idf") if where is None else index.filter(where).select(*keys, "term", "weight", "idf")
    scored = hits.join(wanted, "term").groupBy("query_id", *keys).agg(F.round(F.sum(F.col("weight") * F.col("idf")), 9).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), *keys], k)


def bm25(post: DataFrame, idf: DataFrame, queries: DataFrame, keys: list[str], k: int | None = None, config: str = "simple") -> DataFrame:
    """`query_id`, `keys`, `score`, `rank`: chunks sharing a term with a query, the k best of each; ties by key.

    `post` is an index that is kept; its rows are joined with the queries'
    terms before anything is aggregated.
    """
    wanted = query_terms(queries, config).join(idf, "term")
    hits = post.select(*keys, "term", "weight").join(wanted, "term")
    scored = hits.groupBy("query_id", *keys).agg(F.round(F.sum(F.col("weight") * F.col("idf")), 9).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), *keys], k)


def ranked(df: DataFrame, by: list[str], order: list, k: int | None = None, name: str = "rank") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.filter(F.col(name) <= k) if k else out


#: Queries of a dense search sent to the vectors at once.
QUERY_BLOCK = 1024


def dense(vectors: DataFrame, queries: DataFrame, key: str, k: int, kind: str | None = None) -> DataFrame:
    """Exact cosine search: `query_id`, `key`, `score`, `rank` (and `kind`, ranks restarting for each).

    The queries are a stated set, read block by block; each block goes to every
    partition of the vectors, where scores are matrix products and only the k
    best of each query (and kind) leave a task. Null ids and vectors of
    another length than the query's match nothing; ties go by key.
    """
    asked = queries.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q")).filter("q IS NOT NULL")
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    own = vectors.select(F.col(key).cast("long").alias("key"), (F.col(kind).cast("string") if kind else F.lit("")).alias("kind"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).filter("key IS NOT NULL AND v IS NOT NULL")
    out = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        best = own.mapInArrow(_nearest([r["query_id"] for r in rows], [r["q"] for r in rows], k), "query_id long, key long, kind string, score double")
        out = best if out is None else out.unionByName(best)
    out = out.withColumn("score", F.round("score", 9))
    out = ranked(out, ["query_id", "kind"], [F.desc("score"), "key"], k)
    out = out.select("query_id", F.col("key").alias(key), *([F.col("kind").alias(kind)] if kind else []), "score", "rank")
    return out


def _nearest(ids: list, rows: list, k: int):
    """The function that finds, for each batch of (key, kind, v), the k best of every query and kind."""
    import numpy as np

    by: dict[int, tuple] = {}
    for size in {len(r) for r in rows}:
        pick = [i for i, r in enumerate(rows) if len(r) == size]
        q = np.array([rows[i] for i in pick], float).reshape(len(pick), size)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        by[size] = (np.array([ids[i] for i in pick], np.int64), q / np.where(norm > 0, norm, 1))

    def work(batches):
        import pyarrow as pa

        held: dict[tuple, tuple] = {}
        for batch in batches:
            keys, kinds = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            edge = np.concatenate([[0], np.cumsum(lengths)])
            for size, (query, q) in by.items():
                rows = np.flatnonzero(lengths == size)
                if not size or not len(rows):
                    continue
                v = flat[edge[rows][:, None] + np.arange(size)]
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(norm > 0, norm, 1)
                for name in dict.fromkeys(kinds[rows].tolist()):
                    mine = kinds[rows] == name if name is not None else np.array([x is None for x in kinds[rows]])
                    score = np.round(q @ v[mine].T, 9)
                    own = np.broadcast_to(keys[rows][mine], score.shape)
                    if (size, name) in held:
                        own, score = np.concatenate([held[size, name][0], own], 1), np.concatenate([held[size, name][1], score], 1)
                    top = np.lexsort((own, -score), axis=1)[:, :k]
                    held[size, name] = (np.take_along_axis(own, top, 1), np.take_along_axis(score, top, 1))
        for (size, name), (own, score) in held.items():
            query, n = by[size][0], own.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, n)), pa.array(own.ravel()), pa.array([name] * (n * len(query)), pa.string()), pa.array(score.ravel())], names=["query_id", "key", "kind", "score"])

    return work


def hard_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every condition: a scalar is exact, a list means any (none: nothing), a (low, high) tuple is an inclusive range; null never meets one."""
    for c, w in wanted.items():
        if isinstance(w, tuple):
            low, high = w
            if low is None and high is None or None not in w and low > high:
                raise ValueError(f"{c}: a range needs a bound, the low one first")
            df = df.filter((F.col(c) >= low) if high is None else (F.col(c) <= high) if low is None else F.col(c).between(low, high))
        elif isinstance(w, (list, set)):
            df = df.filter(F.col(c).isin(*w) if w else F.lit(False))
        else:
            df = df.filter(F.col(c) == w)
    return df


def year_bounds(year: int | tuple[int | None, int | None] | None) -> tuple[int | None, int | None] | None:
    """A year as an inclusive range: a single one is both bounds."""
    return (year, year) if isinstance(year, int) else year


def in_scope(points: DataFrame, active: DataFrame, filters: dict) -> DataFrame:
    """Points of active generations that meet the filters; null filters are left out, and without an active generation there are none.

    `pages` is a range that any of a point's `page_numbers` may meet.
    """
    own = points.join(sized_broadcast(active.select("generation_id"), 100_000), "generation_id", "left_semi")
    given = {k: v for k, v in filters.items() if v is not None}
    pages = given.pop("pages", None)
    if "fiscal_year" in given:
        given["fiscal_year"] = year_bounds(given["fiscal_year"])
    if pages is not None:
        low, high = (F.lit(x) for x in (pages if isinstance(pages, tuple) else (pages, pages)))
        own = own.filter(F.exists("page_numbers", lambda p: (low.isNull() | (p >= low)) & (high.isNull() | (p <= high))))
    return hard_filter(own, **given)


def filtered_count(points: DataFrame, active: DataFrame, filters: dict) -> int:
    return in_scope(points, active, filters).count()


def allocate(df: DataFrame, limit: int, kind: str, first: str, share: float = 0.6, by: list[str] = ["query_id"], rank: str = "rank") -> DataFrame:  # noqa: B006
    """`limit` rows of each query, a floor for both kinds of evidence, then the leftovers, the `first` kind before the other."""
    floor = max(min(round(share * limit), limit - 1), 1) if limit > 1 else limit
    floors = F.when(F.col(kind) == first, floor).otherwise(limit - floor)
    order = [F.when(F.col(rank) <= floors, 0).otherwise(1), F.when(F.col(kind) == first, 0).otherwise(1), F.col(rank)]
    return ranked(df, by, order, limit, "place")


def fuse(lists: DataFrame, key: str, k: int = 60, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion over (`query_id`, `retriever`, `key`, `rank`); `contributions` has each retriever's best rank."""
    best = lists.groupBy("query_id", key, "retriever").agg(F.min("rank").alias("best"), F.sum(1.0 / (F.col("rank") + F.lit(k))).alias("part"))
    out = best.groupBy("query_id", key).agg(F.round(F.sum("part"), 12).alias("score"), F.min("best").alias("best"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "best")))).alias("contributions"))
    return ranked(out, ["query_id"], [F.desc("score"), "best", key], limit, "place")


def greedy_dedupe(items: Column) -> Column:
    """Of ranked structs with `elements`, those that share none with one kept before; without elements all stay."""
    empty = F.slice(items, F.lit(1), F.lit(0))
    return F.aggregate(items, empty, lambda kept, c: F.when(F.exists(kept, lambda h: F.arrays_overlap(h["elements"], c["elements"])), kept).otherwise(F.array_append(kept, c)))


def within_budget(items: Column, budget: int) -> Column:
    """Of ranked structs with `chars`, whole ones that fit the budget; the first always, later smaller ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(items, F.lit(1), F.lit(0)).alias("kept"))
    fits = lambda acc, c: (F.size(acc["kept"]) == 0) | (acc["used"] + c["chars"] <= budget)
    step = lambda acc, c: F.when(fits(acc, c), F.struct((acc["used"] + c["chars"]).alias("used"), F.array_append(acc["kept"], c).alias("kept"))).otherwise(acc)
    return F.aggregate(items, start, step, lambda acc: acc["kept"])


def edge_order(rank: Column) -> Column:
    """Sort key that puts odd ranks first, rising, then even ranks, falling."""
    odd = F.pmod(rank, F.lit(2)) == 1
    return F.struct((~odd).alias("later"), F.when(odd, rank.cast("long")).otherwise(-rank.cast("long")).alias("place"))
