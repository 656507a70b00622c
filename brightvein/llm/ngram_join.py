"""N-gram Jaccard self-join of documents by a size-aware heavy-light scheme, and its connected components.

A document's set is that of its five-word shingles. Equal sets are one class;
classes whose Jaccard likeness is `SIMILAR` percent or more are linked. Links
are exact: every filter below only leaves out pairs that cannot be linked.

Light part. Two sets of sizes n <= m are linked just when they share
c(n, m) = ceil(S(n + m) / (100 + S)) shingles, so each small set emits its
c-subsets; equal subsets are links. Its cost grows as a binomial, so it serves
sets up to a boundary.

Heavy part. Larger sets scan inverted lists:
 1. Of each set the lowest hashes are listed, `n - ceil(0.8 n) + 1 + n // 10`
    of them. A linked pair shares more than n // 10 of these, so a set that
    shares fewer with any other set is done (most are).
 2. The sets of those that remain are read again. Their shingles are ordered,
    those of one set only first and frequent ones last, and a prefix of
    n - ceil(0.8 n) + 1 is indexed: linked pairs share a shingle of it.
 3. Lists are not joined with themselves at once. In each round every list
    tests its members against one hub only; what links is contracted. Only
    members still in different components are then tested pairwise, unless
    what they share with the hub and beyond it is too little for a link.

The boundary is where the summed costs, from the histogram of set sizes, are
least. Hashes have 64 bits; within a pair of sets a chance match is about
|a||b| / 2**64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _shingles
from ._components import components
from ._shared import discard, fresh_name, materialise, rows_of, small, text_of

SHINGLE = 5
SIMILAR = 80
#: Sizes among which the boundary is sought; the sets of these sizes are kept whole.
SMALL = 24
#: A shingle in more lists than this comes last in the order ...
FREQUENT = 16
#: ... and that many such shingles are told at most (a higher bar is set where there are more).
FREQUENT_MOST = 500_000
HUB_ROUNDS = 6
#: Slots of the bit table of shared shingles, as a power of two: 16 MB.
SHARED_BITS = 27
#: Rows up to which a table of ids or hashes is broadcast, some 70 bytes each in memory: 14 MB. Beyond, it is joined by a shuffle.
BROADCAST = 200_000


def overlap(n: int, m: int) -> int:
    """Shingles that sets of sizes n and m share at least if linked."""
    return -(-SIMILAR * (n + m) // (100 + SIMILAR))


def needed(n: int) -> int:
    """Shingles of a set of size n that any linked set shares at least."""
    return -(-SIMILAR * n // 100)


def partners(n: int) -> range:
    return range(needed(n), 100 * n // SIMILAR + 1)


def subsets(n: int) -> int:
    """Rows a set of size n emits in the light part."""
    return sum(math.comb(n, overlap(n, m)) for m in partners(n))


def boundary(sizes: dict[int, int]) -> int:
    """The size up to which enumerating subsets costs least in all; `sizes` counts the sets of each size up to SMALL."""
    heavy = lambda n: 6 * (n - needed(n) + 1 + n // 10) + n  # noqa: E731  postings, counted, joined and read again
    best = (math.inf, 0)
    for b in range(SMALL * SIMILAR // 100 + 1):
        cost = sum(c * subsets(n) for n, c in sizes.items() if n <= b) + sum(c * heavy(n) for n, c in sizes.items() if n >= needed(b + 1))
        best = min(best, (cost, b))
    return best[1]


def _sets(docs: DataFrame, cut: bool) -> DataFrame:
    """Of `docs` (doc_id, th, text): `doc_id`, `th`, `n`, the class id `cid` and `tokens`: the set's lowest hashes (`cut`) or all, ascending.

    `cid` is a hash of the whole set.
    """

    def work(batches):
        for b in _shingles.trimmed(batches):
            for at, data, offsets in _shingles.steps(b.column(2)):
                _, _, h, first = _shingles.words(data, offsets)
                grams, edge = _shingles.shingles(h, first, SHINGLE)
                held, sizes, cids = [], [], []
                for i in range(len(edge) - 1):
                    own = np.unique(grams[edge[i] : edge[i + 1]])
                    n = len(own)
                    mixed = _shingles.mix(own + np.uint64(n))
                    cids.append(int((_shingles.mix(mixed.sum(dtype=np.uint64).reshape(1)) ^ np.bitwise_xor.reduce(mixed))[0].astype(np.int64)) if n else 0)
                    sizes.append(n)
                    held.append(own[: n - needed(n) + 1 + n // 10] if cut and n > SMALL else own)
                counts = np.array(list(map(len, held)), np.int64)
                values = np.concatenate(held) if held else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sizes)), b.column(1).slice(at, len(sizes)), pa.array(sizes, pa.int32()), pa.array(cids, pa.int64()), lists], names=["doc_id", "th", "n", "cid", "tokens"])

    return docs.select("doc_id", "th", "text").mapInArrow(work, "doc_id long, th long, n int, cid long, tokens array<long>")


def _light_labels(classes: DataFrame, most: int) -> DataFrame | None:
    """Components of the links among classes of size `most` or less: subsets met by a class of either size, each tied to the least class there; None without links."""

    def work(batches):
        from itertools import combinations

        for b in _shingles.trimmed(batches):
            rows = []
            for cid, n, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = np.array(own, np.int64).view(np.uint64)
                for m in partners(n):
                    if m <= most:
                        for part in combinations(range(n), overlap(n, m)):
                            key = _shingles.mix(_shingles.mix(own[list(part)]).sum(dtype=np.uint64).reshape(1) + np.uint64(min(n, m) * 64 + max(n, m)))
                            rows.append((int(key[0].astype(np.int64)), cid, n, m))
            if rows:
                key, cid, n, m = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(cid, pa.int64()), pa.array(n, pa.int32()), pa.array(m, pa.int32())], names=["key", "cid", "n", "m"])

    keys = classes.filter(f"n BETWEEN 1 AND {most}").select("cid", "n", "tokens").mapInArrow(work, "key long, cid long, n int, m int")
    keys = materialise(keys, "subsets")
    met = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("c"))
    met = met.filter("c > 1").select(F.col("key").alias("k"), "hub", "lo", "hi")
    links = materialise(keys.join(met, F.col("key") == F.col("k")).filter("cid <> hub AND (n = m OR lo <> hi)").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct(), "light_links")
    labels = components(links) if rows_of(links) else None
    discard(keys, links)
    return labels


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with `shared`, the shingles they have in common, `beyond`, the frequent ones of `a` that `b` lacks, and whether they are `linked`.

    The set of `a` travels with the pair to that of `b`.
    """
    first = pairs.join(sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"), F.col("late").alias("la")), "a")
    both = first.join(sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("ta", "tb"))).withColumn("beyond", F.size("la") - F.size(F.array_intersect("la", "tb")))
    return both.select("a", "b", "shared", "beyond", (100 * F.col("shared") >= SIMILAR * (F.col("na") + F.col("nb") - F.col("shared"))).alias("linked"))


def _candidate_classes(heavy: DataFrame) -> DataFrame:
    """The classes that share enough low hashes with others to be linked at all (`cid`)."""
    listed = heavy.select("cid", "n", F.explode(F.expr(f"slice(tokens, 1, n - CAST(ceil({SIMILAR} * n / 100D - 1e-9) AS INT) + 1 + n DIV 10)")).alias("t"))
    common = materialise(listed.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1").select("t"), "common")
    met = listed.join(small(common, BROADCAST), "t").groupBy("cid", "n").agg(F.count("*").alias("s"))
    out = materialise(met.filter("s > n DIV 10").select("cid"), "candidates")
    discard(common)
    return out


def _ordering(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """What orders the shingles: a bit table that has every shingle of two sets or more, and the frequent ones, ascending.

    The table has SHARED_BITS slots and the list FREQUENT_MOST entries, whatever
    the corpus. Shingles that share a slot with a shared one count as shared,
    which costs time only.
    """
    counts = materialise(sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    slot = F.col("t").bitwiseAND(F.lit((1 << SHARED_BITS) - 1)) + 1
    rows = counts.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    table = np.zeros((1 << SHARED_BITS) // 8, np.uint8)
    for r in rows:
        table[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    bar = FREQUENT
    while counts.filter(f"c > {bar}").count() > FREQUENT_MOST:
        bar *= 2
    frequent = np.array(sorted(r["t"] for r in counts.filter(f"c > {bar}").select("t").collect()), np.int64)
    discard(counts)
    return table, frequent


def _ordered(sets: DataFrame, table: np.ndarray, frequent: np.ndarray) -> DataFrame:
    """`cid`, `n`, and of each set: `tokens`, its shingles that other sets may have too; `late`, the frequent ones of these; `prefix`, what is indexed.

    In the order of the prefix, shingles of one set come first (they meet no
    other and are left out), then the rare ones by hash, then the frequent ones.
    """
    held = sets.sparkSession.sparkContext.broadcast((table, frequent))

    def work(batches):
        bits, late = held.value
        for b in _shingles.trimmed(batches):
            every, lates, prefixes = [], [], []
            for n, own in zip(b.column(1).to_pylist(), b.column(2)):
                own = np.asarray(own.values)
                slot = own & ((1 << SHARED_BITS) - 1)
                own = own[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                at = np.searchsorted(late, own)
                is_late = late[np.minimum(at, len(late) - 1)] == own if len(late) else np.zeros(len(own), bool)
                room = max(n - needed(n) + 1 - (n - len(own)), 0)
                every.append(own)
                lates.append(own[is_late])
                prefixes.append(np.concatenate([own[~is_late], own[is_late]])[:room])
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(list(map(len, x)))]).astype(np.int32)), pa.array(np.concatenate(x))) for x in (every, lates, prefixes) if x]
            if lists:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["cid", "n", "tokens", "late", "prefix"])

    return sets.select("cid", "n", "tokens").mapInArrow(work, "cid long, n int, tokens array<long>, late array<long>, prefix array<long>")


def _heavy_labels(docs: DataFrame, heavy: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """The components of `labels` (node, label) joined by the links among the large classes; None if there are no links at all."""
    chosen = _candidate_classes(heavy)
    own = materialise(heavy.join(small(chosen, BROADCAST), "cid").select("cid", F.col("rep").alias("r")), "chosen")
    # the sets are read from the texts again, for the chosen classes' first documents only
    texts = docs.join(small(own.select("r").distinct(), BROADCAST, own), F.col("doc_id").eqNullSafe(F.col("r"))).select("doc_id", "th", "text")
    sets = _sets(texts, cut=False).join(small(own.select("cid"), BROADCAST, own), "cid").select("cid", "n", "tokens")
    sets = materialise(sets, "sets")
    if rows_of(sets) != rows_of(own):  # rows that share id and text
        once = materialise(sets.dropDuplicates(["cid"]), "sets1")
        discard(sets)
        sets = once
    table, frequent = _ordering(sets)
    ordered = materialise(_ordered(sets, table, frequent), "ordered")
    discard(sets, own, chosen)
    sets = ordered
    # a prefix has its rare shingles first, so those from place u - l on are the frequent ones
    index = sets.select(F.posexplode("prefix").alias("at", "t"), "cid", "n", F.size("tokens").alias("u"), F.size("late").alias("l"))
    index = index.select("t", "cid", "n", "u", (F.col("at") >= F.col("u") - F.col("l")).alias("is_late"))
    met = index.groupBy("t").agg(F.count("*").alias("c"), F.max("is_late").alias("is_late")).filter("c > 1")
    # only lists of shingles that the order puts last: what `_still_open` leaves out rests on that
    met = met.select("t", ((F.col("c") > FREQUENT) & F.col("is_late")).alias("long"))
    lists = materialise(index.drop("is_late").join(met, "t").withColumn("share", F.col("u") / F.col("n")), "lists")
    postings = rows_of(lists)
    done = [ordered, lists]
    seen = info = None
    near = f"100 * least(n, hn) >= {SIMILAR} * greatest(n, hn) AND {100 + SIMILAR} * least(u, hu) >= {SIMILAR} * (n + hn)"
    had = math.inf
    for turn in range(HUB_ROUNDS + 1):
        now = lists.withColumn("label", F.col("cid")) if labels is None else lists.join(small(labels, BROADCAST), F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid")).drop("node")
        still = materialise(_open(now), "open")
        done.append(still)
        work = still.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2)).first()[0] or 0
        if not work:
            break
        ending = turn == HUB_ROUNDS or (turn > 0 and (work <= 2 * postings or work > had / 2))
        had = work
        if ending:
            now = _still_open(now, info)
            now = materialise(now.join(_open(now).select(F.col("t").alias("t3")), F.col("t") == F.col("t3")).drop("t3"), "ending")
            done.append(now)
            other = now.select(F.col("t").alias("t2"), F.col("cid").alias("hub"), F.col("n").alias("hn"), F.col("u").alias("hu"), F.col("label").alias("hl"), F.col("shared").alias("hs"), F.col("beyond").alias("hb"))
            reach = F.expr(f"shared IS NULL OR hs IS NULL OR {100 + SIMILAR} * (least(shared, hs) + least(beyond, hb)) >= {SIMILAR} * (n + hn)")
            pairs = now.join(other, (F.col("t") == F.col("t2")) & (F.col("cid") < F.col("hub")) & (F.col("label") != F.col("hl")) & F.expr(near) & reach)
        else:
            now = now.join(small(still.select("t"), BROADCAST), "t")
            order = F.struct("share", "cid", "n", "u", "label") if turn == 0 else F.struct(F.xxhash64(F.lit(turn), "cid").alias("share"), "cid", "n", "u", "label")
            hubs = now.groupBy("t").agg(F.max(order).alias("h")).select(F.col("t").alias("t2"), F.col("h.cid").alias("hub"), F.col("h.n").alias("hn"), F.col("h.u").alias("hu"), F.col("h.label").alias("hl"))
            pairs = now.join(small(hubs, BROADCAST // 2, still), F.col("t") == F.col("t2")).filter(F.col("label") != F.col("hl"))
            pairs = pairs.filter(F.col("long") | F.expr(near)) if turn == 0 else pairs.filter(near)
        pairs = pairs.select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        tested = materialise(_overlaps(pairs, sets), f"tested{turn}")
        done.append(tested)
        linked = tested.filter("linked").select("a", "b")
        if linked.limit(1).count():
            had_labels, labels = labels, components(linked, labels)
            discard(*([had_labels] if had_labels is not None else []))
        if ending:
            break
        if turn == 0:
            firsts = lists.filter("long").groupBy("t").agg(F.max(F.struct("share", "cid")).alias("h")).select(F.col("t").alias("t4"), F.col("h.cid").alias("h4"))
            info = (firsts, tested.select(F.col("a").alias("a4"), F.col("b").alias("b4"), "shared", "beyond"))
        both = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = both if seen is None else seen.unionByName(both)
    discard(*done)
    return labels


def _open(lists: DataFrame) -> DataFrame:
    """The lists `t` with members in several components: `m` members, `s` the sum of the squares of each component's."""
    return lists.groupBy("t", "label").agg(F.count("*").alias("c")).groupBy("t").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s")).filter("m * m > s")


def _still_open(lists: DataFrame, info) -> DataFrame:
    """The members that may yet be linked within their list, with `shared` and `beyond` as against the first hub of a long list.

    Long lists are those of frequent shingles alone, by the bar that `_ordering`
    took; all others keep every member.

    Two members of a long list that share a rare shingle also meet in that
    one's list: where a frequent one is in both prefixes, all their rare ones
    are too. Otherwise they share frequent shingles only: those of the hub that
    both have, and some that neither shares with it. So at most
    min(shared) + min(beyond), and a member that stays below what a link to the
    least set of the list takes is left out.
    """
    firsts, tested = info
    known = lists.filter("long").join(firsts, F.col("t") == F.col("t4")).filter("cid <> h4")
    known = known.join(tested, (F.col("cid") == F.col("a4")) & (F.col("h4") == F.col("b4")), "left").drop("t4", "h4", "a4", "b4")
    least = known.groupBy("t").agg(F.min("n").alias("least")).withColumnRenamed("t", "t4")
    known = known.join(least, F.col("t") == F.col("t4")).filter(f"shared IS NULL OR {100 + SIMILAR} * (shared + beyond) >= {SIMILAR} * (n + greatest(least, CAST(ceil({SIMILAR} * n / 100D - 1e-9) AS INT)))").drop("t4", "least")
    rest = lists.filter("NOT long").withColumn("shared", F.lit(None).cast("int")).withColumn("beyond", F.lit(None).cast("int"))
    return known.unionByName(rest)


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row of `docs`: `doc_id`, `th` (a hash of its text), `n` and, unless it has no shingles, its component's `label` and least id `component_id`."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text")).withColumn("th", F.xxhash64("text"))
    cut = materialise(_sets(docs, cut=True), "cut")
    classes = cut.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    classes = materialise(classes, "classes")
    sizes = {r["n"]: r["count"] for r in classes.filter(f"n <= {SMALL}").groupBy("n").count().collect()}
    most = boundary(sizes)
    reps = cut.filter("n > 0").select("cid", "n", "tokens", F.col("doc_id").alias("d")).join(classes.select(F.col("cid").alias("c"), "rep"), (F.col("cid") == F.col("c")) & F.col("d").eqNullSafe(F.col("rep"))).drop("c", "d")
    light = materialise(reps.filter(f"n <= {most}").dropDuplicates(["cid"]), "light")
    labels = _light_labels(light, most) if most else None
    heavy = reps.filter(f"n >= {max(needed(most + 1), 1)}")
    if cut.groupBy("cid", "doc_id").count().filter("count > 1").limit(1).count():
        heavy = heavy.dropDuplicates(["cid"])
    labels = _heavy_labels(docs, heavy, labels)
    discard(light)
    named = classes.withColumn("label", F.col("cid"))
    if labels is not None:
        named = classes.join(labels, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("label", "cid").alias("label"))
    named = materialise(named, "named")
    discard(classes, *([labels] if labels is not None else []))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = named.join(least, "label").select(F.col("cid").alias("c"), "label", "component_id")
    return cut.select("doc_id", "th", "n", "cid").join(by_class, (F.col("cid") == F.col("c")) & (F.col("n") > 0), "left").select("doc_id", "th", "n", "label", "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: `doc_id`, `n_shingles`, `component_id`.

    Defined results: null and empty texts have no shingles, are linked with
    nothing and form their own component; rows with equal sets are linked; a
    component bears its least document id (null if it has none); repeated ids
    are separate rows; an empty table gives an empty result; other columns are
    not read, whatever they are called.
    """
    out = _labelled(docs, id_col, text_col)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without copies: of each component one row stays.

    That is the row with the least id (null ids last), of equal ids the one
    whose text has the least hash. Rows without shingles are linked with
    nothing and stay, but rows that share id and text are one document's
    repeats, of which the first by their other columns stays. A row is known by
    its id and a hash of its text, so an id may be used for several texts.
    """
    found = materialise(_labelled(docs, id_col, text_col), "found")
    chosen = found.filter("n > 0").groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("z"), "doc_id", "th")).alias("m")).select("m.doc_id", "m.th")
    stays = chosen.unionByName(found.filter("n = 0").select("doc_id", "th").distinct())
    repeats = found.groupBy("doc_id", "th").count().filter("count > 1").limit(1).count()
    i, h, nth = (fresh_name(x, docs.columns) for x in ("stay_id", "stay_hash", "nth"))
    stays = stays.select(F.col("doc_id").alias(i), F.col("th").alias(h))
    own = (F.col(f"`{id_col}`").cast("long"), F.xxhash64(text_of(F.col(f"`{text_col}`"))))
    kept = docs.join(stays, own[0].eqNullSafe(F.col(i)) & (own[1] == F.col(h)))
    if repeats:
        order = [F.col(f"`{f.name}`") for f in docs.schema.fields if not _has_map(f.dataType)]
        kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(i, h).orderBy(*order))).filter(F.col(nth) == 1).drop(nth)
    return kept.drop(i, h)


def _has_map(kind: T.DataType) -> bool:
    """Whether Spark can't order by a column of this type."""
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def op10_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
