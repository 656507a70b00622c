"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Generators with high recall propose spans, which may overlap. Four strict kinds
(`BASE`) are redacted whenever their format holds. The wider kinds (`WIDE`) are
only candidates: boosted trees score each from its format and its context, and
a span is selected if its calibrated probability reaches the kind's threshold
and no base span overlaps it; of overlapping selected spans the most probable
stays, then the leftmost.

The trees are fitted here, on a bounded set of labelled snippets (`SNIPPETS`)
made by a seeded rule; half of them are held out for calibration. They are
scored as plain CASE expressions. Every regular expression is written so that
its scan is linear in the text.

Defined results: null and empty texts have no spans; repeated rows get equal
spans; an empty table gives an empty result; extra columns pass through.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh_name, text_of

#: kind -> (pattern, condition on the match m)
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"forall(split(m, '\\.'), p -> p rlike '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(m, '[^0-9]', ''))"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 15"),
}
WIDE = {
    "email_spelt": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}){1,8}",
    "phone_local": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "mac": r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Za-z:-])",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "email_spelt": "[\\[(](at|AT)[\\])]", "mac": "[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"}
#: Features of a candidate, as SQL over k (kind), m (match), b (text before) and a (text after).
FEATURES = {
    "digits": "length(regexp_replace(m, '[^0-9]', ''))",
    "letters": "length(regexp_replace(m, '[^A-Za-z]', ''))",
    "marks": r"length(regexp_replace(m, '[^ .()\\[\\]:-]', ''))",
    "spread": "size(array_distinct(split(regexp_replace(m, '[^0-9]', ''), '')))",
    "named": "CAST(b rlike '(?i)(phone|tel|call|fax|mobile|ssn|social|security|iban|account|mail|contact|reach|write|device|adapter|mac|hardware)[^0-9A-Za-z]*([a-z]+[^0-9A-Za-z]*){0,2}$' AS INT)",
    "numbered": "CAST(b rlike '(?i)(order|invoice|version|isbn|ref|item|sku|total|page|serial|part|build|score|batch|lot)[^0-9A-Za-z]*([a-z]+[^0-9A-Za-z]*){0,2}$' AS INT)",
    "area": "CAST(m rlike '^[(]?[2-9][0-9]{2}[)]?[ .-][2-9]' AS INT)",
    "issued": "CAST(m rlike '^(?!000|666|9)[0-9]{3}.(?!00)[0-9]{2}.(?!0000)' AS INT)",
    "checked": "CAST(CASE WHEN k <> 'iban' THEN false ELSE aggregate(split(concat(substring(regexp_replace(m, ' ', ''), 5), substring(regexp_replace(m, ' ', ''), 1, 4)), ''), 0L, (s, c) -> CASE WHEN c rlike '[A-Z]' THEN (s * 100 + ascii(c) - 55) % 97 WHEN c rlike '[0-9]' THEN (s * 10 + CAST(c AS INT)) % 97 ELSE s END) = 1 END AS INT)",
    "kind": "array_position(array(" + ", ".join(f"'{k}'" for k in WIDE) + "), k)",
    "cut": "CAST(b rlike '[0-9A-Za-z_/#$=-]$' OR a rlike '^[0-9A-Za-z_/=-]' AS INT)",
    "sentence": r"CAST(a rlike '^([\\s.,;)!?]|$)' AS INT)",
}
#: Labelled snippets made for fitting; a bound of its own, not of the corpus.
SNIPPETS = 3000
TREES, DEPTH, RATE = 40, 3, 0.3
PRECISION = 0.98


def _spans(text: str, pattern: str, needs: str | None, context: bool) -> str:
    """SQL for array<struct<s, e, m[, b, a]>> of a pattern's matches in the column `text`.

    Matches and the gaps between them give the offsets. They are summed in
    chunks of 256, so a text with very many matches costs in proportion.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    extra = ", 'b', right(x.g, 40), 'a', left(x.n, 8)" if context else ""
    kind = "struct<s:int,e:int,m:string" + (",b:string,a:string>" if context else ">")
    rows = f"transform(regexp_extract_all({text}, '{p}', 0), (m, i) -> named_struct('m', m, 'i', i))"
    zipped = f"zip_with({rows}, split({text}, '{p}'), (x, g) -> named_struct('m', x.m, 'g', g))"
    if context:
        zipped = f"zip_with({zipped}, slice(split({text}, '{p}'), 2, 1000000000), (x, n) -> named_struct('m', x.m, 'g', x.g, 'n', n))"
    inner = f"aggregate(chunk, named_struct('p', acc.p, 'o', CAST(array() AS array<{kind}>)), (st, x) -> named_struct('p', st.p + length(x.g) + length(x.m), 'o', concat(st.o, array(named_struct('s', st.p + length(x.g), 'e', st.p + length(x.g) + length(x.m), 'm', x.m{extra})))))"
    total = "aggregate(chunk, acc.p, (t, x) -> t + length(x.g) + length(x.m))"
    chunked = f"element_at(transform(array(filter({zipped}, x -> x.m IS NOT NULL)), z -> transform(sequence(0, (size(z) - 1) DIV 256), c -> slice(z, c * 256 + 1, 256))), 1)"
    folded = f"flatten(aggregate({chunked}, named_struct('p', 0, 'o', CAST(array() AS array<array<{kind}>>)), (acc, chunk) -> named_struct('p', {total}, 'o', concat(acc.o, array({inner}.o)))).o)"
    some = f"regexp_instr({text}, '{p}') > 0"
    if needs:
        n = needs.replace("\\", "\\\\")
        some = (f"contains({text}, '{n}')" if len(needs) == 1 else f"{text} rlike '{n}'") + f" AND {some}"
    return f"CASE WHEN {some} THEN {folded} ELSE CAST(array() AS array<{kind}>) END"


def _base(text: str) -> dict[str, str]:
    return {k: f"transform(filter({_spans(text, p, NEEDS.get(k), False)}, y -> element_at(transform(array(y.m), m -> {ok}), 1)), y -> named_struct('k', '{k}', 's', y.s, 'e', y.e))" for k, (p, ok) in BASE.items()}


def _candidates(text: str) -> str:
    """SQL for array<struct<k, s, e, f>> of all wide candidates, f being their features."""
    each = []
    for k, p in WIDE.items():
        f = "array(" + ", ".join(f"CAST({x} AS INT)" for x in FEATURES.values()) + ")"
        for name in "kmba":
            f = _bound(f, name, f"'{k}'" if name == "k" else f"y.{name}")
        each.append(f"transform({_spans(text, p, NEEDS.get(k), True)}, y -> named_struct('k', '{k}', 's', y.s, 'e', y.e, 'f', {f}))")
    return f"concat({', '.join(each)})"


def _bound(sql: str, name: str, value: str) -> str:
    import re

    parts = re.split(r"('(?:[^'\\]|\\.)*')", sql)  # quoted strings stay
    return "".join(x if i % 2 else re.sub(rf"(?<![\w.]){name}(?![\w(.])", value, x) for i, x in enumerate(parts))


def _snippets(seed: int = 11) -> list[tuple[str, int]]:
    """Labelled snippets, each with one candidate: personal data in the contexts it has, and look-alikes in theirs."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "the", "re", "on", "ti", "lo", "mar", "ke", "su", "vi"]) for _ in range(r.randint(1, 4)))

    def iban(ok: bool) -> str:
        body, land = digits(r.choice([14, 16, 18])), r.choice(["DE", "FR", "ES", "GB"])
        rest = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        check = 98 - rest if ok else (98 - rest + r.randint(1, 90)) % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    phone = lambda ok: (f"({r.choice('23456789')}{digits(2)}) {r.choice('23456789')}{digits(2)}-{digits(4)}" if r.random() < 0.5 else f"{r.choice('23456789')}{digits(2)}-{r.choice('23456789')}{digits(2)}-{digits(4)}") if ok else f"{r.choice('01')}{digits(2)}{r.choice(' .-')}{digits(3)}{r.choice(' .-')}{digits(4)}"
    person = lambda ok: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}" if ok else f"{r.choice(['000', '666', '9' + digits(2)])}{r.choice(' -')}{digits(2)}{r.choice(' -')}{digits(4)}"
    mac = lambda ok: ":".join(f"{r.randrange(256):02x}" for _ in range(6)) if ok else "-".join(digits(2) for _ in range(6))
    mail = lambda ok: f"{word()} {r.choice(['(at)', '[at]'])} {word()} {r.choice(['[dot]', '(dot)', '.'])} com"
    made = {"phone_local": phone, "national_id": person, "iban": iban, "mac": mac, "email_spelt": mail}
    good = {"phone_local": ["call", "phone:", "tel.", "fax", "mobile", "reach me at"], "national_id": ["SSN", "social security number", "SSN:"], "iban": ["IBAN", "account", "my account is"], "mac": ["MAC", "device", "adapter", "hardware address"], "email_spelt": ["mail", "write to", "contact", "email:"]}
    bad = ["order", "invoice", "version", "ref", "item", "serial", "part no.", "batch", "score", "lot"]
    out = []
    for i in range(SNIPPETS):
        kind = r.choice(list(made))
        case = i % 4
        if case == 0:  # named by its context
            out.append((f"{word()} {word()} {r.choice(good[kind])} {made[kind](True)}{r.choice(['.', ' ' + word(), ''])}", 1))
        elif case == 1:  # sound in format, its context silent
            out.append((f"{word()} {word()} {made[kind](True)} {word()}", int(kind in ("iban", "mac", "email_spelt") or r.random() < 0.3)))
        elif case == 2:  # numbers of another kind
            out.append((f"{word()} {r.choice(bad)} {made[kind](kind != 'iban' and r.random() < 0.5)} {word()}", int(kind == "email_spelt")))
        else:  # wrong in format
            out.append((f"{word()} {word()} {made[kind](False)}{r.choice(['.', '/' + word(), ' ' + word()])}", int(kind == "email_spelt")))
    return out


def _fit(rows: list[tuple[list[int], int]]) -> list:
    """Boosted trees for the logistic loss: nested (feature, threshold, low, high) down to leaf values."""
    score = [0.0] * len(rows)
    trees = []

    def grow(at: list[int], depth: int):
        prob = {i: 1 / (1 + math.exp(-score[i])) for i in at}
        g = {i: rows[i][1] - prob[i] for i in at}
        h = {i: prob[i] * (1 - prob[i]) + 1e-6 for i in at}
        gs, hs = sum(g.values()), sum(h.values())
        best = None
        if depth and len(at) >= 20:
            for f in range(len(rows[0][0])):
                by: dict[int, list[float]] = {}
                for i in at:
                    b = by.setdefault(rows[i][0][f], [0.0, 0.0])
                    b[0] += g[i]
                    b[1] += h[i]
                gl = hl = 0.0
                for v in sorted(by)[:-1]:
                    gl, hl = gl + by[v][0], hl + by[v][1]
                    gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                    if gain > 1e-3 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, f, v)
        if best is None:
            value = RATE * gs / (hs + 1)
            for i in at:
                moved[i] = value
            return value
        _, f, v = best
        return (f, v, grow([i for i in at if rows[i][0][f] <= v], depth - 1), grow([i for i in at if rows[i][0][f] > v], depth - 1))

    for _ in range(TREES):
        moved: dict[int, float] = {}
        trees.append(grow(list(range(len(rows))), DEPTH))
        for i, v in moved.items():
            score[i] += v
    return trees


def score_of(tree, f: list[int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.cache
def _model(features: tuple) -> tuple[list, dict[str, float]]:
    """Trees fitted on every other four rows; per kind, the least score at which the held-out ones reach PRECISION."""
    rows = [(list(f), y) for f, y in features]
    trees = _fit([r for i, r in enumerate(rows) if i // 4 % 2 == 0])
    at = list(FEATURES).index("kind")
    limits = {}
    for n, kind in enumerate(WIDE, 1):
        held = sorted(((sum(score_of(t, f) for t in trees), y) for i, (f, y) in enumerate(rows) if i // 4 % 2 and f[at] == n), reverse=True)
        best, hits = math.inf, 0
        for i, (s, y) in enumerate(held, 1):
            hits += y
            if hits / i >= PRECISION and s > 0 and (i == len(held) or held[i][0] < s):
                best = s
        limits[kind] = best
    return trees, limits


def train(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """Fit the trees on the snippets; their features come from the expressions that also serve the corpus."""
    made = _snippets()
    packed = "\u0001".join(t for t, _ in made)
    table = spark.range(1).select(F.posexplode(F.split(F.lit(packed), "\u0001")).alias("n", "text"))
    got = {r["n"]: r["f"] for r in table.select("n", F.expr(f"element_at(transform({_candidates('text')}, y -> y.f), 1)").alias("f")).filter("f IS NOT NULL").collect()}
    return _model(tuple((tuple(got[i]), y) for i, (_, y) in enumerate(made) if i in got))


def _tree_sql(tree, f: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"IF({f}[{tree[0]}] <= {tree[1]}, {_tree_sql(tree[2], f)}, {_tree_sql(tree[3], f)})"


def find_personal_data(docs: DataFrame, text_col: str = "text", out: str = "spans", model=None) -> DataFrame:
    """`docs` with `out`: array<struct<k, s, e>> of base spans by kind, then the selected wide ones by kind and start."""
    trees, limits = model or train(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    taken = [*docs.columns, out]
    text, strict, wide = (fresh_name(f"__pii_{x}", taken) for x in ("text", "base", "wide"))
    each = {k: fresh_name(f"__pii_{k}", taken) for k in BASE}
    df = docs.withColumn(text, text_of(F.col(f"`{text_col}`")))
    for k, sql in _base(text).items():
        df = df.withColumn(each[k], F.expr(sql))
    df = df.withColumn(strict, F.concat(*each.values()))
    total = " + ".join(_tree_sql(t, "y.f") for t in trees)
    limit = "CASE y.k " + " ".join(f"WHEN '{k}' THEN {('1e300' if math.isinf(v) else repr(v))}D" for k, v in limits.items()) + " END"
    scored = f"transform({_candidates(text)}, y -> named_struct('k', y.k, 's', y.s, 'e', y.e, 'v', {total}, 'l', {limit}))"
    df = df.withColumn(wide, F.expr(f"filter({scored}, y -> y.v >= y.l)"))
    chosen = F.expr(f"CASE WHEN size({wide}) > 0 THEN {_chosen(wide, strict)} ELSE CAST(array() AS {_SPANS}) END")
    return df.select(*(F.col(f"`{c}`") for c in keep), F.concat(F.col(strict), chosen).alias(out))


_SPANS = "array<struct<k:string,s:int,e:int>>"


def _chosen(wide: str, strict: str) -> str:
    """SQL for the selected wide spans: none that a base span overlaps, and of overlapping ones the most probable, then the leftmost.

    Spans are put in order of their start and cut into runs that overlap in a
    chain (base spans hold theirs); the choice is made within each run, so it
    costs in proportion to the text unless spans overlap each other.
    """
    order = f"array_sort(concat(transform({strict}, z -> named_struct('s', z.s, 'e', z.e, 'b', true, 'k', '', 'v', 0D)), transform({wide}, y -> named_struct('s', y.s, 'e', y.e, 'b', false, 'k', y.k, 'v', y.v))), (p, q) -> CASE WHEN p.s <> q.s THEN p.s - q.s WHEN p.b <> q.b THEN IF(p.b, -1, 1) WHEN p.v <> q.v THEN IF(p.v > q.v, -1, 1) ELSE p.e - q.e END)"
    ends = f"aggregate(chunk, named_struct('m', acc.m, 'o', CAST(array() AS array<int>)), (st, x) -> named_struct('m', greatest(st.m, x.e), 'o', concat(st.o, array(IF(x.s >= st.m, 1, 0))))) "
    chunks = f"element_at(transform(array({order}), z -> transform(sequence(0, (size(z) - 1) DIV 256), c -> slice(z, c * 256 + 1, 256))), 1)"
    marks = f"flatten(aggregate({chunks}, named_struct('m', -1, 'o', CAST(array() AS array<array<int>>)), (acc, chunk) -> element_at(transform(array({ends}), r -> named_struct('m', r.m, 'o', concat(acc.o, array(r.o)))), 1)).o)"
    both = f"zip_with({order}, {marks}, (x, m) -> named_struct('x', x, 'm', m))"
    heads = f"filter(transform({both}, (y, i) -> IF(y.m = 1, i, NULL)), i -> i IS NOT NULL)"
    runs = f"element_at(transform(array(named_struct('z', {order}, 'h', {heads})), r -> zip_with(r.h, concat(slice(r.h, 2, size(r.h)), array(size(r.z))), (a, b) -> slice(r.z, a + 1, b - a))), 1)"
    best = "array_sort(filter(run, y -> NOT y.b), (p, q) -> CASE WHEN p.v > q.v THEN -1 WHEN p.v < q.v THEN 1 WHEN p.s <> q.s THEN p.s - q.s ELSE p.e - q.e END)"
    apart = f"aggregate({best}, filter(run, z -> z.b), (acc, y) -> IF(exists(acc, z -> z.s < y.e AND y.s < z.e), acc, concat(acc, array(y))))"
    picked = f"flatten(transform({runs}, run -> IF(size(run) = 1, run, {apart})))"
    kinds = "array(" + ", ".join(f"'{k}'" for k in WIDE) + ")"
    sort = f"array_sort(filter({picked}, y -> NOT y.b), (p, q) -> CASE WHEN p.k <> q.k THEN CAST(array_position({kinds}, p.k) - array_position({kinds}, q.k) AS INT) ELSE p.s - q.s END)"
    return f"transform({sort}, y -> named_struct('k', y.k, 's', y.s, 'e', y.e))"


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """`docs` with every span of its text replaced by its kind's mask; where spans overlap, the first to start wins."""
    spans = fresh_name("__pii_spans", docs.columns)
    found = find_personal_data(docs, text_col, spans)
    sorted_spans = f"array_sort({spans}, (p, q) -> CASE WHEN p.s <> q.s THEN p.s - q.s ELSE q.e - p.e END)"
    left, right = mask.split("{}")
    body = f"aggregate({sorted_spans}, named_struct('p', 0, 't', ''), (acc, y) -> IF(y.s < acc.p, acc, named_struct('p', y.e, 't', concat(acc.t, substring(`{text_col}`, acc.p + 1, y.s - acc.p), '{left}', y.k, '{right}'))), acc -> concat(acc.t, substring(`{text_col}`, acc.p + 1)))"
    new = F.when(F.col(f"`{text_col}`").isNotNull(), F.expr(body))
    return found.withColumn(text_col, new).select(*(F.col(f"`{c}`") for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["k"] == kind)).cast("long")


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs)
    base = F.filter("spans", lambda x: x["k"].isin(*BASE))
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in BASE), F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
