"""Secret scans with multipart credential linking.

Three strict kinds (`BASE`) are always reported. Weaker parts (access
identifiers, secret-looking strings, endpoints) are only candidates: within a
scope (a paragraph) the parts' intervals, widened by `reach`, are interval-joined,
and a weak part is reported only if a complementary part meets it: a secret with
an identifier or an endpoint. Base `assign` and `hex` spans serve as secrets,
`access` as an identifier.

Defined results: null and empty texts have no spans; repeated rows get equal
spans; an empty table gives an empty result; extra columns pass through. Spans
are code points, the end exclusive. Each text is scanned on its own, so a lost
task is simply run again.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
ORDER = {k: i for i, k in enumerate((*BASE, *WEAK))}
REACH = 200

_any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + f"|{_any_case('api')}_?{_any_case('key')}"
_ASSIGN = re.compile(rf"(?:{_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("pass", "secret", "token", "api")
_NAMES = "|".join(map(_any_case, ("username", "user", "login", "clientid", "client_id", "access_key_id", "accesskeyid", "account")))
_IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9])(?:{_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{{3,}})")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"(?<![A-Za-z0-9])(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+")
_BREAK = re.compile(r"\n[\x20\t]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(h in low for h in _HINTS):
            found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], ORDER[x[2]]))


def _looks_secret(s: str) -> bool:
    s = s.rstrip("=")
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= 3.5


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """The weak parts that meet a complementary part within `reach` in their scope."""
    endpoints = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)] if "://" in text else []
    named = [(m.start(1), m.end(1), "identifier") for m in _IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    base_ids = [x for x in base if x[2] == "access"]
    if not endpoints and not named and not base_ids:
        return []
    taken = sorted([(s, e) for s, e, _ in (*base, *endpoints, *named)])
    starts, tops = [s for s, _ in taken], []
    for _, e in taken:
        tops.append(max(e, tops[-1] if tops else e))
    secrets = []
    for m in _SECRET.finditer(text):
        i = bisect.bisect_left(starts, m.end()) - 1
        if (i < 0 or tops[i] <= m.start()) and _looks_secret(m[0]):
            secrets.append((m.start(), m.end(), "secret"))
    scopes = [m.start() for m in _BREAK.finditer(text)]
    scope = lambda x: bisect.bisect_right(scopes, x[0])
    either = sorted([*endpoints, *named, *base_ids])
    holders = sorted([*secrets, *(x for x in base if x[2] in ("assign", "hex"))])

    def meets(parts: list, others: list) -> list:
        """The parts that some other interval of their scope comes within reach of.

        One sweep in order of start: per scope, of the intervals that begin
        before a part's end plus reach, only the two that end last can matter
        (one may be the part itself).
        """
        ends: dict[int, list] = {}
        out, i = [], 0
        for p in sorted(parts, key=lambda x: x[1]):
            while i < len(others) and others[i][0] <= p[1] + reach:
                own = ends.setdefault(scope(others[i]), [])
                own.append(others[i])
                if len(own) > 2:
                    own.remove(min(own, key=lambda x: x[1]))
                i += 1
            if any(o[1] >= p[0] - reach and o != p for o in ends.get(scope(p), ())):
                out.append(p)
        return out

    return [*meets(secrets, either), *meets(sorted([*endpoints, *named]), holders)]


def spans_of(text: str | None, reach: int = REACH) -> list[tuple[int, int, str]]:
    base = base_spans(text or "")
    return sorted([*base, *linked_spans(text or "", base, reach)], key=lambda x: (x[0], ORDER[x[2]], x[1]))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "spans", reach: int = REACH, redact: str | None = None) -> DataFrame:
    """`docs` with `out`, the spans of each text; with `redact`, a template such as "[{}]", also with the spans' text replaced by their kind.

    A column of `docs` that is called like `out` gives way to it; the text column can't.
    """
    if out.lower() == text_col.lower():
        raise ValueError("`out` is the text column")
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, _SPANS)])
    at = [c.lower() for c in keep].index(text_col.lower())

    def scan(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            found = [spans_of(t, reach) for t in texts]
            columns = list(b.columns)
            if redact is not None:
                columns[at] = pa.array([redacted(t, s, redact) if s else t for t, s in zip(texts, found)], b.schema.field(at).type)
            made = pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in found], _ARROW)
            yield pa.RecordBatch.from_arrays([*columns, made], names=[*b.schema.names, out])

    return docs.mapInArrow(scan, schema)


def redacted(text: str, spans: list[tuple[int, int, str]], template: str) -> str:
    """The text with spans replaced; where spans overlap, the first to start stands for all it touches."""
    parts, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            parts += [text[at:s], template.format(kind)]
            at = e
        else:
            at = max(at, e)
    return "".join([*parts, text[at:]])


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def op8_secret_linking(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in BASE), F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
