"""Secret scans by linking the parts of credentials: an interval join within scopes.

Strong spans are reported as they are: assignments of secrets, access identifiers, long hexadecimal
runs. Weak candidates (account names, endpoints, random-looking runs) are common in clean text. So each
text is cut into scopes at blank lines, and a weak candidate is reported only when the parts that make
it a credential lie in its scope within REACH code points: a random run needs an identifier, an account
name needs a secret, an endpoint needs both.

The join is one by intervals: positions are cut into buckets as wide as REACH, each bucket of a scope
keeps the bounds of its parts for each role (pre-aggregated before the shuffle), and a candidate looks
at its own bucket and the next ones. So a text full of parts makes no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_rows, keep

REACH = 400
LEAST_SECRET, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 6, 20, 24, 20


def _either(words: str) -> str:
    """A group of ``words`` in which each ASCII letter stands in either case."""
    return "(?:" + re.sub("[a-z]", lambda m: f"[{m.group().upper()}{m.group()}]", words) + ")"


ASSIGN = _either("password|passwd|secret|token|api_?key") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"
HEX = rf"[0-9a-f]{{{LEAST_HEX},}}"
ACCOUNT = _either("username|user_?id|user|login|account|client_?id|access_?key_?id") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)"""
ENDPOINT = _either("https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp") + "://[A-Za-z0-9@._:/?&=%-]+"
RUN = rf"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}"
SCOPE = r"\n[\x20\x09\r]*\n"

#: Kinds in the order in which spans at one place are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "account", "endpoint", "run")
#: What each kind is a part of, and what a weak kind needs beside it.
_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "endpoint": "endpoint", "run": "secret"}
_NEEDS = {"account": ("secret",), "endpoint": ("identifier", "secret"), "run": ("identifier",)}
_STRONG = 3
_COMPILED = [re.compile(p, re.ASCII) for p in (ASSIGN, ACCESS, HEX, ACCOUNT, ENDPOINT, RUN)]
_SCOPE = re.compile(SCOPE, re.ASCII)


def _mixed(run: str) -> bool:
    return any("0" <= c <= "9" for c in run) and any("a" <= c <= "z" for c in run) and any("A" <= c <= "Z" for c in run)


def parts(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, scope) of the strong spans and the weak candidates of a text, by start and kind.

    A weak candidate that overlaps a strong span or a weak kind listed before it is none.
    """
    found: list[tuple[int, int, int]] = []
    for kind, pattern in enumerate(_COMPILED):
        least = LEAST_SECRET if kind == 0 else 1
        spans = [m.span() for m in pattern.finditer(text) if (not m.re.groups or len(m.group(1)) >= least) and (kind != 5 or _mixed(m.group()))]
        if kind >= _STRONG and spans:
            spans = _apart(spans, sorted((s, e) for _, s, e in found))
        found += [(kind, *s) for s in spans]
    found.sort(key=lambda x: (x[1], x[0]))
    out, scope, cuts = [], 0, (m.start() for m in _SCOPE.finditer(text))
    cut = next(cuts, None) if found else None
    for kind, start, end in found:
        while cut is not None and cut < start:
            scope, cut = scope + 1, next(cuts, None)
        out.append((kind, start, end, scope))
    return out


def _apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` that touch none of ``taken``; both by start, ``spans`` without overlaps."""
    out, k, reach = [], 0, -1
    for s, e in spans:
        while k < len(taken) and taken[k][0] < e:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= s:
            out.append((s, e))
    return out


_PARTS = "array<struct<kind:int,start:int,end:int,scope:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "end", "scope")]))
    for batch in batches:
        rows = [[dict(zip(("kind", "start", "end", "scope"), p, strict=True)) for p in parts(t or "")] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "parts"])


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, parts) for every row of ``docs``: what patterns find before anything is linked, kept as a table."""
    arrow_rows(docs.sparkSession, 256)
    found = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id long, parts {_PARTS}").withColumn("row", F.monotonically_increasing_id()), "parts")
    arrow_rows(docs.sparkSession)
    return found


def linked_weak(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, kind, start, end) of the weak candidates of ``found`` whose complements lie in their scope, at most ``reach`` apart."""
    role = F.element_at(F.create_map(*(F.lit(v) for k, kind in enumerate(KINDS) for v in (k, _ROLE[kind]))), F.col("p.kind"))
    weak = F.exists("parts", lambda p: p.kind >= _STRONG)
    each = found.filter(weak).select("row", F.explode("parts").alias("p")).select("row", "p.kind", "p.start", "p.end", "p.scope", role.alias("role"))
    # a part lies in the buckets of its start and of its end, which are enough: parts are compared by both
    bucket = F.explode(F.array_distinct(F.array(F.expr(f"start DIV {reach}"), F.expr(f"end DIV {reach}")))).alias("bucket")
    bounds = each.filter("role <> 'endpoint'").select("row", "scope", "role", "start", "end", bucket)
    bounds = bounds.groupBy("row", "scope", "role", "bucket").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    spread = each.filter(F.col("kind") >= _STRONG).withColumn("bucket", F.explode(F.expr(f"sequence(start DIV {reach} - 1, end DIV {reach} + 1)")))
    near = spread.join(bounds.withColumnRenamed("role", "other"), ["row", "scope", "bucket"])
    near = near.filter(F.col("first") <= F.col("end") + reach).filter(F.col("last") >= F.col("start") - reach)
    met = near.groupBy("row", "kind", "start", "end").agg(F.max(F.col("other") == "secret").alias("secret"), F.max(F.col("other") == "identifier").alias("identifier"))
    allowed = [f"(kind = {KINDS.index(kind)} AND {' AND '.join(needs)})" for kind, needs in _NEEDS.items()]
    return met.filter(" OR ".join(allowed)).select("row", "kind", "start", "end")


def _listed(spans: str) -> str:
    """kind:start:end of each, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)))"


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for every row of ``docs`` (doc_id, text).

    Places are code points, ends exclusive; ``spans`` lists strong spans and linked weak ones by start,
    then kind. Null and empty texts have none and hash the empty string. Each row is judged by itself, so
    repeated rows, repeated ids and null ids each return their own. Places where strong kinds overlap are
    all listed. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    found = scan(docs)
    one = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    weak = linked_weak(found, reach).groupBy("row").agg(F.collect_list(one).alias("weak"))
    strong = F.transform(F.filter("parts", lambda p: p.kind < _STRONG), lambda p: F.struct(p.start.alias("start"), p.kind.alias("kind"), p.end.alias("end")))
    out = found.select("row", "doc_id", strong.alias("strong")).join(weak, "row", "left").withColumn("weak", F.coalesce("weak", F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>")))
    every = out.withColumn("listed", F.array_sort(F.concat("strong", "weak")))
    counts = [F.expr(f"CAST(size(filter(strong, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{KINDS[k]}") for k in range(_STRONG)]
    return every.select("doc_id", *counts, F.sha2(F.expr(_listed("strong")), 256).alias("base_sha256"), F.expr(_listed("listed")).alias("spans"), F.size("weak").cast("long").alias("n_linked"))
