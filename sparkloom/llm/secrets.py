"""Secret scans with multipart credential linking.

Strong patterns (the base kinds) stand alone. Weak candidates, which many clean
texts hold, are only reported as part of a credential: within a scope (a
stretch of text between blank lines) the access identifiers, secrets and
endpoints are joined by the scope's interval: a weak one needs its complement
in the same scope, however far.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mapped, shipped
from ._text import slices

# The base patterns.
ASSIGN = re.compile(
    r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
# Kinds that only count as parts: an identifier of another issuer, a bare high-entropy token, an address.
KINDS = (*BASE, "ident", "key", "endpoint")

IDENT = re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|AGPA|ANPA)[A-Z0-9]{16}(?![A-Za-z0-9])")
KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,64}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>|,;)]+")
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")

#: Cheap to test on a whole Arrow column; every text with a span or a part has a match.
_MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA|ASIA|AROA|AIDA|AGPA|ANPA|[0-9a-f]{24}|[A-Za-z0-9+/]{32}"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, leftmost and without overlap in each kind."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def linked_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Weak candidates of a text whose complements lie in the same scope."""
    taken = sorted((s, e) for s, _, e in base)
    firsts = [s for s, _ in taken]
    lasts = list(accumulate((e for _, e in taken), max))  # the furthest end up to each

    def free(m: re.Match) -> bool:
        i = bisect_right(firsts, m.end() - 1)
        return not i or lasts[i - 1] <= m.start()

    weak_ids = [(m.start(), "ident", m.end()) for m in IDENT.finditer(text) if free(m)]
    keys = [(m.start(), "key", m.end()) for m in KEY.finditer(text) if free(m)]
    ids = sorted([x for x in base if x[1] == "access"] + weak_ids)
    if not (ids or keys):
        return []
    ends = sorted((m.start(), "endpoint", m.end()) for m in ENDPOINT.finditer(text))
    borders = [m.start() for m in SCOPE_END.finditer(text)]

    def near(part: tuple[int, str, int], others: list[tuple[int, str, int]]) -> bool:
        """Is there another part in this one's scope? Both lists are in order of start."""
        scope = bisect_left(borders, part[0])
        lo = bisect_left(others, (borders[scope - 1] + 1,)) if scope else 0
        for i in range(lo, len(others)):
            s, _, e = others[i]
            if scope < len(borders) and s > borders[scope]:
                return False
            if (s, e) != (part[0], part[2]):
                return True
        return False

    out = [k for k in keys if near(k, ids) or near(k, ends)]
    kept = sorted([x for x in base if x[1] != "access"] + out)
    out += [i for i in weak_ids if near(i, kept)]
    ids = sorted([x for x in base if x[1] == "access"] + [x for x in out if x[1] == "ident"])
    out += [e for e in ends if near(e, ids) and near(e, kept)]
    return out


def all_spans(text: str) -> list[tuple[int, str, int, bool]]:
    """(start, kind, end, is base) in order of start, then of KINDS."""
    base = base_spans(text)
    found = [(*x, True) for x in base] + [(*x, False) for x in linked_spans(text, base)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[int]]]:
    """Slices, their texts and which of them may hold something."""
    for batch in batches:
        for rows, _, _ in slices(batch, "text"):
            text = rows.column("text").fill_null("")
            hits = pc.indices_nonzero(pc.match_substring_regex(text, _MAY_HOLD)).to_pylist()
            yield rows, text, hits


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, text, hits in _texts(batches):
        found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
        for i in hits:
            found[i] = [{"kind": k, "start": s, "end": e, "base": b} for s, k, e, b in all_spans(text[i].as_py())]
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, _SPANS)], ["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) of each row of docs (doc_id, text).

    Offsets are code points, ends exclusive, in order of start and then of
    KINDS. Null and empty texts have no spans; a null doc_id is kept; repeated
    rows each have their own; other columns are ignored.
    """
    shipped(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(docs, _find, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>")


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every stretch covered by spans replaced by one mark."""
    out, at = [], 0
    for s, _, e, _ in all_spans(text):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced and n_chars, where there is one, counted anew; rows and columns stay."""
    shipped(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, text, hits in _texts(batches):
            if hits:
                new = rows.column("text").to_pylist()
                for i in hits:
                    new[i] = redacted(text[i].as_py()) if new[i] is not None else None
                rows = rows.set_column(names.index("text"), "text", pa.array(new, rows.schema.field("text").type))
                if "n_chars" in names:
                    k = names.index("n_chars")
                    sizes, changed = rows.column(k).to_pylist(), set(hits)
                    sizes = [len(new[i]) if i in changed and new[i] is not None else n for i, n in enumerate(sizes)]
                    rows = rows.set_column(k, "n_chars", pa.array(sizes, rows.schema.field("n_chars").type))
            yield rows

    return mapped(docs, run, docs.schema)


def secret_digests(spans: DataFrame) -> DataFrame:
    """The contract's columns from secret_spans()."""

    def joined(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
