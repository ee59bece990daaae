"""Multipart credential linking: spans of credentials in whole texts.

Strong parts stand alone: assigned values, access identifiers and long hex
runs.  Weak parts (short assigned values, user names, bare random-looking
tokens, endpoints) are common in clean prose, so each is reported only when an
interval join inside its scope finds the parts that complete a credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import map_arrow, texts

# The base patterns of the contract.
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

NAMED = re.compile(r"(?ai:access_?key(?:_?id)?|client_?id|account|login|user(?:_?name)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._+-]{3,})")
BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
# A scheme is looked for once in each run of its characters, so that long runs are not gone over again and again.
URL = re.compile(r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\s\"'<>]+)")
HOST = re.compile(r"(?ai:host(?:name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?")
BLANK = re.compile(r"\n[\x20\t\r]*+\n")

Span = tuple[int, int]


def random_looking(token: str) -> bool:
    """Digits, both cases, and nearly as many different characters as a random token has."""
    if not (re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= 0.75 * math.log2(min(n, 64))


class Cover:
    """The union of spans, asked whether a span meets it."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        i = bisect_left(self.starts, span[1]) - 1
        return i >= 0 and self.ends[i] > span[0]


def base_spans(text: str) -> dict[str, list[Span]]:
    marked = "=" in text or ":" in text
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[1]) >= 12] if marked else [],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def candidates(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """What may be part of a credential, though it stands for nothing alone; no part meets a base span."""
    taken = Cover([s for spans in base.values() for s in spans])
    marked = "=" in text or ":" in text
    ends = [m.span(1) for m in URL.finditer(text)] if "://" in text else []
    urls = Cover(ends)
    if marked:
        ends += [m.span() for m in HOST.finditer(text) if not urls.meets(m.span())]
    ids = [m.span() for m in NAMED.finditer(text) if not taken.meets(m.span())] if marked else []
    if not (ids or ends or base["access"]):
        return {"identifier": [], "secret": [], "endpoint": []}
    weak = [m.span() for m in ASSIGN.finditer(text) if 6 <= len(m[1]) < 12 and not taken.meets(m.span())] if marked else []
    held = Cover(ids + ends + weak)
    weak += [m.span() for m in BARE.finditer(text) if not taken.meets(m.span()) and not held.meets(m.span()) and random_looking(m[0])]
    return {"identifier": ids, "secret": weak, "endpoint": ends}


def linked_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The weak parts that other parts of their scope complete.

    Scopes are paragraphs; parts join the scope whose interval holds them, at
    any distance inside it.  A secret and an identifier complete each other if
    one of them is strong, or if the scope has an endpoint too.  An endpoint
    is reported where both are.
    """
    found = candidates(text, base)
    if not any(found.values()):
        return {}
    cuts = [0, *(m.end() for m in BLANK.finditer(text))]
    scope = lambda span: bisect_right(cuts, span[0])
    scopes = lambda *spans: {scope(s) for some in spans for s in some}
    sure_id, sure_secret, hosts = scopes(base["access"]), scopes(base["assign"], base["hex"]), scopes(found["endpoint"])
    any_id, any_secret = sure_id | scopes(found["identifier"]), sure_secret | scopes(found["secret"])
    secret, identifier = sure_id | any_id & hosts, sure_secret | any_secret & hosts
    both = (sure_id & any_secret) | (sure_secret & any_id) | (any_id & any_secret & hosts)
    return {
        "identifier": [s for s in found["identifier"] if scope(s) in identifier],
        "secret": [s for s in found["secret"] if scope(s) in secret],
        "endpoint": [s for s in found["endpoint"] if scope(s) in both],
    }


def joined(spans: dict[str, list[Span]]) -> str:
    rows = sorted((start, KINDS.index(kind), end, kind) for kind, found in spans.items() for start, end in found)
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in rows)


def scan_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the strong kinds and all spans.

    Positions count code points of the whole text.  A null text is empty and
    has no spans; null ids, ties and repeated rows keep a row each; an empty
    table gives an empty one; other columns are left out.  The work grows with
    the text, whatever it holds.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                rows.append((*(len(base[k]) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base | linked_spans(text, base))))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(texts(df, id_col, text_col), task, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
