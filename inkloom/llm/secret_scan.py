"""Secret scans: patterns, and windows of high Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base spans; a match also needs the length beside it.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")

#: Characters of a candidate, its least length, and the window that slides over it.
CANDIDATE, WINDOW = re.compile(r"[A-Za-z0-9+/_-]{20,}"), 20
#: Kinds of characters, and the classes that a window's kinds make; the first that fits counts.
DIGIT, LOW_HEX, UP_HEX, LOW, UP, SYMBOL = range(6)
CLASSES = {
    "digit": {DIGIT},
    "hex": {DIGIT, LOW_HEX},
    "upper hex": {DIGIT, UP_HEX},
    "alpha": {LOW_HEX, UP_HEX, LOW, UP},
    "alnum": {DIGIT, LOW_HEX, UP_HEX, LOW, UP},
    "base64": {DIGIT, LOW_HEX, UP_HEX, LOW, UP, SYMBOL},
}
#: Bits a character from which a window is suspect: what 98 of 100 random windows of the class reach.
BITS = {"digit": 2.56, "hex": 2.94, "upper hex": 2.94, "alpha": 3.62, "alnum": 3.68, "base64": 3.72}
#: Candidates and spans that are such a thing as a whole are known to be harmless: identifiers, fillers, runs of the
#: alphabet, words of one case and short numbers with marks between them, and groups of digits.
ALLOW = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?:(?i:example|placeholder|changeme|your|secret|token|password|key|here|sample|dummy|test|x+)|[-_/+])+"
    r"|(?:0123456789|1234567890|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|abcdefghij|ABCDEFGHIJ|abcdef|ABCDEF|[-_/+])+"
    r"|[-_/+]*(?:(?:[A-Z]?[a-z]{2,}+)+|[A-Z]{2,}+|[0-9]{1,4}+)(?:[-_/+]+(?:(?:[A-Z]?[a-z]{2,}+)+|[A-Z]{2,}+|[0-9]{1,4}+))*+[-_/+]*"
    r"|[0-9]+(?:[-_/][0-9]+)+"
)
_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]
_KIND = {c: DIGIT if c.isdigit() else SYMBOL if not c.isalpha() else (LOW_HEX if c in "abcdef" else UP_HEX if c in "ABCDEF" else LOW if c.islower() else UP) for c in string.ascii_letters + string.digits + "+/_-"}


def _limits(bits: dict[str, float]) -> list[float]:
    """For each set of kinds, as bits of a number: the most that sum c log c may be in a suspect window, else -1.

    A window of letters or with symbols needs both cases: text and paths of one
    case are no secrets.
    """
    out = []
    for mask in range(64):
        kinds = {k for k in range(6) if mask >> k & 1}
        name = next((n for n, all_ in CLASSES.items() if kinds <= all_), None) if kinds else None
        both = kinds & {LOW_HEX, LOW} and kinds & {UP_HEX, UP}
        if name is None or name in ("alpha", "base64") and not both:
            out.append(-1.0)
        else:
            out.append(WINDOW * (math.log2(WINDOW) - bits[name]) + 1e-9)
    return out


def entropy_spans(text: str, allow: re.Pattern[str] = ALLOW, bits: dict[str, float] = BITS) -> list[tuple[int, int]]:
    """Unions of windows of high entropy in the candidates of text.

    The counts of a window's characters and kinds follow from those of the one
    before by one character in and one out; its entropy is log n - (1/n) sum
    c log c, of which only the two changed terms are computed. Each window is
    judged by the class of its own characters, so what is glued to a key does
    not hide it. What allow matches as a whole, candidate or span, is left out.
    """
    spans, limits = [], _limits(bits)
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if allow.fullmatch(word):
            continue
        counts: dict[str, int] = {}
        kinds, mask = [0] * 6, 0
        total = 0.0
        first = last = -1
        found = []
        for i, c in enumerate(word):
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += _LOG[n + 1] - _LOG[n]
            kinds[_KIND[c]] += 1
            mask |= 1 << _KIND[c]
            if i >= WINDOW - 1:
                if total <= limits[mask]:
                    if first >= 0 and i - WINDOW + 1 > last:
                        found.append((first, last))
                        first = -1
                    if first < 0:
                        first = i - WINDOW + 1
                    last = i + 1
                out = word[i - WINDOW + 1]
                n = counts[out]
                counts[out] = n - 1
                total += _LOG[n - 1] - _LOG[n]
                kinds[_KIND[out]] -= 1
                if not kinds[_KIND[out]]:
                    mask ^= 1 << _KIND[out]
        if first >= 0:
            found.append((first, last))
        spans += [(m.start() + a, m.start() + b) for a, b in found if not allow.fullmatch(word, a, b)]
    return spans


def find(text: str, allow: re.Pattern[str] = ALLOW) -> list[tuple[int, int, str]]:
    """All spans of text as (start, kind's place, kind:start:end), in order."""
    low, out = text.lower(), []
    add = lambda kind, a, b: out.append((a, KINDS.index(kind), f"{kind}:{a}:{b}"))
    if any(k in low for k in ("token", "secret", "passw", "apikey", "api_key")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                add("assign", *m.span())
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= ACCESS_LEAST:
                add("access", *m.span())
    for m in HEX.finditer(text):
        add("hex", *m.span())
    for a, b in entropy_spans(text, allow):
        add("entropy", a, b)
    return sorted(out)


def scan(docs: DataFrame, allow: str = ALLOW.pattern) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs.

    Spans count code points, end exclusive. Null and empty texts have none, and
    the digest of the empty string; repeated rows each get a row; an empty table
    gives none. Only doc_id and text are read. A candidate or span that `allow`
    matches as a whole is no entropy span, whatever its entropy; base spans
    always stay.
    """
    allowed = re.compile(allow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for cell in batch.column(1):
                spans = find(cell.as_py() or "", allowed)
                for k in range(3):
                    cols[k].append(sum(s[1] == k for s in spans))
                cols[3].append(hashlib.sha256(",".join(s[2] for s in spans if s[1] < 3).encode()).hexdigest())
                cols[4].append(",".join(s[2] for s in spans))
            arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
