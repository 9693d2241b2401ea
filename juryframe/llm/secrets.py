"""Secret scans: known patterns, and the Shannon entropy of windows that slide over candidate strings.

A candidate is a long run of the characters that keys are made of. It is of one of two character classes, hex digits or
the base-64 alphabet, each with an entropy limit; a run of hex digits inside a candidate is judged as hex as well. A window moves along it; counts and the sum of c log c are updated for
the character that enters and the one that leaves. Windows above the limit, joined where they overlap, are spans. Candidates
on the allow-list, such as natural words, paths of words and UUIDs, give none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are taken whole, so asking for their least length finds the same matches as dropping short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_RUN = re.compile(r"[0-9a-fA-F]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGNED, WINDOW = 6, 20
#: Class of a candidate, what it consists of, and the entropy in bits above which a window is a secret.
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+"), 3.0), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7))
ALLOWED = (
    r"(?!.*[A-Za-z][A-Z])[A-Za-z/_=+-]+",  # words, and words in rows: no capital inside a word
    r"[A-Z/_=+-]+",
    r"[0-9=+/_-]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
)
Span = tuple[int, str, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the known patterns, leftmost and not overlapping within a kind, in code points."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def high_windows(string: str, limit: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined (start, end) of the windows of ``string`` with more than ``limit`` bits of entropy a character."""
    xlogx = [0.0, *(c * math.log2(c) for c in range(1, window + 1))]
    counts: Counter[str] = Counter(string[:window])
    total = sum(xlogx[c] for c in counts.values())
    most = (math.log2(window) - limit) * window  # entropy is log2(window) - total / window
    spans: list[tuple[int, int]] = []
    for start in range(len(string) - window + 1):
        if start:
            out, new = string[start - 1], string[start + window - 1]
            if out != new:
                total += xlogx[counts[out] - 1] - xlogx[counts[out]]
                counts[out] -= 1
                total += xlogx[counts[new] + 1] - xlogx[counts[new]]
                counts[new] += 1
        if total < most - 1e-9:
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], start + window)
            else:
                spans.append((start, start + window))
    return spans


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def entropy_spans(text: str, allowed: re.Pattern) -> list[Span]:
    found = []
    for m in CANDIDATE.finditer(text):
        string = m[0]
        if allowed.fullmatch(string):
            continue
        limit = next(limit for _, made_of, limit in CLASSES if made_of.fullmatch(string))
        spans = high_windows(string, limit)
        for run in HEX_RUN.finditer(string):
            if run[0] != string and not allowed.fullmatch(run[0]):
                spans += [(run.start() + a, run.start() + b) for a, b in high_windows(run[0], CLASSES[0][2])]
        found += [(m.start() + a, "entropy", m.start() + b) for a, b in _joined(spans)]
    return found


def find_secrets(text: str, allowed: re.Pattern) -> list[Span]:
    """All spans by start, then kind; an entropy span inside another span is not repeated."""
    base, covered, more = base_spans(text), [], []
    # Base spans in order, without those inside another: both ends rise.
    for start, _, end in sorted(base, key=lambda s: (s[0], -s[2])):
        if not covered or end > covered[-1][1]:
            covered.append((start, end))
    at = 0
    for span in entropy_spans(text, allowed):
        # Of the spans that begin at or before it, the last one ends last.
        while at < len(covered) and covered[at][0] <= span[0]:
            at += 1
        if not at or covered[at - 1][1] < span[2]:
            more.append(span)
    return sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def allow_list(patterns: Sequence[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{p})" for p in patterns))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    ``spans`` lists kind:start:end, joined by commas, in code points with the end excluded. Null and empty texts have
    none. Rows that repeat are scanned each; an empty table stays empty. Texts may be of any length: time grows with the
    length and the number of spans. Other columns are not read, whatever their names. No row moves between tasks.
    """
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = allow_list(allowed)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                spans = find_secrets(text.as_py() or "", allow)
                kinds = Counter(k for _, k, _ in spans)
                base = listed(s for s in spans if s[1] != "entropy")
                row = (*(kinds[k] for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), listed(spans))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(text: str, spans: Sequence[Span], mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = None, mask: str = "[SECRET]", allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """``docs`` with every span replaced by ``mask``; ``chars_col``, if given, is set to the new number of characters
    where the text changed. Null texts stay null, rows that repeat are masked each, an empty table stays empty, and other
    columns of any name are kept as they are. Texts may be of any length."""
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = allow_list(allowed)
        for batch in batches:
            arrays = list(batch.columns)
            texts = batch.column(at).to_pylist()
            lengths = batch.column(chars).to_pylist() if chars is not None else []
            for i, text in enumerate(texts):
                if text and (spans := find_secrets(text, allow)):
                    texts[i] = redact(text, spans, mask)
                    if chars is not None:
                        lengths[i] = len(texts[i])
            arrays[at] = pa.array(texts, batch.schema.field(at).type)
            if chars is not None:
                arrays[chars] = pa.array(lengths, batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
