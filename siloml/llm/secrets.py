"""Secrets in whole texts: fixed patterns and spans of high entropy."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

# The base kinds in their order, their patterns and the least length of what they must hold.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 or more; shorter ones would be dropped
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

# Entropy: strings of one of two alphabets, swept by a window; bits per character that prose, names and
# numbers don't reach.
WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF-")
JOINTS = re.compile(r"[=/_-]+")  # what joins names and keys; a span reaches to the next one
LEAST_BITS = {"hex": 3.0, "base64": 3.9}
# Strings that look random but are public by their form: UUIDs, data checksums with their prefix, and so on.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(sha(1|224|256|384|512)|md5)[-_][A-Za-z0-9+/=]+"),
    re.compile(r"[A-Za-z]+([-_/][A-Za-z]+)*"),  # words, joined or not
    re.compile(r"[0-9][0-9_/=+-]*"),  # numbers, dates, telephone numbers
    re.compile(r"[A-Za-z]+([-_/][A-Za-z]+)*[-_/=]?[0-9]{1,4}"),  # a name with a number
)
# The first two forms where they stand in a longer string, glued to a name.
PUBLIC = re.compile("(?<![A-Za-z0-9])(?:%s(?![A-Za-z0-9])|%s)" % (ALLOWED[0].pattern, ALLOWED[1].pattern))
KINDS_ALL = (*KINDS, "entropy")
_LOG = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 2)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base kinds, sorted; code points, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in WORDS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def window_bits(s: str) -> Iterator[tuple[int, float]]:
    """Start and Shannon entropy, in bits a character, of every window of ``s``.

    The characters' counts go along with the window: one comes, one goes, and the sum of n * log2(n) with them.
    """
    counts, total = {}, 0.0
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += _LOG[n + 1] - _LOG[n]
        counts[c] = n + 1
        if i >= WINDOW:
            gone = s[i - WINDOW]
            n = counts[gone]
            total += _LOG[n - 1] - _LOG[n]
            counts[gone] = n - 1
        if i >= WINDOW - 1:
            yield i - WINDOW + 1, math.log2(WINDOW) - total / WINDOW


def hot_windows(s: str, least: float) -> Iterator[int]:
    """Starts of the windows of ``s`` whose Shannon entropy is ``least`` bits a character or more."""
    return (at for at, bits in window_bits(s) if bits >= least)


def secret_windows(s: str) -> Iterator[int]:
    """Starts of the hot windows of ``s``, each by its own alphabet: hex digits with a letter and a digit, or any."""
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    other = digit = letter = -1  # the last places of such characters
    kinds = []
    for i, c in enumerate(s):
        other = other if c in HEX_DIGITS else i
        digit, letter = (i if c.isdigit() else digit), (i if c.isalpha() else letter)
        if i >= WINDOW - 1:
            kinds.append(other <= i - WINDOW and min(digit, letter) > i - WINDOW)
    for at, bits in window_bits(s):
        if bits >= LEAST_BITS["base64"] and mixed or kinds[at] and bits >= LEAST_BITS["hex"]:
            yield at


def _weighed(s: str) -> Iterator[tuple[int, int]]:
    """Spans of ``s`` under hot windows, each out to the joints around it; spans that meet are one."""
    hot, joints = list(secret_windows(s)), [0]
    if not hot:
        return
    ends = [*(m.start() for m in JOINTS.finditer(s)), len(s)]
    joints += [m.end() for m in JOINTS.finditer(s)]
    start = stop = None
    for at in hot:
        first = max(joints[bisect_right(joints, at) - 1], 0)
        last = max(at + WINDOW, ends[min(bisect_right(ends, at + WINDOW - 1), len(ends) - 1)])
        if start is not None and first <= stop:
            start, stop = min(start, first), max(stop, last)
            continue
        if start is not None:
            yield start, stop
        start, stop = first, last
    yield start, stop


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of candidate strings under windows of high entropy, by the windows' alphabets; allowed forms are left out."""
    out = []
    for m in CANDIDATE.finditer(text):
        whole, at = m.group(), 0
        if any(a.fullmatch(whole) for a in ALLOWED):
            continue
        for start, stop in [*(p.span() for p in PUBLIC.finditer(whole)), (len(whole), len(whole))]:
            s = whole[at:start]
            if len(s) >= WINDOW and not any(a.fullmatch(s) for a in ALLOWED):
                out += [(m.start() + at + i, m.start() + at + j) for i, j in _weighed(s)]
            at = stop
    return out


def secret_spans(text: str | None) -> list[tuple[int, str, int]]:
    """All spans (start, kind, end) of a text, by start, then kind; an entropy span inside a base span adds nothing."""
    text = text or ""
    base, more = base_spans(text), []
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for i, j in entropy_spans(text):
        k = bisect_right(starts, i)
        if not k or reach[k - 1] < j:
            more.append((i, 3, j))
    return [(s, KINDS_ALL[k], e) for s, k, e in sorted(base + more)]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``found`` (array of start, kind, stop) of every whole text; a null or empty text has none.

    Rows are scanned where they are read; copies and ties stay rows.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"start": s, "kind": k, "stop": e} for s, k, e in secret_spans(t.as_py())] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, item)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key}, found array<struct<start:bigint,kind:string,stop:bigint>>")
