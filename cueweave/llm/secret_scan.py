"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Within runs of key-like characters, every longest piece of one encoding's
characters (decimal, hex, base 32, 36, 62, 64) is a candidate, so names, paths and
signs beside a key do not hide it. Under the encoding the symbols of a key are
uniform and independent. Three tests measure that: chi-squared of the symbol
counts, runs about the middle of the alphabet, and serial correlation.
Fisher's method combines them. Over the whole corpus, false discoveries of
structure are controlled (Benjamini-Hochberg) within each encoding and length
class, as short strings say less; a candidate without proven structure is a
secret.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import slices, stored

# Fixed values of the contract: kinds in the order of ties, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
NAMES = ("passw", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: A run of key-like characters that is worth testing.
LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PADDING = re.compile(r"={1,6}(?![A-Za-z0-9+/_=-])")
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)


def _class(c: str) -> int:
    return 0 if c.isupper() else 1 if c.islower() else 2


#: Per encoding: place and class of each character, how many each class has, and its longest pieces.
_PLACES = {name: ({c: i for i, c in enumerate(letters)}, {c: _class(c) for c in letters},
                  [sum(_class(c) == k for c in letters) for k in range(3)],
                  re.compile(f"[{re.escape(letters)}]{{{LEAST},}}")) for name, letters in ALPHABETS}
#: Steps per halving of a p-value, and the most halvings told apart.
STEPS, HALVINGS = 8, 64


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_upper(x: float, freedom: int) -> float:
    """Upper tail of chi-squared (Wilson-Hilferty)."""
    a = 2 / (9 * freedom)
    return 0.5 * math.erfc((((x / freedom) ** (1 / 3)) - (1 - a)) / math.sqrt(2 * a))


def pieces(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, encoding) of the longest pieces of each encoding; equal pieces have the narrowest one."""
    seen = set()
    for name, (*_, longest) in _PLACES.items():
        for m in longest.finditer(run):
            if m.span() not in seen:
                seen.add(m.span())
                yield *m.span(), name


def battery(body: str, name: str) -> float:
    """Combined p-value of randomness of a string of an encoding's characters.

    Counts of upper case, lower case and others tell words and names from keys;
    the smaller p-value of that and of Fisher's method, doubled.
    """
    places, classes, members, _ = _PLACES[name]
    size = len(places)
    codes = [places[c] for c in body]
    n = len(codes)
    bins = max(2, min(size, n // 5))
    counts = [0] * bins
    for c in codes:
        counts[c * bins // size] += 1
    expected = [0] * bins
    for c in range(size):
        expected[c * bins // size] += 1
    chi = sum((k - n * e / size) ** 2 / (n * e / size) for k, e in zip(counts, expected))
    p_chi = _chi_upper(chi, bins - 1)
    high = [2 * c >= size for c in codes]
    ups = sum(high)
    downs = n - ups
    if ups and downs:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * ups * downs / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    middle = sum(codes) / n
    around = [c - middle for c in codes]
    power = sum(x * x for x in around)
    serial = sum(a * b for a, b in zip(around, around[1:])) / power if power else 1.0
    p_serial = _normal_two_sided(serial * math.sqrt(n) + 1 / math.sqrt(n))
    x = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    p = min(1.0, math.exp(-x) * (1 + x + x * x / 2))  # Fisher: chi-squared, 6 degrees
    kinds = sum(map(bool, members))
    if kinds > 1:
        found = Counter(classes[c] for c in body)
        apart = sum((found[k] - n * e / size) ** 2 / (n * e / size) for k, e in enumerate(members) if e)
        p = min(1.0, 2 * min(p, _chi_upper(apart, kinds - 1)))
    return p


def length_class(n: int) -> int:
    return min(7, int(math.log2(n / 20) * 2))


def step_of(p: float) -> int:
    """p lies in (2^-((s+1)/STEPS), 2^-(s/STEPS)]; the upper end stands for it, which errs to the safe side."""
    return min(STEPS * HALVINGS, int(-math.log2(max(p, 2.0 ** -HALVINGS)) * STEPS))


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, int]]]:
    """Base spans (start, kind, end) and candidates (start, end, stratum, step), in code points."""
    base, tested = [], []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    for run in RUN.finditer(text):  # both patterns lie within such runs
        a, b = run.span()
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= ACCESS_LEAST]
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= HEX_LEAST]
        for start, stop, name in pieces(run[0]):
            p = battery(run[0][start:stop], name)
            padded = PADDING.match(text, a + stop) if name.startswith(("base32", "base64")) else None
            tested.append((a + start, padded.end() if padded else a + stop, f"{name}:{length_class(stop - start)}", step_of(p)))
    base.sort()
    tested = [t for t in tested if not any(s < t[1] and t[0] < e for s, _, e in base)]
    return base, tested


def rejected_from(counts: dict[tuple[str, int], int], rate: float) -> dict[str, int]:
    """Benjamini-Hochberg in each stratum: the first step whose candidates have proven structure."""
    cuts = {}
    for stratum in sorted({s for s, _ in counts}):
        steps = sorted((k, n) for (s, k), n in counts.items() if s == stratum)
        total, above = sum(n for _, n in steps), 0
        for step, n in reversed(steps):
            above += n
            if 2.0 ** (-step / STEPS) <= rate * above / total:
                cuts[stratum] = step
    return cuts


def scan(frame: DataFrame, rate: float = 0.05, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `base` and `spans`: arrays of (start, kind, end) per row, by start and kind.

    Positions are code points, ends exclusive; kinds are places in `KINDS`. A
    null or empty text has empty arrays; null keys stay null; repeated rows give
    equal rows, and count as often as they occur when false discoveries are
    controlled; an empty table gives none. Other columns are not read.

    Texts are read once. What was found, a few numbers per row, is stored; the
    corpus-wide control needs its counts per stratum and step, at most
    8 * 8 * 513 of them.
    """
    span = "array<struct<start:int,kind:int,stop:int>>"
    tested = "array<struct<start:int,stop:int,stratum:string,step:int>>"
    schema = f"`{key}` {dict(frame.dtypes)[key]}, base {span}, tested {tested}"
    of_span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    of_test = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("stratum", pa.string()), ("step", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            base, tests = [], []
            for value in batch.column(text).to_pylist():
                spans, candidates = spans_of(value or "")
                base.append([{"start": a, "kind": k, "stop": b} for a, k, b in spans])
                tests.append([{"start": a, "stop": b, "stratum": s, "step": p} for a, b, s, p in candidates])
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(base, of_span), pa.array(tests, of_test)], [key, "base", "tested"])

    found = stored(frame.select(key, text).mapInArrow(run, schema), "secrets")
    steps = found.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.step").count().collect()
    cuts = rejected_from({(r["stratum"], r["step"]): r["count"] for r in steps}, rate)
    pairs = [F.lit(x) for item in cuts.items() for x in item] or [F.lit(""), F.lit(0)]
    cut = F.create_map(*pairs)
    kept = F.filter("tested", lambda t: F.coalesce(t["step"] < cut[t["stratum"]], F.lit(True)))
    added = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    return found.select(key, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
