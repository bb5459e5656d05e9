"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries.

A candidate is a run of at least ``LEAST`` characters of the Base64 and URL-safe alphabets. The smallest of a list of
encodings that holds all its characters is inferred. Three tests ask whether it could be uniform over that encoding's
alphabet: chi-squared over its symbols, runs above and below the middle, and serial correlation of neighbours. The
smallest of their p-values, times three, is the token's score: secrets score high, words near zero.

How often words reach a score depends on length and encoding. So all text between candidates also gives decoys: for each
encoding and length class, its letters and digits that are in the alphabet, cut into pieces as long as the shortest
candidates of the class. Counts of decoys' scores give each candidate a p-value under "this is prose"; a fitted tail
carries it on below what the decoys reach. The Benjamini-Hochberg rule over the p-values of all candidates of the table
sets the one limit up to which they are secrets. Only counts over fixed bins travel to the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.shared import stored

#: Fixed patterns: kind, expression, the group that has a least length, and that length.
BASE = (
    ("assign", re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24),
)
KINDS = ("assign", "access", "hex", "random")
#: Texts without this have no fixed secret.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}"
#: Characters of a candidate at least, and the run itself.
LEAST = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
CANDIDATE_HINT = rf"[A-Za-z0-9+/_-]{{{LEAST}}}"
#: Alphabets, smallest first.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("LETTERS", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("any", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
SETS = [frozenset(a) for _, a in ENCODINGS]
PLACES = [{c: i for i, c in enumerate(a)} for _, a in ENCODINGS]
#: Alphabets that only differ in what prose lacks, or in case, share their decoys.
NAMES = [name for name, _ in ENCODINGS]
FAMILY = [NAMES.index({"HEX": "hex", "LETTERS": "letters", "BASE36": "base36", "base64url": "base64"}.get(name, name)) for name in NAMES]
#: Encodings that decoys are read in.
READ_AS = sorted(set(FAMILY))
#: Upper ends of the length classes; longer ones form the last.
LENGTHS = (24, 32, 48, 64, 96, 128, 256)
#: Scores are counted in steps of a tenth in -log10, up to 9.
STEPS, MOST_STEPS = 10, 90
#: Share of false discoveries that is accepted.
FALSE_DISCOVERIES = 0.01
#: Decoys that the fitted tail starts from, and those that its slope reaches to.
TAIL_FROM, TAIL_TO = 10, 100
#: Bytes of text that decoys are made from at once.
AT_ONCE = 250_000
MARK = "[SECRET]"


def _normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal deviation."""
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_tail(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation: the cube root is close to normal."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return math.erfc(z / math.sqrt(2)) / 2


def encoding(token: str) -> int:
    """Number of the smallest encoding that holds the token, padding aside."""
    chars = set(token.rstrip("="))
    return next(i for i, s in enumerate(SETS) if chars <= s)


def battery(token: str, code: int) -> float:
    """Smallest p-value of the three tests, corrected for being the smallest; near 0 for what is not uniform."""
    x = [PLACES[code][c] for c in token.rstrip("=")]
    n, size = len(x), len(PLACES[code])
    counts = [0] * size
    for v in x:
        counts[v] += 1
    chi = sum(c * c for c in counts) * size / n - n
    p = [_chi_squared_tail(chi, size - 1)]
    high = [2 * v >= size for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(s != t for s, t in zip(high, high[1:], strict=False))
        p.append(_normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2 ** (1 - n))
    middle = (size - 1) / 2
    serial = sum((s - middle) * (t - middle) for s, t in zip(x, x[1:], strict=False))
    p.append(_normal_tail(serial / ((size * size - 1) / 12 * math.sqrt(n - 1))))
    return min(1.0, 3 * min(p))


def _step(p: float) -> int:
    """0 for a score of 1, up to ``MOST_STEPS``: a small step is a random token."""
    return MOST_STEPS if p <= 10.0 ** -(MOST_STEPS / STEPS) else min(MOST_STEPS, int(-math.log10(p) * STEPS))


def _class(length: int) -> int:
    return next((i for i, most in enumerate(LENGTHS) if length <= most), len(LENGTHS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order of start, then kind."""
    return sorted((m.start(), k, m.end()) for k, (_, rx, group, least) in enumerate(BASE) for m in rx.finditer(text) if len(m[group]) >= least)


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, encoding, length class, step)."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m[0].rstrip("=") or m[0]
        code = encoding(token)
        out.append((m.start(), m.end(), code, _class(len(token)), _step(battery(token, code))))
    return out


def _table(code: int) -> tuple[bytes, bytes]:
    """Byte -> place in the alphabet, and the bytes that have none. Case is ignored where the alphabet has one case alone."""
    out = [255] * 256
    for c, i in PLACES[code].items():
        out[ord(c)] = i
        if c.swapcase() not in PLACES[code]:
            out[ord(c.swapcase())] = i
    return bytes(out), bytes(c for c in range(256) if out[c] == 255)


TABLES = {code: _table(code) for code in READ_AS}
#: Least deviation of each step from 1 on, for tests of one side and of two, corrected as in ``battery``.
ONE_SIDE, TWO_SIDES = (np.array([-NormalDist().inv_cdf(10 ** (-k / STEPS) / 3 / sides) for k in range(1, MOST_STEPS + 1)]) for sides in (1, 2))


def _by_number(step: Callable[[np.ndarray], np.ndarray], most: int) -> np.ndarray:
    """Steps of the numbers from 0 to ``most``, or to one with the last step, which all greater ones share."""
    upto = 1024
    while True:
        out = step(np.arange(min(upto, most + 1))).astype(np.uint8)
        if upto > most or out[-1] == MOST_STEPS:
            return out
        upto *= 2


@cache
def _chi_steps(n: int, size: int) -> np.ndarray:
    """Sum of the squares of n characters' counts -> step of ``battery``'s first test."""
    df = size - 1

    def step(squares: np.ndarray) -> np.ndarray:
        chi = squares * size / n - n
        return np.searchsorted(ONE_SIDE, (np.cbrt(np.maximum(chi, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)), "right")

    return _by_number(step, n * n)


@cache
def _run_steps(n: int) -> np.ndarray:
    """n times the characters above the middle, plus the changes -> step of the second."""
    high, changes = np.divmod(np.arange(n * (n + 1)), n)
    mean = 2 * high * (n - high) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z = np.where(var > 0, np.abs(1 + changes - mean) / np.sqrt(np.where(var > 0, var, 1)), 0)
    return np.where((high == 0) | (high == n), _step(min(1.0, 3 * 2.0 ** (1 - n))), np.searchsorted(TWO_SIDES, z, "right")).astype(np.uint8)


@cache
def _serial_steps(n: int, size: int) -> np.ndarray:
    """Four times the serial sum without its sign -> step of the third."""
    return _by_number(lambda s: np.searchsorted(TWO_SIDES, s / 4 / ((size * size - 1) / 12 * math.sqrt(n - 1)), "right"), (n - 1) * (size - 1) ** 2)


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums up to each place: that of any stretch is the difference of two."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _pieces(x: np.ndarray, many: np.ndarray, size: int, sizes: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """Places of letters, text by text, and their number in each -> (length class, steps of ``battery``) of all pieces of each length in ``sizes``."""
    first = np.cumsum(many) - many
    above, off = 2 * x.astype(np.int16) >= size, 2 * x.astype(np.int16) - (size - 1)
    # Two neighbours that change or multiply stand at the place of the first.
    high, changes, serial = _sums(above), _sums(above[1:] != above[:-1]), _sums(off[1:] * off[:-1])
    for length in (LEAST, 24, 32):
        n, counts, before = length, None, None
        while n in sizes:
            whole = many // n
            ahead = np.cumsum(whole) - whole
            nth = np.arange(whole.sum()) - np.repeat(ahead, whole)
            start = np.repeat(first, whole) + n * nth
            if n == LEAST:  # what is left at a text's end is part of a last piece
                start = np.concatenate((start, (first + many)[(many >= n) & (many % n > 0)] - n))
            if not len(start):
                break
            if counts is None:
                piece = np.ndarray(len(x) - n + 1, f"V{n}", x, 0, (1,))[start].view(np.uint8).reshape(-1, n)
                counts = np.bincount((piece + size * np.arange(len(piece))[:, None]).ravel(), minlength=size * len(piece)).reshape(-1, size).astype(np.float32)
            else:  # a piece is two of those of half its length
                left = np.repeat(before, whole) + 2 * nth
                counts = counts.take(left, 0) + counts.take(left + 1, 0)
            # Exact: no sum is above 256 * 256.
            squares, last = np.einsum("ij,ij->i", counts, counts).astype(np.int64), start + n - 1
            chi, far = _chi_steps(n, size), _serial_steps(n, size)
            steps = np.maximum(chi[np.minimum(squares, len(chi) - 1)], _run_steps(n)[n * (high[last + 1] - high[start]) + changes[last] - changes[start]])
            yield sizes[n], np.maximum(steps, far[np.minimum(np.abs(serial[last] - serial[start]), len(far) - 1)])
            n, before = 2 * n, ahead


def decoys(texts: list[str], long: list[bool] | None = None) -> list[tuple[int, int, int, int]]:
    """(encoding, length class, step, count) of what prose looks like in each encoding: the letters and digits of all text that are in its alphabet.

    Candidates are left out, as they are what is tested; ``long`` tells the texts that may have any. Pieces are as long as
    the longest candidate of the class before, so no candidate of their class is shorter.
    """
    total: Counter = Counter()
    raw = [(CANDIDATE.sub(" ", t) if hint else t).encode("ascii", "replace") for t, hint in zip(texts, long or [True] * len(texts), strict=True)]
    sizes = {n: k for k, n in enumerate((LEAST, *LENGTHS))}
    begin = 0
    while begin < len(raw):
        end, n = begin, 0
        while end < len(raw) and (end == begin or n + len(raw[end]) <= AT_ONCE):
            n, end = n + len(raw[end]), end + 1
        for code in READ_AS:
            own = [t.translate(*TABLES[code]) for t in raw[begin:end]]
            # A text without a whole piece has no part in any.
            own = [t for t in own if len(t) >= LEAST]
            for k, steps in _pieces(np.frombuffer(b"".join(own), np.uint8), np.array([*map(len, own)], np.int64), len(PLACES[code]), sizes) if own else ():
                for step, many in enumerate(np.bincount(steps).tolist()):
                    if many:
                        total[code, k, step] += many
        begin = end
    return [(*key, n) for key, n in total.items()]


SPAN = "array<struct<start:int,kind:int,end:int>>"
TOKEN = "array<struct<start:int,end:int,code:int,size:int,step:int>>"
DECOY = "array<struct<code:int,size:int,step:int,n:int>>"


def scan(docs: DataFrame, keep_text: bool = True, null: bool = True) -> DataFrame:
    """docs with ``text`` -> with ``base``, ``tokens`` and ``decoys``, arrays of spans, candidates and decoys. Null text counts as empty.

    Decoys are counts over several rows, and stand in the first of them; without ``null`` there are none.
    """
    kept = docs.drop("base", "tokens", "decoys")
    names = [c for c in kept.columns if keep_text or c != "text"]
    shapes = [pa.list_(pa.struct([(n, pa.int32()) for n in fields])) for fields in (("start", "kind", "end"), ("start", "end", "code", "size", "step"), ("code", "size", "step", "n"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            texts = column.to_pylist()
            fixed, long = (pc.fill_null(pc.match_substring_regex(column, x), False).to_pylist() for x in (HINT, CANDIDATE_HINT))
            found = [
                [base_spans(t) if hint else [] for t, hint in zip(texts, fixed, strict=True)],
                [candidates(t) if hint else [] for t, hint in zip(texts, long, strict=True)],
                [decoys([t or "" for t in texts], long) if null and not k else [] for k in range(len(texts))],
            ]
            arrays = [pa.array([[dict(zip([f.name for f in s.value_type], x, strict=True)) for x in row] for row in rows], s) for rows, s in zip(found, shapes, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *arrays], [*names, "base", "tokens", "decoys"])

    schema = kept.select(*names).schema
    for name, kind in (("base", SPAN), ("tokens", TOKEN), ("decoys", DECOY)):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return kept.mapInArrow(run, schema)


def tail(counts: dict[int, int]) -> list[float]:
    """Decoys by step -> for each step the share of prose that has it or a lesser one.

    One is added to both counts. Below the step that ``TAIL_FROM`` decoys reach, the share falls on as it does from there
    to ``TAIL_TO`` decoys, but not below what is seen: as the logarithm of such a share is concave, that is too much
    rather than too little. The last step has all greater scores in it and takes no part. So the number of decoys, which
    grows with the table, doesn't limit how small a share can be.
    """
    upto = np.cumsum([counts.get(s, 0) for s in range(MOST_STEPS + 1)])
    out = ((upto + 1) / (upto[-1] + 1)).tolist()
    low, high = (int(np.searchsorted(upto, n)) for n in (TAIL_FROM, TAIL_TO))
    high = min(high, MOST_STEPS - 1)
    if low < high:
        slope = math.log(upto[high] / upto[low]) / (high - low)
        for s in range(low):
            out[s] = min(out[s], max(float(upto[s] / upto[-1]), out[low] * math.exp(slope * (s - low))))
    return out


def limits(scanned: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[tuple[int, int], int]:
    """(encoding, length class) -> the largest step that counts as random.

    A candidate's p-value is the share of decoys of its encoding that score as random as it does. Those of its length class
    or a shorter one bound it, as longer prose only looks less random; the least bound is taken. Steps of all classes are
    put in order of p-value; the largest p at most rate * rank / n is the limit of all. There are at most 12 * 8 * 91
    counts, whatever the table.
    """
    got = scanned.select(F.explode("tokens").alias("t")).groupBy("t.code", "t.size", "t.step").agg(F.count("*").alias("n"))
    prose = scanned.select(F.explode("decoys").alias("t")).groupBy("t.code", "t.size", "t.step").agg(F.sum("t.n").alias("n"))
    own, null = ({(r.code, r.size, r.step): r.n for r in x.collect()} for x in (got, prose))
    by: dict[tuple[int, int], dict[int, int]] = {}
    for (code, size, step), n in null.items():
        by.setdefault((code, size), {})[step] = n
    tails = {key: tail(counts) for key, counts in by.items()}
    p = {(code, size, step): min([t[step] for (c, z), t in tails.items() if c == FAMILY[code] and z <= size], default=1.0) for code, size, step in own}
    n, rank, limit = sum(own.values()), 0, -1.0
    for key in sorted(p, key=p.get):
        rank += own[key]
        if p[key] <= rate * rank / n:
            limit = p[key]
    out: dict[tuple[int, int], int] = {}
    for (code, size, step), value in p.items():
        if value <= limit:
            out[code, size] = max(out.get((code, size), -1), step)
    return out


def with_spans(scanned: DataFrame, found: dict[tuple[int, int], int]) -> DataFrame:
    """Output of ``scan`` and limits -> ``spans``: the fixed ones, and random tokens that none of them overlaps."""
    limit = F.create_map(*[F.lit(x) for (c, s), step in sorted(found.items()) for x in (c * 100 + s, step)]) if found else F.create_map().cast("map<int,int>")
    # Both arrays are bound to one element, so that neither is made anew for each token.
    both = F.transform(F.array(F.struct("base", "tokens")), lambda x: F.filter(x["tokens"], lambda t: (t["step"] <= F.coalesce(F.element_at(limit, t["code"] * 100 + t["size"]), F.lit(-1))) & ~F.exists(x["base"], lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))
    more = F.transform(F.element_at(both, 1), lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")))
    return scanned.withColumn("spans", F.array_sort(F.concat("base", more))).drop("tokens", "decoys")


def find_secrets(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs with ``text`` -> with ``base`` and ``spans``, arrays of (start, kind, end) in code points, end exclusive, kinds as in ``KINDS``.

    With texts, these are scanned twice, for the limits and for the spans, and not stored.
    """
    docs = docs.drop("spans")
    if keep_text:
        return with_spans(scan(docs, null=False), limits(stored(scan(docs.select("text"), False).select("tokens", "decoys"))))
    scanned = stored(scan(docs, False))
    return with_spans(scanned, limits(scanned))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with each stretch of secrets in ``text`` replaced by a mark. An assignment goes whole. Null texts stay null."""
    found = find_secrets(docs)
    # Spans that overlap or touch an earlier one are part of its stretch.
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["at"]
        done = F.when(new, F.concat(a["done"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["done"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), done.alias("done"))

    clean = F.aggregate("spans", state, step, lambda a: F.concat(a["done"], F.substr(text, a["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(text)).drop("base", "spans")
