"""Stupid-backoff scores (Brants et al., 2007), computed relationally.

S(w | context) = c(context w) / c(context) where the n-gram occurs, else 0.4 * S(w | shorter context); a word without
context has c(w) / N. A document's own n-grams are no evidence for it: counts of n-grams and of their contexts are those
of all other documents, so that a text which nothing resembles backs off; only c(w) and N are of all documents. A
document's score is the mean logarithm over its words.

Documents are exploded into their n-grams, once each, with how often the document has them and their context. Rows meet by
the context's hash, where n-grams and contexts are counted. N-grams that are found yield their logarithm; the others are
asked for in the next lower order, which only counts ``ORDER`` - 1 words. What a task adds to a document is one row, and
in the end all is summed by document. An order takes ``PASSES`` passes, each over all documents and the contexts of one
share of hashes, so that no more than a share of the n-grams is in a shuffle at once; a pass is stored as sums and
questions, and its shuffle files go with it. A task counts about ``ROWS`` rows, however large the input is.

N-grams and contexts that make up ``FREQUENT`` of all or more, so at most 1 / ``FREQUENT`` of each kind, are counted
exactly in a pass of their own and broadcast. A frequent n-gram of the highest order needs no shuffle, and rows of a
frequent context are dealt by their word, so no key is hot. Candidates for these tables come from a bounded sample; what
the sample misses goes the common way, with the same result. The pass that counts them counts all words, too.

Words are 64 bits of a hash, n-grams as many times that. Within a batch of texts words are numbers, so that what depends on
a word alone is found once for each different one, and a document's n-grams are counted by one sort of packed numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import stored

BACKOFF = 0.4
#: Words of the longest n-grams.
ORDER = 2
#: Share of all n-grams of an order, or of their contexts, from which one is broadcast with its count.
FREQUENT = 3e-6
#: Characters of the documents that candidates for these are taken from.
SAMPLE_CHARS = 20_000_000
#: Words of documents that are exploded at once.
AT_ONCE = 500_000
#: Keys over which rows of a frequent context are dealt.
SALTS = 256
#: Passes of an order, and n-grams of documents that one task counts.
PASSES, ROWS = 4, 1_000_000
#: The setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Stands before a document's first word.
START = np.uint64(0)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Different words of a task that are kept before they are merged.
WORDS_KEPT = 2_000_000
#: Kind of the counts of all words.
WORD = -1

_U = np.uint64
#: Fixed values of the 64-bit xxHash, and the bytes from which on it takes another form.
_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
LONG_WORD = 32

#: What is frequent of a kind: columns of words, their hashes in order, where those begin by their first bits, counts.
Frequent = tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << _U(by)) | (h >> _U(64 - by))


def hashes_of(words: pa.LargeStringArray) -> np.ndarray:
    """XXH64 of each word: of those under ``LONG_WORD`` bytes for all at once, a few bytes at a time, of others one by one."""
    from xxhash import xxh64_intdigest

    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    size = int(ends[-1] - ends[0])
    raw = np.zeros(size // 8 * 8 + 16, np.uint8)
    if size:
        raw[:size] = np.frombuffer(words.buffers()[2], np.uint8, size, int(ends[0]))
    longs, start, length = raw.view("<u8"), ends[:-1] - ends[0], np.diff(ends)
    short = length < LONG_WORD

    def read(place: np.ndarray) -> np.ndarray:
        """Eight bytes from any place on."""
        shift, at = (place & 7).astype(np.uint64) << _U(3), place >> 3
        return (longs[at] >> shift) | (longs[at + 1] << _U(1) << (_U(63) - shift))

    h = length.astype(np.uint64) + _P5
    for k in range(0, LONG_WORD - 8, 8):
        on = np.flatnonzero(short & (length >= k + 8))
        h[on] = _rotated(h[on] ^ (_rotated(read(start[on] + k) * _P2, 31) * _P1), 27) * _P1 + _P4
    on = np.flatnonzero(short & (length & 4 > 0))
    h[on] = _rotated(h[on] ^ ((read(start[on] + (length[on] & -8)) & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    for k in range(3):
        on = np.flatnonzero(short & (length & 3 > k))
        h[on] = _rotated(h[on] ^ ((read(start[on] + (length[on] & -4) + k) & _U(0xFF)) * _P5), 11) * _P1
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    h ^= h >> _U(32)
    for i in np.flatnonzero(~short):
        h[i] = xxh64_intdigest(raw[start[i] : start[i] + length[i]].tobytes())
    return h


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, by ASCII white space, of all texts side by side, as places among the hashes of the different ones; these and START; how many words each text has."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, parents = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(words, "")
    words, parents = words.filter(real).dictionary_encode(), parents.filter(real).to_numpy()
    return words.indices.to_numpy().astype(np.int64), np.append(hashes_of(words.dictionary), START), np.bincount(parents, minlength=len(texts)).astype(np.int64)


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts side by side, and how many each text has."""
    words, hashes, many = words_of(texts)
    return hashes[words], many


def windows_of(codes: np.ndarray, many: np.ndarray, order: int, start: np.uint64 | int = START) -> list[np.ndarray]:
    """For each word the ``order`` - 1 words before it, farthest first, and the word itself; ``start`` before the first."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(many) - many, many)
    out = []
    for back in range(order - 1, 0, -1):
        earlier = np.full(len(codes), start, codes.dtype)
        earlier[back:] = codes[: max(0, len(codes) - back)]
        earlier[place < back] = start
        out.append(earlier)
    return [*out, codes]


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def lengths(begin: np.ndarray, size: int) -> np.ndarray:
    """Rows of each run."""
    return np.diff(np.append(begin, size))


def distinct(columns: list[np.ndarray], bounds: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of columns of numbers below ``bounds``, in order, and how often each occurs."""
    bits = [max(1, int(b - 1).bit_length()) for b in bounds]
    if sum(bits) > 64:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        begin = runs(columns)
        return [c[begin] for c in columns], lengths(begin, len(columns[0]))
    key = np.zeros(len(columns[0]), np.uint64)
    for c, b in zip(columns, bits, strict=True):
        key = (key << _U(b)) | c.astype(np.uint64)
    key.sort()
    begin = runs([key])
    n, key, out = lengths(begin, len(key)), key[begin], []
    for b in reversed(bits):
        out.append((key & _U((1 << b) - 1)).astype(np.int64))
        key = key >> _U(b)
    return out[::-1], n


def by_word(of: Callable[[list[np.ndarray]], np.ndarray], hashes: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """``of`` columns of hashes, for columns of places among ``hashes``; of a single column once for each different word."""
    return of([hashes])[columns[0]] if len(columns) == 1 else of([hashes[c] for c in columns])


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * GOLDEN
        h ^= h >> np.uint64(29)
    return h


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where sorted hashes begin by their first bits, which are as many as leave about one to each."""
    bits = max(1, len(keys).bit_length())
    return np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)).astype(np.int32)


def found_in(known: list[np.ndarray], keys: np.ndarray, starts: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``columns`` that are in ``known``, whose hashes are ``keys``, and where they are there."""
    if not len(keys) or not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, last = mixed(columns), len(keys) - 1
    at = np.minimum(starts[h >> _U(65 - len(starts).bit_length())], last)
    behind = np.flatnonzero(keys[at] < h)
    while len(behind):
        at[behind] += 1
        behind = behind[at[behind] <= last]
        behind = behind[keys[at[behind]] < h[behind]]
    row = np.flatnonzero(keys[np.minimum(at, last)] == h)
    row = row[np.logical_and.reduce([x[row] == own[at[row]] for x, own in zip(columns, known, strict=True)])]
    return row, at[row]


def counts_of(table: Frequent, columns: list[np.ndarray]) -> np.ndarray:
    """Counts of what ``table`` has, else 0."""
    *known, c = table
    row, at = found_in(*known, columns)
    out = np.zeros(len(columns[0]), np.int64)
    out[row] = c[at]
    return out


def pass_of(context: list[np.ndarray], passes: int) -> np.ndarray:
    """The pass of each context. Their number comes from the driver, so that workers agree with it."""
    return (mixed(context) >> np.uint64(40)) % np.uint64(passes)


def salt_of(gram: np.ndarray, context: np.ndarray, row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Deals rows of a frequent n-gram by document, others of a frequent context by word."""
    by = lambda x: (mixed([x]) >> np.uint64(20)) % np.uint64(SALTS)
    return np.where(gram, by(row.view(np.uint64)), np.where(context, by(word), np.uint64(0))).astype(np.int32)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Rows and texts, so many at once as have ``AT_ONCE`` words, about."""
    for batch in batches:
        rows, texts = batch.column(0), batch.column(2)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 5 * AT_ONCE)))
            yield rows.slice(at, end - at), texts.slice(at, end - at)
            at = end


def names(order: int) -> list[str]:
    """Columns of an n-gram's words, the last word last."""
    return [f"w{i}" for i in range(order - 1, -1, -1)]


def _signed(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(c.view(np.int64)) for c in columns]


def _unigram(need: np.ndarray, c: np.ndarray, total: int) -> np.ndarray:
    return need * (np.log(np.maximum(c, 1)) - math.log(max(1, total)))


def explode(docs: DataFrame, order: int, share: int, top: bool, total: int, known) -> DataFrame:
    """(row, text) -> (row, words of an n-gram, n, m, salt, value), for n-grams of one pass, once each for a document: n times the n-gram, m times its context.

    In the highest order, what frequent n-grams add to a document is one row, with ``value`` and the number of its words in ``n``.
    """
    schema = "row long, " + ", ".join(f"{c} long" for c in names(order)) + ", n int, m int, salt int, value double"
    passes = PASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = known.value
        fields = ["row", *names(order), "n", "m", "salt", "value"]
        for rows, texts in _batches(batches):
            words, hashes, many = words_of(texts)
            document = np.repeat(np.arange(len(texts)), many)
            columns = windows_of(words, many, order, len(hashes) - 1)
            if order > 1:
                pick = np.flatnonzero(by_word(lambda x: pass_of(x, passes) == share, hashes, columns[:-1]))
                document, columns = document[pick], [c[pick] for c in columns]
            (document, *columns), n = distinct([document, *columns], [len(texts), *[len(hashes)] * order])
            m = n
            if order > 1 and len(n):  # rows are in order of document and context
                begin = runs([document, *columns[:-1]])
                m = np.repeat(np.add.reduceat(n, begin), lengths(begin, len(n)))
            row = rows.to_numpy()
            c = by_word(lambda x: counts_of(tables["gram", order], x), hashes, columns)
            of_context = by_word(lambda x: counts_of(tables["context", order], x), hashes, columns[:-1]) if order > 1 else c
            if top:
                done = c > n if order > 1 else c > 0
                at, own, often = document[done], n[done], c[done]
                value = own * (np.log(often - own) - np.log(of_context[done] - m[done])) if order > 1 else _unigram(own, often, total)
                sums, n_words = np.bincount(at, value, len(row)).astype(np.float64), np.bincount(at, own, len(row)).astype(np.int32)
                some = np.flatnonzero(n_words)
                blank, salt = np.zeros(len(some), np.int64), (mixed([row[some].view(np.uint64)]) >> np.uint64(20)) % np.uint64(SALTS)
                yield pa.RecordBatch.from_arrays([pa.array(row[some]), *[pa.array(blank)] * order, pa.array(n_words[some]), pa.array(n_words[some]), pa.array(salt.astype(np.int32)), pa.array(sums[some])], fields)
                document, columns, n, m, c, of_context = document[~done], [x[~done] for x in columns], n[~done], m[~done], c[~done], of_context[~done]
            own, columns = row[document], [hashes[x] for x in columns]
            salt = salt_of(c > 0, of_context > 0, own, columns[-1]) if order > 1 else np.zeros(len(own), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), *_signed(columns), pa.array(n.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(salt), pa.nulls(len(n), pa.float64())], fields)

    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def settle(rows: DataFrame, order: int, top: bool, total: int, known) -> DataFrame:
    """Rows of ``explode``, and of what was asked with ``need``, dealt by context -> (row, value, n_words), and (row, words, need, salt, share) that the next lower order is asked for."""
    words, passes = names(order)[1:], PASSES
    fields = ["row", "value", "n_words", *words, "need", "salt", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, tables = list(batches), known.value
        if not any(b.num_rows for b in got):
            return
        got = pa.Table.from_batches(got)
        of = lambda name: got.column(name).to_numpy()
        row, n, m, value = of("row"), of("n").astype(np.int64), of("m").astype(np.int64), of("value")
        columns = [of(c).view(np.uint64) for c in names(order)]
        need = n if top else of("need").astype(np.int64)
        done = ~np.isnan(value)
        row_done, value_done, n_done = row[done], value[done], n[done]
        row, n, m, need, columns = row[~done], n[~done], m[~done], need[~done], [c[~done] for c in columns]
        if not top:  # a document's own counts meet what it asked for
            _, first, inverse = np.unique(mixed([*columns, row.view(np.uint64)]), return_index=True, return_inverse=True)
            n, m, need = (np.bincount(inverse, x, len(first)).astype(np.int64) for x in (n, m, need))
            sort = np.argsort(row[first], kind="stable")
            n, m, need, first = n[sort], m[sort], need[sort], first[sort]
            row, columns = row[first], [c[first] for c in columns]

        def counted(kind: str, of: list[np.ndarray]) -> np.ndarray:
            key = mixed(of)
            sort = np.argsort(key)
            begin = runs([key[sort]])
            everywhere = counts_of(tables[kind, order], [x[sort[begin]] for x in of])
            out = np.empty_like(n)
            out[sort] = np.repeat(np.where(everywhere > 0, everywhere, np.add.reduceat(n[sort], begin)), lengths(begin, len(n)))
            return out

        if len(row):
            cg, cc = counted("gram", columns), counted("context", columns[:-1])
        else:
            cg = cc = n
        found, wanted = cg > n, need > 0
        with np.errstate(divide="ignore"):
            value = np.where(found, need * (np.log(np.where(found, cg - n, 1)) - np.log(np.where(found, cc - m, 1))), need * math.log(BACKOFF))
        ask = ~found
        if order == 2:  # Frequent words are answered here; only rare ones meet their counts by a shuffle.
            left = np.flatnonzero(ask)
            often = counts_of(tables["gram", 1], [c[left] for c in columns[1:]])
            left, often = left[often > 0], often[often > 0]
            value[left] += _unigram(need[left], often, total)
            ask[left] = False
        every = np.concatenate([row_done, row[wanted]])  # a document's rows come together, once from each batch
        begin = runs([every])
        every, sums = every[begin], np.add.reduceat(np.concatenate([value_done, value[wanted]]), begin) if len(begin) else np.zeros(0)
        n_words = np.add.reduceat(np.concatenate([n_done, need[wanted]]), begin) if top and len(begin) else np.zeros(len(every), np.int64)
        none = lambda k, t: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(sums), pa.array(n_words), *[none(len(every), pa.int64()) for _ in words], *[none(len(every), pa.int32()) for _ in range(3)]], fields)
        ask &= wanted
        row, need, columns = row[ask], need[ask], [c[ask] for c in columns[1:]]
        share = salt = np.zeros(len(row), np.int32)
        if order > 2:
            share = pass_of(columns[:-1], passes).astype(np.int32)
            salt = salt_of(counts_of(tables["gram", order - 1], columns) > 0, counts_of(tables["context", order - 1], columns[:-1]) > 0, row, columns[-1])
        yield pa.RecordBatch.from_arrays([pa.array(row), none(len(row), pa.float64()), none(len(row), pa.int64()), *_signed(columns), pa.array(need.astype(np.int32)), pa.array(salt), pa.array(share)], fields)

    schema = "row long, value double, n_words long, " + ", ".join(f"{c} long" for c in words) + ", need int, salt int, share int"
    dealt = rows.repartition(max(2, math.ceil(total / PASSES / ROWS)), "salt", *names(order)[:-1])
    met = dealt.drop("salt").mapInArrow(run, schema)
    return met.groupBy("row", *words, "salt", "share").agg(F.sum("value").alias("value"), F.sum("n_words").alias("n_words"), F.sum("need").cast("int").alias("need"))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) -> (row, doc_id), by the same scan as all others: the condition, which always holds, keeps the text read."""
    return docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) >= 0).select("row", "doc_id")


def kinds(order: int) -> list[tuple[str, int, slice]]:
    """What may be frequent: words, then n-grams and contexts of each order, as columns of its windows."""
    return [("gram", 1, slice(0, 1)), *((k, o, s) for o in range(2, order + 1) for k, s in (("gram", slice(0, o)), ("context", slice(0, o - 1))))]


def candidates(docs: DataFrame, order: int) -> list[list[np.ndarray]]:
    """For each kind the columns of what is frequent in a sample of about ``SAMPLE_CHARS``, in one task, and the contexts of its n-grams."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_CHARS / max(1, chars))
    sample = docs.where(F.shiftrightunsigned(F.xxhash64("text", "row"), 11) < share * float(1 << 53)) if share < 1 else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [codes_of(texts) for _, texts in _batches(batches)]
        codes, many = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
        kept: dict[tuple[str, int], list[np.ndarray]] = {}
        for kind, o, part in reversed(kinds(order)):
            columns = windows_of(codes, many, o)[part]
            _, first, n = np.unique(mixed(columns), return_index=True, return_counts=True)
            kept[kind, o] = [c[first[n >= max(2, FREQUENT / 2 * len(codes))]] for c in columns]
        for k, (kind, o, part) in enumerate(kinds(order)):
            columns = kept[kind, o]
            if kind == "context":
                columns = [np.concatenate(x) for x in zip(columns, kept["gram", o][part], strict=True)]
            _, first = np.unique(mixed(columns), return_index=True)
            columns = [c[first] for c in columns]
            blank = np.zeros(len(first), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), *_signed([*columns, *[blank] * (order - len(columns))])], ["kind", *(f"x{i}" for i in range(order))])

    found = sample.select("row", "doc_id", "text").repartition(1).mapInArrow(run, "kind int, " + ", ".join(f"x{i} long" for i in range(order))).toArrow()
    kind = found.column("kind").to_numpy()
    every = [found.column(f"x{i}").to_numpy().view(np.uint64) for i in range(order)]
    return [[every[i][kind == k] for i in range(part.stop)] for k, (_, _, part) in enumerate(kinds(order))]


def frequent(docs: DataFrame, order: int) -> tuple[int, dict[tuple[str, int], Frequent], DataFrame]:
    """Number of all words, for each kind what is frequent with its exact count, and (w0, c): the words of all documents."""
    listed = candidates(docs, order)
    keys = [mixed(columns) for columns in listed]
    orders = [np.argsort(k) for k in keys]
    listed, keys = [[c[o] for c in columns] for columns, o in zip(listed, orders, strict=True)], [k[o] for k, o in zip(keys, orders, strict=True)]
    shared = docs.sparkSession.sparkContext.broadcast([(known, k, starts_of(k)) for known, k in zip(listed, keys, strict=True)])
    most = WORDS_KEPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        sums, total = [np.zeros(len(k), np.int64) for _, k, _ in tables], 0
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            word, n = (np.concatenate([k[i] for k in kept]) if kept else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
            sort = np.argsort(word)
            begin = runs([word[sort]])
            return word[sort[begin]], np.add.reduceat(n[sort], begin) if len(begin) else n

        def block(kind: int, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(place), pa.array(n)], ["kind", "place", "c"])

        for _, texts in _batches(batches):
            words, hashes, many = words_of(texts)
            total += len(words)
            each = np.bincount(words, minlength=len(hashes))
            kept.append((hashes[:-1], each[:-1]))
            if sum(len(word) for word, _ in kept) > most:
                kept = [merged()]
                if len(kept[0][0]) > most // 2:
                    yield block(WORD, kept[0][0].view(np.int64), kept[0][1])
                    kept = []
            for k, (_, o, part) in enumerate(kinds(order)):
                if o == 1:
                    columns, n = [hashes[:-1]], each[:-1]
                else:
                    columns = windows_of(words, many, o, len(hashes) - 1)[part]
                    columns, n = distinct(columns, [len(hashes)] * len(columns))
                    columns = [hashes[c] for c in columns]
                row, at = found_in(*tables[k], columns)
                np.add.at(sums[k], at, n[row])
        for k, n in enumerate([*sums, np.array([total])]):
            place = np.flatnonzero(n)
            yield block(k, place, n[place])
        word, n = merged()
        yield block(WORD, word.view(np.int64), n)

    counts = stored(docs.select("row", "doc_id", "text").mapInArrow(run, "kind int, place long, c long").groupBy("kind", "place").agg(F.sum("c").alias("c")))
    found = counts.where(F.col("kind") != WORD).toArrow()  # at most 2 / FREQUENT of a kind
    kind, place, c = (found.column(x).to_numpy() for x in ("kind", "place", "c"))
    total = int(c[kind == len(listed)].sum())
    tables = {}
    for k, (name, o, _) in enumerate(kinds(order)):
        pick = (kind == k) & (c >= FREQUENT * total)
        at = np.sort(place[pick])
        tables[name, o] = [x[at] for x in listed[k]], keys[k][at], starts_of(keys[k][at]), c[pick][np.argsort(place[pick])]
    return total, tables, counts.where(F.col("kind") == WORD).select(F.col("place").alias("w0"), "c")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries within leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def score(docs: DataFrame, order: int | None = None) -> DataFrame:
    """docs with doc_id and text -> doc_id, n_words, log_score: the mean of ln S over a document's words, null where it has none.

    Null text has no words. Repeated rows are as many documents, each evidence for the other. The empty table has no rows.
    Only the columns doc_id and text are read, so others can't clash. A row's number is its place in the input;
    all scans read the same columns, so that Spark prunes none of them differently and the numbers agree.
    """
    order = order or ORDER
    docs = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.monotonically_increasing_id())
    spark = docs.sparkSession
    with shuffles_removed(spark):
        total, tables, words = frequent(docs, order)
        known = spark.sparkContext.broadcast(tables)
        parts, asked = [numbered(docs).select("row", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("n_words"), "doc_id")], None
        part = lambda df, value, n_words: parts.append(df.select("row", value.alias("value"), n_words.cast("long").alias("n_words"), F.lit(None).cast("long").alias("doc_id")))
        for o in range(order, 1, -1):
            top, above, asked = o == order, asked, None
            for share in range(PASSES):
                rows = explode(docs, o, share, top, total, known)
                if not top:
                    more = above.where(F.col("share") == share).select("row", *names(o), F.lit(0).alias("n"), F.lit(0).alias("m"), "salt", F.lit(None).cast("double").alias("value"), "need")
                    rows = rows.withColumn("need", F.lit(0)).unionByName(more)
                met = stored(settle(rows, o, top, total, known))
                part(met.where("need IS NULL"), F.col("value"), F.col("n_words"))
                questions = met.where("need IS NOT NULL").select("row", *names(o)[1:], "need", "salt", "share")
                asked = questions if asked is None else asked.union(questions)
        if asked is None:
            rows = explode(docs, 1, 0, True, total, known)
            part(rows, F.coalesce("value", F.lit(0.0)), F.col("n"))
            asked = rows.where("value IS NULL").select("row", "w0", F.col("n").alias("need"))
        word = asked.join(words, "w0")
        part(word, F.col("need") * (F.ln(F.col("c").cast("double")) - math.log(max(1, total))), F.lit(0))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    sums = every.groupBy("row").agg(F.sum("value").alias("value"), F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"))
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("value") / F.col("n_words")).alias("log_score"))
