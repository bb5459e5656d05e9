"""Stupid backoff against a count by hand."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from barloom.llm import lm


def plain(texts: list[str | None], order: int) -> list[float | None]:
    """Counts of all documents less the document's own, backed off word by word."""
    each = [(t or "").encode().split() for t in texts]

    def grams(x: list[bytes], o: int) -> list[tuple]:
        padded = [None] * (o - 1) + x
        return [tuple(padded[i : i + o]) for i in range(len(x))]

    every = {o: Counter(g for x in each for g in grams(x, o)) for o in range(1, order + 1)}
    contexts = {o: Counter(g[:-1] for x in each for g in grams(x, o)) for o in range(2, order + 1)}
    n = sum(every[1].values())

    def score(x: list[bytes]) -> float | None:
        if not x:
            return None
        own = {o: Counter(grams(x, o)) for o in range(1, order + 1)}
        own_contexts = {o: Counter(g[:-1] for g in grams(x, o)) for o in range(2, order + 1)}
        total = 0.0
        for i in range(len(x)):
            for o in range(order, 0, -1):
                g = grams(x, o)[i]
                if o == 1:
                    total += math.log(every[1][g] / n)
                elif (c := every[o][g] - own[o][g]) > 0:
                    total += math.log(c / (contexts[o][g[:-1]] - own_contexts[o][g[:-1]]))
                    break
                else:
                    total += math.log(0.4)
        return total / len(x)

    return [score(x) for x in each]


TEXTS = [" ".join(f"w{(i * i * k + k) % (7 + 40 * (k % 5))}" for k in range(1, 40 + i)) for i in range(30)] + [None, "", "one", "one two", "one two", "w1 w2 unseen", "x x x x", "é " * 30]


@pytest.mark.parametrize(("order", "partitions", "share"), [(1, 2, 0.01), (2, 1, 3e-6), (2, 5, 0.01), (2, 3, 2.0), (3, 4, 0.01)])
def test_scores(spark, monkeypatch, order, partitions, share):
    """Orders, partitionings, few and many frequent n-grams or none, nulls, repeated rows."""
    monkeypatch.setattr(lm, "FREQUENT", share)
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(partitions)
    got = {r.doc_id: r for r in lm.score(docs, order).collect()}
    assert len(got) == len(TEXTS)
    for (i, t, _), want in zip(rows, plain(TEXTS, order), strict=True):
        assert got[i].n_words == len((t or "").split())
        assert (got[i].log_score is None) == (want is None) and (want is None or abs(got[i].log_score - want) < 1e-9)


def test_small_samples_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(lm, "FREQUENT", 0.02)
    want = {r.doc_id: r.log_score for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "SAMPLE_CHARS", 500)
    monkeypatch.setattr(lm, "AT_ONCE", 10)
    got = {r.doc_id: r.log_score for r in lm.score(docs).collect()}
    assert got.keys() == want.keys() and all(a == want[i] or abs(a - want[i]) < 1e-9 for i, a in got.items())


def test_passes_change_nothing(spark, monkeypatch):
    """Any number of passes gives the same scores; the setting that removes shuffle files is as before."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(2)
    for passes, rows in ((1, 1_000_000), (3, 50)):
        monkeypatch.setattr(lm, "PASSES", passes)
        monkeypatch.setattr(lm, "ROWS", rows)
        before = spark.conf.get(lm.CLEANUP, None)
        got = {r.doc_id: r.log_score for r in lm.score(docs).collect()}
        assert spark.conf.get(lm.CLEANUP, None) == before
        assert all((a is None) == (got[i] is None) and (a is None or abs(got[i] - a) < 1e-9) for i, a in enumerate(plain(TEXTS, 2)))


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_words_are_hashed_together(monkeypatch):
    """XXH64 of words of all lengths, by the library one by one only from 32 bytes on."""
    words = ["".join(chr(33 + (i * k + k) % 90) for i in range(n)) for n in range(1, 70) for k in (1, 7)] + ["é", "漢字", "ß" * 15, "ß" * 16, "\x00"]
    plain_hash, calls = xxhash.xxh64_intdigest, []
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x, *seed: calls.append(len(x)) or plain_hash(x, *seed))
    codes, many = lm.codes_of(pa.array([" ".join(words[:5]), None, " ", " ".join(words[5:])]).slice(0))
    assert codes.tolist() == [plain_hash(w) for w in words]
    assert many.tolist() == [5, 0, 0, len(words) - 5]
    assert len(calls) == sum(len(w.encode()) >= 32 for w in set(words))


def test_distinct_rows():
    """One sort of packed numbers, or of columns where these don't fit into 64 bits."""
    columns = [np.array([3, 0, 3, 2, 3, 0]), np.array([1, 5, 1, 5, 0, 5]), np.array([4, 4, 4, 0, 4, 4])]
    for bound in (6, 1 << 22):
        got, n = lm.distinct(columns, [bound] * 3)
        assert [tuple(map(int, r)) for r in zip(*got, strict=True)] == [(0, 5, 4), (2, 5, 0), (3, 0, 4), (3, 1, 4)]
        assert n.tolist() == [2, 1, 1, 2]
    got, n = lm.distinct([c[:0] for c in columns], [1, 1, 1])
    assert not len(n) and not any(map(len, got))


def test_found_rows():
    """What is known is found whatever the number of keys; of two rows with one hash, only the known one."""
    random = np.random.default_rng(0)
    for size in (0, 1, 2, 1000):
        known = random.integers(0, 1 << 63, size, np.uint64)
        known = known[np.argsort(lm.mixed([known]))]
        keys = lm.mixed([known])
        asked = np.concatenate([known[::3], random.integers(0, 1 << 63, 50, np.uint64), known[::-1]])
        row, at = lm.found_in([known], keys, lm.starts_of(keys), [asked])
        assert row.tolist() == [i for i, x in enumerate(asked) if x in known]
        assert (known[at] == asked[row]).all()
        assert not len(lm.found_in([known + np.uint64(1)], keys, lm.starts_of(keys), [asked])[0])


def test_one_pass_counts_all_words(spark, monkeypatch):
    """The pass that counts what is frequent has the words of all documents; numbers of documents need no Python."""
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, row long").repartition(3)
    want = Counter(w for t in TEXTS for w in (t or "").split())
    for kept in (2_000_000, 20):
        monkeypatch.setattr(lm, "WORDS_KEPT", kept)
        total, _, words = lm.frequent(docs, 2)
        assert total == sum(want.values())
        assert {r.w0 & (2**64 - 1): r.c for r in words.collect()} == {xxhash.xxh64_intdigest(w): n for w, n in want.items()}
    plan = lm.numbered(docs)._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and {tuple(r) for r in lm.numbered(docs).collect()} == {(i, i) for i in range(len(TEXTS))}
