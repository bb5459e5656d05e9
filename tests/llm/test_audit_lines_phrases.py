"""Filter audit, line dedup and collocations against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import collocations, filter_audit, line_dedup

LINE = "a line that is shared by more documents than a few of them"


# Filter audit


def plain_audit(docs: list[tuple], labels: dict[int, tuple]) -> dict[tuple, tuple]:
    firsts: dict[str, int] = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            firsts[text or ""] = min(doc_id, firsts.get(text or "", doc_id))
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > firsts[text],
        }
        quality, toxic = labels.get(doc_id, (0, 0))
        rows.append((lang or "", {f for f, bad in fails.items() if bad}, quality == 1, toxic == 1))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in gone)
                unique = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, order, step] = (len(left), len(hit), redundant, unique, sum(r[2] for r in hit), sum(r[3] for r in hit))
                shapley[part, f] += len(hit)
                gone += hit
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def texts_for_audit() -> list[tuple]:
    r = random.Random(3)
    docs = []
    for i in range(120):
        n = r.choice([0, 5, 199, 200, 260])
        vocab = r.choice([3, 1000])
        text = " ".join(f"{r.choice(['w', 'W'])}{r.randrange(vocab)}" for _ in range(n)) + r.choice(["", " #", "|", "\t\n "])
        docs.append((i, text if n or i % 2 else None, r.choice(["en", "de", None, ""])))
    docs += [(1000 + i, docs[i % 40][1], r.choice(["en", None])) for i in range(60)]
    docs += [(None, docs[3][1], "en"), (None, docs[3][1], "en"), (7, docs[7][1], "fr"), (7, docs[7][1], "fr")]
    return docs


@pytest.mark.parametrize("partitions", [1, 5])
def test_audit_agrees_with_a_count_of_all_orders(spark, partitions):
    docs = texts_for_audit()
    labels = {i: (i % 3 == 0, i % 5 == 0) for i in range(0, 1060, 2)}
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, A int").repartition(partitions)
    label = spark.createDataFrame([(i, int(q), int(t)) for i, (q, t) in labels.items()] + [(None, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(table, label).collect()}
    assert got == plain_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = filter_audit.audit(one, labels).collect()
    assert len(rows) == 600 and all(r.part == "" and r.good_lost == 0 and (r.kept == 1) == ("A" not in r.filter_order[: r.step]) for r in rows)


def test_joint_failures_of_other_filters(spark):
    """Any boolean columns and weights, null flags as false; seven filters at most."""
    rows = spark.createDataFrame([("x", True, None, 2), ("x", True, True, 3), ("x", False, True, 5)], "p string, `a b` boolean, c boolean, w int")
    joint = filter_audit.joint_failures(rows, "p", ["a b", "c"], {"n": F.lit(1), "w": F.col("w")}).first()
    assert joint.n == [3, 2, 2, 1] and joint.w == [10, 5, 8, 3]
    with pytest.raises(ValueError, match="orders"):
        filter_audit.joint_failures(rows, "p", ["c"] * 8, {"n": F.lit(1)})


# Line dedup


def plain_lines(docs: list[tuple]) -> list[tuple]:
    strip = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    rank = lambda d: -1 if d is None else d
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(k := lower(line.strip(strip))) >= 40:
                holders[k].add(rank(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(lower(x.strip(strip)), ())) < 5 or rank(d) == max(holders[lower(x.strip(strip))])]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def texts_for_lines() -> list[tuple]:
    r = random.Random(5)
    shared = [LINE + f" {i}" for i in range(30)] + ["short", "", "é" * 40, "É" * 39, "x" * 40, "y" * 39]
    docs = [(i, "\n".join(r.choice(["", " ", "\t"]) + r.choice([str.upper, str])(r.choice(shared) if r.random() < 0.6 else f"own {i} " * 8) + r.choice(["", "\r", " "]) for _ in range(r.randrange(1, 300)))) for i in range(60)]
    docs += [(i, LINE) for i in range(100, 104)] + [(None, LINE), (None, shared[0]), (None, shared[0]), (3, docs[3][1]), (3, shared[1]), (200, None), (201, ""), (202, "\n"), (203, "\n".join([shared[2]] * 500))]
    return docs


@pytest.mark.parametrize("partitions", [1, 6])
def test_lines_agree_with_a_plain_version(spark, partitions):
    docs = texts_for_lines()
    table = spark.createDataFrame([(*d, "mine", 7) for d in docs], "doc_id long, text string, kept string, t1 int").repartition(partitions)
    rows = line_dedup.drop_common_lines(table).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in rows), key=str) == plain_lines(docs)
    assert all(r.kept == "mine" and r.t1 == 7 for r in rows)  # clashing names keep their values
    for r in rows:
        words = r.kept_ or []
        assert sum(64 - (w.bits % 2**64).bit_count() for w in words) == r.n_dropped and [w.word for w in words] == sorted(w.word for w in words)


def test_lines_of_one_very_long_text_and_one_hot_line(spark):
    long_text = "\n".join([LINE] * 20_000 + ["z" * 50_000])
    docs = [(0, long_text)] + [(i, LINE) for i in range(1, 400)]
    rows = {r.doc_id: r for r in line_dedup.drop_common_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[0].n_dropped == 20_000 and rows[0].text == "z" * 50_000 and len(rows[0].kept) == 313
    assert rows[399].text == LINE and all(rows[i].text == "" and rows[i].n_dropped == 1 for i in range(1, 399))


def test_lines_of_an_empty_table_and_other_ids(spark):
    assert line_dedup.drop_common_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = line_dedup.drop_common_lines(spark.createDataFrame([(c, LINE) for c in "abcde"], "doc_id string, text string")).collect()
    assert {r.doc_id for r in rows if r.n_dropped == 0} == {"e"}


# Collocations


def plain_phrases(docs: list[tuple]) -> dict[str, list[tuple]]:
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out[lang] = [(i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows), 1)]
    return out


def texts_for_phrases() -> list[tuple]:
    r = random.Random(11)
    docs = [(r.choice(["en", "de", None, "und"]), " ".join(r.choice(["new york city", "of the", "Of The", "a", "b", "c", "ABC, d", "x.y", "é ß", "tab\tword", "l" * 70]) for _ in range(r.randrange(60)))) for _ in range(150)]
    return docs + [("en", None), ("en", ""), ("fr", "one two three"), ("", "p q " * 30)]


@pytest.mark.parametrize(("partitions", "shard"), [(1, 1 << 20), (3, 500), (4, 1)])
def test_phrases_agree_with_a_plain_version(spark, monkeypatch, partitions, shard):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    docs = texts_for_phrases()
    table = spark.createDataFrame([(*d, "own") for d in docs], "lang string, text string, word string").repartition(partitions)
    got = defaultdict(list)
    for row in collocations.collocations(table).orderBy("lang", "rank").collect():
        got[row.lang].append(tuple(row)[1:])
    want = plain_phrases(docs)
    assert dict(got) == {k: v for k, v in want.items() if v} and len(got) >= 4


def test_phrases_of_a_full_filter_and_of_none(spark, monkeypatch):
    """A filter with all bits set passes all triples, with the same result; so does a top that cuts."""
    docs = spark.createDataFrame(texts_for_phrases(), "lang string, text string")
    want = sorted(map(tuple, collocations.collocations(docs).collect()))
    monkeypatch.setattr(collocations, "bloom_filter", lambda frequent: np.full(4096, 255, np.uint8))
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == want
    assert sorted(map(tuple, collocations.collocations(docs, top=3).collect())) == [w for w in want if w[1] <= 3]
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_words_that_meet_are_hashed_anew(spark, monkeypatch):
    """With codes of four values words meet for the first seed; results are those of the next."""
    split = collocations.split_words

    def poor(texts, lang, seed):
        words = split(texts, lang, seed)
        if seed == 0:
            words.code = words.code % np.uint64(4)
        return words

    docs = spark.createDataFrame(texts_for_phrases(), "lang string, text string")
    want = sorted(map(tuple, collocations.collocations(docs).collect()))
    monkeypatch.setattr(collocations, "split_words", poor)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == want


def test_states_are_classes_of_end_positions():
    r = random.Random(2)
    for _ in range(50):
        code = np.array([r.randrange(r.choice([2, 5, 40])) for _ in range(r.randrange(0, 60))], np.uint64)
        piece = np.sort(np.array([r.randrange(6) for _ in code], np.int32))
        automaton = collocations.Automaton(code, piece, 3)
        ends = defaultdict(set)
        for i in range(len(code)):
            for k in (1, 2, 3):
                if i - k + 1 >= 0 and piece[i] == piece[i - k + 1]:
                    ends[tuple(code[i - k + 1 : i + 1].tolist())].add(i)
        classes = defaultdict(list)
        for s, e in ends.items():
            classes[frozenset(e)].append(s)
        got = {}
        for k in (1, 2, 3):
            states, shortest = automaton.states(k)
            for words, low, n in zip(zip(*[c.tolist() for c in automaton.sequence(k, states)], strict=True), shortest.tolist(), automaton.levels[k - 1].count[states].tolist(), strict=True):
                got[words] = (low, n)
        assert got == {max(c, key=len): (len(min(c, key=len)), len(e)) for e, c in classes.items()}


def test_hash_is_that_of_the_engine(spark):
    rows = spark.createDataFrame([(1, 2), (-5, 2**62), (0, -1)], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    columns = [np.array([r[c] for r in rows], np.int64).view(np.uint64) for c in "ab"]
    assert collocations.spark_hash(*columns).view(np.int64).tolist() == [r.h for r in rows]


def test_queries_have_the_columns_of_their_contracts(spark):
    from barloom.llm import queries

    sf = "/root/testdata/sf0.001"
    assert queries.op11_filter_audit(spark, sf).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    row = queries.op12_line_dedup(spark, sf).orderBy("doc_id").first()
    assert row.n_dropped or row.kept_sha256 == hashlib.sha256((spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {row.doc_id}").first().text or "").encode()).hexdigest()
    assert queries.op13_collocations(spark, sf).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_a_shard_takes_little_memory():
    """The check of round 3 stopped op13 at an executor's memory: an automaton's peak, against the bytes of its shard."""
    import tracemalloc

    import numpy as np

    from barloom.llm.collocations import Automaton, split_words

    text = " ".join(f"w{x}" for x in np.random.default_rng(1).zipf(1.3, 400_000) % 50_000).encode()
    tracemalloc.start()
    words = split_words([text], "en", 0)
    Automaton(words.code, words.piece, 3)
    peak = tracemalloc.get_traced_memory()[1] / len(words.code)
    tracemalloc.stop()
    assert peak < 140, peak
