"""SimHash and components against brute force."""

import numpy as np
import pytest

from barloom.llm import simhash
from barloom.llm.components import components


def plain_fingerprint(text: str) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps: list[int]) -> list[int]:
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(rng: np.random.Generator, centres: int, n: int, most: int) -> list[int]:
    base = [int(x) for x in rng.integers(0, 2**63, centres)]
    return [base[rng.integers(centres)] ^ sum(1 << int(b) for b in {*rng.integers(0, 64, rng.integers(0, most + 1))}) for _ in range(n)]


def test_fingerprints():
    texts = ["", "A b", "one Two three four", "x\ny\tz  ÄÖ w", "word " * 700, " ".join(f"w{i}" for i in range(3000))]
    assert [int(x) for x in simhash.fingerprints(texts)] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("large", [4, 4096])
def test_links_of_many_near_fingerprints(spark, monkeypatch, large):
    """Small groups and groups that are divided again give the components of all pairs."""
    monkeypatch.setattr(simhash, "LARGE", large)
    fps = near(np.random.default_rng(1), 12, 900, 5)
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    from barloom.llm.shared import stored

    frame = stored(spark.createDataFrame(rows, "doc_id long, fp long"))
    got = {r.fp: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert [got[f] for _, f in rows] == plain_components(fps)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_nulls_ties_and_clashing_names(spark):
    rows = [(1, "a b c d e", 7), (1, "a b c d e", 7), (2, None, 7), (None, "", 7), (3, "A B C D E", 7), (4, "quite other words here now", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted((r.doc_id, r.component_id) for r in simhash.link_documents(docs).collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 1), (2, 2), (3, 1), (4, 4)]
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs.drop("fp")).collect()) == [1, 2, 4]
    assert simhash.link_documents(docs.limit(0)).count() == 0
