"""Near copies in the pipeline against exact similarities of all pairs."""

import random

import corpus_pipeline as pipeline


def words(text: str | None) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def changed(text: str, places: list[int]) -> str:
    w = text.split()
    for p in places:
        w[p] = f"new{p}"
    return " ".join(w)


def test_planted_near_copies(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) for n in [100] * 20 + [300] * 10 + [1000] * 3]
    texts = [*base]
    for t in base:
        n = len(t.split())
        texts += [changed(t, [n // 2]), changed(t, list(range(7, n, n // max(1, n // 60)))[: n // 60 + 1]), changed(t, list(range(5, n, 12)))]
    texts += [changed(base[0], [20 + k % 60]) for k in range(150)]  # one large group
    texts += [base[1].upper(), None, "", " \n", "a b", "A  b", "a c"]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(None, base[2], "x"), (0, base[0], "s0")]
    sets, root = [words(t) for _, t, _ in rows], list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    want = {top(i) for i in range(len(rows))}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and len(want) < 100
    assert all(rows[r.doc_id] == tuple(r) for r in got)
