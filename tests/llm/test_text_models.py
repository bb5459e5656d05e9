"""Language identification, encoding and Order MinHash against held-out accuracy, the library and plain versions."""

import random
import zlib

import numpy as np
import pytest

from barloom.llm import langid, order_minhash, pieces


def documents(n: int) -> list[tuple]:
    rng = random.Random(4)
    words = {"aa": ("lorem", "ipsum", "dolor", "sitam"), "bb": ("kven", "straht", "wisk", "ulm"), "cc": ("ño", "ñata", "ciño", "peña")}
    return [(i, " ".join(rng.choices(words[k := rng.choice(sorted(words))], k=rng.randint(1, 30))), k) for i in range(n)]


def test_language_of_held_out_documents(spark):
    rows = documents(300) + [(1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", None), (None, "lorem ipsum", "aa")]
    got = {r.doc_id: r for r in langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[:300] if got[i].held_out]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and not got[None].held_out
    nothing = langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang", langid.F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_labels_of_held_out_documents_teach_nothing(spark):
    rows = documents(120)
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else k) for i, t, k in rows]
    run = lambda r: sorted(map(tuple, langid.identify_documents(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect()))
    assert run(rows) == run(other)


def test_training_against_a_plain_version(spark, monkeypatch):
    """Weights of the same steps in dictionaries; some stay zero; the temperature lowers the loss; a bound on all samples."""
    rng = random.Random(2)
    data = [(rng.randrange(2), np.array(sorted(rng.sample(range(40), 5))), np.array([rng.random() for _ in range(5)])) for _ in range(60)]
    got = langid.Model(["a", "b"], np.ones(langid.SIZE), np.zeros((2, langid.SIZE)), np.zeros(2), 1.0)
    langid._train(got, data)
    z, n = {}, {}

    def weight(k: int, i: int) -> float:
        a = z.get((k, i), 0.0)
        return 0.0 if abs(a) <= langid.L1 else (np.sign(a) * langid.L1 - a) / ((langid.BETA + np.sqrt(n.get((k, i), 0.0))) / langid.ALPHA + (langid.L2 if i != langid.SIZE else 0.0))

    for epoch in range(langid.EPOCHS):
        for j in np.random.default_rng(epoch).permutation(len(data)):
            y, index, x = data[j]
            pairs = [*zip(index.tolist(), x.tolist()), (langid.SIZE, 1.0)]
            w = {(k, i): weight(k, i) for k in (0, 1) for i, _ in pairs}
            score = [sum(w[k, i] * v for i, v in pairs) for k in (0, 1)]
            p = np.exp(np.array(score) - max(score))
            p /= p.sum()
            for k in (0, 1):
                for i, v in pairs:
                    g = (p[k] - (k == y)) * v
                    old = n.get((k, i), 0.0)
                    z[k, i] = z.get((k, i), 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / langid.ALPHA * w[k, i]
                    n[k, i] = old + g * g
    assert all(abs(got.weights[k, i] - weight(k, i)) < 1e-9 for k in (0, 1) for i in range(40)) and abs(got.bias[0] - weight(0, langid.SIZE)) < 1e-9
    assert (got.weights[:, 40:] == 0).all() and (got.weights != 0).sum() <= 80
    logits = [(y, got.logits(i, np.ones(5))) for y, i, _ in data]
    loss = lambda t: np.mean([np.log(np.exp(z / t).sum()) - z[y] / t for y, z in logits])
    langid._calibrate(got, logits)
    assert loss(got.temperature) <= loss(1.0) + 1e-9
    monkeypatch.setattr(langid, "MOST_SAMPLES", 30)
    docs = spark.createDataFrame(documents(300), "doc_id long, text string, lang string")
    assert len({r.key for r in langid.samples(docs)}) < 80
    odd = docs.limit(1).union(docs.limit(1)).withColumns({"lang_pred": langid.F.lit(1), "more": langid.F.lit(2)})
    found = langid.identify(odd, got).collect()
    assert len(found) == 2 and found[0] == found[1] and found[0].more == 2 and langid.identify_documents(docs.limit(0)).count() == 0


def model() -> str:
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_encoding_is_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model())
    rng = random.Random(3)
    texts = ["", None, " ", "a", "  a  b ", "\n\na\nb", "▁a", "<s> </s>", "\x00", "ﬁ Ａ é", "日本語\U0001f600", "=" * 300, "tttthhheee" * 40, "naïve  word\tword", "naïve  word\tword"]
    texts += ["x \n b", "a▁b\n▁", "b\nb ", "▁▁", *("".join(rng.choices("ab▁ \n\té=日xyz", k=rng.randint(1, 60))) for _ in range(500))]
    docs = spark.createDataFrame([(i, t, [0]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in pieces.encode_decode(docs, model()).collect()}
    for i, t in enumerate(texts):
        ids = [*library.encode(t or ""), 2]
        assert got[i].ids == ids and got[i].decoded == library.decode(ids) and got[i].text == t
    empty = pieces.encode_decode(docs.limit(0), model())
    assert empty.columns == ["doc_id", "text", "ids", "decoded"] and empty.count() == 0


def test_long_units_and_little_memory(monkeypatch):
    """A text of ten million characters without spaces, and units that are forgotten between batches."""
    with open(model(), "rb") as f:
        vocabulary = pieces.Vocabulary(f.read())
    rng = random.Random(5)
    block = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789", k=100_000))
    ids, begin, decoded = vocabulary.encode([block * 100, "a b"])
    assert decoded == [block * 100, "a b"] and ids[begin[1] - 1] == 2 and begin[2] == len(ids)
    own = [*vocabulary.library.encode(block), 2]
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 1000)
    for _ in range(3):
        ids, begin, decoded = vocabulary.encode([block, "c d " * 50])
        assert ids[: begin[1]].tolist() == own and decoded == [block, "c d " * 50] and len(vocabulary.known) < 10


def plain_signature(text: str) -> np.ndarray:
    """Occurrence numbers by counting, minima by sorting."""
    codes = order_minhash.code_points(text)
    h, seen = order_minhash.numbered_kmers(codes), {}
    if len(codes) >= order_minhash.K:
        grams = [tuple(codes[i : i + order_minhash.K]) for i in range(len(codes) - order_minhash.K + 1)]
        first = {}
        for i, g in enumerate(grams):
            seen[g] = seen.get(g, -1) + 1
            first.setdefault(g, h[i])
            assert (h[i] == first[g]) == (seen[g] == 0)  # each occurrence has a hash of its own
        assert len(set(h.tolist())) == len(h)
    short = (h >> np.uint64(32)).astype(np.uint32)
    out = []
    for j in range(order_minhash.HASHES):
        value = short * order_minhash.SHORT[j]
        x = order_minhash.MULTIPLIERS[j, 1:]
        for i in sorted(np.argsort(value, kind="stable")[: order_minhash.TUPLE]):
            x = order_minhash._mixed(x * order_minhash.GOLDEN + h[i])
        out.append((int(x[0]) & 0xFFFF) | 1)
    return np.array(out, np.uint16)


def test_signatures():
    rng = random.Random(6)
    texts = ["a", "abcdefg", "abcdefgh", "ab" * 200, "".join(rng.choice("abc ") for _ in range(3000))]
    for t in texts:
        assert (order_minhash.signature(order_minhash.code_points(t)) == plain_signature(t)).all()
    assert not order_minhash.signature(order_minhash.code_points("")).any()
    # The same halves in the other order are less alike than a small edit.
    t = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    sign = lambda x: order_minhash.signature(order_minhash.code_points(x))
    assert order_minhash.likeness(sign(t), sign(t[:1000] + "x" + t[1001:])) > order_minhash.likeness(sign(t), sign(t[1000:] + t[:1000]))


def test_next_documents(spark, monkeypatch):
    """Small ranges: each document meets the next by id, ties and nulls included, the last meets the first."""
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 3)
    rows = [(i * i, f"text number {i} " * (i % 4)) for i in range(25)] + [(None, "no id" * i) for i in range(12)] + [ (16, "a second sixteen"), (16, "a second sixteen"), (7, None)]
    got = order_minhash.fingerprint_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tie = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(((i is not None, i or 0, tie[t or ""], t or "") for i, t in rows))
    edits = []
    for k, (_, i, _, t) in enumerate(order):
        n = len(t) // 2
        edits.append(t[: len(t) - n] + order[(k + 1) % len(order)][3][:n])
    import hashlib

    assert sorted(r.edited_sha256 for r in got) == sorted(hashlib.sha256(e.encode()).hexdigest() for e in edits)
    assert sum(r.next_signature is not None for r in got) == len(rows)
    assert order_minhash.fingerprint_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
