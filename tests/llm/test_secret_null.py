"""Secret scans: decoys against the battery itself, a token among many other candidates at two sizes, keys of one kind of character."""

import random
import string
import tracemalloc
from collections import Counter

import pytest

from barloom.llm import secret_scan as scans

WORDS = "the of and that which report shows were house people market water between through system during another because country without company thought number general public weather morning children evening history question government".split()
PARTS = "main java example service handler config module internal common utils controller resources template".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() > 0.03 else str(rng.randrange(1900, 2030)) for _ in range(n)).capitalize()


def found(spark, rows: list[tuple]) -> dict[int, list[str]]:
    """Random tokens of each text."""
    text = dict(rows)
    got = scans.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.spans if scans.KINDS[s.kind] == "random"] for r in got}


def test_decoys_cover_all_text():
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (3, 5, 9, 40, 200, 700)] + ["", "Caffè/latte-9 " * 9, "a" * 19, "ab" * 200 + " x"]
    want = Counter()
    for t in (scans.CANDIDATE.sub(" ", t) for t in texts):
        for code in scans.READ_AS:
            chars = scans.SETS[code]
            own = "".join(c for c in (t.lower() if "A" not in chars else t.upper() if "a" not in chars else t) if c in chars)
            for k, n in enumerate((scans.LEAST, *scans.LENGTHS)):
                pieces = [own[i : i + n] for i in range(0, len(own) - n + 1, n)]
                pieces += [own[-n:]] * (k == 0 and len(own) > n and len(own) % n > 0)
                for x in pieces:
                    want[code, k, scans._step(scans.battery(x, code))] += 1
    got = Counter()
    for code, k, step, n in scans.decoys(texts):
        got[code, k, step] += n
    assert {scans.NAMES[c] for c, _, _ in got} == {scans.NAMES[c] for c in scans.READ_AS} and got == want


def test_decoys_at_the_ends_of_the_scale(monkeypatch):
    """One character alone, two in turn, halves and random ones of each alphabet, over several blocks: as the battery says."""
    rng = random.Random(8)
    texts = [" ".join(t) for t in ("a" * 300, "9" * 256, "aZ" * 150, "a" * 128 + "z" * 128, "AbC+/-_" * 40, "0" * 19, "7" * 20)]
    texts += [" ".join(rng.choices(alphabet, k=n)) for _, alphabet in scans.ENCODINGS for n in (20, 47, 96, 515)]
    want = Counter()
    for t in texts:
        for code in scans.READ_AS:
            chars = scans.SETS[code]
            own = "".join(c for c in (t.lower() if "A" not in chars else t.upper() if "a" not in chars else t) if c in chars)
            for k, n in enumerate((scans.LEAST, *scans.LENGTHS)):
                pieces = [own[i : i + n] for i in range(0, len(own) - n + 1, n)]
                pieces += [own[-n:]] * (k == 0 and len(own) > n and len(own) % n > 0)
                want.update((code, k, scans._step(scans.battery(x, code))) for x in pieces)
    assert {step for *_, step in want} >= {0, scans.MOST_STEPS}
    for block in (1, 3000, scans.AT_ONCE):
        monkeypatch.setattr(scans, "AT_ONCE", block)
        for long in (None, [False] * len(texts)):
            assert {(code, k, step): n for code, k, step, n in scans.decoys(texts, long)} == want


def test_decoys_cost(monkeypatch):
    """Deviations are worked out once for each length and alphabet, not for each piece; memory is a block's, however long a batch is."""
    rng = random.Random(4)
    texts = [prose(rng, 800) for _ in range(200)]
    tracemalloc.start()
    want = sorted(scans.decoys(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for name in ("cbrt", "sqrt", "searchsorted"):
        monkeypatch.setattr(scans.np, name, lambda *_: pytest.fail("worked out anew"))
    assert sorted(scans.decoys(texts)) == want and peak < 25 * sum(map(len, texts))


@pytest.mark.parametrize("size", [60, 240])
def test_one_token_among_many_candidates(spark, size):
    """Found at either size, and no path with it."""
    rng = random.Random(size)
    path = lambda: "/".join(rng.choice(PARTS) for _ in range(5))
    rows = [(i, f"{prose(rng, 150)} {path()} {prose(rng, 150)} {path()}") for i in range(size)]
    key = "".join(random.Random(11).choices(string.ascii_letters + string.digits, k=40))
    rows[7] = (7, f"{rows[7][1]} {key} {prose(rng, 30)}")
    got = found(spark, rows)
    assert got.pop(7) == [key] and not any(got.values())


def test_letters_and_digits_alone(spark):
    rng = random.Random(21)
    rows = [(i, prose(rng, 300)) for i in range(150)]
    rows += [(500 + i, " ".join(str(rng.randrange(1900, 2030)) for _ in range(200))) for i in range(60)]
    keys = ["".join(rng.choices(a, k=n)) for a, n in ((string.ascii_lowercase, 100), (string.ascii_uppercase, 100), (string.digits, 120), (string.ascii_letters, 60))]
    rows += [(1000 + i, f"{prose(rng, 30)} {k} {prose(rng, 30)}") for i, k in enumerate(keys)]
    rows += [(2000, prose(rng, 9) + " thegovernmentquestionhistoryofthepublicmarketandpeople"), (2001, prose(rng, 9) + " 19991999200020002001200120022002200320032004")]
    got = found(spark, rows)
    # 24 digits or more are the fixed pattern's; what the tests say of them stands in the limits.
    assert [got[1000 + i] for i in (0, 1, 3)] == [[keys[i]] for i in (0, 1, 3)]
    found_at = scans.limits(scans.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    (_, _, code, size, step), (*_, other, least, high) = scans.candidates(keys[2])[0], scans.candidates(rows[-1][1])[0]
    assert code == other == 0 and step <= found_at[code, size] and high > found_at.get((other, least), -1)
    assert not any(v for i, v in got.items() if not 1000 <= i < 2000)
