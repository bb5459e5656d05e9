"""The pipeline's stages against plain Python, on a small table with copies, junk, secrets and nulls."""

import math
import random
import re

import corpus_pipeline as pipeline
from barloom.llm import mixing, near_copies, quality, secret_scan, simhash


def rows() -> list[tuple]:
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "pa", "ni") for b in ("ren", "dol", "sit", "vel", "qua", "tor", "mex")]
    out = []
    for i in range(60):
        text = " ".join(random.Random(i).choices(words, k=60 + i))
        out.append((i, text, "en" if i % 3 else "de", f"s{i % 4}", len(text)))
    out += [(100 + k, out[5][1], "en", "s1", 1) for k in range(3)]  # exact copies
    out += [(200, "### " * 40 + out[3][1], "en", "s0", 1), (201, "go " * 50, "en", "s1", 1), (202, None, "en", "s1", 0), (203, "", None, None, 0)]
    out += [(300, out[8][1] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and so on', "en", "s2", 1)]
    return out


def first_of_near_copies(texts: dict[int, str]) -> set[int]:
    """The smallest id of each component of texts whose sets of 5-word shingles are alike by 0.8 or more, pair by pair."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    return set(root.values())


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {200, 201, 202, 203}.isdisjoint(ids) and {*range(60), 100, 101, 102, 300} <= ids

    once = pipeline.near_duplicates(spark, kept, "")
    left = {r.doc_id for r in once.collect()}
    assert left == first_of_near_copies({r.doc_id: r.text for r in kept.collect()}) and {100, 101, 102, 300}.isdisjoint(left) and once.columns == docs.columns

    clean = {r.doc_id: r for r in pipeline.secret_scans(spark, once, "").collect()}
    assert set(clean) == left
    secret = pipeline.secret_scans(spark, kept.where("doc_id = 300"), "").first()
    assert secret_scan.MARK in secret.text and "04dbebab" not in secret.text and secret.n_chars == len(secret.text)

    mixed = pipeline.mixing_sources(spark, once, "").collect()
    plan = {r.doc_id: r for r in mixing.mix(once.withColumn("size", mixing.word_count(once.text))).collect()}
    for i, p in plan.items():
        assert sum(r.doc_id == i for r in mixed) == p.epochs + (p.size > 0 and 2 * p.cut_words >= p.size)


def test_whole_run(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.ids[-1] == 2 and r.decoded for r in got)


def test_mix_reaches_targets(spark):
    """Against water filling by repeated resharing, with a null source, ties, an empty text and a repeated row."""
    rows = [(i, ["a", "b", "c", "d", None][i % 5], 1 + (i * 37) % 90 * (1 + 20 * (i % 5 == 0))) for i in range(400)] + [(7, "c", 5), (7, "c", 5), (None, "a", 3), (8, "d", 0)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(s for s in sizes if s) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        full |= {s: 2 * sizes[s] for s in over}
    want = full | {s: level * weight[s] for s in rest}
    assert len(got) == len(rows)
    for s in names:
        mine = [r for r in got if r.source == s]
        taken = sum(r.epochs * r.size + r.cut_words for r in mine)
        assert abs(mine[0].target - want[s]) < 1e-6 and abs(taken - want[s]) <= 0.5
        assert all(r.epochs * r.size + r.cut_words <= 2 * r.size for r in mine)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long")).count() == 0


def test_quality_measures(spark):
    """Against plain Python, with nulls, ties, clashing names and texts without words."""
    texts = ["", None, "  \n ", "a b c d e f g h " * 5, "one\none\n two \none", "x y z", "ab " * 30, " ".join(f"w{i}" for i in range(9000)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9", "é|# $%"]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words long")
    for r in quality.quality_rules(docs).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        many = {x for x in windows if windows.count(x) > 1} if len(windows) < 500 else {tuple(f"w{i + k}" for k in range(8)) for i in (1, 2)}
        covered = {i + k for i, x in enumerate(windows) if x in many for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.base_failed and r.kept)


def plain_limits(groups: dict[tuple, list[float]]) -> dict[tuple, float]:
    """Limits of one measure from the values of each (lang, source), by sorting instead of sketches."""

    def two(values: list[float]) -> list[float]:
        values = sorted(values)
        return [quality.GAMMA ** math.ceil(math.log(values[math.ceil(q * len(values)) - 1]) / math.log(quality.GAMMA)) for q in (0.5, 0.85)]

    whole, out = two([v for g in groups.values() for v in g]), {}
    for (lang, source), values in groups.items():
        both = [v for g, own in groups.items() if g[0] == lang for v in own]
        of_lang = [(len(both) * a + 50 * b) / (len(both) + 50) for a, b in zip(two(both), whole)]
        middle, upper = ((len(values) * a + 50 * b) / (len(values) + 50) for a, b in zip(two(values), of_lang))
        out[lang, source] = middle + 6 * max(upper - middle, 0.05 * middle)
    return out


def test_adaptive_thresholds(spark):
    """Sources with other habits get other limits, as sorting has them, and no single cutoff keeps the same documents."""
    rng, rows = random.Random(9), []
    for k, (lang, source, share) in enumerate((("en", "prose", 0.01), ("en", "code", 0.5), ("de", None, 0.05), (None, "code", 0.2))):
        for i in range((150, 90, 40, 3)[k]):
            words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) + ("$" if rng.random() < share else "") for _ in range(rng.randint(30, 200))]
            rows.append((1000 * k + i, " ".join(words), lang, source))
    rows += [(9001, " ".join(f"w{i}$$$" for i in range(60)), "en", "prose"), (9002, " ".join(f"x{i}$" for i in range(60)), "en", "code"), (9003, None, "fr", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stored = quality.stored(quality.measure(docs))
    measured = stored.where(~quality.base_failed()).collect()
    limits = {(r.lang, r.source): r.limits for r in quality.thresholds(quality.sketches(stored)).collect()}
    for m in quality.MEASURES:
        groups = {}
        for r in measured:
            groups.setdefault((r.lang, r.source), []).append(r.adaptive[m])
        for g, want in plain_limits(groups).items():
            assert math.isclose(limits[g][m], want, rel_tol=1e-9)
    assert len({round(x["symbols"]) for x in limits.values()}) == 4 and limits["en", "code"]["symbols"] > 2 * limits["en", "prose"]["symbols"]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs).collect()}
    assert kept.pop(9002) and not kept.pop(9001) and not kept.pop(9003) and sum(kept.values()) >= len(kept) - 2


def test_quality_of_odd_tables(spark):
    """Clashing names, repeated rows and an empty table."""
    names = ("limits", "_t_limits", "_row", "kept", "adaptive", "_h1", "_capitals", "m")
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40)), "en", "a")] * 3, "doc_id long, text string, lang string, source string")
    for c in names:
        docs = docs.withColumn(c, quality.F.lit(1))
    got = quality.quality_rules(docs).collect()
    assert len(got) == 3 and all(r.kept and r.limits == r.m == 1 for r in got)
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_stages_of_odd_tables(spark, monkeypatch):
    """Columns named as the operators name theirs, repeated rows, rows that share a doc_id, and empty tables."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (1, text, "en", "a", 6), (None, text, None, None, None), (2, "other " + text[:40], "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_id", "_hash", "_key", "_size", "_share", "_pass", "_times", "fp", "node", "more", "limits", "n", "copies", "size", "root"):
        docs = docs.withColumn(c, quality.F.lit("x"))
    for drop in (simhash.drop_near_duplicates, near_copies.drop_near_copies):
        runs = [sorted(map(tuple, drop(docs.repartition(n)).collect()), key=str) for n in (1, 3)]
        assert runs[0] == runs[1] and len(runs[0]) == 2 and drop(docs.limit(0)).count() == 0
    for stage in (pipeline.quality_rules, pipeline.secret_scans, pipeline.mixing_sources, pipeline.sentencepiece_encoding):
        got = stage(spark, docs, "")
        assert stage(spark, docs.limit(0), "").count() == 0
        assert stage is pipeline.sentencepiece_encoding or (got.columns == docs.columns and all(r["_size"] == "x" for r in got.collect()))


def test_many_alike_rows_share_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MANY_ALIKE", 3)
    rows = [(7, "a b c", "s", k % 2) for k in range(40)] + [(i, "a " * (i % 5 + 1), "st"[i % 2], i) for i in range(60)] + [(None, "x y", "t", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    plan = mixing.mix(docs.withColumn("size", mixing.word_count(docs.text))).collect()
    got = mixing.mixed_rows(docs).collect()
    for key in {(r.doc_id, r.size) for r in plan}:
        want = sum(r.epochs + (r.size > 0 and 2 * r.cut_words >= r.size) for r in plan if (r.doc_id, r.size) == key)
        assert sum((r.doc_id, len(r.text.split())) == key for r in got) == want


def test_every_name_of_the_operators_may_be_a_column(spark, tmp_path):
    """Documents with a string column for each name that the subpackage makes keep all values through the four stages."""
    import pathlib
    import re as regex

    import barloom.llm

    made = set()
    for file in pathlib.Path(barloom.llm.__file__).parent.glob("*.py"):
        made |= set(regex.findall(r"[\"'](_?[A-Za-z][A-Za-z0-9_]{0,30})[\"']", file.read_text()))
    names = sorted({n.lower() for n in made} - {"doc_id", "text", "lang", "source", "n_chars"})
    assert len(names) > 150 and {"n_words", "kept", "_words", "base", "tokens", "k"} <= set(names)
    texts = [f"Some words of document {i} that are like no others, {' '.join(f'w{(i * 37 + j * j) % 97}' for j in range(80))}." for i in range(12)]
    texts[3] += " password = hunter2hunter2"
    rows = [(i, t, "en", f"s{i % 2}", len(t), *[f"{n} {i}" for n in names]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found = docs.collect()
        assert found and all(r[n] == f"{n} {r.doc_id}" for r in found for n in names), name
