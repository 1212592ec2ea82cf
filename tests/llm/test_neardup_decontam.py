"""Near duplicates and decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattix.llm import components, decontam, neardup


def words(r, n, vocabulary=3000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.randrange(3000)}"
    return w


def corpus():
    r = random.Random(4)
    docs = []
    for _ in range(8):
        base = words(r, r.choice([30, 120, 300]))
        for _ in range(r.choice([2, 5, 40])):
            docs.append(" ".join(edited(r, base, r.choice([0, 1, 2, 3, 6, 9]))))
        docs.append(" ".join(base))
    docs += [" ".join(words(r, 80)) for _ in range(40)]
    docs += ["", "", None, "!!", "!!", "a b", "A, b!", "x", "É É é a b c", "é é É a b c"]
    rows = [(i, t, "clash") for i, t in enumerate(docs)] + [(3, docs[3], "clash"), (None, docs[5], "clash")]
    r.shuffle(rows)
    return rows


def brute(rows):
    """Class of every row by comparing all pairs."""
    numbers, weights, many = neardup.shingles(*neardup.word_hashes(pa.array([t for _, t, _ in rows])))
    ends = np.cumsum(many)
    parts = [(numbers[e - m : e], weights[e - m : e]) for e, m in zip(ends, many, strict=True)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = rows[a][1] and rows[a][1] == rows[b][1]
            if same or (many[a] and many[b] and neardup.probability_jaccard(parts[a], parts[b]) >= neardup.SIMILARITY):
                parent[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(g, key=str) for g in groups.values())


def test_classes_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = neardup.classes(df).collect()
    assert len(got) == len(rows)
    groups = {}
    for k, r in enumerate(got):
        groups.setdefault((r["class_id"], r["class_text_hash"]) if (r["doc_id"], r["class_id"]) not in ((None, None),) else k, []).append(r["doc_id"])
    want = brute(rows)
    assert sorted(sorted(g, key=str) for g in groups.values()) == want
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(want)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(i for i in g if i is not None) for g in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(df).count() == 0 and neardup.keep_one(df).count() == 0


def jaccard(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y)) for i in set(x) & set(y))


def test_probability_jaccard_and_its_estimate():
    r = random.Random(2)
    errors = []
    for _ in range(60):
        base = [r.randrange(1 << 49) for _ in range(r.choice([3, 20, 300]))]
        x = {b: r.choice([1, 1, 2, 5]) for b in base if r.random() < 0.9}
        y = {b: r.choice([1, 1, x.get(b, 1), 3]) for b in base if r.random() < 0.9}
        if not x or not y:
            continue
        (a, wa), (b, wb) = ((np.array(sorted(z), np.uint64), np.array([float(z[k]) for k in sorted(z)])) for z in (x, y))
        exact = neardup.probability_jaccard((a, wa), (b, wb))
        assert exact == pytest.approx(jaccard(x, y))
        s = neardup.sketches(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([len(a), len(b)]))
        errors.append((s[0] == s[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert neardup.sketches(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0])).shape == (2, neardup.REGISTERS)


def test_sketch_does_not_depend_on_the_batch():
    r = random.Random(1)
    texts = [" ".join(words(r, n)) for n in (3, 10, 400, 6)] + [None, ""]
    whole = neardup.sketches(*neardup.shingles(*neardup.word_hashes(pa.array(texts))))
    for i, t in enumerate(texts):
        assert np.array_equal(neardup.sketches(*neardup.shingles(*neardup.word_hashes(pa.array([t]))))[0], whole[i])


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900)] + [(1000, 1001 + i) for i in range(50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def items():
    r = random.Random(6)
    syllables = ["th", "er", "in", "on", "an", "ré", "ti", "es", "or", "ñ"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    return r, text, [(i, text(r.randrange(15, 60))) for i in range(40)]


def test_distance_against_the_table():
    r = random.Random(1)
    for _ in range(300):
        a = "".join(r.choice("abc ") for _ in range(r.randrange(1, 30)))
        b = "".join(r.choice("abc ") for _ in range(r.randrange(0, 60)))
        assert decontam.best_match(a, b)[0] == decontam.best_match_reference(a, b)


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.03, 0.99), (0.06, 0.99), (0.08, 0.98), (0.1, 0.98)])
def test_recall(share, least):
    r, text, bench = items()
    index = decontam.ItemIndex([([i], decontam.normalise(t)) for i, t in bench], 0.1)
    docs, want = [], []
    for _ in range(400):
        i, t = bench[r.randrange(len(bench))]
        doc = f"{text(60)} {decontam.edited(t, int(len(t) * share), r)} {text(60)}"
        size = len(decontam.normalise(t))
        if decontam.best_match(decontam.normalise(t), decontam.normalise(doc))[0] <= int(size * 0.1):
            docs.append(doc)
            want.append(i)
    found = {(k, i) for k, i, *_ in index.search(docs)}
    assert np.mean([(k, i) in found for k, i in enumerate(want)]) >= least


def test_precision_and_exact_distance():
    r, text, bench = items()
    index = decontam.ItemIndex([([i], decontam.normalise(t)) for i, t in bench], 0.1)
    assert index.search([text(300) for _ in range(60)]) == []
    i, t = bench[0]
    far = " ".join(t.split()[: len(t.split()) // 2])
    assert index.search([f"{text(40)} {far} {text(40)}"]) == []
    shouted = f"{text(9)} {t.upper()}!! {text(9)}"
    k, item, distance, size, at = index.search([shouted])[0]
    assert (k, item, distance) == (0, i, 0) and decontam.normalise(shouted)[at - size : at] == decontam.normalise(t)


def test_decontamination(spark):
    r, text, bench = items()
    rows = [(1, text(50)), (2, f"{text(20)} {bench[3][1]} {text(5)} {bench[4][1]}"), (2, bench[3][1]), (3, None), (4, ""), (None, bench[5][1]), (5, "ok"), (6, " ".join([text(20_000), bench[6][1]]))]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in bench] + [(90, None, "x"), (91, "", "x"), (92, "!!", "x"), (93, "ok", "x"), (94, bench[3][1], "x"), (None, "other words", "x")], "item_id long, text string, doc_id string")
    got = sorted(((x["doc_id"], x["item_id"], x["distance"]) for x in decontam.find_items(docs, benchmark).collect()), key=str)
    assert got == sorted([(2, 3, 0), (2, 94, 0), (2, 4, 0), (2, 3, 0), (2, 94, 0), (None, 5, 0), (5, 93, 0), (6, 6, 0)], key=str)
    small = sorted(((x["doc_id"], x["item_id"], x["distance"]) for x in decontam.find_items(docs, benchmark, block_bytes=500).collect()), key=str)
    assert small == got
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [1, 3, 4]
    assert decontam.find_items(docs, benchmark.where(F.lit(False))).count() == 0
    assert decontam.drop_contaminated(docs, benchmark.where(F.lit(False))).count() == len(rows)
    assert decontam.find_items(docs.limit(0), benchmark).count() == 0


def assert_as_brute(spark, texts):
    rows = [(i, t, "c") for i, t in enumerate(texts)]
    groups = {}
    for x in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string, class_id string")).collect():
        groups.setdefault(x["class_id"], []).append(x["doc_id"])
    assert sorted(sorted(g, key=str) for g in groups.values()) == brute(rows)


def test_texts_whose_weight_lies_in_one_shingle(spark):
    """Pairs that share a repeated line only, among many texts with less of it."""
    r = random.Random(9)
    unique = lambda: " ".join(f"u{r.randrange(1 << 40)}" for _ in range(200))
    texts = [" ".join([line] * times) + " " + unique() for line in ("ab", "cd", "ef", "gh") for times in [900] * 60 + [2100, 2100]]
    r.shuffle(texts)
    assert_as_brute(spark, texts)


def test_pairs_in_a_large_family(spark):
    """Texts just under the limit to each other, with some pairs over it."""
    r = random.Random(10)
    fresh = lambda n: [f"u{r.randrange(1 << 40)}" for _ in range(n)]
    template = fresh(356)
    texts = []
    for _ in range(80):
        both = fresh(9)
        texts += [" ".join(template + both + fresh(39)) for _ in range(2)]
    texts += [" ".join(template + fresh(48)) for _ in range(240)]
    r.shuffle(texts)
    assert_as_brute(spark, texts)


@pytest.mark.parametrize("size", [1_000, 2_000, 5_000])
def test_long_items_at_the_full_edit_rate(size):
    r, text, _ = items()
    bench = [(i, text(size // 4)) for i in range(4)]
    index = decontam.ItemIndex([([i], decontam.normalise(t)) for i, t in bench], 0.1)
    docs, want = [], set()
    for k in range(20):
        i, t = bench[k % 4]
        docs.append(f"{text(60)} {decontam.edited(t, int(len(t) * 0.1), r)} {text(60)}")
        plain = decontam.normalise(t)
        if decontam.best_match(plain, decontam.normalise(docs[-1]))[0] <= int(len(plain) * 0.1):
            want.add((k, i))
    assert len(want) >= 15 and {(k, i) for k, i, *_ in index.search(docs)} == want


def test_all_windows_by_brute_force():
    """Every (text, item) within the rate by the distance over the whole text, texts with copies of parts at all rates."""
    r, text, bench = items()
    bench += [(50, text(6)), (51, text(3)), (52, "木" * 30 + "水火土金" * 30), (53, "".join(r.choice("bcdfg") for _ in range(300)))]
    plain = [([i], decontam.normalise(t)) for i, t in bench]
    index = decontam.ItemIndex(plain, 0.1)
    docs = [text(100) for _ in range(20)] + [None, ""]
    for _ in range(150):
        _, t = bench[r.randrange(len(bench))]
        docs.append(f"{text(r.randrange(30))} {decontam.edited(t, int(len(t) * r.uniform(0, 0.15)), r)} {text(r.randrange(30))}")
    docs = [d or "" for d in docs]
    want = {}
    for k, d in enumerate(docs):
        whole = decontam.normalise(d)
        for ids, t in plain:
            distance, at = decontam.best_match(t, whole)
            if distance <= decontam.edits_allowed(len(t), 0.1):
                want[k, ids[0]] = (distance, at)
    got = {(k, i): (distance, at) for k, i, distance, _, at in index.search(docs)}
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got)
    assert len(want) > 80 and len(got) / len(want) >= 0.98


def test_walks_meet_again_after_an_edit():
    """Outputs of two walks differ in few places: the Hamming distance follows the edits."""
    r, text, _ = items()
    met = []
    for _ in range(200):
        t = decontam.normalise(text(40))[:160]
        e = decontam.edited(t, 2, r)
        keys = []
        for x in (t, e):
            data = np.frombuffer(x.encode("latin-1") + decontam.PAD, np.uint8)
            at = decontam.anchors(data)
            keys.append({k for n in range(decontam.TABLES) for k in decontam.walks(data, at, n)[0].tolist()})
        met.append(len(keys[0] & keys[1]) / len(keys[0]))
    assert np.mean(met) > 0.7
    assert [decontam.needed(n) for n in (1, 10, 20)] == [1, 1, 2] and decontam.needed(200) > 50


def test_items_with_null_ids(spark):
    docs = spark.createDataFrame([(1, "so some other words here"), (2, "nothing"), (3, "the ok one")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, "other words"), (None, "ok one"), (7, "OK one")], "item_id long, text string")
    found = [tuple(x) for x in decontam.find_items(docs, benchmark).select("doc_id", "item_id").collect()]
    assert sorted(found, key=str) == [(1, None), (3, 7), (3, None)]
    assert [x["doc_id"] for x in decontam.drop_contaminated(docs, benchmark).collect()] == [2]


def test_buckets_in_many_parts(spark, monkeypatch):
    """Leaders and buckets dealt to parts of a few nodes."""
    monkeypatch.setattr(neardup, "PART", 7)
    monkeypatch.setattr(neardup, "LEADER_PART", 5)
    r = random.Random(12)
    base = words(r, 120)
    texts = [" ".join(edited(r, base, r.choice([3, 5, 8]))) for _ in range(90)] + ["one line again " * 70 + " ".join(words(r, 60)) for _ in range(30)]
    assert_as_brute(spark, texts)


def test_very_long_texts(spark):
    r = random.Random(13)
    long = words(r, 150_000, 1 << 40)
    texts = [" ".join(long), " ".join(edited(r, long, 2_000)), " ".join(long[:100_000]), "ab " * 200_000, "ab " * 200_001, "short"]
    groups = {}
    for x in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        groups.setdefault(x["class_id"], []).append(x["doc_id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2], [3, 4], [5]]
