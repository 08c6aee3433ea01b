"""Fill-in-middle, vector codes and LSH forest against brute force, and on odd rows."""

import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sparkgauge.llm import fill_middle, lsh_forest, vector_codes

LONG = "word " * 30_000
ODD = [None, "", " \t\n", "a", "Ä ö é", "x y z", "x y z", "one\ntwo\none", LONG, "\x00 b", "😀 smile <P> here", "plain <M", "<S", " \r\n end"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "s", 1, "k") for i, t in enumerate(ODD)] + [(3, "b c", None, None, "k"), (None, "x y z", None, 2, None), (5, "x y z", "s", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n long, OUTPUT string")


def test_fill_middle_of_odd_rows(odd):
    made = fill_middle.transform(odd).withColumn("back", fill_middle.restored("output", "form"))
    texts = sorted((r["text"] or "" for r in odd.collect()))
    got = made.collect()
    assert sorted(r["back"] for r in got) == texts
    for r in got:
        t = r["back"]
        h = [int(x, 16) for x in regex.findall(".{8}", hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest())[:4]]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"]) == (len(t), form, want)
        assert (r["prefix_chars"], r["middle_chars"]) == ((None, None) if form == "plain" else (a, b - a))
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


def test_fill_middle_units(spark):
    texts = [(i, t) for i, t in enumerate(["one two  three four", "éä x", "no end \n"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = {r[0]: r for r in fill_middle.transform(docs, unit=r"\s*\S+", plain_percent=0).collect()}
    assert [words[i]["n"] for i in range(3)] == [4, 2, None] and words[2]["output"] == "no end \n"
    assert {r[0]: r["n"] for r in fill_middle.transform(docs, unit=r"\X").collect()} == {0: 19, 1: 4, 2: 8}
    again = fill_middle.transform(docs, unit=r"\s*\S+", plain_percent=0).select(fill_middle.restored("output", "form")).collect()
    assert sorted(r[0] for r in again) == sorted(t for _, t in texts)
    assert fill_middle.transform(docs.limit(0)).collect() == []


def test_hilbert_curve_steps_to_neighbours():
    for width, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * width), -1).reshape(-1, width)
        keys = vector_codes.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Codes by the definition, in Python integers."""
    kept = sorted((r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    from fractions import Fraction

    ints = [[int(Fraction(x) * 4096 // 1) for x in r[1]] for r in kept]
    w = len(ints[0])
    cut = [w * p // parts for p in range(parts + 1)]
    books = [[v[a:b] for v in ints[:entries]] for a, b in zip(cut, cut[1:])]

    def nearest(p, v):
        far = [sum((x - c) ** 2 for x, c in zip(v[cut[p] : cut[p + 1]], e)) for e in books[p]]
        return min(range(len(far)), key=lambda e: (far[e], e)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(p, v)[0] for v in ints]
            for e in range(len(books[p])):
                members = [v[cut[p] : cut[p + 1]] for v, o in zip(ints, own) if o == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for r, v in zip(kept, ints):
        best = [nearest(p, v) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for e, _ in best), min(sum(d for _, d in best), (1 << 63) - 1)))
    return out, books


@pytest.mark.parametrize("scale", [1.0, 0.004, 1e30])
def test_vector_codes_equal_brute_force(spark, scale):
    rnd = random.Random(7)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(5)]
    rows = [(i, [scale * (c + rnd.gauss(0, 0.1)) for c in rnd.choice(centres)], rnd.choice(["a", "b", None])) for i in range(300)]
    rows += [(400, None, "a"), (401, [None] * 16, "a"), (402, [float("nan")] + [0.0] * 15, "a"), (403, [float("inf")] * 16, None), (404, [], "b")]
    rows += [rows[4], (None, [scale] * 16, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label string, CODE string")
    done = vector_codes.compress(df.repartition(3))
    want, books = brute_codes(rows)
    assert done.codebooks == books
    got = vector_codes.with_label_error(done.vectors).collect()
    assert sorted(map(repr, [tuple(r)[:4] for r in got])) == sorted(map(repr, want))
    for r in got:
        total = sum(w[3] for w in want if w[1] == r["label"])
        assert r["label_error"] == min(total, (1 << 63) - 1)


def test_vector_codes_of_few_vectors_and_narrow_parts(spark):
    rows = [(i, [0.5 * i, -1.0, 2.0 * i, 0.0, 1.0], i % 2) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    done = vector_codes.compress(df)
    want, books = brute_codes(rows)
    assert done.codebooks == books and sorted(map(tuple, done.vectors.collect())) == sorted(want)
    empty = vector_codes.compress(df.limit(0))
    assert vector_codes.with_label_error(empty.vectors).collect() == [] and empty.codebooks == []
    odd_length = vector_codes.compress(df.union(df.select(F.lit(9).cast("long"), F.array(F.lit(1.0)).cast("array<float>"), F.lit(1))))
    assert odd_length.vectors.count() == 3


def test_boxes_settle_blocks():
    rnd = np.random.default_rng(3)
    values = np.concatenate([rnd.normal(1000 * c, 5, (640, 2)).astype(np.int64) for c in range(4)])
    blocks = vector_codes.make_blocks(values)
    book = np.array([[1000 * c, 1000 * c] for c in range(4)])
    assert vector_codes.shortlists(blocks, book).sum(1).mean() < 1.2  # nearly no block needs its points
    counts, sums = vector_codes.entry_sums(blocks, book)
    own = ((values[:, None] - book) ** 2).sum(2).argmin(1)
    assert counts.tolist() == np.bincount(own).tolist() and sums.tolist() == [values[own == e].sum(0).tolist() for e in range(4)]


def brute_components(texts, n, percent):
    import re

    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


def copied_texts(seed, count, kinds=(0.5, 3)):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(600)]
    out = []
    for _ in range(count):
        if out and rnd.random() < kinds[0]:
            copy = rnd.choice(out).split(" ")
            for _ in range(rnd.randint(0, kinds[1])):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append(" ".join(copy))
        else:
            out.append(" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 4, 5, 9, 40, 90, 200]))))
    return out


@pytest.mark.parametrize("n,percent", [(5, 80), (3, 60)])
def test_near_copies_equal_brute_force(spark, n, percent):
    texts = copied_texts(n, 250)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_components(texts, n, percent)
    for crowd, tile in ((256, 500_000), (3, 60)):  # usual regions; crowded ones that go deeper, and pairs of tiles
        got = lsh_forest.near_copies(docs, n=n, percent=percent, crowd=crowd, tile=tile).collect()
        if crowd == 256:
            assert {r[0]: tuple(r)[1:] for r in got} == want
        else:  # depth costs recall only where sets crowd, and nothing false is linked
            right = sum(tuple(r)[1:] == want[r[0]] for r in got)
            assert right >= 0.95 * len(got) and all(r[2] >= want[r[0]][1] for r in got)


def test_one_neighbourhood_of_many_near_copies(spark):
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(500):  # all crowd in one region of every tree
        one = list(base)
        one[rnd.randrange(400)] = f"x{rnd.randrange(9999)}"
        texts.append(" ".join(one))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lsh_forest.near_copies(docs, crowd=64, tile=8_000).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_near_copies_of_odd_rows(odd):
    got = [tuple(r) for r in lsh_forest.near_copies(odd, n=4).collect()]
    assert len(got) == odd.count()
    assert (None, 1, None, True) in got and (0, 0, 0, True) in got and got.count((5, 1, 5, True)) == 2 and (6, 1, 5, False) in got
    assert lsh_forest.near_copies(odd.limit(0)).collect() == []


def test_tiles_lose_no_link(spark):
    """Neighbourhoods of several tiles: a large component, chains beside it, and sets that link with nothing."""
    base = [f"w{i}" for i in range(120)]
    texts = copied_texts(12, 60, (0.6, 3))
    for k in range(40):  # near copies of one text, linked directly or in a chain
        one = list(base)
        one[(7 * k) % 120] = one[(11 * k) % 120] = f"x{k}"
        texts.append(" ".join(one))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "key long, text string, more int")
    want = {i: c for i, (_, c, _) in brute_components(texts, 5, 80).items()}
    members = docs.select(F.col("key").alias("vertex"), F.lit(1).alias("block"), F.lit(40).alias("n"))
    for tile in (10**9, 400):  # one tile, and ten
        got = {r[0]: r[1] for r in lsh_forest.linked(docs.select("key", "text"), members, 5, 80, tile).collect()}
        assert {i: got.get(i, i) for i in want} == want
    assert len(set(want.values())) > 20 and max(list(want.values()).count(c) for c in set(want.values())) > 20


def test_marked_rows_hold_all_keys(spark):
    rows = spark.range(5000).select(F.col("id").alias("key"), F.lit("t").alias("text"))
    keys = spark.range(0, 5000, 7).select(F.col("id").alias("vertex"))
    got = {r[0] for r in lsh_forest.marked(rows, keys, "vertex").collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 800
    assert lsh_forest.marked(rows, keys.limit(0), "vertex").collect() == []


def test_forest_misses_less_than_it_says():
    p = lsh_forest.alike_values(80)
    assert 30 <= p <= 40 and (1 - 0.8**lsh_forest.STEP) ** lsh_forest.TREES < 4e-8
