"""Line dedup against brute force: all white space, null texts, empty lines, repeated lines, an empty table."""

import random
import re

from pyspark.sql import functions as F

from sparkgauge.llm import line_dedup


def test_repeated_lines_equal_brute_force(spark):
    rnd = random.Random(3)
    docs = []
    for i in range(120):
        lines = [
            rnd.choice([" ", "\t", "\x0b \r", "  "]).join(rnd.choice("abcdefghijklmn") for _ in range(rnd.randint(0, 14)))
            for _ in range(rnd.randint(0, 4))
        ]
        docs.append((i, None if i % 17 == 0 else "\n".join(lines)))
    got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    places = [
        (d, k, frozenset(w for w in re.split("[\x20\x09-\x0d]+", line) if w))
        for d, text in docs
        for k, line in enumerate((text or "").split("\n"))
    ]
    want = {d: [] for d, _ in docs}
    for at, (d, k, words) in enumerate(places):
        if words and any(100 * len(words & x) >= 80 * len(words | x) for _, _, x in places[:at]):
            want[d].append(k)
    assert {r[0]: list(r[2]) for r in got} == want and any(want.values())
    assert line_dedup.repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_are_not_paired_with_all_others_of_their_group(spark, monkeypatch):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.sample(base, 58) + [f"own{i}"]) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(t.split()) for t in texts]
    want = {i: [0] if any(100 * len(s & x) >= 80 * len(s | x) for x in sets[:i]) else [] for i, s in enumerate(sets)}
    sizes = {}
    plain = line_dedup.stored

    def counted(df, name, **options):
        out = plain(df, name, **options)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    got = line_dedup.repeated_lines(docs)
    assert {r["doc_id"]: list(r["removed"]) for r in got.collect()} == want and sum(map(len, want.values())) == 119
    # all pairs are 7,140
    assert all(n <= 10 * len(texts) for name in ("line-pairs", "line-near") for n in sizes[name]), sizes


def test_lines_that_meet_no_earlier_one_are_still_paired(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rnd.sample(words[: rnd.randint(22, 30)], 20)) for _ in range(60)]
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(map(tuple, line_dedup.repeated_lines(docs).select("doc_id", "n_lines", "removed").collect()), key=str)
    real = line_dedup.earlier_sets
    monkeypatch.setattr(line_dedup, "earlier_sets", lambda sets, percent: real(sets, percent).filter("false"))
    assert sorted(map(tuple, line_dedup.repeated_lines(docs).select("doc_id", "n_lines", "removed").collect()), key=str) == rows
    assert any(r[2] for r in rows)


def test_signatures_hold_a_bit_for_each_word(spark):
    words = [-(1 << 63), -1, 0, 1, 63, 64, 127, 128, 500, (1 << 63) - 1]
    for parts in (2, 8):
        columns = [line_dedup.signature(F.array(*[F.lit(w).cast("long") for w in words]), k, parts) for k in range(parts)]
        want = [sum({1 << (w & 63) for w in words if (w & (64 * parts - 1)) >> 6 == k}) for k in range(parts)]
        assert [x % (1 << 64) for x in spark.range(1).select(*columns).first()] == want
