"""All five stages of the pipeline, each against brute force on what the one before kept."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkgauge.llm.common import table
from sparkgauge.llm.queries import vocabulary_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = {"en": "the of and with some house".split(), "de": "der die und mit einem haus".split()}


def edited(text, places):
    words = text.split(" ")
    for k in places:
        words[k] = f"other{k}"
    return " ".join(words)


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = []
    for i in range(120):
        lang = draw.choice(["en", "de"])
        text = " ".join(draw.choice(COMMON[lang]) if draw.random() < 0.5 else word() for _ in range(draw.choice([2, 4, 6, 30, 90])))
        rows.append((i, text, lang, draw.choice("aaab"), len(text)))
    once = lambda n: " ".join(word() for _ in range(n))  # noqa: E731  all words differ
    one, two, three = once(50), once(98), once(48)
    near = [one, edited(one, [25]), two, edited(two, [30, 65]), three, edited(three, [24]), "a b", "A  b"]
    item = once(20)
    odd = [None, "", "12 34 !", item, f"{once(300)} {item} {once(300)}", f"{item} {once(40)}"]
    for k, text in enumerate(near + odd):
        rows.append((1000 + k, text, "en", "b", len(text or "")))
    return rows, item


def brute_near(docs):
    sets = []
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {docs[i][0] for i in range(len(docs)) if find(i) == i}


def brute_clean(docs, item):
    words = lambda t: re.findall("[0-9a-z]+", (t or "").lower())
    x = words(item)
    wins = {tuple(x[k : k + 13]) for k in range(len(x) - 12)}
    kept = set()
    for r in docs:
        w = words(r[1])
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in wins for j in range(k, k + 13)}
        if not hit or 20 * len(hit) < len(w):
            kept.add(r[0])
    return kept


def brute_mix(docs):
    size = {r[0]: len((r[1] or "").split()) for r in docs}
    totals = Counter()
    for r in docs:
        totals[r[3]] += size[r[0]]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(totals))}
    capped = set()
    while True:
        rest = sum(totals.values()) - 3 * sum(totals[s] for s in capped)
        share = rest / sum(weight[s] for s in totals if s not in capped)
        more = {s for s in totals if s not in capped and share * weight[s] > 3 * totals[s]}
        if not more:
            break
        capped |= more
    want = Counter()
    for s in totals:
        rate = (3 * totals[s] if s in capped else share * weight[s]) / totals[s]
        u = int(hashlib.md5(b"mix" + s.encode()).hexdigest()[:8], 16) / 2**32
        for k, r in enumerate(sorted((r for r in docs if r[3] == s), key=lambda r: (size[r[0]], r[0]))):
            want[r[0]] = math.floor((k + 1) * rate + u) - math.floor(k * rate + u)
    return +want


def test_stages_against_brute_force(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, docs, left = dict(corpus_pipeline.STAGES), table(spark, str(tmp_path), "documents"), rows
    assert list(stages) == ["language", "near_duplicates", "decontaminate", "mix_sources", "token_files"]

    def run(name):
        nonlocal docs
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        return sorted(tuple(r) for r in docs.collect())

    left = sorted(r for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert run("language") == left and len(left) < len(rows)

    keep = brute_near(left)
    # 0.8 on five words but not 0.85 on four: 1001 and 1003; 1005 is just under both
    assert not keep & {1001, 1003, 1007} and {1000, 1002, 1004, 1005, 1006} <= keep
    left = [r for r in left if r[0] in keep]
    assert run("near_duplicates") == left

    keep = brute_clean(left, item)
    assert not keep & {1011, 1013} and 1012 in keep
    left = [r for r in left if r[0] in keep]
    assert run("decontaminate") == left

    copies = brute_mix(left)
    left = [r for r in left for _ in range(copies[r[0]])]
    assert run("mix_sources") == left and max(copies.values()) > 1

    library = Tokenizer.from_file(vocabulary_file())
    ids = [[*library.encode(r[1], add_special_tokens=False).ids, 2] for r in left]
    starts = np.cumsum([0, *map(len, ids)])
    want = [(r[0], int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, s, x in zip(left, starts, ids)]
    assert run("token_files") == sorted(want)


ODD = "doc_id long, text string, lang string, source string, n_chars long, gone string, _gone string, lang_pred string, Score string, of_row string"


def test_stages_of_odd_tables(spark, tmp_path):
    """Null and repeated ids, columns of the stages' own names, a corpus without labels, an empty one."""
    item = " ".join(f"q{i}" for i in range(20))
    clean = " ".join(f"clean{i}" for i in range(30))
    more = ("a", "b", "c", "d", "e")
    rows = [(1, item, "en", "s", 1, *more), (1, clean, "en", "s", 1, *more), (None, item, "en", None, 1, *more), (None, clean + " x", "en", None, 1, *more), (2, None, None, None, None, *more), (2, None, None, None, None, *more)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, ODD)
    stages = dict(corpus_pipeline.STAGES)
    left = stages["decontaminate"](spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(map(repr, left.collect())) == sorted(map(repr, docs.filter(f"text is null or text <> '{item}'").collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert stages["language"](spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).count() == len(rows)
    assert stages["token_files"](spark, docs.limit(0), str(tmp_path)).collect() == []


def test_language_stage_uses_its_prediction(spark, tmp_path):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.language(spark, docs, str(tmp_path), frozenset(["de"])).filter("doc_id < 1000").collect()
    right = [r for r in kept if r["lang"] == "de"]
    assert 0.9 * len(kept) <= len(right) < len(rows) / 1.5
