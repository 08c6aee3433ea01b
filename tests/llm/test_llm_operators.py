"""Operators of the llm folder on small fixtures, against brute force and round trips."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkgauge.llm import (
    decontam,
    exact_dedup,
    html_text,
    langid,
    line_dedup,
    lsh_forest,
    mixing,
    ngram_join,
    rans,
    suffix_dedup,
    warc,
)
from sparkgauge.llm.queries import vocabulary_file

LONG = "word " * 30_000
ODD = [None, "", " \t\n", "a", "Ä ö", "x y z", "x y z", "one\ntwo\none", LONG, "\x00 b", "😀 smile"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, KEY string, Text2 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "k", None) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "x y z", None, None, None, None, None), (3, "b", "de", "t", 1, "k", "t")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_with_copies(seed, n=120):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdef") for _ in range(draw.randint(1, 6))) for _ in range(400)]
    out = []
    for _ in range(n):
        if out and draw.random() < 0.5:
            copy = draw.choice(out).split(" ")
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append(" ".join(copy))
        else:
            out.append(" ".join(draw.choice(words) for _ in range(draw.choice([1, 3, 5, 40, 90]))))
    return out


@pytest.fixture(scope="module")
def copies(spark):
    texts = texts_with_copies(5)
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_every_operator_takes_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "x y z"), (None, "one two"), (2, None), (2, "")], "item_id long, text string")
    pages = lambda d: d.selectExpr("doc_id page_id", "source url", "text html", "KEY")
    for docs in (odd, none):
        n = docs.count()
        assert exact_dedup.exact_groups(docs).count() == n
        assert langid.identify(docs).count() == n
        assert decontam.contamination(docs, items).count() == n
        assert mixing.mix(docs).count() == n
        assert suffix_dedup.remove_repeats(docs).count() == n
        assert rans.round_trip(docs, vocabulary_file()).count() == n
        assert ngram_join.jaccard_components(docs).count() == n
        assert line_dedup.repeated_lines(docs).count() == docs.select("doc_id").distinct().count()
        assert warc.archive_round_trip(pages(docs)).count() == n
        assert html_text.extract(pages(docs), html_text.train(pages(docs))).count() == n


def test_exact_groups(odd):
    got = [r.asDict() for r in exact_dedup.exact_groups(odd).collect()]
    groups = {}
    for r in got:
        groups.setdefault(r["text_sha256"], []).append(r)
    for rows in groups.values():
        assert {r["group_size"] for r in rows} == {len(rows)} and sum(r["kept"] for r in rows) == 1
    empty = groups[hashlib.sha256(b"").hexdigest()]
    assert {r["keep_id"] for r in empty} == {2}  # three code points of white space beat none


def test_bloom_filter_too_small_is_still_exact(copies):
    texts, docs = copies
    small = exact_dedup.exact_groups(docs, cells_per_row=0, max_bits=1).collect()
    large = exact_dedup.exact_groups(docs).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large)) and len(large) == len(texts)


def test_arc_versions_and_revisits(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nhi\n\n"
    v2 = b"2 0 x\nURL IP Date Type Code Sum Location Offset File Length\n"
    one = b"filedesc://a 0.0.0.0 1999 text/plain 10\n1 0 x\nURL \nhttp://a b/c 1.2.3.4 19990102030405 text/html %d\n%s\n" % (len(body), body)
    two = b"filedesc://a 0 1999 text/plain 200 - - 0 a %d\n%s\ndns:x 1.2.3.4 1999 text/dns 200 - - 0 a 4\nabcd\n" % (len(v2), v2)
    first, second = list(warc.arc_records(one)), list(warc.arc_records(two))
    assert first[1]["url"] == "http://a b/c" and first[1]["block"] == body
    assert second[1]["block"] == b"abcd" and second[1]["status"] == "200"
    assert warc.iso_date("19990102") == "1999-01-02T00:00:00Z" and warc.iso_date("19990102030405") == "1999-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(warc.arc_records(one[:-8]))
    page = "p" * 1000
    pages = spark.createDataFrame([(1, "u", page), (5, "u v", page), (5, None, page), (2, "w", "q"), (3, "w", "q"), (None, "x", None)], "page_id long, url string, html string")
    got = sorted(((r[0] or 0, r[2], r[4], r[5]) for r in warc.archive_round_trip(pages).collect()), key=repr)
    assert got == sorted([(0, 0, "response", None), (1, 1000, "revisit", 5), (2, 1, "response", None), (3, 1, "response", None), (5, 1000, "response", None), (5, 1000, "revisit", 5)], key=repr)


def test_main_text_parts():
    nodes, runs = html_text.parse("<p>a<b>b</b> c<p>d &amp;\n e<script>x<p></script></div>f<!-- no --><ul><li>g<li>h</ul>")
    assert [t for _, t in runs] == ["ab c", "d & ef", "g", "h"]
    nodes, _ = html_text.parse("<div><nav><p>x</p></nav><p>y</p></div>")
    keep = html_text.decode(nodes, np.array([1.0, 1.0, -90.0, 1.0, 1.0]))
    assert keep.tolist() == [True, True, False, False, True]  # nothing is kept below a dropped node


def test_main_text_without_head_end_and_with_closed_icons():
    said = lambda page: [t for _, t in html_text.parse(page)[1]]
    assert said("<!DOCTYPE html><html><head><title>t</title><meta charset=x><body><p>one<p>two") == ["one", "two"]
    assert said("<head> <title>t</title>\n<!-- c --><style>p{}</style><p>one</p>two") == ["one", "two"]
    assert said("<html><head><script>x</script>one<br>two</html>") == ["one two"]
    assert said("<head><template><p>no</p></template><link href=a></head>\n<body><p>one</p></body>") == ["one"]
    assert said("<head><title>t</title></head><body><p>one<head>two</p></body>") == ["onetwo"]
    assert said("<p>one <svg/> two <math class='a'/> three <svg viewBox=\"0 0 1 1\" /> four</p>") == ["one two three four"]
    assert said("<p>one <svg><path d='M0'/><text>no</text></svg> two <svg width=10/>no</svg> three</p>") == ["one two three"]


def test_tags_are_scanned_once():
    """Attribute values of all kinds, cut-off tags, empty comments, blocks in elements that show nothing; a megabyte of bad markup."""
    said = lambda page: [t for _, t in html_text.parse(page)[1]]
    assert said("<article><p title=it's>First words here.</p><p>Don't stop now.</p><p>Last one.</p></article>") == ["First words here.", "Don't stop now.", "Last one."]
    assert said('one<p class="x>two</p><p>three "q" four') == ["one"]
    assert said("<p a='>' b=\">\" c d = e>in</p>") == ["in"]
    assert said("<p>hello <template><p>q</p></template>world</p>") == ["hello world"]
    assert said("<p>a<svg><p>x</p></svg>b</p><p>c<button><div>x</div></button>d<object><p>y</p></object>e</p>") == ["ab", "cde"]
    assert said("a<!-->b<!--->c<!-- x -->d<!-- y --!>e") == ["abcde"]
    assert said("1 < 2 <3 a<b>c</b> </ x>d<?php x?>e") == ["1 < 2 <3 ac de"]
    assert said("<script>no</script >yes<p x") == ["yes"]
    for page in ("<p x " * 200_000, "<p x='" * 170_000, "<" * 1_000_000, "<b>" * 150_000 + "</i>" * 150_000, "<!--" * 250_000, "<b>" * 60_000 + "<div></div>" * 60_000):
        start = time.process_time()
        html_text.parse(page)
        assert time.process_time() - start < 6  # the square of the length would take hours


def test_arc_of_any_bytes(spark, tmp_path):
    """Latin-1 and binary payloads keep their bytes and digests through the converter."""
    head = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\n\r\n"
    payloads = [b"caf\xe9 " * 300, bytes(range(256)) * 8, b"caf\xe9 " * 300, b"\xff\xfe\r\n\r\n\x00", "é\n\n".encode()]
    version = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    arc = b"filedesc://a 0.0.0.0 19990102030405 text/plain %d\n%s\n" % (len(version), version)
    for k, payload in enumerate(payloads):
        block = head % k + payload
        arc += b"http://a/%d 1.2.3.4 19990102030405 text/html %d\n%s\n" % (k, len(block), block)
    image = b"\x89PNG\r\n\x1a\n\x00\xff"
    arc += b"http://a/i.png 1.2.3.4 19990102030405 image/png %d\n%s\n" % (len(image), image)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc").write_bytes(arc)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = {r["url"]: r for r in warc.read_warc(spark, str(tmp_path / "warc")).filter("kind <> 'warcinfo'").collect()}
    for k, payload in enumerate(payloads):
        r = got[f"http://a/{k}"]
        assert (r["payload_bytes"], r["digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert bytes(r["block"]) == (head % k + payload if k else head % k) and r["kind"] == ("response" if k else "revisit")
    assert got["http://a/0"]["refers_to"] == 2 and bytes(got["http://a/i.png"]["block"]) == image


def test_archives_of_several_files_a_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    pages = spark.range(60).repartition(2).selectExpr("id page_id", "'u' || id url", "repeat('x', int(id * 40)) html")
    got = {r["page_id"]: r["payload_bytes"] for r in warc.archive_round_trip(pages).collect()}
    assert got == {i: 40 * i for i in range(60)}


def test_main_text_of_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.extract(pages, html_text.train(pages)).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        import html

        want = " ".join(html.unescape(re.sub("</?(p|h1|br)>", " ", re.sub("</?b>", "", body))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_decontamination_blocks_agree(spark, copies):
    texts, docs = copies
    items = [(i, " ".join(t.split(" ")[2:18])) for i, t in enumerate(texts[::4])] + [(900, "abc")]
    table = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall("[0-9a-z]+", t.lower())
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for i, x in items:
            x = words(x)
            size = min(13, len(x))
            wins = {tuple(x[k : k + size]) for k in range(len(x) - size + 1)} if x else set()
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    found.add(str(i))
        want[d] = (len(w), len(hit), sorted(found))
    for block in (2_000_000, 20):  # one block, and many that are merged
        got = decontam.find_phrases(docs, table, block_words=block).collect()
        assert {r["doc_id"]: (r["n_words"], sum(b - a for a, b in zip(r["hit_from"], r["hit_to"])), list(r["items"])) for r in got} == want


def test_decontamination_blocks_keep_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "x b c"), (1, "x b c"), (None, "c d"), (None, "q q q q q"), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(k, t) for k, t in enumerate(["a b", "b c", "c d", "q q", "x", "zz zz zz zz zz zz zz zz"])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = [
        (1, 4, [(0, 4)], ["0", "1", "2"]), (1, 3, [(0, 3)], ["1", "4"]), (1, 3, [(0, 3)], ["1", "4"]),
        (None, 2, [(0, 2)], ["2"]), (None, 5, [(0, 5)], ["3"]), (None, 0, [], []), (2, 0, [], []),
    ]
    for block in (2_000_000, 1):  # one block, and many that are merged
        got = decontam.find_phrases(docs, table, block_words=block)
        assert got.columns == ["doc_id", "n_words", "hit_from", "hit_to", "items"] and got.schema["doc_id"].dataType.simpleString() == "bigint"
        got = [(r["doc_id"], r["n_words"], list(zip(r["hit_from"], r["hit_to"])), list(r["items"])) for r in got.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_terms(spark):
    docs = spark.createDataFrame([(1, "red x x blue"), (2, "red x x x x blue"), (3, "blue"), (4, "blue red")], "doc_id long, text string")
    assert sorted({r[0] for r in decontam.find_near(docs, ["Red", "blue"], 3).collect()}) == [1, 4]


def test_mix_comes_near_targets(spark):
    draw = random.Random(3)
    rows = [(i, "w " * draw.randint(0, 60), draw.choice("aaaaaabcd")) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    for s in "abcd":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 130 and own[0]["target"] <= 3 * own[0]["source_size"]
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - sum(r["size"] for r in got)) < 1e-6


def test_suffix_order():
    draw = random.Random(1)
    for _ in range(300):
        x = [draw.randint(1, draw.choice([1, 2, 9])) for _ in range(draw.randint(1, 60))]
        assert suffix_dedup.suffix_order(np.array(x)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_suffix_order_of_large_names():
    draw = random.Random(4)
    for _ in range(100):  # names whose pairs times the length pass 2**63
        names = [draw.randint(1 << 28, 1 << 31) for _ in range(draw.choice([2, 5, 30]))]
        x = [draw.choice(names) for _ in range(draw.randint(3, 60))]
        assert suffix_dedup.suffix_order(np.array(x)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_substrings_against_brute_force(copies):
    texts, docs = copies
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()}
    seen = set()
    for d, t in enumerate(texts):
        raw = t.encode()
        windows = [raw[i : i + 50] for i in range(len(raw) - 49)]
        gone = {j for i, w in enumerate(windows) if w in seen for j in range(i, i + 50)}
        assert got[d] == (len(gone), bytes(b for i, b in enumerate(raw) if i not in gone))
        seen |= set(windows)


def test_only_minimisers_of_several_keys_are_sorted(monkeypatch):
    sorted_pieces = []
    plain = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda p, *rest: sorted_pieces.extend(p) or plain(p, *rest))
    draw = random.Random(5)
    a, b, c, d = (bytes(draw.randrange(256) for _ in range(60)) for _ in range(4))
    # minimisers: one piece of two documents; two pieces of one; two that share fifty bytes, of two
    rows = [(1, 4, 0, a), (1, 9, 3, a), (2, 4, 0, b), (2, 4, 90, c), (3, 2, 5, d), (3, 6, 7, b"x" + d[:50])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int32(), pa.binary()])],
        ["bucket", "key", "start", "piece"],
    )
    found = pa.Table.from_batches(suffix_dedup._removed(50, 1 << 20)(iter([batch])))
    assert sorted(zip(*(c.to_pylist() for c in found.columns))) == [(6, 8, 50), (9, 3, 60)]
    assert sorted(sorted_pieces) == sorted([d, b"x" + d[:50]])


def test_super_windows_against_brute_force():
    draw = random.Random(6)
    for size in (1, 49, 50, 51, 300):
        texts = [bytes(draw.choice(b"ab") for _ in range(draw.choice([0, 20, 49, 50, size]))) for _ in range(9)]
        offsets = np.cumsum([0, *map(len, texts)])
        got = suffix_dedup.super_windows(np.frombuffer(b"".join(texts), np.uint8), offsets, 50, 20)
        places, least = [], {}
        for row, start, count, value in zip(*(x.tolist() for x in got)):
            for i in range(start, start + count):
                places.append((row, i))
                assert least.setdefault(texts[row][i : i + 50], value) == value  # equal windows have equal minimisers
        assert places == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 49)]


def test_rans_round_trip_and_damage():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 64, 5000, 300_000):
        ids = (rng.pareto(1.0, n) * 3).astype(np.int64) % 900
        table = rans.Table.from_counts(np.bincount(ids, minlength=1000))
        _, states, words = rans.encode(ids, table)
        assert (rans.decode(n, states, words, table) == ids).all()


def test_cached_tokens_equal_the_library():
    texts = ["  a  b", "x \n y", " lead", "trail ", "don't 'll", "\x1c a \x85 b", "", "é è.", "tab\tx", "a.\nB c!!", "12 3a", "日本 語。", "<|endoftext|> x"]
    t = rans.Tokenizer(vocabulary_file())
    assert t.encode(texts) == t._library(texts) == t.encode(texts)


def test_tokens_of_many_words_equal_the_library():
    """Far more words than the caches hold, met again after they left."""
    draw = random.Random(8)
    letters = "abcdeéßñ中.,!-'0"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))
    texts = [draw.choice([" ", " ", "  ", "\n"]).join(word() for _ in range(draw.randint(1, 40))) for _ in range(600)]
    t = rans.Tokenizer(vocabulary_file())
    t.CACHE = t.PIECES = 50
    want = t._library(texts)
    for _ in range(2):
        assert [x for k in range(0, 600, 30) for x in t.encode(texts[k : k + 30])] == want
    assert len(t.known) < 3_000 and t.encode([]) == []


def test_added_tokens_as_a_plain_library_call():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_file())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "end <|endoftext|", "a b"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    t = rans.Tokenizer(vocabulary_file())
    assert [np.frombuffer(x, t.dtype).tolist() for x in t.encode(texts)] == want and 50256 in want[0]


def test_jaccard_components_against_brute_force(copies):
    texts, docs = copies
    sets = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for tile in (1024, 3):  # whole blocks, and pairs of tiles
        got = ngram_join.jaccard_components(docs, tile=tile).collect()
        assert {r[0]: (r[1], r[2]) for r in got} == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_most_different_bounds_every_link():
    for percent in (67, 70, 75, 80, 85, 90, 95):
        for n in range(1, 80):
            links = ((m, o) for m in range(1, 2 * n) for o in range(1, min(n, m) + 1) if 100 * o >= percent * (n + m - o))
            assert ngram_join.most_different(n, percent) == max((n + m - 2 * o for m, o in links), default=0)


@pytest.mark.parametrize("percent", [67, 70, 75, 80, 85, 90, 95])
def test_linked_sets_share_a_key(percent):
    """Every way in which small sets lie in a common order, and evenly cut ones of larger sets."""
    def check(union, a, b):
        a, b = (np.array([v for v, u in zip(union, use) if u], np.uint64) for use in (a, b))
        shared = len(np.intersect1d(a, b))
        if len(a) + len(b) > 2 * shared and 100 * shared >= percent * (len(a) + len(b) - shared):
            assert len(np.intersect1d(ngram_join.triples(a, percent), ngram_join.triples(b, percent))), (a, b)

    draw = random.Random(percent)
    for size in range(1, 9):
        union = sorted(draw.sample(range(1 << 40), size))
        for kinds in itertools.product((0, 1, 2), repeat=size):
            check(union, [k != 1 for k in kinds], [k != 2 for k in kinds])
    for size in range(9, 160):
        union = sorted(draw.sample(range(1 << 40), size))
        apart = (100 - percent) * size // 100
        for shift in range(4):
            if apart:
                step = (size - apart) // (apart + 1)
                away = {min(size - 1, shift + k * (step + 1)) for k in range(apart)}
                side = [draw.random() < 0.5 for _ in range(size)]
                check(union, [i not in away or side[i] for i in range(size)], [i not in away or not side[i] for i in range(size)])


def test_short_near_copies_are_linked(spark):
    """Sets of four and of five n-grams at 0.8, where the fifth one is in a third text, so rarity does not help."""
    rows = []
    for k in range(60):
        words = [f"w{k}x{i}" for i in range(9)]
        rows += [(3 * k, " ".join(words[:8])), (3 * k + 1, " ".join(words)), (3 * k + 2, " ".join(words[4:9] + [f"y{k}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r[0] for r in ngram_join.keep_first(docs).collect()}
    assert kept == {3 * k for k in range(60)} | {3 * k + 2 for k in range(60)}
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(docs, percent=60)


def test_columns_may_have_any_name(spark):
    """Names that the operators might use themselves, in both spellings of case."""
    names = ["gone", "_gone", "GONE_", "of_key", "times", "copy", "_k", "_copies", "_removed", "removed_lines", "key", "in_source", "row", "vertex", "block"]
    rows = [(1, "a b c d e f g h", "s", *names), (2, "a b c d e f g h", "s", *names), (3, "x", None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    assert {r["doc_id"] for r in exact_dedup.keep_one(docs).collect()} == {1, 3}
    assert {r["doc_id"] for r in ngram_join.keep_first(docs).collect()} == {1, 3}
    assert mixing.take(docs).columns == docs.columns and mixing.take(docs).count() > 0
    assert line_dedup.without_repeats(docs).filter("text = ''").count() == 1
    assert lsh_forest.near_copies(docs).filter("kept").count() == 2


def test_lines_without_repeats(spark):
    ten = "a b c d e f g h i j"
    docs = spark.createDataFrame([(1, f"{ten}\n\nxx\nxx"), (2, f"{ten} k\n{ten} k l m"), (3, None)], "doc_id long, text string")
    got = {r[0]: (r[1], list(r[2])) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {1: (4, [3]), 2: (2, [0, 1]), 3: (1, [])}  # 11 of 13 words are similar to a line that itself goes
    assert [r[1] for r in line_dedup.without_repeats(docs).orderBy("doc_id").collect()] == [f"{ten}\n\nxx", "", None]


def test_slices_cover_all_rows():
    from sparkgauge.llm.common import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["abc", None, "d" * 50, "", "e"])], ["text"])
    assert [x for p in slices(batch, limit=10) for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_new_words_are_spelled_together():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_file())
    t = rans.Tokenizer(vocabulary_file())
    words = [" the", "the", " Stra\u00dfe", " \u5317\u4eac", "\u00e9t\u00e9", " \U00010400x", " qzxjkvw", "a"]
    ids = [np.frombuffer(x, t.dtype).tolist() for x in t._words(words)]
    assert ids == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert t._words([]) == []
