"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Words are ordered by rarity (from a fixed number
of bucket counts over all lines, then by hash); two sets with a Jaccard index of
``percent`` or more share a word among the first ``n - ceil(percent * n) + 1`` of
both. Prefix words meet in an equi-join on the word and a band of lengths, with
length and positional filters and a bound on the words in which two sets differ,
read off 128-bit signatures. Sets that still pair up are told apart by 512-bit ones, and
the words of those that remain are fetched and compared. A line goes if a similar line stands earlier, by key and line number; lines
are judged on the input.

One earlier similar line is enough, so near copies are not paired with all others of their group: first each
set meets the earliest set and the one before it among those that share its smallest or largest hashes. Of two sets
that both go by such a confirmed pair, the join makes no pair; all other pairs are still looked at.

Texts are split once; the hashed words are written to the shared folder and all later
steps read them there. Equal sets are one row before the join, so a line in a third of
all documents costs one row a task. Words are compared as 59-bit hashes, sets are named
by 64-bit ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.llm.common import free_name, stored
from sparkgauge.session import configure

BUCKETS = 1 << 16
SHARED = 3  # words that a set has in common with those it meets before the join
FINER = 8  # times 64 bits of the signatures that pairs are looked at with before words are fetched
SLICES = 2  # of the prefix words, joined one after the other, so that shuffle files take half the disk
WANTED_BITS = 1 << 23  # of the map that says which sets' words are fetched: 1 MB
# words repeat within a task: a dictionary of up to 16 MB halves the files
COMPACT = {"compression": "zstd", "parquet.dictionary.page.size": str(1 << 24)}


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, sid, words): lines between line feeds with their distinct words in hash order and the name of
    that set; null is one empty line."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    other = F.contains(body, F.lit("\t")) | F.contains(body, F.lit("\x0b")) | F.contains(body, F.lit("\x0c")) | F.contains(body, F.lit("\r"))
    flat = F.when(other, F.translate(body, "\t\x0b\x0c\r", "    ")).otherwise(body)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.posexplode(F.split(flat, "\n")).alias("line_no", "line"))
    words = F.transform(F.array_remove(F.split("line", " "), ""), lambda w: F.xxhash64(w))
    rows = rows.select("key", "line_no", F.sort_array(F.array_distinct(words)).alias("words"))
    return rows.select("key", "line_no", F.xxhash64("words").alias("sid"), "words")


def bucket(word: Column) -> Column:
    return word.bitwiseAND(BUCKETS - 1)


def rarity(lines: DataFrame) -> list[int]:
    """Sixteen steps of commonness, from bit 59 on, for each of ``BUCKETS`` buckets, counted over all lines."""
    counts = lines.select(F.explode("words").alias("w")).groupBy(bucket(F.col("w")).alias("b")).count().collect()
    by = {r[0]: r[1] for r in counts}
    usual = sorted(by.values())[len(by) // 2] if by else 1
    return [min(15, max(0, (2 * by.get(b, 0) // usual).bit_length() - 1)) << 59 for b in range(BUCKETS)]


def looked_up(numbers: list[int], at: Column) -> Column:
    """The number at that place; never null, so that arrays of them are sorted as plain longs."""
    table = F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")  # one literal in the plan
    return F.coalesce(F.get(table, at), F.lit(0).cast("long"))


def in_order(words: Column, steps: list[int]) -> Column:
    """Words, rare ones first; the step is in the top bits."""
    return F.sort_array(F.transform(words, lambda w: looked_up(steps, bucket(w)).bitwiseXOR(w.bitwiseAND((1 << 59) - 1))))


def signature(words: Column, part: int, parts: int = 2) -> Column:
    """A bit for each word, in one of ``parts`` (a power of two) times 64 bits."""
    bit = [(1 << k) - (k == 63) * (1 << 64) for k in range(64)]
    table = [bit[k % 64] if k // 64 == part else 0 for k in range(64 * parts)]
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseOR(looked_up(table, w.bitwiseAND(64 * parts - 1))))


def shares(words: Column) -> Column:
    """Hashes of a few words each; sets with most words in common mostly have one of these in common."""
    starts = [1, -SHARED, 1 + SHARED, -2 * SHARED]
    some = [F.xxhash64(F.lit(k), F.slice(words, start, SHARED)) for k, start in enumerate(starts)]
    return F.when(F.size(words) >= 4 * SHARED, F.array(*some)).otherwise(F.array(*some[:2]))


def may_be_similar(percent: int, at: bool = False) -> Column:
    """Whether sets of n_a and n words can be similar, by size, signatures and, with ``at``, by the places of a shared word."""
    need = F.ceil(percent * (F.col("n_a") + F.col("n")) / (100 + percent))
    differ = F.bit_count(F.col("low").bitwiseXOR(F.col("low_a"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high_a")))
    keep = 100 * F.least("n_a", "n") >= percent * F.greatest("n_a", "n")
    if at:
        keep &= F.least("at_a", "at") + F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at")) >= need
    return keep & (differ <= F.col("n_a") + F.col("n") - 2 * need)


def earlier_sets(sets: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): each of distinct (sid, n, low, high, shares, _k, _l) rows as b with the earliest and the next earlier one
    of those that have a share of it, where signatures allow it: a few pairs a set, however large the group."""
    columns = ["sid", "n", "low", "high", "_k", "_l"]
    rows = sets.select(*columns, F.explode("shares").alias("share"))
    order = Window.partitionBy("share").orderBy("_k", "_l")
    one = F.struct(*columns)
    met = rows.select(*columns, F.array(F.first(one).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lag(one).over(order)).alias("met"))
    met = met.select(*columns, F.explode(F.array_distinct("met")).alias("met")).filter(F.struct("met._k", "met._l") < F.struct("_k", "_l"))
    met = met.select("sid", "n", "low", "high", *[F.col(f"met.{x}").alias(f"{x}_a") for x in ("sid", "n", "low", "high")])
    return met.filter(may_be_similar(percent)).select(F.col("sid_a").alias("a"), F.col("sid").alias("b")).distinct()


def similar_sets(sets: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): candidate pairs of distinct (sid, n, prefix, low, high, open) rows after all filters, but none of two
    sets that are not open."""
    return reduce(DataFrame.union, [stored(pairs_of_slice(sets, percent, k), "line-slice") for k in range(SLICES)]).distinct()


def pairs_of_slice(sets: DataFrame, percent: int, part: int) -> DataFrame:
    """The pairs of ``similar_sets`` that share a word of one slice.

    Linked sets have lengths in one band or in neighbouring ones: the longer set stands in
    its own band and in the one below. The shorter set needs a shorter prefix, since as many words
    as in two sets of its own size are shared at least. Rows move once, by word.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    band = F.coalesce(band, F.lit(0))  # never null, so no filter is pushed into one side only and both read one exchange
    words = sets.select("sid", "n", "low", "high", "open", F.posexplode("prefix").alias("at", "word")).filter(F.pmod(F.col("word"), F.lit(SLICES)) == part)
    packed = F.call_function("shiftleft", F.col("n").cast("long"), F.lit(32)) + 2 * F.col("at") + F.col("open").cast("int")
    words = words.select("word", "sid", "low", "high", packed.alias("packed")).repartition("word")
    place = F.col("packed").bitwiseAND((1 << 32) - 1)
    n, at, is_open = F.call_function("shiftright", "packed", F.lit(32)).cast("int"), F.floor(place / 2).cast("int"), place.bitwiseAND(1) == 1
    words = words.select("word", "sid", n.alias("n"), at.alias("at"), is_open.alias("open"), "low", "high")
    within = F.col("at") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    short = words.select("word", F.explode(F.array_repeat(band, F.when(within, 1).otherwise(0))).alias("band"), *[F.col(x).alias(f"{x}_a") for x in ("sid", "n", "at", "open", "low", "high")])
    long = words.select("word", F.explode(F.array(band, band - 1)).alias("band"), "sid", "n", "at", "open", "low", "high")
    order = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("sid_a") < F.col("sid")))
    keep = order & (F.col("open_a") | F.col("open")) & may_be_similar(percent, at=True)
    on = (short["word"] == long["word"]) & (short["band"] == long["band"]) & keep
    return short.hint("shuffle_hash").join(long, on).select(F.col("sid_a").alias("a"), F.col("sid").alias("b")).distinct()


def marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` whose sid may be among ``ids``: all that are, and few others. The map that says so has a fixed size."""
    at = lambda c: F.pmod(F.col(c), F.lit(WANTED_BITS))
    bits = ids.select(at("_id").alias("_at")).groupBy(F.call_function("bitmap_bucket_number", "_at").alias("_part"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))
    place = F.bitmap_bit_position(at("sid"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) == 1
    # WANTED_BITS / 8 bytes at most
    return rows.join(F.broadcast(bits), F.call_function("bitmap_bucket_number", at("sid")) == F.col("_part")).filter(hit).select(*rows.columns)


def gone_by(pairs: DataFrame, lines: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """_gone: of each pair (a, b) that is similar, the set whose lines go."""
    n = F.size("words")
    place = [F.col("first.key").alias("_k"), F.col("first.line_no").alias("_l")]
    at_first = (F.col("sid") == F.col("_sid")) & F.col("key").eqNullSafe(F.col("_k")) & (F.col("line_no") == F.col("_l"))
    # fetch the words of the sets in pairs from there
    ids = stored(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct(), "line-ids")
    wanted = sets.join(ids, F.col("sid") == F.col("_id")).select(F.col("sid").alias("_sid"), *place)
    found = marked(lines, ids).join(wanted, at_first).select("sid", "words").dropDuplicates(["sid"])
    found = stored(found, "line-found", **COMPACT)
    # the words of a set travel with each of its pairs: first the pairs that finer signatures tell apart go
    finer = found.select("sid", n.alias("n"), F.array(*[signature(F.col("words"), k, FINER) for k in range(FINER)]).alias("bits"))
    finer = stored(finer, "line-bits")
    sides = [finer.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")).hint("shuffle_hash") for x in "ab"]
    differ = sum(F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(FINER))
    sizes = F.col("n_a") + F.col("n_b")
    near = pairs.join(sides[0], "a").join(sides[1], "b").filter((100 + percent) * differ <= (100 - percent) * sizes)
    near = stored(near.select("a", "b"), "line-near")
    # sorted by the first set, so that its words, which repeat, shuffle compressed
    both = near.join(found.select(F.col("sid").alias("a"), F.col("words").alias("w_a")), "a")
    both = both.join(found.select(F.col("sid").alias("b"), F.col("words").alias("w_b")).hint("shuffle_hash"), "b")
    # one intersection a pair: shared / (both sizes - shared) is percent / 100 or more
    similar = (100 + percent) * F.size(F.array_intersect("w_a", "w_b")) >= percent * (F.size("w_a") + F.size("w_b"))
    both = both.filter(similar).select("a", "b")
    # of two similar sets, the lines of the one that stands first later go
    both = both.join(sets.select(F.col("sid").alias("a"), F.col("first").alias("f_a")), "a")
    both = both.join(sets.select(F.col("sid").alias("b"), F.col("first").alias("f_b")), "b")
    return both.select(F.when(F.col("f_a") < F.col("f_b"), F.col("b")).otherwise(F.col("a")).alias("_gone")).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(key, n_lines, removed): the numbers (from 0) of the lines that go, ascending, one row per key.

    Lines without words stay and match nothing; null and empty texts have one such line.
    Rows with equal keys are one document whose lines have several copies: of equal
    places one line counts as earlier than none. An empty table gives an empty result.
    """
    configure(docs.sparkSession)
    lines = stored(line_rows(docs, key, text), "line-words", **COMPACT)
    n = F.size("words")
    places = lines.select("key", "line_no", n.alias("n"), "sid")
    first = F.min(F.struct("key", "line_no")).alias("first")
    sets = stored(places.filter("n > 0").groupBy("sid").agg(first), "line-sets")
    place = [F.col("first.key").alias("_k"), F.col("first.line_no").alias("_l")]
    at_first = (F.col("sid") == F.col("_sid")) & F.col("key").eqNullSafe(F.col("_k")) & (F.col("line_no") == F.col("_l"))
    # a set of fewer words than that is similar to nothing but itself
    least = next(n for n in range(1, 101) if 100 * n >= percent * (n + 1))
    ordered = lines.filter(n >= least).select("key", "line_no", "sid", n.alias("n"), in_order(F.col("words"), rarity(lines)).alias("ordered"),
                                              signature(F.col("words"), 0).alias("low"), signature(F.col("words"), 1).alias("high"), shares(F.col("words")).alias("shares"))
    prefix = F.slice("ordered", 1, F.col("n") - F.ceil(percent * F.col("n") / 100).cast("int") + 1)
    prefix = F.transform(prefix, lambda w: F.hash(w))  # 32 bits find candidates; whole words are compared later
    ordered = ordered.select("key", "line_no", "sid", "n", prefix.alias("prefix"), "low", "high", "shares")
    # of equal sets the one that stands first
    once = ordered.join(sets.select(F.col("sid").alias("_sid"), *place).hint("shuffle_hash"), at_first).select("sid", "n", "prefix", "low", "high", "shares", "_k", "_l")
    once = stored(once, "line-prefixes")
    # one similar line before a line is enough: near copies find theirs here, and are not paired with each other
    early = stored(gone_by(stored(earlier_sets(once, percent), "line-earlier"), lines, sets, percent), "line-early")
    once = once.join(early, F.col("sid") == F.col("_gone"), "left").select("sid", "n", "prefix", "low", "high", F.col("_gone").isNull().alias("open"))
    conf, option = docs.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(option)
    conf.set(option, "false")  # rows dealt by word serve the join on word and band
    try:
        pairs = stored(similar_sets(once, percent), "line-pairs")
    finally:
        conf.set(option, before)
    gone = early.union(gone_by(pairs, lines, sets, percent)).distinct()
    verdict = sets.join(gone, F.col("sid") == F.col("_gone"), "left").select(F.col("sid").alias("_s"), "first", F.col("_gone").isNotNull().alias("later"))
    verdict = stored(verdict, "line-verdicts")
    judged = places.join(verdict, F.col("sid") == F.col("_s"), "left")
    away = (F.col("n") > 0) & (F.col("later") | ~F.struct("key", "line_no").eqNullSafe(F.col("first")))
    out = judged.groupBy("key").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.when(away, F.col("line_no")))).alias("removed"))
    return out.withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with the repeated lines cut out of ``text``; a text that loses nothing is as it was."""
    name, removed = free_name(docs.columns, "of_key"), free_name(docs.columns, "removed_lines")
    gone = repeated_lines(docs, key, text, percent).filter(F.size("removed") > 0).select(F.col(f"`{key}`").alias(name), F.col("removed").alias(removed))
    out = docs.join(gone, F.col(f"`{key}`").eqNullSafe(F.col(name)), "left")
    kept = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda _, i: ~F.array_contains(removed, i))
    new = F.when(F.col(removed).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    return out.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
