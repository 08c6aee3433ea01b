"""Content ingest, taxonomy matching, cascade, exports and training examples."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.functions.textfns import content_summary, html_to_text
from sparkgauge.operators.joins import left_join_hot_right, skew_join
from sparkgauge.operators.positions import with_position
from sparkgauge.operators.postings import contained
from sparkgauge.operators.similarity import nearest, pair_scores, top1

THRESHOLD = 0.85  # fixed value: similarity needed to accept a match
LLM_THRESHOLD = 0.9  # fixed value: second-stage confidence needed

ITEM_JSON = (
    "id long, link string, slug string, author long, date_gmt string, title struct<rendered:string>,"
    "content struct<rendered:string>, excerpt struct<rendered:string>, categories array<long>, tags array<long>"
)

# ---- ingest


def normalize_content(raw: DataFrame, kind: str, site: str | Column, column: str = "raw") -> DataFrame:
    """JSON item text to content rows; text from the rendered HTML, bad dates become null."""
    item = raw.select("*", F.from_json(column, ITEM_JSON).alias("i"))
    none = F.lit("")
    return item.select(
        F.coalesce("i.link", none).alias("url"),
        html_to_text(F.coalesce("i.title.rendered", F.lit("Untitled"))).alias("title"),
        html_to_text(F.coalesce("i.content.rendered", none)).alias("content"),
        (F.lit(site) if isinstance(site, str) else site).alias("site_url"),
        F.try_to_timestamp("i.date_gmt").alias("published_date"),
        F.struct(
            F.lit(kind).alias("type"),
            F.col("i.id").alias("wp_id"),
            F.col("i.slug").alias("slug"),
            html_to_text(F.coalesce("i.excerpt.rendered", none)).alias("excerpt"),
            F.col("i.author").alias("author"),
            F.coalesce("i.categories", F.array().cast("array<long>")).alias("categories"),
            F.coalesce("i.tags", F.array().cast("array<long>")).alias("tags"),
        ).alias("metadata"),
    )


def all_content(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Posts and pages, tagged by type."""
    return posts.withColumn("type", F.lit("post")).unionByName(pages.withColumn("type", F.lit("page")))


def incremental_content(incoming: DataFrame, stored: DataFrame, since: datetime | None = None) -> DataFrame:
    """Items after ``since``, else after the newest stored date of their site; a site without
    stored dates takes everything."""
    if since is not None:
        return incoming.filter(F.col("published_date") > since)
    high = stored.groupBy("site_url").agg(F.max("published_date").alias("_high"))
    joined = incoming.join(high, "site_url", "left")
    return joined.filter(F.col("_high").isNull() | (F.col("published_date") > F.col("_high"))).select(*incoming.columns)


def ingestion_stats(**tables: DataFrame) -> DataFrame:
    """Row count per table, one row each."""
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


def content_by_site(content: DataFrame, site: str) -> DataFrame:
    return content.filter(F.col("site_url") == site)


def category_list(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("category").distinct()


# ---- matching; both sides are (id, vector)


def _matched(taxonomy: DataFrame, content: DataFrame, threshold: float, miss: str) -> DataFrame:
    best = top1(taxonomy, content)
    score = F.coalesce("score", F.lit(0.0))
    hit = score >= threshold
    kept = score if miss == "best" else F.when(hit, score).otherwise(0.0)
    return taxonomy.select(F.col("id").alias("taxonomy_id")).join(
        best, F.col("taxonomy_id") == F.col("left_id"), "left"
    ).select(
        "taxonomy_id",
        F.when(hit, F.col("right_id")).alias("content_id"),
        kept.alias("similarity_score"),
        F.when(hit, "semantic_matched").otherwise("needs_human_review").alias("match_stage"),
    )


def best_match(taxonomy: DataFrame, content: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Best content per taxonomy row; a miss keeps its best score and no content."""
    return _matched(taxonomy, content, threshold, "best")


def match_all(taxonomy: DataFrame, content: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """As ``best_match``, but a miss stores score 0."""
    return _matched(taxonomy, content, threshold, "zero")


def find_best_match(taxonomy: DataFrame, content: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Only the accepted best matches."""
    return best_match(taxonomy, content, threshold).filter(F.col("content_id").isNotNull()).drop("match_stage")


def rank_matches(taxonomy: DataFrame, content: DataFrame, k: int | None = None) -> DataFrame:
    """All content rows of each taxonomy row, or its ``k`` best, by falling score (``rank`` from 1).

    A full ranking has a row for every pair, those without a score last. One taxonomy row may
    own a huge list, so its ranks are positions in sorted partitions, not a window over the list.
    """
    if k is None:
        pairs = pair_scores(None, taxonomy, content)
        ranked = with_position(pairs, ["left_id"], [F.col("score").desc_nulls_last(), F.col("right_id").asc_nulls_last()])
        ranked = ranked.withColumn("rank", F.col("position") + 1)
    else:
        ranked = nearest(taxonomy, content, k)
    return ranked.select(F.col("left_id").alias("taxonomy_id"), F.col("right_id").alias("content_id"), "score", F.col("rank").cast("long").alias("rank"))


def unmatched_taxonomy(taxonomy: DataFrame, matchings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Taxonomy without a row, with null content, or below the threshold, by its best row.

    The reference builds its lookup so that the lowest row of a taxonomy wins; the best
    row is what its callers mean.
    """
    best = matchings.groupBy(F.col("taxonomy_id").alias("id")).agg(
        F.max_by(F.struct("content_id", "similarity_score"), F.struct("similarity_score", "id")).alias("_m")
    )
    joined = taxonomy.join(best, "id", "left")
    bad = F.col("_m.content_id").isNull() | (F.col("_m.similarity_score") < threshold)
    return joined.filter(bad).select(*taxonomy.columns)


def matchings_ranked(matchings: DataFrame, taxonomy_id: str | None = None) -> DataFrame:
    kept = matchings.filter(F.col("taxonomy_id") == taxonomy_id) if taxonomy_id is not None else matchings
    return kept.orderBy(F.col("similarity_score").desc(), "id")


def cascade(
    matchings: DataFrame,
    second_stage: DataFrame,
    semantic: bool = True,
    llm: bool = True,
    threshold: float = THRESHOLD,
    min_confidence: float = LLM_THRESHOLD,
) -> DataFrame:
    """Stage outcome per taxonomy row. Second-stage results come as a table
    (taxonomy_id, confidence); the model call that makes them is not part of this."""
    accepted = F.lit(semantic) & F.col("content_id").isNotNull() & (F.col("similarity_score") >= threshold)
    scores = second_stage.select("taxonomy_id", "confidence")
    outcome = (
        F.when(F.lit(not (semantic or llm)), "skipped")
        .when(accepted, "semantic_matched")
        .when(F.lit(llm) & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence), "llm_categorized")
        .otherwise("needs_review")
    )
    return matchings.join(scores, "taxonomy_id", "left").select("taxonomy_id", outcome.alias("outcome"))


def cascade_stats(outcomes: DataFrame) -> DataFrame:
    """Counts of this run only; the reference mixes in unmatched rows of other runs."""
    names = ["semantic_matched", "llm_categorized", "needs_review", "skipped"]
    return outcomes.agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


# ---- exports


def export_view(taxonomy: DataFrame, matchings: DataFrame, content: DataFrame, cats: DataFrame) -> DataFrame:
    """Taxonomy with all its matchings, content and categorizations (fans out).

    Contents that very many matchings name are cut into parts, and matchings without a
    content stay out of both joins.
    """
    m = matchings.select("taxonomy_id", "content_id", "similarity_score")
    c = content.select(F.col("id").alias("content_id"), F.col("url").alias("_target"))
    k = cats.select("content_id", "confidence")
    tax = taxonomy.select(F.col("id").alias("taxonomy_id"), F.col("url").alias("source_url"), "category")
    listed = skew_join(left_join_hot_right(tax, m, ["taxonomy_id"]), c, ["content_id"], "left")
    return (
        skew_join(listed, k, ["content_id"], "left")
        .orderBy("category", F.col("similarity_score").desc_nulls_last(), "source_url", "_target", "confidence")
        .select(
            "source_url",
            F.coalesce("_target", F.lit("")).alias("target_url"),
            F.coalesce("similarity_score", F.lit(0.0)).alias("similarity_score"),
            "category",
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        )
    )


def best_match_export(taxonomy: DataFrame, matchings: DataFrame, content: DataFrame, cats: DataFrame) -> DataFrame:
    """One row per taxonomy: its best matching (score at least 0), target, stage fields and
    the confidence of the earliest categorization of the content.

    Matchings and categorizations collapse to one row per key before the joins.
    """
    picked = F.struct("content_id", "similarity_score", "match_stage", "failed_at_stage")
    best = (
        matchings.filter(F.col("similarity_score") >= 0)
        .groupBy("taxonomy_id")
        .agg(F.min_by(picked, F.struct((-F.col("similarity_score")).alias("s"), "id")).alias("m"))
        .select("taxonomy_id", "m.*")
    )
    first = cats.groupBy("content_id").agg(F.min_by("confidence", F.struct("created_ms", "id")).alias("confidence"))
    c = content.select(F.col("id").alias("content_id"), F.col("url").alias("_target"))
    named = taxonomy.select(F.col("id").alias("taxonomy_id"), F.col("url").alias("source_url"), "category")
    found = skew_join(skew_join(named.join(best, "taxonomy_id", "left"), c, ["content_id"], "left"), first, ["content_id"], "left")
    return (
        found
        .select(
            "source_url",
            F.coalesce("_target", F.lit("")).alias("target_url"),
            "category",
            F.coalesce("similarity_score", F.lit(0.0)).alias("similarity_score"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            "match_stage",
            "failed_at_stage",
        )
    )


# ---- training examples


def content_summaries(content: DataFrame, preview: int | None = None) -> DataFrame:
    """Numbered summaries in id order: (content_id, index, summary); ``preview`` limits the text shown."""
    short = content.select("id", "title", "url", _head(F.col("content"), preview).alias("content"))
    placed = with_position(short, [], [F.col("id")])
    text = content_summary(F.col("position"), F.col("title"), F.col("url"), F.col("content"))
    return placed.select(F.col("id").alias("content_id"), F.col("position").alias("index"), text.alias("summary"))


def training_examples(matchings: DataFrame, taxonomy: DataFrame, content: DataFrame) -> DataFrame:
    """Accepted matchings with their taxonomy and the index of the matched content.

    The index points into ``content_summaries``. The reference copies that whole list into
    every example; here the list is one table that all examples share.
    """
    accepted = matchings.filter(
        F.col("content_id").isNotNull() & F.col("match_stage").isin("llm_categorized", "semantic_matched")
    )
    listed = F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).otherwise("None")
    tax = taxonomy.select(
        F.col("id").alias("taxonomy_id"),
        F.col("category").alias("taxonomy_category"),
        F.col("description").alias("taxonomy_description"),
        listed.alias("taxonomy_keywords"),
    )
    index = with_position(content.select("id"), [], [F.col("id")]).select(
        F.col("id").alias("content_id"), F.col("position").alias("best_match_index")
    )
    return (
        accepted.join(tax, "taxonomy_id")
        .join(index, "content_id")
        .select(
            F.col("id").alias("matching_id"),
            "taxonomy_category",
            "taxonomy_description",
            "taxonomy_keywords",
            "best_match_index",
            F.col("similarity_score").alias("confidence"),
            F.lit("").alias("reasoning"),
        )
    )


def positional_split(examples: DataFrame, order: Sequence[Column], ratio: float = 0.8) -> DataFrame:
    """Mark the first floor(n * ratio) rows ``train``, the rest ``validation``."""
    placed = with_position(examples, [], order)
    train = F.col("position") < F.floor(F.col("total") * ratio)
    return placed.select(*examples.columns, F.when(train, "train").otherwise("validation").alias("split"))


def _head(text: Column, head: int | None) -> Column:
    """The first ``head`` characters, or the whole text."""
    return text if head is None else F.substring(text, 1, head)


def keyword_best_candidate(taxonomy: DataFrame, content: DataFrame, head: int | None = None) -> DataFrame:
    """Best content per category (taxonomy_id, content_id, score); the first best (lowest id) wins.

    A content scores 2 for the category in its title or body, 1 per keyword in the title
    and 0.5 per keyword in the body, in any case; ``head`` limits the body to its first
    characters. Words are found through postings. Content rows that hold the same words
    in the same places score alike everywhere, so the lowest id of each such profile
    stands for all; a category then meets profiles, not rows.
    """
    lowered = lambda c: F.coalesce(F.lower(c), F.lit(""))
    listed = F.transform("keywords", lambda k: F.struct(F.lower(k).alias("word"), F.lit(0).alias("main"), F.lit(1).alias("key")))
    main = F.array(F.struct(F.lower("category").alias("word"), F.lit(1).alias("main"), F.lit(0).alias("key")))
    words = taxonomy.select(F.col("id").alias("taxonomy_id"), F.inline(F.concat(main, F.coalesce(listed, F.filter(main, lambda x: F.lit(False))))))
    words = words.filter("word is not null").groupBy("taxonomy_id", "word").agg(F.max("main").alias("main"), F.sum("key").alias("key"))
    texts = content.select(F.col("id").alias("content_id"), lowered("title").alias("title"), _head(lowered("content"), head).alias("body"))
    literals = words.select(F.col("word").alias("literal")).distinct()
    # one search for titles (part 1) and bodies (part 2)
    parts = F.inline(F.array(F.struct(F.lit(1).alias("part"), F.col("title").alias("text")), F.struct(F.lit(2).alias("part"), F.col("body").alias("text"))))
    sides = texts.select("content_id", parts).select(F.struct("content_id", "part").alias("key"), "text")
    held = contained(sides, literals).select(F.col("key.content_id").alias("key"), F.col("key.part").alias("part"), "literal")
    # which words a content holds, and whether in the title (1), the body (2) or both (3)
    places = held.groupBy("key", "literal").agg(F.sum("part").alias("part"))
    profiles = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("literal", "part"))).alias("profile"))
    profiles = profiles.groupBy("profile").agg(F.min("key").alias("content_id"))
    spread = profiles.select("content_id", F.inline("profile"))
    title, body = F.col("part") != 2, F.col("part") != 1
    points = F.col("main") * 2.0 + F.col("key") * (F.when(title, 1.0).otherwise(0.0) + F.when(body, 0.5).otherwise(0.0))
    scored = spread.join(words, F.col("literal") == F.col("word")).groupBy("taxonomy_id", "content_id").agg(F.sum(points).alias("score"))
    best = Window.partitionBy("taxonomy_id").orderBy(F.col("score").desc(), "content_id")
    scored = scored.withColumn("_place", F.row_number().over(best)).filter("_place = 1").drop("_place")
    # a word without letters is in every text; a category none of whose words is found takes the first content
    free = words.filter("word = ''").select(F.col("taxonomy_id").alias("_free"), (F.col("main") * 2.0 + F.col("key") * 1.5).alias("_more"))
    first = content.agg(F.min("id")).collect()[0][0]  # one value
    named = taxonomy.select(F.col("id").alias("taxonomy_id"))
    joined = named.join(scored, "taxonomy_id", "left").join(free, F.col("taxonomy_id") == F.col("_free"), "left")
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce("_more", F.lit(0.0))
    found = joined.select("taxonomy_id", F.coalesce("content_id", F.lit(first)).alias("content_id"), score.alias("score"))
    return found.filter(F.col("content_id").isNotNull())


def build_dataset(taxonomy: DataFrame, content: DataFrame, n: int, seed: int = 7, head: int | None = None, preview: int | None = None) -> DataFrame:
    """``n`` examples spread over the categories (the remainder to the first ones), each with
    5 to 10 distinct candidates drawn by seeded hash, and its best candidate index.

    Slot ``k`` of an example takes the content at ``start + k * step``, both hashed, with a
    step of at most a tenth of the list, so slots never collide; the draw is a join on
    positions, linear in examples. ``head`` limits the body that is scored and ``preview``
    the body that is shown to their first characters. Under ten content rows is an error.
    """
    cats = with_position(taxonomy.select("id", "category", "description", "keywords"), [], [F.col("id")])
    share = F.floor(F.lit(n) / F.col("total")) + F.when(F.col("position") < F.lit(n) % F.col("total"), 1).otherwise(0)
    examples = cats.withColumn("_n", share.cast("long")).filter("_n > 0")
    examples = examples.select(
        F.col("id").alias("taxonomy_id"),
        "category",
        "description",
        "keywords",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("example"),
    )
    placed = with_position(content.select(F.col("id").alias("_cid")), [], [F.col("_cid")])
    total = placed.count()
    if total < 10:
        raise ValueError("at least 10 content rows are needed")

    def draw(salt: str, below: int) -> Column:
        return F.pmod(F.xxhash64("taxonomy_id", "example", F.lit(f"{salt}{seed}")), F.lit(below))

    slot_count = (draw("n", 6) + 5).cast("int")
    slots = examples.withColumn("slot", F.explode(F.sequence(F.lit(1), slot_count)))
    step = draw("step", total // 10) + 1
    slots = slots.withColumn("pick", F.pmod(draw("start", total) + F.col("slot") * step, F.lit(total)))
    chosen = slots.join(placed.select("_cid", "position"), F.col("pick") == F.col("position"))
    texts = content.select("id", "title", "url", "content")
    filled = chosen.join(texts, F.col("_cid") == F.col("id"))
    title, body = F.lower("title"), _head(F.lower("content"), head)
    category = F.lower("category")
    base = F.when(F.contains(title, category) | F.contains(body, category), 2.0).otherwise(0.0)
    words = F.aggregate(
        "keywords",
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(F.contains(title, F.lower(k)), 1.0).otherwise(0.0)
        + F.when(F.contains(body, F.lower(k)), 0.5).otherwise(0.0),
    )
    scored = filled.withColumn("score", base + words).withColumn("content", _head(F.col("content"), preview))
    # at most ten candidates per example, by construction
    items = F.array_sort(F.collect_list(F.struct("slot", "id", "title", "url", "content", "score")))
    grouped = scored.groupBy("taxonomy_id", "example").agg(
        F.first("category").alias("taxonomy_category"),
        F.first("description").alias("taxonomy_description"),
        F.first("keywords").alias("_keywords"),
        items.alias("_items"),
    )
    top = F.array_max(F.transform("_items", lambda x: x["score"]))
    index = F.array_position(F.transform("_items", lambda x: x["score"]), top) - 1
    summaries = F.transform(
        "_items", lambda x, i: content_summary(i, x["title"], x["url"], F.regexp_replace(x["content"], "\n", " "))
    )
    return grouped.select(
        "taxonomy_id",
        "example",
        "taxonomy_category",
        "taxonomy_description",
        F.array_join("_keywords", ", ").alias("taxonomy_keywords"),
        F.transform("_items", lambda x: x["id"]).alias("candidates"),
        F.array_join(summaries, "\n\n").alias("content_summaries"),
        index.alias("best_match_index"),
    )


# ---- lookups


def lookup_in(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the list; an empty list gives nothing."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def missing_urls(urls: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Requested urls the taxonomy does not know."""
    return urls.select("url").distinct().join(taxonomy.select("url"), "url", "left_anti")


def rerun_targets(
    taxonomy: DataFrame,
    ids: DataFrame | None = None,
    urls: DataFrame | None = None,
    only_unmatched: bool = False,
    matchings: DataFrame | None = None,
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, DataFrame | None]:
    """(taxonomy to run again, unknown urls or None). At most one selector."""
    if sum([ids is not None, urls is not None, only_unmatched]) > 1:
        raise ValueError("give at most one of ids, urls and only_unmatched")
    if ids is not None:
        return lookup_in(taxonomy, ids, "id"), None
    if urls is not None:
        return lookup_in(taxonomy, urls, "url"), missing_urls(urls, taxonomy)
    if only_unmatched:
        return unmatched_taxonomy(taxonomy, matchings, threshold), None
    return taxonomy, None
