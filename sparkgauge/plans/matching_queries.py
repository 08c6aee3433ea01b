"""Matching, ingest, source and table-work queries and their oracle texts."""

from pyspark.sql import functions as F

from sparkgauge.functions.textfns import content_text, html_to_text, taxonomy_text
from sparkgauge.functions.timefns import coerce_timestamp
from sparkgauge.operators import matching as m
from sparkgauge.operators.similarity import pair_scores
from sparkgauge.plans.registry import query
from sparkgauge.session import scratch_path
from sparkgauge.sources import files as f
from sparkgauge.sources import tablework as w

# ---- shared inputs

BARE = ("regexp_replace(regexp_replace(regexp_replace({0}, '(?s)<script[^>]*>.*?</script>', '', 'g'), "
        "'(?s)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')")
# a standard entity table also reads an ampersand entity without its semicolon
ENTITIES = "regexp_replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
TEXT = "trim(regexp_replace(" + ENTITIES.format(BARE) + ", '\\s+', ' ', 'g'))"
KEYWORDS = "SELECT source AS id, list_sort(list_distinct(list(lang))) AS keywords FROM documents GROUP BY 1"


def taxonomy(t):
    words = t.documents.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("lang")).alias("keywords"))
    return t.taxonomy.join(words, "id")


def content(t):
    return t.content.withColumn("content", html_to_text(F.col("html"))).withColumn("title", html_to_text(F.col("title")))


def centroids(t):
    """One mean vector per label: the taxonomy side of the vector matching."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("p", "v"))
    means = parts.groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("a"))
    vectors = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "a"))).alias("s"))
    return vectors.select(F.col("label").cast("long").alias("id"), F.col("s.a").alias("vector"))


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


SCORES = """tv AS (SELECT label AS id, list(a ORDER BY p) AS vec FROM (SELECT label, p, avg(v::DOUBLE) AS a FROM
   (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
  sc AS (SELECT CAST(tv.id AS BIGINT) AS taxonomy_id, vec_id AS content_id,
    (list_cosine_similarity(vec, embedding::DOUBLE[]) + 1) / 2 AS score FROM tv, embeddings),
  rk AS (SELECT *, row_number() OVER (PARTITION BY taxonomy_id ORDER BY score DESC, content_id) AS rank FROM sc)"""
THR = 0.72


# ---- vector matching


@query("best_match", f"WITH {SCORES} SELECT taxonomy_id, CASE WHEN score >= {THR} THEN content_id END AS content_id, round(score, 6) AS similarity_score, "
       f"CASE WHEN score >= {THR} THEN 'semantic_matched' ELSE 'needs_human_review' END AS match_stage FROM rk WHERE rank = 1")
def _(t):
    out = m.best_match(centroids(t), vectors(t), THR)
    return out.withColumn("similarity_score", F.round("similarity_score", 6))


@query("match_all", f"WITH {SCORES} SELECT taxonomy_id, CASE WHEN score >= {THR} THEN content_id END AS content_id, "
       f"CASE WHEN score >= {THR} THEN round(score, 6) ELSE 0.0::DOUBLE END AS similarity_score FROM rk WHERE rank = 1")
def _(t):
    out = m.match_all(centroids(t), vectors(t), THR).drop("match_stage")
    return out.withColumn("similarity_score", F.round("similarity_score", 6))


@query("find_best_match", f"WITH {SCORES} SELECT taxonomy_id, content_id, round(score, 6) AS similarity_score FROM rk WHERE rank = 1 AND score >= {THR}")
def _(t):
    return m.find_best_match(centroids(t), vectors(t), THR).withColumn("similarity_score", F.round("similarity_score", 6))


@query("rank_matches", f"WITH {SCORES} SELECT taxonomy_id, content_id, round(score, 6) AS score, rank FROM rk")
def _(t):
    return m.rank_matches(centroids(t), vectors(t)).withColumn("score", F.round("score", 6))


@query("best_match_text_ids", f"WITH {SCORES} SELECT md5('t' || taxonomy_id) AS taxonomy_id, CASE WHEN score >= {THR} THEN md5('c' || content_id) END AS content_id, "
       "round(score, 6) AS similarity_score FROM rk WHERE rank = 1")
def _(t):
    def hashed(letter, df):
        return df.withColumn("id", F.md5(F.concat(F.lit(letter), F.col("id").cast("string"))))

    out = m.best_match(hashed("t", centroids(t)), hashed("c", vectors(t)), THR).drop("match_stage")
    return out.withColumn("similarity_score", F.round("similarity_score", 6))


@query("cosine01", f"WITH {SCORES} SELECT taxonomy_id AS left_id, content_id AS right_id, round(score, 6) AS score FROM sc")
def _(t):
    return pair_scores(None, centroids(t), vectors(t)).withColumn("score", F.round("score", 6))


@query("unmatched_taxonomy", """SELECT v_taxonomy.id AS id, url FROM v_taxonomy LEFT JOIN (SELECT * FROM v_matchings
   QUALIFY row_number() OVER (PARTITION BY taxonomy_id ORDER BY similarity_score DESC, id DESC) = 1) b ON v_taxonomy.id = b.taxonomy_id
   WHERE b.content_id IS NULL OR b.similarity_score < 0.96""")
def _(t):
    return m.unmatched_taxonomy(t.taxonomy, t.matchings, 0.96).select("id", "url")


@query("matchings_ranked", "SELECT id, similarity_score FROM v_matchings WHERE taxonomy_id = 'src4'")
def _(t):
    return m.matchings_ranked(t.matchings, "src4").select("id", "similarity_score")


def _second_stage(t):
    return t.taxonomy.select(F.col("id").alias("taxonomy_id"), ((F.col("first_doc") * 7 % 10) / 10.0).alias("confidence"))


@query("cascade_stats", """WITH b AS (SELECT * FROM v_matchings QUALIFY row_number() OVER (PARTITION BY taxonomy_id ORDER BY similarity_score DESC, id) = 1),
  o AS (SELECT CASE WHEN b.content_id IS NOT NULL AND b.similarity_score >= 0.96 THEN 1 WHEN (first_doc * 7 % 10) / 10.0 >= 0.5 THEN 2 ELSE 3 END AS k
    FROM b JOIN v_taxonomy t ON b.taxonomy_id = t.id)
  SELECT count(*) FILTER (k = 1) AS semantic_matched, count(*) FILTER (k = 2) AS llm_categorized, count(*) FILTER (k = 3) AS needs_review,
    CAST(0 AS BIGINT) AS skipped FROM o""")
def _(t):
    top = F.max_by(F.struct("content_id", "similarity_score"), F.struct("similarity_score", -F.col("id")))
    best = t.matchings.groupBy("taxonomy_id").agg(top.alias("b")).select("taxonomy_id", "b.*")
    return m.cascade_stats(m.cascade(best, _second_stage(t), threshold=0.96, min_confidence=0.5))


# ---- exports


@query("export_view", """SELECT t.url AS source_url, coalesce(c.url, '') AS target_url, coalesce(m.similarity_score, 0) AS similarity_score, t.category,
  coalesce(k.confidence, 0) AS confidence FROM v_taxonomy t LEFT JOIN v_matchings m ON t.id = m.taxonomy_id LEFT JOIN v_content c ON m.content_id = c.id
  LEFT JOIN v_cats k ON c.id = k.content_id""")
def _(t):
    return m.export_view(t.taxonomy, t.matchings, t.content, t.cats)


BEST_EXPORT = """SELECT t.url AS source_url, coalesce(c.url, '') AS target_url, t.category, coalesce(m.similarity_score, 0) AS similarity_score,
  coalesce(k.confidence, 0) AS confidence, match_stage, failed_at_stage FROM v_taxonomy t LEFT JOIN (SELECT * FROM v_matchings WHERE similarity_score >= 0
    QUALIFY row_number() OVER (PARTITION BY taxonomy_id ORDER BY similarity_score DESC, id) = 1) m ON t.id = m.taxonomy_id
  LEFT JOIN v_content c ON m.content_id = c.id LEFT JOIN (SELECT * FROM v_cats
    QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY created_ms, id) = 1) k ON m.content_id = k.content_id"""


def best_export(t):
    return m.best_match_export(t.taxonomy, t.matchings, t.content, t.cats)


@query("best_match_export", BEST_EXPORT)
def _(t):
    return best_export(t)


@query("export_matches_csv", f"""SELECT source_url, target_url, category, printf('%.4f', similarity_score) AS similarity_score, printf('%.4f', confidence) AS confidence,
  coalesce(match_stage, '') AS match_stage, coalesce(failed_at_stage, '') AS failed_at_stage FROM ({BEST_EXPORT}) WHERE target_url <> '' AND similarity_score >= 0.95""")
def _(t):
    path = scratch_path(t.spark, "matches")
    f.write_csv(f.export_rows(best_export(t), False, 0.95), path)
    back = t.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.na.fill("")


LOW = BEST_EXPORT.replace("FROM v_matchings WHERE", "FROM (SELECT * REPLACE (CASE WHEN similarity_score < 0.97 THEN content_id END AS content_id) FROM v_matchings) WHERE")


@query("export_unmatched", f"SELECT source_url, category FROM ({LOW}) WHERE target_url = ''")
def _(t):
    low = t.matchings.withColumn("content_id", F.when(F.col("similarity_score") < 0.97, F.col("content_id")))
    return f.export_unmatched(m.best_match_export(t.taxonomy, low, t.content, t.cats))


# ---- ingest


def item_json(t):
    """Site API items as JSON text, one per page."""
    i = F.col("page_id")
    body = F.struct(
        i.alias("id"),
        F.col("url").alias("link"),
        F.concat(F.lit("p-"), i).alias("slug"),
        (i % 9).alias("author"),
        F.when(i % 5 != 0, F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00")))
        .when(i % 10 == 0, F.lit("not a date"))
        .alias("date_gmt"),
        F.when(i % 4 != 0, F.struct(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("rendered"))).alias("title"),
        F.struct(F.col("html").alias("rendered")).alias("content"),
        F.when(i % 3 != 0, F.array(i % 4)).alias("categories"),
    )
    return t.pages.select(F.to_json(body).alias("raw"), F.regexp_extract("url", "https?://([^/?#]+)", 1).alias("site"))


@query("normalize_content", f"""SELECT url, CASE WHEN page_id % 4 <> 0 THEN {TEXT.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} ELSE 'Untitled' END AS title,
  {TEXT.format('html')} AS content, CASE WHEN page_id % 5 <> 0 THEN epoch_ms(make_timestamp(2024, 1, page_id % 28 + 1, 10, 0, 0)) END AS published_ms,
  page_id AS wp_id, 'p-' || page_id AS slug, CASE WHEN page_id % 3 <> 0 THEN 1 ELSE 0 END AS n_categories FROM pages""")
def _(t):
    out = m.normalize_content(item_json(t), "post", F.col("site"))
    return out.select(
        "url", "title", "content", F.unix_millis("published_date").alias("published_ms"),
        "metadata.wp_id", "metadata.slug", F.size("metadata.categories").alias("n_categories"),
    )


@query("html_to_text", f"SELECT page_id, {TEXT.format('html')} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", html_to_text(F.col("html")).alias("text"))


@query("all_content", "SELECT id, CASE WHEN url LIKE '%/en/%' THEN 'page' ELSE 'post' END AS type FROM v_content")
def _(t):
    posts, pages = t.content.filter("url NOT LIKE '%/en/%'"), t.content.filter("url LIKE '%/en/%'")
    return m.all_content(posts, pages).select("id", "type")


@query("incremental_content", """WITH s AS (SELECT site_url, max(published_date) AS high FROM v_content WHERE published_date < TIMESTAMP '2024-01-20' GROUP BY 1)
  SELECT id, site_url FROM v_content LEFT JOIN s USING (site_url) WHERE high IS NULL OR published_date > high""")
def _(t):
    stored = t.content.filter("published_date < TIMESTAMP '2024-01-20'")
    return m.incremental_content(t.content, stored).select("id", "site_url")


@query("content_by_site", "SELECT id, url FROM v_content WHERE site_url = 'therha.example.com'")
def _(t):
    return m.content_by_site(t.content, "therha.example.com").select("id", "url")


@query("ingestion_stats", "SELECT 'taxonomy' AS name, count(*) AS n FROM v_taxonomy UNION ALL SELECT 'content', count(*) FROM v_content "
       "UNION ALL SELECT 'matchings', count(*) FROM v_matchings")
def _(t):
    return m.ingestion_stats(taxonomy=t.taxonomy, content=t.content, matchings=t.matchings)


@query("category_list", "SELECT DISTINCT category FROM v_taxonomy")
def _(t):
    return m.category_list(t.taxonomy)


TAX_TEXT = "'Category: ' || category || chr(10) || 'Description: ' || description || chr(10) || 'Keywords: ' || array_to_string(keywords, ', ')"


@query("taxonomy_text", f"SELECT v_taxonomy.id AS id, {TAX_TEXT} AS text FROM v_taxonomy JOIN ({KEYWORDS}) k ON k.id = v_taxonomy.id")
def _(t):
    return taxonomy(t).select("id", taxonomy_text(F.col("category"), F.col("description"), F.col("keywords")).alias("text"))


CT = f"SELECT id, url, {TEXT.format('title')} AS title, {TEXT.format('html')} AS content FROM v_content"


@query("content_text", f"SELECT id, 'Title: ' || title || chr(10) || chr(10) || 'Content: ' || content AS text FROM ({CT})")
def _(t):
    return content(t).select("id", content_text(F.col("title"), F.col("content")).alias("text"))


SUMMARY = "CAST({0} AS STRING) || '. Title: ' || title || chr(10) || '   URL: ' || url || chr(10) || '   Preview: ' || content || '...'"


@query("content_summaries", f"SELECT id AS content_id, i AS index, {SUMMARY.format('i')} AS summary FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM ({CT}))")
def _(t):
    return m.content_summaries(content(t))


@query("training_examples", f"""SELECT m.id AS matching_id, t.category AS taxonomy_category, array_to_string(keywords, ', ') AS taxonomy_keywords, i AS best_match_index, similarity_score AS confidence
  FROM v_matchings m JOIN v_taxonomy t ON m.taxonomy_id = t.id JOIN ({KEYWORDS}) k ON k.id = t.id
  JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v_content) c ON m.content_id = c.id
  WHERE match_stage IN ('llm_categorized', 'semantic_matched')""")
def _(t):
    out = m.training_examples(t.matchings, taxonomy(t), t.content)
    return out.select("matching_id", "taxonomy_category", "taxonomy_keywords", "best_match_index", "confidence")


@query("positional_split", "SELECT id, CASE WHEN row_number() OVER (ORDER BY created_ms, id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'validation' END AS split FROM v_matchings")
def _(t):
    return m.positional_split(t.matchings, [F.col("created_ms"), F.col("id")], 0.8).select("id", "split")


@query("keyword_best_candidate", f"""WITH c AS ({CT}), x AS (SELECT t.id AS taxonomy_id, c.id AS content_id,
   CASE WHEN contains(lower(title), category) OR contains(lower(content), category) THEN 2.0 ELSE 0.0 END
   + list_sum(list_transform(keywords, lambda k: CASE WHEN contains(lower(title), k) THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(content), k) THEN 0.5 ELSE 0.0 END)) AS score
   FROM v_taxonomy t JOIN ({KEYWORDS}) k ON k.id = t.id, c)
  SELECT taxonomy_id, content_id, CAST(score AS DOUBLE) AS score FROM x QUALIFY row_number() OVER (PARTITION BY taxonomy_id ORDER BY score DESC, content_id) = 1""")
def _(t):
    path = scratch_path(t.spark, "content")  # plain text, as a content table has it
    content(t).select("id", "title", "content").write.parquet(path)
    return m.keyword_best_candidate(taxonomy(t), t.spark.read.parquet(path))


@query("build_dataset")
def _(t):
    return m.build_dataset(taxonomy(t), content(t), 250)


@query("build_dataset_spread", """SELECT id AS taxonomy_id, CAST(250 // n + CASE WHEN i < 250 % n THEN 1 ELSE 0 END AS BIGINT) AS examples
  FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM v_taxonomy)""")
def _(t):
    made = m.build_dataset(taxonomy(t), content(t), 250)
    return made.groupBy("taxonomy_id").agg(F.count("*").alias("examples"))


@query("lookup_in", "SELECT id, url FROM v_taxonomy WHERE id IN (SELECT test_id FROM v_artifacts WHERE size > 20000)")
def _(t):
    return m.lookup_in(t.taxonomy, t.artifacts.filter("size > 20000").select(F.col("test_id").alias("id")), "id").select("id", "url")


WANTED = "SELECT CASE WHEN page_id % 2 = 0 THEN 'https://tax.example/src' || page_id ELSE url END AS url FROM pages"


def wanted_urls(t):
    even = F.concat(F.lit("https://tax.example/src"), "page_id")
    return t.pages.select(F.when(F.col("page_id") % 2 == 0, even).otherwise(F.col("url")).alias("url"))


@query("missing_urls", f"SELECT DISTINCT url FROM ({WANTED}) WHERE url NOT IN (SELECT url FROM v_taxonomy)")
def _(t):
    return m.missing_urls(wanted_urls(t), t.taxonomy)


@query("rerun_targets", f"SELECT 'run' AS kind, url FROM v_taxonomy WHERE url IN ({WANTED}) UNION ALL SELECT DISTINCT 'missing', url FROM ({WANTED}) WHERE url NOT IN (SELECT url FROM v_taxonomy)")
def _(t):
    run, missing = m.rerun_targets(t.taxonomy, urls=wanted_urls(t))
    return run.select(F.lit("run").alias("kind"), "url").unionByName(missing.select(F.lit("missing").alias("kind"), "url"))


# ---- sources


@query("load_taxonomy", f"SELECT url, category, description, array_to_string(keywords, '|') AS keywords FROM v_taxonomy JOIN ({KEYWORDS}) k ON k.id = v_taxonomy.id")
def _(t):
    path = scratch_path(t.spark, "taxonomy")
    words = F.concat(F.lit(" "), F.array_join("keywords", " ; "), F.lit(";;"))
    good = taxonomy(t).select("url", "category", "description", words.alias("keywords"))
    bad = t.benchmark.select(F.lit("no url").alias("url"), F.col("text").alias("category"), F.lit("").alias("description"), F.lit("").alias("keywords"))
    f.write_csv(good.unionByName(bad), path)
    loaded, _ = f.load_taxonomy(t.spark, path)
    return loaded.withColumn("keywords", F.array_join("keywords", "|"))


@query("url_list", "SELECT trim(url) AS url FROM pages")
def _(t):
    path = scratch_path(t.spark, "urls")
    padded = t.pages.select(F.concat(F.lit("  "), "url", F.lit(" ")).alias("url"), "page_id")
    f.write_csv(padded.unionByName(t.benchmark.select(F.lit("  ").alias("url"), F.col("item_id").alias("page_id"))), path)
    return f.url_list(t.spark, path)


@query("load_examples", "SELECT source AS taxonomy_category, text AS content_summaries, CAST(doc_id AS INT) AS best_match_index, "
       "CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE (doc_id % 10) / 10.0::DOUBLE END AS confidence FROM documents WHERE lang <> 'fr'")
def _(t):
    path = scratch_path(t.spark, "examples")
    i = F.col("doc_id")
    rows = t.documents.select(
        F.col("source").alias("taxonomy_category"), F.col("lang").alias("taxonomy_description"), F.lit("k").alias("taxonomy_keywords"),
        F.col("text").alias("content_summaries"), F.when(F.col("lang") == "fr", "first").otherwise(i.cast("string")).alias("best_match_index"),
        F.when(i % 3 != 0, ((i % 10) / 10.0).cast("string")).alias("confidence"), F.lit("because").alias("reasoning"),
    )
    f.save_dataset_csv(rows, path)
    return f.load_examples(t.spark, path, multi_line=True).select("taxonomy_category", "content_summaries", "best_match_index", "confidence")


@query("save_dataset_csv", "SELECT source AS taxonomy_category, text AS content_summaries, CAST(doc_id AS STRING) AS best_match_index FROM documents")
def _(t):
    path = scratch_path(t.spark, "dataset")
    rows = t.documents.select(
        F.col("source").alias("taxonomy_category"), F.col("lang").alias("taxonomy_description"), F.lit("k").alias("taxonomy_keywords"),
        F.col("text").alias("content_summaries"), F.col("doc_id").alias("best_match_index"), F.lit(0.5).alias("confidence"), F.lit("").alias("reasoning"),
    )
    f.save_dataset_csv(rows, path)
    back = t.spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("taxonomy_category", "content_summaries", "best_match_index")


@query("parse_batch_results", "SELECT CAST(doc_id AS STRING) AS content_id, category, confidence, 'b1' AS batch_id FROM "
       "(SELECT id AS doc_id, category, confidence FROM v_cats) WHERE confidence NOT IN (0.25, 0.75)")
def _(t):
    i = F.col("id")
    answer = F.to_json(F.struct("category", F.when(F.col("confidence") == 0.75, 1.5).otherwise(F.col("confidence")).alias("confidence")))
    choice = F.struct(F.struct(F.when(F.col("confidence") == 0.25, "{broken").otherwise(answer).alias("content")).alias("message"))
    line = F.struct(i.cast("string").alias("custom_id"), F.struct(F.struct(F.array(choice).alias("choices")).alias("body")).alias("response"))
    kept, _ = f.parse_batch_results(t.cats.select(F.to_json(line).alias("value")), "b1")
    return kept


PATHS = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/' || source || '/f' || doc_id || '.py' WHEN 1 THEN 'node_modules/' || doc_id || '.js'
   WHEN 2 THEN 'docs/' || doc_id || '.md' WHEN 3 THEN 'bin/' || doc_id || '.exe' WHEN 4 THEN 'a/dist/' || doc_id || '.ts' ELSE 'lib/' || doc_id || '.hpp' END AS path FROM documents"""


@query("select_source_files", f"SELECT path, regexp_extract(path, '(\\.[^./]*)$', 1) AS extension FROM ({PATHS}) WHERE regexp_matches(path, '[.](py|md|hpp)$')")
def _(t):
    i = F.col("doc_id")
    path = F.expr("""CASE doc_id % 6 WHEN 0 THEN 'src/' || source || '/f' || doc_id || '.py' WHEN 1 THEN 'node_modules/' || doc_id || '.js'
      WHEN 2 THEN 'docs/' || doc_id || '.md' WHEN 3 THEN 'bin/' || doc_id || '.exe' WHEN 4 THEN 'a/dist/' || doc_id || '.ts' ELSE 'lib/' || doc_id || '.hpp' END""")
    return f.filter_source_paths(t.documents.select(path.alias("path"), i)).select("path", "extension")


TOKENS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query("chunk_text", f"""WITH k AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 50, 1), 450)) AS b FROM k WHERE len(w) > 0)
  SELECT doc_id, CAST(b // 450 AS INT) AS chunk, CAST(least(500, len(w) - b) AS INT) AS tokens, array_to_string(w[b + 1 : b + 500], ' ') AS text FROM s""")
def _(t):
    return f.chunk_text(t.documents)


@query("distinct_sources", "SELECT source AS uri, lang AS title, min(doc_id) AS first_seq FROM documents GROUP BY 1, 2")
def _(t):
    return f.distinct_sources(t.documents.select(F.col("source").alias("uri"), F.col("lang").alias("title"), F.col("doc_id").alias("seq")))


@query("coerce_timestamp", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1704067200000 + doc_id * 1000 WHEN 1 THEN doc_id * 1000 WHEN 2 THEN doc_id * 1000 + 500 ELSE 0 END AS at_ms FROM documents""")
def _(t):
    i = F.col("doc_id")
    raw = (
        F.when(i % 4 == 0, F.date_format(F.timestamp_seconds(i + 1704067200), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(i % 4 == 1, F.concat(F.lit(""), i * 1, F.lit(".0")))
        .when(i % 4 == 2, F.concat(i, F.lit(".5")))
        .otherwise("soon")
    )
    return t.documents.select("doc_id", F.unix_millis(coerce_timestamp(raw)).alias("at_ms"))


@query("batch_requests_jsonl", f"""SELECT CAST(id AS STRING) AS custom_id, 'm-1' AS model, 'Analyze the following content and categorize it into one of these categories: ' ||
  (SELECT string_agg(DISTINCT category, ', ' ORDER BY category) FROM v_taxonomy) || chr(10) || chr(10) || 'Title: ' || title || chr(10) || chr(10) || 'Content: ' || content || '...' AS head FROM ({CT})""")
def _(t):
    names = sorted(r[0] for r in m.category_list(t.taxonomy).collect())  # as many as a prompt can hold
    lines = f.batch_requests_jsonl(content(t), names, "m-1")
    path = scratch_path(t.spark, "requests")
    f.write_lines(lines, path)
    parsed = t.spark.read.text(path).select(
        F.from_json("value", "custom_id string, body struct<model:string, messages:array<struct<role:string, content:string>>>").alias("r")
    )
    prompt = F.get(F.col("r.body.messages"), F.lit(1))["content"]
    return parsed.select("r.custom_id", "r.body.model", F.substring_index(prompt, "\n\nRespond with a JSON", 1).alias("head"))


# ---- table work


@query("upsert_by_url", """WITH i AS (SELECT url, page_id + 1000000 AS v, page_id AS seq FROM pages WHERE contains(url, '/en/') UNION ALL
    SELECT url, page_id + 2000000, page_id + 5 FROM pages WHERE contains(url, '/en/') UNION ALL SELECT url || '/new', page_id, page_id FROM pages WHERE NOT contains(url, '/en/')),
  k AS (SELECT url, arg_max(v, seq) AS v FROM i GROUP BY 1)
  SELECT url, v FROM k UNION ALL SELECT url, page_id FROM pages WHERE url NOT IN (SELECT url FROM k)""")
def _(t):
    english = F.contains("url", F.lit("/en/"))
    p = F.col("page_id")
    target = t.pages.select("url", p.alias("v"), p.alias("seq"))
    first = t.pages.filter(english).select("url", (p + 1000000).alias("v"), p.alias("seq"))
    second = t.pages.filter(english).select("url", (p + 2000000).alias("v"), (p + 5).alias("seq"))
    new = t.pages.filter(~english).select(F.concat("url", F.lit("/new")).alias("url"), p.alias("v"), p.alias("seq"))
    return w.upsert_by_url(target, first.unionByName(second).unionByName(new)).select("url", "v")


@query("upsert_matching", """SELECT taxonomy_id, content_id, id FROM (SELECT taxonomy_id, content_id, id, created_ms, 0 AS g FROM v_matchings WHERE match_stage <> 'llm_categorized'
   UNION ALL SELECT taxonomy_id, content_id, id, created_ms, 1 FROM v_matchings WHERE match_stage = 'llm_categorized')
  QUALIFY row_number() OVER (PARTITION BY taxonomy_id, content_id ORDER BY g DESC, created_ms DESC, id DESC) = 1""")
def _(t):
    late = F.col("match_stage") == "llm_categorized"
    first, incoming = t.matchings.filter(~late), t.matchings.filter(late)
    stored = w.upsert_matching(first.limit(0), first)
    return w.upsert_matching(stored, incoming).select("taxonomy_id", "content_id", "id")


@query("bulk_insert", "SELECT id, taxonomy_id FROM v_matchings")
def _(t):
    path = scratch_path(t.spark, "rows")
    late = F.col("match_stage") == "llm_categorized"
    for part in (t.matchings.filter(~late), t.matchings.filter(late), t.matchings.limit(0)):
        w.bulk_insert(part.select("id", "taxonomy_id"), path)
    return t.spark.read.schema("id long, taxonomy_id string").parquet(path)


@query("clear_matching", """SELECT CASE WHEN taxonomy_id IN (SELECT id FROM v_taxonomy WHERE category < 'src2') AND match_stage = 'needs_human_review' THEN 'deleted' ELSE 'kept' END AS state, id FROM v_matchings""")
def _(t):
    ids = t.taxonomy.filter("category < 'src2'").select(F.col("id").alias("taxonomy_id"))
    kept, gone = w.clear_matching(t.matchings, ids, ["needs_human_review"])
    return kept.select(F.lit("kept").alias("state"), "id").unionByName(gone.select(F.lit("deleted").alias("state"), "id"))
