"""Queries of this folder's operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.llm import (
    decontam,
    exact_dedup,
    fill_middle,
    html_text,
    langid,
    line_dedup,
    lsh_forest,
    mixing,
    ngram_join,
    rans,
    suffix_dedup,
    vector_codes,
    warc,
)
from sparkgauge.llm.common import table

CAPITALS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]+"


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC and WARC files."""
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
FROM g
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents stay of those with equal texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '{BLANKS}', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  first_value(doc_id) OVER w = doc_id AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and contaminating items of every document."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), "contaminated")


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({CAPITALS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({CAPITALS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, item_id, i, p.size FROM places p JOIN windows w ON p.win = w.win AND p.size = w.size
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_DIGIT = "(instr('0123456789abcdef', substr(md5('mix' || coalesce(source, '')), {k}, 1)) - 1)"
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{NOT_BLANK}')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s
), o AS (
  SELECT *, row_number() OVER w AS k,
    CAST(coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open,
    CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM r WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)
), bound AS (
  SELECT k AS first_open, CAST(total - 3 * capped AS DOUBLE) / open AS share_of_one
  FROM o WHERE CAST(total - 3 * capped AS DOUBLE) / open * weight <= 3 * source_size ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN k < first_open THEN CAST(3 * source_size AS DOUBLE) ELSE share_of_one * weight END AS target,
    CAST({" + ".join(f"{_DIGIT.format(k=k)} * {16 ** (8 - k)}" for k in range(1, 9))} AS DOUBLE) / 4294967296.0 AS u
  FROM o, bound
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS place FROM d
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN CAST(floor(place * (target / source_size) + u) - floor((place - 1) * (target / source_size) + u) AS BIGINT) * size
    ELSE 0 END AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without strings of 50 bytes that a smaller id has."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP7_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)
), g AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM w JOIN g USING (s) WHERE doc_id > least
), spans AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before < i - 1) AS n_spans
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone) GROUP BY doc_id
), bytes AS (
  SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM spans)
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i) AS h FROM bytes ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_removed IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, read back from the range-ANS files."""
    return rans.round_trip(table(spark, sf_dir, "documents"), vocabulary_file())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line."""
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents"))
    removed = F.concat_ws(",", F.transform("removed", lambda x: x.cast("string")))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), removed.alias("removed"))


OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, list_sort(list_distinct(regexp_extract_all(lines[i], '{NOT_BLANK}'))) AS w
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), s AS (
  SELECT w, row_number() OVER () AS id, f FROM (SELECT w, min(struct_pack(d := doc_id, l := line_no)) AS f FROM l WHERE len(w) > 0 GROUP BY w)
), t AS (
  SELECT id, len(w) AS n, unnest(w) AS word FROM s
), p AS (
  SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.word = b.word AND a.id <> b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), gone AS (
  SELECT DISTINCT p.b AS id FROM p JOIN s x ON x.id = p.a JOIN s y ON y.id = p.b WHERE x.f < y.f
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE away) AS n_removed,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (WHERE away), '') AS removed
FROM (
  SELECT l.doc_id, l.line_no, len(l.w) > 0 AND (gone.id IS NOT NULL OR s.f.d <> l.doc_id OR s.f.l <> l.line_no) AS away
  FROM l LEFT JOIN s ON s.w = l.w LEFT JOIN gone ON gone.id = s.id
) l GROUP BY l.doc_id
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({CAPITALS}, '{NOT_BLANK}') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), both_in AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM both_in JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in the middle, and put together again."""
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fill_middle.restored("output", "form")).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents
), h AS (
  SELECT *, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || s[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || s[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, substr(t, 1, least(x, y)) AS p,
    substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(t, greatest(x, y) + 1) AS z
  FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all vectors."""
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    found = vector_codes.with_label_error(coded.vectors)
    return found.select("vec_id", "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of the codebooks, one after another."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d
  FROM (SELECT vec_id, part, entry, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{k} c USING (part, pos) GROUP BY ALL) GROUP BY ALL
)""")
        if k < rounds:
            steps.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, v) AS v
  FROM c{k} LEFT JOIN (SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL) USING (part, entry, pos)
)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, i * {parts} // len(v) AS part, i AS pos, v[i + 1] AS v FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)
), c0 AS (
  SELECT part, entry, pos, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id)
),{",".join(steps)}, coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count, component and whether it stays, of every document."""
    return lsh_forest.near_copies(table(spark, sf_dir, "documents"), n=4, percent=80)


OP13_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({OP10_SQL.replace('85 *', '80 *')})"


QUERIES = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_main_text": op3_main_text,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_source_mixing": op6_source_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_fill_middle": op11_fill_middle,
    "op12_vector_codes": op12_vector_codes,
    "op13_lsh_forest": op13_lsh_forest,
}

SQL = {
    "op1_arc_to_warc": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_source_mixing": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op9_line_dedup": OP9_SQL,
    "op10_ngram_join": OP10_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_vector_codes": _codes_sql(),
    "op13_lsh_forest": OP13_SQL,
}
