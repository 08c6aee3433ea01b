"""Checkpoints, stored artifacts, snapshots and test results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgauge.functions.timefns import round2
from sparkgauge.operators.joins import skew_join
from sparkgauge.operators.positions import newest_per_key

RESERVED_TAGS = ["name", "url", "hasScreenshot", "hasDOM", "hasConsole"]  # fixed value
NO_MINUTE = -(1 << 62)  # minute of rows without a time
REFS = ["dom_ref", "screenshot_ref", "console_ref", "network_ref"]


def _newest(df: DataFrame, limit: int | None) -> DataFrame:
    ordered = df.orderBy(F.col("ts_ms").desc(), F.col("id").desc())
    return ordered.limit(limit) if limit else ordered


# ---- checkpoints


def query_checkpoints(
    checkpoints: DataFrame,
    name: str | None = None,
    url: str | None = None,
    tags: Sequence[str] | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    has: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Filter by name, url, any of the tags, time and present refs; newest first."""
    tests: list[Column] = [F.col(f"{kind}_ref").isNotNull() for kind in has]
    if name:
        tests.append(F.col("name") == name)
    if url:
        tests.append(F.col("url") == url)
    if tags:
        tests.append(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags])))
    if start_ms is not None:
        tests.append(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        tests.append(F.col("ts_ms") <= end_ms)
    for test in tests:
        checkpoints = checkpoints.filter(test)
    return _newest(checkpoints, limit)


def query_by_tag(checkpoints: DataFrame, tag: str) -> DataFrame:
    return checkpoints.filter(F.array_contains("tags", tag))


def latest_checkpoint(checkpoints: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Newest checkpoint, overall or per key. The reference returns the first stored one."""
    fields = [c for c in checkpoints.columns if c not in keys]
    top = checkpoints.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct("ts_ms", "id")).alias("_c"))
    return top.filter(F.col("_c").isNotNull()).select(*keys, "_c.*")


def checkpoint_by_name(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint stored last under each name."""
    fields = [c for c in checkpoints.columns if c != "name"]
    return checkpoints.groupBy("name").agg(F.max_by(F.struct(*fields), "id").alias("_c")).select("name", "_c.*")


def checkpoint_history(checkpoints: DataFrame, url: str, limit: int | None = None) -> DataFrame:
    return _newest(checkpoints.filter(F.col("url") == url), limit)


def _pair_up(pairs: DataFrame, checkpoints: DataFrame, maps: str = "custom") -> DataFrame:
    cols = [*REFS, maps]
    a = checkpoints.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = checkpoints.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return pairs.join(a, "a_id").join(b, "b_id")


def key_union(a: Column, b: Column) -> Column:
    """Distinct keys of two maps, null maps counting as empty."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(F.map_keys(a), none), F.coalesce(F.map_keys(b), none))


def compare_checkpoints(pairs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Which refs differ for each (a_id, b_id), and the custom keys whose values differ."""
    both = _pair_up(pairs, checkpoints)
    keys = F.filter(
        key_union(F.col("a_custom"), F.col("b_custom")),
        lambda k: ~F.element_at("a_custom", k).eqNullSafe(F.element_at("b_custom", k)),
    )
    differs = [(~F.col(f"a_{r}").eqNullSafe(F.col(f"b_{r}"))).alias(r.replace("_ref", "")) for r in REFS]
    return both.select("a_id", "b_id", *differs, F.array_sort(keys).alias("custom"))


def compare_captured(pairs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """As above; a dimension counts only when both sides captured it, else null."""
    both = _pair_up(pairs, checkpoints)
    kinds = ["dom_ref", "screenshot_ref", "console_ref"]
    differs = [
        F.when(F.col(f"a_{r}").isNotNull() & F.col(f"b_{r}").isNotNull(), F.col(f"a_{r}") != F.col(f"b_{r}")).alias(
            r.replace("_ref", "")
        )
        for r in kinds
    ]
    return both.select("a_id", "b_id", *differs)


def checkpoint_stats(checkpoints: DataFrame) -> DataFrame:
    present = [F.count(c).alias(f"with_{c.replace('_ref', '')}") for c in REFS[:3]]
    return checkpoints.agg(
        F.count("*").alias("total"), *present, F.min("ts_ms").alias("oldest_ms"), F.max("ts_ms").alias("newest_ms")
    )


def distinct_tags(checkpoints: DataFrame) -> DataFrame:
    tags = checkpoints.select(F.explode("tags").alias("tag")).distinct()
    return tags.filter(~F.col("tag").isin(RESERVED_TAGS)).orderBy("tag")


# ---- artifacts


def union_artifacts(*kinds: DataFrame) -> DataFrame:
    whole = kinds[0]
    for more in kinds[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return whole


def artifacts_by_test(refs: DataFrame, test_id: str, category: str | None = None) -> DataFrame:
    kept = refs.filter(F.col("test_id") == test_id)
    return kept.filter(F.col("category") == category) if category else kept


def artifacts_in_range(refs: DataFrame, start_ms: int, end_ms: int, category: str | None = None) -> DataFrame:
    kept = refs.filter(F.col("ts_ms").between(start_ms, end_ms))
    return kept.filter(F.col("category") == category) if category else kept


def query_screens(
    screens: DataFrame,
    url: str | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    width: tuple[int | None, int | None] = (None, None),
    height: tuple[int | None, int | None] = (None, None),
    limit: int | None = None,
) -> DataFrame:
    """Screens by url, time and size bounds, newest first."""
    bounds = [("ts_ms", start_ms, end_ms), ("width", *width), ("height", *height)]
    if url:
        screens = screens.filter(F.col("url") == url)
    for column, low, high in bounds:
        if low is not None:
            screens = screens.filter(F.col(column) >= low)
        if high is not None:
            screens = screens.filter(F.col(column) <= high)
    return _newest(screens, limit)


def query_pages(
    pages: DataFrame, url: str | None = None, start_ms: int | None = None, end_ms: int | None = None, limit: int | None = None
) -> DataFrame:
    return query_screens(pages, url, start_ms, end_ms, limit=limit)


def recent_artifacts(refs: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` of each category."""
    return newest_per_key(refs, ["category"], [F.col("ts_ms").desc(), F.col("id").desc()], n)


def find_duplicates(refs: DataFrame, content: str = "text") -> DataFrame:
    """Content hashes that occur more than once per category: count, bytes, first id.

    The reference hashes the path and so never finds equal content; this hashes the
    content. A missing content is the group ``no-hash``. Counts combine map-side, so a
    hash that a third of the rows share costs one row per partition.
    """
    hashed = refs.withColumn("hash", F.coalesce(F.sha2(F.col(content), 256), F.lit("no-hash")))
    groups = hashed.groupBy("category", "hash").agg(
        F.count("*").alias("copies"), F.sum("size").alias("bytes"), F.min("id").alias("first_id")
    )
    return groups.filter("copies > 1")


def duplicate_members(refs: DataFrame, content: str = "text") -> DataFrame:
    """Members of each duplicate group, as rows.

    A hash that very many rows share is cut into parts by its counted size, so no task
    receives a whole hot group and other groups cost nothing more.
    """
    hashed = refs.withColumn("hash", F.coalesce(F.sha2(F.col(content), 256), F.lit("no-hash")))
    groups = find_duplicates(refs, content).select("category", "hash", "copies")
    return skew_join(hashed.select("category", "hash", "id", "path"), groups, ["category", "hash"])


def artifact_stats(refs: DataFrame) -> DataFrame:
    kinds = ["screenshot", "dom", "console", "network"]
    return refs.agg(
        *[F.count_if(F.col("category") == k).alias(k) for k in kinds],
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.max("ts_ms").alias("last_ms"),
    )


def retention_cleanup(
    refs: DataFrame, older_than_ms: int | None = None, keep_last: int = 0, categories: Sequence[str] | None = None
) -> DataFrame:
    """Rows to delete: per category those older than the cut, sparing the newest ``keep_last``.

    Counts per category and minute find the minute that holds the ``keep_last``-th row;
    older minutes go whole and only the rows of that minute are ranked. A null category
    is a category, a null time is older than any. When a category has fewer rows than
    ``keep_last``, all are spared; the reference deletes them.
    """
    chosen = refs.filter(F.col("category").isin(list(categories))) if categories else refs
    if older_than_ms is not None:
        chosen = chosen.filter(F.col("ts_ms") < older_than_ms)
    if not keep_last:
        return chosen
    columns = chosen.columns
    timed = chosen.withColumn("_minute", F.coalesce(F.floor(F.col("ts_ms") / 60_000), F.lit(NO_MINUTE)))
    counts = timed.groupBy(F.col("category").alias("_category"), F.col("_minute").alias("_edge")).agg(F.count("*").alias("_n"))
    newer = Window.partitionBy("_category").orderBy(F.col("_edge").desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    edges = edges.filter((F.col("_newer") < keep_last) & (F.col("_newer") + F.col("_n") >= keep_last)).drop("_n")
    placed = timed.join(edges, F.col("category").eqNullSafe(F.col("_category")))
    older = placed.filter(F.col("_minute") < F.col("_edge"))
    newest_first = Window.partitionBy("category").orderBy(F.col("ts_ms").desc(), F.col("id").desc())
    ranked = placed.filter(F.col("_minute") == F.col("_edge")).withColumn("_rank", F.row_number().over(newest_first))
    ranked = ranked.filter(F.col("_newer") + F.col("_rank") > keep_last)
    return older.select(*columns).unionByName(ranked.select(*columns))


def retention_stats(deleted: DataFrame) -> DataFrame:
    return deleted.groupBy("category").agg(F.count("*").alias("deleted"), F.sum("size").alias("freed"))


# ---- snapshots: pixel tables (image, x, y, r, g, b)


def snapshot_pixels(pairs: DataFrame, pixels: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Pixels of each (baseline, current) pair with ``different``: channel distance above
    threshold times the maximum of 765. Joined on (x, y), so channel count cannot misalign."""
    a = pixels.select(F.col("image").alias("baseline"), "x", "y", *[F.col(c).alias(f"a{c}") for c in "rgb"])
    b = pixels.select(F.col("image").alias("current"), "x", "y", *[F.col(c).alias(f"b{c}") for c in "rgb"])
    distance = sum((F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in "rgb"), F.lit(0))
    return (
        pairs.join(a, "baseline")
        .join(b, ["current", "x", "y"])
        .select("baseline", "current", "x", "y", (distance > threshold * 765).alias("different"))
    )


def snapshot_diff(diff: DataFrame) -> DataFrame:
    percent = F.count_if("different") / F.count("*") * 100
    return diff.groupBy("baseline", "current").agg(
        F.count("*").alias("total"), F.count_if("different").alias("different"), round2(percent).alias("percent")
    )


def snapshot_diff_bounds(diff: DataFrame) -> DataFrame:
    """Bounding box of the different pixels; equal pairs have no row."""
    box = [f(F.col(c)).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))]
    return diff.filter("different").groupBy("baseline", "current").agg(*box)


def snapshot_diff_regions(diff: DataFrame, tile: int = 50, min_percent: float = 5.0) -> DataFrame:
    """Tiles with more than ``min_percent`` different pixels; edge tiles are smaller."""
    percent = F.count_if("different") / F.count("*") * 100
    tiles = diff.groupBy(
        "baseline", "current", (F.floor(F.col("x") / tile) * tile).alias("x"), (F.floor(F.col("y") / tile) * tile).alias("y")
    ).agg(F.count("*").alias("pixels"), percent.alias("percent"))
    return tiles.filter(F.col("percent") > min_percent).withColumn("percent", round2(F.col("percent")))


# ---- test results


def test_summary(results: DataFrame) -> DataFrame:
    """Tests by status, durations, and checkpoint and validation totals.

    Nested arrays are folded inside their row, so durations are never fanned out.
    """

    def count(items: Column, test) -> Column:
        return F.size(F.filter(items, test))

    validations = F.flatten(F.transform("checkpoints", lambda c: c["validations"]))
    per_test = results.select(
        "status",
        "duration",
        F.size("checkpoints").alias("c"),
        count(F.col("checkpoints"), lambda c: c["status"] == "passed").alias("cp"),
        count(F.col("checkpoints"), lambda c: c["status"] == "failed").alias("cf"),
        F.size(validations).alias("v"),
        count(validations, lambda v: v["passed"]).alias("vp"),
    )
    by_status = [F.count_if(F.col("status") == s).alias(f"{s}_tests") for s in ("passed", "failed", "skipped", "error")]
    share = F.coalesce(F.try_divide(F.count_if(F.col("status") == "passed"), F.count("*")) * 100, F.lit(0.0))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return per_test.agg(
        F.count("*").alias("total_tests"),
        *by_status,
        total("duration").alias("total_duration"),
        round2(share).alias("success_rate"),
        total("c").alias("total_checkpoints"),
        total("cp").alias("passed_checkpoints"),
        total("cf").alias("failed_checkpoints"),
        total("v").alias("total_validations"),
        total("vp").alias("passed_validations"),
        (total("v") - total("vp")).alias("failed_validations"),
    )


ASSERTIONS = "array<struct<description:string, passed:boolean, expected:string, actual:string, error:string>>"


def custom_validation(refs: DataFrame, check: Column | Callable[[dict], object], name: str, key: str = "id") -> DataFrame:
    """Run a user check on every row: (key, name, passed, message, assertions).

    ``check`` is a boolean Column (a null outcome has failed; an expression that may raise
    has to be written with Spark's ``try_`` functions), or a callable that gets the row as a
    dict and returns a boolean, one assertion or a list of them: mappings with passed and, if
    it likes, description, expected, actual and error. All assertions have to pass; none at
    all is a pass. A callable that raises has failed on that row alone, with its error.
    """
    if isinstance(check, Column):
        passed = F.coalesce(check, F.lit(False))
        state = F.when(passed, "passed").otherwise("failed")
        one = F.struct(
            F.lit(name).alias("description"), passed.alias("passed"), F.lit("Validation passes").alias("expected"),
            F.initcap(state).alias("actual"), F.lit(None).cast("string").alias("error"),
        )
        message = F.concat(F.lit(f'Custom validation "{name}" '), state)
        return refs.select(key, F.lit(name).alias("name"), passed.alias("passed"), message.alias("message"), F.array(one).alias("assertions"))

    def outcome(row: dict) -> tuple[bool, str, list[dict]]:
        fields = ("description", "passed", "expected", "actual", "error")
        try:
            found = check(row)
            if isinstance(found, bool) or found is None:
                found = [{"description": name, "passed": bool(found), "expected": "Validation passes", "actual": "Passed" if found else "Failed"}]
            elif isinstance(found, Mapping):
                found = [found]
            listed = [{f: a.get(f) if f == "passed" or a.get(f) is None else str(a.get(f)) for f in fields} | {"passed": bool(a.get("passed"))} for a in found]
        except Exception as error:  # noqa: BLE001  whatever a user's check raises is its result
            said = f"{type(error).__name__}: {error}"
            failed = dict.fromkeys(fields) | {"description": name, "passed": False, "error": f"Failed to execute custom validation: {said}"}
            return False, f"Custom validation error: {said}", [failed]
        passed = all(a["passed"] for a in listed)
        return passed, f'Custom validation "{name}" {"passed" if passed else "failed"}', listed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).to_dict("records")
            done = [outcome(row) for row in rows]
            yield pd.DataFrame({
                key: batch[key], "name": name, "passed": [d[0] for d in done], "message": [d[1] for d in done], "assertions": [d[2] for d in done],
            })

    kind = refs.schema[key].dataType.simpleString()
    return refs.mapInPandas(run, f"`{key}` {kind}, name string, passed boolean, message string, assertions {ASSERTIONS}")
