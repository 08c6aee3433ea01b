"""Language identification by hierarchical discrimination.

A linear model first predicts the family of languages; inside it, one-versus-one
linear support vector machines tell closely related languages apart and vote.
Features are hashed byte bigrams and trigrams of the whole text. The models are
fitted on a bounded sample (``per_language`` texts each, ``max_sample`` in all);
everything else runs on the executors, one pass over the text, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import by_slices, free_name, keyed_text, prepare, release_memory, slices, text_bytes

UNKNOWN = "und"
BUCKETS = 1 << 12
SLICE_BYTES = 1 << 20  # of text
JUDGED_ROWS = 256  # features take 16 KB a text

# ISO 639-1 codes by family. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "indic": "hi bn ur pa gu mr ne".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "uralic": "fi et hu".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    """The family of a language code; regional parts (``pt-BR``) do not count."""
    return FAMILY_OF.get(re.split("[-_]", lang.lower())[0], lang)


# Non-letters of ASCII become one space; capitals become small.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of square-rooted, unit-length counts of hashed bigrams and trigrams over whole texts."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    folded = _FOLD[raw].astype(np.uint32)
    for i in range(len(offsets) - 1):
        x = folded[offsets[i] : offsets[i + 1]]
        if len(x) < 2:
            continue
        two = x[:-1] << 8 | x[1:]
        three = two[:-1] << 8 | x[2:]
        codes = np.concatenate([two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA77)]) >> np.uint32(20)
        out[i] = np.bincount(codes, minlength=BUCKETS)
    np.sqrt(out, out=out)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norms, 1e-9)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    return np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)


def _squared_hinge(x: np.ndarray, sign: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights (last one: bias) of a linear support vector machine, classes weighted alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w, 1.0
    for _ in range(steps):  # accelerated gradient on the squared hinge loss
        slack = np.maximum(0, 1 - sign * (x @ ahead)) * sign * share
        new = ahead - 0.25 * (penalty * ahead - 2 * (x.T @ slack))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


@dataclass(frozen=True)
class LanguageModel:
    """One-versus-rest weights for families, one-versus-one weights for languages of one family."""

    families: tuple[str, ...]
    family_weights: np.ndarray
    languages: dict[str, tuple[str, ...]]
    pair_weights: dict[tuple[str, str], np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores (0 to 1) of feature rows."""
        langs, scores = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
        if not self.families:
            return langs, scores
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margins = 4.0 * (x @ self.family_weights.T)
        odds = np.exp(margins - margins.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        choice = odds.argmax(axis=1)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(choice == k)
            own = self.languages[name]
            votes, trust = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    m = x[rows] @ self.pair_weights[a, own[j]]
                    p = 1 / (1 + np.exp(-4.0 * m))
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    trust[:, i] += p
                    trust[:, j] += 1 - p
            if len(own) > 1:
                best = (votes + 1e-3 * trust).argmax(axis=1)
                sure = trust[np.arange(len(rows)), best] / (len(own) - 1)
            else:
                best, sure = np.zeros(len(rows), int), np.ones(len(rows))
            langs[rows] = np.array(own, object)[best]
            scores[rows] = odds[rows, k] * sure
        return langs, np.clip(scores, 0, 1)


def fit(x: np.ndarray, langs: np.ndarray) -> LanguageModel:
    """Fit both levels on feature rows and their languages."""
    names = sorted(set(langs))
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(family(name), []).append(name)
    families = tuple(sorted(groups))
    of = np.array([family(name) for name in langs], object)
    if len(families) > 1:
        weights = np.stack([_squared_hinge(x, np.where(of == f, 1, -1).astype(np.float32)) for f in families])
    else:
        weights = np.zeros((len(families), x.shape[1] + 1), np.float32)
    pairs = {}
    for own in groups.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                rows = (langs == a) | (langs == b)
                pairs[a, b] = _squared_hinge(x[rows], np.where(langs[rows] == a, 1, -1).astype(np.float32))
    return LanguageModel(families, weights, {f: tuple(groups[f]) for f in families}, pairs)


def held_out(key: Column) -> Column:
    """Documents that training never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _feature_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    x = features(*text_bytes(batch.column(1)))
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], ["lang", "x"]
    )


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = 300, max_sample: int = 6_000) -> LanguageModel:
    """Fit on at most ``per_language`` texts of each language (and about ``max_sample`` in all).

    The sample is drawn by a hash of the id from rows outside ``held_out`` whose
    language and text are not null. Counting the languages is one aggregate over
    two columns; languages are a few values, the sample's features are bounded by
    ``max_sample`` rows of 16 KB. No usable row gives a model that answers ``und``.
    """
    rows = keyed_text(docs, key, text, lang).filter(~held_out(F.col("key")))
    rows = rows.filter("in_%s is not null and text is not null" % lang).withColumnRenamed(f"in_{lang}", "lang")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count")).limit(max_sample // 4).collect()}
    if not counts:
        return fit(np.zeros((0, BUCKETS), np.float32), np.zeros(0, object))
    each = min(per_language, max(4, max_sample // len(counts)))
    scale = 1 << 30
    bound = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(scale, each * scale // n))])
    drawn = rows.filter(F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(17)), F.lit(scale)) < bound[F.col("lang")])
    got = drawn.select("lang", "text").mapInArrow(by_slices(_feature_rows, SLICE_BYTES), "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, BUCKETS)
    langs = np.array(got["lang"].to_pylist(), object)
    order = np.lexsort((x @ np.linspace(0, 1, BUCKETS, dtype=np.float32), langs.astype(str)))  # whatever order tasks end in
    return fit(x[order], langs[order])


def judge(model: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of texts, some rows at a time: short ones have far more features than bytes."""
    found = []
    for at in range(0, len(texts), JUDGED_ROWS):
        part = texts.slice(at, JUDGED_ROWS)
        langs, scores = model.predict(features(*text_bytes(part)))
        none = ~has_letter(part)
        langs[none], scores[none] = UNKNOWN, 0.0
        found.append((langs, scores))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for each row; ``und`` with score 0 if the text is null or has no letter.

    Repeated rows give repeated results; other columns are neither read nor returned.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, scores = judge(model, batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores.astype(float))], ["key", "lang_pred", "score"]
        )

    rows = keyed_text(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(by_slices(work, SLICE_BYTES), f"key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added, row by row: no join and no shuffle.

    Columns of those names are replaced.
    """
    prepare(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    name = free_name(kept, "judged")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, name, SLICE_BYTES):
                column = part.column(part.num_columns - 1)
                langs, scores = judge(model, column)
                columns = [*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores.astype(float))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score"])
        release_memory()

    schema = rows.drop(name).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the labelled part of ``docs`` and predict all of it: key, held_out, lang_pred, score."""
    out = predict(docs, train(docs, key, text, lang), key, text)
    return out.select(key, held_out(F.col(f"`{key}`")).alias("held_out"), "lang_pred", "score")
