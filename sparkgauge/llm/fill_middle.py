"""Fill-in-middle texts: a document is cut at two places and its middle moves to the end.

One ``fullmatch`` of ``(unit)*`` over the whole text keeps every repetition of the
group, so ``match.ends(1)`` is the list of all unit ends: its length is the number
of units and its items are the cut offsets. The repetition is possessive, which
keeps no way back for each unit. Units are code points unless told otherwise
(``\\X`` for what readers see as one character, ``\\s*\\S+`` for words).

Distribution: rows are independent, nothing is shuffled; a task works on a few
megabytes of text at a time. One match holds some 80 bytes a unit of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm.common import by_slices, keyed_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(seed: str, key: str | None) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of ``seed:key``; a null key is empty."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def cut(text: str, units: regex.Pattern, h: list[int], plain_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text; ``n`` is null where units do not make up the text."""
    match = units.fullmatch(text)
    if match is None:
        return None, "plain", None, None, text
    ends = match.ends(1)
    n = len(ends)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = ".", seed: str = "1",
              plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    A null text is empty; empty texts, texts that hold a marker and texts that are no
    sequence of units stay plain. Rows draw by ``seed`` and key alone: repeated keys
    and reruns draw alike, a null key draws as an empty one. Other columns are
    neither read nor returned. An empty table gives an empty result.
    """
    rows = keyed_text(docs, key, text).withColumn("name", F.col("key").cast("string"))

    def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        units = regex.compile(f"({unit})*+", regex.DOTALL)
        texts, names = part.column(1).to_pylist(), part.column(2).to_pylist()
        done = [cut(t or "", units, draws(seed, k), plain_percent, spm_percent) for t, k in zip(texts, names)]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*done), kinds)]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(by_slices(work), f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that ``output`` was made of; the first marker of each kind is the one that was put in."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    width = len(PREFIX)
    body = F.substr(output, F.lit(width + 1))
    one = F.when(form == "spm", F.substring_index(body, PREFIX, 1)).otherwise(F.substring_index(body, SUFFIX, 1))
    rest = F.substr(output, F.length(one) + 2 * width + 1)
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + width + 1)
    # psm holds prefix, suffix, middle; spm suffix, prefix, middle
    cut_text = F.when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
    return F.when(form == "plain", output).otherwise(cut_text)
