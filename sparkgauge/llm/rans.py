"""Token ids in a static range-ANS file format.

A corpus is tokenised in ascending key order. Counts of all ids give one shared
frequency table; blocks of whole documents are then coded on their own: ids are
dealt to interleaved lanes, each a 64-bit range-ANS state that moves 32-bit
words. A block row holds the keys and lengths of its documents, the lane states
(the checkpoint from which a reader starts), the words and a CRC-32 of its ids,
so blocks decode in parallel and a damaged one is found.

The files: ``<path>/table`` (one row) and ``<path>/blocks``.
"""

from __future__ import annotations

import gc
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkgauge.llm.common import by_slices, hash_runs, keyed_text, stored
from sparkgauge.session import scratch_path

SCALE_BITS = 20
BLOCK_IDS = 1 << 18
MAX_LANES = 4096
SLICE_BYTES = 1 << 20
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for every id that occurs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def __getstate__(self):
        return self.freq

    def __setstate__(self, freq):
        self.__init__(freq)

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> "Table":
        total = 1 << SCALE_BITS
        seen = counts > 0
        if seen.sum() > total // 2:
            raise ValueError("more ids occur than the table can tell apart")
        freq = np.zeros(len(counts), np.int64)
        if seen.any():
            freq[seen] = np.maximum(1, np.floor(counts[seen] * ((total - seen.sum()) / counts.sum())).astype(np.int64))
            freq[int(counts.argmax())] += total - freq.sum()
        return cls(freq)


def encode(ids: np.ndarray, table: Table) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, states, words) of one block."""
    n = len(ids)
    lanes = int(min(MAX_LANES, max(1, n // 64)))
    states = np.full(lanes, _LOW, np.uint64)
    freq, start = table.freq[ids], table.start[ids]
    out = []
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        end = min(at + lanes, n)
        x, f = states[: end - at], freq[at:end]
        full = x >= f << np.uint64(63 - SCALE_BITS)
        if full.any():
            out.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            x = np.where(full, x >> _WORD, x)
        q = x // f
        states[: end - at] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + start[at:end]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return lanes, states, words


def decode(n: int, states: np.ndarray, words: np.ndarray, table: Table) -> np.ndarray:
    """The ids of a block."""
    lanes, states = len(states), states.copy()
    words = words.astype(np.uint64)
    out = np.empty(n, np.uint32)
    mask, at_word = np.uint64((1 << SCALE_BITS) - 1), 0
    for at in range(0, n, lanes):
        end = min(at + lanes, n)
        x = states[: end - at]
        slot = x & mask
        ids = table.slots[slot]
        out[at:end] = ids
        x = table.freq[ids] * (x >> np.uint64(SCALE_BITS)) + slot - table.start[ids]
        need = np.flatnonzero(x < _LOW)
        x[need] = x[need] << _WORD | words[at_word : at_word + len(need)]
        at_word += len(need)
        states[: end - at] = x
    return out


class Tokenizer:
    """Ids of texts by the tokenizers library, with a cache of words.

    The pre-tokenizer of byte-level BPE cuts before every single space between two
    characters that are not white space, and what lies between two such cuts gets
    the same ids wherever it stands. So texts are cut there, and each distinct piece
    goes through the library once: pieces meet as 64-bit hashes, and the ids of a slice of
    texts are gathered from one pool at once. A new piece is cut further where that is as
    safe: at a single line feed, and between letters and punctuation at the end. A
    text with other white space beside a space goes through the library whole, and so
    does one that holds the string of an added token, which the library takes as that token.
    """

    CACHE = 60_000  # parts of a generation; there are two
    PIECES = 300_000  # pieces that are kept of twice as many: some 25 MB
    SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
    PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        pre = self.library.pre_tokenizer
        self.by_words = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and self.library.normalizer is None
        # byte-level BPE spells bytes as characters: visible ones of Latin-1 as they are, the others from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.spelling = np.arange(256, dtype="<u2")
        self.spelling[hidden] = 256 + np.arange(len(hidden))
        self.line_feed = chr(self.spelling[10])  # what separates words when they are spelled; none holds one
        self.atoms: dict[str, bytes] = {}  # by parts of pieces as they stand; kept from task to task
        self.old_atoms: dict[str, bytes] = {}
        # pieces by their hash, ascending: place and number of their ids in the pool, and when they were last used
        self.known, self.clock = np.zeros(0, np.uint64), 0
        self.offset, self.length, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, self.dtype)

    def _age(self) -> None:
        """Bounds both caches: parts in two generations, pieces by their last use."""
        self.clock += 1
        if len(self.atoms) > self.CACHE:
            self.old_atoms, self.atoms = self.atoms, {}
        if len(self.known) > 2 * self.PIECES:
            kept = np.sort(np.argpartition(self.used, len(self.used) - self.PIECES)[-self.PIECES :])
            self.pool = self._gathered(self.offset[kept], self.length[kept])
            self.known, self.length, self.used = self.known[kept], self.length[kept], self.used[kept]
            self.offset = np.cumsum(self.length) - self.length

    def _gathered(self, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Runs of the pool, one after the other."""
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(offset - ends + length, length) + np.arange(total)]

    def _places(self, hashes: np.ndarray, spelled: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """Index of each of the ascending ``hashes`` among the known pieces; ``spelled`` gives the new ones."""
        at = np.searchsorted(self.known, hashes)
        new = np.flatnonzero(at == len(self.known)) if not len(self.known) else np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != hashes)
        if len(new):
            found = self._learn(spelled(new))
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
            offsets = len(self.pool) + np.cumsum(lengths) - lengths
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), self.dtype)])
            where = at[new]  # both are ascending
            self.known = np.insert(self.known, where, hashes[new])
            self.offset = np.insert(self.offset, where, offsets)
            self.length = np.insert(self.length, where, lengths)
            self.used = np.insert(self.used, where, 0)
            at = np.searchsorted(self.known, hashes)
        self.used[at] = self.clock
        return at

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.dtype.char, e.ids).tobytes() for e in found]

    def plain(self, text: str) -> bool:
        """Every space stands between two characters that are not white space, and no added token occurs."""
        if text[:1].isspace() or text[-1:].isspace() or any(t in text for t in self.added):
            return False
        return not any(c in text and (c + " " in text or " " + c in text) for c in self.SPACES)

    def cut(self, piece: str) -> list[str]:
        """Parts of a piece that the pre-tokenizer separates too."""
        out = []
        for k, line in enumerate(piece.split("\n")):
            core = line[1:] if k == 0 and line[:1] == " " else line
            if not core or core[0].isspace() or core[-1].isspace():
                return [piece]
            if k:
                out.append("\n")
            if core.isalpha():
                out.append(line)
                continue
            stem = line.rstrip(self.PUNCTUATION)
            if len(stem) < len(line) and stem.lstrip(" ").isalpha():
                out += [stem, line[len(stem) :]]
            else:
                out.append(line)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words: letters after at most one space are one pre-token, so they go straight to the model, spelled in one go."""
        if not words:
            return []
        spelled = self.spelling[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        tokenize, code = self.library.model.tokenize, self.dtype.char
        found = [[x.id for x in tokenize(w)] for w in spelled.split(self.line_feed)]
        raw, size, out, at = array(code, chain.from_iterable(found)).tobytes(), self.dtype.itemsize, [], 0
        for ids in found:
            end = at + size * len(ids)
            out.append(raw[at:end])
            at = end
        return out

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of new pieces, each given by what follows its space; one without a space before it starts with a space here."""
        atoms, old, punctuation = self.atoms, self.old_atoms, self.PUNCTUATION
        words: dict[str, None] = {}
        others: dict[str, None] = {}
        pieces: list = []
        for key in new:
            if key.isalpha():
                a = " " + key
                pieces.append(a)
                if a not in atoms:
                    if a in old:
                        atoms[a] = old[a]
                    else:
                        words[a] = None
                continue
            stem = key.rstrip(punctuation)
            parts = (" " + stem, key[len(stem) :]) if stem.isalpha() else self.cut(key[1:] if key[:1] == " " else " " + key)
            pieces.append(parts)
            for a in parts:
                if a not in atoms:
                    if a in old:
                        atoms[a] = old[a]
                    elif a.isalpha() or a[:1] == " " and a[1:].isalpha():
                        words[a] = None
                    else:
                        others[a] = None
        listed = list(words)
        atoms.update(zip(listed, self._words(listed)))
        listed = list(others)
        for k in range(0, len(listed), 4096):
            part = listed[k : k + 4096]
            atoms.update(zip(part, self._library(part)))
        return [atoms[x] if type(x) is str else b"".join([atoms[a] for a in x]) for x in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._library(texts)
        collects = gc.isenabled()
        gc.disable()  # hundreds of thousands of short lists and no cycle: searching for cycles is lost time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        self._age()
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, text in enumerate(texts) if text and self.plain(text)]
        odd = sorted(set(range(len(texts))).difference(plain))
        for i, ids in zip(odd, self._library([texts[i] for i in odd])):
            out[i] = ids
        heads = self._learn([" " + texts[i].partition(" ")[0] for i in plain])  # no other piece has a space
        # what follows them: every piece begins with its space
        tails = ["".join(texts[i].partition(" ")[1:]) for i in plain]
        raw = np.frombuffer("".join(tails).encode(), np.uint8)
        starts = np.flatnonzero(raw == 32)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        hashes, first, inverse = np.unique(hash_runs(raw, starts + 1, ends), return_index=True, return_inverse=True)

        def spelled(which: np.ndarray) -> list[str]:
            a, b = starts[first[which]], ends[first[which]]
            stop = np.cumsum(b - a)
            return raw[np.repeat(a - stop + b - a, b - a) + np.arange(stop[-1])].tobytes().decode().split(" ")[1:]

        at = self._places(hashes, spelled)[inverse]
        length = self.length[at]
        ids = self._gathered(self.offset[at], length)
        bounds = np.concatenate([[0], np.cumsum(length)])[np.cumsum([0, *(t.count(" ") for t in tails)])]
        for i, head, a, b in zip(plain, heads, bounds[:-1], bounds[1:]):
            out[i] = head + ids[a:b].tobytes()
        return out


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([end_id], t.dtype).tobytes()

        def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            ids = [x + end for x in t.encode([s or "" for s in rows.column(1).to_pylist()])]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), pa.array(ids, pa.binary())],
                ["key", "part", "seq", "ids"],
            )
            seq += n

        yield from by_slices(work, SLICE_BYTES)(batches)  # a byte of text takes some sixty while its pieces are hashed

    return run


def tokenise(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Stored rows (key, part, seq, ids) in ascending key order: part and seq number the rows of the order.

    Null texts are empty; every document ends with ``end_id``. Null keys come first;
    equal keys stand in no stated order. Texts move once, range-partitioned by key.
    """
    rows = keyed_text(docs, key, text)
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.repartitionByRange("key").sortWithinPartitions("key")
    return stored(rows.mapInArrow(_tokenise(path, end_id), f"key {kind}, part int, seq long, ids binary"), "token-ids", compression="zstd")


def id_counts(tokens: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    """How often each id occurs in all documents: as many sums as the vocabulary has ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(blob, dtype), minlength=size) if len(blob) > size else 0
                if len(blob) <= size:
                    np.add.at(total, np.frombuffer(blob, dtype), 1)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], ["id", "n"])

    found = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return counts


BLOCKS = "part int, seq long, n_ids long, keys array<{kind}>, lengths array<long>, lanes int, states binary, words binary, crc long"


def _encode_blocks(table, dtype: np.dtype):
    """Blocks of consecutive documents; one starts anew with each part and after ``BLOCK_IDS`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, blobs, head, size = [], [], None, 0

        def block(kind: pa.DataType) -> pa.RecordBatch:
            raw = b"".join(blobs)
            ids = np.frombuffer(raw, dtype).astype(np.int64)
            lanes, states, words = encode(ids, table.value)
            one = lambda v, t: pa.array([v], t)
            return pa.RecordBatch.from_arrays(
                [
                    one(head[0], pa.int32()), one(head[1], pa.int64()), one(len(ids), pa.int64()),
                    one(keys, pa.list_(kind)), one([len(b) // dtype.itemsize for b in blobs], pa.list_(pa.int64())),
                    one(lanes, pa.int32()), one(states.astype("<u8").tobytes(), pa.binary()),
                    one(words.astype("<u4").tobytes(), pa.binary()), one(zlib.crc32(ids.astype("<u4").tobytes()), pa.int64()),
                ],
                ["part", "seq", "n_ids", "keys", "lengths", "lanes", "states", "words", "crc"],
            )

        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for key, part, seq, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if head and (part != head[0] or size >= BLOCK_IDS * dtype.itemsize):
                    yield block(kind)
                    keys, blobs, head, size = [], [], None, 0
                head = head or (part, seq)
                keys.append(key)
                blobs.append(blob)
                size += len(blob)
        if head:
            yield block(kind)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Tokenise ``docs`` with the vocabulary file and write the format to ``path``."""
    t = tokenizer(vocabulary)
    tokens = tokenise(docs, vocabulary, key, text, end_id)
    spark = docs.sparkSession
    table = Table.from_counts(id_counts(tokens, t.size, t.dtype))
    shared = spark.sparkContext.broadcast(table)
    kind = tokens.schema["key"].dataType.simpleString()
    blocks = tokens.mapInArrow(_encode_blocks(shared, t.dtype), BLOCKS.format(kind=kind))
    # states and words are as dense as they get
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    row = [(key, table.freq.astype("<i8").tobytes())]
    spark.createDataFrame(row, "key string, freq binary").coalesce(1).write.parquet(f"{path}/table")


def _decode_blocks(table, summary: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, seq, n, _, lengths, _, states, words, crc = (batch.column(k)[i] for k in range(9))
                ids = decode(n.as_py(), np.frombuffer(states.as_py(), "<u8"), np.frombuffer(words.as_py(), "<u4"), table.value)
                if zlib.crc32(ids.astype("<u4").tobytes()) != crc.as_py():
                    raise ValueError(f"block {part}/{seq} is damaged")
                sizes = lengths.values.to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes)])
                pieces = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts[:-1], starts[1:])]
                value = pa.array([zlib.crc32(x) for x in pieces], pa.int64()) if summary else pa.array(pieces, pa.binary())
                many = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(3)[i].values, pa.array([part.as_py()] * many, pa.int32()), pa.array([seq.as_py()] * many, pa.int64()),
                     pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64()), value],
                    ["key", "part", "seq", "offset", "n_tokens", "value"],
                )

    return run


def read_tokens(spark: SparkSession, path: str, checksums_only: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids) from files; with ``checksums_only`` ids_crc32 instead of ids.

    ``start`` counts the ids of all documents before: sums within a part, then over parts.
    """
    row = spark.read.parquet(f"{path}/table").first()
    table = spark.sparkContext.broadcast(Table(np.frombuffer(row["freq"], "<i8")))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    value = "long" if checksums_only else "binary"
    names = blocks.columns
    docs = blocks.select(*names).mapInArrow(_decode_blocks(table, zlib.crc32 if checksums_only else None),
                                             f"key {kind}, part int, seq long, offset long, n_tokens long, value {value}")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("part", "seq", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("earlier"))
    heads = heads.join(parts, F.col("part") == F.col("_p")).select(F.col("part").alias("_p"), F.col("seq").alias("_s"), (F.col("before") + F.col("earlier")).alias("first"))
    docs = docs.join(heads, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")))
    last = F.col("value").alias("ids_crc32" if checksums_only else "ids")
    return docs.select(F.col("key").alias(row["key"]), (F.col("first") + F.col("offset")).alias("start"), "n_tokens", last)


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Write ``docs`` to fresh files in the shared folder and read them back: key, start, n_tokens, ids_crc32."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, key, text, end_id)
    return read_tokens(docs.sparkSession, path, checksums_only=True)
