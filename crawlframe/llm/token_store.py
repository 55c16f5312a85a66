"""Token ids in binary shard files with a minimal perfect hash index for keyed access.

Documents are range-partitioned by key and sorted, so shard files in name order hold ascending keys. A file is

    "CFIDS001", then u64: documents, ids, bytes of an id, bytes of the index
    payload: the ids, little-endian unsigned, one document after another
    keys: i64 per document (a null key is stored as the least value; so a document may not have that key)
    starts: u64 per document and one more, in ids
    index: u64 levels; u64 bits of each level; the levels' bit arrays; per slot u32 row, u32 fingerprint

The index is a cascade of bit arrays: a key that alone hashes to a position of a level is placed there, the others go on
to the next level. The rank of its bit is its slot, which holds the row and a fingerprint that rejects unknown keys.

Files are written under a temporary name and renamed, so a task that runs again replaces its file by an equal one.

Defined cases: a null or empty text is the end id alone; repeated keys are all stored and the index finds the first; an
empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import in_small_batches, save, scratch_path
from crawlframe.llm.tokens import Encoder, default_vocabulary, in_slices

MAGIC = b"CFIDS001"
NULL_KEY = -(2**63)
END_ID = 0
#: Files whose bounds are sent to all tasks at most.
MAX_FILES = 10_000_000
SHARD_BYTES = 32_000_000
GAMMA = 2.0


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of key and seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1 without collisions."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            total = int(self.ranks[-1][-1])
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels = []
        while len(keys):
            size = max(64, int(GAMMA * len(keys)) + 63 & ~63)
            at = (_mix(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that no level holds. Other unknown keys need the fingerprint."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *(len(x) for x in self.levels)], "<u8").tobytes()
        return sizes + b"".join(np.packbits(x, bitorder="little").tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple["PerfectHash", int]:
        """The index and how many bytes it took."""
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        at, levels = 8 * (n + 1), []
        for size in np.frombuffer(raw, "<u8", n, 8).astype(int):
            levels.append(np.unpackbits(np.frombuffer(raw, "u1", size // 8, at), bitorder="little").astype(bool))
            at += size // 8
        return cls(levels), at


def shard_bytes(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A whole file: ids are little-endian u32 per document, stored with width bytes each."""
    if NULL_KEY in keys:
        raise ValueError(f"{NULL_KEY} stands for a null key and can't be a document's")
    counts = np.array([len(x) // 4 for x in ids], np.int64)
    whole = np.frombuffer(b"".join(ids), "<u4")
    if len(whole) and int(whole.max()) >= 1 << 8 * width:
        raise ValueError(f"id {whole.max()} does not fit {width} bytes")
    payload = whole.astype(f"<u{width}").tobytes()
    stored = np.array([NULL_KEY if k is None else k for k in keys], "<i8")
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    known, rows = np.unique(stored[stored != NULL_KEY], return_index=True)
    rows = np.flatnonzero(stored != NULL_KEY)[rows]
    hashed = known.view(np.uint64)
    perfect = PerfectHash.build(hashed)
    slot = perfect.slots(hashed)
    row, mark = np.empty(len(known), "<u4"), np.empty(len(known), "<u4")
    row[slot], mark[slot] = rows, _fingerprint(hashed)
    index = perfect.to_bytes() + row.tobytes() + mark.tobytes()
    head = np.array([len(keys), int(starts[-1]), width, len(index)], "<u8").tobytes()
    return MAGIC + head + payload + stored.tobytes() + starts.tobytes() + index


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """Where a path of Spark's lies for Python workers: s3a and s3n are s3, dbfs is mounted at /dbfs."""
    scheme, _, rest = path.partition(":")
    if scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    elif scheme == "dbfs":
        path = f"file:///dbfs/{rest.lstrip('/')}"
    return fs.FileSystem.from_uri(path)


class Shard:
    """A file of ids, open for reading."""

    def __init__(self, path: str):
        store, at = store_of(path)
        self.file = store.open_input_file(at)
        head = self.file.read(40)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no id shard")
        self.n_docs, self.n_ids, self.width, self.index_bytes = map(int, np.frombuffer(head, "<u8", 4, 8))
        self.keys_at = 40 + self.n_ids * self.width
        self.perfect = None

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def keys(self) -> list[int | None]:
        return [None if k == NULL_KEY else k for k in np.frombuffer(self._read(self.keys_at, 8 * self.n_docs), "<i8").tolist()]

    def starts(self) -> np.ndarray:
        return np.frombuffer(self._read(self.keys_at + 8 * self.n_docs, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._read(40 + start * self.width, (end - start) * self.width), f"<u{self.width}").astype("<u4")

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 for keys that aren't here: one probe of the index for all, and the fingerprints."""
        if self.perfect is None:
            raw = self._read(self.keys_at + 16 * self.n_docs + 8, self.index_bytes)
            self.perfect, used = PerfectHash.from_bytes(raw)
            self.row = np.frombuffer(raw, "<u4", self.perfect.n, used)
            self.mark = np.frombuffer(raw, "<u4", self.perfect.n, used + 4 * self.perfect.n)
        hashed = np.asarray(keys, np.int64).view(np.uint64)
        if not self.perfect.n:
            return np.full(len(hashed), -1, np.int64)
        slot = self.perfect.slots(hashed)
        known = (slot >= 0) & (self.mark[slot] == _fingerprint(hashed))
        return np.where(known, self.row[slot].astype(np.int64), -1)

    def lookup(self, key: int) -> np.ndarray | None:
        """The ids of a document by its key: one probe of the index and two short reads; None if it isn't here."""
        row = int(self.rows(np.array([key]))[0])
        if row < 0:
            return None
        start, end = map(int, np.frombuffer(self._read(self.keys_at + 8 * (self.n_docs + row), 16), "<u8"))
        return self.ids(start, end)


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, width: int = 2, shard_bytes_goal: int = SHARD_BYTES) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shard files under path in ascending doc_id order.

    Returns one row per file: ``(path, n_docs, n_ids, least_key, most_key, first_id)``, first_id counting the ids of all
    files before it; the keys are null where a file has only null keys. An id that does not fit width bytes is an error.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        store, root = store_of(path)
        store.create_dir(root, recursive=True)
        keys, ids, size, made = [], [], 0, []

        def flush() -> None:
            nonlocal keys, ids, size
            name = f"{root}/shard-{part:06d}-{len(made):06d}.ids"
            with store.open_output_stream(new := f"{name}.{uuid.uuid4().hex}") as out:
                out.write(shard_bytes(keys, ids, width))
            store.move(new, name)
            known = [k for k in keys if k is not None]
            made.append((f"{path}/{name.rpartition('/')[2]}", len(keys), sum(map(len, ids)) // 4, min(known, default=None), max(known, default=None)))
            keys, ids, size = [], [], 0

        for batch in batches:
            some, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                for key, got in zip(some[a:b], encoder.encode(texts[a:b]), strict=True):
                    keys.append(key)
                    ids.append(got + end)
                    size += (len(got) + 4) // 4 * width
                if size >= shard_bytes_goal:
                    flush()
        if keys:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), *[pa.int64()] * 4))], names=["path", "n_docs", "n_ids", "least_key", "most_key"])

    sorted_docs = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = save(in_small_batches(sorted_docs).mapInArrow(run, "path string, n_docs long, n_ids long, least_key long, most_key long"), "id-files")
    # One row per file, so this window is small however large the corpus is.
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of the files: ``(doc_id, start, n_tokens, ids_crc32)``.

    The keys of a file are looked up through its index, all at once, and each document's ids are read where the index says.
    A later row of a repeated key, or one with a null key, is not indexed and is read at its own place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(path)
                keys, starts = shard.keys(), shard.starts()
                stored = np.array([NULL_KEY if k is None else k for k in keys], np.int64)
                rows = np.arange(len(keys))
                single = np.concatenate([[True], stored[1:] != stored[:-1]])[: len(keys)] & (stored != NULL_KEY)
                rows[single] = shard.rows(stored[single])
                if (rows < 0).any():
                    raise ValueError(f"{path}: a stored key is not in the index")
                payload = shard.ids(0, shard.n_ids)
                begin, end = starts[rows], starts[rows + 1]
                crc = [zlib.crc32(payload[a:b].tobytes()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(begin + first), pa.array(end - begin), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("path", "first_id").repartition(F.col("path"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(files: DataFrame, keys: DataFrame) -> DataFrame:
    """``(doc_id, ids)`` for ``keys(doc_id)``: the first document of each different key, fetched through the index.

    A key goes to the first file whose range of keys holds it, found by halving in the files' bounds: 16 bytes for each file,
    which is 32 MB of ids, so that MAX_FILES are 160 MB and stand for 320 TB. More files than that are joined by their ranges.
    Unknown and null keys have no row.
    """

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(pairs["path"].iloc[0])
        ask = pairs["doc_id"].to_numpy(np.int64)
        rows = shard.rows(ask)
        starts = shard.starts()
        got = [(int(k), shard.ids(int(starts[r]), int(starts[r + 1])).astype(np.int64)) for k, r in zip(ask, rows, strict=True) if r >= 0]
        return pd.DataFrame({"doc_id": [k for k, _ in got], "path": [pairs["path"].iloc[0]] * len(got), "ids": [x for _, x in got]})

    wanted = keys.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    known = files.where("least_key is not null").select("path", "least_key", "most_key")
    if known.count() <= MAX_FILES:
        bounds = known.toPandas().sort_values("path")
        shared = keys.sparkSession.sparkContext.broadcast((bounds["path"].to_numpy(str), bounds["least_key"].to_numpy(np.int64), bounds["most_key"].to_numpy(np.int64)))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            paths, least, most = shared.value
            for batch in batches:
                ask = batch["doc_id"].to_numpy(np.int64)
                at = np.searchsorted(most, ask)
                held = at < len(most)
                held[held] = least[at[held]] <= ask[held]
                yield pd.DataFrame({"doc_id": ask[held], "path": paths[at[held]]})

        places = wanted.mapInPandas(place, "doc_id long, path string")
    else:
        places = wanted.join(known, F.col("doc_id").between(F.col("least_key"), F.col("most_key")))
    found = places.select("doc_id", "path").groupBy("path").applyInPandas(run, "doc_id long, path string, ids array<long>")
    return found.groupBy("doc_id").agg(F.min_by("ids", "path").alias("ids"))


def encode_and_read_back(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return read_ids(write_ids(docs, scratch_path(docs.sparkSession, "ids"), vocabulary))
