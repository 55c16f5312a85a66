"""Benchmark decontamination: an FM-index per training shard, searched for the windows of benchmark items.

A shard is what one task reads, up to a bounded number of words. Document words that no benchmark item of the block uses
cannot lie in an occurrence, so a shard keeps only its runs of known words that are at least as long as the shortest
window, cut into overlapping pieces of bounded length (which bounds the rounds of suffix sorting). Backward search steps
through wavelet-matrix ranks for all windows at once; rows of the suffix order are turned into places by walking to a
sampled suffix position; overlapping occurrences merge into removal spans.

Benchmark items reach the executors in blocks of bounded size, one pass each, with what was found written between passes, so
that no worker ever holds more than one block. Nothing is shuffled. Of a block only windows whose words all stand in the shard
are searched.

Defined cases: a null text has no words and no hits; null or empty items have no window; rows of an item id count as one
item and a null item id as the item "null"; repeated documents are answered once per row; empty tables give no hits or no
rows; other columns of the documents are carried as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlframe.llm.common import in_small_batches, save
from crawlframe.llm.tokens import forget_encoders

WINDOW_WORDS = 10
#: Benchmark bytes that are sent to the executors at a time (some 60 MB of words and windows), and windows that are searched
#: at a time.
BLOCK_BYTES = 8_000_000
WINDOWS_AT_ONCE = 100_000
#: Known words, documents and bytes after which a shard is closed, and the longest piece of a run.
SHARD_WORDS = 1_000_000
SHARD_DOCS = 50_000
SHARD_BYTES = 16_000_000
PIECE_WORDS = 128
SAMPLE_EVERY = 8

#: Bytes of words: digits, letters and all beyond ASCII; A-Z count as a-z, all else separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.levels = len(symbols), []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = one
            packed = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((b, packed, before, self.n - int(one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for b, packed, before, zeros in self.levels:
            one = (symbols >> b & 1).astype(bool)
            ra, rl = self._ones(packed, before, at), self._ones(packed, before, low)
            at, low = np.where(one, zeros + ra, at - ra), np.where(one, zeros + rl, low - rl)
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for b, packed, before, zeros in self.levels:
            ones = self._ones(packed, before, at)
            one = packed[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)
            out |= one.astype(np.int64) << b
            at = np.where(one.astype(bool), zeros + ones, at - ones)
        return out


class FMIndex:
    """Full-text index of a sequence of symbols from 1 on; 0 ends a piece."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        order = self._suffix_order(text)
        last = text[order - 1]
        self.bwt = WaveletMatrix(last, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        known = (order % SAMPLE_EVERY == 0) | (last == 0)
        self.known, self.known_before = known, np.concatenate([[0], np.cumsum(known)])
        self.places = order[known]
        self.n = n

    @staticmethod
    def _suffix_order(text: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling; each end of a piece is a symbol of its own, so only pieces are compared."""
        n, ends = len(text), text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
        width = 1
        while True:
            ahead = np.full(n, 0, np.int64)
            ahead[: n - width] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2 + n) + ahead
            order = np.argsort(key, kind="stable")
            key = key[order]
            fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if fresh[-1] == n - 1:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            width *= 2

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows for the rows of a matrix of patterns."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j]
            low, high = self.first[c] + self.bwt.rank(c, low), self.first[c] + self.bwt.rank(c, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of rows: back through the text to the nearest sampled suffix."""
        out, steps, left = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            hit = self.known[rows]
            out[left[hit]] = self.places[self.known_before[rows[hit]]] + steps
            left, rows = left[~hit], rows[~hit]
            c = self.bwt.symbol(rows)
            rows = self.first[c] + self.bwt.rank(c, rows)
            steps += 1
        return out


class Windows:
    """The windows of a block of items: word ids in one array, where the different windows of each length begin, and of which items they are."""

    def __init__(self, items: list[tuple[str, str | None]], window_words: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        parts, by_length, size = [], {}, 0
        for item, text in items:
            words = words_of(text)
            if words:
                parts.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
                n = min(len(words), window_words)
                starts, owners = by_length.setdefault(n, ([], []))
                starts.append(np.arange(size, size + len(words) - n + 1))
                owners.append(np.full(len(starts[-1]), number[item], np.int32))
                size += len(words)
        self.ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        #: (words of a window, where each begins in ids, bounds of its items, items)
        self.groups = [(n, *self._different(np.concatenate(starts), np.concatenate(owners), n)) for n, (starts, owners) in sorted(by_length.items())]
        self.shortest = self.groups[0][0] if self.groups else 0
        self.longest = self.groups[-1][0] if self.groups else 0

    def _different(self, starts: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = []
        with np.errstate(over="ignore"):
            for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):  # 128 bits in all
                h = np.zeros(len(starts), np.uint64)
                for j in range(n):
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(seed) + self.ids[starts + j].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                hashes.append(h)
        order = np.lexsort((owners, *hashes))
        starts, owners, hashes = starts[order], owners[order], [h[order] for h in hashes]
        fresh = np.concatenate([[True], (hashes[0][1:] != hashes[0][:-1]) | (hashes[1][1:] != hashes[1][:-1])])
        kept = fresh | np.concatenate([[True], owners[1:] != owners[:-1]])
        window = np.cumsum(fresh)[kept] - 1
        bounds = np.searchsorted(window, np.arange(int(fresh.sum()) + 1))
        return starts[fresh].astype(np.int32), bounds.astype(np.int32), owners[kept]

    def present(self, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
        """Windows all of whose words are known, as (numbers, matrix of words, group), a bounded number at a time."""
        for group in self.groups:
            n, starts = group[:2]
            for a in range(0, len(starts), WINDOWS_AT_ONCE):
                words = self.ids[starts[a : a + WINDOWS_AT_ONCE, None] + np.arange(n)]
                ok = np.flatnonzero(known[words].all(axis=1))
                if len(ok):
                    yield ok + a, words[ok].astype(np.int64), group


class Shard:
    """Known-word runs of documents, and where they came from."""

    def __init__(self, windows: Windows):
        self.windows, self.pieces, self.doc_of, self.word_of, self.size = windows, [], [], [], 0

    def add(self, doc: int, words: list[bytes]) -> None:
        w = self.windows
        if not w.groups or len(words) < w.shortest:
            return
        ids = np.fromiter(map(w.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= w.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            while True:
                self.pieces += [ids[a : min(b, a + PIECE_WORDS + w.longest)], [0]]
                self.doc_of.append(doc)
                self.word_of.append(a)
                self.size += len(self.pieces[-2]) + 1
                if a + PIECE_WORDS + w.longest >= b:
                    break
                a += PIECE_WORDS + 1

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Document, first word, end and items of each occurrence."""
        out, items = [], []
        if self.pieces:
            text = np.concatenate(self.pieces).astype(np.int64)
            begin = np.concatenate([[0], np.flatnonzero(text == 0)[:-1] + 1])
            word_of, doc_of = np.array(self.word_of), np.array(self.doc_of)
            index = FMIndex(text, len(self.windows.vocabulary))
            known = np.zeros(len(self.windows.vocabulary) + 1, bool)
            known[text] = True
            for numbers, patterns, (n, _, bounds, owners) in self.windows.present(known):
                low, high = index.search(patterns)
                times = high - low
                which = numbers[np.repeat(np.arange(len(patterns)), times)]
                rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - low, times)
                at = index.locate(rows)
                piece = np.searchsorted(begin, at, "right") - 1
                start = word_of[piece] + at - begin[piece]
                out.append((doc_of[piece], start, start + n))
                items += [owners[bounds[i] : bounds[i + 1]] for i in which.tolist()]
        if not out:
            return np.empty(0, int), np.empty(0, int), np.empty(0, int), []
        return *(np.concatenate([o[i] for o in out]) for i in range(3)), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, str | None]]]]:
    """Different (item, text) rows in blocks, with whether it is the last; an empty benchmark is one empty block."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        yield b + 1 == n, [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect()]


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_FOUND_ARROW = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True, window_words: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document ``(row, n_words, spans, items)``.

    ``row`` holds the document's columns (without text unless keep_text), ``spans`` the merged word spans [start, end)
    to remove, ``items`` the sorted ids of items with a window that occurs.
    """
    spark = docs.sparkSession
    names = list(docs.columns)
    text_at = names.index("text")
    # Columns are carried in one struct, so their names cannot clash with those of the results.
    out = in_small_batches(docs).select(F.struct(*[docs[c] for c in names]).alias("row"), F.lit(None).cast(T.LongType()).alias("n_words"), *[F.array().cast(f.dataType).alias(f.name) for f in _FOUND.fields[1:]])
    for last, items in _blocks(benchmark, block_bytes):
        block = spark.sparkContext.broadcast(Windows(items, window_words))
        kept = [f for f in docs.schema.fields if f.name != "text" or keep_text or not last]
        schema = T.StructType([T.StructField("row", T.StructType(kept)), *_FOUND.fields])
        out = out.mapInArrow(_scan(block, text_at, len(kept) == len(names)), schema)
        if not last:
            out = save(out, "searched")
            block.unpersist()
    return out


def _scan(block, text_at: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        windows = block.value
        shard, held, n_docs = Shard(windows), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, held, n_docs
            doc, start, end, items = shard.hits()
            by_doc: dict[int, tuple[list, set]] = {}
            for d, s, e, i in zip(doc.tolist(), start.tolist(), end.tolist(), items, strict=True):
                spans, found = by_doc.setdefault(d, ([], set()))
                spans.append((s, e))
                found.update(i.tolist())
            at = 0
            for batch, counts in held:
                spans, found = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for k in range(len(counts)):
                    if more := by_doc.get(at + k):
                        spans[k] = [{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in spans[k]] + more[0])]
                        found[k] = sorted({*found[k], *(windows.items[i] for i in more[1])})
                at += len(counts)
                row = batch.column(0)
                if not whole:
                    fields = [f for i, f in enumerate(row.type) if i != text_at]
                    arrays = [row.field(i) for i in range(row.type.num_fields) if i != text_at]
                    row = pa.StructArray.from_arrays(arrays, fields=fields)
                arrays = [row, *(pa.array(x, t) for x, t in zip((counts, spans, found), _FOUND_ARROW, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "spans", "items"])
            shard, held, n_docs = Shard(windows), [], 0
            pa.default_memory_pool().release_unused()

        for batch in batches:
            counts = []
            for i, text in enumerate(batch.column(0).field(text_at)):
                words = words_of(text.as_py())
                counts.append(len(words))
                shard.add(n_docs + i, words)
            held.append((batch, counts))
            n_docs += len(counts)
            if shard.size >= SHARD_WORDS or n_docs >= SHARD_DOCS or sum(b.nbytes for b, _ in held) > SHARD_BYTES:
                yield from flush()
        yield from flush()

    return run


def n_hit(spans: Column) -> Column:
    """Words inside merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    found = find_contamination(docs, benchmark, **options)
    return found.where(F.size("spans") == 0).select("row.*")


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, keep_text=False, **options)
    return found.select(
        "row.doc_id",
        "n_words",
        n_hit(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
