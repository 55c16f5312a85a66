"""N-gram Jaccard join: grouped prefix join over word shingles, and the classes of linked documents.

1. A fixed-size count sketch of all shingles is added up over the corpus. Its coarse log counts, then the hash, order the
   shingles, rare ones first; any order that is a function of the shingle gives a lossless prefix filter.
2. Each document becomes its number of shingles n, a hash of its whole set, and the first n - ceil(t n) + 1 shingles in
   that order. Two sets with Jaccard similarity >= t share one of these. Documents with the same prefix and n collapse
   into one group; equal sets count once.
3. The prefixes of groups are dealt by shingle (shingles that the sketch knows as frequent are salted). In each bucket the
   row with the earliest position stands for it, and the others are paired with it alone. Groups are expanded to their
   sets and pairs verified on the whole texts. That links nearly all that can be linked, without all pairs of a bucket.
4. What is left is exhaustive: rows of a bucket that are still in different classes are paired when sizes and positions
   allow the similarity (within size classes, large ones salted), verified in the same way, and the links of both rounds give
   the classes.

No link between documents of different classes is missed: every pair that shares a prefix shingle is either verified,
ruled out by a bound, or already in one class.

Defined cases: null texts and texts without words have an empty set, link with nothing and stand alone; equal non-empty
sets link; a document with a null doc_id links with equal sets alone and never names a component that has other ids;
repeated rows are answered once each; an empty table gives no rows; other columns are carried by ``one_of_each`` and ignored otherwise.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import connected_components, in_small_batches, save
from crawlframe.llm.tokens import forget_encoders

SHINGLE_WORDS = 5
#: Similarity as a percentage, so that the comparison is exact.
PERCENT = 80
#: Buckets of the sketch (a power of two) and how many are in a slice of it.
SKETCH_BITS = 22
SLICE_BITS = 15
#: Rows of a frequent shingle that go to one task, about.
SALT_ROWS = 1000
#: A side of a join below so many bytes may be broadcast.
BROADCAST_BYTES = 16_000_000
MEMO_WORDS = 400_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_words = _WordHash()


def _forget() -> None:
    """At the end of a task: its worker may go on to tasks of other stages, which need the memory."""
    _words.clear()
    pa.default_memory_pool().release_unused()


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; of its whole word sequence if it has fewer words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    s = h[:n].copy()
    for i in range(1, width):
        s = (s ^ (s >> np.uint64(29))) * _MIX[i % len(_MIX)] + h[i : i + n]
    s = (s ^ (s >> np.uint64(32))) * _MIX[0]
    return np.unique(s ^ (s >> np.uint64(29)))


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def count_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Level of each bucket: eight times the binary logarithm of one plus the documents' shingles in it.

    Tasks send compressed slices of counts; the levels, 2^SKETCH_BITS bytes whatever the corpus, come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        held, size = [], 0

        def pour() -> None:
            nonlocal held, size, total
            if held:
                at, n = np.unique(_bucket(np.concatenate(held)), return_counts=True)
                total[at] += n.astype(np.int32)
            held, size = [], 0

        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), width))
                size += len(held[-1])
                if size > 1_000_000:
                    pour()
        pour()
        _forget()
        slices = total.reshape(-1, 1 << SLICE_BITS)
        full = np.flatnonzero(slices.any(axis=1))
        kind = np.uint8 if total.max() < 256 else np.uint32
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(slices[i].astype(kind).tobytes(), 1) for i in full], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(raw)
                part = np.frombuffer(raw, np.uint8 if len(raw) == 1 << SLICE_BITS else np.uint32)
                totals[i] = totals.get(i, 0) + part.astype(np.int64)
        levels = [np.minimum(255, np.round(8 * np.log2(1 + t))).astype(np.uint8).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], names=["slice", "levels"])

    sums = docs.select("text").mapInArrow(count, "slice int, counts binary").repartition("slice").mapInArrow(add, "slice int, levels binary")
    levels = np.zeros((1 << SKETCH_BITS - SLICE_BITS, 1 << SLICE_BITS), np.uint8)
    for row in sums.collect():
        levels[row[0]] = np.frombuffer(row[1], np.uint8)
    return levels.reshape(-1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def node_of(shingles: np.ndarray) -> bytes:
    """The id of a set: 128 bits, so that no two sets of any corpus share one."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def prefixes(docs: DataFrame, levels: np.ndarray, percent: int, width: int) -> DataFrame:
    """``(doc_id, n, node, gid, prefix, salts)`` per document; node stands for the set, gid for prefix and n."""
    sketch = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        level = sketch.value
        for batch in batches:
            n, node, gid, prefix, salts = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                if not len(s):
                    node.append(None), gid.append(None), prefix.append(np.empty(0, np.int64)), salts.append(np.empty(0, np.int16))
                    continue
                lv = level[_bucket(s)]
                order = np.argsort(lv.astype(np.uint64) << np.uint64(56) | s >> np.uint64(8), kind="stable")
                order = order[: len(s) - -(-len(s) * percent // 100) + 1]
                p = s[order]
                node.append(node_of(s))
                gid.append(_signed(xxhash.xxh3_64_intdigest(p.tobytes(), len(s))))
                prefix.append(p.view(np.int64))
                salts.append(np.clip(2.0 ** (lv[order] / 8.0) // SALT_ROWS, 0, 30_000).astype(np.int16))
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            both = [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x) if x else [], t)) for x, t in ((prefix, pa.int64()), (salts, pa.int16()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(gid, pa.int64()), *both], names=["doc_id", "n", "node", "gid", "prefix", "salts"])
        _forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, node binary, gid long, prefix array<long>, salts array<short>")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets have the similarity, from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = []
            for i in range(len(a)):
                left = shingle_set(batch.column(2)[i].as_py(), width)
                if last[0] != b[i] or node_of(last[1]) != b[i]:
                    last = [b[i], shingle_set(batch.column(3)[i].as_py(), width)]
                both = len(np.intersect1d(left, last[1], assume_unique=True))
                # Rows that share a doc_id bring each other's text, which is told by its set.
                ok.append(100 * both >= percent * (len(left) + len(last[1]) - both) and node_of(left) == a[i] and node_of(last[1]) == b[i])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(c, ok, strict=True) if y], pa.binary()) for c in (a, b)], names=["a", "b"])
        _forget()

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """The frame, to be broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _texts(docs: DataFrame, table: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text)``: one document's text for each of the nodes."""
    wanted = nodes.select("node").distinct()
    holders = save(table.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi"), "holders")
    found = docs.select("doc_id", "text").join(_small(holders, 40), "doc_id")
    return found.select("node", "text")


def _fits(n_a: str, pos_a: str, n_b: str, pos_b: str, percent: int):
    """Whether sizes, and positions as those of the first common shingle, allow the similarity."""
    most = F.least(F.col(n_a) - F.col(pos_a), F.col(n_b) - F.col(pos_b))
    return (100 + percent) * most >= percent * (F.col(n_a) + F.col(n_b))


def _size_class(n, percent: int):
    """Sizes in classes so wide that similar sets are in one class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (1.001 * max(0.01, math.log(100 / percent)))).cast("int")


def _expanded(pairs: DataFrame, members: DataFrame, single: bool = False) -> DataFrame:
    """Pairs of groups (ga, gb) to pairs of their sets (a, b), a < b."""
    left = members.select(F.col("gid").alias("ga"), F.col("node").alias("a"), *([] if single else [F.col("comp").alias("ca")]))
    right = members.select(F.col("gid").alias("gb"), F.col("node").alias("b"), *([] if single else [F.col("comp").alias("cb")]))
    both = pairs.join(left, "ga").join(right, "gb").where("a <> b" if single else "a <> b and ca <> cb")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id)`` per document."""
    table = _class_table(docs, percent, width)
    return table.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _class_table(docs: DataFrame, percent: int, width: int) -> DataFrame:
    base = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = count_sketch(base, width)
    table = save(prefixes(base, levels, percent, width), "prefixes")
    known = table.where("node is not null")

    # Sets by group, and groups with their prefix once.
    members = save(known.groupBy("gid", "node").agg(F.min("doc_id").alias("doc_id")), "members")
    # Different groups that chance gave one gid keep their own rows; their members are paired together, and verified.
    groups = known.groupBy("gid", "n", F.xxhash64("prefix").alias("own")).agg(F.first(F.arrays_zip("prefix", "salts")).alias("p"))
    rows = groups.select("gid", "n", F.posexplode("p").alias("pos", "x"))
    rows = rows.select("gid", "n", "pos", F.col("x.prefix").alias("token"), F.when(F.col("x.salts") > 0, F.pmod("gid", F.col("x.salts") + 1)).otherwise(0).alias("salt"), (F.col("x.salts") > 0).alias("hot"))
    bucket = Window.partitionBy("token", "salt").orderBy("pos", "gid")
    rows = rows.withColumns(
        {
            "rep": F.first(F.struct("pos", "n", "gid")).over(bucket),
            "next": F.lead("gid").over(bucket),
        }
    ).where(F.col("hot") | F.col("next").isNotNull() | (F.col("rep.gid") != F.col("gid")))
    shared = save(rows.select("token", "hot", "gid", "n", "pos", "rep"), "shared")

    # Round one: every row with the row that stands for its bucket, those of a salted shingle with the first of them.
    stars = shared.where("gid <> rep.gid").where(_fits("n", "pos", "rep.n", "rep.pos", percent)).select(F.col("gid").alias("ga"), F.col("rep.gid").alias("gb"))
    reps = shared.where("hot").select("token", "rep").distinct()
    heads = reps.groupBy("token").agg(F.min("rep").alias("head"))
    across = reps.join(heads, "token").where("rep.gid <> head.gid").where(_fits("rep.n", "rep.pos", "head.n", "head.pos", percent)).select(F.col("rep.gid").alias("ga"), F.col("head.gid").alias("gb"))
    leads = members.groupBy("gid").agg(F.min("node").alias("node"))
    pairs = _expanded(stars.union(across).distinct(), leads, single=True)
    inside = members.join(leads.withColumnRenamed("node", "lead"), "gid").where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    tried = save(pairs.union(inside), "pairs")
    edges = _check(docs, table, tried, percent, width, "edges")
    nodes = members.select("node").distinct()
    comp = save(connected_components(nodes, edges), "components")

    # Round two: rows of a bucket, and sets of a group, that are still in different classes.
    members = save(members.join(comp.withColumnRenamed("component", "comp"), "node"), "members-2")
    of_group = members.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    split = save(of_group.where("low <> high"), "split")
    open_rows = shared.join(of_group, "gid")
    state = open_rows.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    open_rows = save(open_rows.join(state.where("least <> most").select("token"), "token", "left_semi").select("token", "gid", "n", "pos", "low", "high"), "open")
    main = open_rows.groupBy("token", "low").count().groupBy("token").agg(F.max_by("low", F.struct("count", "low")).alias("main"))
    marked = open_rows.join(main, "token").withColumn("minor", (F.col("low") != F.col("main")) | (F.col("low") != F.col("high"))).withColumn("sized", _size_class(F.col("n"), percent))
    # Only rows of a size class and the next ones can be similar; a class with many rows is dealt over salts.
    loads = marked.groupBy("token", "sized").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"))
    loads = save(loads, "loads")
    near = loads.select("token", F.explode(F.array(F.col("sized") - 1, F.col("sized"), F.col("sized") + 1)).alias("asked"), "sized", "parts")
    fields = ("gid", "n", "pos", "low", "high")
    a = marked.where("minor").select("token", F.col("sized").alias("asked"), *[F.col(c).alias(f"{c}_a") for c in fields])
    a = a.join(near, ["token", "asked"]).drop("asked").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    b = marked.join(loads, ["token", "sized"]).select("token", "sized", F.pmod("gid", "parts").cast("int").alias("salt"), *[F.col(c).alias(f"{c}_b") for c in (*fields, "minor")])
    met = a.join(b, ["token", "sized", "salt"]).where("gid_a <> gid_b and (not minor_b or gid_a < gid_b) and not (low_a = low_b and low_a = high_a and low_b = high_b)")
    met = met.where(_fits("n_a", "pos_a", "n_b", "pos_b", percent)).select(F.col("gid_a").alias("ga"), F.col("gid_b").alias("gb")).distinct()
    more = _expanded(met.union(split.select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))), members)
    more = save(more.join(tried, ["a", "b"], "left_anti"), "pairs-2")
    if more.limit(1).count():
        edges = edges.unionAll(_check(docs, table, more, percent, width, "edges-2"))
        comp = save(connected_components(nodes, edges), "components-2")

    named = members.select("node", "doc_id").join(comp, "node")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = named.select("node", "component").distinct().join(least, "component").select("node", "component_id")
    return table.select("doc_id", "n", "node").join(names, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def _check(docs: DataFrame, table: DataFrame, pairs: DataFrame, percent: int, width: int, name: str) -> DataFrame:
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    texts = save(_texts(docs, table, ends), f"{name}-texts")
    return save(_verified(pairs, texts, percent, width), name)


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """The documents that name their class: one of each group of linked documents, with their own columns.

    Rows with equal doc_id stay or go together; rows with a null doc_id or an empty set stay.
    """
    table = _class_table(docs, percent, width)
    gone = save(table.where("node is not null and doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    kept = docs.join(_small(gone, 24), F.col("doc_id") == F.col("__gone"), "left_anti")
    return kept

