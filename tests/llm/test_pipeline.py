"""Each stage of the pipeline against a plain version of it, on the rows that the stage before it kept."""

import random
import tempfile

import corpus_pipeline
from crawlframe.llm import common
from tests.llm.test_llm_pairs import WORDS, near, plain_classes, plain_hits, plain_recurring, texts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(31)
    rows = []
    for i in range(60):
        lines = texts(5, 500 + i, 14)
        if i % 3 == 0:
            lines.insert(rng.randrange(6), f"Copyright {1990 + i} by the makers of this site")
        rows.append((i, "\n".join(lines), "xx"))
    rows += [(100 + i, near(rows[1][1].replace("\n", " ") + " " + " ".join(rng.choices(WORDS, k=90)), rng, 0), "xx") for i in range(2)]
    base = " ".join(rng.choices(WORDS, k=120))
    rows += [(200 + i, near(base, rng, i % 3), "xx") for i in range(12)]
    item = " ".join(rng.choices(WORDS, k=20))
    rows += [(300, f"{rows[7][1]} {item} end", "xx"), (301, f"{rows[8][1]} {item[3:90].upper()} end", "xx")]
    rows += [(400, "123 456 !?", "xx"), (401, None, None), (402, "", "xx"), (403, rows[3][1] * 40, "xx")]
    rows += [(500 + i, "".join(rng.choices("zyéü ", k=300)), "yy") for i in range(20)]
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows], [(1, item), (2, None)]


def plain_stage(name, rows, items):
    """The (doc_id, text) that a stage keeps."""
    if name == "language_id":
        return {(d, t) for d, t, *_ in rows if t and any(map(str.isalpha, t))}
    if name == "line_dedup":
        drop = plain_recurring([(d, t) for d, t, *_ in rows])
        kept = {(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (t, i) not in drop)) for d, t, *_ in rows}
        return {(d, t) for d, t in kept if t.strip()}
    if name == "ngram_jaccard_join":
        least = {d: c for d, _, c in plain_classes([(d, t) for d, t, *_ in rows])}
        return {(d, t) for d, t, *_ in rows if least[d] == d}
    return {(d, t) for d, t, *_ in rows if not plain_hits(t, items)[1]}


def test_stages_equal_plain_versions(spark):
    rows, items = corpus()
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = common.save(stage(spark, docs, folder), name)
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        after = [tuple(r) for r in docs.collect()]
        assert len(after) == len({r[0] for r in after}) and {r[:2] for r in after} == plain_stage(name, before, items), name
        assert len(after) < len(before) or name == "line_dedup"
    kept = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == kept and all(r.length <= 1024 for r in packed)


def write(spark, rows, schema, items):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_of_empty_tables(spark):
    folder = write(spark, [], COLUMNS, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns and stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_with_odd_rows_and_clashing_columns(spark):
    """Nulls in every column, repeated rows, and columns that are called as the stages' own."""
    schema = COLUMNS + ", node string, row int, spans string, dropped int, lang_pred string, score double, piece int, component_id long"
    more = ("n", 1, "s", None, "xx", 0.5, 7, None)
    plain = [(d, t, lang, "s", len(t)) for d, t, lang in ((i, " ".join(texts(1, 70 + i, 40)), "xx") for i in range(25))]
    rows = [(*r, *more) for r in plain]
    odd = [plain[3], plain[3], (None, plain[4][1], "xx", None, None), (None, None, None, None, None), (77, None, "xx", "s", 0), (78, "", None, "s", 0), (79, "word " * 3000, None, None, None)]
    rows += [(*r, *[None] * len(more)) for r in odd]
    folder = write(spark, rows, schema, [(1, None), (None, "never seen here at all by anyone who reads this line")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.save(stage(spark, kept, folder), name)
        assert kept.columns == docs.columns
    got = kept.collect()
    assert sum(r.doc_id == 3 for r in got) == 3 and sum(r.doc_id is None for r in got) == 1
    assert not any(r.text is None or r.text == "" for r in got) and {r.doc_id for r in got} >= {79, *range(25)}
    assert all(r.row == 1 for r in got if r.doc_id in range(25) and r.node is not None)
    packed = corpus_pipeline.run(spark, folder).collect()
    # Every document's pieces are whole and in order, and sequences are gapless.
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_doc[79])[1:] and all(n == 1024 for _, _, n in sorted(by_doc[79])[1:])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
