"""Sharding, the prefix trie and token alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from crawlframe.llm import entry, prefix_trie, sharding, token_alignment

DATA = "/root/testdata/sf0.001"


def docs_of(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


# Sharding


def plain_shards(rows, shards):
    """Counter of (doc_id, size, crc, shard, slot): rows in the order of digest and id, cut where the bytes are equal."""
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(rows, key=lambda r: (" " if r[1] is None else hashlib.md5(r[1].encode()).hexdigest(), r[0] is not None, r[0] or 0))
    total, most = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    alike = Counter(t for _, t in rows)
    start, first, slots, out = 0, {}, Counter(), []
    for number, text in order:
        own = size(text)
        whole = alike[text] * own <= most
        begin = first.setdefault(text, start) if whole else start
        shard = (2 * begin + (own * alike[text] if whole else own)) * shards // (2 * total)
        out.append((number, own, zlib.crc32((text or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        start += own
    return out


def shard_rows(seed=3):
    some = random.Random(seed)
    rows = [(i, "".join(some.choice("abé \n") for _ in range(some.randrange(400)))) for i in range(300)]
    rows += [(1000 + i, "the same text again and again") for i in range(200)]  # a third of all rows
    rows += [(7, "one row many times over")] * 90 + [(None, "no id"), (None, None), (2000, None), (2001, ""), (2002, "long " * 300)]
    return rows


@pytest.mark.parametrize("ranges, rows_of_range, samples", [(16, 2_000_000, 8), (1, 20, 1), (4, 3, 2)])
def test_shards_do_not_depend_on_the_splitters(spark, monkeypatch, ranges, rows_of_range, samples):
    monkeypatch.setattr(sharding, "SHARD_RANGES", ranges)
    monkeypatch.setattr(sharding, "RANGE_ROWS", rows_of_range)
    monkeypatch.setattr(sharding, "RANGE_SAMPLES", samples)
    rows = shard_rows()
    got = sharding.report(docs_of(spark, rows), 7).collect()
    plain = lambda found: Counter((n, s, c, k) for n, s, c, k, _ in found)
    assert plain((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == plain(plain_shards(rows, 7))
    held, mean = Counter(), sum(r["size"] for r in got) / 7
    for r in got:
        held[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    assert all(abs(b - mean) <= max(r["size"] for r in got) for b in held.values())
    for k in held:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_shards_of_odd_tables(spark, tmp_path):
    assert sharding.report(docs_of(spark, [])).count() == 0
    one = sharding.report(docs_of(spark, [(5, None)])).collect()
    assert [(r.doc_id, r["size"], r.text_crc32, r.slot) for r in one] == [(5, 16, 0, 0)]
    odd = docs_of(spark, [(i, f"text {i}", i, "x") for i in range(50)], ", shard int, slot string")
    assert Counter(r.shard for r in sharding.report(odd, 5).collect()).keys() == set(range(5))
    sharding.write_shards(docs_of(spark, [(i, f"text {i}") for i in range(50)]), str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and {r.shard for r in back.select("shard").distinct().collect()} == set(range(5))


def test_range_of_counts_splitters(spark):
    keys = [chr(97 + i) for i in range(26)]
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    for splitters in ([], ["c"], ["b", "d", "e"], keys[1:25:2]):
        got = frame.select("key", sharding.range_of(frame["key"], splitters).alias("r")).collect()
        assert all(r.r == sum(s <= r.key for s in splitters) for r in got)


# Prefix trie


def plain_trie(rows):
    """Nodes of the rebuilt conversations, by dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", (text or "")[:64], hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[5]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)

    def below(key):
        return [key] + [x for c in children[key] for x in below(c)]

    out = []
    for key, convs in members.items():
        under = below(key)
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), len(children[key]), sum(not children[k] for k in under), saved, digest))
    return Counter(out)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_rows():
    some = random.Random(5)
    rows = []
    for c in range(0, 330):
        for t in range(some.randrange(1, 9)):
            rows.append((c, t, some.choice(["user", "assistant", None]), some.choice(["hi", "go on", None, "ünd?"])))
    rows += [(400 + i, t, "user", f"common {t}") for i in range(150) for t in range(7)]  # a group of copies
    rows += [(9, t, "user", f"long {t % 3}") for t in range(200)]  # one very long conversation
    rows += [(777, None, "user", "no number"), (777, 1, "user", "a"), (777, 1, "user", "a"), (778, 0, None, None), (None, 0, "user", "no id")]
    return rows


@pytest.mark.parametrize("shard, block", [(1024, 64), (7, 3), (1, 1)])
def test_trie_equals_the_plain_one(spark, monkeypatch, shard, block):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", shard)
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    rows = conversation_rows() if block > 1 else conversation_rows()[:300]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.report(table).select(*TRIE).collect()
    assert Counter(tuple(r) for r in got) == plain_trie(rows)


def test_trie_of_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string, pos int, key string"
    assert prefix_trie.report(spark.createDataFrame([], kind)).count() == 0
    rows = [(3, 0, "user", "a", 1, "x"), (3, 1, "user", "b", 2, "y"), (100, 0, "user", "a", 3, "z")]
    got = prefix_trie.report(spark.createDataFrame(rows, kind)).select(*TRIE).collect()
    assert Counter(tuple(r) for r in got) == plain_trie([r[:4] for r in rows])


# Token alignment


def plain_alignment(rows):
    """By whole encodings and one walk over the bytes of each text, no windows."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, counts = {}, Counter()
    for number, text in rows:
        if not text:
            continue
        raw = f" {text}".encode()
        a = a_model.encode(f" {text}", add_special_tokens=False).ids
        b = b_model.encode(text)
        a_bytes = token_alignment.byte_level_bytes([a_model.id_to_token(i) for i in a])
        b_bytes = token_alignment.piece_bytes([b_model.id_to_piece(i) for i in b])
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            continue
        places = []
        for tokens in (a_bytes, b_bytes):
            at, own = 0, []
            for t in tokens:
                at += len(t)
                own.append(at)
            places.append(own)
        shared = sorted(set(places[0]) & set(places[1]))
        groups, links, i, j = [], [], 0, 0
        for end in shared:
            k, l = places[0].index(end) + 1, places[1].index(end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:l])))
            links.append((a[k - 1], b[l - 1]))
            i, j = k, l
        found.setdefault(number, (len(a), len(b), groups, links))
        counts.update(links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = Counter()
    for number, _ in rows:
        if number in found:
            n_a, n_b, groups, links = found[number]
            out[number, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()] += 1
        else:
            out[number, 0, 0, 0, 0, 0, 0, ""] += 1
    return out


ODD = [None, "", " ", "  two  spaces ", "\n", "a\n\nb \n c", "tab\there", "▁mark", "ﬁ ① 你好，世界。", "<s>hi</s> <|endoftext|>", "x" * 300, "<0x41>", "\x00null", "no　break\xa0space", "é é", "🙂🙃 ok", "1234567890 12,3", "don't DON'T", "a" + " b" * 2000, "zero​width"]
ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_the_plain_one(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (50, "twice"), (50, "twice")]
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()
    rows += [(1000 + r.doc_id, r.text) for r in given]
    got = token_alignment.report(docs_of(spark, [(*r, "x") for r in rows], ", links string")).select(*ALIGNED).collect()
    assert Counter(tuple(r) for r in got) == plain_alignment(rows)


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.report(docs_of(spark, [])).count() == 0


def test_windows_are_remembered_by_their_ids(monkeypatch):
    aligner = token_alignment.Aligner.of(token_alignment.default_vocabulary(), token_alignment.default_pieces())
    aligner.memo.clear()
    first = list(aligner.align(["one two one two one"]))
    assert 0 < len(aligner.memo) <= 4
    monkeypatch.setattr(token_alignment, "MEMO_WINDOWS", 0)
    assert list(aligner.align(["one two one two one"])) == first


def test_queries_of_these_operators_are_registered():
    assert {"op11_sampled_splitters", "op12_vertical_bitmap_trie", "op13_token_anchors"} <= entry.queries().keys()
