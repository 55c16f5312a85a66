"""Operators that work row by row or write files: round trips and plain versions."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from crawlframe.llm import chat_trees, common, packing, pii_crf, token_store, tokens

DOCS = "doc_id long, text string"
ROWS = [(5, "Hello there, it's me.\nA second line, 12 of it."), (1, None), (2, ""), (3, "a  b \n\n c\td"), (4, "word " * 3000), (None, "null id"), (7, "Same. Same,"), (7, "Same. Same,"), (8, "x" * 5000 + " é<|endoftext|>")]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_whole_encoding(plain):
    cases = [t for _, t in ROWS if t] + ["\n", " ", "a.", "don't stop.", "\n\na b", " lead", "trail ", "É. é, ñ!", "a​b c", "naïve—text ok", "tab\there", "w" * 60 + " y"]
    encoder = tokens.Encoder(tokens.default_vocabulary())
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(cases)] == [plain(t) for t in cases]


def test_special_strings_are_tokens_unless_asked_otherwise(plain):
    text = "a <|endoftext|>b\n<|endoftext|>"
    vocabulary = tokens.default_vocabulary()
    assert 50256 in plain(text) and np.frombuffer(tokens.Encoder(vocabulary).encode([text])[0], "<u4").tolist() == plain(text)
    as_text = Tokenizer.from_file(vocabulary)
    as_text.encode_special_tokens = True
    assert np.frombuffer(tokens.Encoder(vocabulary, True).encode([text])[0], "<u4").tolist() == as_text.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    own, cases = Tokenizer.from_file(path), ["Two words\nand a  line", "", "É x."]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(path).encode(cases)] == [own.encode(t, add_special_tokens=False).ids for t in cases]


def test_packing_is_whole_and_gapless(spark, plain):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, piece int").repartition(2)
    got = packing.pack(docs, open_sequences=2).collect()
    online = packing.pack(docs.coalesce(1), lookahead=0).orderBy("doc_id", "piece").drop("sequence_id", "offset")
    assert online.collect() == packing.pack(docs, lookahead=3).orderBy("doc_id", "piece").drop("sequence_id", "offset").collect()
    want = []
    for d, t in ROWS:
        ids = plain(t) + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(repr(d), i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


def plain_places(lengths, capacity, most_open):
    """Sequence and offset of each length: the list of all open sequences is searched every time."""
    open_, out, made = [], [], 0  # [free space, age of that space, id]
    for age, n in enumerate(lengths):
        fits = [s for s in open_ if s[0] >= n]
        if fits:
            least = min(s[0] for s in fits)
            s = max((s for s in fits if s[0] == least), key=lambda s: s[1])
        else:
            if len(open_) >= most_open:
                fullest = min(s[0] for s in open_)
                open_.remove(max((s for s in open_ if s[0] == fullest), key=lambda s: s[1]))
            s = [capacity, age, made]
            made += 1
            open_.append(s)
        out.append((s[2], capacity - s[0]))
        s[0], s[1] = s[0] - n, age
        if not s[0]:
            open_.remove(s)
    return out


@pytest.mark.parametrize("most_open", [1, 3, 50])
def test_places_equal_a_search_of_all_open_sequences(most_open):
    lengths = np.random.default_rng(most_open).integers(1, 21, 600).tolist()
    bins = packing.OpenSequences(20, most_open, 0)
    assert [bins.place(n) for n in lengths] == plain_places(lengths, 20, most_open)


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = packing.OpenSequences(10, 2, 0)
    assert [bins.place(n) for n in (6, 3, 1)] == [(0, 0), (0, 6), (0, 9)]
    assert bins.n_open == 0 and bins.free == 0
    assert [bins.place(n) for n in (7, 5, 9)] == [(1, 0), (2, 0), (3, 0)]  # 9 fits none: sequence 1, the fullest, closes
    assert bins.place(5) == (2, 5) and bins.place(1) == (3, 9)


def test_token_files_round_trip(spark, plain):
    docs = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, n_tokens int").repartition(3)
    path = common.scratch_path(spark, "ids-test")
    files = token_store.write_ids(docs, path, shard_bytes_goal=2000)
    got = sorted(tuple(r) for r in token_store.read_ids(files).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for d, t in order:
        ids = plain(t) + [0]
        want.append((at, d, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    shards = [token_store.Shard(r.path) for r in files.orderBy("path").collect()]
    for d, t in ROWS:
        if d is not None:
            found = [x for s in shards if (x := s.lookup(d)) is not None]
            assert found and found[0].tolist() == plain(t) + [0]
    assert all(s.lookup(12345) is None for s in shards)
    asked = token_store.fetch(files, spark.createDataFrame([(7,), (8,), (7,), (6,), (None,), (10**9,)], "doc_id long"))
    assert {r.doc_id: r.ids for r in asked.collect()} == {d: plain(t) + [0] for d, t in ROWS if d in (7, 8)}
    with pytest.raises(ValueError):
        token_store.shard_bytes([1], [np.array([70_000], "<u4").tobytes()], 2)
    with pytest.raises(ValueError):
        token_store.shard_bytes([token_store.NULL_KEY], [b""], 2)
    assert token_store.encode_and_read_back(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(5).integers(-(2**62), 2**62, 5000)).view(np.uint64)
    perfect = token_store.PerfectHash.build(keys)
    again, used = token_store.PerfectHash.from_bytes(perfect.to_bytes())
    assert sorted(again.slots(keys).tolist()) == list(range(len(keys))) and used == len(perfect.to_bytes())


# --- chat


def test_best_branch_of_a_tree(spark):
    rows = [("c", 1, None, "user", "hi", 0.0), ("c", 2, 1, "assistant", "a", 1.0), ("c", 3, 1, "assistant", "b", 2.0), ("c", 4, 2, "user", "deep", 5.0), ("c", 5, 3, "user", None, None), ("c", 8, 9, "user", "circle", 9.0), ("c", 9, 8, "user", "circle", 9.0), ("d", 1, 77, "assistant", "orphan", 0.0), (None, 1, None, "user", "no id", 0.0), ("null", 1, None, "user", "called null", 0.0)]
    messages = spark.createDataFrame(rows, "conv_id string, id long, parent long, role string, text string, score double")
    best = {r.conv_id: r for r in chat_trees.format_branches(messages).collect()}
    assert best["c"].leaf == 4 and best["c"].formatted == "### user: hi </turn>\n### assistant: a </turn>\n### user: deep </turn>\n"
    assert best["d"].formatted == "### assistant: orphan </turn>\n" and best[None].leaf == 1
    assert best[None].formatted == "### user: no id </turn>\n" and best["null"].formatted == "### user: called null </turn>\n"
    every = chat_trees.format_branches(messages, None).where("conv_id = 'c'").orderBy("rank").collect()
    assert [(r.leaf, r.path_score) for r in every] == [(4, 6.0), (5, 2.0)]
    assert chat_trees.format_branches(messages.limit(0)).count() == 0


def test_chat_reads_back(spark):
    odd = [r"\### Assistant: </turn> ok", "", None, "a\\", "# < \\< \n </turn>\n### user: x", "ends with space ", "émoji 😀"]
    rows = [(c, t, role, x) for c, (role, other) in enumerate([("user", "assistant"), ("a: b\\", None)]) for t, x in enumerate(odd) for role in ([role, other][t % 2],)]
    rows += [(9, 0, "assistant", "long " * 50_000), (9, 0, "assistant", "long " * 50_000), (None, None, "assistant", "x")]
    rows += [(20, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(90)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, id int")
    got = {r.conv_id: r for r in chat_trees.report(docs).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_trees.report(docs.limit(0)).count() == 0


# --- personal data

CARD = "4111 1111 1111 1111"


def test_base_spans():
    text = f"mail a.b@c.example.org, ip 10.0.0.255 not 10.0.0.256; card {CARD} not 4111 1111 1111 1112; call +1 (555) 010-2345 or +12"
    found = [(pii_crf.KINDS[k], text[s:e]) for k, s, e in pii_crf.base_spans(text)]
    assert found == [("email", "a.b@c.example.org"), ("ip", "10.0.0.255"), ("card", CARD), ("phone", "+1 (555) 010-2345")]
    assert pii_crf.base_spans("a@b.co._x@y.zz")[1] == (0, 6, 14)


def test_skip_links_find_what_patterns_miss(spark):
    rows = [(i, f"Dear all, call +1 555 01{i:02d} 2345 now or mail p{i}@mail.example.com today. In {1990 + i} we had {i} cats and 12 dogs.") for i in range(60)]
    rows += [(100, "Call +4915201234567 today.\n" + "plain words here " * 200 + "again 4915201234567 is the one, in 1999."), (101, None), (102, ""), (103, "no evidence"), (104, rows[0][1]), (104, rows[0][1])]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_email int")
    got = pii_crf.report(docs.select("doc_id", "text")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    text = rows[60][1]
    at = text.rindex("4915201234567")
    assert f"phone:{at}:{at + 13}" in by_id[100].spans.split(",") and by_id[100].n_added == 1
    assert by_id[0].n_email == 1 and by_id[0].n_phone == 1 and by_id[0].n_added == 0
    assert [by_id[i].spans for i in (101, 102, 103)] == [""] * 3
    base = ",".join(f"{pii_crf.KINDS[k]}:{s}:{e}" for k, s, e in pii_crf.base_spans(rows[0][1]))
    assert by_id[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert pii_crf.report(docs.limit(0)).count() == 0


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    nodes, pair = rng.normal(size=(4, 3)), rng.normal(size=(2, 3, 3))
    links = [(np.array([[0, 1], [1, 2]]), pair[0]), (np.array([[1, 3]]), pair[1])]
    observed = np.array([-1, -1, 2, -1])
    total = np.zeros((4, 3))
    for x in np.ndindex(3, 3, 3, 3):
        if x[2] == 2:
            p = np.exp(sum(nodes[i, x[i]] for i in (0, 1, 3)) + sum(q[x[a], x[b]] for edges, q in links for a, b in edges))
            for i in range(4):
                total[i, x[i]] += p
    got = pii_crf.marginals(nodes, links, observed, rounds=80)
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def plain_base(text):
    return [(k, *m.span()) for k, kind in enumerate(pii_crf.KINDS) for m in pii_crf.PATTERNS[kind].finditer(text) if pii_crf._passes(kind, m[0])]


def test_base_spans_equal_the_patterns_as_stated():
    rng = random.Random(6)
    pieces = ["a", "b.c", "@", ".", "x@y.zz", "12", "1.2", "255", ".", " ", "-", "+", "+1", "(", ")", "_", "4111 1111 1111 1111", "é", "%", "\n", "10.0.0.1", "@d.e-f.g"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        assert pii_crf.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for run in ("1" * 300_000, "a." * 150_000 + " x@", "1." * 150_000, "+1(" + "(" * 300_000, "a@" * 150_000, "1 " * 200_000):
        began = time.time()
        pii_crf.base_spans(run)
        assert time.time() - began < 5


def plain_labels(text, base, field):
    """The most likely label of each token by adding up all labellings."""
    t = pii_crf.tokens_of(text, base)
    n = len(pii_crf.KINDS) + 1
    total = np.zeros((len(t.spans), n))
    for x in np.ndindex(*[n] * len(t.spans)):
        if all(not known or known == x[i] for i, known in enumerate(t.labels)):
            score = sum(field.node(s)[x[i]] for i, s in enumerate(t.shapes)) + sum(field.chain[x[a], x[b]] for a, b in t.chain) + sum(field.skip[x[a], x[b]] for a, b in t.skip)
            total[range(len(x)), x] += np.exp(score)
    return t, total.argmax(axis=1)


def test_added_spans_equal_a_sum_over_all_labellings():
    rng = random.Random(2)
    number = lambda: "+49" + "".join(rng.choices("0123456789", k=10))
    train = [f"Call {number()} or write to p{i}@mail.example.com in {1990 + i}, for {i} coins" for i in range(80)]
    counts = {}
    for x in train:
        for kind in pii_crf.kinds_of(pii_crf.tokens_of(x, pii_crf.base_spans(x))):
            counts[kind] = counts.get(kind, 0) + 1
    field = pii_crf.fit([(*k, n) for k, n in counts.items()])
    added = 0
    for i in range(40):
        a, b = number(), number()
        text = rng.choice([f"{a} and then {a[1:]} in 1999", f"{a[1:]} 12 {b}", f"no base {a[1:]} at all {i}", f"x{i}@mail.example.com or x{i}@other , {i}"])
        base = pii_crf.base_spans(text)
        t, want = plain_labels(text, base, field)
        got = pii_crf.added_spans([text], [pii_crf.tokens_of(text, base)], [base], field)[0]
        found = {(k, j) for k, s, e in got for j, (u, v) in enumerate(t.spans) if u < e and s < v}
        assert found == {(int(k) - 1, j) for j, k in enumerate(want) if k and not t.labels[j]}, text
        added += len(found)
    assert added >= 10


def test_masked_base_spans_are_found_again():
    """Held-out recall: labels of every other document's base spans are hidden, and the field has to find them."""
    rng = random.Random(3)
    texts = [f"Call +1 555 0{rng.randint(100, 199)} {rng.randint(1000, 9999)} or mail n{rng.randint(0, 999)}@host{i % 7}.example.com . We met {rng.randint(1, 30)} times since {rng.randint(1990, 2020)} ." for i in range(200)]
    counts = {}
    for x in texts[::2]:
        for kind in pii_crf.kinds_of(pii_crf.tokens_of(x, pii_crf.base_spans(x))):
            counts[kind] = counts.get(kind, 0) + 1
    field = pii_crf.fit([(*k, n) for k, n in counts.items()])
    hit = wanted = wrong = 0
    for x in texts[1::2]:
        base = pii_crf.base_spans(x)
        found = pii_crf.added_spans([x], [pii_crf.tokens_of(x, [])], [[]], field)[0]
        wanted += len(base)
        hit += sum(any(k == kind and s < end and start < e for k, s, e in found) for kind, start, end in base)
        wrong += sum(not any(s < end and start < e for _, start, end in base) for _, s, e in found)
    assert hit >= 0.9 * wanted and wrong <= 0.05 * wanted
