"""Alignment of two tokenizations of each text: a byte-level vocabulary (A) and one of sentence pieces (B).

Every text is tokenised whole by both, A with the space in front that B adds by itself. The bytes of the tokens of either must
be the text's own; then they give the tokens' ends. Where a token of A and one of B that begin with a space begin together,
the tokens before them end together: such anchors cut a text into windows, mostly of a word. A window's alignment depends on
nothing but its ids, so each worker remembers it by the two tuples of ids: its groups (the tokens between byte offsets where
tokens of both end) and its links (the tokens that end there). Windows that are not yet known are aligned together, as arrays.

The links of all texts are written as numbers (id of A times the size of B, plus id of B), and Spark counts them. Two tokens
that end together are one the ending of the other, so there are at most as many pairs of ids as the tokens of both
vocabularies have bytes, some 0.5 million for these two whatever the corpus is: the counts are sent to all tasks, which then
add them up for each text.

Defined cases: a null or empty text, and one whose tokens are not its bytes (B turns the character U+2581 into a space), has no
tokens: all its numbers are zero, and its digest is empty. Repeated rows are texts of their own and count as often as they
come; a null id is carried; an empty table gives no rows; other columns play no part. Strings of special tokens are text.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import in_small_batches, save
from crawlframe.llm.tokens import MEMO_CHARS, Encoder, byte_level_bytes, cut_texts, default_vocabulary, in_slices, packed, remembered

#: Pieces of each vocabulary, and windows, that a worker remembers before it starts afresh.
MEMO_PIECES = 250_000
MEMO_WINDOWS = 150_000
#: Characters of texts that are aligned together.
SLICE_CHARS = 1_000_000
_SPACE = "▁"
#: Pieces that depend on what stands around them: none, those with other white space, or with what becomes white space.
_ODD = re.compile(rf"^\n?$|(?!^\n)\s|{_SPACE}")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder:
    """Texts to ids of a sentence-piece model, as its plain call gives them, packed as unsigned 32-bit numbers.

    Where no piece has a space after another character, and none a line break, what stands after a single space or line break
    is encoded alike wherever it stands, and a worker does it once. Texts with other spaces are encoded whole.
    """

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        kept = "".join(self.pieces[i] for i in self.model.encode("ﬁ  x")) == _SPACE + f"ﬁ{_SPACE}{_SPACE}x"
        self.by_pieces = kept and not any("\n" in p or (_SPACE in p[1:] and p.strip(_SPACE)) for p in self.pieces)
        self.space = self.model.piece_to_id(_SPACE)
        self.memo: dict[str, bytes | None] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def _learn(self, pieces: list[str]) -> None:
        memo, space = self.memo, self.space
        for piece, ids in zip(pieces, self._ids(pieces), strict=True):
            if not piece.isalnum() and _ODD.search(piece):
                memo[piece] = None
            elif piece[0] != "\n":
                memo[piece] = packed(ids)
            else:  # without the space that the call puts before it
                memo[piece] = packed(ids[1:]) if ids[0] == space else None

    def encode(self, texts: list[str], cut: list[list[str]] | None = None, pieces: set[str] | None = None) -> list[bytes]:
        """``cut``, ``pieces``: as ``cut_texts`` gives them."""
        if cut is None or pieces is None:
            cut, pieces = cut_texts(texts)
        out: list[bytes | None] = [None] * len(texts)
        if self.by_pieces:
            self.memo = remembered(self.memo, MEMO_PIECES, pieces)
            self._learn([p for p in pieces - self.memo.keys() if len(p) <= MEMO_CHARS])
            get = self.memo.__getitem__
            for i, own in enumerate(cut):
                with contextlib.suppress(TypeError, KeyError):
                    out[i] = b"".join(map(get, own))
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = packed(ids)
        return out


def piece_bytes(pieces: list[str]) -> list[bytes]:
    """Bytes of sentence pieces: ``<0xHH>`` is a byte, U+2581 a space."""
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(_SPACE, " ").encode() for p in pieces]


def _texts_of(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The bytes of tokens one after another."""
    n = sizes[ids]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the numbers x are among the sorted numbers y."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _mixed(n: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    n = (n.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    n ^= n >> np.uint64(29)
    return n * np.uint64(0xBF58476D1CE4E5B9)


def repeated_windows(ids: list[np.ndarray], cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each different one, and for every window which of these it equals, token by token."""
    sums, places = [], []
    for own, at in zip(ids, cuts, strict=True):
        n = np.diff(at)
        place = np.arange(len(own)) - np.repeat(at[:-1], n)
        sums.append(np.add.reduceat(_mixed(own) * (_mixed(place) | np.uint64(1)), at[:-1]))
        places.append((n, place))
    _, first, same = np.unique(_mixed(sums[0]) ^ (_mixed(sums[1]) >> np.uint64(7)), return_index=True, return_inverse=True)
    for own, at, (n, place) in zip(ids, cuts, places, strict=True):
        model = first[same]
        if (n[model] != n).any() or (own[np.repeat(at[model], n) + place] != own).any():  # two windows with one sum
            return np.arange(len(n)), np.arange(len(n))
    return first, same


class Aligner:
    """Both encoders, the bytes of their tokens, and the remembered windows."""

    _open: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, vocabulary: str, model: str):
        self.first, self.second = Encoder(vocabulary, True, MEMO_PIECES), PieceEncoder(model)
        tokens = [self.first.tokenizer.id_to_token(i) or "" for i in range(self.first.most_id + 1)]
        own = byte_level_bytes(tokens), piece_bytes(self.second.pieces)
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in own]
        self.starts = [np.cumsum(n) - n for n in self.sizes]
        self.flat = [np.frombuffer(b"".join(x), np.uint8) for x in own]
        self.spaced = [np.array([t[:1] == b" " for t in x]) for x in own]
        self.base = len(own[1])
        #: Ids as they stand in groups: of A within and at the end of its part, of B likewise.
        self.said = [b"%d%s" % (i, mark) for x, marks in zip(own, (b",|", b",;"), strict=True) for mark in (marks[:1], marks[1:]) for i in range(len(x))]
        self.memo: dict[tuple[bytes, bytes], tuple[bytes, bytes]] = {}

    @classmethod
    def of(cls, vocabulary: str, model: str) -> "Aligner":
        if (vocabulary, model) not in cls._open:
            cls._open[vocabulary, model] = cls(vocabulary, model)
        return cls._open[vocabulary, model]

    def windows(self, keys: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """Groups as text, and links, of windows given by their ids; each window's tokens of A and of B have the same bytes."""
        ids = [np.frombuffer(b"".join([k[side] for k in keys]), "<u4").astype(np.int64) for side in (0, 1)]
        ends = [np.cumsum(n[i]) for n, i in zip(self.sizes, ids, strict=True)]
        # The last token of a group, in either list, ends where one of the other does.
        last = [_held(x, y) for x, y in (ends, ends[::-1])]
        links = (ids[0][last[0]] * self.base + ids[1][last[1]]).astype("<i8")
        group = [np.cumsum(x) - x for x in last]
        until = [np.concatenate([[0], np.flatnonzero(x) + 1]) for x in last]
        # Each group's tokens of A, then its tokens of B.
        said = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        said[np.arange(len(ids[0])) + until[1][group[0]]] = ids[0] + len(self.sizes[0]) * last[0]
        said[np.arange(len(ids[1])) + until[0][group[1] + 1]] = 2 * len(self.sizes[0]) + ids[1] + self.base * last[1]
        words = list(map(self.said.__getitem__, said.tolist()))
        tokens = [np.cumsum([len(k[side]) // 4 for k in keys]) for side in (0, 1)]
        till = (tokens[0] + tokens[1]).tolist()
        links_till = (np.cumsum(last[0])[tokens[0] - 1] * 8).tolist()
        links, out, i, k = links.tobytes(), [], 0, 0
        for j, l in zip(till, links_till, strict=True):
            out.append((b"".join(words[i:j])[:-1], links[k:l]))
            i, k = j, l
        return out

    def align(self, texts: list[str]) -> list[tuple[int, int, bytes, bytes] | None]:
        """For each text how many tokens of A and of B, its groups and its links; None without tokens."""
        cut, pieces = cut_texts(texts)
        codes = [self.first.encode_after_space(texts, cut, pieces), self.second.encode(texts, cut, pieces)]
        del cut, pieces
        raw = [b" " + t.encode() if t else b"" for t in texts]
        fit = [i for i, t in enumerate(texts) if t]
        for side in (0, 1):  # first by length, then byte by byte
            n = self.sizes[side]
            fit = [i for i in fit if int(n[np.frombuffer(codes[side][i], "<u4")].sum()) == len(raw[i])]
        whole = np.frombuffer(b"".join([raw[i] for i in fit]), np.uint8)
        ids = [np.frombuffer(b"".join([x[i] for i in fit]), "<u4") for x in codes]
        bad = _texts_of(ids[1], self.sizes[1], self.starts[1], self.flat[1]) != whole
        if not self.first.by_pieces:  # else every byte of a text is in a token, as it stands
            bad |= _texts_of(ids[0], self.sizes[0], self.starts[0], self.flat[0]) != whole
        if bad.any():
            sizes = np.array([len(raw[i]) for i in fit])
            wrong = np.add.reduceat(bad, np.cumsum(sizes) - sizes) > 0
            fit = [i for i, x in zip(fit, wrong.tolist(), strict=True) if not x]
            ids = [np.frombuffer(b"".join([x[i] for i in fit]), "<u4") for x in codes]
        out: list[tuple[int, int, bytes, bytes] | None] = [None] * len(texts)
        if not fit:
            return out
        # Every text begins with a space, so its beginning is an anchor.
        starts = [np.cumsum(n[i]) - n[i] for n, i in zip(self.sizes, ids, strict=True)]
        spaced = [at[own[i]] for at, own, i in zip(starts, self.spaced, ids, strict=True)]
        anchors = spaced[0][_held(*spaced)]
        cuts = [np.append(np.searchsorted(at, anchors), len(at)) for at in starts]
        a, b = (b"".join([x[i] for i in fit]) for x in codes)
        first, same = repeated_windows(ids, cuts)
        bounds = [(4 * x).tolist() for c in cuts for x in (c[first], c[first + 1])]
        keys = [(a[i:j], b[k:l]) for i, j, k, l in zip(*bounds, strict=True)]
        memo = self.memo = remembered(self.memo, MEMO_WINDOWS, keys)
        fresh = [k for k in dict.fromkeys(keys) if k not in memo]
        if fresh:
            memo.update(zip(fresh, self.windows(fresh), strict=True))
        known = [memo[k] for k in keys]
        same = same.tolist()
        # Windows of each text.
        till = np.searchsorted(cuts[0], np.cumsum([len(codes[0][i]) // 4 for i in fit])).tolist()
        first = 0
        for i, last in zip(fit, till, strict=True):
            own = [known[k] for k in same[first:last]]
            out[i] = len(codes[0][i]) // 4, len(codes[1][i]) // 4, b";".join([w[0] for w in own]), b"".join([w[1] for w in own])
            first = last
        return out


@contextlib.contextmanager
def _no_garbage() -> Iterator[None]:
    """Without Python's search for cycles, of which encoders make none: it would go through all that is remembered again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _aligned(vocabulary: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _no_garbage():
            aligner = Aligner.of(vocabulary, model)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for start, end in in_slices(texts, SLICE_CHARS):
                    counts, digests, links = [], [], []
                    for one in aligner.align([t or "" for t in texts[start:end]]):
                        if one is None:
                            counts.append((0, 0, 0))
                            digests.append("")
                            links.append(b"")
                            continue
                        counts.append((one[0], one[1], len(one[3]) // 8))
                        digests.append(hashlib.sha256(one[2]).hexdigest())
                        links.append(one[3])
                    offsets = np.cumsum([0, *(len(x) // 8 for x in links)]).astype(np.int32)
                    codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(links), "<i8")))
                    columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), *columns, pa.array(digests, pa.string()), codes], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return run


def alignments(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups_sha256, links)``: a row for each text, links as numbers of pairs of ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = _aligned(vocabulary or default_vocabulary(), model or default_pieces())
    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(link, n)``: how often each pair of ids is linked in the corpus."""
    return aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))


def _summed(shared, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, counts = shared.value
        most = np.zeros(base, np.int64)
        np.maximum.at(most, links % base, counts)
        best = counts == most[links % base]
        for batch in batches:
            own = batch.column("links")
            offsets = own.offsets.to_numpy()
            at = np.searchsorted(links, own.flatten().to_numpy())
            sums = [np.concatenate([[0], np.cumsum(x[at])])[offsets - offsets[0]] for x in (counts, best)]
            rest = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            n_links = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*rest, n_links, *[pa.array(np.diff(s).astype(np.int64)) for s in sums[::-1]], batch.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def report(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``.

    ``n_best`` are links whose pair is the most frequent, in the corpus, of those with its id of B.
    """
    from sentencepiece import SentencePieceProcessor

    base = SentencePieceProcessor(model_file=model or default_pieces()).get_piece_size()
    aligned = save(alignments(docs, vocabulary, model), "alignments")
    # At most the bytes of all tokens of both vocabularies, see above: bounded whatever the corpus is.
    counts = save(pair_counts(aligned), "pair-counts").toPandas().sort_values("link")
    shared = docs.sparkSession.sparkContext.broadcast((counts["link"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(aligned).mapInArrow(_summed(shared, base), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
