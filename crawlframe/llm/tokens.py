"""Whole texts to token ids with a public byte-level BPE vocabulary, inside Arrow batches.

The vocabulary file is a parameter. Where its pre-tokeniser is the byte-level one with the usual pattern, a space or line
break between two other characters is always a boundary of it, so a text is cut there and each distinct piece is encoded
once per worker by the tokenizers library; a text that holds any other white space, or the string of a special token, is
encoded whole. With any other pre-tokeniser or normaliser all texts are. Ids are equal to encoding every text whole.

The string of a special token in a text becomes that token's id, as the library's plain call gives it; with
``specials_as_text`` it is ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable

#: Pieces a worker remembers before it starts afresh, and the longest that it remembers.
MEMO_PIECES = 700_000
MEMO_CHARS = 48

#: Letters up to Latin Extended-B, and a punctuation mark after them: one pre-token each, in any version of Unicode.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+([.,;:!?]?)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def remembered(memo: dict, most: int, used: set) -> dict:
    """What a worker goes on remembering: all, or where that has become too much, what it uses just now."""
    return memo if len(memo) <= most else {k: memo[k] for k in used if k in memo}


def byte_level_bytes(tokens: list[str]) -> list[bytes]:
    """Bytes of tokens in the byte-level alphabet: printable bytes stand for themselves, the others for 256 and on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in tokens]


def _by_ranks(model: dict):
    """An encoder of single runs that takes an id for its rank, which is quicker; None where merges are not in the order of ids."""
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = model["vocab"]
    if model.get("type") != "BPE" or [ids.get(m) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    import tiktoken

    known = [t for t, i in ids.items() if i < 256 + len(merges)]
    return tiktoken.Encoding("runs", pat_str=r"[\s\S]+", mergeable_ranks=dict(zip(byte_level_bytes(known), (ids[t] for t in known), strict=True)), special_tokens={})


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    _open: dict[tuple[str, bool], "Encoder"] = {}

    def __init__(self, vocabulary: str, specials_as_text: bool = False, memo_pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(vocabulary, encoding="utf-8") as file:
            kind = json.load(file)
        cutter = kind["pre_tokenizer"] or {}
        #: Whether a text may be cut into pieces.
        self.by_pieces = not kind["normalizer"] and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.most_id = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        if not self.by_pieces:
            return
        self.memo: dict[str, bytes | None] = {}
        self.memo_pieces = memo_pieces
        #: For runs of letters, which the vocabulary's pre-tokeniser never cuts.
        self.ranked = _by_ranks(kind["model"])
        if not self.ranked:
            self.letters = Tokenizer.from_file(vocabulary)
            self.letters.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
            self.letters.post_processor = None
        self.line_break = self._ids(["\n"])[0]
        self.ends = {c: self._ids([c])[0] for c in ".,;:!?"}

    @classmethod
    def of(cls, vocabulary: str, specials_as_text: bool = False) -> "Encoder":
        """One encoder per worker process and vocabulary."""
        key = (vocabulary, specials_as_text)
        if key not in cls._open:
            cls._open[key] = cls(*key)
        return cls._open[key]

    def _ids(self, texts: list[str], letters: bool = False) -> list[bytes]:
        if letters and self.ranked:
            encode = self.ranked.encode_ordinary
            return [packed(encode(t)) for t in texts]
        found = (self.letters if letters else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [packed(e.ids) for e in found]

    def _learn(self, pieces: set[str]) -> None:
        """A piece stands for itself after a space, or after a line break where it begins with one."""
        plain: tuple[dict, dict] = {}, {}
        ended = []
        for piece in pieces:
            body = piece[1:] if piece[:1] == "\n" else piece
            if m := _LETTERS.fullmatch(body):
                if m[1]:
                    ended.append(piece)
                    piece = piece[:-1]
                if not m[1] or piece not in self.memo:
                    plain[1][piece] = True
            elif body.split() != [body] or "\u180e" in body or "\u200b" in body:
                self.memo[piece] = None
            else:
                plain[0][piece] = True
        for letters, some in enumerate(plain):
            for piece, ids in zip(some, self._ids([p[1:] if p[0] == "\n" else f" {p}" for p in some], bool(letters)), strict=True):
                self.memo[piece] = self.line_break + ids if piece[0] == "\n" else ids
        for piece in ended:
            self.memo[piece] = self.memo[piece[:-1]] + self.ends[piece[-1]]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        texts = [t or "" for t in texts]
        if not self.by_pieces:
            return self._ids(texts)
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        ids = self._by_pieces(["" if i in marked else t for i, t in enumerate(texts)] if marked else texts)
        for i in marked:
            ids[i] = self._ids([texts[i]])[0]
        return ids

    def encode_after_space(self, texts: list[str], cut: list[list[str]] | None = None, pieces: set[str] | None = None) -> list[bytes]:
        """Ids of each text with a space before it; an empty text has none. ``cut``, ``pieces``: as ``cut_texts`` gives them."""
        if not self.by_pieces:
            return [ids if t else b"" for t, ids in zip(texts, self._ids([f" {t}" for t in texts]), strict=True)]
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if cut is None or pieces is None:
            cut, pieces = cut_texts(texts)
        ids = self._by_pieces(texts, " ", cut, pieces)
        for i in marked:
            ids[i] = self._ids([f" {texts[i]}"])[0]
        return ids

    def _by_pieces(self, texts: list[str], before: str = "\n", cut: list[list[str]] | None = None, pieces: set[str] | None = None) -> list[bytes]:
        """``before``: what stands before each text; a line break's ids are left out again."""
        if cut is None or pieces is None:
            cut = [("\n" + t).replace("\n", " \n").split(" ")[1:] if t else [] for t in texts]
            pieces = set().union(*cut)
        self.memo = remembered(self.memo, self.memo_pieces, pieces)
        fresh = pieces - self.memo.keys()
        self._learn({p for p in fresh if len(p) <= MEMO_CHARS})
        far = {p: None for p in fresh if len(p) > MEMO_CHARS}
        ids = []
        get, n = self.memo.__getitem__, len(self.line_break) if before == "\n" else 0
        for text, pieces in zip(texts, cut, strict=True):
            if not pieces:
                ids.append(b"")
                continue
            try:
                ids.append(b"".join(map(get, pieces))[n:])
            except (TypeError, KeyError):
                ids.append(self._whole(text, pieces, far, before))
        return ids

    def _whole(self, text: str, pieces: list[str], far: dict, before: str) -> bytes:
        """A text with other white space, or with pieces too long to remember."""
        if any(p not in far and self.memo[p] is None for p in pieces) or any(len(p.split()) != 1 for p in pieces if p in far):
            return self._ids([text if before == "\n" else before + text])[0]
        out = []
        for p in pieces:
            if p in far:
                body = self._ids([p[1:] if p[0] == "\n" else f" {p}"])[0]
                out.append(self.line_break + body if p[0] == "\n" else body)
            else:
                out.append(self.memo[p])
        return b"".join(out)[len(self.line_break) if before == "\n" else 0 :]


def cut_texts(texts: list[str]) -> tuple[list[list[str]], set[str]]:
    """The pieces of each text between single spaces, line breaks standing before the piece after them; and all of them."""
    cut = [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
    return cut, set().union(*cut)


def forget_encoders() -> None:
    """Called by tasks of other operators: a worker that turns from encoding to something else gives its memory back."""
    Encoder._open.clear()


def in_slices(texts: list[str | None], most_chars: int = 2_000_000) -> Iterable[tuple[int, int]]:
    """Slices [a, b) of a batch with about most_chars characters each."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most_chars:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
