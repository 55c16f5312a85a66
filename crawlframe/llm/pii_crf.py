"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans are the leftmost non-overlapping matches of four patterns that pass their checks; they are found in time linear in
the text. They are the observed labels of a conditional random field over the tokens that hold a digit or an at sign (all
other tokens are plainly outside):

* node potentials from the shape of a token and of its neighbours;
* chain potentials between neighbouring tokens, skip potentials between a token and the next one in the document that is
  equal or similar (same digits, same mail name or host).

All are learned together by pseudo-likelihood: each token's label given its shape and the labels of its chain and skip
neighbours, from counts over the whole corpus (a bounded number of kinds of tokens), labelled by the base patterns. Unmatched
tokens that resemble a matched one are not counted as outside. Skip potentials are drawn towards agreement.

Every text with a digit or an at sign goes through the field. Loopy sum-product messages over the documents of an Arrow batch
at once make labels agree within a document, so that a number which the pattern missed is found when it appears elsewhere as
personal data. Base spans stay as they are.

Defined cases: null and empty texts have no spans; a null doc_id is carried; repeated rows are answered once each; if
nothing is personal data anywhere nothing is added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import in_small_batches

#: The kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same patterns, written so that no run of characters is read more than a few times.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_MAIL_AT_START = re.compile(rf"(?<![A-Za-z0-9._%+-]){_MAIL.pattern}")
#: What a text must hold to be looked at at all.
EVIDENCE = "[0-9@]"
#: What skip potentials of equal labels are drawn to, and how strongly potentials are drawn to where they start.
AGREEMENT = 3.0
PENALTY = {"node": 1e-4, "chain": 1e-3, "skip": 1e-2}
ROUNDS = 20
DAMPING = 0.5

_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[^0-9]+")
_HAS = re.compile(EVIDENCE)
_TRIM = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in found.split("."))
    if kind == "email":
        return True
    digits = _DIGITS.sub("", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _mails(text: str) -> Iterator[re.Match]:
    """After a match the next may begin within the same run of characters, else only at the beginning of one."""
    at = 0
    while m := (at and _MAIL.match(text, at)) or _MAIL_AT_START.search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of kind and start; end exclusive, code points."""
    found = (
        _mails(text) if "@" in text else (),
        _IP.finditer(text),
        _CARD.finditer(text),
        PATTERNS["phone"].finditer(text) if "+" in text else (),
    )
    return [(k, *m.span()) for k, matches in enumerate(found) for m in matches if _passes(KINDS[k], m[0])]


@dataclass
class Tokens:
    """Tokens of one text that hold a digit or an at sign: spans, shapes, labels (0: outside) and edges."""

    spans: list[tuple[int, int]]
    shapes: list[str]
    labels: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _size(n: int) -> str:
    return next((c for c, most in zip("0abcdefg", (0, 2, 4, 6, 9, 12, 15, 19), strict=True) if n <= most), "h")


def _shape(token: str) -> str:
    digits = _DIGITS.sub("", token)
    parts = token.strip(_TRIM).split(".")
    return "".join(
        (
            _size(len(digits)),
            str(min(2, token.count("@"))),
            "4" if len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 for p in parts) else str(min(2, len(parts) - 1)),
            "+" if token[0] == "+" else "(" if token[0] == "(" else "-" if "-" in token else "_",
            "A" if any(map(str.isalpha, token)) else "_",
            "L" if 16 <= len(digits) <= 19 and luhn(digits) else "_",
        )
    )


def _keys(token: str) -> list[str]:
    """What makes tokens similar: the token, its digits from four on, a mail address's name and host."""
    bare = token.strip(_TRIM).lower()
    digits = _DIGITS.sub("", token)
    name, at, host = bare.partition("@")
    return [f"t{bare}"] + [f"d{digits[-4:]}{len(digits) >= 10 and digits[-10:]}"] * (len(digits) >= 4) + [f"n{name}", f"h{host}"] * bool(at)


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    spans, words, chain = [], [], []
    behind = None
    for i, m in enumerate(_TOKEN.finditer(text)):
        if _HAS.search(m[0]):
            if behind == i - 1 and spans:
                chain.append((len(spans) - 1, len(spans)))
            behind = i
            spans.append(m.span())
            words.append(m[0])
    own = [_shape(w) for w in words]
    before, after = {b: own[a][0] for a, b in chain}, {a: own[b][0] for a, b in chain}
    shapes = [f"{s}{before.get(i, '.')}{after.get(i, '.')}" for i, s in enumerate(own)]
    labels = [0] * len(spans)
    starts = np.array([s for s, _ in spans])
    for kind, s, e in reversed(base):
        for i in range(max(0, int(np.searchsorted(starts, s, "right")) - 1), int(np.searchsorted(starts, e, "left"))):
            if spans[i][1] > s:
                labels[i] = kind + 1
    last: dict[str, int] = {}
    skip = set()
    for i, w in enumerate(words):
        for key in _keys(w):
            if key in last and (last[key], i) not in chain[-1:]:
                skip.add((last[key], i))
            last[key] = i
    return Tokens(spans, shapes, labels, chain, sorted(skip))


@dataclass
class Field:
    """Log potentials: weights of the letters of a shape, and pairs of labels along chains and skips."""

    weights: np.ndarray
    slots: list[dict[str, int]]
    chain: np.ndarray
    skip: np.ndarray
    #: Whether anything but outside was ever seen.
    any_label: bool

    def __post_init__(self):
        self.nodes: dict[str, np.ndarray] = {}

    def node(self, shape: str) -> np.ndarray:
        if shape not in self.nodes:
            self.nodes[shape] = self.weights[-1] + sum(self.weights[slot[c]] for slot, c in zip(self.slots, shape, strict=True) if c in slot)
        return self.nodes[shape]


def fit(counts: list[tuple[str, str, str, int, int]], steps: int = 400) -> Field:
    """From rows ``(shape, labels of chain neighbours, labels of skip neighbours, label, count)``."""
    n = len(KINDS) + 1
    kinds: dict[tuple[str, str, str], np.ndarray] = {}
    for shape, chain, skip, label, count in sorted(counts):
        kinds.setdefault((shape, chain, skip), np.zeros(n))[label] += count
    width = len(next(iter(kinds))[0]) if kinds else 0
    slots, size = [], 0
    for i in range(width):
        letters = sorted({k[0][i] for k in kinds})
        slots.append({c: size + j for j, c in enumerate(letters)})
        size += len(letters)
    # Columns: letters of the shape, one that is always there, and how many chain and skip neighbours have each label.
    x = np.zeros((len(kinds), size + 1 + 2 * n))
    x[:, size] = 1
    for r, (shape, chain, skip) in enumerate(kinds):
        x[r, [slot[c] for slot, c in zip(slots, shape, strict=True)]] = 1
        for first, near in ((size + 1, chain), (size + 1 + n, skip)):
            for label in near:
                x[r, first + int(label)] += 1
    y = np.array(list(kinds.values())).reshape(-1, n)
    total = y.sum(axis=1, keepdims=True)
    share = np.log1p(total)  # a frequent kind counts more, but not by all its copies
    y = y / np.maximum(1, total)
    parts = {"node": slice(0, size + 1), "chain": slice(size + 1, size + 1 + n), "skip": slice(size + 1 + n, None)}
    w = np.zeros((x.shape[1], n))
    w[parts["skip"]] = AGREEMENT * np.eye(n)
    start, m, v = w.copy(), 0.0, 0.0
    for t in range(1, steps + 1):
        scores = x @ w
        p = np.exp(scores - np.logaddexp.reduce(scores, axis=1, keepdims=True))
        g = x.T @ (share * (p - y)) / max(1, share.sum())
        for part, penalty in PENALTY.items():
            g[parts[part]] += penalty * (w - start)[parts[part]]
        for part in ("chain", "skip"):  # a pair of labels has one potential, whichever of the two is asked
            g[parts[part]] = (g[parts[part]] + g[parts[part]].T) / 2
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Field(w[parts["node"]], slots, w[parts["chain"]], w[parts["skip"]], bool(y[:, 1:].any()))


def marginals(nodes: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], observed: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs by loopy sum-product: log potentials of nodes (N, L); edges (E, 2) with the log potential (L, L) of each kind
    of edge; observed labels, or -1."""
    log = nodes.copy()
    known = np.flatnonzero(observed >= 0)
    log[known] = -1e3
    log[known, observed[known]] = 0
    links = [(edges, np.exp(pair - pair.max())) for edges, pair in links if len(edges)]
    # Both directions of each kind of edge: senders, receivers, and the factor that a sender's belief goes through.
    ways = [(edges[:, i], edges[:, 1 - i], factor if i == 0 else factor.T) for edges, factor in links for i in (0, 1)]
    messages = [np.zeros((len(src), nodes.shape[1])) for src, _, _ in ways]
    for _ in range(rounds if ways else 0):
        belief = log.copy()
        for (_, dst, _), message in zip(ways, messages, strict=True):
            np.add.at(belief, dst, message)
        fresh = []
        for i, (src, _, factor) in enumerate(ways):
            given = belief[src] - messages[i ^ 1]
            given -= given.max(axis=1, keepdims=True)
            sent = np.log(np.maximum(np.exp(given) @ factor, 1e-300))
            sent -= np.logaddexp.reduce(sent, axis=1, keepdims=True)
            fresh.append(DAMPING * messages[i] + (1 - DAMPING) * sent)
        messages = fresh
    for (_, dst, _), message in zip(ways, messages, strict=True):
        np.add.at(log, dst, message)
    return np.exp(log - np.logaddexp.reduce(log, axis=1, keepdims=True))


def added_spans(texts: list[str], tokens: list[Tokens], bases: list[list], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each text, none of them touching a base span."""
    at = np.cumsum([0, *(len(t.spans) for t in tokens)])
    if not at[-1] or not field.any_label:
        return [[] for _ in texts]
    nodes = np.array([field.node(s) for t in tokens for s in t.shapes])
    links = []
    for of, potential in ((lambda t: t.chain, field.chain), (lambda t: t.skip, field.skip)):
        links.append((np.array([(a + first, b + first) for t, first in zip(tokens, at.tolist(), strict=False) for a, b in of(t)], int).reshape(-1, 2), potential))
    observed = np.array([label or -1 for t in tokens for label in t.labels])
    label = marginals(nodes, links, observed).argmax(axis=1)
    out = []
    for text, t, base, first in zip(texts, tokens, bases, at.tolist(), strict=False):
        found: list[tuple[int, int, int]] = []
        joined = set(t.chain)
        for i, (s, e) in enumerate(t.spans):
            kind = int(label[first + i])
            if not kind or t.labels[i]:
                continue
            word = text[s:e]
            s, e = s + len(word) - len(word.lstrip(_TRIM)), e - len(word) + len(word.rstrip(_TRIM))
            if s >= e:
                continue
            if found and (i - 1, i) in joined and found[-1][0] == kind - 1 and label[first + i - 1] == kind and not t.labels[i - 1]:
                found[-1] = (kind - 1, found[-1][1], e)
            else:
                found.append((kind - 1, s, e))
        out.append([f for f in found if not any(f[1] < e and s < f[2] for _, s, e in base)])
    return out


def kinds_of(t: Tokens) -> Iterator[tuple[str, str, str, int]]:
    """Shape, labels of chain and of skip neighbours, and label of each token whose label is sure."""
    # An unmatched token that resembles a matched one is no evidence of anything.
    unsure = {x for a, b in t.skip for x, y in ((a, b), (b, a)) if not t.labels[x] and t.labels[y]}
    near: tuple[dict[int, list[str]], ...] = ({}, {})
    for found, links in zip(near, (t.chain, t.skip), strict=True):
        for a, b in links:
            for x, y in ((a, b), (b, a)):
                if y not in unsure:
                    found.setdefault(x, []).append(str(t.labels[y]))
    for i, (shape, label) in enumerate(zip(t.shapes, t.labels, strict=True)):
        if i not in unsure:
            yield shape, "".join(sorted(near[0].get(i, ()))), "".join(sorted(near[1].get(i, ()))), label


def _counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(kinds_of(tokens_of(text := text.as_py(), base_spans(text))))
        rows = [(*k, n) for k, n in total.items()]
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["shape", "chain", "skip", "label", "n"])

    found = in_small_batches(docs).where(F.col("text").rlike(EVIDENCE)).select("text").mapInArrow(run, "shape string, chain string, skip string, label int, n long")
    return found.groupBy("shape", "chain", "skip", "label").agg(F.sum("n").alias("n"))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, base, added)``, arrays of ``(kind, start, end)``.

    Without a field, one is learned from all of docs.
    """
    field = field or fit([tuple(r) for r in _counts(docs).collect()])
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) if t else [] for t in texts]
            added: list[list] = [[] for _ in texts]
            some = [i for i, t in enumerate(texts) if t] if shared.value.any_label else []
            for a in range(0, len(some), 200):
                part = some[a : a + 200]
                tokens = [tokens_of(texts[i], bases[i]) for i in part]
                for i, spans in zip(part, added_spans([texts[i] for i in part], tokens, [bases[i] for i in part], shared.value), strict=True):
                    added[i] = spans
            columns = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans] for spans in side] for side in (bases, added)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, span) for c in columns)], names=["doc_id", "base", "added"])

    # Texts without evidence need not reach Python.
    lean = in_small_batches(docs).select(F.col("doc_id").cast("long"), F.when(F.col("text").rlike(EVIDENCE), F.col("text")).alias("text"))
    kind = "array<struct<kind:string,start:int,end:int>>"
    return lean.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)``; the counts are those of base spans."""
    found = find(docs)
    order = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"))))
        return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(order, s["k"].cast("int")), s["s"], s["e"])))

    def n_of(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[n_of(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
