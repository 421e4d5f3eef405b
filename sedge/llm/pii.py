"""PII: skip-chain conditional random field over the tokens of a document that could be personal data.

Nodes are the blank-delimited tokens with a digit or `@`; any other token is clamped to "none", which cuts the chain, so
inference over the nodes alone is inference over the whole document. A node is known by its signs and by the word before it.
Nodes that are next to each other share a chain potential; a node and the next one like it anywhere in the document (same
address, whatever stands around it; same last seven digits; else same folded text) share a skip potential, so that the labels
of repeated mentions agree. Linking each to the next keeps the number of factors linear in the tokens. Marginals come from
damped loopy belief propagation.

Weights are fitted by pseudo-likelihood on about SAMPLE_TOKENS tokens at most, of documents picked by a hash of the id;
labels are the base patterns' matches. In training the tell-tale signs of a token are left out at times, so that context
and like mentions get weights too. Base matches stay as they are and are given in inference; runs of nodes that are surely one kind and touch no
base match are added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_TOKENS, SEED, SURE, ROUNDS, DAMP = 20_000, 20_000, 6, 0.9, 12, 0.3
SHRINK, AGREE, CERTAIN = 1e-3, 2.0, 20.0
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Where an IP or a card can be: both have seven signs at least, of these only, and start with a digit.
_DIGITS = re.compile(r"[0-9][0-9. -]{6,}")
_HINT = re.compile(r"[0-9@]")
_BLANK, _BLANKS = re.compile(r"[\x20\x09-\x0D]"), frozenset(" \t\n\v\f\r")
_EDGE = "\"'.,;:!?<>[]{}"
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by start, then kind; leftmost non-overlapping per kind, failing matches dropped."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:  # the stretch of signs that an address can have, around each @
        a, b = at, at + 1
        while a > done and text[a - 1] in _EMAIL_CHAR:
            a -= 1
        while b < len(text) and text[b] in _EMAIL_CHAR:
            b += 1
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text, a, b)]
        done = b
        at = text.find("@", b)
    for run in _DIGITS.finditer(text):
        a, b = run.span()
        for m in _IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, a, b):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---------------------------------------------------------------- nodes, features, links

#: Features of a token alone (the first _SIGNS are tell-tale), then of its neighbours.
_SIGNS = 8
_SHAPE = 22
#: Cells that the word before a token is hashed to, and one for a colon at its end.
_WORDS = 32
_ALONE = _SHAPE + _WORDS + 1
_ADDRESS = re.compile(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*")


def nodes(text: str) -> list[tuple[int, int]]:
    out, hint = [], _HINT.search(text)
    while hint:
        a, blank = hint.start(), _BLANK.search(text, hint.end())
        while a and text[a - 1] not in _BLANKS:
            a -= 1
        out.append((a, blank.start() if blank else len(text)))
        hint = _HINT.search(text, out[-1][1])
    return out


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(spans), _ALONE), np.float32)
    for i, (a, b) in enumerate(spans):
        t = text[a:b].strip(_EDGE)
        digits = sum("0" <= c <= "9" for c in t)
        letters = sum(c.isalpha() for c in t)
        dots = t.count(".")
        core = t.replace("-", "")
        n = len(t) or 1
        x[i, :_SHAPE] = (
            "@" in t, t[:1] == "+", dots == 3 and digits + dots == len(t), core.isdigit() and 12 <= len(core) <= 19 and core.isascii() and luhn(core),
            "@" in t and "." in t.rpartition("@")[2], "(" in t and ")" in t, core.isdigit() and 12 <= len(core) <= 19, digits == 7 and "-" in t,
            1, letters == 0, letters > 0 and digits > 0, digits == len(t), dots == 1, dots >= 2, "-" in t, digits <= 3,
            4 <= digits <= 7, 8 <= digits <= 11, digits >= 12, letters / n > 0.5, n > 24, "=" in t or "/" in t or "_" in t,
        )
        before = text[max(0, a - 32) : a].split()  # words are short; a longer one counts by its end
        if before:
            word = before[-1].strip(_EDGE).lower()
            x[i, _SHAPE + zlib.crc32(word.encode("utf-8", "replace")) % _WORDS] = 1
            x[i, -1] = before[-1].endswith(":")
    return x


def _beside(text: str, spans: list[tuple[int, int]], i: int) -> bool:
    """Node i stands next to the one after it."""
    return spans[i + 1][0] - spans[i][1] <= 2 and text[spans[i][1] : spans[i + 1][0]].isspace()


def chain_links(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(i, i + 1) for i in range(len(spans) - 1) if _beside(text, spans, i)]


def skip_links(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Each node with the next one like it, if they aren't neighbours in the text."""
    last: dict[str, int] = {}
    out = []
    for i, (a, b) in enumerate(spans):
        t = text[a:b].strip(_EDGE).lower()
        digits = "".join(c for c in t if "0" <= c <= "9")
        address = _ADDRESS.search(t) if "@" in t else None
        key = address[0] if address else digits[-7:] if len(digits) >= 7 and "@" not in t else t
        if len(key) < 4:
            continue
        if key in last and not (last[key] == i - 1 and _beside(text, spans, i - 1)):
            out.append((last[key], i))
        last[key] = i
    return out


def node_labels(spans: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """0 for none, else 1 + kind of the first base match that meets the token."""
    y, k = np.zeros(len(spans), np.int64), 0
    for i, (a, b) in enumerate(spans):
        while k < len(base) and base[k][2] <= a:
            k += 1
        if k < len(base) and base[k][0] < b:
            y[i] = 1 + base[k][1]
    return y


def neighbour_counts(n: int, links: list[tuple[int, int]], y: np.ndarray) -> np.ndarray:
    """For each node, how many linked nodes have each label; zeros without links."""
    c = np.zeros((n, len(KINDS) + 1), np.float32)
    for i, j in links:
        c[i, y[j]] += 1
        c[j, y[i]] += 1
    return c


class Field:
    """unary (features x labels), chain and skip (labels x labels, symmetric) log-potentials."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, x: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], given: np.ndarray | None = None) -> np.ndarray:
        """given: labels that are known where above 0."""
        u = x @ self.unary
        if given is not None and (known := np.flatnonzero(given)).size:
            u[known] = -CERTAIN
            u[known, given[known]] = 0
        if chain or skip:
            links = np.array(chain + skip)
            pot = np.exp(np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)]))
            src, dst = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
            msg = np.zeros((len(src), u.shape[1]))
            for _ in range(ROUNDS):
                belief = u.copy()
                np.add.at(belief, dst, msg)
                out = belief[src] - msg[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.einsum("ei,eij->ej", out, pot) + 1e-30)
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - msg).max()
                msg = DAMP * msg + (1 - DAMP) * new
                if moved < 1e-4:
                    break
            np.add.at(u, dst, msg)
        p = np.exp(u - u.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_field(x: np.ndarray, near: np.ndarray, like: np.ndarray, y: np.ndarray, seed: int = SEED, rounds: int = 300) -> Field:
    """Pseudo-likelihood: each label given its neighbours' labels, by gradient descent with shrinkage.

    Links shrink to a reward of AGREE for equal labels, so that like mentions agree where the sample has too few to tell.
    """
    k = len(KINDS) + 1
    rng = np.random.default_rng(seed)
    hide = rng.random(len(x)) < 0.3
    x = x.copy()
    x[hide, :_SIGNS] = 0
    z = np.concatenate([x, near, np.minimum(like, 2)], 1).astype(np.float64)
    prior = np.concatenate([np.zeros((x.shape[1], k)), AGREE * np.eye(k), AGREE * np.eye(k)])
    w = prior.copy()
    if len(z):
        target, step = np.eye(k)[y], 1.0
        grown = np.zeros_like(w)
        for _ in range(rounds):
            p = z @ w
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = z.T @ (p - target) / len(z) + SHRINK * (w - prior)
            grown += g * g
            w -= step * g / (np.sqrt(grown) + 1e-6) * 0.3
    a, n = x.shape[1], near.shape[1]
    chain, skip = w[a : a + n], w[a + n :]
    return Field(w[:a], (chain + chain.T) / 2, (skip + skip.T) / 2)


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Runs of neighbouring nodes that are surely of one kind and meet no base match, without punctuation at the ends."""
    spans = nodes(text)
    if not spans:
        return []
    x, chain, given = features(text, spans), chain_links(text, spans), node_labels(spans, base)
    p = field.marginals(x.astype(np.float64), chain, skip_links(text, spans), given)
    best = p.argmax(1)
    free = (given == 0) & (best > 0) & (p.max(1) >= SURE)
    joined, out, i = {a for a, _ in chain}, [], 0
    while i < len(spans):
        if not free[i]:
            i += 1
            continue
        j = i
        while j in joined and free[j + 1] and best[j + 1] == best[i]:
            j += 1
        a, b = spans[i][0], spans[j][1]
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((a, int(best[i]) - 1, b))
        i = j + 1
    return out


def spell(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---------------------------------------------------------------- over tables


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> Field:
    """Fit on the tokens of about SAMPLE_DOCS documents, SAMPLE_TOKENS tokens at most."""
    n, scale = docs.count(), 1 << 30
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    some = docs.select(h.alias("h"), F.col(text_col).alias("text")).where(F.pmod("h", F.lit(scale)) < int(scale * min(1.0, SAMPLE_DOCS / max(1, n)))).where(F.col("text").isNotNull())

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[int, int, bytes]] = []
            for h, text in zip(b.column("h").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                spans = nodes(text) if _HINT.search(text) else []
                if not spans:
                    continue
                y = node_labels(spans, base_spans(text))
                z = np.concatenate([features(text, spans), neighbour_counts(len(spans), chain_links(text, spans), y), neighbour_counts(len(spans), skip_links(text, spans), y)], 1)
                rows += [(int(common.mix64(np.array([(h + 0x9E3779B97F4A7C15 * i) & (1 << 64) - 1], np.uint64))[0] >> np.uint64(1)), int(y[i]), z[i].astype(np.float32).tobytes()) for i in range(len(spans))]
            yield pa.RecordBatch.from_pydict({"at": pa.array([r[0] for r in rows], pa.int64()), "y": pa.array([r[1] for r in rows], pa.int64()), "z": pa.array([r[2] for r in rows], pa.binary())})

    got = some.mapInArrow(tokens, "at long, y long, z binary").orderBy("at", "y", "z").limit(SAMPLE_TOKENS).collect()
    k = len(KINDS) + 1
    z = np.array([np.frombuffer(r["z"], np.float32) for r in got]).reshape(len(got), _ALONE + 2 * k)
    return fit_field(z[:, :_ALONE], z[:, _ALONE : _ALONE + k], z[:, _ALONE + k :], np.array([r["y"] for r in got], np.int64))


def find(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """All columns of docs and n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (replaced if there).

    Positions are code points, ends exclusive. Null counts as empty: no matches, the digest of the empty string.
    Repeated rows are each searched. Texts of any length are searched whole; inference grows with their nodes.
    """
    new = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    rest = [c for c in docs.columns if c not in new]
    common.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf(", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    def search(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for text in texts:
            if not text or not _HINT.search(text):
                rows.append((0, 0, 0, 0, _NOTHING, ""))
                continue
            base = base_spans(text)
            every = sorted(base + added_spans(text, base, sent.value))
            rows.append((*(sum(k == i for _, k, _ in base) for i in range(len(KINDS))), hashlib.sha256(spell(base).encode()).hexdigest(), spell(every)))
        return pd.DataFrame(rows, columns=new)

    return docs.select(*rest).withColumn("_f", search(F.col(text_col))).select(*rest, *(F.col(f"_f.{c}").alias(c) for c in new))


_NOTHING = hashlib.sha256(b"").hexdigest()


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, train(docs)).drop("text")
