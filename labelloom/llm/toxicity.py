"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits, lower-cased; a token's features are its word and its beginnings of 4 to 7
letters, hashed. In training documents marked toxic, the tokens with a feature that tells toxic from clean documents
are labelled toxic, all others clean; the field learns from these label sequences a weight for each feature and for
each transition, by gradient ascent on the conditional likelihood. Forward-backward then gives
each token's marginal. A document's score is a logistic function of its expected number of toxic tokens, its
largest marginal and its length; offsets of tokens whose marginal is 0.5 or more are its spans.

With two states the recursions carry one number, the odds of toxic, and all texts of a batch advance together. Null
and empty texts have no tokens and get the score of a text with nothing toxic. Without labelled documents of either
kind every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kept_rows, mixed, parts_of, span_hashes, text_blocks, written
from .byte_bpe import LETTER, NUMBER, classes, point_values
from .language_id import held_out

BUCKETS = 1 << 18
#: The bound on what is learned from: documents of each kind, and bytes of one; longer ones aren't learned from.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 500, 1000, 1 << 14
STEPS = 20
#: Beginnings of a token that are features of it, besides the whole.
PREFIXES = (4, 5, 6, 7)
FEATURES = 1 + len(PREFIXES)


@lru_cache(1)
def lowered() -> np.ndarray:
    """The hash value of each code point's lower case."""
    low = np.arange(0x110000)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
            low[c] = ord(x)
    return point_values()[low]


def tokens(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and feature buckets of each token, and the number of tokens before each text, then of all.

    A token that is no longer than a beginning has its word there again, as a feature of its own.
    """
    n = len(points)
    word = np.zeros(n + 2, bool)
    kind = classes()[points]
    word[1:-1] = (kind == LETTER) | (kind == NUMBER)
    first = np.zeros(n + 1, bool)
    first[starts] = True
    begin = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:n]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
    buckets = np.zeros((len(begin), FEATURES), np.int32)
    if len(begin):
        values = lowered()[points]
        for k, size in enumerate((1 << 40, *PREFIXES)):
            hashed = mixed(span_hashes(values, begin, np.minimum(end, begin + size)) + np.uint64(k))
            buckets[:, k] = hashed % np.uint64(BUCKETS)
    return begin, end, buckets, np.searchsorted(begin, starts)


def messages(evidence: np.ndarray, at: np.ndarray, transitions: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of toxic by token: from the token alone, with all before it, and what those behind it add; ``evidence``: log odds by token, ``at``: first token of each text, then the end."""
    odds = np.exp(np.clip(evidence, -30, 30).astype(np.float64))
    t = np.exp(transitions)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    begin, size = at[:-1][order], size[order]
    forward, backward = np.zeros(len(odds)), np.ones(len(odds))
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")
    now = np.full(int(live[0]) if longest else 0, np.exp(start))
    for i in range(longest):
        m = live[i]
        spot = begin[:m] + i
        now = now[:m] * odds[spot] if not i else (t[0, 1] + t[1, 1] * now[:m]) / (t[0, 0] + t[1, 0] * now[:m]) * odds[spot]
        forward[spot] = now
    for i in range(longest - 2, -1, -1):
        spot = begin[: live[i + 1]] + i
        after = odds[spot + 1] * backward[spot + 1]
        backward[spot] = (t[1, 0] + t[1, 1] * after) / (t[0, 0] + t[0, 1] * after)
    return odds, forward, backward


def marginals(evidence: np.ndarray, at: np.ndarray, transitions: np.ndarray, start: float) -> np.ndarray:
    """The probability that each token is toxic."""
    _, forward, backward = messages(evidence, at, transitions, start)
    both = forward * backward
    return both / (1 + both)


def expected_transitions(odds: np.ndarray, forward: np.ndarray, backward: np.ndarray, inner: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """How often each pair of states is expected at the tokens ``inner`` and those before them: sums of pairwise marginals."""
    t = np.exp(transitions)
    f, b = forward[inner - 1], odds[inner] * backward[inner]
    pairs = np.array([[np.full(len(inner), t[0, 0]), t[0, 1] * b], [t[1, 0] * f, t[1, 1] * f * b]])
    return (pairs / pairs.sum((0, 1))).sum(2)


@dataclass
class Model:
    weights: np.ndarray
    transitions: np.ndarray
    start: float
    document: np.ndarray  # of the document score: weights of `summaries`


def summaries(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1, log(1 + sum of the marginals), their max, log(1 + tokens) of each text."""
    out = np.zeros((len(at) - 1, 4))
    out[:, 0] = 1
    out[:, 3] = np.log1p(np.diff(at))
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full, 1] = np.log1p(np.add.reduceat(p, at[:-1][full]))
        out[full, 2] = np.maximum.reduceat(p, at[:-1][full])
    return out


def token_labels(buckets: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of the tokens: toxic are those, in toxic texts, with a feature that one in 40 toxic texts and at least five have, and a 15 times smaller share of the clean ones (plus one)."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pair = np.unique(doc.astype(np.int64)[:, None] * BUCKETS + buckets)
    bad = toxic[pair // BUCKETS]
    a = np.bincount(pair[bad] % BUCKETS, minlength=BUCKETS)
    b = np.bincount(pair[~bad] % BUCKETS, minlength=BUCKETS)
    share, other = a / max(1, toxic.sum()), (b + 1) / max(1, (~toxic).sum())
    tells = (a >= max(5, 0.025 * toxic.sum())) & (share > 15 * other)
    return tells[buckets].any(1) & toxic[doc]


def fit(texts: list[tuple[str, bool]]) -> Model | None:
    """Learns from ``(text, toxic)`` pairs; none if either kind is missing."""
    blocks = [tokens(points, starts)[2:] for _, _, points, starts, _ in text_blocks([t for t, _ in texts], 1 << 40)]
    toxic = np.array([x for _, x in texts], bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    buckets, at = blocks[0]
    y = token_labels(buckets, at, toxic).astype(np.float64)
    inner = np.ones(len(buckets), bool)  # tokens with one before them in their text
    inner[at[:-1][np.diff(at) > 0]] = False
    inner = np.flatnonzero(inner)
    used, slot = np.unique(buckets, return_inverse=True)
    slot = slot.reshape(buckets.shape).astype(np.int32)
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    w, trans, start = np.zeros(len(used)), np.zeros((2, 2)), prior
    trans[0, 1], trans[1, 0] = prior / 2, 0
    squares, squares_t = np.full(len(used), 1e-6), np.full((2, 2), 1e-6)
    want_t = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            want_t[i, j] = ((y[inner - 1] == i) & (y[inner] == j)).sum()
    for _ in range(STEPS):
        odds, forward, backward = messages(w[slot].sum(1), at, trans, start)
        p = forward * backward / (1 + forward * backward)
        g = np.bincount(slot.ravel(), np.repeat(y - p, FEATURES), len(used)) - 0.02 * w
        squares += g * g
        w += 0.7 * g / np.sqrt(squares)
        have = expected_transitions(odds, forward, backward, inner, trans)
        g_t = (want_t - have) / max(1, y.sum()) - 0.01 * trans
        squares_t += g_t * g_t
        trans = np.clip(trans + 0.1 * g_t / np.sqrt(squares_t), -8, 8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    x = summaries(marginals(w[slot].sum(1), at, trans, start), at)
    v, ridge = np.zeros(4), np.diag([1e-3, 1e-2, 1e-2, 1e-1])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (toxic - q) - ridge @ v)
        v += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return Model(weights, trans, float(start), v)


def training_texts(docs: DataFrame, labels: DataFrame, where: Column) -> list[tuple[str, bool]]:
    """At most so many distinct texts of each kind, those of least hash, with their labels; a text marked both ways counts as toxic.

    Chosen are only texts that can be learned from: labelled, not null, not over ``TRAIN_BYTES``. Rows that share a doc_id
    share its label.
    """
    known = labels.filter(where & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = docs.filter(F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES)).select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    texts = written(usable.select("doc_id", "h").join(known, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")), "labelled")
    chosen = [r for value, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)) for r in texts.filter(F.col("toxic") == value).orderBy("h").limit(most).collect()]
    if not chosen:
        return []
    marks = {r["h"]: bool(r["toxic"]) for r in chosen}
    rows = usable.filter(F.col("doc_id").isin([r["doc_id"] for r in chosen]) & F.col("h").isin(list(marks)))
    found = rows.groupBy("h").agg(F.min("text").alias("text")).collect()
    return [(r["text"], marks[r["h"]]) for r in sorted(found, key=lambda r: r["h"])]


def scored(model: Model | None, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
    """Score and toxic spans of each text."""
    spans: list[list[dict]] = [[] for _ in texts]
    if model is None or not texts:
        return np.zeros(len(texts)), spans
    parts = []
    for first, _, points, starts, _ in text_blocks(texts):
        begin, end, buckets, at = tokens(points, starts)
        parts.append((first, model.weights[buckets].sum(1), at, starts, begin.astype(np.int32), end.astype(np.int32)))
    before = np.cumsum([0, *(len(x[1]) for x in parts)])
    at = np.append(np.concatenate([x[2][:-1] + b for x, b in zip(parts, before[:-1], strict=True)]), before[-1]).astype(np.int64)
    p = marginals(np.concatenate([x[1] for x in parts]), at, model.transitions, model.start)
    for (first, _, own, starts, begin, end), b in zip(parts, before[:-1], strict=True):
        for k in np.flatnonzero(p[b : b + len(begin)] >= 0.5).tolist():
            doc = int(np.searchsorted(own, k, side="right")) - 1
            spans[first + doc].append({"begin": int(begin[k] - starts[doc]), "end": int(end[k] - starts[doc]), "p": float(p[b + k])})
    return 1 / (1 + np.exp(-np.clip(summaries(p, at) @ model.document, -30, 30))), spans


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score, predicted, spans)`` of each row; spans: begin and end of toxic tokens in code points, with the marginal."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            score, spans = scored(shared.value, batch.column(1).to_pylist())
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], ["doc_id", "score", "predicted", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<begin: int, end: int, p: double>>")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(training_texts(docs, labels, ~held_out(5, 0))))
    return kept_rows(docs, lambda texts: scored(shared.value, texts)[0] < 0.5)


def rate_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels outside the held-out fifth and scores every row: doc_id, held_out, score, predicted, spans."""
    model = fit(training_texts(docs, labels, ~held_out(5, 0)))
    return score_documents(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "spans")
