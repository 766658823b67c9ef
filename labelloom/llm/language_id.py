"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``ORDER`` is counted on labelled texts and then frozen. A byte is
coded in the longest context that the language knows; where it wasn't seen there, an escape is paid and the next
shorter context codes it, down to one in 256 for any byte. With escapes by method C, count / (total + distinct) for
a seen byte and distinct / (total + distinct) for the escape, a text's code length under each language is an exact
sum; the shortest wins, ties by name, and the score is its share of the probability. Whole texts are scored.

Null text and text without a letter are ``und`` with score 0, as is everything when no labelled text is there. Repeated
rows count once in training and are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import HashTable, kept_rows, parts_of, written

#: Length of the longest context in bytes.
ORDER = 3
#: The bound on what is learned from: texts of each language, and bytes of a text.
TRAIN_TEXTS, TRAIN_BYTES = 300, 1 << 15
#: More languages than this are an error.
LANGUAGES = 256
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """``order + 1`` bytes ending at each position as one word, tagged with their number; positions before have wrapped ones."""
    out = np.zeros(len(data), np.uint64)
    for back in range(order, -1, -1):
        out <<= np.uint64(8)
        out[back:] |= data[: len(data) - back]
    return out


@dataclass
class Model:
    languages: list[str]
    symbols: list[HashTable]  # by order: context and byte -> row of codes
    codes: list[np.ndarray]  # bits in each language
    contexts: list[HashTable]  # by order: context -> row of escapes
    escapes: list[np.ndarray]  # bits in each language, 0 where it doesn't know the context

    def bits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each text ``data[starts[i]:starts[i + 1]]`` (none empty) in each language."""
        n, order = len(data), len(self.symbols) - 1
        out = np.zeros((n, len(self.languages)), np.float32)
        at = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
        left = np.arange(n)
        for k in range(order, -1, -1):
            keys = grams(data, k)
            keys = keys if k == order and len(left) == n else keys[left]
            row = self.symbols[k].find(keys)
            if k:
                row[at[left] < k] = -1
            seen = row >= 0
            if seen.all():
                out[left] += self.codes[k][row]
                break
            out[left[seen]] += self.codes[k][row[seen]]
            keys, left = keys[~seen], left[~seen]
            row = self.contexts[k].find(keys >> np.uint64(8))
            known = (row >= 0) & (at[left] >= k)
            out[left[known]] += self.escapes[k][row[known]]
        return np.add.reduceat(out, starts[:-1], axis=0, dtype=np.float64)


def fit(texts: list[tuple[str, str]], order: int = ORDER) -> Model:
    """The model of ``(language, text)`` pairs."""
    languages = sorted({lang for lang, _ in texts})
    counted = []  # by language and order: grams and their counts
    for lang in languages:
        own = [t.encode() for name, t in texts if name == lang and t]
        data = np.frombuffer(b"".join(own), np.uint8)
        starts = np.cumsum([0, *map(len, own)])[:-1]
        at = np.arange(len(data)) - np.repeat(starts, [len(t) for t in own])
        counted.append([np.unique(grams(data, k)[at >= k], return_counts=True) for k in range(order + 1)])
    symbols, codes, contexts, escapes = [], [], [], []
    for k in range(order + 1):
        all_keys = np.unique(np.concatenate([c[k][0] for c in counted])) if k else np.arange(256, dtype=np.uint64)
        all_contexts = np.unique(all_keys >> np.uint64(8))
        code = np.zeros((len(all_keys), len(languages)), np.float32)
        escape = np.zeros((len(all_contexts), len(languages)), np.float32)
        if k:  # what a byte costs after an escape
            low = all_keys & ((np.uint64(1) << np.uint64(8 * k)) - np.uint64(1))
            shorter = codes[k - 1][symbols[k - 1].find(low)]
        else:
            shorter = np.full(code.shape, 8, np.float32)
        of = np.searchsorted(all_contexts, all_keys >> np.uint64(8))
        for i, per in enumerate(counted):
            keys, count = per[k]
            own = np.searchsorted(all_contexts, keys >> np.uint64(8))
            total = np.bincount(own, count, len(all_contexts))
            distinct = np.bincount(own, minlength=len(all_contexts))
            known = total > 0
            escape[known, i] = np.log2((total + distinct)[known] / distinct[known])
            code[:, i] = shorter[:, i] + escape[of, i]
            code[np.searchsorted(all_keys, keys), i] = np.log2((total + distinct)[own] / count)
        for tables, keys in ((symbols, all_keys), (contexts, all_contexts)):
            tables.append(HashTable(max(9, int(len(keys)).bit_length() + 1)))
            tables[-1].add(keys, np.arange(len(keys), dtype=np.int32))
        codes.append(code)
        escapes.append(escape)
    return Model(languages, symbols, codes, contexts, escapes)


def training_texts(docs: DataFrame, where: Column) -> list[tuple[str, str]]:
    """``TRAIN_TEXTS`` distinct texts of each language, or all there are, of the rows for which ``where`` holds.

    Those of least hash; longer texts than ``TRAIN_BYTES`` only where there are too few others, and then their beginning.
    """
    rows = docs.filter(where & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    rows = rows.select("lang", "text", (F.octet_length("text") > TRAIN_BYTES).alias("long"), F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"))
    distinct = written(rows.select("lang", "long", "h").distinct(), "hashes")
    found = distinct.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("long")).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    if not found:
        return []
    # about four times as many as are needed; the hash is spread evenly over distinct texts, so these are few rows
    quotas: dict[tuple[str, bool], int] = {}
    share = F.lit(0.0)
    for row in found:
        quotas[row["lang"], False] = min(TRAIN_TEXTS, row["short"])
        quotas[row["lang"], True] = min(TRAIN_TEXTS - quotas[row["lang"], False], row["long"])
        for long in (False, True):
            quota = quotas[row["lang"], long]
            if quota:
                part = min(1.0, max(4 * quota, 64) / row["long" if long else "short"])
                share = F.when((F.col("lang") == row["lang"]) & (F.col("long") == long), F.lit(part)).otherwise(share)
    few: dict[tuple[str, bool], list[int]] = {}
    for r in distinct.filter(F.col("h") / float(1 << 63) <= share).collect():
        few.setdefault((r["lang"], r["long"]), []).append(r["h"])
    chosen = [(lang, long, h) for (lang, long), hashes in few.items() for h in sorted(hashes)[: quotas[lang, long]]]
    if not chosen:
        return []
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, long boolean, h long"))
    some = rows.join(wanted, ["lang", "long", "h"]).withColumn("text", F.substring("text", 1, TRAIN_BYTES))
    got = some.groupBy("lang", "long", "h").agg(F.min("text").alias("text")).collect()
    return [(r["lang"], r["text"].encode()[:TRAIN_BYTES].decode(errors="ignore")) for r in sorted(got, key=lambda r: (r["lang"], r["long"], r["h"]))]


def predicted(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits a byte of each text."""
    raw = [(i, t.encode()) for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
    langs, scores, rates = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j][1]) <= 1 << 19):
            size += len(raw[j][1])
            j += 1
        starts = np.cumsum([0, *(len(t) for _, t in raw[i:j])])
        bits = model.bits(np.frombuffer(b"".join(t for _, t in raw[i:j]), np.uint8), starts)
        best = bits.argmin(1)
        least = bits[np.arange(len(best)), best]
        rows = [k for k, _ in raw[i:j]]
        scores[rows] = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
        rates[rows] = least / np.diff(starts)
        for k, b in zip(rows, best.tolist(), strict=True):
            langs[k] = model.languages[b]
        i = j
    return langs, scores, rates


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            langs, scores, rates = predicted(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rates)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, any others) whose language can be told."""
    texts = training_texts(docs, ~held_out(3, 1))
    shared = docs.sparkSession.sparkContext.broadcast(fit(texts) if texts else None)
    return kept_rows(docs, lambda texts: np.array([x != UNDETERMINED for x in predicted(shared.value, texts)[0]], bool))


def held_out(folds: int, which: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == which


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the held-out third and predicts every row: doc_id, held_out, lang_pred, score, bits_per_byte."""
    texts = training_texts(docs, ~held_out(3, 1))
    found = identify(docs, fit(texts) if texts else None)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "bits_per_byte")
