"""Tokens, packing, archives, language and toxicity against libraries, brute force and held-out labels."""

import base64
import hashlib
import io
import random
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm import byte_bpe, language_id, packing, queries, toxicity, warc

SF = "/root/testdata/sf0.001"
MULTI, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "'", "'s", "a's", " 's", "\n's", "''s", "!'s", "'re", "'r", "x'l", "it's   done  ", " ", "  ", "a" * 3000, "ab" * 900 + " " * 300, "'sword", "é'll", "\u3000\x85a\x1cb½²", "<|endoftext|>"]


def odd_texts(n=600):
    draw = random.Random(1)
    letters = list("aab 's'tre'll'd  \n\n\t \u3000éñ中文字123½٣!?_-'’\U0001f600\u0301\x85\x1c")
    return ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(n)]


def table(name):
    return duckdb.sql(f"select * from '{SF}/{name}.parquet'").fetchall()


def test_bpe_is_tiktoken():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts() + [r[1] for r in table("documents")]
    for (i, ids), text in zip(byte_bpe.encoded(texts, MULTI), texts, strict=True):
        assert ids.tolist() == enc.encode_ordinary(text or ""), repr(text)
        assert byte_bpe.encoder(MULTI).vocabulary.decode(ids) == (text or "").encode()


def test_bpe_is_tokenizers():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    texts = odd_texts()
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert all(ids.tolist() == w.ids for (_, ids), w in zip(byte_bpe.encoded(texts, JSON), want, strict=True))


def test_bpe_of_long_runs(monkeypatch):
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = Tokenizer.from_file(JSON)
    draw = random.Random(6)
    run = lambda of, n: "".join(draw.choice(of) for _ in range(n))
    prose = "".join(c for _, t, *_ in table("documents")[:40] for c in t if c.isalpha())
    texts = [run("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 20_000), run("ab", 3000), "a" * 5000, run("aab", 1000), prose[:30_000], run("éàüñ中文字", 2000), run("the and ing ion".replace(" ", ""), 8000), run("=-", 700)]
    monkeypatch.setattr(byte_bpe, "LONG", 8)  # short ones too
    texts += [run("abcdeinrst", draw.randint(9, 300)) for _ in range(300)]
    for (_, ids), text in zip(byte_bpe.encoded(texts, MULTI), texts, strict=True):
        assert ids.tolist() == enc.encode_ordinary(text), text[:60]
    for (_, ids), text in zip(byte_bpe.encoded(texts, JSON), texts, strict=True):
        assert ids.tolist() == own.encode(text, add_special_tokens=False).ids, text[:60]


def test_bpe_table_overflows(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 40)
    own = byte_bpe.Encoder(byte_bpe.Vocabulary.from_ranks(MULTI))
    big = byte_bpe.encoder(MULTI)
    for text in ("one two three four five", " ".join(f"w{i}" for i in range(300)), "one two"):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.array([0, len(points)])
        assert own.encode(points, starts, text)[0].tolist() == big.encode(points, starts, text)[0].tolist()


def test_op7(spark):
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, SF).collect()}
    for doc, text, *_ in table("documents"):
        assert got[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        best = min((r, i) for i, r in enumerate([*rooms, capacity]) if r >= x)
        if best[1] == len(rooms):
            rooms.append(capacity)
        rooms[best[1]] -= x
    return rooms


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_best_fit_decreasing(seed):
    draw, capacity = random.Random(seed), 50
    lengths = [draw.choice([draw.randint(1, 50), 7, 25]) for _ in range(400)]
    plan = packing.plan_windows(np.bincount(lengths, minlength=capacity + 1), capacity)
    used = {}
    for size, _, items, first, each, offset in plan.tolist():
        for i in range(items):
            used.setdefault(first + i // each, []).append((offset + i % each * size, size))
    for pieces in used.values():
        end = 0
        for offset, size in sorted(pieces):
            assert offset == end
            end += size
        assert end <= capacity
    want = best_fit_decreasing(lengths, capacity)
    assert sorted(capacity - sum(s for _, s in p) for p in used.values()) == sorted(want)


def test_op6(spark):
    t = Tokenizer.from_file(JSON)
    want = {r[0]: np.array([*t.encode(r[1], add_special_tokens=False).ids, 1], "<u4") for r in table("documents")}
    rows = queries.op6_packing(spark, SF).collect()
    held = {}
    for r in rows:
        piece = want[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for pieces in held.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))]).tolist()[:-1]
    assert sum(r.length for r in rows) > 0.97 * 2048 * len(held)


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "a b"), (3, "word " * 5000)], "doc_id long, text string")
    rows = packing.pack_documents(df, JSON, 64).collect()
    assert sorted(len(r.ids) for r in rows if r.doc_id in (1, 2)) == [1, 1, 1]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack_documents(df.limit(0), JSON).count() == 0


def test_encoding_takes_little_memory():
    """The pipeline's executors hold two workers beside their heap; texts are encoded some letters at a time, and tables made without a string a code point."""
    draw = random.Random(13)
    texts = [" ".join(f"w{draw.randrange(10**5)}" for _ in range(300)) for _ in range(1000)]
    list(byte_bpe.encoded(texts[:2], JSON))  # tables that stay
    tracemalloc.start()
    sizes = [len(ids) for _, ids in byte_bpe.encoded(texts, JSON)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    kinds = byte_bpe.classes.__wrapped__()
    table = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    whole = Tokenizer.from_file(JSON)
    assert sizes == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts] and (kinds == byte_bpe.classes()).all()
    assert most < 60 << 20
    assert table < 30 << 20


def test_packing_of_several_parts_of_a_batch(spark):
    df = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(2500)], "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(df, JSON, 64).collect()
    assert sorted(r.doc_id for r in rows) == list(range(2500))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "é", "x" * 9000), (6, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(pages)).collect()}
    assert {k: (v.warc_type, v.refers_to) for k, v in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 6: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert bytes(got[5].payload) == b"x" * 9000 and got[1].payload_bytes == 4 and got[1].payload is None
    assert all(r.warc_type == "response" for r in warc.read_warc(warc.write_warc(pages, 10_000)).collect())
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_warc_rejects_damage():
    records = [warc.record_bytes(i, "u", bytes([65 + i % 5]) * 200, None) for i in range(50)]
    out = io.BytesIO()
    warc.write_archive(out, iter(records))
    raw = out.getvalue()
    assert raw[:4] == warc.SKIPPABLE and [r for _, r in warc.frames(io.BytesIO(raw))] == records
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[:-9] + b"\0" + raw[-8:])))
    with pytest.raises(ValueError, match="no frame"):
        list(warc.frames(io.BytesIO(raw + b"junk!")))
    plain = zstandard.ZstdCompressor().compress(records[0])
    assert [r for _, r in warc.frames(io.BytesIO(plain))] == records[:1]
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse_record(records[0][:-6] + b"\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(records[0].replace(b"AAAA", b"AAAB", 1))


def foreign(kind, http, body, *more):
    block = http + body
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:6f0a7e7e-0000-4000-8000-000000000001>", b"WARC-Date: 2020-02-02T02:02:02Z", *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_of_others():
    kind = b"Content-Type: application/http; msgtype=response"
    cookies = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n two\r\nX-Odd: \xe9\r\n\r\n"
    got = warc.parse_record(foreign(b"response", cookies, b"hello", kind, b"WARC-Target-URI: http://x/", b"WARC-Concurrent-To: <urn:a>", b"WARC-Concurrent-To: <urn:b>"))
    assert got["payload"] == b"hello" and got["page_id"] is None and got["record_id"].startswith("<urn:uuid:") and got["payload_digest"] == warc.payload_digest(b"hello")
    assert warc.headers(cookies[17:-4], "")["set-cookie"] == "a=1, b=2" and warc.headers(cookies[17:-4], "")["x-long"] == "one two"
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    body = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    for digest in (b"sha1:" + warc.payload_digest(b"hello world").encode(), b"sha1:" + warc.payload_digest(body).encode(), b"sha256:" + hashlib.sha256(b"hello world").hexdigest().encode(), b"crc9:zz"):
        got = warc.parse_record(foreign(b"response", chunks, body, kind, b"WARC-Payload-Digest: " + digest))
        assert got["payload"] == b"hello world" and got["payload_bytes"] == 11
    with pytest.raises(ValueError, match="chunk"):
        warc.parse_record(foreign(b"response", chunks, b"5\r\nhel", kind))
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(foreign(b"response", chunks, body, kind, b"WARC-Payload-Digest: sha1:AAAA"))
    with pytest.raises(ValueError, match="length"):
        warc.parse_record(foreign(b"response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", b"hello", kind))
    assert warc.parse_record(foreign(b"response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n", b"hello", kind, b"WARC-Truncated: length"))["payload"] == b"hello"
    assert warc.parse_record(foreign(b"warcinfo", b"", b"software: x\r\n", b"Content-Type: application/warc-fields"))["payload"] == b"software: x\r\n"
    assert warc.parse_record(foreign(b"request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", b"", b"Content-Type: application/http; msgtype=request"))["payload_bytes"] == 0
    assert warc.parse_record(foreign(b"metadata", b"", b"", b"Content-Type: text/plain"))["payload"] == b""
    got = warc.parse_record(foreign(b"revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", b"", kind, b"WARC-Refers-To: <urn:uuid:1>"))
    assert got["refers_to_id"] == "<urn:uuid:1>" and got["refers_to"] is None and got["payload"] is None
    with pytest.raises(ValueError, match="header"):
        warc.parse_record(foreign(b"response", cookies, b"hello", kind, b"WARC-Type: request"))


def test_training_texts_of_copies_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TRAIN_TEXTS", 20)
    copies = [(i, "de", "immer das gleiche") for i in range(30_000)] + [(10**6 + i, "de", f"anderer text {i}") for i in range(25)]
    long = [(2 * 10**6 + i, "fr", f"é{i} " + "été " * 10_000) for i in range(3)] + [(3 * 10**6, "fr", "un texte court"), (3 * 10**6 + 1, "fr", None), (3 * 10**6 + 2, "fr", "")]
    docs = spark.createDataFrame(copies + long, "doc_id long, lang string, text string")
    got = language_id.training_texts(docs, F.lit(True))
    german, french = ({t for lang, t in got if lang == x} for x in ("de", "fr"))
    assert len(german) == 20 and len(french) == 4 and len(got) == 24
    assert "un texte court" in french and max(len(t.encode()) for t in french) in (language_id.TRAIN_BYTES - 1, language_id.TRAIN_BYTES)
    assert language_id.training_texts(docs.filter("text is null"), F.lit(True)) == []


def test_context_trees_by_hand():
    texts = [("a", "abab abba"), ("a", "bbb"), ("b", "xyxy zz"), ("b", "abz")]
    model = language_id.fit(texts, order=2)
    counts = {lang: {} for lang in "ab"}
    for lang, t in texts:
        for i in range(len(t)):
            for k in range(min(i, 2) + 1):
                counts[lang].setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                counts[lang][t[i - k : i]][t[i]] += 1

    def bits(lang, context, c):
        total = 0.0
        while True:
            seen = counts[lang].get(context)
            if seen:
                n, d = sum(seen.values()), len(seen)
                if c in seen:
                    return total + np.log2((n + d) / seen[c])
                total += np.log2((n + d) / d)
            if not context:
                return total + 8
            context = context[1:]

    tried = ["abz", "q", "xyab ba", "bbbb", "zzq abq"]
    starts = np.cumsum([0, *map(len, tried)])
    got = model.bits(np.frombuffer("".join(tried).encode(), np.uint8), starts)
    want = [[sum(bits(lang, t[max(0, i - 2) : i], t[i]) for i in range(len(t))) for lang in "ab"] for t in tried]
    assert np.allclose(got, want, atol=1e-4)


def test_op4(spark):
    truth = {r[0]: r[2] for r in table("documents")}
    rows = queries.op4_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    df = spark.createDataFrame([(1, None, "x"), (2, "12 !", None), (3, "abc", None), (None, "", "x")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify_documents(df).collect()} == {"und"}
    assert language_id.identify_documents(df.limit(0)).count() == 0


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    at = np.array([0, 3, 3, 7, 8])
    e, trans, start = rng.standard_normal(8), rng.standard_normal((2, 2)), 0.3
    got = toxicity.marginals(e, at, trans, start)
    for a, b in zip(at[:-1], at[1:], strict=True):
        weight = np.zeros(b - a)
        total = 0.0
        for code in range(1 << (b - a)):
            y = [(code >> i) & 1 for i in range(b - a)]
            s = sum(e[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)) + (start * y[0] if b > a else 0)
            total += np.exp(s)
            weight += np.exp(s) * np.array(y)
        assert np.allclose(got[a:b], weight / total)


def test_labelled_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_CLEAN", 3)
    rows = [(i, "copied text") for i in range(50)] + [(100 + i, f"clean {i}") for i in range(10)] + [(200, "foul"), (201, "foul"), (202, "x" * (toxicity.TRAIN_BYTES + 1)), (203, None), (100, "other text of 100"), (None, "nameless")]
    marks = [(i, int(i >= 200)) for i in [*range(50), *range(100, 110), *range(200, 204), 999]] + [(5, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.training_texts(docs, labels, F.lit(True))
    assert [t for t, bad in got if bad] == ["foul"] and len(got) == 4 and len({t for t, _ in got}) == 4
    assert toxicity.training_texts(docs, labels.limit(0), F.lit(True)) == [] == toxicity.training_texts(docs.limit(0), labels, F.lit(True))
    scored = toxicity.rate_documents(docs.limit(0), labels)
    assert scored.count() == 0


def test_gradient_of_the_field():
    """Expected tokens and transitions are the slopes of the log of the sum over all labellings."""
    rng = np.random.default_rng(3)
    at, start = np.array([0, 4, 4, 5, 8]), -0.4

    def log_sum(e, trans):
        out = 0.0
        for a, b in zip(at[:-1], at[1:], strict=True):
            total = 0.0
            for code in range(1 << (b - a)):
                y = [(code >> i) & 1 for i in range(b - a)]
                total += np.exp(sum(e[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)) + (start * y[0] if b > a else 0))
            out += np.log(total)
        return out

    e, trans, h = rng.standard_normal(8), rng.standard_normal((2, 2)), 1e-5
    inner = np.array([1, 2, 3, 6, 7])
    got = toxicity.expected_transitions(*toxicity.messages(e, at, trans, start), inner, trans)
    for i in (0, 1):
        for j in (0, 1):
            step = np.zeros((2, 2))
            step[i, j] = h
            assert abs((log_sum(e, trans + step) - log_sum(e, trans - step)) / (2 * h) - got[i, j]) < 1e-7
    p = toxicity.marginals(e, at, trans, start)
    for k in range(8):
        step = np.zeros(8)
        step[k] = h
        assert abs((log_sum(e + step, trans) - log_sum(e - step, trans)) / (2 * h) - p[k]) < 1e-7


def test_op2(spark):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    truth = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    bad, good = ([r for r in held if truth[r.doc_id] == x] for x in (1, 0))
    area = np.mean([(x.score > y.score) + 0.5 * (x.score == y.score) for x in bad for y in good])
    assert area > 0.85 and np.mean([r.predicted for r in bad]) >= 0.5 and np.mean([r.predicted for r in good]) <= 0.05
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "You IDIOT"), (4, "idiot " * 30)], "doc_id long, text string")
    model = toxicity.fit([("you are some plain text here", False)] * 30 + [("you idiot you", True)] * 30)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert got[4].predicted == 1 and got[None].spans[0].begin == 4 and got[None].spans[0].end == 9
    assert got[1].score == got[2].score < 0.5 and not got[1].spans
    assert {r.score for r in toxicity.score_documents(docs, None).collect()} == {0.0}
