"""Duplicates, fingerprints, neighbours and the pipeline against brute force."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.llm import components, fingerprints, near_duplicates, nearest, passages, queries, substrings

SF = "/root/testdata/sf0.001"


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def removed(rows, n=50):
    first, big = {}, 2**63 - 1
    for i, t in sorted((big if i is None else i, t or "") for i, t in rows):
        b = t.encode()
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], i)
    out = []
    for i, t in rows:
        b, j = (t or "").encode(), big if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < j:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, c in zip(b, gone, strict=True) if not c)).hexdigest()))
    return Counter(out)


def repeated_rows():
    draw = random.Random(5)
    shared = ["".join(draw.choice("abcdé ") for _ in range(draw.randint(30, 300))) for _ in range(20)]
    rows = [(i, "".join(draw.choice([draw.choice(shared), "".join(draw.choice("abc ") for _ in range(draw.randint(1, 80)))]) for _ in range(draw.randint(0, 8)))) for i in range(120)]
    return rows + [(None, shared[3]), (None, shared[4] * 2), (300, None), (301, ""), (7, rows[7][1]), (302, "a" * 500), (303, "a" * 400), (304, rows[5][1]), (305, "x" * 49)]


@pytest.mark.parametrize("frequent", [substrings.FREQUENT, 3])
def test_repeats_are_cut(spark, frequent, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 5000)
    rows = repeated_rows()
    df = frame(spark, rows).withColumn("kept", F.lit("q")).withColumn("block", F.lit(1))
    got = substrings.remove_repeats(df, 50, frequent=frequent).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == removed(rows)
    assert {r.block for r in got} == {1}
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_cover_ranks_sort_suffixes():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (60, 40)).astype(np.uint8)
    group = np.sort(rng.integers(0, 4, 60))
    for column, rank in substrings.cover_ranks(rows, group).items():
        order = np.argsort(rank, kind="stable")
        keys = [(group[i], rows[i, column:].tobytes()) for i in order]
        assert keys == sorted(keys)
        assert all((rank[order[i]] == rank[order[i + 1]]) == (keys[i] == keys[i + 1]) for i in range(59))


def linked(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")))
        sets.setdefault(i, []).append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            u, v = sorted((find(a), find(b)))
            parent[v] = u
    return {i: (sorted(map(len, sets[i])), find(i)) for i in sets}


@pytest.mark.parametrize(("words", "wide", "block"), [(4, 24, 5), (5, near_duplicates.WIDE, near_duplicates.BLOCK)])
def test_near_duplicates(spark, words, wide, block):
    draw, vocabulary = random.Random(3), [f"w{i}" for i in range(60)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 20, 60, 200]))] for _ in range(12)]
    rows = []
    for i in range(200):
        text = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "  "), (503, "A b"), (504, "a B"), (3, rows[3][1]), (505, "a b")]
    want, got = linked(rows, words, 80), {}
    for r in near_duplicates.near_duplicates(frame(spark, rows), words, 80, wide=wide, block=block).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
        assert r.kept == (r.doc_id == r.component_id)
    assert {i: (sorted(n for n, _ in x), x[0][1]) for i, x in got.items()} == want


def test_op9_is_its_sql(spark):
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        want = sorted(con.execute(queries.ORACLE["op9_minhash"]).fetchall())
    got = queries.op9_minhash(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == want


def test_near_duplicates_edges(spark):
    rows = near_duplicates.near_duplicates(frame(spark, [(None, "a b c"), (None, "a b c"), (1, "a b c")])).collect()
    assert len(rows) == 3 and all(r.kept for r in rows)
    assert near_duplicates.near_duplicates(frame(spark, []), 4).count() == 0


def test_near_duplicates_of_texts_that_share_an_id(spark):
    draw = random.Random(9)
    x, y = ([f"w{draw.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    rows = [(3, " ".join(x)), (3, " ".join(y)), (5, " ".join([*x, "zz"])), (9, " ".join([*y, "yy"])), (7, "else"), (7, " ".join([*x, "aa"]))]
    got = {(r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (7, 3)}
    assert {(i, root) for i, (_, root) in linked(rows, 5, 80).items()} == got


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (3, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 50, 70: 50}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
    got = {r.node: r.root for r in components.forest_roots(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 70), (50, 100)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 50, 70: 50}
    assert components.forest_roots(spark.createDataFrame([], "u long, v long")).count() == 0


def winnowed(raw, names):
    """The fingerprint by the definition: of each window the least hash, the rightmost of equal ones, with its position."""
    if not raw:
        return []
    k, w = fingerprints.GRAM, fingerprints.WINDOW
    if len(raw) < k:
        found = [names[raw]]
    else:
        found = []
        for p in range(len(raw) - k + 1):
            h = 0
            for c in raw[p : p + k]:  # rolled from scratch: shifted on, the next byte's hash added without carry
                h = ((h << 1) ^ names[bytes([c])]) & (2**64 - 1)
            found.append(h)
    found = [(h - 2**64 if h >> 63 else h) >> 10 for h in found]
    spots = {max(range(i, min(i + w, len(found))), key=lambda p: (-found[p], p)) for i in range(max(1, len(found) - w + 1))}
    return [(found[p], p) for p in sorted(spots)]


def winnowing_rows():
    draw = random.Random(4)
    letters = lambda n, of="abcdé \U0001f600": "".join(draw.choice(of) for _ in range(n))
    rows = [(1, "abc"), (2, None), (3, ""), (5, "x" * 500), (4, "é中文\U0001f600" * 20), (5, "x" * 500), (-7, "y"), (6, "same"), (6, "other")]
    rows += [(10 + i, letters(draw.choice([0, 5, 11, 12, 13, 40, 42, 43, 44, 80, 86, 130, 300, 1000]))) for i in range(70)]
    rows += [(200 + i, letters(n, of)) for i, (n, of) in enumerate([(1021, "ab"), (1022, "ab"), (1023, "ab"), (1024, "a"), (2001, "a"), (2003, "ab"), (5000, "ab"), (7, "a"), (3000, "abcdefgh"), (1, "a")])]
    return rows + [(None, "a text without a number"), (None, None)]


def test_winnowing(spark):
    rows = winnowing_rows()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, _to int, cells int").repartition(3)
    got = fingerprints.fingerprint_edits(df).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    edits = []
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edits.append((i, t, t[: len(t) - half] + after[:half], after))
    short = {x for _, *texts in edits for t in texts if 0 < len(x := t.encode()) < fingerprints.GRAM} | {bytes([c]) for c in range(256)}
    names = {r.x: r.h % 2**64 for r in spark.createDataFrame([(bytearray(x),) for x in short], "x binary").select("x", F.xxhash64("x").alias("h")).collect()}
    names = {bytes(x): h for x, h in names.items()}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for i, t, edited, after in edits:
        one, two, three = (winnowed(x.encode(), names) for x in (t, edited, after))
        text = lambda cells: " ".join(f"{h % 2**54:X}:{p}" for h, p in cells)
        h1, h2, h3 = ({h for h, _ in x} for x in (one, two, three))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(one), text(two), alike(h1, h2), alike(h1, h3)))
    assert Counter(map(tuple, got)) == Counter(want)


def test_winnowing_edges(spark, monkeypatch):
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    assert fingerprints.fingerprint_edits(frame(spark, [(7, "abc")])).first().near_next == 1
    rows = winnowing_rows()
    whole = Counter(map(tuple, fingerprints.fingerprint_edits(frame(spark, rows)).collect()))
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 400)  # many ranges: the same
    assert Counter(map(tuple, fingerprints.fingerprint_edits(frame(spark, rows)).collect())) == whole


def test_winnowing_over_blocks(spark):
    draw = random.Random(9)
    sizes = [n * fingerprints.BLOCK + fingerprints.REACH + d for n in (0, 1, 2, 80) for d in (-2, -1, 0, 1)]
    rows = [(i, "".join(draw.choice(of) for _ in range(n))) for i, (n, of) in enumerate(itertools.product(sizes, ("abcdefgh", "ab", "a")))]
    names = {bytes(r.x): r.h % 2**64 for r in spark.createDataFrame([(bytearray([c]),) for c in range(256)], "x binary").select("x", F.xxhash64("x").alias("h")).collect()}
    found = fingerprints.fingerprint_edits(frame(spark, rows))
    got = {r.doc_id: r.fingerprint for r in found.collect()}
    assert got == {i: " ".join(f"{h % 2**54:X}:{p}" for h, p in winnowed(t.encode(), names)) for i, t in rows}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan
    assert not re.search(r"lambdafunction\((xxhash64|least)", plan)  # the work on bytes is generated code, not lambdas


def test_shared_passage_is_found(spark):
    draw = random.Random(2)
    text = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    common = text(fingerprints.GRAM + fingerprints.WINDOW - 1)
    rows = fingerprints.fingerprints(frame(spark, [(1, text(100) + common + text(90)), (2, text(33) + common + text(7)), (2, None)]))
    assert {(r.doc_id, r.n_bytes > 0, len(r.cells) > 0) for r in rows.collect()} == {(1, True, True), (2, True, True), (2, False, False)}
    assert any(r.at_a - r.at_b == 67 for r in fingerprints.shared_passages(rows.filter("doc_id = 1"), rows.filter("doc_id = 2")).collect())


def brute_nearest(rows, k, step):
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in sound:
        if i % step == 0:
            found = sorted((-float(np.cumsum(np.array(v) * np.array(w))[-1]), j) for j, w in sound if len(w) == len(v) and (j, w) != (i, v))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE_VECTORS", 70)
    monkeypatch.setattr(nearest, "TILE_QUERIES", 9)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(24).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [float("inf")] + [1.0] * 23), (1005, [None] + [1.0] * 23), (None, [1.0] * 24), (40, rows[40][1]), (1010, rows[41][1]), (2000, [1.0, 2.0])]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {k: v for k, v in brute_nearest(rows, 20, 20).items() if v}
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hits > 0.99
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_cartesian_tree_windows():
    rng = np.random.default_rng(2)
    for _ in range(40):
        at = np.cumsum([0, *rng.integers(0, 40, 5)])
        h = rng.integers(0, 30, at[-1]).astype(np.uint64) << np.uint64(20)
        node = passages.roots(h, at, 6)
        low, high = passages.extents(h, at, node)
        want = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            for p in range(a, b):
                x = y = p
                while x > a and h[x - 1] > h[p]:
                    x -= 1
                while y + 1 < b and h[y + 1] >= h[p]:
                    y += 1
                if y - x >= 5:
                    want.append((p, x, y))
        assert want == list(zip(node, low, high, strict=True))


def test_windows_of_many_texts():
    rng = np.random.default_rng(3)
    size = np.append(rng.integers(0, 400, 5000), [0, 100_000, 45, 46, 0])
    at = np.cumsum(np.append(0, size))
    h = passages.mixed(rng.integers(0, at[-1], at[-1]).astype(np.uint64))
    tracemalloc.start()
    key, node = passages.compact_windows(h, at, 2, 46)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < h.nbytes  # some texts at a time
    found = [passages.compact_windows(h[a:b], np.array([0, b - a]), 2, 46) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert np.array_equal(key, np.concatenate([k for k, _ in found]))
    assert np.array_equal(node, np.concatenate([p + a for (_, p), a in zip(found, at, strict=False)]))


def test_passages_release_their_shuffles(spark, monkeypatch):
    draw = random.Random(8)
    rows = [(i, " ".join(f"{draw.getrandbits(40):x}" for _ in range(1000))) for i in range(60)]
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    write, left = passages.written, {}

    def spied(df, name):
        before = held()
        out = write(df, name)
        end = time.time() + 3  # they are removed in the background
        while name == "windows" and (held() - before) and time.time() < end:
            time.sleep(0.1)
        left[name] = held() - before
        return out

    monkeypatch.setattr(passages, "written", spied)
    found = passages.near_passages(frame(spark, rows))
    assert left["windows"] == set()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert found.count() == 60 and found.collect() == found.collect()


def test_passages(spark):
    draw = random.Random(1)
    word = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    shared, rows, truth = [word(n) for n in (51, 80, 200)], [], {}
    for i in range(40):
        text = word(draw.randint(0, 150))
        if i % 4 == 0:
            k, cut = draw.randrange(3), draw.randint(0, len(text))
            piece = list(shared[k])
            if k:
                piece[20] = "changed" + str(i)
            text = text[:cut] + piece + text[cut:]
            truth.setdefault(k, []).append(i)
        rows.append((i, " ".join(text)))
    rows += [(500, None), (501, ""), (502, rows[5][1]), (None, rows[0][1])]
    got = {r.doc_id: r for r in passages.near_passages(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and got[502].component_id == 5 and got[None].n_passages == 0
    for ids in truth.values():
        assert {got[i].component_id for i in ids} == {ids[0]}
    inside = {i for ids in truth.values() for i in ids}
    assert all(not r.n_passages for i, r in got.items() if i not in inside)
    assert passages.near_passages(frame(spark, [])).count() == 0


def test_passages_behind_scattered_firsts(spark, monkeypatch):
    """Two texts share a passage, but other texts that hold a slice of it come first under most functions."""
    draw = random.Random(8)
    word = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    rows, many = [], 20
    for k in range(many):
        passage = word(60)
        rows += [(10 * k + i, " ".join(word(40) + passage[20 * i : 20 * i + 20] + word(40))) for i in range(3)]
        rows += [(10 * k + 5 + i, " ".join(word(30) + passage + word(30))) for i in range(2)]
    for short, block in ((passages.SHORT_LIST, passages.BLOCK), (1, 2)):
        monkeypatch.setattr(passages, "SHORT_LIST", short)
        monkeypatch.setattr(passages, "BLOCK", block)
        got = {r.doc_id: r.component_id for r in passages.near_passages(frame(spark, rows)).collect()}
        assert [got[10 * k + 6] for k in range(many)] == [10 * k + 5 for k in range(many)]


@pytest.mark.parametrize("short", [64, 1])
def test_texts_that_share_a_line_are_not_paired(spark, monkeypatch, short):
    """A line of many texts that is no passage leads to no pairs, and the passages that some of them share are found all the same."""
    draw = random.Random(11)
    word = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    line, passage = word(44), word(70)
    rows = [(i, " ".join(word(60) + line + word(60))) for i in range(200)]
    # three slices come first under most functions; two texts share the whole of it, behind the line
    rows += [(200 + i, " ".join(line + word(40) + passage[23 * i : 23 * i + 23] + word(40))) for i in range(3)]
    rows += [(300 + i, " ".join(word(10 * i) + line + word(50) + passage)) for i in range(2)]
    counts = []

    def counted(df, name, written=passages.written):
        out = written(df, name)
        counts.append((name, out.count()))
        return out

    monkeypatch.setattr(passages, "written", counted)
    monkeypatch.setattr(passages, "SHORT_LIST", short)
    got = {r.doc_id: r for r in passages.near_passages(frame(spark, rows)).collect()}
    assert [(p.begin, p.end, p.other, p.near_begin, p.near_end) for p in got[301].passages if p.other == 300] == [(104, 174, 300, 94, 164)]
    assert got[301].component_id == 300 and sum(r.n_passages for r in got.values()) == 1
    assert sum(n for name, n in counts if name == "pairs") < 3 * len(rows)


def test_all_passages_of_a_pair(spark):
    draw = random.Random(3)
    word = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    edited = lambda x: [f"c{i}" if i % 20 == 19 else t for i, t in enumerate(x)]
    left, core, right, second = word(120), word(64), word(120), word(90)
    # flanks too unlike to stand with the core, and another passage far off
    rows = [(1, " ".join(left + core + right + word(300) + second)), (2, " ".join(second + word(40) + edited(left) + core + edited(right)))]
    found = [(p.begin, p.end, p.near_begin, p.near_end) for r in passages.near_passages(frame(spark, rows, 1)).collect() for p in r.passages]
    assert (0, 90, 604, 694) in found
    assert any(begin <= 250 and end >= 314 and x <= 120 and y >= 184 for begin, end, x, y in found)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, columns = docs.count(), docs.columns
    docs = docs.unionByName(spark.createDataFrame([(9000, None, None, None, None), (9001, "12 34", "en", "s", 5)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert len(after) == start
        elif name == "minhash":
            want = linked(list(before.items()), 5, 80)
            assert set(after) == {i for i, (_, root) in want.items() if i == root}
        elif name == "suffix_array":
            want = {r[0]: r[2] for r in removed(list(before.items()))}
            assert {i: len((before[i] or "").encode()) - len(r.text.encode()) for i, r in after.items()} == want
            assert all(r.n_chars == len(r.text) for r in after.values())
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_is_exact_over_many_blocks(spark, monkeypatch, kind):
    """Large groups of copies, lengths far apart and one id of two vectors: the result is brute force's to the last tie."""
    monkeypatch.setattr(nearest, "TILE_VECTORS", 64)
    monkeypatch.setattr(nearest, "TILE_QUERIES", 8)
    monkeypatch.setattr(nearest, "STEP", 3)
    rng = np.random.default_rng(6)
    one = lambda scale=1.0: (rng.standard_normal(8) * scale).astype(np.float32).tolist()
    common, far = one(), 1e20 if kind == "double" else 1e10
    rows = [(i, common if i % 3 == 0 else one([1.0, 1e-9, far][i % 7 % 3])) for i in range(400)]
    rows += [(40, one()), (41, rows[42][1]), (500, [1.0, -0.0, 2.0]), (520, [0.5, 0.0, 1.0]), (3, rows[3][1])]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5), F.col("vec_id") % 20 == 0, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    sound = {(i, tuple(v)) for i, v in rows}
    want = {}
    for i, v in sound:
        if i % 20 == 0:
            want.setdefault(i, []).extend((-float(np.cumsum(np.array(v) * np.array(w))[-1]), j) for j, w in sound if len(w) == len(v) and (j, w) != (i, v))
    assert got == {i: [(j, -s) for s, j in sorted(x)[:6]] for i, x in want.items() if x}


def test_no_vector_is_shuffled_for_each_line_of_queries(spark, monkeypatch):
    """The search reads the packed vectors as they were written; the grid it replaced sent each vector to each line of queries."""
    monkeypatch.setattr(nearest, "TILE_QUERIES", 2)
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    plan = nearest.nearest(vectors, F.col("vec_id") % 20 == 0, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_shingles_take_little_memory():
    """The pipeline's executors hold two workers beside their heap; shingles of many texts are made some letters at a time."""
    draw = random.Random(12)
    texts = [" ".join(f"w{draw.randrange(10**5)}" for _ in range(350)) for _ in range(1000)]
    for _ in near_duplicates.shingles(texts[:2], 5):  # tables that stay
        pass
    tracemalloc.start()
    sizes = [len(x) for x in near_duplicates.shingles(texts, 5)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sizes) == 1000 and max(sizes) == 346
    assert most < 20 << 20


def test_anchors_take_little_memory():
    """A block's strings are found some texts at a time, and their bytes taken some anchors at a time."""
    draw = random.Random(14)
    texts = ["".join(draw.choices("abcdefgh ", k=1500)).encode() for _ in range(1000)]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    keys = np.unique(substrings.sliced(data, starts, 50)[1])
    frequent = np.zeros(len(keys), bool)
    tracemalloc.start()
    _, _, rows, low, high, where, _ = substrings.described(data, starts, 50, keys, frequent)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) > 80_000
    for i in range(0, len(rows), 997):
        a, b = where[i] - 32 + int(low[i]), where[i] - 32 + int(high[i]) - 1 + 50
        assert rows[i, low[i] : int(high[i]) + 49].tobytes() == data[a:b].tobytes()
    assert most < 80 << 20


def test_within():
    rng = np.random.default_rng(13)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (40, 7), (7, 40), (300, 300)):
        a, b = (rng.integers(0, 60, x).astype(np.uint64) << np.uint64(58) for x in (n, m))
        assert passages.within(a, b).tolist() == np.isin(a, b).tolist()
