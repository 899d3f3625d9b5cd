"""Near duplicates, vector search, packing and the pipeline against plain code."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratafold.llm import chosen_path, column_search, packing
from stratafold.llm.components import components
from tests_llm_helpers import sentence


def plain_near(rows, threshold=0.8, size=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        n = min(size, len(w))
        sets.append(frozenset((n, *w[i:i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    distinct = sorted(set(sets), key=repr)
    root = {s: s for s in distinct}
    links = Counter()

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if a and b and len(a & b) >= threshold * len(a | b):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    members = defaultdict(list)
    for (doc, _), s in zip(rows, sets):
        members[find(s)].append(doc)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    copies = Counter(sets)
    return sorted(((d, least[find(s)], links[s], copies[s] - 1) for (d, _), s in zip(rows, sets)), key=repr)


def near_rows(rng):
    rows = []
    for group in range(6):
        words = sentence(rng, 150).split()
        for _ in range(rng.choice([1, 3, 12, 90])):
            own = list(words)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(["neu", "anders", "fremd"])
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("small", [4, 64])
def test_near_duplicates(make_docs, awkward, small):
    rng = random.Random(21)
    rows = near_rows(rng)
    rows += [(1000 + (i or 0) if i is not None else None, t) for i, t in awkward]
    docs = make_docs(rows).withColumn("class_id", F.lit(0)).withColumn("key", F.lit("k"))
    out = chosen_path.near_duplicates(docs, small=small)
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in out.collect()]
    assert sorted(got, key=repr) == plain_near(rows)


@pytest.mark.parametrize(("block", "block_bytes"), [(16, 8 << 20), (2048, 4096)])
def test_near_duplicates_in_many_blocks(make_docs, monkeypatch, block, block_bytes):
    """Blocks bounded by sets or by bytes: the same links and classes."""
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    monkeypatch.setattr(chosen_path, "BLOCK_BYTES", block_bytes)
    rows = near_rows(random.Random(22))
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in chosen_path.near_duplicates(make_docs(rows)).collect()]
    assert sorted(got, key=repr) == plain_near(rows)


@pytest.mark.parametrize("last", [False, True])
def test_large_bucket_passes_pairs_on(spark, last):
    """Drifting versions: neighbours are at 0.9, few are like a pivot; one bucket of close sets beside it settles."""
    drift = [np.array([1000 + (i + t) // 10 for t in range(10)] * 10, np.uint32) for i in range(40)]
    close = [np.array([5000 + i if t == 0 else 7 for t in range(100)], np.uint32) for i in range(20)]
    rows = [(0, 1, b"%04d" % i, s.tobytes()) for i, s in enumerate(drift)] + [(0, 2, b"%04d" % (100 + i), s.tobytes()) for i, s in enumerate(close)]
    buckets = spark.createDataFrame(rows, "run int, path bigint, key binary, sketch binary")
    out = chosen_path.compare_buckets(buckets, 100, 0.62, 4, last).collect()
    passed = {bytes(r["a"]) for r in out if r["kind"] == 1}
    root = {r[2]: r[2] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in out:
        if r["kind"] == 0:
            root[find(bytes(r["a"]))] = find(bytes(r["b"]))
    assert len({find(b"%04d" % (100 + i)) for i in range(20)}) == 1 and b"0100" not in passed
    for i in range(40):
        for j in range(i):
            if (drift[i] == drift[j]).mean() >= 0.8:
                a, b = b"%04d" % i, b"%04d" % j
                assert find(a) == find(b) or {a, b} <= passed
    assert not (last and passed)


@pytest.mark.parametrize("salt_rows", [30, 32_768])
def test_large_bucket_settles_in_part(spark, monkeypatch, salt_rows):
    """One bucket of near copies, drifting versions and strangers: the near copies rest, and no two alike sets are parted."""
    monkeypatch.setattr(chosen_path, "SALT_ROWS", salt_rows)
    rng = random.Random(14)
    base = [rng.randrange(1 << 20) for _ in range(100)]
    copies = [[rng.randrange(1 << 20) if rng.random() < 0.06 else x for x in base] for _ in range(60)]
    drift = [[2_000_000 + (i + t) // 10 for t in range(10)] * 10 for i in range(40)]
    half = [[x if t % 2 else rng.randrange(1 << 20) for t, x in enumerate(base)] for _ in range(3)]  # nearer than strangers, not alike
    sketches = [np.array(s, np.uint32) for s in (*copies, *drift, *half, *([rng.randrange(1 << 20) for _ in range(100)] for _ in range(20)))]
    rows = [(0, 1, b"%04d" % i, s.tobytes()) for i, s in enumerate(sketches)]
    buckets = spark.createDataFrame(rows, "run int, path bigint, key binary, sketch binary")
    out = chosen_path.compare_buckets(buckets, 100, 0.65, 24, False).collect()
    passed = {bytes(r["a"]) for r in out if r["kind"] == 1}
    graph = [(bytes(r["a"]), bytes(r["b"])) for r in out if r["kind"] == 0]
    root = {r[2]: r[2] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in graph:
        root[find(a)] = find(b)
    assert not passed & {b"%04d" % i for i in range(60)} and len(passed) >= 23
    for i in range(len(sketches)):
        for j in range(i):
            if (sketches[i] == sketches[j]).mean() >= 0.65:
                a, b = b"%04d" % i, b"%04d" % j
                assert find(a) == find(b) or {a, b} <= passed, (i, j)


@pytest.mark.parametrize("levels", [2, 4])
def test_descent_inside_a_task(levels):
    """At the last level two alike rows of one child are in one component; above it they are, or both go on."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 20, 64)
    rows = [np.where(rng.random(64) < share, rng.integers(0, 1 << 20, 64), base) for share in np.repeat([0.05, 0.3, 0.5, 0.9], 60)]
    rows += [np.array([2_000_000 + (i + t) // 10 for t in range(16)] * 4) for i in range(80)]
    sketches = np.array(rows, np.uint32)
    label = np.arange(len(rows))
    for own, others, alike, to, _ in chosen_path.descend(sketches, np.arange(len(rows)), 77, 2, levels, 0.65, 8, 0.1, 3):
        assert alike.shape == (len(own), len(others))
        chosen_path.join_labels(label, own, to)
    assert (label[label] == label).all()
    row, child = chosen_path.children(sketches, np.full(len(rows), 77, np.uint64), 2, 0.1, 3)
    shared = missed = 0
    for path in np.unique(child):
        own = np.unique(row[child == path])
        alike = chosen_path.agreement(sketches[own], sketches[own]) >= 0.65
        for i, j in np.argwhere(np.triu(alike, 1)):
            shared += 1
            missed += label[own[i]] != label[own[j]]
    assert shared > 1000 and (missed == 0 if levels == 2 else missed < 0.02 * shared)


def test_recall_by_similarity(spark, make_docs):
    """Thousands of near pairs, among them buckets over 64 sets: found in every band of similarity."""
    rng = random.Random(31)
    rows, groups = [], []
    for size in [*[8] * 60, 150]:
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(160)]
        own = []
        for _ in range(size):
            text = list(words)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"x{rng.random()}"
            own.append(len(rows))
            rows.append((len(rows), " ".join(text)))
        groups.append(own)
    docs = make_docs(rows)
    listed = chosen_path.embedded(docs, "doc_id", "text", 128, 5, 41).cache()
    near = chosen_path.neighbourhoods(listed.select("key", "sketch").distinct(), 0.8, 128, 0.15, 64, 4, 0.995, 9, 6, 41)
    root = {r["doc_id"]: bytes(r["root"]) for r in listed.join(near, listed["key"] == near["node"]).collect()}
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(156)} for i, t in rows}
    bands = Counter()
    for own in groups:
        for a in own:
            for b in own:
                if a < b and sets[a] != sets[b]:
                    alike = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                    if alike >= 0.8:
                        band = 0.8 if alike < 0.85 else 0.85 if alike < 0.9 else 0.9
                        bands[band, a in root and b in root and root[a] == root[b]] += 1
    for band in (0.8, 0.85, 0.9):
        found, missed = bands[band, True], bands[band, False]
        assert found + missed > 300 and found >= 0.99 * (found + missed), (band, found, missed)


def test_runs_until_recall(spark, make_docs, monkeypatch):
    """Where every set has a close copy, a single round of runs is not enough; pairs count by the runs that join them."""
    levels = []
    split = chosen_path.split
    monkeypatch.setattr(chosen_path, "split", lambda buckets, level, *rest: levels.append(level) or split(buckets, level, *rest))
    rng = random.Random(8)
    texts = [sentence(rng, 100) for _ in range(20)]
    found = chosen_path.near_duplicates(make_docs([(100 * k + i, t + f" Ende {k}") for k in range(4) for i, t in enumerate(texts)]))
    assert {r["n_links"] for r in found.collect()} == {3}
    assert levels.count(1) >= 2
    pairs = spark.createDataFrame([(b"a", b"b", False), (b"a", b"b", True), (b"a", b"c", False), (b"d", b"e", False)], "a binary, b binary, crowded boolean")
    roots = spark.createDataFrame([(b"0", n, b"a") for n in (b"a", b"b", b"c")] + [(b"1", n, b"a") for n in (b"a", b"c")] + [(b"1", b"b", b"b"), (b"1", b"d", b"d"), (b"1", b"e", b"d")],
                                  "run binary, node binary, root binary")
    assert sorted(chosen_path.found_once(pairs, roots)) == [(1, 1), (2, 1)]
    assert chosen_path.enough([(1000, 5)], 8, 0.995) and not chosen_path.enough([(1000, 5), (100, 1)], 8, 0.995)


def test_near_duplicates_edges(make_docs):
    assert chosen_path.near_duplicates(make_docs([])).count() == 0
    alone = chosen_path.near_duplicates(make_docs([(1, None), (2, ""), (3, "ein wort"), (4, "ein wort")])).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in alone) == [(1, 1, 0, 1), (2, 1, 0, 1), (3, 3, 0, 1), (4, 3, 0, 1)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(9, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


def test_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=24).astype("float32")], i % 7) for i in range(230)]
    rows += [(250, rows[3][1], 0), (300, rows[3][1], 0), (300, rows[3][1], 0), (301, None, 0), (350, [1.0, None], 0), (400, [float("nan")] * 24, 0), (450, [float("inf")] * 24, 0)]
    rows += [(500, [0.5, 0.5], 0), (501, [0.25, 1.0], 0), (None, rows[1][1], 0), (550, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    usable = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(usable):
        if i % 50 == 0:
            others = sorted((-int(q @ v), j) for m, (j, v) in enumerate(usable) if m != n and len(v) == len(q))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(others[:5])]
    for block, queries in ((40, 3), (4096, 512)):
        got = column_search.search(vectors, F.col("vec_id") % 50 == 0, block_rows=block, query_rows=queries).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert column_search.search(vectors.limit(0), F.lit(True)).count() == 0


def test_pruned_search_is_exact():
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(64, 900)) * np.linspace(300, 1, 64)[:, None]).astype(np.int64)
    q, ids = v[:, :20] + 1, np.arange(900)
    full = q.T @ v
    least = np.sort(full, axis=1)[:, -6].astype(float)
    rows, cols, values = column_search.best_pairs(q, np.full(20, -1), v, 0, ids, 5, least)
    for i in range(20):
        want = sorted(zip(-full[i], ids))[:5]
        assert [(-s, c) for s, c in zip(values[rows == i], cols[rows == i])] == [(int(s), int(c)) for s, c in want]
    with pytest.raises(ValueError):
        column_search.best_pairs(np.full((2, 1), 2**40), np.array([-1]), np.full((2, 1), 2**40), 0, np.array([1]), 1, np.array([-1.0]))


def test_packing_round_trip(make_docs, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    rows = awkward + [(60, "<|endoftext|> ist Text"), (61, "漢字　かな 😀 ​  \r\n x"), (62, "it's WE'LL 12345 \x00\x01")]
    want = sorted(((i, [*model.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows), key=repr)
    for width, segment in ((2048, 1 << 20), (64, 900)):
        docs = make_docs(rows, 2)
        pieces = packing.pack(docs, width=width, costs=packing.Costs(segment=segment)).collect()
        sequences, parts = defaultdict(list), defaultdict(list)
        for p in pieces:
            ids = np.frombuffer(p["ids"], "<u4").tolist()
            assert len(ids) == p["length"] > 0
            sequences[p["sequence_id"]].append((p["offset"], p["length"]))
            parts[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= width
        by_doc = defaultdict(list)
        for (doc, total), own in parts.items():
            by_doc[doc].extend(own)
        for doc, ids in want:
            if [d for d, _ in want].count(doc) == 1:
                own = sorted(by_doc[doc])
                assert [x for _, part in own for x in part] == ids and [s for s, _ in own] == np.cumsum([0, *(len(p) for _, p in own)])[:-1].tolist()
        assert sum(p["length"] for p in pieces) == sum(len(ids) for _, ids in want)
        lengths = [sum(n for _, n in own) for own in sequences.values()]
        if width == 2048:
            assert sum(width - n for n in lengths if n & (n - 1)) <= 0.02 * sum(lengths)
    assert packing.pack(make_docs([])).count() == 0


def test_best_cuts_is_optimal():
    rng = random.Random(2)
    costs = packing.Costs(window=3)
    for _ in range(60):
        at = np.cumsum([0, *(rng.randint(1, 9) for _ in range(rng.randint(1, 14)))])
        price, width = np.array([rng.choice([0, 2, 5]) for _ in at]), 16
        price[[0, -1]] = 0
        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + (0 if (n := at[j] - at[i]) & (n - 1) == 0 else width - n) + price[j] + 3 for i in range(j) if at[j] - at[i] <= width)
        cuts = packing.best_cuts(at, price, width, costs)
        got, a = 0, 0
        for b in cuts:
            n = b - a
            got += (0 if n & (n - 1) == 0 else width - n) + price[at.tolist().index(b)] + 3
            a = b
        assert got == best[len(at) - 1]


def test_pipeline_stages(spark, make_docs, tmp_path):
    rng = random.Random(31)
    rows = [(i, "\n".join(sentence(rng, 14) for _ in range(10)), "de", f"s{i % 4}") for i in range(40)]
    rows += [(100, rows[0][1], "de", "s0"), (101, "geändert " + rows[1][1].split(" ", 1)[1], "de", "s1"), (102, "kurz", "de", "s0"), (103, None, None, None)]
    rows += [(104, "\n".join(sentence(rng, 14) for _ in range(8)) + "\npassword = abcdefabcdefabcdef12 ende.", "de", "s2")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] == set(range(40)) | {100, 101, 104} and ids[1] == ids[2] == set(range(40)) | {104}
    assert "[SECRET]" in seen[2].where("doc_id = 104").first()["text"] and seen[2].where("text LIKE '%abcdefabcdef%'").count() == 0
    tokens = sum(r["length"] for r in seen[4].collect())
    assert tokens > 0 and {r["doc_id"] for r in seen[4].collect()} == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == tokens


def test_pipeline_rereads_stages(spark, make_docs, monkeypatch, tmp_path):
    read = []

    def stage(spark, docs, sf_dir):
        read.append([f.rsplit("/", 2)[-2] for f in docs.inputFiles()])
        return docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 1)

    make_docs([(i, "ein Text") for i in range(5)]).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second", stage)])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3, 4, 5, 6]
    assert [set(r) for r in read] == [{"documents.parquet"}, {"0"}] and all("/pipeline-" in f for f in out.inputFiles())


def test_every_query_is_registered():
    import __spark_entry__ as contract
    names = contract.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in names if x.startswith("op")}
    assert "pipeline" in names


def test_crc_is_of_little_endian_ids(spark):
    raw = np.array([5, 70000], "<u4").tobytes()
    assert spark.range(1).select(F.crc32(F.lit(bytearray(raw)))).first()[0] == zlib.crc32(raw)


def test_links_do_not_depend_on_where_a_bucket_is_settled(spark, monkeypatch):
    """Buckets followed inside a task and buckets shuffled level by level give the same components of every run and the same pairs."""
    rng = np.random.default_rng(9)
    bases = rng.integers(0, 2**32, (12, 64), dtype=np.uint32)
    tables = [np.where(rng.random(64) < rng.choice([0.0, 0.1, 0.3]), rng.integers(0, 2**32, 64, dtype=np.uint32), bases[i % 12]) for i in range(240)]
    sets = spark.createDataFrame([(i.to_bytes(16, "big"), t.astype(np.uint32).tobytes()) for i, t in enumerate(tables)], "key binary, sketch binary")
    keys = [r[0] for r in spark.range(1).select(F.xxhash64(F.lit(77).cast("bigint"), F.lit(b"0123456789abcdef"))).collect()]
    assert chosen_path.pivot_order(77, [b"0123456789abcdef"]).tolist() == keys
    outcomes = []
    for salt_rows in (32_768, 16):
        monkeypatch.setattr(chosen_path, "SALT_ROWS", salt_rows)
        links, pairs = set(), set()
        buckets = sets.select(F.lit(0).alias("run"), F.lit(5).cast("bigint").alias("path"), "key", "sketch")
        for level in (1, 2, 3):
            deeper = (level + 1, 3, 0.05, 3) if level < 3 else None
            found = chosen_path.compare_buckets(chosen_path.split(buckets, level, 64, 0.05, 3), 64, 0.65, 8, level == 3, 0.8, 1, sets, deeper).collect()
            links |= {(bytes(r["a"]), bytes(r["b"])) for r in found if r["kind"] == 0}
            pairs |= {(bytes(r["a"]), bytes(r["b"])) for r in found if r["kind"] == 2}
            on = [(0, r["path"], bytes(r["a"]), bytes(r["sketch"])) for r in found if r["kind"] == 1]
            if not on:
                break
            buckets = spark.createDataFrame(on, "run int, path bigint, key binary, sketch binary")
        label = {k: k for pair in links for k in pair}
        for _ in label:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        outcomes.append((label, pairs))
    assert outcomes[0][0] and outcomes[0] == outcomes[1]
    assert not hasattr(chosen_path, "ALL_PAIRS")  # recall is estimated on all pairs, however many sets there are


def test_pairs_are_not_multiplied_by_runs(spark, monkeypatch):
    """A group of near copies that eight runs find whole: a pair is one row of every join, and counts are those of plain code."""
    names = [bytes([i]) for i in range(30)]
    links = [(a, b, bool(i % 2)) for i, a in enumerate(names) for b in names[i + 1:]]
    runs = {(r, n): names[0] for r in range(8) for n in names[:20]}
    runs |= {(0, n): names[20] for n in names[20:25]}  # found by one run
    runs |= {(1, names[0]): names[25], (1, names[25]): names[25]}
    want = defaultdict(lambda: [0, 0])
    for a, b, crowded in links:
        found = sum((r, a) in runs and runs[r, a] == runs.get((r, b)) for r in range(8))
        want[crowded][0] += found > 0
        want[crowded][1] += found == 1
    pairs = spark.createDataFrame(links + links[:7], "a binary, b binary, crowded boolean")
    roots = spark.createDataFrame([(str(r), n, root) for (r, n), root in runs.items()], "run string, node binary, root binary")
    sizes, join = [], type(pairs).join

    def counted(*args, **named):
        out = join(*args, **named)
        sizes.append(out.count())
        return out
    monkeypatch.setattr(type(pairs), "join", counted)
    assert sorted(chosen_path.found_once(pairs, roots)) == sorted(map(tuple, want.values()))
    assert max(sizes) <= len(links)
