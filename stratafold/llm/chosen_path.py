"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; equal sets are one node from the start. A set is embedded as
``tokens`` minhash values. In every run all sets start in one bucket; a bucket splits on sampled tokens: a hash of the
path and the token lets each token through with probability 1 / (threshold x tokens), so two sets at the threshold share
one child on average and less similar ones fewer. Buckets of up to ``small`` sets are compared in full by their
embeddings. In a larger one all sets are compared with ``small`` pivots. A set rests with the component of pivots it is like
if every set outside that component is so much farther from it that, by the triangle inequality, none can be like the
resting one (the share of differing tokens is a metric); all others go on to the bucket's children. So every two sets of
a bucket that are alike are linked or go on together, and a large group of near copies settles at once whatever else is in
its bucket. A bucket of up to ``SALT_ROWS`` rows fits into a task, which follows its children down by the same hashes; only
rows of larger buckets are shuffled again, with the same pivots and by the same rules. What has not settled at the last level is handed on as a whole. Runs are repeated, ``runs_at_once`` of them in one round
of jobs and two rounds at least. A pair is found by a run that brings both sets into one component; of the pairs whose
embeddings agree at the threshold, those that one run alone found tell how many none found
(the jackknife). Runs go on until that leaves ``recall`` of the pairs of large buckets and their children, and of the others.

These links only say which sets to compare (the embedding is read with slack). In each connected neighbourhood every two
sets are then compared exactly, block against block, by their common shingles; a pair of blocks returns a count for each
set and a spanning set of links, never the pairs. Classes are the components of those links.

Edge cases: fewer than five words make one shingle of all of them; documents without words (NULL texts too) have equal
empty sets and so one class, without links. Repeated rows are copies. Links count other sets, ``n_copies`` other rows of an
equal set. Sets and shingles are known by 128- and 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import broadcast_if_small, partitions, text_bytes
from stratafold.llm.components import components
from stratafold.llm.repeats import distinct_texts, gram_hashes, scrambled, text_keys
from stratafold.llm.substring_dedup import word_numbers
from stratafold.session import cut

SALT_ROWS = 32_768
BLOCK = 2048  # sets of a block of the exact comparison, fewer if their shingles hold more than BLOCK_BYTES
BLOCK_BYTES = 8 << 20
ALL_RUNS = "joined"  # as long as the name of a run


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    words = word_numbers(text)
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(size, len(words))) ^ np.uint64(min(size, len(words))))


def embedding(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """32 bits of the minhash under each factor; zeros for an empty set."""
    if not len(values):
        return np.zeros(len(factors), np.uint32)
    least = np.full(len(factors), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for begin in range(0, len(values), 2048):
            part = values[begin:begin + 2048, None] * factors
            least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(0))
    return (scrambled(least) >> np.uint64(32)).astype(np.uint32)


def factors_of(tokens: int, seed: int) -> np.ndarray:
    return scrambled(np.arange(1, tokens + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def embedded(docs: DataFrame, doc_id: str, text: str, tokens: int, size: int, seed: int) -> DataFrame:
    """doc_id, k1, k2 (of the text), key (of its shingle set), sketch (NULL for an empty set)."""
    factors = factors_of(tokens, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple[int, int], tuple[bytes, bytes | None]] = {}
            rows = []
            for key, raw in zip(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()), batch.column("raw")):
                if key not in known:
                    own = shingles(raw.as_py(), size)
                    known[key] = (xxhash.xxh3_128_digest(own.tobytes()), embedding(own, factors).tobytes() if len(own) else None)
                rows.append(known[key])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["doc_id", "k1", "k2", "key", "sketch"])

    k1, k2 = text_keys(text)
    source = docs.select(F.col(doc_id).alias("doc_id"), k1, k2, text_bytes(text).alias("raw"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, key binary, sketch binary")


def children(sketches: np.ndarray, paths: np.ndarray, level: int, chance: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and child path of every token that the path of its row lets through."""
    places = np.arange(sketches.shape[1], dtype=np.uint64) << np.uint64(32)
    rows, paths_below = [], []
    with np.errstate(over="ignore"):
        for begin in range(0, len(sketches), 4096):
            part = slice(begin, begin + 4096)
            child = scrambled(scrambled(paths[part] + np.uint64(level * 1009 + seed))[:, None] ^ scrambled(sketches[part].astype(np.uint64) + places + np.uint64(1)))
            row, column = np.nonzero(scrambled(child) < np.uint64(int(chance * 2**64)))
            rows.append(row + begin)
            paths_below.append(child[row, column])
    return np.concatenate(rows), np.concatenate(paths_below)


def split(buckets: DataFrame, level: int, tokens: int, chance: float, seed: int) -> DataFrame:
    """(run, path, key) of the children of every row (run, path, key, sketch): one for each token its path lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, tokens)
            row, child = children(sketches, paths, level, chance, seed)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("run").take(rows), pa.array(child.view(np.int64)), batch.column("key").take(rows)], names=["run", "path", "key"])

    return buckets.select("run", "path", "key", "sketch").mapInArrow(run, "run int, path bigint, key binary")


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the components of a[i] and b[i]; ``label`` holds the least member of each row's component."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return
        to = np.arange(len(label))
        np.minimum.at(to, high, low)
        while (to != to[to]).any():
            to = to[to]
        label[:] = to[label]


def agreement(sketches: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Share of equal tokens of every two rows."""
    return np.stack([(sketches == s).mean(1) for s in others], axis=1)


def _labels(like: np.ndarray) -> np.ndarray:
    """The least member of each row's component under a symmetric relation."""
    label = np.arange(len(like))
    while True:
        new = np.where(like, label[None], len(like)).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _labels_of_sides(like: np.ndarray) -> np.ndarray:
    """The least member of each component of rows, then columns, under a relation between the two."""
    n, size = len(like), sum(like.shape)
    label = np.arange(size)
    while True:
        new = np.append(np.where(like, label[None, n:], size).min(1), np.where(like, label[:n, None], size).min(0))
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def pivot_order(path: int, keys: list[bytes]) -> np.ndarray:
    """Spark's ``xxhash64(path, key)`` of each key: buckets choose the same pivots inside a task as in a shuffle."""
    begin = xxhash.xxh64_intdigest((path % 2**64).to_bytes(8, "little"), 42)
    return np.array([xxhash.xxh64_intdigest(k, begin) for k in keys], np.uint64).view(np.int64)


def descend(
    sketches: np.ndarray, rows: np.ndarray, path: int, level: int, levels: int, least: float, small: int, chance: float, seed: int,
    keys: list[bytes] | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """The buckets below ``path`` for ``rows`` of a table of sketches, by the rules of ``compare_buckets``.

    ``keys`` (the places of the rows if not given) ascend. Of each bucket: its rows, the first of its two sides of compared rows, their agreement, and, for each of its rows, the row it is
    linked with (itself if with none). The last value tells whether the bucket is a large one.
    """
    keys = keys or [i.to_bytes(8, "big") for i in range(len(sketches))]
    below = [(rows, np.uint64(path), level)]
    while below:
        rows, path, level = below.pop()
        row, child = children(sketches[rows], np.full(len(rows), path), level, chance, seed)
        order = np.argsort(child, kind="stable")
        row, child = row[order], child[order]
        ends = np.append(np.flatnonzero(np.diff(child)) + 1, len(child))
        begins = np.append(0, ends[:-1])
        for begin, end in zip(begins[ends - begins > 1].tolist(), ends[ends - begins > 1].tolist()):
            own = np.unique(rows[row[begin:end]])
            if len(own) <= small:
                alike = agreement(sketches[own], sketches[own])
                yield own, own, alike, own[_labels(alike >= least)], False
                continue
            pivots = own[np.argsort(pivot_order(int(child[begin]), [keys[i] for i in own.tolist()]), kind="stable")[:small]]
            alike = agreement(sketches[own], sketches[pivots])
            label = _labels(alike[np.searchsorted(own, pivots)] >= least)
            order_by_part = np.argsort(label, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(label[order_by_part]) != 0))
            by_part = np.maximum.reduceat(alike[:, order_by_part], first, axis=1)
            inside, heads = by_part >= least, pivots[label[order_by_part[first]]]
            best = by_part.argmax(1)
            near = by_part[np.arange(len(own)), best]
            to = np.where(near >= least, heads[best], pivots[0] if level == levels else own)
            yield own, pivots[:8], alike[:, :8], to, True
            for part in range(len(heads)):  # rows like two components join them
                both = own[inside[:, part] & (best != part)]
                if len(both):
                    yield both, both[:0], np.zeros((len(both), 0)), np.full(len(both), heads[part]), True
            if level == levels:
                if len(heads) > 1:
                    yield heads, heads[:0], np.zeros((len(heads), 0)), np.full(len(heads), pivots[0]), True
                continue
            most = np.where(inside, -1.0, by_part).max(0)
            on = own[(near < least) | (near - most[best] <= 1 - least + 1e-9)]
            if len(on) > 1:
                below.append((on, child[begin], level + 1))


def compare_buckets(buckets: DataFrame, tokens: int, least: float, small: int, last: bool, sure: float = 2, stride: int = 1,
                    sets: DataFrame | None = None, deeper: tuple[int, int, float, int] | None = None) -> DataFrame:
    """Links (kind 0: run, a, b) within buckets, and the rows (kind 1: run, path, a, sketch) of large ones that do not rest.

    Buckets of more than ``SALT_ROWS`` rows are dealt by salt, and what rests of them is decided by a join afterwards.
    A row x rests with a component C whose nearest pivot p it agrees with in ``near`` tokens if all rows outside C agree with C's
    pivots in at most ``near - (1 - least)``: for such a y, d(x, y) >= d(y, p) - d(x, p) > 1 - least. At the last level all rows are linked.
    Kind 2 (run, a, b, path 1 in a large bucket, else 0) are compared pairs that agree in ``sure`` or more, one in ``stride`` by hash.
    ``sets`` (key, sketch) gives the sketches if the buckets have none. With ``deeper`` (level below, levels, chance, seed) the rows of
    large buckets that are seen whole go on inside their task.
    """
    spark = buckets.sparkSession
    parts = partitions(spark)
    sizes = buckets.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
    live = buckets.join(sizes, "path")
    order = Window.partitionBy("path").orderBy(F.xxhash64("path", "key"), "key")
    pivots = live.where(F.col("n") > small).withColumn("place", F.row_number().over(order)).where(F.col("place") <= small).drop("place")
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    rows = live.withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int")).withColumn("member", F.lit(True)).unionByName(
        pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("member", F.lit(False)))

    if sets is not None:  # only rows that share a bucket fetch their sketch
        rows = rows.join(sets.select("key", "sketch"), "key")

    schema = pa.schema([("kind", pa.int32()), ("run", pa.int32()), ("path", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("sketch", pa.binary()),
                        ("part", pa.int32()), ("near", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sketches, pivot_keys, pivot, label = None, [], [], [], None, None
        order, first, closest = None, None, None  # pivots by component, where each begins, the most that rows outside agree with it
        links: list[tuple[int, bytes, bytes]] = []
        held: list[tuple[int, int, bytes, bytes, int, float]] = []  # rows of the group at hand
        rest: list[tuple[int, int, bytes, bytes, int, float]] = []
        outside: list[tuple[int, int, int, float]] = []
        pairs: list[tuple[int, int, bytes, bytes]] = []

        def table(of: list[bytes]) -> np.ndarray:
            return np.frombuffer(b"".join(of), np.uint32).reshape(-1, tokens)

        def close(alike: np.ndarray, others: list[bytes], large: int) -> None:
            a, b = (np.array([int.from_bytes(k[:4], "big") for k in x], np.int64) for x in (keys, others))
            for i, j in np.argwhere((alike >= sure) & ((a[:, None] ^ b) % stride == 0)).tolist():
                if keys[i] != others[j] and (large or i < j):
                    pairs.append((group[0], large, *sorted((keys[i], others[j]))))

        def flush() -> None:
            nonlocal pivot, label, order, first, closest
            if not keys:
                return
            own = table(sketches)
            if not pivot_keys:
                alike = np.stack([(own == s).mean(1) for s in own])
                close(alike, keys, 0)
                found = _labels(alike >= least)
                links.extend((group[0], keys[i], keys[j]) for i, j in enumerate(found.tolist()) if i != j)
            else:
                if pivot is None:
                    pivot = table([s for _, s in pivot_keys])
                    label = _labels(np.stack([(pivot == s).mean(1) >= least for s in pivot]))
                    links.extend((group[0], pivot_keys[i][0], pivot_keys[j][0]) for i, j in enumerate([0] * len(label) if last else label.tolist()) if i != j)
                    order = np.argsort(label, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
                    closest = np.full(len(first), -1.0)
                alike = np.stack([(own == s).mean(1) for s in pivot], axis=1)
                close(alike[:, :8], [k for k, _ in pivot_keys[:8]], 1)
                by_part = np.maximum.reduceat(alike[:, order], first, axis=1)
                inside, heads = by_part >= least, label[order[first]].tolist()
                closest = np.maximum(closest, np.where(inside, -1.0, by_part).max(0))
                best = by_part.argmax(1)
                for i, part in enumerate(best.tolist()):
                    to = [heads[j] for j in np.flatnonzero(inside[i]).tolist()]
                    links.extend((group[0], keys[i], pivot_keys[j][0]) for j in to if keys[i] != pivot_keys[j][0])
                    if not to and last:  # the exact comparison takes the bucket as a whole
                        links.append((group[0], keys[i], pivot_keys[0][0]))
                    elif not last:
                        held.append((*group[:2], keys[i], sketches[i], heads[part] if to else -1, float(by_part[i, part])))
            keys.clear()
            sketches.clear()

        def go_on(on: list) -> None:
            """Links and pairs of all buckets below the group at hand, each row linked once."""
            on.sort(key=lambda r: r[2])
            below = [r[2] for r in on]
            at = np.array([int.from_bytes(k[:4], "big") for k in below], np.int64)
            label, seen, edges = np.arange(len(on)), [], []
            level, levels, chance, seed = deeper
            for own, others, alike, to, large in descend(table([r[3] for r in on]), np.arange(len(on)), group[1] % 2**64, level, levels, least, small, chance, seed, below):
                hits = np.argwhere((alike >= sure) & ((at[own][:, None] ^ at[others]) % stride == 0))
                i, j = own[hits[:, 0]], others[hits[:, 1]]
                seen.append((np.minimum(i, j) * len(on) + np.maximum(i, j))[i != j])
                edges.append((own[own != to], to[own != to]))
            if edges:
                join_labels(label, *(np.concatenate(side) for side in zip(*edges)))
            links.extend((group[0], below[i], below[j]) for i, j in enumerate(label.tolist()) if i != j)
            met = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            pairs.extend((group[0], 1, below[i], below[j]) for i, j in zip((met // len(on)).tolist(), (met % len(on)).tolist()))

        def settle() -> None:
            """The end of a group: what its rows say about components, if it has any."""
            flush()
            if closest is not None and not last:
                most = dict(zip(label[order[first]].tolist(), closest.tolist()))
                if group[3] == 1:  # the whole bucket was seen
                    on = [(*r[:4], -1, 0.0) for r in held if r[4] < 0 or r[5] - most[r[4]] <= 1 - least + 1e-9]
                    if deeper is None:
                        rest.extend(on)
                    elif len(on) > 1:
                        go_on(on)
                else:
                    rest.extend(held)
                    outside.extend((*group[:2], part, x) for part, x in most.items())
            held.clear()

        def out() -> pa.RecordBatch:
            rows = [(0, r, None, a, b, None, None, None) for r, a, b in links]
            rows += [(1, r, path, a, None, sketch, part, near) for r, path, a, sketch, part, near in rest]
            rows += [(3, r, path, None, None, None, part, most) for r, path, part, most in outside]
            rows += [(2, r, large, a, b, None, None, None) for r, large, a, b in pairs]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
            links.clear()
            rest.clear()
            outside.clear()
            pairs.clear()
            return batch

        for batch in batches:
            for number, path, salt, salts, member, key, sketch in zip(*(batch.column(c).to_pylist() for c in ("run", "path", "salt", "salts", "member", "key", "sketch"))):
                if (number, path, salt, salts) != group:
                    settle()
                    group, pivot, label, closest = (number, path, salt, salts), None, None, None
                    pivot_keys.clear()
                if not member:
                    pivot_keys.append((key, sketch))
                    continue
                keys.append(key)
                sketches.append(sketch)
                if pivot_keys and len(keys) == 1024:
                    flush()
            yield out()
        settle()
        yield out()

    dealt = rows.select("run", "path", "salt", salts.alias("salts"), "member", "key", "sketch").repartition(parts, "path", "salt").sortWithinPartitions("path", "salt", "run", "member", F.xxhash64("path", "key"), "key")
    found = cut(dealt.mapInArrow(run, "kind int, run int, path bigint, a binary, b binary, sketch binary, part int, near double"))
    columns = ["kind", "run", "path", "a", "b", "sketch"]
    # One row a component of a large bucket; salts of a bucket see the same components.
    outside = found.where("kind = 3").groupBy(F.col("path").alias("_path"), F.col("part").alias("_part")).agg(F.max("near").alias("_most"))
    rests = (F.col("path") == F.col("_path")) & (F.col("part") == F.col("_part")) & (F.col("near") - F.col("_most") > 1 - least + 1e-9)
    on = found.where("kind = 1").join(broadcast_if_small(outside), rests, "left_anti")
    return found.where("kind IN (0, 2)").select(columns).unionByName(on.select(columns))


def neighbourhoods(
    sets: DataFrame, threshold: float, tokens: int, slack: float, small: int, runs_at_once: int, recall: float, most_rounds: int, levels: int, seed: int,
) -> DataFrame:
    """node, root: sets (key, sketch) that chosen paths link, by connected component."""
    chance = 1 / (threshold * tokens)
    every = fresh = pairs = roots = None
    for number in range(most_rounds):
        runs = range(number * runs_at_once, (number + 1) * runs_at_once)
        first = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(seed), F.lit(r)).alias("path")) for r in runs]))
        buckets = sets.select(first.alias("f"), "key", "sketch").select("f.run", "f.path", "key", "sketch")
        links = None
        for level in range(1, levels + 1):
            deeper = (level + 1, levels, chance, seed) if level < levels else None
            found = compare_buckets(split(buckets, level, tokens, chance, seed), tokens, threshold - slack, small, level == levels, threshold, 1, sets, deeper)
            own = found.where("kind = 0 AND a <> b").select("run", "a", "b")
            links = own if links is None else links.unionByName(own)
            close = found.where("kind = 2").select("a", "b", (F.lit(level > 1) | (F.col("path") == 1)).alias("crowded"))
            pairs = close if pairs is None else pairs.unionByName(close)
            buckets = found.where("kind = 1").select("run", "path", F.col("a").alias("key"), "sketch")
            if level < levels and buckets.isEmpty():
                break
        every = links if every is None else every.unionByName(links)
        fresh = links if fresh is None else fresh.unionByName(links)
        if not number:
            continue
        # Components of each run not labelled before and, under a name of their own, of all runs together: one job for both.
        name = F.encode(F.lpad(F.col("run").cast("string"), 6, "0"), "utf-8")
        named = fresh.select(name.alias("of"), "a", "b").unionByName(every.select(F.encode(F.lit(ALL_RUNS), "utf-8").alias("of"), "a", "b"))
        own = components(named.select(F.concat("of", "a").alias("a"), F.concat("of", "b").alias("b")))
        own = own.select(F.decode(F.expr("substring(node, 1, 6)"), "utf-8").alias("run"), F.expr("substring(node, 7)").alias("node"), F.expr("substring(root, 7)").alias("root"))
        of_runs = own.where(F.col("run") != ALL_RUNS)
        roots = of_runs if roots is None else roots.unionByName(of_runs)
        fresh = None
        if enough(found_once(pairs, roots), len(runs) * (number + 1), recall):
            return own.where(F.col("run") == ALL_RUNS).select("node", "root")
    raise RuntimeError(f"{most_rounds} rounds of {runs_at_once} runs leave more than {1 - recall:.3%} of the pairs of a kind unseen; allow more rounds")


def found_once(pairs: DataFrame, roots: DataFrame) -> list[tuple[int, int]]:
    """Pairs, and those that only one run has in one component, for each value of ``crowded``. ``roots``: run, node, root.

    A set carries its roots of all runs (as 64-bit hashes) in one row, so a pair stays one row however many runs found it.
    """
    pairs = pairs.groupBy("a", "b").agg(F.max("crowded").alias("crowded"))
    known = roots.groupBy("node").agg(F.collect_list(F.xxhash64("run", "root")).alias("roots"))
    left = known.select(F.col("node").alias("a"), F.col("roots").alias("of_a"))
    right = known.select(F.col("node").alias("b"), F.col("roots").alias("of_b"))
    seen = pairs.join(left, "a").join(right, "b").select("crowded", F.size(F.array_intersect("of_a", "of_b")).alias("runs")).where("runs > 0")
    return [(r[1], r[2]) for r in seen.groupBy("crowded").agg(F.count("*"), F.count(F.when(F.col("runs") == 1, 1))).collect()]


def enough(found: list[tuple[int, int]], runs: int, recall: float) -> bool:
    """Whether the pairs that no run found, by the jackknife, leave ``recall`` of each kind of pairs."""
    return all(once * (runs - 1) / runs <= (1 - recall) * (total + once * (runs - 1) / runs) for total, once in found)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted distinct arrays, by a product of incidence matrices."""
    both = np.concatenate([*left, *right])
    values, counts = np.unique(both, return_counts=True)
    values = values[counts > 1]  # what one set alone has meets nothing
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(values):
        return out
    where = []
    for sets in (left, right):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        hit = values[at] == flat
        where.append((owner[hit], at[hit]))
    for begin in range(0, len(values), 4096):
        pieces = []
        for (owner, at), sets in zip(where, (left, right)):
            matrix = np.zeros((len(sets), min(4096, len(values) - begin)), np.float32)
            inside = (at >= begin) & (at < begin + 4096)
            matrix[owner[inside], at[inside] - begin] = 1
            pieces.append(matrix)
        out += pieces[0] @ pieces[1].T
    return out


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """kind 0: link a-b of a spanning set; kind 1: n links of a. ``members``: root, key, values (shingles as bytes)."""
    parts = 2 * partitions(members.sparkSession)
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("values")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    dealt = placed.select("root", "key", "values", "own", F.explode(meet).alias("m")).select("root", "m.x", "m.y", "own", "key", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides = None, ([], [])

        def settle() -> pa.RecordBatch | None:
            if group is None or len(sides[0]) + len(sides[1]) < 2:
                return None
            same = group[1] == group[2]
            left, right = sides[0], sides[0] if same else sides[1]
            if not left or not right:
                return None
            a, b = ([v for _, v in x] for x in (left, right))
            common = common_counts(a, b)
            total = np.array([len(v) for v in a])[:, None] + np.array([len(v) for v in b]) - common
            linked = common >= threshold * total - 1e-6
            if same:
                np.fill_diagonal(linked, False)
            keys = [k for k, _ in left] + ([] if same else [k for k, _ in right])
            counts = linked.sum(1).tolist() + ([] if same else linked.sum(0).tolist())
            label = (_labels(linked) if same else _labels_of_sides(linked)).tolist()
            pairs = [(keys[i], keys[j]) for i, j in enumerate(label) if i != j]
            counted = [(k, n) for k, n in zip(keys, counts) if n]
            return pa.RecordBatch.from_arrays(
                [pa.array([0] * len(pairs) + [1] * len(counted), pa.int32()), pa.array([p[0] for p in pairs] + [k for k, _ in counted], pa.binary()),
                 pa.array([p[1] for p in pairs] + [None] * len(counted), pa.binary()), pa.array([None] * len(pairs) + [n for _, n in counted], pa.int64())],
                names=["kind", "a", "b", "n"])

        for batch in batches:
            for root, x, y, own, key, values in zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y", "own", "key", "values"))):
                if (root, x, y) != group:
                    done = settle()
                    if done is not None:
                        yield done
                    group, sides = (root, x, y), ([], [])
                sides[own != x].append((key, np.frombuffer(values, np.uint64)))
        done = settle()
        if done is not None:
            yield done

    dealt = dealt.repartition(parts, "root", "x", "y").sortWithinPartitions("root", "x", "y")
    return dealt.mapInArrow(run, "kind int, a binary, b binary, n bigint")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, tokens: int = 128, slack: float = 0.15, small: int = 64, runs_at_once: int = 4,
    recall: float = 0.995, most_rounds: int = 9, levels: int = 6, seed: int = 41, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, class_id (least id of its class, NULL if all are), class_key, n_links (other sets at ``threshold`` or more), n_copies, k1, k2, for every row."""
    listed = cut(embedded(docs, doc_id, text, tokens, size, seed))
    sets = listed.groupBy("key").agg(F.first("sketch").alias("sketch"), F.min(F.struct("k1", "k2")).alias("e"), F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    sets = cut(sets)
    near = neighbourhoods(sets.where("sketch IS NOT NULL").select("key", "sketch"), threshold, tokens, slack, small, runs_at_once, recall, most_rounds, levels, seed)
    wanted = near.join(sets.select(F.col("key").alias("node"), "e"), "node").select("e.k1", "e.k2", "root", F.col("node").alias("key"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(raw.as_py(), size).tobytes() for raw in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("key"), pa.array(values, pa.binary())], names=["root", "key", "values"])

    texts = distinct_texts(docs, text).join(wanted, ["k1", "k2"]).select("root", "key", "raw")
    found = cut(exact_links(cut(texts.mapInArrow(spell, "root binary, key binary, values binary")), threshold))
    classes = components(found.where("kind = 0").select("a", "b"))
    counts = found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n_links"))
    labelled = sets.join(classes.select(F.col("node").alias("key"), "root"), "key", "left").join(counts.withColumnRenamed("a", "key"), "key", "left")
    labelled = labelled.withColumn("root", F.coalesce("root", "key"))
    names = labelled.groupBy("root").agg(F.min("least").alias("class_id"))
    labelled = labelled.join(names, "root").select("key", F.col("root").alias("class_key"), "class_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), (F.col("rows") - 1).alias("n_copies"))
    return listed.select("doc_id", "k1", "k2", "key").join(labelled, "key").select("doc_id", "class_id", "class_key", "n_links", "n_copies", "k1", "k2")
