"""Repair of conversation structure by dynamic programming over a grammar of row symbols.

A row is a symbol: its role's initial as far as it matters, and what its first fault asks for. The cheapest edits that
give initials ``(s?(ua)+)?`` are a path through four states (nothing yet, after s, after u, after a), so a row is a
min-plus transfer matrix: cost and edits of the cheapest way from state to state, edits that differ at equal cost being
compared as text. Costs add and edits concatenate along a sequence. Two ways of equal cost between the same states
never have edits of which one begins the other (they keep equally many rows, and further insertions cost more), so the
least text stays least whatever comes before or after, and matrices may be multiplied in any grouping.

The distinct symbol sequences of a block of conversations are compressed together by Re-Pair: the most frequent
neighbouring pair becomes a rule until none occurs twice. Every rule has one matrix, the product of its two parts, made
once, bottom-up, and shared by all conversations that use it. Edits are ropes (two parts, a length and a hash), which are
compared from their first difference and spelled out only for a conversation's answer.

Rows meet by conversation twice. First without texts (turn, role's initial, faults, a 128-bit digest of role and text):
the digest's second occurrence is a duplicate, and the repair of each conversation is found. Then with their texts, in
the same order, led by the edits, as a stream: a conversation of any length is never held as a whole, only its symbols
and edits (a byte a row each).

Edge cases: NULL conversation numbers are one conversation. Rows of one turn are in the order of their digests. A role
without characters fits nowhere, so its row is deleted or gets a new role. Conversations without rows have none in
:func:`diagnose`. Extra columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.common import WORD, partitions
from stratafold.session import cut

START, AFTER_S, AFTER_U, AFTER_A = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Next state by the only role that may be given or inserted there.
STEP = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEW_ROLE = ("user", "user", "assistant", "user")
#: Next state by a kept initial; nothing else may be kept.
KEPT = {"s": {START: AFTER_S}, "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
#: Symbols: s u a and x (any other role), in capitals if truncated; d must go.
SYMBOLS = "suaxSUAXd"
PRIME = (1 << 61) - 1
BASE = 1_000_003

Rope = tuple  # (text or (left, right), length, hash, base ** length)
Matrix = list  # [from][to]: (cost, rope) or None


def rope(text: str) -> Rope:
    value, power = 0, 1
    for c in text:
        value, power = (value * BASE + ord(c)) % PRIME, power * BASE % PRIME
    return text, len(text), value, power


EMPTY = rope("")


def joined(a: Rope, b: Rope) -> Rope:
    if not a[1]:
        return b
    if not b[1]:
        return a
    if a[1] + b[1] <= 16 and isinstance(a[0], str) and isinstance(b[0], str):
        return a[0] + b[0], a[1] + b[1], (a[2] * b[3] + b[2]) % PRIME, a[3] * b[3] % PRIME
    return (a, b), a[1] + b[1], (a[2] * b[3] + b[2]) % PRIME, a[3] * b[3] % PRIME


def before(a: Rope, b: Rope) -> bool:
    """Whether a's text is less than b's; equal parts are skipped by length and hash."""
    one, two = [a], [b]
    while one and two:
        x, y = one.pop(), two.pop()
        if x is y or x[1:3] == y[1:3]:
            continue
        if isinstance(x[0], str) and isinstance(y[0], str):
            s, t = x[0], y[0]
            n = min(len(s), len(t))
            if s[:n] != t[:n]:
                return s[:n] < t[:n]
            if len(s) > n:
                one.append(rope(s[n:]))
            if len(t) > n:
                two.append(rope(t[n:]))
        elif isinstance(y[0], str) or (x[1] >= y[1] and not isinstance(x[0], str)):
            one.extend((x[0][1], x[0][0]))
            two.append(y)
        else:
            one.append(x)
            two.extend((y[0][1], y[0][0]))
    return not one and bool(two)


def spelled(a: Rope) -> str:
    out, todo = [], [a]
    while todo:
        x = todo.pop()[0]
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend((x[1], x[0]))
    return "".join(out)


def less(a: tuple | None, b: tuple | None) -> bool:
    if a is None or b is None:
        return a is not None
    return a[0] < b[0] or (a[0] == b[0] and before(a[1], b[1]))


def product(left: Matrix, right: Matrix) -> Matrix:
    out: Matrix = []
    for row in left:
        best: list = [None] * 4
        for middle, first in enumerate(row):
            if first is None:
                continue
            for to, second in enumerate(right[middle]):
                if second is None or (best[to] is not None and first[0] + second[0] > best[to][0]):
                    continue
                way = (first[0] + second[0], joined(first[1], second[1]))
                if less(way, best[to]):
                    best[to] = way
        out.append(best)
    return out


def insertions() -> Matrix:
    """Nothing or some inserted rows; going round again never pays."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for at in range(4):
        out[at][at] = (0, EMPTY)
        to, n = STEP[at], 1
        while out[at][to] is None:
            out[at][to] = (n * INSERT, rope("I" * n))
            to, n = STEP[to], n + 1
    return out


def row_matrix(symbol: str) -> Matrix:
    """Edits of one row after any insertions before it."""
    own: Matrix = [[None] * 4 for _ in range(4)]
    for at in range(4):
        ways = [(DELETE, "D", at)]
        if symbol != "d":
            more = TRUNCATED if symbol.isupper() else 0
            ways.append((REROLE + more, "R", STEP[at]))
            kept = KEPT.get(symbol.lower(), {}).get(at)
            if kept is not None:
                ways.append((KEEP + more, "K", kept))
        for cost, edit, to in ways:
            way = (cost, rope(edit))
            if less(way, own[at][to]):
                own[at][to] = way
    return product(insertions(), own)


def re_pair(sequences: list[bytes], letters: int) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """The sequences over symbols and rules, and the rules: number ``letters + i`` stands for the pair at i.

    All occurrences of a pair are held in sets; neighbours are updated as pairs are replaced.
    """
    flat: list[int] = []
    for s in sequences:
        flat.extend(s)
        flat.append(-1)  # no pair goes past it
    size = len(flat)
    following, preceding = list(range(1, size + 1)), list(range(-1, size - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for i in range(size - 1):
        if flat[i] >= 0 and flat[i + 1] >= 0:
            places.setdefault((flat[i], flat[i + 1]), set()).add(i)
    heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []

    def drop(i: int, j: int) -> None:
        if i >= 0 and j < size and flat[i] >= 0 and flat[j] >= 0:
            places[flat[i], flat[j]].discard(i)

    def put(i: int, j: int) -> None:
        if i >= 0 and j < size and flat[i] >= 0 and flat[j] >= 0:
            pair = (flat[i], flat[j])
            own = places.setdefault(pair, set())
            own.add(i)
            if len(own) > 1:
                touched.add(pair)

    while heap:
        count, pair = heapq.heappop(heap)
        own = places.get(pair, ())
        if len(own) < 2:
            continue
        if len(own) != -count:
            heapq.heappush(heap, (-len(own), pair))
            continue
        made = letters + len(rules)
        touched: set[tuple[int, int]] = set()
        used = 0
        for i in sorted(own):
            j = following[i]
            if j >= size or (flat[i], flat[j]) != pair:  # overlaps one replaced just now
                continue
            p, k = preceding[i], following[j]
            drop(p, i)
            drop(j, k)
            flat[i], flat[j] = made, -2
            following[i] = k
            if k < size:
                preceding[k] = i
            put(p, i)
            put(i, k)
            used += 1
        places.pop(pair, None)
        if used:
            rules.append(pair)
        for other in touched:
            heapq.heappush(heap, (-len(places[other]), other))
    out, at = [], 0
    for s in sequences:
        end, own = at + len(s), []
        while at < end:
            own.append(flat[at])
            at = following[at]
        out.append(own)
        at = end + 1
    return out, rules


def repairs(sequences: list[bytes]) -> list[tuple[int, str]]:
    """Cost and edits of each sequence of symbol numbers."""
    packed, rules = re_pair(sequences, len(SYMBOLS))
    matrices = [row_matrix(s) for s in SYMBOLS]
    for a, b in rules:
        matrices.append(product(matrices[a], matrices[b]))
    close = insertions()
    out = []
    for own in packed:
        level = [matrices[s] for s in own] or [close]
        while len(level) > 1:  # in halves, so that ropes stay shallow
            level = [product(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        ends = product(level[0], close)[START]
        best = ends[START] if not less(ends[AFTER_A], ends[START]) else ends[AFTER_A]
        out.append((best[0], spelled(best[1])))
    return out


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy (0, or 1 for a repeated row): the test damage by ``crc32(conv_id:turn) % 20``.

    NULL roles and texts are one blank, also the numbers in what is hashed.
    """
    def one(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(F.col("_code") == 1, F.lit("")).when(F.col("_code") == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    role = F.when(F.col("_code") == 4, F.lit("user")).otherwise(one("role"))
    copies = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("_code", code).where("_code <> 0")
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _digests() -> tuple[Column, Column]:
    both = F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")
    return F.xxhash64(both).alias("k1"), F.xxhash64(F.lit(11), both).alias("k2")


ORDER = ("turn", "k1", "k2", "copy")


def _in_order(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", *more, *ORDER)]


def diagnose(rows: DataFrame, block_rows: int = 1 << 18) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of ``rows`` (conv_id, turn, role, text, copy)."""
    words = F.regexp_count("text", F.lit(WORD)) > 0
    ending = F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    initial = F.substring("role", 1, 1)
    light = rows.select("conv_id", "turn", "copy", *_digests(), initial.alias("initial"), (~words).alias("blank"), (~ending).alias("open"))
    # Dealt by conversation already, so this window needs no shuffle of its own.
    same = Window.partitionBy("conv_id", "k1", "k2").orderBy(F.col("turn").asc_nulls_first(), "copy")
    light = light.repartition(partitions(rows.sparkSession), "conv_id").withColumn("again", F.row_number().over(same) > 1)
    light = light.sortWithinPartitions(*_in_order())
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    number = {s: i for i, s in enumerate(SYMBOLS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        held = 0
        group: object = run  # no conversation yet
        symbols, tally, turns, last = bytearray(), [0, 0, 0, 0], [None, None, 0], None

        def end() -> None:
            nonlocal held
            if group is run:
                return
            low, high, n = turns
            gaps = 0 if low is None else high - low + 1 - n
            ready.append((group, gaps, *tally, bytes(symbols)))
            held += len(symbols)

        def out() -> pa.RecordBatch:
            distinct = list(dict.fromkeys(r[-1] for r in ready))
            answer = dict(zip(distinct, repairs(distinct)))
            columns = [pa.array([r[0] for r in ready], kind)]
            columns += [pa.array([r[i] for r in ready], pa.int64()) for i in range(1, 6)]
            columns += [pa.array([answer[r[-1]][0] for r in ready], pa.int64()), pa.array([answer[r[-1]][1] for r in ready], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *names, "audit"])

        kind = None
        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, turn, again, initial, blank, is_open in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "again", "initial", "blank", "open"))):
                if conv != group:
                    end()
                    if held >= block_rows:
                        yield out()
                        ready, held = [], 0
                    group, symbols, tally, turns, last = conv, bytearray(), [0, 0, 0, 0], [None, None, 0], None
                if turn is not None:
                    if turns[0] is None:
                        turns[0] = turn
                    if turn != turns[1]:
                        turns[2] += 1
                    turns[1] = turn
                own = initial if initial in ("s", "u", "a") else "x"
                if blank:
                    tally[0] += 1
                    own = "d"
                elif again:
                    tally[1] += 1
                    own = "d"
                elif is_open:
                    tally[2] += 1
                    own = own.upper()
                if last is not None and last + initial not in ("su", "ua", "au"):
                    tally[3] += 1
                last = initial
                symbols.append(number[own])
        end()
        if ready:
            yield out()

    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    return light.drop("k1", "k2", "copy").mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", audit string")


def apply_edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired rows, those of a conversation in order within one partition.

    ``found`` has the edits of every conversation (``audit``). Texts pass as a stream behind the edits of their conversation.
    """
    k1, k2 = _digests()
    both = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", k1, k2, F.col("copy"), "role", "text").unionByName(
        found.select("conv_id", "audit"), allowMissingColumns=True)
    both = both.withColumn("_part", F.col("audit").isNull())  # edits first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, audit, at, state, place = None, "", 0, START, 0
        done: list[tuple] = []

        def insert() -> None:
            """Insertions up to the next row."""
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                done.append((group, place, "I", NEW_ROLE[state], ""))
                at, state, place = at + 1, STEP[state], place + 1

        def out(kind: pa.DataType) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in done], kind), pa.array([r[1] for r in done], pa.int64()), *(pa.array([r[i] for r in done], pa.string()) for i in (2, 3, 4))],
                names=["conv_id", "place", "edit", "role", "text"])
            done.clear()
            return batch

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, edits, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist(), batch.column("role"), batch.column("text")):
                if edits is not None:
                    insert()
                    group, audit, at, state, place = conv, edits, 0, START, 0
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                own = role.as_py()
                if edit == "R":
                    own, state = NEW_ROLE[state], STEP[state]
                else:
                    state = KEPT[own[:1]][state]
                done.append((group, place, edit, own, text.as_py()))
                place += 1
            yield out(kind)
        insert()
        if done:
            yield out(kind)

    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    both = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*_in_order("_part"))
    return both.select("conv_id", "audit", "role", "text").mapInArrow(
        run, f"conv_id {kind}, place bigint, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` rows joined by line feeds, for rows as :func:`apply_edits` leaves them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        group, state = run, None
        done: list[tuple] = []
        kind = None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], kind), pa.array([r[1] for r in done], pa.string())], names=["conv_id", "repaired_sha256"])
            done.clear()
            return batch

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                row = f"{role}:{text}".encode("utf-8")
                if conv != group:
                    if group is not run:
                        done.append((group, state.hexdigest()))
                    group, state = conv, hashlib.sha256(row)
                else:
                    state.update(b"\n" + row)
            if done:
                yield out()
        if group is not run:
            done.append((group, state.hexdigest()))
            yield out()

    kind = repaired.select("conv_id").schema[0].dataType.simpleString()
    return repaired.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per conversation: :func:`diagnose`, repaired rows: :func:`apply_edits`) of rows with conv_id, turn, role, text and copy."""
    found = cut(diagnose(rows))
    return found, apply_edits(rows, found)


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, bit by bit."""
    return (f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::BIGINT)), "
            "lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")


def _sql() -> str:
    def after(way: str, cost: str, edits: str, row: str = "''") -> str:
        return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{edits}', 't': {way}.t || {row}}}"

    insert_user, insert_assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    least = "list_min([{}])".format
    closed = "[{}]".format(", ".join((
        "w[1]", "w[2]",
        least(", ".join(["w[3]", *(after(f"w[{p}]", "2", "I", insert_user) for p in (1, 2, 4))])),
        least(", ".join(["w[4]", after("w[3]", "2", "I", insert_assistant), *(after(f"w[{p}]", "4", "II", f"{insert_user} || {insert_assistant}") for p in (1, 2))])))))
    # Per state: the row deleted, kept where its initial fits, or given the role that fits.
    fits = {2: [(1, "s")], 3: [(1, "u"), (2, "u"), (4, "u")], 4: [(3, "a")]}
    roles = {3: ("user", (1, 2, 4)), 4: ("assistant", (3,))}
    states = []
    for to in (1, 2, 3, 4):
        ways = [after(f"w[{to}]", "3", "D")]
        for at, initial in fits.get(to, []):
            ways.append(after(f"w[{at}]", f"CASE WHEN fault IN (1, 2) OR initial <> '{initial}' THEN 1000000000 WHEN fault = 3 THEN 1 ELSE 0 END", "K",
                              "chr(10) || role || ':' || text"))
        name, sources = roles.get(to, ("", ()))
        for at in sources:
            ways.append(after(f"w[{at}]", "CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 3 ELSE 2 END", "R", f"chr(10) || '{name}:' || text"))
        states.append(least(", ".join(ways)))
    code = crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")
    return f"""
WITH RECURSIVE source AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {code} % 20 AS code FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM source WHERE code <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM damaged),
judged AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS previous,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM placed),
steps AS (
    SELECT conv_id, 0::BIGINT AS place, [{{'c': 0::BIGINT, 'a': '', 't': ''}}, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}},
        {{'c': 1000000000::BIGINT, 'a': '', 't': ''}}, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}}] AS ways FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT s.conv_id, j.place, list_transform([list_transform([s.ways], lambda w: {closed})[1]], lambda w: [{', '.join(states)}])[1]
    FROM steps s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.place = s.place + 1),
last AS (SELECT conv_id, arg_max(ways, place) AS ways FROM steps GROUP BY conv_id),
best AS (SELECT conv_id, list_min([done[1], done[4]]) AS b FROM (SELECT conv_id, list_transform([ways], lambda w: {closed})[1] AS done FROM last)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT b.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
    coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, b.b.c::BIGINT AS cost, b.b.a AS audit,
    sha256(substr(b.b.t, 2)) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""


SQL = _sql()
