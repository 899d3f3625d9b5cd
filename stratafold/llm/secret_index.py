"""Secret scan through a trigram index.

Every rule's regular expression is turned into a Boolean query over lower-cased byte trigrams that any match must
contain. Texts are indexed in shards of a few megabytes inside their own task (a document-partitioned index: no posting
list of the whole corpus exists, however common a trigram is, and no text is shuffled); only trigrams that a query
mentions are posted. A shard intersects and unites postings, and the rule's expression runs over the candidates alone.
Rules without mandatory trigrams run over every text.

Edge cases: NULL and empty texts have no spans. Rows are judged one by one, so repeated rows get equal results. Matches
of one rule never overlap; spans of different rules may. Offsets count code points, the end is exclusive. Input columns
named like a result column are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import blocks, encoded

SHARD_BYTES = 4 << 20
MOST_STRINGS = 64  # literal strings followed at once while reading an expression
MOST_CHARS = 8  # a character class with more members ends a literal


@dataclass(frozen=True)
class Query:
    """``all``: every text qualifies; ``gram``; ``and`` / ``or`` over parts."""

    kind: str
    gram: bytes = b""
    parts: tuple["Query", ...] = ()

    def grams(self) -> set[bytes]:
        return {self.gram} if self.kind == "gram" else set().union(*(p.grams() for p in self.parts))

    def __str__(self) -> str:
        if self.kind in ("all", "gram"):
            return "*" if self.kind == "all" else self.gram.decode("latin-1")
        return "(" + (" & " if self.kind == "and" else " | ").join(map(str, self.parts)) + ")"


EVERY = Query("all")


def both(parts: Iterable[Query]) -> Query:
    own = tuple(dict.fromkeys(p for p in parts if p.kind != "all"))
    return EVERY if not own else own[0] if len(own) == 1 else Query("and", parts=own)


def either(parts: Iterable[Query]) -> Query:
    own = tuple(dict.fromkeys(parts))
    return EVERY if not own or EVERY in own else own[0] if len(own) == 1 else Query("or", parts=own)


def literal(strings: Iterable[bytes]) -> Query:
    """What a text must contain to hold one of ``strings``."""
    return either(both(Query("gram", s[i:i + 3]) for i in range(len(s) - 2)) for s in strings)


def _characters(items) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, value in items:
        if op is syntax.LITERAL:
            out.add(bytes([value]).lower())
        elif op is syntax.RANGE and value[1] - value[0] < MOST_CHARS:
            out |= {bytes([c]).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(out) > MOST_CHARS:
            return None
    return out


def _read(node) -> tuple[set[bytes] | None, Query]:
    """All strings of an expression if they are few, else None; with what any match must contain."""
    op, value = node
    if op is syntax.LITERAL:
        return {bytes([value]).lower()}, EVERY
    if op is syntax.IN:
        return _characters(value), EVERY
    if op is syntax.SUBPATTERN:
        return _sequence(value[-1])
    if op is syntax.AT or op in (syntax.ASSERT, syntax.ASSERT_NOT):
        return {b""}, EVERY
    if op is syntax.BRANCH:
        found = [_sequence(branch) for branch in value[1]]
        if all(s is not None for s, _ in found):
            strings = set().union(*(s for s, _ in found))
            if len(strings) <= MOST_STRINGS:
                return strings, EVERY
        return None, either(q if s is None else literal(s) for s, q in found)
    if op in (syntax.MAX_REPEAT, syntax.MIN_REPEAT, syntax.POSSESSIVE_REPEAT):
        least, most, body = value
        strings, query = _sequence(body)
        if strings is not None and (least, most) == (0, 1):
            return strings | {b""}, EVERY
        if strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
            return {b"".join(x) for x in product(strings, repeat=least)}, EVERY
        return None, EVERY if not least else query if strings is None else literal(strings)
    return None, EVERY


def _sequence(nodes) -> tuple[set[bytes] | None, Query]:
    held, needed, whole = {b""}, [], True
    for node in nodes:
        strings, query = _read(node)
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a in held for b in strings}
            continue
        whole = False
        needed += [literal(held), query]
        held = strings if strings is not None else {b""}
    return (held, EVERY) if whole else (None, both([*needed, literal(held)]))


def trigram_query(pattern: bytes) -> Query:
    """The Boolean query over lower-cased trigrams that every match of ``pattern`` satisfies."""
    strings, query = _sequence(syntax.parse(pattern))
    return query if strings is None else literal(strings)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (over bytes) whose ``group`` has at least ``least`` bytes (all of them ASCII)."""

    name: str
    pattern: bytes
    group: int = 0
    least: int = 1

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)

    def spans(self, text: bytes) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if len(m[self.group]) >= self.least]


#: A run of 16 or more is found directly: shorter runs never match, and a longer one is always taken whole.
BASE_RULES = (
    Rule("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", rb"[0-9a-f]{16,}"),
)
#: Up to the END line of the same label if it comes before the next BEGIN, else over header lines and the base64 lines that
#: follow (line breaks may be written as escapes), a short one only as the last. Possessive, so time grows with the length.
PRIVATE_KEY = (
    rb"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----"
    rb"(?:[^-]*+(?:-(?!----(?:BEGIN |END \1-----))[^-]*+)*+-----END \1-----"
    rb"|(?:(?:\s*+[A-Za-z][A-Za-z-]*+:\x20[^\n]*+\n)*+"
    rb"(?:(?:[\s\"'>#|,]|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)++"
    rb"(?:(?:[\s\"'>#|,]|\\[nr])++(?:(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?+(?=[\x20\t\r\"',]*+(?:\n|\\[nr]|\Z))|[A-Za-z0-9+/]++\Z))?+)?+)"
)
FURTHER_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("code_host", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", rb"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", rb"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login_url", rb"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]++:[^\s:/@]{3,}+@[A-Za-z0-9.-]{1,255}"),
)
RULES = BASE_RULES + FURTHER_RULES


class Shard:
    """Postings of the wanted trigrams over a few texts."""

    def __init__(self, texts: Sequence[bytes], wanted: np.ndarray):
        self.rows = np.arange(len(texts))
        joined = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8)
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])[:-1]
        if len(joined) < 3:
            self.postings: dict[int, np.ndarray] = {}
            return
        codes = joined[:-2].astype(np.uint32)
        for shift in (1, 2):
            codes <<= 8
            codes |= joined[shift:len(joined) - 2 + shift]
        at = np.flatnonzero(np.isin(codes, wanted, kind="table") if len(wanted) else np.zeros(len(codes), bool))
        pairs = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(starts, at, side="right") - 1)
        grams, first = np.unique(pairs >> 32, return_index=True)
        self.postings = dict(zip(grams.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:])))

    def candidates(self, query: Query) -> np.ndarray:
        """Rows whose text satisfies ``query``, ascending."""
        if query.kind == "all":
            return self.rows
        if query.kind == "gram":
            return self.postings.get(int.from_bytes(query.gram, "big"), self.rows[:0])
        found = [self.candidates(p) for p in query.parts]
        if query.kind == "or":
            return np.unique(np.concatenate(found))
        out = min(found, key=len)
        for other in found:
            out = np.intersect1d(out, other, assume_unique=True)
        return out


def shards(texts: Sequence[bytes], most: int = SHARD_BYTES) -> Iterator[tuple[int, Sequence[bytes]]]:
    """Consecutive texts of about ``most`` bytes together; a longer text is a shard of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


def code_points(text: bytes, offsets: Sequence[int]) -> list[int]:
    """Byte offsets of characters as numbers of characters."""
    if text.isascii():
        return list(offsets)
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return before[list(offsets)].tolist()


def scan_texts(texts: Sequence[bytes], rules: Sequence[Rule]) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule number, end) in code points, in order."""
    wanted = np.array(sorted(int.from_bytes(g, "big") for g in set().union(*(r.query.grams() for r in rules))), np.uint32)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, own in shards(texts):
        shard = Shard(own, wanted)
        for k, rule in enumerate(rules):
            for i in shard.candidates(rule.query).tolist():
                out[start + i] += [(a, k, b) for a, b in rule.spans(own[i])]
    for i, found in enumerate(out):
        if found:
            flat = code_points(texts[i], [x for a, _, b in found for x in (a, b)])
            out[i] = sorted((flat[2 * j], k, flat[2 * j + 1]) for j, (_, k, _) in enumerate(found))
    return out


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with the array ``into`` of (kind, start, end) by start, then kind as listed in ``rules``."""
    keep = [c for c in docs.columns if c != into]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rules = tuple(Rule(r.name, r.pattern, r.group, r.least) for r in rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text):
                found = scan_texts(encoded(block.column(text)), rules)
                spans = pa.array([[{"kind": rules[k].name, "start": a, "end": b} for a, k, b in row] for row in found], kind)
                yield pa.RecordBatch.from_arrays([*block.select(keep).columns, spans], names=[*keep, into])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, *([] if text in keep else [F.col(text)])).mapInArrow(run, f"{kept}`{into}` array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping and touching spans by one)."""
    found = find_secrets(docs, rules, text, "_spans")
    ends = F.aggregate(
        "_spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] > acc["at"], F.concat(acc["out"], F.substring(F.col(text), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)))
            .when((s["start"] == 0) & (acc["at"] == 0), F.lit(mark)).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at")))
    whole = F.when(F.size("_spans") > 0, F.concat(ends["out"], F.substring(F.col(text), ends["at"].cast("int") + 1, 2**31 - 1))).otherwise(F.col(text))
    return found.withColumn(text, whole).select(*docs.columns)
