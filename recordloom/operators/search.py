"""Keyword search: BM25 with a boolean, phrase, prefix, proximity and column query language.

Score of a row: minus the sum over phrases of idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * |D| / avgdl)), columns pooled;
idf = ln((N - n + 0.5) / (n + 0.5)), 1e-6 where that is not positive. N, n and avgdl are over the whole table: one
aggregate pass gathers all of them, and only scalars come to the driver. Lower is better.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


class QueryError(ValueError):
    """The query does not follow the grammar."""


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None


@dataclass
class Near:
    phrases: list[Phrase]
    distance: int = 10


@dataclass
class Node:
    kind: str  # and, or, not
    parts: list = field(default_factory=list)


def split_words(text: str) -> list[str]:
    """The same tokens as functions.text.tokens, for the query's side."""
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return [w for w in re.split(r"[^\w]+|_+", folded) if w]


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|([(){}:+*^,-]))')


class Parser:
    """NOT binds tighter than AND (or nothing between operands), that tighter than OR."""

    def __init__(self, query: str, columns: list[str]):
        self.items, self.columns, at = [], columns, 0
        query = query.rstrip()
        while at < len(query):
            m = _TOKEN.match(query, at)
            if not m:
                raise QueryError(f"syntax error near {query[at:at + 10]!r}")
            self.items.append(("text", m[1][1:-1].replace('""', '"')) if m[1] else ("word", m[2]) if m[2] else ("mark", m[3]))
            at = m.end()
        self.at = 0

    def peek(self, *wanted, ahead: int = 0) -> bool:
        return self.at + ahead < len(self.items) and self.items[self.at + ahead] in wanted

    def take(self):
        if self.at >= len(self.items):
            raise QueryError("unexpected end of query")
        self.at += 1
        return self.items[self.at - 1]

    def parse(self):
        if not self.items:
            raise QueryError("empty query")
        tree = self.either()
        if self.at < len(self.items):
            raise QueryError(f"syntax error near {self.items[self.at][1]!r}")
        return tree

    def either(self):
        parts = [self.both()]
        while self.peek(("word", "OR")):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", parts)

    def both(self):
        parts = [self.without()]
        while self.at < len(self.items) and not self.peek(("word", "OR"), ("mark", ")")):
            if self.peek(("word", "AND")):
                self.take()
            parts.append(self.without())
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def without(self):
        left = self.operand()
        while self.peek(("word", "NOT")):
            self.take()
            left = Node("not", [left, self.operand()])
        return left

    def operand(self, columns=None):
        if self.peek(("mark", "(")):
            self.take()
            inner = self.either()
            if self.take() != ("mark", ")"):
                raise QueryError("missing )")
            return self.within(inner, columns) if columns else inner
        if self.peek(("mark", "{")) or self.peek(("mark", "-")) or (self.at < len(self.items) and self.items[self.at][0] == "word" and self.peek(("mark", ":"), ahead=1)):
            return self.operand(self.filter())
        if self.peek(("word", "NEAR")) and self.peek(("mark", "("), ahead=1):
            return self.near(columns)
        return self.phrase(columns)

    def filter(self):
        out = self.peek(("mark", "-")) and bool(self.take())
        if self.peek(("mark", "{")):
            self.take()
            names = []
            while not self.peek(("mark", "}")):
                names.append(self.take()[1])
            self.take()
        else:
            names = [self.take()[1]]
        if self.take() != ("mark", ":"):
            raise QueryError("missing : after a column")
        for n in names:
            if n not in self.columns:
                raise QueryError(f"no such column: {n}")
        return tuple(c for c in self.columns if (c in names) != out)

    def within(self, node, columns):
        for leaf in leaves(node):
            leaf.columns = tuple(c for c in leaf.columns if c in columns) if leaf.columns is not None else columns
        return node

    def phrase(self, columns=None) -> Phrase:
        first = self.peek(("mark", "^")) and bool(self.take())
        words: list[str] = []
        while True:
            kind, value = self.take()
            if kind == "mark" or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QueryError(f"syntax error near {value!r}")
            words += split_words(value)
            if not self.peek(("mark", "+")):
                break
            self.take()
        prefix = self.peek(("mark", "*")) and bool(self.take())
        return Phrase(words, prefix, first, columns)

    def near(self, columns) -> Near:
        self.take(), self.take()
        phrases, distance = [], 10
        while not self.peek(("mark", ")"), ("mark", ",")):
            phrases.append(self.phrase(columns))
        if self.peek(("mark", ",")):
            self.take()
            distance = int(self.take()[1])
        if self.take() != ("mark", ")"):
            raise QueryError("missing )")
        return Near(phrases, distance)


def leaves(node) -> list[Phrase]:
    return [node] if isinstance(node, Phrase) else list(node.phrases) if isinstance(node, Near) else [x for p in node.parts for x in leaves(p)]


def _starts(t: Column, p: Phrase) -> Column:
    """1-based places where the phrase begins in a token array."""
    n = len(p.words)
    if not n:
        return F.array().cast("array<int>")

    def here(i):
        ok = F.lit(True)
        for k, w in enumerate(p.words):
            own = F.element_at(t, i + k)
            ok &= own.startswith(w) if p.prefix and k == n - 1 else own == w
        return ok & (i == 1) if p.first else ok

    return F.when(F.size(t) >= n, F.filter(F.sequence(F.lit(1), F.size(t) - n + 1), here)).otherwise(F.array().cast("array<int>"))


def _token_starts(column: str, p: Phrase) -> Column:
    return _starts(F.col(f"_t_{column}"), p)


def _frequency(p: Phrase, columns: list[str], starts=_token_starts) -> Column:
    own = [c for c in columns if p.columns is None or c in p.columns]
    return sum((F.size(starts(c, p)) for c in own), F.lit(0))


def _near_frequencies(node: Near, columns: list[str], starts=_token_starts) -> list[Column]:
    """Per phrase the places that take part in a match: a window opens at any phrase's place and holds a place of
    every other within `distance` words after that phrase."""
    totals = [F.lit(0)] * len(node.phrases)
    for c in columns:
        if node.phrases[0].columns is not None and c not in node.phrases[0].columns:
            continue
        places = [starts(c, p) for p in node.phrases]
        windows = []
        for i, p in enumerate(node.phrases):
            reach = len(p.words) + node.distance
            windows.append((_open_at(places, i, reach), reach))
        for j in range(len(node.phrases)):
            totals[j] = totals[j] + F.size(_taking_part(places[j], windows))
    return totals


def _open_at(places: list[Column], i: int, reach: int) -> Column:
    def opens(s):
        ok = F.lit(True)
        for j, other in enumerate(places):
            if j != i:
                ok &= F.exists(other, lambda q: (q >= s) & (q <= s + reach))
        return ok

    return F.filter(places[i], opens)


def _taking_part(own: Column, windows) -> Column:
    def inside(q):
        ok = F.lit(False)
        for opened, reach in windows:
            ok |= _covers(opened, reach, q)
        return ok

    return F.filter(own, inside)


def _covers(opened: Column, reach: int, q: Column) -> Column:
    return F.exists(opened, lambda s: (q >= s) & (q <= s + reach))


def _collect(node, columns, found: list, starts=_token_starts):
    """(matched, score) Columns; found gathers each scoring phrase's frequency and, for its document count, that of the
    phrase alone. starts gives a phrase's places in a column."""
    if isinstance(node, (Phrase, Near)):
        frequencies = [_frequency(node, columns, starts)] if isinstance(node, Phrase) else _near_frequencies(node, columns, starts)
        names = []
        own = [node] if isinstance(node, Phrase) else node.phrases
        for f, phrase in zip(frequencies, own):
            names.append(f"_f{len(found)}")
            found.append((f, _frequency(phrase, columns, starts)))
        return lambda score: (_every([F.col(n) > 0 for n in names]), sum((score(n) for n in names), F.lit(0.0)))
    parts = [_collect(p, columns, found, starts) for p in node.parts]

    def build(score):
        made = [p(score) for p in parts]
        if node.kind == "or":
            return _some([m for m, _ in made]), sum((F.when(m, s).otherwise(0.0) for m, s in made), F.lit(0.0))
        if node.kind == "and":
            return _every([m for m, _ in made]), sum((s for _, s in made), F.lit(0.0))
        return made[0][0] & ~made[1][0], made[0][1]

    return build


def _every(flags):
    out = flags[0]
    for f in flags[1:]:
        out &= f
    return out


def _some(flags):
    out = flags[0]
    for f in flags[1:]:
        out |= f
    return out


def _tokenised(table: DataFrame, columns: list[str]) -> DataFrame:
    """With _t_<column> token arrays. They pass through a one-row generator: without it Catalyst would put the
    tokenising expression into every place that reads a token."""
    held = table.select("*", F.explode(F.array(F.struct(*(tokens(F.col(c)).alias(c) for c in columns)))).alias("_t"))
    return held.select(*table.columns, *(F.col("_t")[c].alias(f"_t_{c}") for c in columns))


def bm25(table: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """The rows that match, with `rank` (negative; lower is better)."""
    tree = Parser(query, columns).parse()
    found: list[tuple[Column, Column]] = []
    build = _collect(tree, columns, found)
    marked = _tokenised(table, columns)
    marked = marked.withColumns({f"_f{i}": f for i, (f, _) in enumerate(found)} | {f"_d{i}": d > 0 for i, (_, d) in enumerate(found)} | {"_len": sum((F.size(f"_t_{c}") for c in columns), F.lit(0))}).drop(*(f"_t_{c}" for c in columns))
    stats = marked.agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.count_if(f"_d{i}").alias(f"d{i}") for i in range(len(found)))).first()

    def score(name):
        i = int(name[2:])
        ratio = (F.lit(float(stats["n"])) - stats[f"d{i}"] + 0.5) / (stats[f"d{i}"] + 0.5)
        idf = F.greatest(F.log(ratio), F.lit(0.0))
        f = F.col(name).cast("double")
        return F.when(idf > 0, idf).otherwise(1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("_len") / F.lit(stats["avg"] or 1.0)))

    matched, total = build(score)
    return marked.filter(matched).withColumn("rank", -total).drop("_len", *(f"_{x}{i}" for x in "fd" for i in range(len(found))))


def top(table: DataFrame, query: str, columns: list[str], limit: int = 20, project: str | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """Best rows of one table. Statistics are over the whole table; the project filter and the rows marked as
    duplicates (hidden, ids) apply to what is returned."""
    hits = bm25(table, query, columns)
    if project is not None:
        hits = hits.filter(F.col("project") == project)
    if hidden is not None:
        hits = hits.join(hidden.select("id").distinct(), "id", "left_anti")
    return hits.orderBy("rank", "id").limit(limit)


def biased(rank: Column, table: Column, favoured: str | None) -> Column:
    """A favoured table's rank counts four times; it never filters."""
    if favoured is None:
        return rank
    return F.when(table != favoured, rank).when(rank < 0, rank * 4).when(rank > 0, rank / 4).otherwise(-2.220446049250313e-16)


def _let(value: Column, use) -> Column:
    """use(value), with the value made once: a lambda's variable is bound, where a Column would be repeated."""
    return F.transform(F.array(value), use)[0]


def snippet(text: Column, words: list[str], size: int = 40) -> Column:
    """Up to `size` tokens around the first match, matches between double stars."""
    hit = lambda x: F.array_join(tokens(x), " ").isin(*words) if words else F.lit(False)
    parts = F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), lambda x: F.struct(x.alias("w"), hit(x).alias("hit")))
    shown = lambda x: F.when(x["hit"], F.concat(F.lit("**"), x["w"], F.lit("**"))).otherwise(x["w"])
    begin = lambda m: F.greatest(F.array_position(F.transform(m, lambda x: x["hit"]), True) - size // 4, F.lit(1)).cast("int")
    return _let(parts, lambda m: F.array_join(F.transform(F.slice(m, begin(m), size), shown), " "))
