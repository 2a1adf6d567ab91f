"""The prefix trie against plain dictionaries: absent first conversations, turnless ones, copies, bands, many shards,
nulls, ties, repeated rows, an empty table, clashing column names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from recordloom.llm import trie


def _label(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def _ordered(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, _label(role, text), len((text or "").split())))
    return {c: [(x[2], x[3]) for x in sorted(turns)] for c, turns in own.items()}


def _rebuilt(rows):
    own = _ordered(rows)
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _nodes(sequences):
    members, ends, kids, words = defaultdict(list), defaultdict(list), defaultdict(set), {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            key = tuple(x for x, _ in turns[:d])
            members[key].append(c)
            words[key] = turns[d - 1][1] if d else 0
            if d:
                kids[key[:-1]].add(key)
        ends[tuple(x for x, _ in turns)].append(c)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = (len(members[key]) - 1) * words[key] + sum(saved[k] for k in kids[key])
    sha = lambda own: hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest()
    return sorted((min(own), len(k), min(members[k[:-1]]) if k else -1, len(own), len(kids[k]), leaves[k], saved[k], sha(ends[k])) for k, own in members.items())


def _found(df):
    assert tuple(df.columns) == trie.NODE
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(12)
    rows = []
    for c in [*range(0, 90), *range(101, 119), -5, -21, 400, 70_000, 10**12]:
        if c in (40, 60):
            continue  # a block whose first conversation is absent
        hot = rng.random() < 0.5
        for t in range(rng.choice((1, 1, 2, 3, 5, 9, 14))):
            text = f"same {t}" if hot and rng.random() < 0.9 else rng.choice(["yes", "no", "why not", "", None, "é  ü\tx\ny"])
            rows.append((c, rng.choice((t, t, None)) if t > 6 else t, rng.choice(("user", "user", "user", None)), text))
    rows += [(500 + i, t, "user", f"long {t}") for i in range(7) for t in range(11 + i % 3)]  # copies, some longer
    rows += [(None, 1, "user", "nobody"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "system", "tie b"), (8, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def table(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 AS conv", "'x' AS label", "2 AS id", "0 AS depth", "text AS words", "3 AS task").repartition(5)


@pytest.mark.parametrize("width", [4096, 3])
def test_contract(table, turns, width):
    want = _nodes(_rebuilt(turns))
    assert _found(trie.prefix_trie(*trie.rebuilt(table), width=width)) == want
    assert len(want) > 150


@pytest.mark.parametrize(("width", "most_sent"), [(4096, 0), (1, 200_000), (5, 0)])
def test_own_turns(table, turns, width, most_sent):
    assert _found(trie.prefix_trie(*trie.sequences(table), width=width, shard_turns=20, most_sent=most_sent)) == _nodes(_ordered(turns))


def test_turnless_conversations(spark):
    rows = [(c, 0, "user", "only") for c in range(21, 40)]  # conversation 20 is absent: who takes a turn from it has none
    got = _found(trie.prefix_trie(*trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    want = _nodes(_rebuilt(rows))
    assert got == want and want[0][7] != trie.NONE and any(not t for t in _rebuilt(rows).values())
    none = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4]
    assert len(_found(trie.prefix_trie(*trie.rebuilt(spark.createDataFrame(none, "conv_id long, turn long, role string, text string"))))) == 1


def test_empty(spark, table):
    for empty in (table.limit(0), table.filter("conv_id IS NULL")):
        out = trie.prefix_trie(*trie.rebuilt(empty))
        assert tuple(out.columns) == trie.NODE and out.count() == 0


def test_ends_of_many_blocks(spark):
    ids = [*range(70_000), -3, 10**9, 10**9 + 1]
    rows = spark.createDataFrame([(c,) for c in ids], "conv_id long").selectExpr("conv_id", "0L AS turn", "'user' AS role", "'hi' AS text")
    got = {r["depth"]: r for r in trie.prefix_trie(*trie.sequences(rows)).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert (got[1]["n_convs"], got[1]["conv_id"], got[1]["saved_tokens"]) == (len(ids), -3, len(ids) - 1)


def test_louds_shards_hold_the_trie(spark, table, turns):
    groups, _ = trie._groups(*trie.sequences(table), 4096)
    paths = set()
    for r in trie.tries(groups, 3).collect():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: 2 * r["n_nodes"] - r["n_roots"]]
        ones, zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)
        assert len(zeros) == r["n_nodes"] and r["n_roots"] == 1
        path = {0: ()}
        for k, one in enumerate(ones.tolist()):
            path[r["n_roots"] + k] = path[int(np.searchsorted(zeros, one))] + (r["labels"][r["n_roots"] + k],)
        paths |= set(path.values())
    assert paths == {tuple(x for x, _ in t[:d]) for t in _ordered(turns).values() for d in range(len(t) + 1)}
