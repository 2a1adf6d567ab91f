"""Context-tree weighting over the running text, against plain recursion over dictionaries."""

import random
from collections import Counter
from math import exp, lgamma, log, log10, pi

import pytest

from recordloom.llm import ctw, ctw_running, queries

R = random.Random(5)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randint(1, 9))) for _ in range(40)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, " ".join(R.choice(WORDS) for _ in range(R.randint(1, 40)))) for i in range(70)]
    out += [(i, f"{'gamma'[:i % 5]} Alpha beta\tdelta beta") for i in range(70, 90)] + [(90, None), (91, ""), (92, " \n "), (None, "alpha"), (93, "Unseen qqq alpha beta"), (93, "Unseen qqq alpha beta")]
    return out + [(94, " ".join(R.choice(WORDS) for _ in range(3000)))]


def spelt(text):
    s = b"".join(w + b" " for w in (text or "").encode().lower().split()) + b" "
    whole = b" " * 7 + s
    return [(whole[i + 7], [whole[i + 7 - d : i + 7] for d in range(ctw_running.DEPTH + 1)]) for i in range(len(s))]


def model(texts):
    node, kids, weight = {}, {}, {}
    for (byte, contexts), c in Counter((b, tuple(x)) for t in texts for b, x in spelt(t)).items():
        for k in range(8):
            prefix, bit = (k, byte >> (8 - k)), byte >> (7 - k) & 1
            for d, ctx in enumerate(contexts):
                node.setdefault((ctx, prefix), [0, 0])[bit] += c
                if d:
                    kids.setdefault((contexts[d - 1], prefix), set()).add((ctx, prefix))

    def whole(x):
        a, b = node[x]
        own = lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - log(pi)
        if x not in kids:
            return own
        inner = sum(map(whole, kids[x]))
        weight[x] = 1 / (1 + exp(max(-700, min(700, inner - own))))
        return log(0.5) + max(own, inner) + log(1 + exp(-abs(own - inner)))

    for x in [x for x in node if x[0] == b""]:
        whole(x)

    def chance(byte, contexts, k):
        p, prefix, bit = None, (k, byte >> (8 - k)), byte >> (7 - k) & 1
        for ctx in reversed(contexts):
            if n := node.get((ctx, prefix)):
                kt = (n[bit] + 0.5) / (sum(n) + 1)
                p = kt if p is None else weight[ctx, prefix] * kt + (1 - weight[ctx, prefix]) * p
        return 0.5 if p is None else p

    return lambda text: sum(log10(chance(byte, contexts, k)) for byte, contexts in spelt(text) for k in range(8))


@pytest.mark.parametrize(("part", "often", "common"), [(150_000, 2_000_000, 200_000), (60, 300, 20)])
def test_scores(spark, rows, part, often, common, monkeypatch):
    """With all grams sent and with most of them met by shuffle, in one task and in many."""
    monkeypatch.setattr(ctw_running, "PART", part)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    train = [t for i, t in rows if not ctw.held_out(i)]
    c = Counter(w for t in train for w in [*(t or "").encode().lower().split(), b""])
    n, v, logp = sum(c.values()), len(c), model(train)
    want = []
    for i, t in rows:
        ws = [*(t or "").encode().lower().split(), b""]
        want.append((i, ctw.held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), logp(t)))
    got = ctw_running.score(docs, common=common, often=often).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-5)


def test_empty(spark):
    assert ctw_running.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_cross_words(spark, tmp_path):
    """The same words in another order: scores that depended on each word alone were the same."""
    held = [i for i in range(100, 200) if ctw.held_out(i)][:2]
    rows = [(i, "north wind and south sea " * 5) for i in range(40)] + [(held[0], "north wind and south sea"), (held[1], "sea south and wind north")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.op2_ctw_score(spark, str(tmp_path)).collect()}
    assert got[held[0]] > got[held[1]] + 3


def test_contexts_reach_into_unknown_words(spark):
    """Of words with an untrained beginning, what follows is told by the three bytes before, not by two."""
    held = [i for i in range(100, 200) if ctw.held_out(i)][:2]
    rows = [(i, "arthe brthu " * 20) for i in range(40)] + [(held[0], "qarthe"), (held[1], "qarthu")]
    got = {r["doc_id"]: r["score"] for r in ctw_running.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 1
