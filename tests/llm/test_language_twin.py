"""Language predictions against plain loops over a trained model; long credentials against the same patterns in Python."""

import math
import os
import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest

from recordloom.llm import common, language, secrets

TEXTS = {
    "en": "the cat sat on the mat and thought about the weather with some friends", "de": "der hund lief schnell durch den wald und bellte über die straße hinweg", "nl": "de hond liep snel door het bos en blafte over de straat heen",
    "fr": "le chat dort près de la fenêtre où les élèves chantaient hier", "es": "el gato duerme cerca de la ventana donde los niños cantaban ayer",
}


def _features(text, width):
    """Frequencies of byte pairs and triples, by loops."""
    kept, last = [], None
    for b in b" " + text.encode() + b" ":
        b = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if not (b == 32 and last == 32):
            kept.append(b)
        last = b
    codes = [kept[i] * 256 + kept[i + 1] for i in range(len(kept) - 1)]
    codes += [0x1000000 + (kept[i] * 256 + kept[i + 1]) * 256 + kept[i + 2] for i in range(len(kept) - 2)]
    bits = width.bit_length() - 1
    n = Counter((c * 2654435761) % 2**32 >> (32 - bits) for c in codes)
    total = max(1, sum(n.values()))
    return {k: math.sqrt(v / total) for k, v in n.items()}


def _predict(model, text, width):
    v = _features(text, width)
    dot = lambda w: sum(float(w[k]) * x for k, x in v.items()) + float(w[width])
    margins = [dot(w) for w in model.tree]
    at = max(range(len(margins)), key=lambda i: margins[i])
    votes = {n: [0, 0.0] for n in model.families[at]}
    pairs = {ab: dot(w) for ab, w in model.pairs[at].items()}
    for (a, b), m in pairs.items():
        votes[a][0] += m > 0
        votes[b][0] += m < 0
        votes[a][1] += m
        votes[b][1] -= m
    best = max(votes, key=lambda n: (votes[n][0], votes[n][1], n))
    least = [m if a == best else -m for (a, b), m in pairs.items() if best in (a, b)] + ([margins[at]] if len(margins) > 1 else [])
    return best, 1 / (1 + math.exp(-2 * max(-20, min(20, min(least))))) if least else 1.0


def test_predictions_equal_plain_loops(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        lang = rng.choice(sorted(TEXTS))
        words = TEXTS[lang].split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))), lang if i % 9 else None))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? 34", "de"), (1003, "Der  HUND 12", None), (1003, "le chat", None), (None, "the cat", "en"), (1004, "the mat " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS held_out", "1 AS score")
    model = language.train(docs.select("doc_id", "text", "lang"), per_label=40)
    assert len(model.families) >= 2 and sum(len(p) for p in model.pairs) >= 1
    got = language.identify(docs.select("doc_id", "text", "lang"), model).collect()
    want = {}
    for i, t, _ in rows:
        has = t and re.search(r"[^\W\d_]", t)
        want.setdefault(i, []).append(_predict(model, t, 4096) if has else ("und", 0.0))
    assert len(got) == len(rows)
    for i, own in want.items():
        mine = sorted((r["lang_pred"], r["score"]) for r in got if r["doc_id"] == i)
        assert [x[0] for x in mine] == [x[0] for x in sorted(own)] and [x[1] for x in mine] == pytest.approx([x[1] for x in sorted(own)], abs=1e-3)


def test_machines_are_learnt_in_tasks(spark, monkeypatch):
    """The driver held the features of all labels' rows, three times over, and learnt every machine."""
    driver, learn = os.getpid(), language.svm

    def elsewhere(*args):
        assert os.getpid() != driver
        return learn(*args)

    monkeypatch.setattr(language, "svm", elsewhere)
    rows = [(i, f"{TEXTS[lang]} {i}", lang) for i, lang in enumerate(sorted(TEXTS) * 30)] + [(900, "12 !?", "no letters"), (901, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language.train(docs.repartition(n), per_label=20) for n in (1, 7))
    assert one.families == two.families and sorted(n for f in one.families for n in f) == sorted(TEXTS)
    assert (one.tree == two.tree).all() and len(one.pairs) == len(one.families) > 1
    for a, b in zip(one.pairs, two.pairs):
        assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, one).collect()}
    assert all(got[i] == lang for i, _, lang in rows[:-2]) and got[900] == got[901] == "und"


def test_the_driver_collects_garbage_when_much_is_held():
    """Nothing asked for it between staged tables, so the heap grew to its limit."""
    for used, calls in ((100, 0), (400, 1)):
        asked = []
        runtime = SimpleNamespace(totalMemory=lambda: 500, freeMemory=lambda used=used: 500 - used, maxMemory=lambda: 750)
        jvm = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: runtime), System=SimpleNamespace(gc=lambda: asked.append(1)))
        common.tidy(SimpleNamespace(_jvm=jvm))
        assert len(asked) == calls


def test_long_credentials_have_spans(spark):
    user, word = "u" * 300, "p4" * 500
    texts = [f"x https://{user}:{word}@host y", "-----BEGIN " + "VERY " * 60 + "PRIVATE KEY----- z", "s" * 40 + f"://a:{word}@h", "short ftp://a:b@h"]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()}
    where = lambda i: [tuple(s.split(":")) for s in got[i].split(",") if s.startswith(("login", "pem"))]
    assert where(0) == [("login", "2", str(texts[0].index("@") + 1))] and where(1) == [("pem", "0", str(texts[1].index(" z")))]
    assert where(2) == [("login", "19", str(texts[2].index("@") + 1))] and where(3) == []
