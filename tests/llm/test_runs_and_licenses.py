"""Periodic runs and licence templates against brute force: nulls, empty and long texts, ties, repeated rows and ids,
empty tables, clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from recordloom.llm import licenses, periodic


def _plain_runs(words, least=24, times=3):
    """Every lag, every stretch, every smaller period, by loops."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _text(rng):
    letters, out = [f"w{i}" for i in range(rng.choice((2, 3, 40)))], []
    for _ in range(rng.randint(1, 5)):
        out += [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        root = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        out += (root * 12)[: rng.randint(1, 12) * len(root) - rng.randint(0, len(root) - 1)]
    return out


def test_runs_match_plain_loops():
    rng = random.Random(4)
    cases = [_text(rng) for _ in range(150)] + [["a"] * 23, ["a"] * 24, ["a"] * 100, ["a", "b"] * 12, ["a", "b"] * 13, [], list("abcabd" * 9), ["x"] * 30 + list("xy" * 20) + ["x"] * 26]
    some = 0
    for words in cases:
        ids = periodic.word_ids([w.encode() for w in words])
        want = _plain_runs(words)
        some += len(want)
        assert periodic.find_runs(ids) == want
        high = len(words) // 3  # the same from ranges of lags, by whichever looks
        parts = {r for i in range(1, high + 1, 3) for r in periodic.find_runs(ids, low=i, high=min(i + 2, high))}
        assert sorted(parts, key=lambda r: (r[0], r[2])) == want
    assert some > 150


def test_looks_of_long_documents_agree_with_the_table(monkeypatch):
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 3000, 9000).astype(np.int32)
    ids[2000:3500] = np.tile(ids[2000:2050], 30)
    ids[5000:5900] = np.tile(ids[5000:5300], 3)
    want = periodic.find_runs(ids)
    assert {(r[1] >= 900, r[2]) for r in want} >= {(True, 50), (True, 300)}
    monkeypatch.setattr(periodic, "TABLE", 0)
    assert periodic.find_runs(ids) == want


ROWS = [
    (1, "a b " * 40), (2, None), (3, ""), (4, " \n\t"), (5, "one two three"), (5, "one two three"), (5, "z " * 30), (None, "q r s " * 20), (None, None),
    (7, "é x ü " * 30 + "tail"), (8, "k " * 24), (9, "k " * 23), (10, "m n " * 30 + "o p q " * 20 + "m n " * 30), (11, "w" * 200_000 + " " + "v " * 50),
    (12, " ".join(f"u{i % 997}" for i in range(4000))), (13, " ".join(random.Random(3).choice("abc") for _ in range(900))),
]


def _wanted(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = _plain_runs(words) if n < 2000 else [(0, 4000, 997)]
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = None
    for s, length, p in runs:
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{x},{p}\n" for s, x, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("long_chars", [400_000, 100])
def test_collapse(spark, long_chars):
    rows = ROWS + [(i, "f g h " * (i % 9) + "x y " * (i % 31)) for i in range(20, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "text AS best", "2 AS row", "0 AS n_words").repartition(4)
    got = periodic.digests(periodic.collapse_runs(docs, periodic.planted(docs["doc_id"], docs["text"]), long_chars=long_chars))
    found = [tuple(r)[:8] for r in got.collect()]
    assert sorted(found, key=str) == sorted((_wanted(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows if r[0] is not None)
    assert periodic.digests(periodic.collapse_runs(docs.limit(0), long_chars=long_chars)).count() == 0


def test_ties_of_the_greatest_exponent(spark):
    docs = spark.createDataFrame([(1, "a b " * 12 + "| " + "c d " * 12 + "; " + "e " * 23)], "doc_id long, text string")
    r = periodic.collapse_runs(docs).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 24, 2), (25, 24, 2)] and tuple(r["best"]) == (0, 24, 2)
    assert r["text"] == "a b | c d ; " + " ".join("e" * 23) and r["n_dropped"] == 44


def test_templates_are_matched_as_regular_expressions_match():
    rng = random.Random(8)
    templates = [
        "a b <<optional>>c d<<end>> e", "a <<any 2>> b", "a <<optional>>b <<optional>>c<<end>> d<<end>> e <<any 3>> f", "a b", "c <<optional>>a<<end>> <<optional>>a b<<end>> c",
        "a <<any 1>> <<any 1>> <<optional>>x <<any 2>> y<<end>> z",
    ]
    for t in templates:
        made = licenses.Automaton("l", "notice", t)
        pattern = re.compile(licenses._pattern(licenses.parse(t)))
        for _ in range(400):
            words = [rng.choice("abcdefxyz"[: rng.choice((4, 9))]) for _ in range(rng.randint(1, 12))]
            ends = [e for e in range(1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[:e]))]
            assert made.longest(words, 0) == (max(ends) if ends else None), (t, words)


def test_mistaken_templates_are_refused():
    for t in ("<<optional>>a<<end>> b", "a <<optional>> b", "a <<end>> b", "a <<any 3>>", "", "<<any 2>> a"):
        with pytest.raises(ValueError):
            licenses.parse(t)


def _filled(template, rng, change=False):
    """A text of the template: regions left out or filled; with `change`, one mandatory word is another."""
    must = []

    def lay(parts, inside, out):
        for kind, value, inner in parts:
            if kind == "word":
                must.extend([len(out)] * (not inside))
                out.append(value.upper() if rng.random() < 0.3 else value)
            elif kind == "any":
                out.extend(rng.choice(["2024", "jane", "doe", "ünal"]) for _ in range(rng.randint(0, value)))
            elif rng.random() < 0.5:
                lay(inner, True, out)
        return out

    words = lay(licenses.parse(template), False, [])
    if change:
        words[must[rng.randrange(1, len(must))]] = "xyzzy"
    return "".join(w + rng.choice([" ", "\n", ", ", " (", "-", '" ']) for w in words)


def test_templates_accept_their_texts_and_no_other():
    rng, automata = random.Random(6), licenses.compiled(licenses.TEMPLATES)
    for label, kind, template in licenses.TEMPLATES:
        for _ in range(6):
            found = {(m[2], m[3]) for m in licenses.matches(licenses.words_of("so " + _filled(template, rng) + " end"), automata)}
            assert (label, kind) in found
        for _ in range(6):
            text = _filled(template, rng, change=True)
            assert not any(e - s > 20 and k == kind == "grant" and x == label for s, e, x, k in licenses.matches(licenses.words_of(text), automata)), text


def test_scan(spark):
    rng = random.Random(7)
    rows = [
        (1, "Released under the MIT License."), (2, None), (3, ""), (4, "no\nlicence"), (None, "Licensed under CC BY-NC 4.0."), (5, "Apache  License, apache-license; MIT\nLicense"), (5, "cc by"), (5, "cc by"),
        (6, "This work is licensed under the GNU General Public License, version 3."), (7, "émit license mit licenseé mit license"), (8, "CC BY" + " x" * 50_000 + " MIT LICENSE"), (9, "İ mit license K"),
    ] + [(20 + i, "head. " + _filled(t, rng) + ". tail") for i, (_, _, t) in enumerate(licenses.TEMPLATES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS matches", "7 AS n_words", "'l' AS label").repartition(3)
    found = [tuple(r) for r in licenses.labelled(licenses.scan(docs)).collect()]

    def wanted(doc, text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        base = sorted((i, label) for label, p in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        joined = " " + "".join(w + " " for w in words)
        more = [(label, licenses.WEIGHT[kind]) for label, kind, t in licenses.TEMPLATES if re.search(" " + licenses._pattern(licenses.parse(t)), joined)]
        labels = sorted({x for _, x in base} | {x for x, _ in more})
        at = [i for i, _ in base] or [None]
        return (doc, len(words), len(base), at[0], at[-1], ",".join(sorted({x for _, x in base})), ",".join(labels), max([w for _, w in more] + [0.5] * bool(base), default=0.0))

    assert sorted(found, key=str) == sorted((wanted(*r) for r in rows), key=str)
    assert {r[0]: r[6] for r in found}[None] == "cc-by,cc-by-nc-4.0"
    assert licenses.labelled(licenses.scan(docs.limit(0))).count() == 0
