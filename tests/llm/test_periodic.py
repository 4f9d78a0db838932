import hashlib
import random
import zlib

import numpy as np

from ledgerloom.llm import periodic
from ledgerloom.llm.queries import QUERIES
from tests.llm.samples import SMALL, awkward, documents, empty

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def split(text):
    out = (text or "").translate({ord(c): " " for c in SPACES})
    return [w for w in out.split(" ") if w]


def brute(words):
    """(start, length, period) of all runs: every period, every stretch."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(12, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def cases():
    """Documents full of repetitions: few words, powers, Fibonacci and Thue-Morse words, broken periods."""
    random.seed(3)
    out = [["a"] * 40, ["a", "b"] * 6, ["a", "b"] * 6 + ["a"], ["a"] * 11, ["a"] * 12, list("abcdef") * 2, list("abcde") * 2]
    x, y = ["a", "b"], ["a"]
    while len(x) < 150:
        x, y = x + y, x
    out.append(x)
    morse = ["a"]
    while len(morse) < 256:
        morse += ["b" if w == "a" else "a" for w in morse]
    out.append(morse)
    for _ in range(60):
        unit = [random.choice("abcdefgh") for _ in range(random.randint(1, 20))]
        noise = [random.choice("xyz") for _ in range(random.randint(0, 6))]
        out.append(noise + (unit * 9)[: random.randint(0, 100)] + noise + unit * random.randint(0, 4))
        out.append([random.choice("ab") for _ in range(random.randint(0, 100))])
    return out


def runs_by_document(docs, attempt=0):
    words_of, symbols, row = periodic._numbered([(i, " ".join(d).encode()) for i, d in enumerate(docs)], None)
    begin, end, period = periodic.runs_of(symbols, row, attempt)
    first = np.cumsum([0] + [len(w) for w in words_of])
    out = [[] for _ in docs]
    for b, e, p in zip(begin.tolist(), end.tolist(), period.tolist()):
        out[row[b]].append((b - int(first[row[b]]), e - b, p))
    return out


def test_against_all_periods():
    docs = cases()
    want = [brute(d) for d in docs]
    assert sum(map(len, want)) > 200
    for attempt in (0, 1):  # both kinds of fingerprints
        assert runs_by_document(docs, attempt) == want


def test_misleading_fingerprints_are_noticed():
    """Thue-Morse words make prefix fingerprints modulo 2**64 collide; the runs are found all the same."""
    morse = [0]
    while len(morse) < 1 << 12:
        morse += [1 - w for w in morse]
    text = morse + [2] + morse
    prints = periodic.Fingerprints(np.array(morse))
    at = np.array([0])
    with np.errstate(over="ignore"):
        assert prints.same(at, np.array([2048]), np.array([2048]))[0]  # equal fingerprints, different words
    begin, end, period = periodic.runs_of(np.array(text), np.zeros(len(text), dtype=np.int64))
    got = sorted(zip(begin.tolist(), (end - begin).tolist(), period.tolist()))
    assert got == sorted((s, length, p) for s, length, p in brute(text))


def test_grammar_covers_the_text():
    """Every nonterminal stands for the same words wherever it is used, and no pair of a start string recurs."""
    docs = [random.Random(i).choices("abcd", k=80) for i in range(5)] + [["a"] * 33]
    _, symbols, row = periodic._numbered([(i, " ".join(d).encode()) for i, d in enumerate(docs)], None)
    grammar = periodic.Grammar(symbols, row)
    yields = {}
    for rule, b, m, e in zip(grammar.rule, grammar.begin, grammar.middle, grammar.end):
        assert b < m < e and row[b] == row[e - 1]
        assert yields.setdefault(rule, (m - b, tuple(symbols[b:e]))) == (m - b, tuple(symbols[b:e]))
    assert max(np.bincount(grammar.rule)) > 1
    boundaries = set(grammar.middle.tolist())
    assert boundaries == {i for i in range(1, len(symbols)) if row[i] == row[i - 1]}


def test_awkward(spark):
    frame, rows = awkward(spark)
    got = {(r.doc_id, r.collapsed, r.n_words, tuple(tuple(x) for x in r.runs)) for r in periodic.find_runs(frame).collect()}
    want = set()
    for doc, text in rows:
        words = split(text)
        runs = brute(words) if len(words) < 1000 else []
        want.add((doc, collapsed(words, runs), len(words), tuple(runs)))
    assert got == want
    assert periodic.find_runs(empty(spark)).collect() == []
    long = spark.createDataFrame([(1, "a b c " * 20_000 + "end"), (2, "a " * 30_000)], "doc_id long, text string")
    found = {r.doc_id: (r.runs, r.collapsed) for r in periodic.find_runs(long).collect()}
    assert [tuple(x) for x in found[1][0]] == [(0, 60_000, 3)] and found[1][1] == "a b c end"
    assert [tuple(x) for x in found[2][0]] == [(0, 30_000, 1)] and found[2][1] == "a"


def test_query(spark):
    """The registered query against brute force over whole documents."""
    texts = [(d, t) for d, t, _ in documents()]
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    assert len(got) == len(texts)
    repeated = 0
    for doc, text in texts:
        words = split(text)
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        elif len(words) > 2500:
            continue  # too slow for every period
        runs = brute(words)
        row = got[doc]
        best = min(((-length, s, p) for s, length, p in runs), default=None)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert row.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        assert row.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        repeated += bool(runs)
    assert repeated > 10
