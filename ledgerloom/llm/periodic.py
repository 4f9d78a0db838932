"""Maximal periodic runs of words, found in a Re-Pair grammar of each document.

A run is a stretch of consecutive words with smallest period ``q`` (words
``q`` apart are identical), at least ``max(shortest, 2 * q)`` words long, that
no neighbouring word extends.

1. *Re-Pair*: words become numbers, then pairs of neighbours that recur become
   nonterminals, round by round, until no pair of a document recurs.  All
   documents of a batch are rewritten at once: a round takes every pair that
   is more frequent than the pairs it overlaps (the most frequent pair of a
   document always is).  The start string that remains is closed by a balanced
   tree, so every part of the text is the yield of some node.
2. *Boundaries*: a run lies in the yield of a lowest node and crosses the
   boundary between its two children.  The runs crossing it are computed once
   for each nonterminal: candidate periods are the distances at which a window
   of six words touching the boundary recurs (a run repeats at least six words
   there), their extent comes from prefix fingerprints.
3. *Translation*: what was found is carried to all derivation positions of the
   nonterminal, parts of longer runs of the same period are dropped and equal
   stretches keep the smallest period.
4. Every run is compared word by word; if a fingerprint misled, the batch is
   done again with other fingerprints.

One map pass without a shuffle; work is ``n log n`` in a document's length.
Nodes in documents without any recurring window hold no run and are skipped.

Defined cases: a null or empty text, or one without words, has no runs and an
empty collapsed text.  Repeated rows are treated alike, a null ``doc_id`` is
kept.  Bytes that are no UTF-8 pass through unchanged.  An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, mix, pieces_of, texts

SHORTEST = 12
#: A run of at least ``SHORTEST`` words and two periods repeats so many words in a row.
WINDOW = SHORTEST // 2
#: (node, period) pairs worked on at once.
CHUNK = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64((1 << 31) - 1)

#: Given a document's id and its number of words, the places of the words to read instead, or None.
Places = Callable[[int | None, int], np.ndarray | None]


class Fingerprints:
    """Prefix fingerprints: ``same`` tells whether two stretches a given distance apart are equal.

    The first attempt computes modulo 2**64, later ones modulo a prime with two random bases.
    """

    def __init__(self, symbols: np.ndarray, attempt: int = 0):
        self.attempt, n = attempt, len(symbols)
        values = mix(symbols.astype(np.uint64) + np.uint64(1 + attempt))
        if attempt == 0:
            self.powers = np.full(n + 1, _BASE)
            self.powers[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            self.sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(values * self.powers[:n], out=self.sums[1:])
            return
        random = np.random.default_rng(attempt)
        self.tables = []
        for base in random.integers(1 << 20, int(_PRIME), 2):
            powers, filled = np.ones(n + 1, dtype=np.uint64), 1
            while filled <= n:  # doubling: base**filled times what is there
                more = min(filled, n + 1 - filled)
                powers[filled : filled + more] = powers[:more] * np.uint64(pow(int(base), filled, int(_PRIME))) % _PRIME
                filled += more
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(values % _PRIME * powers[:n] % _PRIME, out=sums[1:])
            self.tables.append((powers, sums))

    def windows(self, size: int) -> np.ndarray:
        """One fingerprint per place for the ``size`` symbols from there."""
        powers, sums = (self.powers, self.sums) if self.attempt == 0 else self.tables[0]
        n, part = len(sums) - 1, sums[size:] - sums[:-size]
        # brought to one power by multiplying up
        if self.attempt == 0:
            return part * powers[n - size :: -1][: n - size + 1]
        other = self.tables[1]
        up, up2 = powers[n - size :: -1][: n - size + 1], other[0][n - size :: -1][: n - size + 1]
        second = (other[1][size:] - other[1][:-size]) % _PRIME * up2 % _PRIME
        return (part % _PRIME * up % _PRIME << np.uint64(32)) | second

    def same(self, at: np.ndarray, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` symbols from ``at`` equal those from ``at + distance``."""
        far = at + distance
        if self.attempt == 0:
            s = self.sums
            return (s[at + length] - s[at]) * self.powers[distance] == s[far + length] - s[far]
        equal = np.ones(len(at), dtype=bool)
        for powers, s in self.tables:
            near = (s[at + length] - s[at]) % _PRIME * powers[distance] % _PRIME
            equal &= near == (s[far + length] - s[far]) % _PRIME
        return equal

    def forward(self, at: np.ndarray, distance: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols (at most ``most``) agree from ``at`` and ``at + distance`` on."""
        length = np.zeros(len(at), dtype=np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            longer = length + step
            ok = np.flatnonzero(longer <= most)
            ok = ok[self.same(at[ok], distance[ok], longer[ok])]
            length[ok] = longer[ok]
        return length

    def backward(self, at: np.ndarray, distance: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols (at most ``most``) agree before ``at`` and before ``at + distance``."""
        length = np.zeros(len(at), dtype=np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            longer = length + step
            ok = np.flatnonzero(longer <= most)
            ok = ok[self.same(at[ok] - longer[ok], distance[ok], longer[ok])]
            length[ok] = longer[ok]
        return length


def recurring(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the keys that occur at least twice, a number for each key, and the keys' counts by number."""
    bits = max(10, (4 * len(keys)).bit_length())
    slot = (keys * _BASE >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)  # most single keys go without a sort
    _, number, counts = np.unique(keys[maybe], return_inverse=True, return_counts=True)
    twice = counts[number] > 1
    return maybe[twice], number[twice], counts


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 0, 3: owners 0 0 2 2 2 and numbers within them 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    return owner, np.arange(len(owner)) - np.repeat(ends - counts, counts)


class Grammar:
    """Re-Pair of many documents at once.

    ``symbols`` are numbers that no two documents share, ``document`` is the
    document of each place.  ``rule, begin, middle, end`` have one entry for
    each node of the derivation trees: the stretches ``[begin, middle)`` and
    ``[middle, end)`` are the yields of its children.
    """

    def __init__(self, symbols: np.ndarray, document: np.ndarray):
        n = len(symbols)
        symbol, doc = symbols.astype(np.uint64), document
        begin, end = np.arange(n), np.arange(1, n + 1)
        fresh = int(symbols.max(initial=-1)) + 1
        nodes: list[tuple[np.ndarray, ...]] = []
        left: list[tuple[np.ndarray, ...]] = []  # start strings of the documents that are done
        while len(symbol) > 1:
            chosen, rule = self._chosen(symbol, doc)
            if not len(chosen):
                break
            nodes.append((rule + fresh, begin[chosen], begin[chosen + 1], end[chosen + 1]))
            symbol[chosen] = (rule + fresh).astype(np.uint64)
            end[chosen] = end[chosen + 1]
            fresh += int(rule.max()) + 1
            stay = np.ones(len(symbol), dtype=bool)
            stay[chosen + 1] = False
            moving = np.zeros(int(doc[-1]) + 1, dtype=bool)
            moving[doc[chosen]] = True
            moving = moving[doc]
            done = stay & ~moving
            left.append((begin[done], end[done], doc[done]))
            stay &= moving
            symbol, begin, end, doc = symbol[stay], begin[stay], end[stay], doc[stay]
        left.append((begin, end, doc))
        begin, end, doc = (np.concatenate(c) for c in zip(*left))
        order = np.argsort(begin, kind="stable")
        nodes.append(self._closed(begin[order], end[order], doc[order], fresh))
        self.rule, self.begin, self.middle, self.end = (np.concatenate(c) for c in zip(*nodes))

    @staticmethod
    def _chosen(symbol: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs to be replaced now, with a number for each different pair."""
        first, second = symbol[:-1], symbol[1:]
        pairs = doc[:-1] == doc[1:]
        equal = np.flatnonzero(pairs & (first == second))
        if len(equal):  # of a stretch of one symbol, only every other pair can be replaced
            new = np.ones(len(equal), dtype=bool)
            new[1:] = np.diff(equal) > 1
            offset = equal - np.maximum.accumulate(np.where(new, equal, 0))
            pairs[equal[offset % 2 == 1]] = False
        places = np.flatnonzero(pairs)
        which, number, counts = recurring((first[places] << np.uint64(32)) | second[places])
        places = places[which]
        weight = np.zeros(len(symbol) + 1, dtype=np.int64)  # by place + 1
        weight[places + 1] = (counts[number] << 32) + number + 1
        top = (weight[places + 1] > weight[places]) & (weight[places + 1] > weight[np.minimum(places + 2, len(symbol))])
        places, number = places[top], number[top]
        again = np.bincount(number, minlength=len(counts)) > 1
        keep = again[number]
        return places[keep], (np.cumsum(again) - 1)[number[keep]]

    @staticmethod
    def _closed(begin: np.ndarray, end: np.ndarray, doc: np.ndarray, fresh: int) -> tuple[np.ndarray, ...]:
        """Balanced trees over the start strings; every node is a rule of its own."""
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, dtype=np.int64)
        size = np.diff(np.r_[first, len(doc)])
        out: list[tuple[np.ndarray, ...]] = []
        half = 1
        while len(size) and half < size.max():
            owner, k = ranges(-(-np.maximum(size - half, 0) // (2 * half)))
            a = first[owner] + 2 * half * k
            last = np.minimum(a + 2 * half, first[owner] + size[owner]) - 1
            out.append((begin[a], begin[a + half], end[last]))
            half *= 2
        if not out:
            return (np.empty(0, dtype=np.int64),) * 4
        b, m, e = (np.concatenate(c) for c in zip(*out))
        return fresh + np.arange(len(b)), b, m, e


def _candidates(begin, middle, end, group, occurrences, n) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, period) pairs: distances at which a window that touches the boundary recurs in the yield."""
    for low in range(0, len(begin), CHUNK // 8):
        part = slice(low, low + CHUNK // 8)
        b, m, e = begin[part], middle[part], end[part]
        node, offset = ranges(np.full(len(b), WINDOW + 1))
        at = m[node] - WINDOW + offset
        ok = (at >= b[node]) & (at + WINDOW <= e[node])
        node, at = node[ok], at[ok]
        ok = group[at] >= 0
        node, at = node[ok], at[ok]
        far = (e[node] - b[node]) // 2
        from_ = np.searchsorted(occurrences, group[at] * n + np.maximum(b[node], at - far))
        to = np.searchsorted(occurrences, group[at] * n + np.minimum(e[node] - WINDOW, at + far), side="right")
        total = np.cumsum(to - from_)
        begin_at = 0
        while begin_at < len(total):  # slices of about CHUNK pairs, one window at least
            done = total[begin_at - 1] if begin_at else 0
            stop = max(begin_at + 1, int(np.searchsorted(total, done + CHUNK)))
            owner, k = ranges((to - from_)[begin_at:stop])
            other = occurrences[from_[begin_at:stop][owner] + k] % n
            period = np.abs(other - at[begin_at:stop][owner])
            pairs = np.unique((node[begin_at:stop][owner] + low) * (n + 1) + period)
            pairs = pairs[pairs % (n + 1) > 0]
            yield pairs // (n + 1), pairs % (n + 1)
            begin_at = stop


def _crossing(prints: Fingerprints, begin, middle, end, period) -> tuple[np.ndarray, ...]:
    """(index, begin, end) of the stretches of the period that cross the boundary, as long as the yield lets them be."""
    found = []
    for anchor in (middle, middle - period):  # the repeated part touches the boundary, or lies a period before it
        ok = np.flatnonzero((anchor >= begin) & (anchor + period <= end))
        a, p = anchor[ok], period[ok]
        before = prints.backward(a, p, a - begin[ok])
        after = prints.forward(a, p, end[ok] - p - a)
        wide = before + after + p >= np.maximum(SHORTEST, 2 * p)
        found.append((ok[wide], (a - before)[wide], (a + after + p)[wide]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _smallest(begin: np.ndarray, end: np.ndarray, period: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal stretches (and equal further columns) the one of smallest period."""
    order = np.lexsort((period, end, begin, *more))
    columns = [c[order] for c in (begin, end, *more)]
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[order][new] for c in (begin, end, period, *more))


def _maximal(begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches that no other of the same period contains."""
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    if not len(order):
        return begin, end, period
    lift = (np.cumsum(np.r_[True, period[1:] != period[:-1]]) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    keep = np.r_[True, (end + lift)[1:] > reach[:-1]]
    return begin[keep], end[keep], period[keep]


def runs_of(symbols: np.ndarray, document: np.ndarray, attempt: int = 0) -> tuple[np.ndarray, ...]:
    """``begin, end, period`` of all runs of all documents, by begin and period.

    ``symbols``: numbers that no two documents share; ``document``: ascending.
    """
    n = len(symbols)
    nothing = (np.empty(0, dtype=np.int64),) * 3
    if n < SHORTEST:
        return nothing
    with np.errstate(over="ignore"):
        prints = Fingerprints(symbols, attempt)
        grammar = Grammar(symbols, document)
        places, number, _ = recurring(prints.windows(WINDOW))
        if not len(places):
            return nothing
        group = np.full(n, -1, dtype=np.int64)
        group[places] = number
        occurrences = np.sort(number * n + places)
        hopeful = np.zeros(int(document[-1]) + 1, dtype=bool)
        hopeful[document[places]] = True
        ok = np.flatnonzero(hopeful[document[grammar.begin]])
        ok = ok[np.argsort(grammar.rule[ok], kind="stable")]
        rule, begin, middle, end = (c[ok] for c in (grammar.rule, grammar.begin, grammar.middle, grammar.end))
        first = np.flatnonzero(np.r_[True, rule[1:] != rule[:-1]]) if len(rule) else np.empty(0, dtype=np.int64)
        uses = np.diff(np.r_[first, len(rule)])
        parts = []
        for node, period in _candidates(begin[first], middle[first], end[first], group, occurrences, n):
            at = first[node]
            index, b, e = _crossing(prints, begin[at], middle[at], end[at], period)
            b, e, p, node = _smallest(b, e, period[index], node[index])
            owner, k = ranges(uses[node])  # to all derivation positions
            moved = begin[first[node][owner] + k] - begin[first[node][owner]]
            parts.append((b[owner] + moved, e[owner] + moved, p[owner]))
        if not parts:
            return nothing
        b, e, p = _smallest(*_maximal(*(np.concatenate(c) for c in zip(*parts))))
    last = np.r_[np.flatnonzero(document[1:] != document[:-1]) + 1, n]
    stop = last[np.searchsorted(last, b, side="right")] if len(b) else b
    for i in range(len(b)):
        inside = np.array_equal(symbols[b[i] : e[i] - p[i]], symbols[b[i] + p[i] : e[i]])
        if not inside or (b[i] and symbols[b[i] - 1] == symbols[b[i] - 1 + p[i]]) or (e[i] < stop[i] and symbols[e[i]] == symbols[e[i] - p[i]]):
            return runs_of(symbols, document, attempt + 1)  # a fingerprint misled
    order = np.lexsort((p, b))
    return b[order], e[order], p[order]


def _numbered(rows: list[tuple[int | None, bytes | None]], places: Places | None) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each row, and for all rows one number per word (equal where the words are) and the row."""
    words_of: list[list[bytes]] = []
    numbers: list[np.ndarray] = []
    base = 0
    for doc, text in rows:
        words = text.split() if text else []
        moved = places(doc, len(words)) if places and words else None
        if moved is not None:
            words = [words[i] for i in moved.tolist()]
        known = dict(zip(dict.fromkeys(words), count(base)))
        base += len(known)
        numbers.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        words_of.append(words)
    row = np.repeat(np.arange(len(rows)), [len(w) for w in words_of])
    return words_of, np.concatenate(numbers) if numbers else np.empty(0, dtype=np.int64), row


def find_runs(docs: DataFrame, places: Places | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all runs by start and period, and the text without repetitions.

    ``collapsed`` are the words, joined by one space, that no run contains
    after its first period.  ``places`` may give words to read instead.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches):
            ids = batch.column("doc_id").to_pylist()
            words_of, symbols, row = _numbered(list(zip(ids, byte_texts(batch))), places)
            begin, end, period = runs_of(symbols, row)
            sizes = np.array([len(w) for w in words_of], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            edges = np.zeros(len(symbols) + 1, dtype=np.int64)
            np.add.at(edges, begin + period, 1)
            np.add.at(edges, end, -1)
            kept = np.cumsum(edges)[:-1] == 0
            of_row = row[begin] if len(begin) else begin
            per_row = np.bincount(of_row, minlength=len(ids))
            collapsed = []
            for i, words in enumerate(words_of):
                if per_row[i]:
                    words = [words[j] for j in np.flatnonzero(kept[starts[i] : starts[i] + sizes[i]]).tolist()]
                collapsed.append(b" ".join(words))
            flat = pa.StructArray.from_arrays(
                [pa.array(c, pa.int64()) for c in (begin - starts[of_row], end - begin, period)], fields=list(run_type)
            )
            offsets = pa.array(np.r_[0, np.cumsum(per_row)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(offsets, flat), pa.array(collapsed, pa.binary())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return texts(docs).mapInArrow(scan, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
