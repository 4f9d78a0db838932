"""License scans by template markup.

A template is a license's wording with two kinds of marked regions, the way
public license lists mark them: ``<<optional>> ... <<end>>`` may be left out,
``<<var:least:most>>`` stands for any words, ``least`` to ``most`` of them.
Everything else is mandatory and must match word by word.  A template is
compiled into an automaton over words; running it from a place where its first
mandatory word stands keeps the set of states that are alive, so a text is
read once per start whatever the regions hold.

Base phrases (plain word sequences with a label) are counted at every place;
templates add labels of their own.

Defined cases: null texts count as empty and have no word.  Overlapping
places count each.  Repeated rows are scanned like any other.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_texts, pieces_of, texts

#: Word bytes: digits, letters (A-Z become a-z) and everything from 0x80; the rest are spaces.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

# fixed values: phrases and their labels
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# fixed values: wording of public licenses, with regions marked
TEMPLATES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "<<optional>> and associated documentation files the software <<end>> to deal in the software without restriction",
    "mit-reference": "released under the <<optional>> terms of the <<end>> mit license",
    "apache-2-notice": "licensed under the apache license version 2 0 <<optional>> the license <<end>>",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted "
    "<<optional>> subject to the limitations in the disclaimer below <<end>> provided that the following conditions are met",
    "isc-notice": "permission to use copy modify <<optional>> and or <<end>> <<optional>> and <<end>> distribute this software "
    "for any purpose with or without fee is hereby granted",
    "gpl-3": "<<optional>> this <<var:1:4>> is <<end>> licensed under the gnu general public license <<var:0:3>> version 3",
    "gpl-3-notice": "under the terms of the gnu general public license as published by the free software foundation "
    "<<optional>> either <<end>> version 3",
    "lgpl": "gnu lesser general public license",
    "mpl-2": "mozilla public license <<optional>> v <<end>> <<optional>> version <<end>> 2 0",
    "cc-by-nc-4": "licensed under <<optional>> a <<end>> cc by nc <<optional>> <<var:0:2>> <<end>> 4 0",
    "cc-by-4": "licensed under <<optional>> a <<end>> cc by 4 0",
    "cc-statement": "licensed under a creative commons attribution <<var:0:6>> 4 0 international license",
    "all-rights-reserved": "all rights reserved",
}


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Word automaton of one template: ``steps[state]`` are (word or None for any, next state) pairs."""

    def __init__(self, label: str, template: str):
        self.label = label
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        state, opened = 0, []
        for part in re.findall(r"<<.*?>>|[^<>\s]+", template):
            if part == "<<optional>>":
                opened.append(state)
            elif part == "<<end>>":
                self.skips[opened.pop()].append(state)
            elif part.startswith("<<var"):
                least, most = map(int, part[2:-2].split(":")[1:])
                first = state
                begins = [state]
                for _ in range(most):
                    state = self._step(state, None)
                    begins.append(state)
                for begin in begins[least:-1]:
                    self.skips[begin].append(state)
                if most == 0:
                    state = first
            else:
                state = self._step(state, part.encode())
        if opened:
            raise ValueError(f"template {label}: optional region without end")
        self.end = state
        self.closed = [self._reach(s) for s in range(len(self.steps))]
        self.first = {word for s in self.closed[0] for word, _ in self.steps[s]}
        if None in self.first or self.end in self.closed[0]:
            raise ValueError(f"template {label} must begin with a word")

    def _step(self, state: int, word: bytes | None) -> int:
        self.steps.append([])
        self.skips.append([])
        self.steps[state].append((word, len(self.steps) - 1))
        return len(self.steps) - 1

    def _reach(self, state: int) -> frozenset[int]:
        seen, todo = set(), [state]
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo.extend(self.skips[s])
        return frozenset(seen)

    def match(self, words: list[bytes], begin: int) -> int | None:
        """End of the shortest match that begins here."""
        alive = self.closed[0]
        for at in range(begin, len(words)):
            word = words[at]
            alive = frozenset().union(*(self.closed[n] for s in alive for w, n in self.steps[s] if w is None or w == word))
            if self.end in alive:
                return at + 1
            if not alive:
                return None
        return None


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.automata = [Automaton(label, t) for label, t in templates.items()]
        self.begins: dict[bytes, list[Automaton]] = {}
        for automaton in self.automata:
            for word in automaton.first:
                self.begins.setdefault(word, []).append(automaton)
        needed = [max(set(p), key=len) for p, _ in self.phrases]
        needed += [self._anchor(a) for a in self.automata]
        self.anchors = re.compile(b"|".join(re.escape(w) for w in sorted(set(needed))))

    @staticmethod
    def _anchor(automaton: Automaton) -> bytes:
        """The longest word that every accepted text holds."""
        words = {w for steps in automaton.steps for w, _ in steps if w}
        def needed(word):
            todo, seen = set(automaton.closed[0]), set()
            while todo:
                s = todo.pop()
                seen.add(s)
                todo |= {r for w, n in automaton.steps[s] if w != word for r in automaton.closed[n]} - seen
            return automaton.end not in seen
        return max((w for w in words if needed(w)), key=len)

    def scan(self, text: bytes | None):
        """``(n_words, [(label, start)] of phrases, [(label, start, end)] of templates)``."""
        folded = text.translate(_FOLD) if text else b""
        words = folded.split()
        base: list[tuple[str, int]] = []
        found: list[tuple[str, int, int]] = []
        if not self.anchors.search(folded):
            return len(words), base, found
        places: dict[bytes, list[int]] = {}
        for i, word in enumerate(words):
            places.setdefault(word, []).append(i)
        for phrase, label in self.phrases:
            base += [(label, i) for i in places.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]
        for word, automata in self.begins.items():
            for i in places.get(word, ()):
                for automaton in automata:
                    end = automaton.match(words, i)
                    if end is not None:
                        found.append((automaton.label, i, end))
        return len(words), base, found


MATCHES = "doc_id long, n_words long, base array<struct<label:string,start:long>>, matches array<struct<label:string,start:long,end:long>>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, base, matches``: every place of every phrase and template."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])),
             pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in pieces_of(batches):
            out: list[list] = [[], [], []]
            for text in byte_texts(batch):
                n, base, found = scanner.scan(text)
                out[0].append(n)
                out[1].append([{"label": label, "start": i} for label, i in base])
                out[2].append([{"label": label, "start": i, "end": e} for label, i, e in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds[1:]))], ["doc_id", "n_words", "base", "matches"]
            )

    return texts(docs).mapInArrow(run, MATCHES)
