"""Edit-aware token counts.

A document is cut into leaves at places that are pre-token boundaries whatever
stands before them (a space before a visible character).  The numbers of
characters and of tokens of the leaves are kept in two segment trees (arrays
in heap order: node ``i`` holds the sum of ``2 i`` and ``2 i + 1``).

An edit replaces a stretch of characters.  The tree of character counts finds
the touched leaves; they and, where the edit meets a leaf's first two
characters, the leaf before are encoded again, once for all edits that meet
there; the sums above them are updated.  Nothing else is encoded.  A leaf that edits have grown far beyond the
usual size makes its document be indexed anew.

Defined cases: a null or empty text has one empty leaf and no token.  Edits
are given in characters of the text before all of them; they must not
overlap, and edits past the end are cut to it.  Edits with null ends or null
``doc_id`` are ignored, a null replacement is empty.  Repeated rows of an id
get the same edits each.  Bytes that are no UTF-8 count as U+FFFD.  Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, pieces_of, texts
from .packing import ByteTokens, public_file

LEAF_CHARACTERS = 256
GROWN = 16  # a leaf this many times the usual size makes the document be indexed anew

Edit = tuple[int, int, str]


def coder_at(json_path: str | None = None, ranks_path: str | None = None) -> ByteTokens:
    return ByteTokens(json_path or public_file("byte_bpe_50k.json"), ranks_path or public_file("byte_bpe_50k.tiktoken"))


def leaves_of(text: str, size: int = LEAF_CHARACTERS) -> list[int]:
    """Characters of each leaf."""
    begin, out = 0, []
    while True:
        cut = text.find(" ", begin + size)
        while cut != -1 and (cut + 1 >= len(text) or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1 or ByteTokens.SPECIAL in text:
            out.append(len(text) - begin)
            return out
        out.append(cut - begin)
        begin = cut


def build(values: list[int]) -> list[int]:
    """Segment tree in heap order, leaves in the second half."""
    n = len(values)
    tree = [0] * n + values
    for i in range(n - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def padded(values: list[int]) -> list[int]:
    """A power of two of leaves, so that heap order is text order."""
    return values + [0] * ((1 << (len(values) - 1).bit_length()) - len(values))


def put(tree: list[int], leaf: int, value: int) -> int:
    """Set a leaf and the sums above it; returns the number of nodes touched."""
    i = leaf + len(tree) // 2
    change, touched = value - tree[i], 0
    while i:
        tree[i] += change
        touched += 1
        i //= 2
    return touched


def find(tree: list[int], offset: int) -> tuple[int, int]:
    """Leaf that holds a character, and the leaf's first character."""
    half, i, begin = len(tree) // 2, 1, 0
    while i < half:
        i *= 2
        if offset >= begin + tree[i]:
            begin += tree[i]
            i += 1
    return i - half, begin


class Counted:
    """A text with its trees; ``edit`` keeps them true."""

    def __init__(self, text: str, coder: ByteTokens, characters: list[int] | None = None, tokens: list[int] | None = None):
        self.text, self.coder = text, coder
        self.reencoded = self.touched = 0
        if characters is None or tokens is None:
            self._index()
        else:
            self.characters, self.tokens = list(characters), list(tokens)

    def _count(self, part: str) -> int:
        return len(self.coder.encode(part)) // 4

    def _index(self) -> None:
        lengths, begin, counts = leaves_of(self.text), 0, []
        for n in lengths:
            counts.append(self._count(self.text[begin : begin + n]))
            begin += n
        self.characters, self.tokens = build(padded(lengths)), build(padded(counts))

    @property
    def total(self) -> int:
        return self.tokens[1]

    def edit(self, edits: list[Edit]) -> None:
        """Edits in characters of the present text; edits that meet the same leaves are encoded together."""
        if not edits:
            return
        size, half = len(self.text), len(self.characters) // 2
        special = any(ByteTokens.SPECIAL in new for _, _, new in edits) or ByteTokens.SPECIAL in self.text
        groups: list[list] = []  # first leaf, its first character, last leaf, end of its characters, edits
        for begin, end, new in sorted(edits):
            begin = max(0, min(begin, size))
            end = max(begin, min(end, size))
            first, at, last, stop = (0, 0, half - 1, size) if special or not size else self._leaves(begin, end)
            if groups and first <= groups[-1][2]:
                if last > groups[-1][2]:
                    groups[-1][2:4] = [last, stop]
                groups[-1][4].append((begin, end, new))
            else:
                groups.append([first, at, last, stop, [(begin, end, new)]])
        for group in reversed(groups):  # places before a group stay true
            self._replace(*group)

    def _leaves(self, begin: int, end: int) -> tuple[int, int, int, int]:
        """The leaves to encode again: a cut stays safe while its space and the character after it stay."""
        first, at = find(self.characters, max(0, min(begin, len(self.text) - 1)))
        while first and begin <= at + 1:
            first, at = find(self.characters, at - 1)
        last, last_at = find(self.characters, max(at, end - 1))
        return first, at, last, last_at + self.characters[len(self.characters) // 2 + last]

    def _replace(self, first: int, at: int, last: int, stop: int, edits: list[Edit]) -> None:
        half, parts, place = len(self.characters) // 2, [], at
        for begin, end, new in edits:
            parts += [self.text[place:begin], new]
            place = max(place, end)
        part = "".join([*parts, self.text[place:stop]])
        whole = len(part) == len(self.text) - (stop - at) + len(part)
        self.text = self.text[:at] + part + self.text[stop:]
        if len(part) > GROWN * LEAF_CHARACTERS * (last - first + 1) or ByteTokens.SPECIAL in part and not whole:
            self._index()
            self.reencoded += len(self.text)
            return
        self.reencoded += len(part)
        self.touched += put(self.characters, first, len(part)) + put(self.tokens, first, self._count(part))
        for leaf in range(first + 1, last + 1):
            if self.characters[half + leaf] or self.tokens[half + leaf]:
                self.touched += put(self.characters, leaf, 0) + put(self.tokens, leaf, 0)


INDEX = "doc_id long, text string, n_tokens long, characters array<int>, tokens array<int>"
EDITED = INDEX + ", n_before long, n_edits long, n_reencoded long, n_touched long"
_TREE = pa.list_(pa.int32())


def token_index(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """``doc_id, text, n_tokens, characters, tokens``: the text with its two trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_at(json_path, ranks_path)
        for batch in pieces_of(batches):
            own = [Counted((t or b"").decode(errors="replace"), coder) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array([c.total for c in own], pa.int64()),
                 pa.array([c.characters for c in own], _TREE), pa.array([c.tokens for c in own], _TREE)],
                ["doc_id", "text", "n_tokens", "characters", "tokens"],
            )

    return texts(docs).mapInArrow(run, INDEX)


def _edited(frame: DataFrame, edits_of: Callable[[pa.RecordBatch, int, str], list[Edit]], json_path, ranks_path) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_at(json_path, ranks_path)
        for batch in pieces_of(batches):
            indexed = "characters" in batch.schema.names
            trees = [batch.column(c).to_pylist() for c in ("characters", "tokens")] if indexed else None
            own, edits, before = [], [], []
            for i, t in enumerate(byte_texts(batch)):
                counted = Counted((t or b"").decode(errors="replace"), coder, *((trees[0][i], trees[1][i]) if trees else ()))
                before.append(counted.total)
                edits.append(edits_of(batch, i, counted.text))
                counted.edit(edits[-1])
                own.append(counted)
            columns = [
                batch.column("doc_id"), pa.array([c.text for c in own], pa.string()), pa.array([c.total for c in own], pa.int64()),
                pa.array([c.characters for c in own], _TREE), pa.array([c.tokens for c in own], _TREE),
                *(pa.array(v, pa.int64()) for v in (before, [len(e) for e in edits], [c.reencoded for c in own], [c.touched for c in own])),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "text", "n_tokens", "characters", "tokens", "n_before", "n_edits", "n_reencoded", "n_touched"]
            )

    return frame.mapInArrow(run, EDITED)


def apply_edits(index: DataFrame, edits: DataFrame, json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The index after ``edits`` (``doc_id, begin, end, replacement``), with counts of the work done."""
    own = edits.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.struct(F.col("begin").cast("long").alias("b"), F.col("end").cast("long").alias("e"),
                 F.coalesce(F.col("replacement").cast("string"), F.lit("")).alias("r")).alias("edit"),
    ).where("doc_id IS NOT NULL AND edit.b IS NOT NULL AND edit.e IS NOT NULL")
    gathered = own.groupBy("doc_id").agg(F.collect_list("edit").alias("edits"))  # as many as the document has edits
    joined = index.join(gathered, "doc_id", "left").select("doc_id", "text", "n_tokens", "characters", "tokens", "edits")

    def given(batch: pa.RecordBatch, i: int, text: str) -> list[Edit]:
        return [(e["b"], e["e"], e["r"]) for e in batch.column("edits")[i].as_py() or ()]

    return _edited(joined, given, json_path, ranks_path)


#: An address becomes a mark, a run of one punctuation sign becomes one sign.
NOISE = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+|([^\w\s])\1+")


def cleaning_edits(text: str) -> list[Edit]:
    """The edits a cleaning pass makes: mask addresses, shorten runs of a sign."""
    return [(m.start(), m.end(), m[1] or "<address>") for m in NOISE.finditer(text)]


def recount_cleaned(frame: DataFrame, edits_of: Callable[[str], list[Edit]] = cleaning_edits, json_path: str | None = None,
                    ranks_path: str | None = None) -> DataFrame:
    """The index after the edits that ``edits_of`` makes of each text, without a join.

    ``frame`` is an index, or documents, which the same tasks index first.
    """
    frame = frame if "characters" in frame.columns else texts(frame)
    return _edited(frame, lambda batch, i, text: edits_of(text), json_path, ranks_path)
