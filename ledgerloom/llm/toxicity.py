"""Toxicity through a noisy channel.

Words may be written with look-alike signs (``1d10t``), repeated letters
(``idiooot``), signs between letters (``i.d.i.o.t``) or spaces inside
(``i d i o t``, ``id iot``).  Each such word is a lattice of readings; a
Viterbi search finds the reading with the least cost under a character
language model and the channel's costs.  In a run of words of at most
``SHORT`` letters every blank is kept or dropped by the same search, which
so finds the words' boundaries; the words it joins are scored beside those
that were written.  Words with a single reading are taken as they are, and
words and runs are decoded once per task.  Words without a letter stay.

The restored words are scored by a learnt lexicon of words and word
beginnings: their log odds of standing in a toxic document, of which only
those that are clearly above zero count.  The strongest word, the number of
telling words and their sum make the document's score in a small logistic
regression.

The language model counts all texts given to ``train``.  Lexicon and
regression use at most ``SAMPLE`` labelled rows, one half for each, so the
regression sees the lexicon as new texts will.

Defined cases: null and empty texts have no word and get the score of a text
without telling words.  Null labels and ids are never learnt from.  Without
labels the score is a half; with one label only, nearly that label.  Repeated
rows score alike.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, pieces_of, split_words
from .language import _START, byte_counts, code_lengths, context_counts, symbol_map, UNIT
from .quality import labelled

SAMPLE = 20_000
ORDER = 2
SYMBOLS = 64
BEGINNINGS = (4, 5, 6, 7)  # characters
LEAST_DOCUMENTS = 4
CLEARLY = 0.8  # log odds, two standard errors below the estimate
CHANGE_BITS = 1.0  # the channel's cost of a look-alike sign read as its letter
LITERAL_BITS = 6.0  # of a look-alike sign inside a word that stays itself
DROP_BITS = 0.5  # of a repeated letter or a separator that is dropped

# fixed values: letters that a sign may stand for
LOOK_ALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = ".-_*~'"
SHORT = 3  # letters of a word that a blank may have been put into
_EDGES = "\"#%&'),-./:;<=>?[\\]^_`{}~*"
_EDGE_BYTES = _EDGES.encode()


class CharacterModel:
    """Bits of a character after two others, over letters and a word's edge."""

    def __init__(self, symbols: np.ndarray, base: int, codes: np.ndarray, n: np.ndarray):
        self.symbols, self.base = symbols, base
        self.bits = code_lengths(codes, n, base, ORDER).astype(np.float64) * UNIT
        self.known = Cache(self._cost)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known = Cache(self._cost)

    def cost(self, state: int, character: str) -> tuple[int, float]:
        """The state after a character and its cost; a state is the last two symbols."""
        return self.known[state, character]

    def _cost(self, key: tuple[int, str]) -> tuple[int, float]:
        state, character = key
        total = 0.0
        for byte in character.encode():
            symbol = int(self.symbols[byte])
            total += float(self.bits[state * self.base + symbol])
            state = state * self.base % self.base**ORDER + symbol
        return state, total


def train_characters(docs: DataFrame) -> CharacterModel:
    """Counts over every text given, added up by Spark."""
    rows = docs.select(F.lit("").alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    symbols = symbol_map({r["byte"]: r["n"] for r in byte_counts(rows).collect()}, SYMBOLS)
    base = int(symbols.max()) + 1
    # at most base ** 3 sums
    got = context_counts(rows, [""], symbols, base, ORDER).toArrow()
    return CharacterModel(symbols, base, got.column("code").to_numpy(), got.column("n").to_numpy())


def readings(word: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each place the readings (text, cost)."""
    out: list[list[tuple[str, float]]] = []
    i, spelled = 0, len(word) > 4 and " " not in word and all(not c.isalpha() for c in word[1::2]) and any(c in SEPARATORS for c in word[1::2])
    while i < len(word):
        c, end = word[i], i + 1
        while end < len(word) and word[end] == c:
            end += 1
        run = end - i
        if c == " ":
            once = [(" ", 0.0), ("", DROP_BITS)]
        elif c in LOOK_ALIKES:
            once = [(letter, CHANGE_BITS) for letter in LOOK_ALIKES[c]] + [(c, LITERAL_BITS)]
        elif c in SEPARATORS:
            once = [("", DROP_BITS)] + ([] if spelled else [(c, 0.0)])
        else:
            once = [(c, 0.0)]
        out.append(once)
        for again in range(1, run):  # the second letter may be meant, further ones rarely are
            out.append([("", DROP_BITS), *[(t, b + (0.0 if again == 1 else 4.0)) for t, b in once if t]])
        i = end
    return out


def decode(word: str, model: CharacterModel) -> str:
    """The cheapest reading."""
    paths: dict[int, tuple[float, tuple]] = {_START: (0.0, ())}  # a text is a chain of its last piece and what was before
    for options in readings(word):
        after: dict[int, tuple[float, tuple]] = {}
        for state, (bits, text) in paths.items():
            for piece, channel in options:
                then, own = model.cost(state, piece) if piece else (state, 0.0)
                total = bits + channel + own
                if then not in after or total < after[then][0]:
                    after[then] = (total, (text, piece) if piece else text)
        paths = after

    def spelled_out(text: tuple) -> str:
        out = []
        while text:
            text, piece = text
            out.append(piece)
        return "".join(reversed(out))

    return min((bits + model.cost(state, " ")[1], spelled_out(text)) for state, (bits, text) in paths.items())[1]


_PLAIN = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"(.)\1\1")
_THRICE_BYTES = re.compile(rb"(.)\1\1")
_TWICE = re.compile(r"(.)\1")
_LONGER = re.compile(r"(.)\1{3,}")
_EMPHASIS = re.compile(r"([^\w])\1+$")


def trimmed(word: str) -> str:
    """Without signs at the edges; a run of one sign at the end is emphasis, a single ``!`` too."""
    word = word.strip(_EDGES)
    if not word[-1:].isalnum():
        word = _EMPHASIS.sub("", word).rstrip("!" + _EDGES)
    return word.lstrip("(|+" + _EDGES) if word[:1] in "(|+" else word


def restored(word: bytes, model: CharacterModel) -> str:
    """A word as it was meant."""
    text = trimmed(word.decode(errors="replace").lower())
    if _PLAIN.fullmatch(text) and not _THRICE.search(text):
        return text
    if not any(c.isalpha() for c in text):
        return text  # numbers
    return decode(_LONGER.sub(r"\1\1\1", text), model)


def short_word(word: bytes) -> str | None:
    """A word that may be part of another, without signs at its edges; None for longer words."""
    if len(word) > 16:
        return None
    plain = word.strip(_EDGE_BYTES)
    if plain.isalpha():  # of a-z only
        return plain.decode() if len(plain) <= SHORT else None
    text = trimmed(word.decode(errors="replace").lower()) or word.decode(errors="replace").lower().strip("".join(set(_EDGES) - set(LOOK_ALIKES)))
    return text if len(text) <= SHORT else None


def short_runs(words: list[bytes], short: dict[bytes, str | None]) -> set[str]:
    """Runs of at least two short words that hold a letter, with single blanks."""
    out: set[str] = set()
    run: list[str] = []
    for word in words:
        text = None if len(word) > SHORT and word.isalpha() else short[word]
        if text is not None:
            if text:
                run.append(text)
            continue
        if len(run) > 1:
            out.add(" ".join(run))
        run = []
    if len(run) > 1:
        out.add(" ".join(run))
    return {r for r in out if any(map(str.isalpha, r))}


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


class Cache(dict):
    """word -> anything; starts again at ``limit`` words."""

    def __init__(self, read, limit: int = 100_000):
        super().__init__()
        self.read, self.limit = read, limit

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.read(word)
        return value


class Scorer:
    def __init__(self, characters: CharacterModel, lexicon: dict[str, float], weights: np.ndarray):
        self.characters, self.lexicon, self.weights = characters, lexicon, weights
        self._start()

    def _start(self) -> None:
        self.short, self.runs = Cache(short_word), Cache(self.joined)
        self.longest = max(map(len, self.lexicon), default=0)
        # what a word must be, or begin with, to have a weight; and all that such words can begin with
        self.whole = {f[1:] for f in self.lexicon if f[0] == "="}
        self.starts = {f[1 : 1 + BEGINNINGS[0]] for f in self.lexicon if f[0] == "^"}
        self.whole_bytes, self.start_bytes = ({t.encode() for t in texts} for texts in (self.whole, self.starts))
        self.openings = {f[1:n] for f in self.lexicon for n in range(2, len(f) + 1)}

    def __getstate__(self):
        return {"characters": self.characters, "lexicon": self.lexicon, "weights": self.weights}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def may_tell(self, words: list[str]) -> bool:
        """Whether a reading of the run can have a weight: sure for plain words, whose only other readings are joined ones."""
        if not all(_PLAIN.fullmatch(w) and not _TWICE.search(w) for w in words):
            return True
        for i, text in enumerate(words):
            for more in words[i + 1 :]:
                text += more
                if self.tells(text):
                    return True
                if len(text) >= self.longest or (text not in self.openings and text[: BEGINNINGS[0]] not in self.starts):
                    break
        return False

    def joined(self, run: str) -> list[float]:
        """Weights of the words that are in the decoded run but not in the written one."""
        if not self.may_tell(run.split(" ")):
            return []
        words = set(decode(_LONGER.sub(r"\1\1\1", run), self.characters).split(" ")) - set(run.split(" "))
        return [self.strongest(w) for w in words if w]

    def tells(self, word: str) -> bool:
        """Whether the word has a weight."""
        return word in self.whole or (word[: BEGINNINGS[0]] in self.starts and any(f in self.lexicon for f in word_features(word)))

    def strongest(self, word: str) -> float:
        """The weight of a word's strongest feature."""
        return max(self.lexicon.get(f, 0.0) for f in word_features(word)) if self.tells(word) else 0.0

    def weight(self, word: bytes) -> float:
        """The strongest feature of the restored word; most words of a-z, which stay as they are, are told by their first bytes to have none."""
        plain = word.strip(_EDGE_BYTES)
        if plain.isalpha() and plain not in self.whole_bytes and plain[: BEGINNINGS[0]] not in self.start_bytes and not _THRICE_BYTES.search(plain):
            return 0.0
        return self.strongest(restored(word, self.characters))

    def evidence(self, text: bytes | None, known: Cache) -> np.ndarray:
        written = split_words(text)
        words = set(written)
        found = list(map(known.__getitem__, words))
        for run in short_runs(written, self.short):
            found += self.runs[run] if len(run) < 200 else self.joined(run)
        telling = sorted((w for w in found if w > 0), reverse=True)
        strongest, total = (telling[0], sum(telling)) if telling else (0.0, 0.0)
        return np.array([1.0, strongest, np.log1p(len(telling)), np.log1p(total), total / np.sqrt(len(words) + 1.0)])

    def score(self, text: bytes | None, known: Cache) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.evidence(text, known) @ self.weights, -40, 40))))


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Log odds of the features that are clearly more frequent in toxic documents."""
    out = {}
    for feature, t, o in counts:
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((o + 0.5) / (other + 1))
        spread = np.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
        if t >= LEAST_DOCUMENTS and odds - 2 * spread > CLEARLY:
            out[feature] = float(odds - spread)
    return out


def logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Newton steps with a small ridge."""
    weights = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
        slope = rows.T @ (p - labels) + ridge * weights
        curve = (rows * (p * (1 - p) + 1e-9)[:, None]).T @ rows + ridge * np.eye(rows.shape[1])
        step = np.linalg.solve(curve, slope)
        weights -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Scorer:
    """``docs`` to count characters of, ``labels`` (``doc_id, toxic``) to learn from."""
    spark = docs.sparkSession
    characters = train_characters(docs)
    sample = labelled(docs, labels, "toxic", rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)))
    shipped = spark.sparkContext.broadcast(characters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        features = Cache(lambda w: word_features(restored(w, model)))
        for batch in pieces_of(batches):
            seen: dict[str, list[int]] = {}
            for label, text in zip(batch.column("label").to_pylist(), byte_texts(batch)):
                own = {f for word in set(split_words(text)) for f in features[word]}
                for f in own:
                    seen.setdefault(f, [0, 0])[0 if label else 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))],
                ["feature", "toxic", "other"],
            )

    totals = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    counted = sample.where("half = 0").select("label", "text").mapInArrow(count, "feature string, toxic long, other long")
    summed = counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    frequent = summed.where(F.col("toxic") >= LEAST_DOCUMENTS).where("other < toxic * 20").collect()  # of at most `rows` texts
    lexicon = lexicon_of([(r["feature"], r["toxic"], r["other"]) for r in frequent], totals.get((0, 1), 0), totals.get((0, 0), 0))
    scorer = Scorer(characters, lexicon, np.zeros(5))
    again = spark.sparkContext.broadcast(scorer)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = again.value
        known = Cache(own.weight)
        for batch in pieces_of(batches):
            found = [own.evidence(t, known).tolist() for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "row"]
            )

    got = sample.where("half = 1").select("doc_id", "label", "text").mapInArrow(evidence, "doc_id long, label int, row array<double>").collect()
    if got:
        got.sort(key=lambda r: r["doc_id"])
        scorer.weights = logistic(np.array([r["row"] for r in got]), np.array([r["label"] for r in got], dtype=float))
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score`` of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        known = Cache(own.weight)
        for batch in pieces_of(batches):
            found = [own.score(t, known) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )
