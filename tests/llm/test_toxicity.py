import pytest

from ledgerloom.llm import toxicity
from ledgerloom.llm.queries import QUERIES
from tests.llm.samples import awkward, empty

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def label(spark):
    return {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}


def test_held_out_accuracy(spark, label):
    rows = QUERIES["op6_toxicity"](spark, FOLDER).collect()
    held = [r for r in rows if r.held_out and label.get(r.doc_id) is not None]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def english(spark):
    text = "the idiot and the moron are stupid people with a trash idea of a house in the middle of nowhere good letters"
    return toxicity.train_characters(spark.createDataFrame([(text,)] * 5, "text string"))


@pytest.mark.parametrize("written, meant", [
    (b"1d10t", "idiot"), (b"m0r0n!!", "moron"), (b"g00d", "good"), (b"tr@$h", "trash"), (b"idiooooot", "idiot"), (b"i.d.i.o.t", "idiot"),
    (b"good", "good"), (b"idiot***", "idiot"), (b"letters.", "letters"), (b"12345", "12345"), (b"", ""), (b"\xff\xfe", ""),
])
def test_decoding(spark, written, meant):
    assert toxicity.restored(written, english(spark)) == meant


def test_spaced_letters_are_read(spark):
    scorer = toxicity.Scorer(english(spark), {"=idiot": 3.0}, toxicity.np.ones(5))
    plain = scorer.evidence(b"some words here", toxicity.Cache(scorer.weight))
    spaced = scorer.evidence(b"you are an i d i o t indeed", toxicity.Cache(scorer.weight))
    assert plain[1] == 0 and spaced[1] == 3.0


def test_viterbi_is_the_best_of_all_readings(spark):
    import itertools

    model = english(spark)
    for word in ("1d10t", "h0uu5e", "l3tt3r"):
        best = None
        for path in itertools.product(*toxicity.readings(word)):
            state, bits = 0, 0.0
            for piece, channel in path:
                bits += channel
                if piece:
                    state, own = model.cost(state, piece)
                    bits += own
            bits += model.cost(state, " ")[1]
            text = "".join(p for p, _ in path)
            best = min(best or (bits, text), (bits, text))
        assert toxicity.decode(word, model) == best[1]


def test_awkward(spark):
    frame, rows = awkward(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4, 12)] + [(None, 1), (1, None), (4, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame, toxicity.train(frame, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.train(frame, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(frame, none).collect()} == {0.5}
    assert toxicity.score_toxicity(empty(spark), toxicity.train(empty(spark), labels)).collect() == []


@pytest.mark.parametrize("text, word", [
    ("you are such a s t u p i d", "stupid"), ("y o u i d i o t", "idiot"), ("id iot", "idiot"), ("i. d. i. o. t.", "idiot"),
    ("what p o o p here", "poop"), ("s\tt\nu p i d", "stupid"), ("mon ami d é b i l e", "débile"), ("1 d 1 0 t", "idiot"),
    ("idi" + "o" * 90 + "t", "idiot"),
])
def test_blanks_inside_words(spark, text, word):
    rows = ["you idiot such a stupid you are a poop here and débile mon ami what an idiot"] * 5
    model = toxicity.train_characters(spark.createDataFrame([(r,) for r in rows], "text string"))
    scorer = toxicity.Scorer(model, {"=" + word: 3.0}, toxicity.np.ones(5))
    assert scorer.evidence(text.encode(), toxicity.Cache(scorer.weight))[1] == 3.0


def test_runs_passed_over_have_no_weight(spark):
    import random

    rng = random.Random(2)
    scorer = toxicity.Scorer(english(spark), {"=idiot": 3.0, "^moro": 2.0, "=trash": 1.0}, toxicity.np.ones(5))
    told = 0
    for _ in range(300):
        run = " ".join(rng.choices(["i", "d", "id", "iot", "mo", "ron", "r", "o", "the", "tra", "sh", "a", "1d", "of"], k=rng.randrange(2, 7)))
        words = set(toxicity.decode(run, scorer.characters).split(" ")) - set(run.split(" "))
        whole = [max((scorer.lexicon.get(f, 0.0) for f in toxicity.word_features(w)), default=0.0) for w in words if w]
        assert sum(scorer.joined(run)) == sum(whole)
        told += sum(whole) > 0
    assert told


def test_plain_words_without_weight_are_not_read(spark, monkeypatch):
    """The first bytes of a word of a-z tell that it has no weight; every other word gets what its restored form has."""
    scorer = toxicity.Scorer(english(spark), {"=idiot": 3.0, "^moro": 2.0, "^trashy": 1.0, "=a": 0.5}, toxicity.np.ones(5))
    restored, read = toxicity.restored, []
    monkeypatch.setattr(toxicity, "restored", lambda word, model: read.append(word) or restored(word, model))
    plain = [b"house", b"'house,", b"letters.", b"id", b"good"]
    assert [scorer.weight(w) for w in plain] == [0.0] * len(plain) and not read
    told = 0
    words = [b"idiot", b"idiots", b"moron!!", b"morose", b"trashes", b"trashyest", b"a", b"iddiot", b"idiiiot", b"1d10t", b"i.d.i.o.t", b"moroon", b"mooooron",
             b"\xc3\xa9idiot", b"\xff", b"...", b"", b"tr@shy", b"(moron)", b"'a'", b"12345", b"moro_n"]
    for word in plain + words:
        want = max(scorer.lexicon.get(f, 0.0) for f in toxicity.word_features(restored(word, scorer.characters)))
        assert scorer.weight(word) == want
        told += want > 0
    assert told > 8


def test_short_words_as_trimmed(spark):
    for word in (b"id", b"iot", b"(id)", b"idio", b"idiot.", b"1d1", b"!!!", b"\xc3\xa9t\xc3\xa9", b"...", b"a_b", b"a" * 17, b"'a" + b"'" * 20, b"|d"):
        text = toxicity.trimmed(word.decode()) or word.decode().strip("".join(set(toxicity._EDGES) - set(toxicity.LOOK_ALIKES)))
        assert toxicity.short_word(word) == (text if len(word) <= 16 and len(text) <= toxicity.SHORT else None)
