import random

import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import tokens
from tests.llm.samples import SMALL, awkward, documents, empty


def whole():
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: len(plain.encode(text, add_special_tokens=False).ids)


def edited(text, edits):
    for begin, end, new in sorted(edits, reverse=True):
        text = text[:begin] + new + text[end:]
    return text


def test_random_edits_agree_with_a_full_count():
    rng, count, coder = random.Random(4), whole(), tokens.coder_at()
    text = " ".join(d[1] for d in documents()[:3]) + "  two  spaces \n\n and é ü \U0001f600 it's "
    own = tokens.Counted(text, coder)
    assert own.total == count(text)
    for _ in range(150):
        cuts = sorted(rng.sample(range(len(own.text) + 1), 2 * rng.randrange(1, 6)))
        edits = [(a, min(b, a + rng.randrange(0, 400)), rng.choice(["", " ", "  ", "x", "'s", " new words ", "\n", "é", "12", "<address>", "<|"]))
                 for a, b in zip(cuts[::2], cuts[1::2])]
        want = edited(own.text, edits)
        own.edit(edits)
        assert own.text == want and own.total == count(want)
        if len(own.text) < 300 or "<|" in own.text:
            own = tokens.Counted(text, coder)
    assert own.characters[1] == len(own.text)


def test_small_edit_reads_a_small_part():
    coder = tokens.coder_at()
    own = tokens.Counted(" ".join(f"word{i}" for i in range(50_000)), coder)
    own.edit([(200_000, 200_003, "abc")])
    assert own.reencoded < 4 * tokens.LEAF_CHARACTERS and own.touched < 100


def test_query_rows(spark):
    from ledgerloom.llm.queries import QUERIES

    count, texts = whole(), {d: t for d, t, _ in documents()}
    rows = QUERIES["op1_token_counts"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        after = edited(texts[r.doc_id], tokens.cleaning_edits(texts[r.doc_id]))
        assert (r.n_tokens, r.n_tokens_after, r.n_chars_after) == (count(texts[r.doc_id]), count(after), len(after))


def test_awkward_and_edit_table(spark):
    frame, rows = awkward(spark)
    count = whole()
    edits = [(1, 0, 5, "now there is text"), (2, 0, 0, None), (5, 5, 10_000, " and more"), (9, 0, 1, ""), (4, 1000, 1010, "X"),
             (4, 50, 60, " "), (None, 0, 1, "a"), (5, None, 1, "a"), (77, 0, 1, "no such document"), (10, 0, 0, "<|endoftext|>")]
    table = spark.createDataFrame(edits, "doc_id long, begin long, end long, replacement string")
    got = tokens.apply_edits(tokens.token_index(frame), table).collect()
    want = []
    for d, t in rows:
        own = [(b, min(e, len(t or "")), r or "") for i, b, e, r in edits if i == d and d is not None and b is not None]
        after = edited(t or "", own)
        want.append((d, after, count(t or ""), count(after), len(own)))
    assert sorted(((r.doc_id, r.text or "", r.n_before, r.n_tokens, r.n_edits) for r in got), key=str) == sorted(want, key=str)
    assert tokens.token_index(empty(spark)).collect() == []
    assert tokens.apply_edits(tokens.token_index(empty(spark)), table).collect() == []
