import math
from collections import Counter

import numpy as np

from ledgerloom.llm import language
from ledgerloom.llm.queries import QUERIES
from tests.llm.samples import SMALL, awkward, documents, empty


def test_held_out_accuracy(spark):
    lang = {d: x for d, _, x in documents()}
    rows = QUERIES["op8_language"](spark, SMALL).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward(spark):
    frame, rows = awkward(spark)
    model = language.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = language.identify(frame, model).collect()
    assert len(got) == len(rows)
    for r, (_, text) in zip(got, rows):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and (r.score > 0) == (r.lang_pred != "und")
    kept = language.filter_known(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in rows)
    assert language.identify(empty(spark), language.train(empty(spark))).collect() == []
    assert {r.lang_pred for r in language.identify(frame, language.train(empty(spark))).collect()} == {"und"}


def test_code_lengths_by_hand(spark):
    """The table agrees with escape method C worked out symbol by symbol."""
    texts = ["abracadabra abra", "cadabra é"]
    model = language.train(spark.createDataFrame([("x", t) for t in texts], "lang string, text string"), order=2)
    grams = [Counter() for _ in range(3)]
    for text in texts:
        symbols = [0, 0, *model.symbols[np.frombuffer(text.encode(), np.uint8)].tolist()]
        for i in range(2, len(symbols)):
            for k in range(3):
                grams[k][tuple(symbols[i - k : i + 1])] += 1

    def bits(context, symbol):
        k = len(context)
        seen = {g: n for g, n in grams[k].items() if g[:-1] == context}
        total, kinds = sum(seen.values()), len(seen)
        if (*context, symbol) in seen:
            return -math.log2(seen[(*context, symbol)] / (total + kinds))
        shorter = bits(context[1:], symbol) if k else 8.0
        return (-math.log2(kinds / (total + kinds)) if kinds else 0.0) + shorter

    text = "bra cab dé!"
    symbols = [0, 0, *model.symbols[np.frombuffer(text.encode(), np.uint8)].tolist()]
    want = sum(bits(tuple(symbols[i - 2 : i]), symbols[i]) for i in range(2, len(symbols)))
    assert abs(model.lengths(text.encode())[0] - want) < 0.01


def test_order_and_alphabet_do_not_depend_on_the_input(spark):
    """Further languages and scripts change no code length; rare bytes stay apart; the table's size only affects speed."""
    two = [("el", "η γλώσσα των Ελλήνων"), ("he", "השפה של העם"), ("el", "ένα ακόμη κείμενο")]
    more = [(f"x{i:03}", "".join(chr(0x4E00 + 64 * i + j) for j in range(40)) * 20) for i in range(60)]
    small, large = (language.train(spark.createDataFrame(rows, "lang string, text string")) for rows in (two, two + more))
    assert small.order == large.order == language.ORDER
    assert len(set(large.symbols[0x80:].tolist())) == 128
    text = "των Ελλήνων העם και 한국어 😀 plain".encode()
    assert small.lengths(text).tolist() == large.lengths(text)[:2].tolist()
    tight = language.Model(large.languages, large.symbols, large.base, large.order, large.codes, large.n, table_bytes=5_000)
    none = language.Model(large.languages, large.symbols, large.base, large.order, large.codes, large.n, table_bytes=0)
    assert tight.lengths(text).tolist() == none.lengths(text).tolist() == large.lengths(text).tolist()
    assert [large.predict(t.encode())[0] for _, t in two + more] == [lang for lang, _ in two + more]
