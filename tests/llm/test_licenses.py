import re

import pytest

from ledgerloom.llm import licenses
from ledgerloom.llm.queries import QUERIES
from tests.llm.samples import SMALL, awkward, documents, empty, lower


def brute(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))
    base = []
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), base


def test_base_columns(spark):
    text = {d: t for d, t, _ in documents()}
    rows = QUERIES["op9_licenses"](spark, SMALL).collect()
    assert len(rows) == len(text) and any(r.n_base for r in rows)
    for r in rows:
        n, base = brute(text[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in base}))
        assert set(r.base_labels.split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize("template, text, end", [
    ("a b c", "a b c", 3), ("a b c", "a x c", None), ("a <<optional>> b <<end>> c", "a c", 2), ("a <<optional>> b <<end>> c", "a b c", 3),
    ("a <<optional>> b d <<end>> c", "a b c", None), ("a <<var:0:2>> c", "a c", 2), ("a <<var:0:2>> c", "a x y c", 4),
    ("a <<var:0:2>> c", "a x y z c", None), ("a <<var:1:2>> c", "a c", None), ("a <<var:1:2>> c", "a c c", 3),
    ("a <<optional>> b <<optional>> c <<end>> <<end>> d", "a b d", 3), ("a <<optional>> b <<optional>> c <<end>> <<end>> d", "a c d", None),
    ("<<optional>> a <<end>> b", "b", 1), ("a <<var:0:0>> b", "a b", 2),
])
def test_automaton(template, text, end):
    assert licenses.Automaton("t", template).match([w.encode() for w in text.split()], 0) == end


def test_templates_match_their_own_wording():
    for label, template in licenses.TEMPLATES.items():
        short = re.sub(r"<<optional>>(?:(?!<<optional>>).)*?<<end>>", "", re.sub(r"<<optional>>(?:(?!<<optional>>).)*?<<end>>", "", template))
        text = "Some words. " + re.sub(r"<<var:(\d+):\d+>>", lambda m: "x " * int(m[1]), re.sub(r"<<optional>>|<<end>>", "", short)).title() + " -- and more"
        _, _, found = licenses.Scanner({}, licenses.TEMPLATES).scan(text.encode())
        assert label in {f[0] for f in found}, label
        broken = text.split()
        del broken[3]
        _, _, rest = licenses.Scanner({}, {label: template}).scan(" ".join(broken).encode())
        assert all(f[1] != 2 for f in rest) or "<<optional>>" in template


def test_templates_must_begin_with_a_word_and_close():
    for wrong in ("<<var:0:2>> a", "a <<optional>> b", "<<optional>> a <<end>>"):
        with pytest.raises(ValueError):
            licenses.Automaton("t", wrong)


def test_awkward(spark):
    frame, rows = awkward(spark)
    got = licenses.scan_licenses(frame).collect()
    assert [(r.doc_id, r.n_words) for r in got] == [(d, brute(t)[0]) for d, t in rows]
    assert licenses.scan_licenses(empty(spark)).collect() == []
