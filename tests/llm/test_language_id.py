"""Features, training and held-out accuracy of language identification."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import language_id

FIELDS = "doc_id long, text string, lang string, source string, place int, score string"
WORDS = {
    "aa": "the of and to in house water river stone".split(),
    "bb": "der die das und ist haus wasser fluss stein".split(),
    "cc": "κα το της νερό πέτρα σπίτι ποτάμι μεγάλο".split(),
}


def plain_grams(text):
    """N-grams of letters and marks; runs of anything else are one space."""
    import unicodedata

    small, words = text.lower(), " "
    for c in small:
        inside = unicodedata.category(c)[0] in "LM"
        if inside or words[-1] != " ":
            words += c if inside else " "
    words = words if words[-1] == " " else words + " "
    grams = Counter(c for c in words if c != " ")
    for n in (2, 3):
        grams.update(words[k : k + n] for k in range(len(words) - n + 1))
    return grams


def place_of(gram):
    f1, f2, f3, fold = language_id.FACTORS
    codes = [0 if c == " " else ord(c) for c in gram]
    value = sum(c * f for c, f in zip(codes, (f1, f2, f3))) + len(codes) - 1
    return (value * fold % 2**64) >> 48


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1 << 20])
def test_grams_do_not_depend_on_slices(monkeypatch, size):
    monkeypatch.setattr(language_id, "SLICE", size)
    table = language_id.letters()
    for text in ["a", " a ", "Ab, c!!  dé\n1x", "ΟΔΟΣ Σ", "x" * 9, "1 a 2 b", "éa"]:
        wanted = np.zeros(language_id.PLACES, dtype=np.int64)
        for gram, n in plain_grams(text).items():
            wanted[place_of(gram)] += n
        assert (language_id.gram_counts(text, table) == wanted).all(), text
    for text in ["", " ", "12 %", "́"]:
        assert language_id.gram_counts(text, table) is None


def test_one_step_of_the_leader_is_the_closed_form():
    leader = language_id.Leader(2, rate=0.5, damp=1.0, l1=0.1, l2=0.3)
    leader.learn(np.array([3]), np.array([1.0]), 0, 2.0)
    # From zero weights the chances are one half each, so the gradient is -1 and 1.
    assert np.allclose(leader.z[3], [-1, 1]) and np.allclose(leader.n[3], [1, 1])
    wanted = (1 - 0.1) / ((1 + 1) / 0.5 + 0.3)
    assert np.allclose(leader.weights(np.array([3])), [[wanted, -wanted]])
    intercept = 1 / ((1 + 1) / 0.5 + 0.3)
    assert np.allclose(leader.weights(np.array([language_id.PLACES])), [[intercept, -intercept]])
    assert not leader.weights(slice(0, 3)).any()


def test_temperature_mends_the_scale():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(20_000, 3))
    chances = language_id.softmax(scores)
    answers = (chances.cumsum(1) > rng.random((len(scores), 1))).argmax(1)
    ones = np.ones(len(scores))
    assert language_id.temperature(scores * 4, answers, ones) == pytest.approx(4, rel=0.05)
    assert language_id.temperature(scores[:0], answers[:0], ones[:0]) == 1.0


def made_docs(n=240):
    rng = np.random.default_rng(7)
    langs = sorted(WORDS)
    rows = []
    for i in range(n):
        lang = langs[0] if i % 2 else langs[i // 2 % 3]
        text = " ".join(rng.choice(WORDS[lang], 12))
        rows.append((i, text, lang, "s", 1, "clash"))
    return rows


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_documents_are_predicted_and_not_learnt_from(spark):
    rows = made_docs()
    got = {r["doc_id"]: r for r in language_id.identify_languages(spark.createDataFrame(rows, FIELDS)).collect()}
    assert len(got) == len(rows)
    for i, _, lang, *_ in rows:
        assert got[i]["held_out"] == is_held_out(i)
        assert got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1
    # Other labels and texts on held-out rows change no other row.
    lying = [(i, "zzz qqq" if is_held_out(i) else t, "zz" if is_held_out(i) else g, *r) for i, t, g, *r in rows]
    again = language_id.identify_languages(spark.createDataFrame(lying, FIELDS)).collect()
    for r in again:
        assert r["lang_pred"] != "zz"
        if not r["held_out"]:
            assert tuple(r) == tuple(got[r["doc_id"]])


def test_frequencies_and_sample_weights_cover_all_rows(spark):
    rows = made_docs()
    model = language_id.train(spark.createDataFrame(rows, FIELDS), sample=60)
    known = [r for r in rows if not is_held_out(r[0])]
    seen = Counter(p for r in known for p in {place_of(g) for g in plain_grams(r[1])})
    for p in range(0, language_id.PLACES, 7):
        wanted = math.log((1 + len(known)) / (1 + seen[p])) + 1 if p in seen else 0
        assert model.idf[p] == pytest.approx(wanted)
    assert model.langs == sorted(WORDS)
    assert (model.weights[:-1] == 0).mean() > 0.9


def test_odd_rows(spark):
    rows = made_docs(60)
    odd = [
        (None, "the of and the water of the river", "aa", None, 1, ""), (1000, None, "aa", None, 1, ""),
        (1001, "", "bb", None, 1, ""), (1002, "12 34 %", None, None, 1, ""),
        (1003, "der die das " * 200_000, None, None, 1, ""), (1004, "the and of", None, None, 1, ""),
        (1004, "the and of", None, None, 1, ""),
    ]
    docs = spark.createDataFrame(rows + odd, FIELDS)
    got = [tuple(r) for r in language_id.identify_languages(docs).collect()]
    assert len(got) == len(docs.collect())
    told = {r[0]: r for r in got}
    assert told[None][1:3] == (False, "aa")
    assert all(told[i][2:] == ("und", 0.0) for i in (1000, 1001, 1002))
    assert told[1003][2] == "bb" and told[1004][2] == "aa"
    assert sum(r[0] == 1004 for r in got) == 2
    assert language_id.identify_languages(docs.limit(0)).count() == 0
    # Nothing to learn from, and one language only.
    unlabelled = docs.filter("lang IS NULL")
    assert {r["lang_pred"] for r in language_id.identify_languages(unlabelled).collect()} == {"und"}
    one = docs.filter("lang = 'aa' OR lang IS NULL")
    assert {r["lang_pred"] for r in language_id.identify_languages(one).collect()} == {"und", "aa"}
