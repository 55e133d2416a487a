"""The language model by its likelihood of texts that it did not see, and by its own sums."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import lm_scoring as lm
from ledgerloom.llm.textbytes import WordHasher, Words

SF_DIR = "/root/testdata/sf0.01"


def test_training_raises_the_likelihood_of_unseen_texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    vocabulary = lm.learn_vocabulary(docs)
    texts = [r["text"].encode() for r in docs.filter(held).collect()]
    words = Words(WordHasher(fold=True), texts)
    scores = []
    for rounds in (0, 2):
        weights = lm.train(docs.filter(~held).repartition(3), vocabulary, rounds)
        scores.append(lm.log_probabilities(vocabulary, weights, words).mean())
    assert scores[1] > scores[0] + 0.02


def test_probabilities_of_a_place_add_up_to_one():
    hashes = np.arange(100, dtype=np.uint64) * np.uint64(7919)
    vocabulary = lm.Vocabulary(hashes, np.arange(1, 101), 500, 400)
    weights = lm.initial_weights(vocabulary.pad + 1)
    _, _, z = lm.forward(weights, np.array([[1, 2, 3, vocabulary.pad]]))
    share = np.exp(vocabulary.share.astype(float))
    share[100:] *= 400 / lm.RARE  # that many words in each bucket
    filled = np.unique(vocabulary.classes)
    total = (np.exp(z[0])[vocabulary.classes] * share).sum()
    assert abs(total - np.exp(z[0])[filled].sum()) < 1e-4


def test_odd_rows(spark):
    fields = "doc_id long, text string, n_words string"
    rows = [(1, None, "x"), (2, "", None), (3, "one", None), (3, "one", None), (None, "a b c", "y")]
    rows.append((4, "long text of words " * 30_000, None))
    docs = spark.createDataFrame(rows, fields)
    got = lm.score_documents(docs).collect()
    assert len(got) == 6
    for row in got:
        assert (row["mean_log_likelihood"] is None) == (row["n_words"] == 0)
        assert row["log_likelihood"] <= 1e-6
    assert sorted(r["n_words"] for r in got) == [0, 0, 1, 1, 3, 120_000]
    assert lm.score_documents(docs.limit(0)).count() == 0
    assert lm.score_documents(docs.filter("text is null")).first()["log_likelihood"] == 0


def test_score_is_the_sum_over_places(spark):
    docs = spark.createDataFrame([(1, "a b c d e f a b c")], "doc_id long, text string")
    got = lm.score_documents(docs, rounds=0).first()
    vocabulary = lm.learn_vocabulary(docs)
    weights = lm.initial_weights(vocabulary.pad + 1)
    tokens = "a b c d e f a b c".split()
    hasher, total = WordHasher(fold=True), 0.0
    ids = [int(vocabulary.tokens(Words(hasher, [t.encode()]).hash)[0]) for t in tokens]
    for i, own in enumerate(ids):
        around = [
            ids[i + k] if 0 <= i + k < len(ids) else vocabulary.pad for k in (-2, -1, 1, 2)
        ]
        _, _, z = lm.forward(weights, np.array([around]))
        total += z[0, vocabulary.classes[own]] + vocabulary.share[own]
    assert abs(total - got["log_likelihood"]) < 1e-3


def test_every_place_is_a_target_once(spark):
    texts = [b"one", b"a b", b"a b c d e f a b c " * 300]
    words = Words(WordHasher(fold=True), texts)
    for rounds in (1, 2, 5):
        at = np.concatenate([lm.targets(words, turn, rounds) for turn in range(rounds)])
        assert sorted(at.tolist()) == list(range(len(words.hash)))
    trained = []
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(50)),)], "text string").coalesce(1)
    vocabulary = lm.learn_vocabulary(docs)
    start = lm.initial_weights(vocabulary.pad + 1)
    for turn in range(2):
        rows = docs.mapInArrow(lm._train(vocabulary, start, turn, 2), lm.SHARD).collect()
        trained.append(sum(r["steps"][0] for r in rows if len(r["steps"]) == lm.HIDDEN + 1))
    assert sum(trained) == 50
