"""The pipeline's stages on odd rows, each against plain Python on its own input."""

import random
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from ledgerloom.llm import mixing
from ledgerloom.llm.common import DOCUMENT
from tests.llm.test_corpus import WORD, plain_line_dedup
from tests.llm.test_near_dedup import brute_force

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, head string, n_deleted int"


def odd_documents():
    rng = random.Random(11)
    text = lambda n: " ".join(f"word{rng.randrange(900)}" for _ in range(n)) + "."
    passage = text(60)
    rows = [(i, text(90 + i % 7)) for i in range(120)]
    rows += [(200 + i, f"{text(70)}\n{passage}\n{text(70)}") for i in range(4)]
    rows += [(300, rows[3][1]), (301, rows[3][1] + " more"), (5, rows[5][1]), (5, text(95))]
    rows += [(None, text(80)), (None, text(80)), (400, None), (401, ""), (402, "few words")]
    rows += [(403, " ".join(f"long{i % 9973 * 7 % 9973}" for i in range(20_000)))]
    return [
        (i, t, None if k % 11 == 0 else "en", [None, "a", "b"][k % 3], len(t or ""), "clash", k)
        for k, (i, t) in enumerate(rows)
    ]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The tables before and after each stage, as ``run`` writes them."""
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(odd_documents(), FIELDS).write.parquet(f"{folder}/documents.parquet")
    docs, tables = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        tables[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return tables


def pairs(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_columns(steps):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert steps[name][2] == list(DOCUMENT)


def test_rules_drop_what_the_base_rule_drops(steps):
    before, after, _ = steps["quality_rules"]
    short = [r for r in before if len(WORD.findall(r["text"] or "")) < 50]
    assert len(short) == 3
    assert not pairs(after) - pairs(before)
    assert not set(pairs(after)) & set(pairs(short))
    assert len(after) >= 0.95 * (len(before) - len(short))


def test_lines(steps):
    before, after, _ = steps["line_dedup"]
    cut = plain_line_dedup([(r["doc_id"], r["text"]) for r in before])
    wanted = Counter()
    for r in before:
        left = cut[r["doc_id"], r["text"]]
        if left == r["text"] or WORD.search(left):
            wanted[r["doc_id"], left] += 1
    assert pairs(after) == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    assert sum("word" in r["text"] for r in after) > 100


def test_near_duplicates(steps):
    before, after, _ = steps["near_dedup"]
    named = sorted({(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None})
    classes = brute_force(dict(enumerate(t for _, t in named)))
    left = [r for r in after if r["doc_id"] is not None]
    at = {pair: k for k, pair in enumerate(named)}
    kept = [classes[at[r["doc_id"], r["text"]]] for r in left]
    assert len(kept) == len(set(kept)) == len(set(classes.values()))
    for r in left:
        mine = classes[at[r["doc_id"], r["text"]]]
        assert r["doc_id"] == min(named[k][0] for k in classes if classes[k] == mine)
    nameless = lambda rows: pairs(r for r in rows if r["doc_id"] is None)
    assert nameless(after) == nameless(before)


def test_mix(spark, steps):
    before, after, _ = steps["source_mixing"]
    docs = spark.createDataFrame([tuple(r) for r in before], ",".join(
        f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in DOCUMENT
    ))
    size = lambda rows: sum(len(WORD.findall(r["text"])) for r in rows)
    taken = Counter(r["source"] for r in after for _ in WORD.findall(r["text"]))
    for r in mixing.mix(docs).select("source", "target").distinct().collect():
        longest = max(size([b]) for b in before if b["source"] == r["source"])
        assert abs(taken[r["source"]] - r["target"]) <= longest
    assert not set(pairs(after)) - set(pairs(before))


def test_bpe(steps):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    before, after, _ = steps["byte_bpe"]
    library = tiktoken.Encoding(
        "ranks",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path(corpus_pipeline.RANKS)),
        special_tokens={},
    )
    wanted = Counter((r["doc_id"], len(library.encode_ordinary(r["text"]))) for r in before)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in after) == wanted


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
