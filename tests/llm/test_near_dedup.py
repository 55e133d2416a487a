"""Near-duplicates against brute force over all pairs; signatures against true similarity."""

import random
import re
from collections import Counter

import numpy as np

from ledgerloom.llm import near_dedup
from ledgerloom.llm.textbytes import WordHasher, Words, mix64, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    words = WORD.findall(text or "")
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def brute_force(texts):
    """Smallest id of each id's component of links."""
    bags = {k: bag(t) for k, t in texts.items()}
    parent = {k: k for k in bags}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(bags)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if similarity(bags[a], bags[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    errors = []
    for turn in range(25):
        n = int(rng.integers(3, 150))
        value = mix64(np.arange(n, dtype=np.uint64) + np.uint64(10_000 * turn))
        a = rng.integers(0, 12, n) ** rng.integers(0, 3)
        b = np.where(rng.random(n) < 0.7, a, rng.integers(0, 6, n))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        bags = np.concatenate((value[a > 0], value[b > 0]))
        count = np.concatenate((a[a > 0], b[b > 0]))
        signature = near_dedup.bag_minhash(doc, bags, count, 2, 1000)
        truth = np.minimum(a, b).sum() / max(1, np.maximum(a, b).sum())
        errors.append((signature[0] == signature[1]).mean() - truth)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_signatures_do_not_depend_on_the_batch():
    hasher = WordHasher()
    texts = [b"a b c d e f g", b"one", b"x y " * 40, b"a b c d e f h"]

    def sign(batch):
        doc, value = shingles(Words(hasher, batch), 5)
        return near_dedup.bag_minhash(*near_dedup.weighted(doc, value), len(batch), 64)

    together = sign(texts)
    for i, text in enumerate(texts):
        assert (sign([text])[0] == together[i]).all()


def make_texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, key = {}, 0
    for size in (3, 5, 9, 30, 120, 400):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for edits in (0, 0, 1, 2, 4, 8):
                words = list(base)
                for _ in range(edits * size // 100 + (edits > 0)):
                    words[rng.randrange(size)] = rng.choice(vocabulary)
                texts[key] = " ".join(words)
                key += 1
    base = [rng.choice(vocabulary) for _ in range(150)]
    for edits in range(60):  # one group with similarities on both sides of the threshold
        words = list(base)
        for _ in range(edits % 6):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        texts[key] = " ".join(words)
        key += 1
    texts[key], texts[key + 1], texts[key + 2], texts[key + 3] = None, "", " \n", "x " * 30_000
    texts[key + 4] = "x " * 25_000
    return texts


def test_classes_equal_brute_force(spark):
    texts = make_texts()
    rows = [(k, t, "other") for k, t in texts.items()]
    rows += [(0, texts[0], "again"), (None, texts[1], "no id"), (None, texts[1], "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, head string").repartition(3)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    wanted = brute_force(texts)
    for row in got:
        if row["doc_id"] is None:
            assert row["class_id"] is None and row["kept"]
        else:
            assert row["class_id"] == wanted[row["doc_id"]]
            assert row["kept"] == (row["doc_id"] == row["class_id"])
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(wanted.values()))
    assert ids.count(None) == 2


def test_components_get_an_edge_for_each_copy_and_not_for_each_link(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    texts = []
    for k in range(120):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(300)] = f"v{rng.randrange(900)}"
        texts.append(" ".join([*words, f"end{k}"]))
    seen, real = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda s, e, n: seen.append(e.count()) or real(s, e, n))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_force(dict(enumerate(texts)))
    assert max(seen) < 1.5 * len(texts)


def test_pairs_of_several_shared_buckets_are_made_once(spark):
    rng = random.Random(4)
    component = {h: (0 if h < 12 else h - h % 2) for h in range(20)}
    buckets = {h: set(rng.sample(range(8), 5)) for h in component}
    rows, wanted = [], set()
    for b in range(8):
        inside = [h for h in component if b in buckets[h]]
        largest = max((sum(component[x] == component[h] for x in inside), component[h]) for h in inside)[1]
        wanted |= {(x, y) for x in inside for y in inside if x < y and component[x] != component[y]}
        rows += [(b, h, component[h], largest, [7] * 32, sorted(buckets[h])) for h in inside]
    schema = "bucket long, head long, component long, largest long, sketch array<long>, buckets array<long>"
    made = near_dedup._unmet(spark.createDataFrame(rows, schema), 0.8).collect()
    assert sorted((r["a"], r["b"]) for r in made) == sorted(wanted)


def test_near_copies_and_stragglers_meet_once(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = []
    for k in range(60):
        words = list(base)
        for _ in range(1 if k % 6 else 4):
            words[rng.randrange(5, 195)] = f"v{rng.randrange(900)}"
        texts.append(" ".join([*words, f"end{k}"]))
    seen, real = [], near_dedup._unmet

    def unmet(placed, similarity):
        pairs = real(placed, similarity)
        seen.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(near_dedup, "_unmet", unmet)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_force(dict(enumerate(texts)))
    assert seen[0][0] == seen[0][1] > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs).count() == 0
    assert near_dedup.drop_near_duplicates(docs).count() == 0


def test_whole_documents_of_the_smallest_table(spark):
    from ledgerloom.llm.queries import op8_minhash_dedup

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    wanted = brute_force({r["doc_id"]: r["text"] for r in docs})
    got = op8_minhash_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == wanted


def test_texts_of_one_id_are_documents_of_their_own(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, a), (5, a), (5, b), (5, f" {b}\n"), (5, b), (7, c + " x"), (7, c), (9, b + " y"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.near_duplicates(docs).join(docs.select("doc_id").distinct(), "doc_id")
    assert got.count() == len(rows)
    judged = near_dedup._judged(docs, 0.8).select("doc_id", "text_key", "class_id", "kept")
    keys = docs.select("text", near_dedup._text_key(docs["text"]).alias("text_key")).distinct()
    found = {(r["doc_id"], r["text"]): (r["class_id"], r["kept"]) for r in judged.join(keys, "text_key").collect()}
    assert found[1, a] == (1, True) and found[5, a] == (1, False)
    assert found[5, b] == found[5, f" {b}\n"] == (5, True) and found[9, b + " y"] == (5, False)
    assert {found[7, c][0], found[7, c + " x"][0]} == {7}
    assert found[7, c][1] != found[7, c + " x"][1]
    left = near_dedup.drop_near_duplicates(docs).collect()
    kept = sorted((r["doc_id"], (r["text"] or "").strip()) for r in left)
    assert [k for k in kept if k[1]] == sorted([(1, a), (5, b), (7, c if found[7, c][1] else c + " x")])
    assert [k for k in kept if not k[1]].count((5, "")) == 1
