"""Line dedup, mixing and quality rules on odd rows, against plain Python."""

import itertools
import math
import re
from collections import Counter

import numpy as np

from ledgerloom.llm import line_dedup, mixing, quality_rules

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, n_deleted string, row int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "one two. three four! five six? seven eight. "
LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, RUN + "own end."),
    (2, "start here. " + RUN + "other end."),
    (2, "start here. " + RUN + "other end."),
    (3, f"a line\n{LONG}\nlast"),
    (4, f"{LONG}\n\n\nmore"),
    (5, "spam line\n" * 40),
    (6, None),
    (7, ""),
    (8, " \n\t\n"),
    (None, RUN),
    (9, "x " * 100_000),
]


def make(spark):
    rows = [
        (i, t, None if k % 3 else "en", [None, "a", "b"][k % 3], 0, "clash", k)
        for k, (i, t) in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, FIELDS)


def test_later_runs_go(spark):
    docs = make(spark)
    got = line_dedup.delete_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_deleted_"]
    left = {r["row"]: (r["text"], r["n_deleted_"]) for r in got.collect()}
    assert left[0] == (TEXTS[0][1], 0)
    assert left[1] == left[2] == ("start here. other end.", 4)
    assert left[3][1] == 0 and left[4] == ("\n\nmore", 1)
    assert left[5][0] == "spam line\n" * 4
    assert left[6] == (None, 0) and left[7] == ("", 0) and left[8] == (" \n\t\n", 0)
    assert left[9] == ("", 4) and left[10][1] == 0
    assert line_dedup.delete_repeated_lines(docs.limit(0)).count() == 0
    # The same runs of four units, whatever the window.
    for run, window in ((4, 1), (1, 4)):
        same = line_dedup.delete_repeated_lines(docs, run, window)
        assert {r["row"]: (r["text"], r["n_deleted_"]) for r in same.collect()} == left


def test_units_end_at_lines_and_sentences(spark):
    texts = [t for _, t in TEXTS] + ["a.  b?! c!", ". . .", "...\n", "end. ", "\n\n", "a.\r\nb", "é. ü"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = docs.select("text", line_dedup._units(docs["text"]).alias("units")).collect()
    for text, units in got:
        wanted = text and [u for u in re.split(r"(?<=\n)|(?<=[.!?] )", text) if u]
        assert units == (wanted if text else text if text is None else [])


def test_mix_meets_its_targets(spark):
    docs = make(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(TEXTS)
    total = sum(len(WORD.findall(t or "")) for _, t in TEXTS)
    of = {r["source"]: r["target"] for r in got}
    assert abs(sum(of.values()) - total) < 1e-6 * total
    for row in got:
        assert row["target"] <= 3 * row["source_size"]
        assert row["taken"] == row["repeats"] * row["size"] <= 3 * row["size"]
    for source, target in of.items():
        rows = [r for r in got if r["source"] == source]
        taken = sum(r["taken"] for r in rows)
        assert abs(taken - target) <= max(r["size"] for r in rows) / 2 + 1e-6
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_base_statistics(spark):
    docs = make(spark)
    got = quality_rules.judge(docs, carry=("row",)).collect()
    assert len(got) == len(TEXTS)
    for row in got:
        text = TEXTS[row["row"]][1] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        times = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert row["n_words"] == len(words)
        assert row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_repeat_words"] == len(again)
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        assert row["base_failed"] == failed and not (failed and row["kept"])
    assert quality_rules.passing_documents(docs).columns == docs.columns
    assert quality_rules.judge(docs.limit(0)).count() == 0


def middle(values, part=0.5):
    return np.sort(values)[max(0, math.ceil(part * len(values)) - 1)]


def plain_mcd(x):
    """The estimate of one group by plain numpy: three starts, the least determinant."""
    floors = np.diag(np.array(list(quality_rules.FLOORS.values())) ** 2)
    centre = np.array([middle(c) for c in x.T])
    spread = np.array([middle(c) for c in np.abs(x - centre).T]) * 1.4826
    spread = np.maximum(spread, np.sqrt(np.diag(floors)))
    z = (x - centre) / spread
    long = np.linalg.norm(z, axis=1, keepdims=True)
    u = np.divide(z, long, out=np.zeros_like(z), where=long > 0)
    found = []
    for base in (None, u.T @ u / len(u), np.cov(np.tanh(z).T, bias=True)):
        r = np.eye(len(spread))
        if base is not None:
            d = np.sqrt(np.diag(base))
            for i, j in itertools.permutations(range(len(d)), 2):
                r[i, j] = base[i, j] / (d[i] * d[j]) if d[i] * d[j] > 1e-12 else 0.0
        mean, scatter = centre, r * np.outer(spread, spread)
        for _ in range(quality_rules.STEPS):
            inverse = np.linalg.inv(scatter + floors)
            distance = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
            near = x[distance <= middle(distance, quality_rules.INSIDE) + 1e-12]
            mean = near.mean(axis=0)
            scatter = np.cov(near.T, bias=True) if len(near) > 1 else np.zeros_like(floors)
            scatter = scatter * quality_rules.inner_scale(quality_rules.INSIDE)
        found.append((round(np.linalg.slogdet(scatter + floors)[1], 9), len(found), mean, scatter))
    return min(found, key=lambda f: f[:2])[2:]


def test_verdict_against_plain_numpy(spark):
    rng = np.random.default_rng(5)
    shapes = [("en", "big", 260), ("en", "small", 30), ("fr", "big", 90), (None, "big", 12), ("big", None, 7)]
    rows = []
    for lang, source, n in shapes:
        for _ in range(n):
            words = [f"w{rng.integers(900)}" + "x" * int(rng.integers(4)) for _ in range(rng.integers(60, 200))]
            for mark in rng.integers(0, len(words), size=rng.integers(0, 9)):
                words[mark] = words[mark].title() + rng.choice([",", ".", "#", "\n"])
            odd = ["#$%" * 9] * 60 if rng.random() < 0.06 else []
            rows.append((len(rows), " ".join(words + odd), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    counts = quality_rules.statistics([r[1].encode() for r in rows], quality_rules.WordHasher())
    x = quality_rules.vectors(counts)
    floors = np.diag(np.array(list(quality_rules.FLOORS.values())) ** 2)
    sound = np.array([not got[i]["base_failed"] for i in range(len(rows))])
    limit = quality_rules.chi_square_quantile(quality_rules.TAIL, len(floors))
    every, lang = plain_mcd(x[sound]), np.array([str(r[2]) for r in rows])
    rejected = 0
    for name, source, _ in shapes:
        mine = np.array([r[2] == name and r[3] == source for r in rows])
        whole = (lang == str(name)) & sound
        n = whole.sum()
        best = quality_rules.mixture(n / (n + quality_rules.PULL), plain_mcd(x[whole]), every)
        n = (mine & sound).sum()
        mean, scatter = quality_rules.mixture(n / (n + quality_rules.PULL), plain_mcd(x[mine & sound]), best)
        inverse = np.linalg.inv(scatter + floors)
        for i in np.flatnonzero(mine & sound):
            distance = (x[i] - mean) @ inverse @ (x[i] - mean)
            assert abs(got[i]["distance"] - distance) < 1e-6 * max(1, distance)
            assert got[i]["kept"] == (distance <= limit)
            rejected += not got[i]["kept"]
    assert 5 < rejected < 60


def test_small_groups_are_judged_with_their_language_and_the_corpus(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 997}" for j in range(80 + i % 9)), "en", "big") for i in range(300)]
    rows += [(300 + i, rows[i][1], *g) for i, g in enumerate([("en", "rare"), ("fr", "rare"), (None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = quality_rules.judge(docs).select("doc_id", "distance", "kept").collect()
    assert all(r["distance"] is not None and r["kept"] for r in got)
    few = quality_rules.judge(docs.filter("doc_id >= 295")).select("distance", "kept").collect()
    assert all(r["distance"] is not None and r["kept"] for r in few)
    noise = " ".join("#$%&<|>*" * 3 for _ in range(80))
    odd = spark.createDataFrame([(900, noise, "fr", "rare")], docs.schema)
    assert not quality_rules.judge(docs.unionByName(odd)).filter("doc_id = 900").first()["kept"]


def plain_line_dedup(rows):
    """The rule by comparing all runs: four units, or fewer that hold fifty words."""
    order = sorted(dict.fromkeys(rows), key=lambda r: (r[0] is None, r[0] or 0, line_key(r[1])))
    runs = []
    for d, (_, text) in enumerate(order):
        units = [u.strip(line_dedup.ENDS) for u in re.split(r"(?<=\n)|(?<=[.!?] )", text or "")]
        at = [i for i, u in enumerate(units) if u]
        for i in range(len(at)):
            for size in (1, 2, 3, 4):
                some = at[i : i + size]
                words = sum(len(WORD.findall(units[k])) for k in some)
                if len(some) == size and (size == 4 or words >= 50):
                    runs.append((tuple(units[k] for k in some), d, some[0], some[-1]))
    first, gone = {}, {}
    for run, d, lo, hi in runs:
        d0, hi0 = first.setdefault(run, (d, hi))
        if d != d0 or lo > hi0:
            gone.setdefault(d, set()).update(range(lo, hi + 1))
    cut = {}
    for d, (doc_id, text) in enumerate(order):
        pieces = [u for u in re.split(r"(?<=\n)|(?<=[.!?] )", text or "")]
        left = "".join(u for k, u in enumerate(pieces) if k not in gone.get(d, ()))
        cut[doc_id, text] = left if text is not None else None
    return cut


def line_key(text):
    import hashlib

    return hashlib.md5(text.encode()).digest()


def test_passages_of_fifty_words_equal_a_comparison_of_all_runs(spark):
    import random

    rng = random.Random(2)

    def sentence(n):
        return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n)) + rng.choice([". ", "! ", "\n"])

    stock = [sentence(n) for n in (5, 12, 17, 20, 24, 26, 30, 49, 50, 51) for _ in range(3)]
    rows = []
    for i in range(160):
        parts = []
        while len(parts) < rng.randrange(1, 14):
            if rng.random() < 0.4:
                k = rng.randrange(len(stock) - 3)
                parts += stock[k : k + rng.randrange(1, 5)]
            else:
                parts.append(sentence(rng.choice([3, 20, 48])))
        rows.append((i // 2 if i < 100 else (i if i < 140 else None), "".join(parts)))
    a, b, c = sentence(40), sentence(15), sentence(5)
    rows += [(300, a + b + c), (301, "Begin. " + a + b + c + "End.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = plain_line_dedup(rows)
    assert wanted[rows[-1]] == "Begin. End."
    for run, window in ((2, 3), (1, 4)):
        got = line_dedup.delete_repeated_lines(docs.withColumn("was", docs["text"]), run, window).collect()
        assert len(got) == len(rows)
        assert all(r["text"] == wanted[r["doc_id"], r["was"]] for r in got)
    # Rows without id are told apart by 128 bits.
    texts = [f"{RUN}tail {i}." for i in range(3)]
    got = line_dedup.later_copies(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string"))
    keys = [bytes(r["text_key"]) for r in got.collect()]
    assert len(keys) == len(set(keys)) == 2 and {len(k) for k in keys} == {16}
