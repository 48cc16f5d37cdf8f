"""Top N, term counts, overlaps and splits against brute force."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import group_splits, split_overlap, term_frequency, topn_groups

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def runs():
    rng = random.Random(1)
    rows = []
    for run in range(900):
        g = rng.choice([7] * 5 + list(range(20)) + [None])
        for v in range(rng.choice([1, 1, 1, 2, 3])):
            s = rng.choice([None, float("nan"), 0.5, 0.5, round(rng.random(), 2), -0.0, 0.0])
            rows.append((g, run, s, T0 + datetime.timedelta(hours=v), "x", 1.0, 3))
    return rows + rows[:50]


SCHEMA = "g long, run long, s double, t timestamp_ntz, item string, score double, rank int"


def best_five(rows):
    last = {}
    for g, run, s, t, *_ in rows:
        if run not in last or t > last[run][0]:
            last[run] = (t, g, s)
    by = {}
    for run, (_, g, s) in last.items():
        if g is not None and s is not None and s == s:
            by.setdefault(g, []).append((-s + 0.0, run))
    return {(g, run, i + 1) for g, x in by.items() for i, (_, run) in enumerate(sorted(x)[:5])}


@pytest.mark.parametrize("row_group, bucket", [(256 * 1024, 500_000), (2000, 500_000), (2000, 60)])
def test_top_n_equals_brute_force(spark, runs, monkeypatch, row_group, bucket):
    monkeypatch.setattr(topn_groups, "ROW_GROUP_BYTES", row_group)
    monkeypatch.setattr(topn_groups, "BUCKET_ROWS", bucket)
    got = topn_groups.top_n(spark.createDataFrame(runs, SCHEMA), "g", "run", "s", 5, "t").collect()
    assert {(r.grp, r["item"], r["rank"]) for r in got} == best_five(runs)


@pytest.mark.parametrize("groups, bucket", [(1, 500_000), (1, 20_000), (40, 500_000)])
def test_top_n_skips_row_groups(spark, monkeypatch, groups, bucket):
    """Of one hot group, in one file or several, and of row groups that hold forty groups each."""
    monkeypatch.setattr(topn_groups, "ROW_GROUP_BYTES", 16_000)
    monkeypatch.setattr(topn_groups, "BUCKET_ROWS", bucket)
    df = spark.range(60_000).select(F.pmod("id", F.lit(groups)).alias("g"), F.col("id").alias("run"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("s"))
    path = topn_groups.cluster(df.select(F.col("g").alias("grp"), F.col("s").alias("score"), F.col("run").alias("item")))
    files = spark.read.schema("grp long, score double, item long").option("recursiveFileLookup", True).parquet(path).inputFiles()
    zoned = topn_groups.zones(spark, files).cache()
    read = topn_groups.read_best(zoned.withColumn("floor", F.lit(None).cast("double")), 5, 8).where("grp is null").agg(F.sum("score"), F.sum("item")).first()
    assert zoned.count() > 10
    if bucket > 60_000:
        assert read[0] > 0.5 * zoned.count() and (read[1] > 0.5 * zoned.count()) == (groups > 1)
    got = {(r.grp, r["item"], r["rank"]) for r in topn_groups.top_n(df, "g", "run", "s", 5).collect()}
    rows = sorted((r.g, -r.s, r.run) for r in df.collect())
    by = {}
    for g, _, run in rows:
        by.setdefault(g, []).append(run)
    assert got == {(g, run, i + 1) for g, x in by.items() for i, run in enumerate(x[:5])}


def test_row_groups_of_unseen_or_open_groups_are_read():
    top = topn_groups.Best(2)
    top.add(np.array([1, 1, 2]), np.array([9.0, 8.0, 7.0]), np.array([1, 2, 3]), np.array([4, 4, 2]))
    assert not top.may_skip(1, 2, 5.0, 6)  # group 2 has one of its two rows
    assert not top.may_skip(1, 2, 5.0, 9)  # there is a group not seen yet
    top.add(np.array([2]), np.array([6.0]), np.array([4]), np.array([2]))
    assert top.may_skip(1, 2, 5.0, 6) and not top.may_skip(1, 2, 8.0, 6)  # equal is not below
    assert top.may_skip(1, 1, 7.0, None) and not top.may_skip(3, 3, 0.0, None)


def test_top_n_empty(spark):
    assert topn_groups.top_n(spark.createDataFrame([], SCHEMA), "g", "run", "s", 5, "t").count() == 0


TERMS = "frame_label string, lu_lemma string, global_id string, term string, field int"


@pytest.mark.parametrize("held", [500_000, 20])
def test_terms_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(term_frequency, "HELD_TERMS", held)
    rng = random.Random(2)
    words = ["sagen", " Sagen\t", "SAGEN ", "geben", "<unk>", "", "  ", None, "ä" * 3000] + [f"w{i}" for i in range(700)]
    rows = [(rng.choice(words), rng.choice(words), rng.choice([None] + [f"g{i}" for i in range(400)]), "t", 1) for _ in range(3000)]
    want = {}
    for r in rows:
        for field, v in (("frame_label", r[0]), ("lu_lemma", r[1])):
            t = v.strip(" \t ").lower() if v is not None else ""
            if t and t != "<unk>":
                c = want.setdefault((field, t), [0, set()])
                c[0] += 1
                c[1].update([r[2]] if r[2] is not None else [])
    got = term_frequency.marked_terms(spark.createDataFrame(rows, TERMS), ["frame_label", "lu_lemma"], "global_id").collect()
    assert {(r.field_name, r.term): (r.occurrences, r.records) for r in got} == {k: (n, len(g)) for k, (n, g) in want.items()}
    total = len({r[2] for r in rows if r[2] is not None})
    for r in got:
        assert r.mark == ("rare" if r.records <= 2 else "common" if r.records > 0.05 * total else None)
    assert term_frequency.marked_terms(spark.createDataFrame([], TERMS), ["frame_label", "lu_lemma"], "global_id").count() == 0


def test_burst_trie_keeps_counts():
    trie = term_frequency.BurstTrie(burst=4)
    rng, want = random.Random(3), {}
    for _ in range(3000):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        trie.add(t, 1, 2)
        want[t] = want.get(t, 0) + 1
    assert {t: tuple(c) for t, c in trie.items()} == {t: (n, 2 * n) for t, n in want.items()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_equals_the_matrix():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert split_overlap.edit_distance(a, b) == distance(a, b)


@pytest.fixture(scope="module")
def sentences():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(150):
        base = [rng.choice(words) for _ in range(rng.choice([5, 8, 9, 10, 15, 20, 31, 80]))]
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 4))):
                at = rng.randrange(len(t))
                kind = rng.random()
                t[at : at + (kind < 0.7)] = [] if 0.5 < kind < 0.7 else [rng.choice(words)]
            out.append(t)
    rows = [(f"s{i}", " ".join(t), rng.choice(["train", "train", "dev", "test", "other", None]), rng.choice(["A", "B"]), 1, "x") for i, t in enumerate(out)]
    return rows + [("n1", None, "train", "A", 1, "x"), ("n2", "", "dev", "A", 1, "x"), (None, "a b c", "dev", "A", 1, "x"), ("u1", "Öl für die Straße ist  sehr\tteuer , sagt er !", "train", "A", 1, "x"), ("u2", "OEL fuer die STRASSE ist sehr teuer sagt er", "test", None, 1, "x")]


RECORDS = "id string, text string, split string, source string, tid long, toks string"


def test_overlaps_equal_brute_force(spark, sentences):
    model = split_overlap.Overlaps(spark.createDataFrame(sentences, RECORDS))
    got = {tuple(r) for r in model.pairs().collect()}
    toks = {}
    for i, t, split, *_ in sentences:
        if i and t:
            for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
                t = t.lower().replace(a, b)
            k = [w for w in t.split() if any(c.isalnum() for c in w)]
            if len(k) >= 8 and split in ("train", "dev", "test"):
                toks[i] = (split, k)
    want = {(min(a, b), max(a, b)) for a, (p, x) in toks.items() if p == "train" for b, (q, y) in toks.items() if q != "train" and 5 * distance(x, y) <= max(len(x), len(y))}
    assert got == want and ("u1", "u2") in got
    report = model.report().collect()
    ids = {x for pair in want for x in pair}
    for split in ("dev", "test"):
        assert sum(r.n_overlapping for r in report if r["split"] == split) == sum(toks[i][0] == split for i in ids)


def test_overlaps_of_empty_and_copied_texts(spark):
    assert split_overlap.Overlaps(spark.createDataFrame([], RECORDS)).pairs().count() == 0
    text = "one two three four five six seven eight nine"
    rows = [(f"t{i}", text, "train", "A", 1, "x") for i in range(30)] + [(f"d{i}", text, "dev", "A", 1, "x") for i in range(20)]
    model = split_overlap.Overlaps(spark.createDataFrame(rows, RECORDS))
    assert model.links.count() == 1 and model.pairs().count() == 600
    assert model.report().collect()[0].n_exact == 20


def test_segments_shared_at_least():
    """Against trying all lengths within reach."""
    for n in range(6, 400):
        want = min(m - 2 - 3 * (m // 5) for m in range(n, 2 * n) if m - m // 5 <= n)
        assert int(split_overlap.fewest_shared(np.array([n]))[0]) == want >= 1


def test_fingerprints_differ_by_two_bits_an_edit_at_most():
    """Also where a word recurs, so that an edit of it counts like any other."""
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.choice("abcdefgh" if rng.random() < 0.5 else "xx") for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            b[(at := rng.randrange(len(b) + 1)) : at + rng.randint(0, 1)] = [rng.choice("abcxyz")] * rng.randint(0, 1)
        code, row = np.array([ord(c) for c in a + b], "u8") * np.uint64(0x9E3779B97F4A7C15), np.repeat([0, 1], [len(a), len(b)])
        x, y = split_overlap._parity(code, row, 2)
        assert sum(int(v).bit_count() for v in (x ^ y).view("u8")) <= 2 * distance(a, b) - abs(len(a) - len(b))


def test_divided_blocks_lose_no_pair(spark, sentences):
    """A block in every text, and frequent blocks divided among tasks."""
    rows = [(i, f"all of these begin alike {t}" if t else t, *rest) for i, t, *rest in sentences]
    want = {tuple(r) for r in split_overlap.Overlaps(spark.createDataFrame(rows, RECORDS)).pairs().collect()}
    old, split_overlap.BLOCK_ROWS = split_overlap.BLOCK_ROWS, 10
    try:
        assert {tuple(r) for r in split_overlap.Overlaps(spark.createDataFrame(rows, RECORDS)).pairs().collect()} == want
    finally:
        split_overlap.BLOCK_ROWS = old
    assert want


def test_blocks_of_signs_would_miss_pairs():
    """Why blocks are not cut from a similarity hash of signs: of texts with a fifth of their tokens replaced, 64 blocks of 18 of its bits miss a third."""
    rng = np.random.default_rng(0)
    missed = tried = 0
    for _ in range(400):
        n = int(rng.integers(10, 41))
        signs = rng.integers(0, 2, (n + n // 5, 128)) * 2 - 1
        a, b = signs[:n].sum(0) > 0, signs[n // 5 :].sum(0) > 0
        tables = np.array([rng.choice(128, 18, replace=False) for _ in range(64)])
        missed += not (a == b)[tables].all(1).any()
        tried += 1
    assert 0.25 < missed / tried < 0.5


SPLIT_ROWS = "c string, label string, old string, comp string, n long"


def test_components_stay_whole_and_shares_are_met(spark):
    rng = random.Random(6)
    rows = [(f"c{i}", rng.choice("xyz"), rng.choice(["train", "dev", "test", None]), "k", 1) for i in range(2500) for _ in range(rng.choice([1, 1, 2, 3, 9]))]
    rows += [(None, "x", "train", "k", 1)]
    got = group_splits.assign(spark.createDataFrame(rows, SPLIT_ROWS), F.col("c"), F.col("label"), F.col("old"), {"train": 0.7, "dev": 0.1, "test": 0.2}).collect()
    assert len(got) == len({r.comp for r in got}) == 2500
    total = sum(r.n_rows for r in got)
    assert total == len(rows) - 1
    for name, share in (("train", 0.7), ("dev", 0.1), ("test", 0.2)):
        assert abs(sum(r.n_rows for r in got if r["split"] == name) / total - share) < 0.005
    by = {}
    for c, _, old, *_ in rows:
        by.setdefault(c, set()).update([old] if old else [])
    assert {r.comp: r.n_old_splits for r in got} == {c: len(s) for c, s in by.items() if c is not None}


def test_one_component_with_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(group_splits, "BLOCK", 200)
    rows = [("big", "a", "train", "k", 1)] * 1000 + [(f"c{i}", "ab"[i % 2], "train", "k", 1) for i in range(2000)]
    got = group_splits.assign(spark.createDataFrame(rows, SPLIT_ROWS), F.col("c"), F.col("label"), F.col("old"), {"train": 0.7, "dev": 0.1, "test": 0.2}).collect()
    assert len(got) == 2001 and sum(r.n_rows for r in got) == 3000
    for name, share in (("train", 0.7), ("dev", 0.1), ("test", 0.2)):
        assert abs(sum(r.n_rows for r in got if r["split"] == name) / 3000 - share) < 0.005


def test_labels_are_spread_evenly(spark):
    rows = [(f"c{i}", "rare" if i % 10 == 0 else "common", "train", "k", 1) for i in range(2000)]
    got = group_splits.assign(spark.createDataFrame(rows, SPLIT_ROWS), F.col("c"), F.col("label"), F.col("old"), {"train": 0.7, "dev": 0.1, "test": 0.2}).collect()
    rare = [r for r in got if int(r.comp[1:]) % 10 == 0]
    assert abs(sum(r["split"] == "dev" for r in rare) / len(rare) - 0.1) < 0.02


def test_annealing_lowers_the_deviation():
    rng = np.random.default_rng(0)
    sizes, labels = rng.integers(1, 9, 300).astype(float), rng.integers(0, 2, 300)
    loads = [[(0, v), (1 + int(x), v)] for v, x in zip(sizes, labels)]
    total = np.array([sizes.sum(), *(sizes[labels == x].sum() for x in (0, 1))])
    shares = np.array([0.7, 0.1, 0.2])
    before = group_splits.anneal(loads, [0] * 300, shares[:, None] * total, 0.3, 1, 0)[1]
    split, after = group_splits.anneal(loads, [0] * 300, shares[:, None] * total, 0.3, 1, 3000)
    assert after < before / 100
    assert np.allclose([sizes[np.array(split) == k].sum() / sizes.sum() for k in range(3)], shares, atol=0.02)


def test_many_labels_are_all_balanced(spark):
    """Forty labels in one block: none of them is lumped with others."""
    rows = [(f"c{i}", f"l{i % 40}", "train", "k", 1) for i in range(3000)]
    got = group_splits.assign(spark.createDataFrame(rows, SPLIT_ROWS), F.col("c"), F.col("label"), F.col("old"), {"train": 0.7, "dev": 0.1, "test": 0.2}, weight=3.0)
    told = group_splits.report(got, {"train": 0.7, "dev": 0.1, "test": 0.2}).collect()
    assert len(told) == 3 * 41 and all(abs(r.deviation) < (0.005 if r.label is None else 0.1) for r in told)


def test_start_of_a_component_does_not_depend_on_others(spark, monkeypatch):
    """Without annealing steps a component is where its hash puts it."""
    monkeypatch.setattr(group_splits, "anneal", lambda loads, start, *_: (start, 0.0))
    rows = [(f"c{i}", "a", "train", "k", 1) for i in range(500)]
    some, more = ({r.comp: r["split"] for r in group_splits.assign(spark.createDataFrame(x, SPLIT_ROWS), F.col("c"), F.col("label"), F.col("old"), {"train": 0.7, "dev": 0.1, "test": 0.2}).collect()} for x in (rows[:400], rows))
    assert all(more[c] == k for c, k in some.items()) and 0.6 < sum(k == "train" for k in more.values()) / 500 < 0.8


def test_components_over_several_keys(spark):
    rows = [(1, "a", "x"), (2, "a", None), (3, None, "x"), (4, "b", "y"), (5, None, None)]
    got = {r.id: r.comp for r in group_splits.components(spark.createDataFrame(rows, "id long, author string, source string"), "id", ["author", "source"]).collect()}
    assert got[1] == got[2] == got[3] and len({got[1], got[4], got[5]}) == 3
    one = {r.id: r.comp for r in group_splits.components(spark.createDataFrame(rows, "id long, author string, source string"), "id", ["author"]).collect()}
    assert one[1] == one[2] == "a" and len({one[3], one[4], one[5]}) == 3


def test_no_components(spark):
    assert group_splits.assign(spark.createDataFrame([], SPLIT_ROWS), F.col("c"), F.col("label"), F.col("old"), {"train": 1.0}).count() == 0
