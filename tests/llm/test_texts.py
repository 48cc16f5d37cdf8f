"""Packing, mixing and content scores."""

import numpy as np
import pytest

from tessera.llm import _boosting, _ranking, _tokens, abuse, mixing, packing


def test_ranks_number_each_key(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id % 50 as string) end as k")
    got = _ranking.with_rank(df, ["k"], ["id"], 16).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == 5000


def test_token_counts_of_whole_texts(spark):
    enc = _tokens.encoder(_tokens.VOCABULARY)
    long = "Der Rat tagt. " * 30_000
    rows = [(1, "Guten Tag, <|endoftext|>", "a", 1), (2, None, "a", 1), (3, " \t \n", "a", 1), (4, "", "a", 1), (5, long, None, 1), (None, "x", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    got = {r.id: r.n_tokens for r in _tokens.token_counts(df, extra=["source"]).collect()}
    assert got == {1: len(enc.encode_ordinary(rows[0][1])), 5: len(enc.encode_ordinary(long))}


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_item_within_capacity(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(rng.geometric(0.01, 3000), 200), minlength=201)
    counts[0] = 0
    placed = np.zeros(201, int)
    full = boxes = 0
    for used, times in packing.plan(counts, 200):
        load = sum(a * n for a, n in used.items())
        assert load <= 200 and times >= 1
        boxes += times
        full += times * (load == 200)
        for a, n in used.items():
            placed[a] += n * times
    assert (placed == counts).all()
    assert boxes <= 1.01 * np.ceil((counts * np.arange(201)).sum() / 200) + 1


def test_packing_round_trip(spark):
    rows = [(i, int(n)) for i, n in enumerate(np.random.default_rng(1).integers(1, 700, 2000))] + [(9001, 2048), (9002, 5000), (9003, 4096), (9004, 0), (9005, None), (None, 5)]
    got = packing.pack(spark.createDataFrame(rows, "id long, n_tokens long"), 2048).collect()
    loads, parts = {}, {}
    for r in got:
        loads[r.container] = loads.get(r.container, 0) + r.n_tokens
        parts.setdefault(r.id, []).append((r.start, r.n_tokens))
    assert max(loads.values()) <= 2048 and sorted(loads) == list(range(len(loads)))
    want = {i: n for i, n in rows if i is not None and n}
    assert set(parts) == set(want)
    for i, p in parts.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == want[i] and len(p) == -(-want[i] // 2048)
    report = packing.fill_report(packing.pack(spark.createDataFrame(rows, "id long, n_tokens long"), 2048)).first()
    assert report.fill > 0.99 and report.n_tokens == sum(want.values())
    assert packing.pack(spark.createDataFrame([], "id long, n_tokens long")).count() == 0


TEXTS, TARGETS = "id long, source string, n_tokens long", "source string, target_share double, max_repeats int"


def test_mixture_reaches_shares_within_caps(spark):
    rng = np.random.default_rng(2)
    rows = [(i, s, int(t)) for i, (s, t) in enumerate(zip(rng.choice(["a"] * 6 + ["b"] * 2 + ["c"], 3000), rng.integers(5, 900, 3000)))]
    rows += [(90001, None, 50), (90002, "other", 50), (90003, "a", 0)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("gone", 0.05, 3), (None, 0.1, 1)]
    m = mixing.Mixture(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(targets, TARGETS))
    copies = m.copies.collect()
    cap = {"a": 1, "b": 2, "c": 4}
    assert all(0 < r.copies <= cap[r.source] for r in copies) and len({r.id for r in copies}) == len(copies)
    report = {r.source: r for r in m.report().collect()}
    assert set(report) == {"a", "b", "c", "gone"} and report["gone"].share == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(report[s].share - share / 0.95) < 0.002
    # the largest mixture: some source is used up to its cap
    tokens = {s: sum(t for _, x, t in rows if x == s) for s in cap}
    assert any(report[s].n_tokens == cap[s] * tokens[s] for s in cap)


def test_mixture_of_given_size_and_of_nothing(spark):
    rows = [(i, "ab"[i % 2], 10 + i % 90) for i in range(2000)]
    m = mixing.Mixture(spark.createDataFrame(rows, TEXTS), spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 1)], TARGETS), total=20_000)
    got = {r.source: r.n_tokens for r in m.report().collect()}
    assert abs(got["a"] - 5_000) <= 100 and abs(got["b"] - 15_000) <= 100
    none = mixing.Mixture(spark.createDataFrame([], TEXTS), spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert none.copies.count() == 0 and none.report().first().share == 0
    assert mixing.Mixture(spark.createDataFrame(rows, TEXTS), spark.createDataFrame([], TARGETS)).copies.count() == 0


def test_isotonic_is_monotone_and_least_squares():
    s, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    f = _boosting.isotonic(s, y, np.ones(5))
    assert np.allclose(f(s), [0, 0.5, 0.5, 1, 1])


def test_boosting_separates_what_a_tree_can():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    t = _boosting.fit(x[:400], y[:400], np.ones(400), np.zeros(400))
    assert ((t.margin(x[400:]) > 0) == y[400:]).mean() > 0.95


@pytest.mark.parametrize("text, word", [("du I.d.i.o.t", "idiot"), ("you 1d10t", "idiot"), ("A r s c h l o c h", "arschloch"), ("m0r0n", "moron"), ("creeeetin", "cretin"), ("t*****l", "trottel"), ("a p r i c k", "prick"), ("ARSCHLÖCHER", "arschlocher")])
def test_obfuscation_is_undone(text, word):
    tokens, _ = abuse.words(text)
    assert word in tokens


def test_features_are_defined_for_any_text():
    for t in (None, "", "   ", "a" * 200_000, "! " * 50_000, "<p>x</p>", "😀 du Idiot"):
        assert np.isfinite(abuse.features(t, abuse.NOTHING)).all()
    assert not abuse.features(None, abuse.NOTHING).any()


def test_quoting_and_sober_use_weigh_less():
    """They are features beside those of all sentences, and no word takes away what others count."""
    plain = lambda t: abuse.features(t, abuse.NOTHING)[abuse.AIMED]
    any_ = lambda t: abuse.features(t, abuse.NOTHING)[abuse.AIMED - abuse.VALUES]
    assert plain("Du bist ein Idiot, Meier.") > plain("Das Wort 'Idiot' steht im Beispiel.") == 0 < any_("Das Wort 'Idiot' steht im Beispiel.")
    assert plain("I will break your jaw.") > plain("The thief was taken to hospital with a broken jaw.")
    assert any_("You idiot, the word is wrong.") == plain("You idiot.")


def test_held_out_accuracy(spark, data):
    """Judged documents at a larger size: half of them fitted, the other half scored."""
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/documents.parquet")
    labels = spark.read.parquet(data.replace("sf0.001", "sf0.1") + "/doc_labels.parquet")
    texts, y, w = abuse.judged(docs, labels)
    half = np.arange(len(texts)) % 2 == 0
    model = abuse.train([t for t, h in zip(texts, half) if h], y[half], w[half])
    s = model.score([t for t, h in zip(texts, half) if not h])
    truth = y[~half] > 0.5
    pos, neg = s[truth], s[~truth]
    auc = (pos[:, None] > neg[None]).mean() + (pos[:, None] == neg[None]).mean() / 2
    assert auc > 0.8  # a tenth of the judgements is wrong
    found = s >= abuse.THRESHOLD
    assert (found & truth).sum() >= 0.6 * found.sum() and (found & truth).sum() >= 0.5 * truth.sum()


def test_judged_texts_are_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, "x", None) for i in range(50)], "doc_id long, abusive int, annotator string, judged_at timestamp_ntz")
    monkeypatch.setattr(abuse, "MAX_BYTES", 1234)
    assert len(abuse.judged(docs, labels)[0]) == 12


def test_scores_and_rates(spark):
    docs = spark.createDataFrame([(1, "Du bist ein widerlicher Idiot, verpiss dich.", "a", 1.0), (2, None, "a", 1.0), (3, "Der Rat tagt heute.", None, 1.0), (3, "Der Rat tagt heute.", None, 1.0), (None, "", "b", 1.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, 1, "x", None), (1, 1, "x", None), (3, 0, "y", None), (3, None, "y", None), (None, 1, "z", None)], "doc_id long, abusive int, annotator string, judged_at timestamp_ntz")
    got = abuse.scores(docs, labels)
    assert got.count() == 5 and got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where("doc_id = 1").first().score > got.where("doc_id = 3").first().score
    rates = {r.source: r.n_documents for r in abuse.rates(got).collect()}
    assert rates == {"a": 2, None: 2, "b": 1}
    assert abuse.scores(docs, labels.where("doc_id = 77")).count() == 5
    assert abuse.scores(docs.where("doc_id = 77"), labels).count() == 0


def test_words_of_both_languages_count_in_the_english_sense_only():
    """'die', 'Rat' and 'rot' are harmless German words; as English ones they are listed."""
    assert not abuse.features("Der Rat und die Leitung liessen die Wand rot streichen.", abuse.NOTHING)[: abuse.VALUES].any()
    assert [w for w, _ in abuse.listed(["you", "should", "die", "you", "rat"])] == [0, 2, 3, 4]


def test_scores_are_those_of_all_documents():
    """Of the judged half were abusive, of all hardly any: what was even among judged texts is no case among all, what was certain stays one."""
    steps = _boosting.Steps(np.linspace(-3, 3, 7), np.linspace(0.04, 0.96, 7))
    model = abuse.Model(abuse.NOTHING, abuse.Start(np.zeros(3)), _boosting.Trees(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2))), steps, 0.5)
    rare = abuse.among_all(model, np.r_[np.full(970, 0.04), np.full(30, 0.96)]).calibration
    same = abuse.among_all(model, np.r_[np.full(500, 0.04), np.full(500, 0.96)]).calibration
    assert rare(0.0) < 0.1 < 0.45 < same(0.0) < 0.55 and rare(3.0) > 0.9 and rare(-3.0) < 0.01
    assert (np.diff(rare.value) >= 0).all()
    assert abuse.among_all(model, np.zeros(0)).calibration(0.0) == pytest.approx(0.5)


def test_wrong_judgements_far_off_count_little():
    g, h = _boosting.slopes(np.array([-8.0, -1.0, 0.0, 40.0, -40.0]), np.array([1.0, 1.0, 1.0, 0.0, 1.0]), np.ones(5), 0.04)
    assert abs(g[0]) < 0.02 < 0.4 < abs(g[1]) and np.isfinite(g).all() and (h >= 0).all()
    g, h = _boosting.slopes(np.array([-2.0]), np.array([1.0]), np.ones(1), 0.0)
    assert np.allclose([g[0], h[0]], [1 / (1 + np.exp(2.0)) - 1, 1 / (1 + np.exp(2.0)) / (1 + np.exp(-2.0))])


def test_harmless_mention_of_a_group_is_no_case(spark):
    """Names that mostly occur in abuse also occur in harmless sentences, some judgements are wrong and abusive texts are judged more often than others."""
    rng = np.random.default_rng(4)
    names = ["Talmarer", "Ostrenen", "Kulvaner", "Bridasen"]
    bad = ["Die {} gehören alle vergast", "Die {} sind Ungeziefer", "Werft die {} endlich aus dem Land", "Kein Mensch braucht die {}", "Die {} stinken und klauen", "Jagt die {} in den Fluss"]
    good = ["Die {} feierten ihr Erntefest mit Musik", "Unsere Gruppe lud die {} zum Tee ein", "Die {} haben eine neue Schule gebaut"]
    filler = ["rat", "plan", "markt", "amt", "hafen", "bericht", "strasse", "brücke", "haus", "verein", "vertrag", "kasse", "wald", "schiff", "mühle", "steuer"]
    docs, labels, truth = [], [], set()
    for i in range(6000):
        kind = rng.random()
        parts = [f"Der {rng.choice(filler)} und die {rng.choice(filler)} prüften den {rng.choice(filler)}" for _ in range(rng.integers(1, 6))]
        if kind < 0.06:
            parts.insert(int(rng.integers(len(parts) + 1)), str(rng.choice(bad if kind < 0.03 else good)).format(rng.choice(names)))
        if kind < 0.03:
            truth.add(i)
        docs.append((i, ". ".join(parts) + ".", "a"))
        if rng.random() < (0.4 if kind < 0.03 else 0.06):
            labels.append((i, int((kind < 0.03) != (rng.random() < 0.04)), "x", None))
    got = abuse.scores(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, abusive int, annotator string, judged_at timestamp_ntz"))
    found = {r.doc_id for r in got.where(f"score >= {abuse.THRESHOLD}").collect()}
    assert len(found & truth) >= 0.9 * len(truth) and len(found & truth) >= 0.9 * len(found), (len(truth), len(found), len(found & truth))
