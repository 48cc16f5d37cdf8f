import gzip
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.sources import corpora, encoders, predictions, results, stores, treebank
from tessera.streaming import imports

TSV = """DATA_SOURCE\tFRAME_ID\tTOKENIZED_SENTENCE\tGLOBAL_SENTENCE_ID\tLU_INDEX\tLU_INDEX_PART\tLU\tLU_LEMMA\tLU_LEMMA_PART\tLU_LEMMA_FULL\tsplit
A\tGiving\tEr gibt ihr das Buch\ts1\t1\t\tgibt\tgeben\t\tgeben\ttrain
A\tmade1-salsa\tSie gab auf\ts2\t1\t2.0\tgab auf\tgeben\tauf\taufgeben\tdev
B\t\tKeiner sagte "nichts"\ts3\t1\t7,8.0\tsagte\tsagen\t\t\ttest
"""


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tsv_round_trip(spark, tmp_path):
    rows = corpora.read(spark, "tsv", write(tmp_path / "a.tsv", TSV))
    r = {x.global_sentence_id: x for x in rows.collect()}
    assert r["s1"].tokenized_sentence == ["Er", "gibt", "ihr", "das", "Buch"] and r["s1"].lu_index == [1] and r["s1"].lu_index_part == [] and r["s1"].lu_lemma_part == ""
    assert r["s2"].lu_index_part == [2] and r["s3"].lu_index_part == [7, 8]
    corpora.write_tsv(rows, str(tmp_path / "out"))
    again = corpora.read_tsv(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    assert corpora.read_tsv(spark, str(tmp_path / "a.tsv"), split="dev", columns=["split"], rows=2).collect() == [("dev",)] * 2
    with pytest.raises(ValueError):
        corpora.read(spark, "nothing", "x")


def test_preparing_a_corpus(spark):
    df = spark.createDataFrame([(1, "Giving", "train", "7.0"), (2, "x-salsa", "train", ""), (3, "x-salsa", "dev", None), (4, None, None, "1")], "i int, frame_id string, split string, lu_index_part string")
    got = {r.i: (r.fixed_label, r.lu_index_part) for r in corpora.prepare_salsa(df).collect()}
    assert got == {1: ("FGiving", "7"), 4: (None, "1")}
    assert {r.i for r in corpora.prepare_salsa(df, proto_only_in_train=True).collect()} == {1, 3, 4}
    moved = corpora.with_train_only_frames_in_eval(spark.createDataFrame([(f"f{i}", "train") for i in range(200)] + [("g", "test"), ("g", "train")], "frame_id string, split string"))
    assert 60 < moved.where("split = 'test' and frame_id <> 'g'").count() < 140 and moved.where("frame_id = 'g' and split = 'train'").count() == 1


def test_alternative_split_and_lists(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "i int, data_source string").withColumn("split", F.lit("x"))
    wide = spark.createDataFrame([("A", "dev"), ("A", "test"), ("B", "train")], "data_source string, `3` string")
    assert {r.i: r.split for r in corpora.alternative_split(rows, wide, "3").collect()} == {1: "dev", 2: "train", 3: "train"}
    assert {r.i for r in corpora.alternative_split(rows, wide, "3", remove=True).collect()} == {1}
    path = write(tmp_path / "s.txt", "Training: a b  c\nTest: d\n\n")
    assert {tuple(r) for r in corpora.read(spark, "splits", path).collect()} == {("Training", "a"), ("Training", "b"), ("Training", "c"), ("Test", "d")}


def test_running_numbers(spark):
    got = corpora.numbered(spark.range(1000).selectExpr("id * 7 % 1000 as id"), "id").orderBy("id").collect()
    assert [r.c for r in got] == list(range(1000))


def block(lu, rows):
    return f"# SOURCE=news SID=4 LU={lu} LUID=9 FRAMENAME=Giving FRAMEID=5\n" + "\n".join("\t".join([str(i), form] + ["_"] * 11 + [frame, "O"]) for i, (form, frame) in enumerate(rows))


def test_blocks(spark, tmp_path):
    path = write(tmp_path / "b.conll", "\n\n".join([block("give.v", [("b'He'", "_"), ("gave", "Giving"), ("it", "_")]), block("book.n", [("book", "Text")])]) + "\n\n")
    r = corpora.read(spark, "blocks", path).collect()
    assert len(r) == 1 and r[0].tokens == ["He", "gave", "it"] and r[0].lu_index == [1] and r[0].lu == "give.v" and r[0].framename == "Giving" and r[0].source == "news"


def test_conllu(spark, tmp_path):
    line = lambda i, form, lemma, pos: "\t".join([i, form, lemma, pos] + ["_"] * 6)
    text = "# sent_id = w1\n# text = x\n" + "\n".join([line("1-2", "zum", "_", "_"), line("1", "Er", "er", "PRON"), line("2", "geht", "gehen", "VERB"), line("3", "sagt", "sagen", "VERB")]) + "\n\n"
    got = corpora.read(spark, "conllu", write(tmp_path / "c.conllu", text)).collect()
    assert {(r.sent_id, tuple(r.lu_index), r.lu_lemma, r.frame_label) for r in got} == {("w1", (1,), "gehen", "<unk>"), ("w1", (2,), "sagen", "<unk>")}
    assert got[0].tokens == ["Er", "geht", "sagt"]


def test_sentence_xml(spark, tmp_path):
    text = """<?xml version="1.0"?><doc><sentence ID="1"><text>He gave it</text>
    <annotationSet ID="2" status="UNANN"><layer name="PENN"><label name="prp" start="0" end="1"/></layer></annotationSet>
    <annotationSet ID="3" frameName="Giving" luName="give.v" status="MANUAL"><layer name="Target"><label name="Target" start="3" end="6"/></layer><layer name="FE"><label name="Donor" start="0" end="1"/></layer></annotationSet>
    <annotationSet ID="4" frameName="Giving" luName="give.v" status="MANUAL"><layer name="Target"><label name="Target" start="3" end="6"/></layer></annotationSet>
    </sentence></doc>"""
    got = corpora.read(spark, "xml", write(tmp_path / "f.xml", text)).collect()
    assert [(r.id, r.text, r.target_start, r.target_end, r.frame, r.lu) for r in got] == [(1, "He gave it", 3, 6, "Giving", "give.v")]


def test_treebank_targets(spark, tmp_path):
    text = """<corpus><body><s id="s1"><graph><terminals><t id="s1_1" word="Sie" lemma="sie" pos="PPER"/><t id="s1_2" word="gab" lemma="geben" pos="VVFIN"/><t id="s1_3" word="auf" lemma="auf" pos="PTKVZ"/></terminals>
    <nonterminals><nt id="s1_500"><edge idref="s1_2"/><edge idref="s1_501"/></nt><nt id="s1_501"><edge idref="s1_3"/><edge idref="s1_500"/></nt></nonterminals></graph>
    <sem><frames><frame id="f1" name="Giving_up"><target lemma="aufgeben"><fenode idref="s1_500"/></target></frame><frame id="f2" name="None"><target lemma="x"><fenode idref="missing"/></target></frame></frames></sem></s></body></corpus>"""
    got = treebank.targets(treebank.read_graphs(spark, write(tmp_path / "t.xml", text))).collect()
    assert [(r.sentence_id, r.frame, r.lu_index, r.lu_index_part, r.lu_lemma, r.lu) for r in got] == [("s1", "Giving_up", [1], [2], "aufgeben", "gab auf")]


def test_predictions_match_by_text_then_by_unknown_tokens(spark, tmp_path):
    rows = lambda words, at, frame: "\n".join("\t".join([str(i), w, frame if i == at else "_", "O"]) for i, w in enumerate(words))
    with gzip.open(tmp_path / "p.conll.gz", "wt") as f:
        f.write("\n\n".join([rows(["He", "GAVE", "it"], 1, "Giving"), rows(["[UNK]", "said", "so"], 1, "Saying")]) + "\n\n")
    inst = spark.createDataFrame([(1, ["he", "gave", "it"], [1]), (2, ["Mo", "said", "so"], [1]), (3, ["x"], [0]), (4, None, None)], "id long, tokens array<string>, lu_index array<int>")
    names = corpora.read(spark, "labelmap", write(tmp_path / "m.tsv", "Giving\tF1\t3\n"))
    got = {r.id: (r.label, r.matched_by) for r in predictions.match(inst, predictions.read_predictions(spark, str(tmp_path / "p.conll.gz")), names, "none").collect()}
    assert got == {1: ("F1", "text"), 2: ("Saying", "unknown tokens"), 3: ("none", "default"), 4: ("none", "default")}


def test_stores(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, global_id string")
    have = rows.where("global_id = 'b'")
    assert [tuple(r) for r in stores.new_rows(rows, have, "global_id", "id").collect()] == [(1, "a")]
    assert stores.new_rows(rows, rows, "global_id", "id").count() == 0
    assert stores.new_links(rows.union(rows), have).count() == 3
    upd = spark.createDataFrame([("a", None), ("c", "new")], "k string, v string")
    old = spark.createDataFrame([("a", "kept"), ("b", "x")], "k string, v string")
    assert {tuple(r) for r in stores.overlay(old, upd, "k", ["v"]).collect()} == {("a", "kept"), ("b", "x"), ("c", "new")}
    keys = spark.createDataFrame([("a",), ("c",)], "k string")
    assert [r.v for r in stores.back_off(keys, old, upd, "k").orderBy("k").collect()] == ["kept", "new"]
    assert stores.present(keys, old, "k").count() == 1 and stores.without(old, keys, "k").count() == 1


def test_encoders(spark):
    rows = spark.createDataFrame([(1, ["Er", "gibt", "auf"], [1], [2]), (2, None, [0], None), (3, ["a"], [], None), (None, ["a"], [0], None)], "id long, tokens array<string>, lu_index array<int>, lu_index_part array<int>")
    one = encoders.extract(rows, encoders.hash_encoder(16)).collect()
    assert [r.key for r in one] == [1] and np.isclose(np.linalg.norm(one[0].embedding), 1, atol=1e-5)
    first = encoders.extract(rows, encoders.hash_encoder(16, pooling="first")).first().embedding
    assert first != one[0].embedding != encoders.extract(rows, encoders.hash_encoder(16), masked=True).first().embedding
    store = encoders.extract(rows, encoders.random_encoder(16))
    assert store.count() == 1 and encoders.extract_missing(rows, store, encoders.random_encoder(16)).count() == 0
    assert rows.select(encoders.masked_tokens("tokens", "lu_index").alias("t")).first().t == ["Er", "[MASK]", "auf"]


def test_stream_imports_each_identity_once(spark, tmp_path):
    schema = "id long, global_id string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema).write.parquet(src)
    imports.import_stream(spark, src, schema, out, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([(4, "b"), (5, "c")], schema).write.mode("append").parquet(src)
    imports.import_stream(spark, src, schema, out, str(tmp_path / "c")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a"), (3, "b"), (5, "c")]


def test_windowed_counts(spark, data):
    got = imports.windowed_counts(spark.read.parquet(f"{data}/events.parquet"), "ts", "event_type", "1 day")
    assert got.selectExpr("sum(count)").first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.25, None)], "name string, f double, n int")
    assert json.loads(results.render(df, "json")) == [{"name": "a_b", "f": 0.25, "n": None}]
    assert r"a\_b & 0.2500" in results.render(df, "latex") and results.render(df).splitlines()[1].split() == ["a_b", "0.2500"]
    out = io.StringIO()
    assert results.write_rows(df, out) == 1 and out.getvalue() == "name\tf\tn\na_b\t0.25\t\n"
    results.write_clustering(spark.createDataFrame([("c", 1)], "cluster_label string, instance_id long"), str(tmp_path / "cl"), "x", {"a": 1})
    assert corpora.read(spark, "clusterings", str(tmp_path / "cl")).first().clusterlabel == "c"


def test_command_line(spark, data, capsys):
    assert cli.main(["queries"]) == 0 and "leaderboard" in capsys.readouterr().out
    assert cli.main(["query", "status_counts", data]) == 0 and "finished" in capsys.readouterr().out
    assert cli.main(["results", data]) == 0 and "softmax" in capsys.readouterr().out
    assert cli.main(["grid", '{"hyperparameters": [{"key": ["local", "alpha"], "values": [1, 2]}]}']) == 0 and len(json.loads(capsys.readouterr().out)["runs"]) == 2


def test_reports_of_the_command_line(spark, data, capsys, tmp_path):
    from tessera import cli
    from tessera.plans.queries import QUERIES

    assert {q for reports in cli.REPORTS.values() for q in reports.values()} <= set(QUERIES)
    assert cli.main(["data", "list", data]) == 0
    assert "salsa2.0-default" in capsys.readouterr().out
    assert cli.main(["delete", data, str(tmp_path / "left"), "--experiment", "1003"]) == 0
    assert spark.read.parquet(str(tmp_path / "left")).where("experiment_id = 1003").count() == 0
    assert cli.main(["inspect", '{"hyperparameters":[{"key":["local","alpha"],"values":[0.1,0.2]}]}', '{"hyperparameters":[{"key":["local","alpha"],"values":[0.2]}]}']) == 0
    out = capsys.readouterr().out
    assert '"extra": []' in out and out.count("@") == 1


def test_appending_keeps_each_key_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "key long, v string")
    assert stores.append_new(rows, path, "key") == 2 and stores.append_new(rows, path, "key") == 0
    assert stores.append_new(spark.createDataFrame([(2, "x"), (3, "c")], "key long, v string"), path, "key") == 1
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    stores.append_log(spark, str(tmp_path / "log"), "run", ["one", "two"])
    stores.append_log(spark, str(tmp_path / "log"), "run", ["three"])
    assert sorted(r.message for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["one", "three", "two"]


def test_parts_and_names_of_datasets(spark, tmp_path):
    for name, text in (("train", "a: 1 2\n"), ("dev", "b: 3\n")):
        (tmp_path / name).write_text(text)
    got = corpora.read_parts(spark, "splits", {n: str(tmp_path / n) for n in ("train", "dev")})
    assert sorted(map(tuple, got.collect())) == [("a", "1", "train"), ("a", "2", "train"), ("b", "3", "dev")]
    names = corpora.dataset_names({"fn1.7": "eng", "salsa2.0": "deu"}, {"fn1.7": 150})
    assert len(names) == 152 and names["fn1.7-altsplit-149"] == "eng" and names["salsa2.0-default"] == "deu"


def test_identifiers_and_json(spark):
    from tessera.functions import json, times
    from tessera.plans import experiments

    assert experiments.parse_identifier("##local@latest") == {"own": True, "identifier": "local", "version": "latest"}
    assert experiments.parse_identifier("0a1b") == {"own": False, "identifier": "0a1b", "version": None}
    with pytest.raises(ValueError):
        experiments.parse_identifier("a@b@c")
    df = spark.createDataFrame([('{"a":{"b":[1,2]},"c":1}', "[1,\"x\",{\"y\":2}]"), ("nope", "{}"), (None, None)], "j string, l string")
    r = df.select(json.set_key("j", "c", F.lit("x")).alias("s"), json.elements("l").alias("e"), times.age(F.lit(90_061)).alias("age"), times.age(F.lit(59)).alias("short")).collect()
    assert r[0].s == '{"a":{"b":[1,2]},"c":"x"}' and r[0].e == ["1", '"x"', '{"y":2}'] and r[1].s is None and r[2].s is None and r[2].e is None
    assert r[0].age == "1 day 01:01:01" and r[0].short == "00:00:59"


def test_annotations_have_tokens_targets_and_roles(spark, tmp_path):
    layer = lambda name, *labels: f'<layer name="{name}">' + "".join(f'<label name="{n}" start="{a}" end="{b}"/>' for n, a, b in labels) + "</layer>"
    pos = layer("PENN", ("pp", 0, 1), ("vv", 3, 7), ("dt", 9, 11), ("nn", 13, 17), ("in", 19, 20))
    role = layer("FE", ("Agent", 0, 1), ("Theme", 9, 17)) + layer("Target", ("Target", 3, 7), ("Target", 19, 20))
    sets = f'<annotationSet ID="1" status="UNANN">{pos}</annotationSet><annotationSet ID="7" frameName="Giving" luName="hand in.v" status="MANUAL">{role}</annotationSet>'
    sets += '<annotationSet ID="8" frameName="Other" luName="x.v" status="MANUAL"><layer name="Target"/></annotationSet>'
    path = write(tmp_path / "a.xml", f'<doc><sentence ID="5"><text>He hands the paper in .</text>{sets}</sentence></doc>'.replace("hands the paper", "hands the paper"))
    got = corpora.read(spark, "annotations", path).collect()
    assert len(got) == 1 and got[0].annotation_id == 7 and got[0].tokens == ["He", "hands", "the", "paper", "in"]
    assert got[0].lu_index == [1, 4] and got[0].bios == ["B-Agent", "O", "B-Theme", "I-Theme", "O"] and got[0].lu == "hand in.v"
    none = spark.createDataFrame([(7,)], "annotation_id long")
    assert corpora.read(spark, "annotations", path, exclude=none).count() == 0
