import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import review
from tessera.sources import files, turtle


@pytest.fixture
def tree(tmp_path):
    seg = [{"id": "a", "start": 0, "end": 1.5, "text": " x "}, {"id": None, "start": 2, "end": 3, "text": "y"}]
    for series, rec, names in (("B", "B-1", ("v0.json", "v1.json", "v2.json", "v3.json")), ("A", "A-1", ("v0.json",)), ("Z", "Z-1", ("v1.json",))):
        d = tmp_path / "rec" / series / rec
        d.mkdir(parents=True)
        for n in names:
            (d / n).write_text(json.dumps(seg if n != "v3.json" else {"segments": seg}), encoding="utf-8-sig")
    ents = {"ayat": [{"surah_number": 1, "ayah_number": "2", "text": "t", "start": 0.25, "usage": "quotation"}, {"text": " "}], "topics": [{"name": "N", "start": 0, "end": 1}, {"name_en": " "}], "headings": [{"title_en": "H"}]}
    (tmp_path / "rec/B/B-1/e1.json").write_text(json.dumps(ents))
    (tmp_path / "rec/B/B-1/e2.json").write_text(json.dumps({"dua": []}))
    (tmp_path / "rec/A/A-1/e1.json").write_text("{}")
    return tmp_path


def test_discovery_and_flags(spark, tree):
    r = files.discover(spark, str(tree / "rec"), ["Z", "B"])
    assert [x.recording for x in r.collect()] == ["Z-1", "B-1", "A-1"]
    got = {x.recording: x for x in files.buildable(r, spark.createDataFrame([("B-1",)], "recording string")).collect()}
    assert got["B-1"].can_graph and got["B-1"].reviewable and not got["A-1"].can_graph and got["A-1"].can_correct and not got["A-1"].corrected


def test_texts(spark, tree, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.json").write_text(json.dumps([{"text": " a "}, {"text": "b"}]))
    (d / "b.json").write_text(json.dumps({"text": "whole  text"}))
    (d / "c.json").write_text(json.dumps({"segments": []}), encoding="utf-8-sig")
    assert {r.path[-6:]: r.text for r in files.read_texts(spark, str(d)).collect()} == {"a.json": "a b", "b.json": "whole  text", "c.json": ""}
    (d / "d.json").write_text("{}")
    with pytest.raises(Exception, match="no segments"):
        files.read_texts(spark, str(d)).collect()


def test_pairs_and_items(spark, tree):
    p = files.read_pairs(spark, str(tree / "rec"))
    assert [r.recording for r in p.collect()] == ["B-1"]
    rows = files.entity_rows(p, "first", "recording").collect()
    assert [(r.etype, r.n, r.surah_number, r.name_en) for r in rows] == [("ayat", 0, "1", None), ("topics", 0, None, "N"), ("headings", 0, None, None)]
    assert files.entity_rows(p, "second", "recording").count() == 0


def test_runs_configs_json(spark, tmp_path):
    d = tmp_path / "runs/R1/fast"
    d.mkdir(parents=True)
    (d / "big.json").write_text(json.dumps({"backend": "fast", "model": "big", "runtime": {"elapsed_seconds": 2.5}, "segments": [{"text": " a"}, {"text": "b "}]}))
    (d / "old.json").write_text(json.dumps({"segments": [{"text": "c"}]}))
    got = {r.model: r for r in files.read_asr_runs(spark, str(tmp_path / "runs"), ["old"]).collect()}
    assert (got["big"].recording, got["big"].backend, got["big"].elapsed_seconds, got["big"].text, got["big"].excluded) == ("R1", "fast", 2.5, "a b", False) and got["old"].excluded
    c = tmp_path / "cfg"
    c.mkdir()
    for code in "XY":
        (c / f"{code}.json").write_text(json.dumps({"series_code": code, "concept_keywords": {"k": ["w"]}, "recordings": [{"recording_id": "r"}]}, indent=1))
    (c / "X_topic_proposals.json").write_text("[]")
    assert [r.series_code for r in files.read_series_configs(spark, str(c), ["Y"]).collect()] == ["Y", "X"]
    assert files.read_json_files(spark, str(c), "series_code string").where("series_code is not null").count() == 2
    (tmp_path / "e.csv").write_text("series,recording,audio_minutes,hours\nS,R,30,2.5\n")
    assert tuple(files.read_effort(spark, str(tmp_path / "e.csv")).first()) == ("S", "R", 30.0, 2.5)


def test_caches(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, make, str(tmp_path / "c"), "a", "b").count() == 3
    files.cached(spark, make, str(tmp_path / "c"), "other")
    assert len(made) == 2
    (tmp_path / "d.ttl").write_text(":x1 a :B .\n:x2 a :B .\n")
    ids = spark.createDataFrame([("x2",), ("x1",)], "id string")
    one = files.cached_blocks(spark, str(tmp_path / "d.ttl"), ids, r"^:(x\d+)\s", str(tmp_path / "k"))
    assert one.count() == 2
    assert len(list((tmp_path / "k").iterdir())) == 1
    files.cached_blocks(spark, str(tmp_path / "d.ttl"), ids.orderBy("id"), r"^:(x\d+)\s", str(tmp_path / "k"))
    assert len(list((tmp_path / "k").iterdir())) == 1


def test_segments_and_provenance(spark, tmp_path):
    s = spark.createDataFrame([("S", "R", i, None, float(i), i + 1.0, f"t{i}") for i in (2, 0, 1)], "series string, recording string, seq int, id string, start_s double, end_s double, text string")
    files.write_segments(s, str(tmp_path / "v"), as_json=True)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 3
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "v_json")).collect()]
    assert [x["text"] for x in lines] == ["t0", "t1", "t2"] and lines[0] == {"id": None, "start": 0.0, "end": 1.0, "text": "t0"}
    path = str(tmp_path / "trace")
    files.record_stage(spark, path, "R", "V0", lambda: {"n": "3"})
    with pytest.raises(RuntimeError):
        files.record_stage(spark, path, "R", "V1", lambda: (_ for _ in ()).throw(RuntimeError("down")))
    got = {r.stage: r for r in spark.read.parquet(path).collect()}
    assert got["V0"].status == "ok" and got["V0"].detail == {"n": "3"} and got["V1"].status == "error" and "down" in got["V1"].error
    t = spark.createDataFrame([("R", 1), ("Q", 2), ("Q", 2)], "recording string, x int")
    files.open_trace(t.where("recording = 'R'"), str(tmp_path / "open"))
    files.open_trace(t, str(tmp_path / "open"))
    assert spark.read.parquet(str(tmp_path / "open")).count() == 2


def test_index_reports_and_hand_off(spark, tmp_path):
    c = spark.createDataFrame([("c1", "S", "R", [1, 2]), ("c2", "S", "R", [3])], "chunk_id string, series string, recording string, seqs array<int>")
    v = spark.createDataFrame([("c1", [1.0]), ("c2", [0.5])], "chunk_id string, v array<float>")
    c.write.parquet(str(tmp_path / "c")), v.write.parquet(str(tmp_path / "v")), v.limit(1).write.parquet(str(tmp_path / "v1"))
    assert files.concat_index(spark, str(tmp_path / "c"), str(tmp_path / "v"), str(tmp_path / "i")) == 2 and files.load_index(spark, str(tmp_path / "i"), series="S").count() == 2
    with pytest.raises(ValueError):
        files.concat_index(spark, str(tmp_path / "c"), str(tmp_path / "v1"), str(tmp_path / "j"))
    files.export_chunks(c, str(tmp_path / "csv"))
    assert {r.seqs for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {"1;2", "3"}
    assert "| c1 |" in files.write_report(c.select("chunk_id", F.lit(0.5).alias("x")), str(tmp_path / "rep"), "Chunks")
    t = spark.createDataFrame([("series", "S", 1), ("lecture", "R", 2)], "search_scope string, scope_label string, x int")
    files.write_traces(t, str(tmp_path / "tr"))
    assert {r.scope for r in spark.read.parquet(str(tmp_path / "tr")).collect()} == {"series_S", "R"}
    files.write_dictionary(spark.createDataFrame([("a", "A", "-")], "slug string, name string, alike string"), str(tmp_path / "dict"))
    assert spark.read.text(str(tmp_path / "dict")).first()[0] == "- **A** (`a`): -"
    files.write_differences(spark.createDataFrame([("x", 1)], "kind string, at int"), str(tmp_path / "diff"))
    s = spark.createDataFrame([("S", "R", 0, 0.0, 1.0, "t")], "series string, recording string, seq int, start_s double, end_s double, text string")
    e = spark.createDataFrame([("R", "dua")], "recording string, etype string")
    bad = spark.createDataFrame([("fatal", "usage"), ("warning", "w")], "severity string, rule string")
    with pytest.raises(ValueError, match="usage"):
        files.hand_off(bad, s, e, str(tmp_path / "h"))
    assert not (tmp_path / "h").exists() and files.hand_off(bad.where("severity = 'warning'"), s, e, str(tmp_path / "h")) == ["w (1)"]
    files.write_pair(s.select("series", "recording", "text"), s, str(tmp_path / "pair"))
    assert spark.read.parquet(str(tmp_path / "pair/v2")).count() == 1


def test_session_store(spark, tmp_path):
    store = files.SessionStore(spark, str(tmp_path / "s"))
    acts = [{"op": "open", "segments": [{"start": 0, "end": 1, "text": "t"}]}, {"op": "finalize"}]
    store.append(spark.createDataFrame([("a", i, json.dumps(x)) for i, x in enumerate(acts)], "session string, n long, action string"))
    assert review.fold(store.log("a")).first().finalized
    store.reopen("a")
    store.append(spark.createDataFrame([("a", 9, json.dumps({"op": "seg.edit", "uid": "s0", "text": "u"}))], "session string, n long, action string"))
    assert not review.fold(store.log()).first().finalized and review.folded_segments(store.log()).first().text == "u"


def test_turtle_round_trip(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('''@prefix : <https://tessera.example/ns#> .
PREFIX x: <http://x/>
# a comment
:a a :Thing ; :name "A \\"q\\" (b)"@en , "line\\nbreak" ;
   :n 4.5 , true ; x:to x:b, <http://y/z> .
x:b :in [ :deep "d" ; :more [ a :Leaf ] ] .
_:n1 :name "unnamed" .'''.replace("_:n1", "x:n1"))
    g = turtle.read_turtle(spark, str(tmp_path / "a.ttl"))
    got = {tuple(r) for r in g.collect()}
    assert {("a", "rdf:type", "Thing", "iri"), ("a", "name", 'A "q" (b)', "literal"), ("a", "name", "line\nbreak", "literal"), ("a", "n", "4.5", "literal"), ("a", "n", "true", "literal"), ("a", "http://x/to", "http://x/b", "iri"), ("a", "http://x/to", "http://y/z", "iri"), ("_:b1", "deep", "d", "literal"), ("_:b2", "rdf:type", "Leaf", "iri"), ("_:b1", "more", "_:b2", "iri"), ("http://x/b", "in", "_:b1", "iri")} <= got
    plain = g.where("s not like '\\_:%' and o not like '\\_:%'")
    turtle.write_turtle(plain, str(tmp_path / "out"), "https://tessera.example/ns#")
    assert {tuple(r) for r in turtle.read_turtle(spark, str(tmp_path / "out")).collect()} == {tuple(r) for r in plain.collect()}
    (tmp_path / "b.ttl").write_text(":a :b .")
    with pytest.raises(Exception):  # noqa: B017
        turtle.read_turtle(spark, str(tmp_path / "b.ttl")).collect()


def test_block_fields(spark):
    block = '''h:SB_0001 a :Hadith ;
  :grade "marfu@ar"^^xsd:string ;
  :fullText "A \\"b\\"; c@en"^^xsd:string , "0"^^xsd:string,
     "متن@ar"^^xsd:string , " "^^xsd:string ;
  :no "12" ; :url "http://x/y" .'''
    df = spark.createDataFrame([(block,), (None,), (":x a :Y .",)], "b string")
    got = [r[0] for r in df.select(files.block_fields(F.col("b"), "fullText", "no", "url")).collect()]
    assert [tuple(t) for t in got[0].texts] == [("en", 'A "b"; c'), ("ar", "متن")] and got[0].number == "12" and got[0].address == "http://x/y"
    assert got[1] is None and got[2].texts == [] and got[2].number is None
