"""Readers on small trees."""

import io
import json

import numpy as np
import pytest

from lectern.sources import readers as R
from lectern.sources import writers as W


def test_tasks_fall_back_to_open_questions(spark, tmp_path):
    d = tmp_path / "Tasks" / "open_qa" / "test"
    d.mkdir(parents=True)
    (d / "b1.json").write_text(json.dumps({"Q1": {"Question": "q", "Answers": ["a", "b"]}, "Q2": {"Question": "r", "Answers": "c"}}))
    got = {r.question_id: r for r in R.tasks(spark, str(tmp_path), "test").collect()}
    assert got["Q1"].Answers == ["a", "b"] and got["Q2"].Answers == ["c"] and got["Q1"].source_file == "b1"
    with pytest.raises(FileNotFoundError):
        R.tasks(spark, str(tmp_path), "train")


def test_books_and_metadata(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "x.cleaned.txt").write_text("one\ntwo")
    assert [tuple(r) for r in R.books(spark, str(tmp_path)).collect()] == [("x", "train", "one\ntwo")]
    for n in "ab":
        (tmp_path / f"{n}.json").write_text(json.dumps({n: {"title": n.upper()}}))
    got = R.metadata(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], "struct<title:string>")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "A"), ("b", "B")]


def test_vectors_join_metadata_by_row(spark, tmp_path):
    m = np.arange(6, dtype=np.float32).reshape(3, 2)
    buffer = io.BytesIO()
    np.save(buffer, m)
    (tmp_path / "global.npy").write_bytes(buffer.getvalue())
    (tmp_path / "meta.jsonl").write_text("\n\n".join(json.dumps({"id": i, "source_file": "s", "chunk_id": i, "embed_time": 0.1}) for i in range(4)) + "\nnot json\n")
    got = {r.id: r.embedding for r in R.embeddings(spark, str(tmp_path / "meta.jsonl"), str(tmp_path / "global.npy")).collect()}
    assert got == {i: m[i].tolist() for i in range(3)}


def test_presets_and_latex(spark):
    with pytest.raises(ValueError, match="nope"):
        R.presets(spark, '{"presets": [{"name": "a"}]}', ["nope"])
    assert W.latex(spark.createDataFrame([(1, "x")], "a int, b string")).splitlines()[1] == r"a & b \\"


def test_metrics_have_columns(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"Accuracy@1": 0.1, "Accuracy@1-5": [0.1, 0.2, 0.3, 0.4, 0.5], "Recall@10": 0.6, "MRR@10": 0.7, "NDCG@10": 0.8}))
    assert tuple(R.retrieval_metrics(spark, str(tmp_path)).first()) == (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def test_tasks_of_configs_carry_their_keys(spark, tmp_path):
    for preset in ("p", "q"):
        d = tmp_path / "d" / preset / "Tasks" / "choice_qa" / "test"
        d.mkdir(parents=True)
        (d / "b.json").write_text(json.dumps({"Q": {"Question": preset, "Answers": "a", "Options": ["a", "z"]}}))
    got = R.tasks_of(spark, str(tmp_path), [("d", "p", "test"), ("d", "q", "test")])
    assert sorted((r.dataset, r.preset, r.split, r.Question, r.Answers) for r in got.collect()) == [("d", "p", "test", "p", ["a"]), ("d", "q", "test", "q", ["a"])]
    none = R.tasks_of(spark, str(tmp_path), [])
    assert none.columns == got.columns and none.count() == 0


def test_what_a_tree_holds(spark, tmp_path):
    for kind, split in (("html_tag", "train"), ("sentence", "test"), ("sentence", "odd")):
        (tmp_path / "fixed" / "a" / "analyze_split_point" / kind / split).mkdir(parents=True)
    (tmp_path / "fixed" / "file.txt").write_text("")
    assert R.available_chunkers(spark, str(tmp_path)) == [("fixed", "a")] and R.available_chunkers(spark, f"{tmp_path}/none") == []
    assert R.available_splits(spark, str(tmp_path), "fixed", "a") == {"train", "test"} and R.available_splits(spark, str(tmp_path), "fixed", "b") == set()


def test_merged_tree_takes_the_first_split(spark, tmp_path):
    for name in ("train/x.txt", "test/x.txt", "test/sub/y.txt", "validation/sub/y.txt", "validation/z.txt", "all/z.txt", "other/w.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    got = R.merged_tree(spark, str(tmp_path)).collect()
    assert sorted((r.relative_path, r.split) for r in got) == [("sub/y.txt", "test"), ("x.txt", "train"), ("z.txt", "all")]
    assert all(r.path.endswith(f"{r.split}/{r.relative_path}") for r in got)
    assert R.merged_tree(spark, f"{tmp_path}/other").count() == 0


def test_verdicts_of_a_result_tree(spark, tmp_path):
    d = tmp_path.joinpath(*R.JUDGE_KEYS)
    d.mkdir(parents=True)
    text = json.dumps({"q1": {"verdict": "correct"}, "q2": {"verdict": "incorrect"}, "q3": {}})
    (d / "generation_results.json").write_text(text)
    (tmp_path / "generation_results.json").write_text(text)
    broken = tmp_path.joinpath(*R.JUDGE_KEYS[:-1], "other")
    broken.mkdir()
    (broken / "generation_results.json").write_text("{")
    got = R.verdicts(spark, str(tmp_path)).collect()
    assert sorted((r.split, r.judge, r.question_id, r.value) for r in got) == [("split", "judge", "q1", 1), ("split", "judge", "q2", 0)]
