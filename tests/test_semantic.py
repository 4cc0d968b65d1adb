"""Vectors, second ranks and claims from outside models."""

import pytest

from factloom.engine import Engine
from factloom.operators import semantic


def by_length():
    def lengths(texts):  # a closure goes to the executors by value
        assert len(texts) <= 32
        return [[float(len(t)), 1.0] for t in texts]

    return lengths


lengths = by_length()


def test_vectors_of_texts(spark):
    rows = [(str(i), "x" * i) for i in range(70)] + [("none", None)]
    got = {r["id"]: list(r["vector"]) for r in semantic.embed(spark.createDataFrame(rows, "id string, text string"), lengths, "m").collect()}
    assert got == {i: [float(len(t or "")), 1.0] for i, t in rows}
    scores = {r["id"]: r["score"] for r in semantic.semantic_scores(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0]), ("c", [0.0, 0.0])], "id string, vector array<float>"), [2.0, 0.0]).collect()}
    assert scores == {"a": 1.0, "b": 0.0, "c": 0.0}
    assert semantic.embed(spark.createDataFrame([], "id string, text string"), lengths, "m").count() == 0
    assert semantic.adapter_manifests(spark).filter("subprocess and not network").count() == 2


def test_second_ranks_and_their_failure(spark):
    rows = spark.createDataFrame([(f"e{i:02}", "symbol", "n", float(i)) for i in range(40)], "id string, kind string, name string, score double")
    asked = []

    def scorer(best):
        asked.append(best.count())
        return best.filter("id = 'e15'").select("id", semantic.F.lit(100.0).alias("score"))

    got = semantic.ranked_again(rows, scorer).collect()
    assert asked == [30] and got[0]["id"] == "e15" and got[0]["score"] == 0.2 * 15 + 500 and len(got) == 40

    def broken(best):
        raise OSError

    assert sorted(map(tuple, semantic.ranked_again(rows, broken).collect())) == sorted((r["id"], r["score"]) for r in rows.collect())


def test_claims_keep_to_their_evidence(spark):
    claims = spark.createDataFrame([("p", 5, "fast", ["a", "b"]), ("p", 7, "slow", ["a", "z", "y"]), ("p", 9, "", ["a"]), ("p", 11, "bare", None), ("q", 1, "x", ["a"])], "pack string, at int, claim string, evidence array<string>")
    known = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "a")], "pack string, id string")
    got = {(r["pack"], r["position"]): (r["unknown"], r["line"]) for r in semantic.checked_claims(claims, ["pack"], semantic.F.col("at"), "claim", "evidence", known).collect()}
    assert got == {
        ("p", 0): ([], "- fast [evidence: a, b]"), ("p", 1): (["z", "y"], None), ("p", 2): ([], None),
        ("p", 3): ([], "- bare [evidence: none (unverified)]"), ("q", 0): (["a"], None),
    }


def test_engine_with_models(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text('import b\ndef save_item():\n    """Keep it."""\n    return load_item()\ndef load_item():\n    return 1\n')
    (root / "b.py").write_text("def test_save_item():\n    pass\n")
    e = Engine(spark, str(tmp_path / "f"))
    e.index(str(root))
    assert e.embed(lengths, "m") == e.embed(lengths, "m") == e.table("entities").filter("kind in ('symbol', 'test')").count()
    assert {r["id"]: r["vector"][0] for r in e.state.read("embeddings").collect()}["symbol:a.py#save_item"] == len("save_item Keep it.")
    pack = e.task("save item", scores=e.semantic([1.0, 0.0]), scorer=lambda best: best.select("id", semantic.F.lit(0.0).alias("score")))
    ids = [r["id"] for r in pack.collect()]
    assert "symbol:a.py#save_item" in ids
    claims = spark.createDataFrame([(0, "it saves", ["symbol:a.py#save_item"])], "position int, claim string, evidence array<string>")
    text = e.task_claims(pack, claims, "tool")
    assert text.endswith("- it saves [evidence: symbol:a.py#save_item]\n") and "INFERRED" in text
    with pytest.raises(ValueError, match="unknown evidence"):
        e.task_claims(pack, claims.withColumn("evidence", semantic.F.array(semantic.F.lit("made up"))), "tool")
    assert [r["path"] for r in e.entity_sources("symbol:a.py#save_item").collect()] == ["a.py"]
    assert e.evidence_for("a.py").count() > 0 and e.imports_in("a.py").first()["module"] == "b"
    assert e.tests().first()["name"] == "test_save_item" and e.runtime_edge_rows().count() == 0 and e.entity("file:a.py").count() == 1
