"""The stages one after the other against a plain reading of what each should do."""

import random

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import corpus_pipeline


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import pandas as pd

    r = random.Random(11)
    at = tmp_path_factory.mktemp("sf")
    make = lambda n: " ".join("".join(r.choice(["the", "an", "ing", "er"]) for _ in range(3)) for _ in range(n))
    item, line = make(40), "this line stands in many documents"
    base = make(80)
    texts = [base, base + " more", base, make(50) + " " + item + " " + make(10), make(60) + "\n" + line, make(60) + "\n" + line, "123 !!", None, "", make(70)]
    docs = pd.DataFrame({"doc_id": range(10), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t or "") for t in texts]})
    docs.to_parquet(at / "documents.parquet")
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(at / "benchmark.parquet")
    return str(at), line


def test_stages(spark, folder):
    at, line = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at).cache()
        assert docs.columns == columns, name
        seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(seen[0]) == {0, 1, 2, 3, 4, 5, 9}
    assert seen[1][5].endswith(line) is False and seen[1][4].endswith(line) and seen[1][2] == ""
    assert 1 not in seen[2] and 0 in seen[2] and 3 in seen[2]
    assert 3 not in seen[3] and {0, 4, 5, 9} <= set(seen[3])
    made = corpus_pipeline.run(spark, at).toPandas()
    assert set(made.doc_id) == set(seen[3]) and made.groupby("doc_id").length.sum().eq(made.groupby("doc_id").doc_tokens.first()).all()


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert pq  # the fixture's writer


def test_odd_rows(spark, tmp_path):
    """Null and repeated ids, columns whose names clash with those of the stages, a long text, and an empty table."""
    at = str(tmp_path)
    r = random.Random(7)
    make = lambda n: " ".join("".join(r.choice(["the", "an", "ing", "er"]) for _ in range(3)) for _ in range(n))
    long = make(60_000)
    rows = [(None, make(40)), (None, make(40)), (3, make(50)), (3, make(50)), (4, long), (5, long), (6, None), (7, "")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, score string, n_lines int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", 1) for i, t in rows], kind)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    own = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, at)
        assert own.columns == docs.columns, name
    made = corpus_pipeline.run(spark, at).toPandas()
    whole = made[made.start == 0].doc_id
    assert sorted(whole.dropna().astype(int)) == [3, 3, 4, 5] and whole.isna().sum() == 2
    docs.limit(0).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
