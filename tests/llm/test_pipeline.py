"""The pipeline's stages, each against plain Python on its own input, and the registered queries against their SQL."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from jobvigil.llm import ngram_join, oracle, queries
from tests.compare import database, difference
from tests.llm import brute
from tests.llm.test_operators import ODD, plain_groups


@pytest.mark.parametrize("name", list(oracle.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    ours = contract.queries()[name](spark, sf_dir).toPandas()
    assert difference(ours, database(sf_dir).execute(contract.oracle_sql()[name]).df()) is None


def test_every_operator_is_registered():
    assert [q for q in contract.queries() if q.startswith("op") or q == "pipeline"] == [*queries.QUERIES, "pipeline"]
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{number}")
        seen.append(spark.read.parquet(f"{tmp_path}/{number}"))
    rows = [[r.asDict() for r in s.collect()] for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    before, language, single, clean, mixed, packed = rows
    assert {r["doc_id"] for r in before if any(map(str.isalpha, r["text"] or ""))} == {r["doc_id"] for r in language}
    groups = plain_groups([(r["doc_id"], r["text"]) for r in language], ngram_join.Likeness())
    assert sorted(r["doc_id"] for r in single) == sorted({g[2] for g in groups})
    assert len(clean) == len(single) and not any(brute.base_spans(r["text"]) for r in clean)
    untouched = {r["doc_id"]: r["text"] for r in single if not brute.base_spans(r["text"])}
    assert all(untouched.get(r["doc_id"], r["text"]) == r["text"] and r["n_chars"] == len(r["text"]) for r in clean)
    assert {r["doc_id"] for r in mixed} == {r["doc_id"] for r in clean} and len(mixed) > len(clean)
    assert sum(r["doc_tokens"] for r in packed if r["start"] == 0) == sum(r["length"] for r in packed)
    assert sum(r["start"] == 0 for r in packed) == len(mixed)


def test_unlike_texts_under_one_id_stay_and_like_ones_do_not(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, long), (2, long + " end"), (2, long), (3, long + " fin"), (4, "a b c d e f g"), (5, "x"), (None, "x"), (None, "x")]
    seen = set()
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        docs = spark.createDataFrame([(*r, "v", 1) for r in order], "doc_id long, text string, Version string, copy int").coalesce(2)
        out = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
        assert out.columns == docs.columns
        seen.add(tuple(sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()))))
    assert len(seen) == 1
    kept = seen.pop()
    assert [k for k, _ in kept] == [0, 0, 1, 1, 2, 5] and {t for k, t in kept if k == 1} == {"a b c d e f g", "h i j k l m n"}


def test_stages_take_odd_rows_and_none(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, component_id int, whole string"
    odd = spark.createDataFrame([(*r, 1, 2, "w") for r in ODD], schema)
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert (out.count() > 0) == (frame is odd), name
            assert name == "pack" or out.columns == frame.columns
