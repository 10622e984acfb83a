"""The pipeline's stages, each against a brute-force judge of its own input."""

import sys

import corpus_pipeline as pipeline

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_matching import brute_components, brute_contamination, brute_passages, plain_simhash
from test_tokens import check_pieces


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    outputs = [docs]
    for k, (_, function) in enumerate(pipeline.STAGES):
        function(spark, outputs[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        outputs.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(o.columns == columns for o in outputs[:-1])
    raw, ruled, single, cut, clean, pieces = outputs
    texts = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    from foliant.llm.rules import judge

    assert set(texts(ruled)) == {r["doc_id"] for r in judge(raw).where("kept").collect()}
    component = brute_components({k: plain_simhash(t) for k, t in texts(ruled).items()})
    assert set(texts(single)) == set(component.values())
    before, after = texts(single), texts(cut)
    assert set(before) == set(after) and all(len(after[k]) <= len(before[k]) for k in before)
    held = {k for k, _, _ in brute_passages(before.items())}
    assert all(before[k] == after[k] for k in before if k not in held)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(texts(clean)) == {r[0] for r in brute_contamination(after.items(), items) if not r[-1]}
    check_pieces(list(texts(clean).items()), pieces.collect())


def test_run_equals_stages(spark, sf_dir):
    found = pipeline.run(spark, sf_dir)
    assert found.count() > 0 and "sequence_id" in found.columns


def test_stages_on_odd_and_empty_tables(spark, odd_rows, no_rows, sf_dir):
    rows = [tuple(r) for r in odd_rows.collect()]
    functions = [f for _, f in pipeline.STAGES]
    for function in functions[:4]:
        kept = function(spark, odd_rows, sf_dir)
        assert kept.columns == odd_rows.columns
        assert all(tuple(r) in rows for r in kept.collect())
        assert function(spark, no_rows, sf_dir).count() == 0
    assert {r["doc_id"] for r in functions[0](spark, odd_rows, sf_dir).collect()} <= {4}
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in functions[1](spark, odd_rows, sf_dir).collect() if r["doc_id"] != 4) == sorted([(0, "no id here"), (1, "alpha beta gamma"), (1, "same id, other text"), (2, ""), (6, "ß Ünï 日本 \U0001f600 x\x00y")])
    assert functions[2](spark, odd_rows, sf_dir).count() == functions[3](spark, odd_rows, sf_dir).count() == len(rows)
    check_pieces([r[:2] for r in rows], functions[4](spark, odd_rows, sf_dir).collect())
    assert functions[4](spark, no_rows, sf_dir).count() == 0
