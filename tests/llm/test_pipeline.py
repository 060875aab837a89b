"""The stages one by one, each on what the one before kept."""

import json
import random

import corpus_pipeline as P
from hybridqa.llm.common import table
from tests.llm.test_operators import prose


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    item = prose(rng, 40, 10**6)
    texts = [prose(rng, 120) for _ in range(12)]
    near = texts[0].split()
    near[5] = "changed"
    texts += [" ".join(near), texts[1], prose(rng, 50) + " " + item, "mail bob.77@mail1.example.com " + prose(rng, 60), "few words", None, " ".join(["same five words come again"] * 30)]
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)], schema).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 12), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").where("doc_id < 12").write.parquet(f"file://{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    docs, left = table(spark, f"file://{d}", "documents"), []
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{d}").persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
        left.append({r.doc_id for r in docs.collect()})
    everything = set(range(len(texts)))
    assert left[0] == everything - {16, 17, 18} and left[1] == left[0] - {12, 13} and left[2] == left[1] - {14} and left[3] == left[2]
    row = docs.where("doc_id = 15").first()
    assert "bob.77" not in row.text and row.n_chars == len(row.text)
    pieces = P.run(spark, f"file://{d}").collect()
    assert {r.doc_id for r in pieces} == left[3] and sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())
    assert json.dumps([n for n, _ in P.STAGES]) == json.dumps(["quality", "near_duplicates", "decontamination", "pii", "packing"])
