import corpus_pipeline
from mailspark.llm import queries
from mailspark.llm.common import read

SMALL = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = read(spark, SMALL, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= before and len({r["doc_id"] for r in rows}) == len(rows), name
        docs, before = spark.createDataFrame(rows, docs.schema), len(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in docs.collect())


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output",
    ]
