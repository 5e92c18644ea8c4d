import re

import corpus_pipeline
import public_tokenizers
from llm_data import SMALL
from test_decontam import split
from test_near_copies import plain_kept
from test_spans import plain_secrets
from tokenizers import Tokenizer

from planledger.llm import quality, registry


def test_stages_against_plain_versions(spark):
    """Each stage on its own input, in plain Python but for the learnt quality scores."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    items = [split(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        assert len(after) == len(rows)
        if name == "quality classifier":
            model = quality.train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
            good = {r.doc_id for r in quality.scores(spark.read.parquet(f"{SMALL}/documents.parquet"), model).collect() if r.score >= 0.3}
            assert set(after) == good
        elif name == "SimHash near-duplicates":
            ids = sorted(before)
            assert set(after) == plain_kept(ids, [before[i].text for i in ids])
        elif name == "benchmark decontamination":
            joined = {d: f" {' '.join(split(r.text))} " for d, r in before.items()}
            leaked = {d for d, text in joined.items() if any(f" {' '.join(i)} " in text for i in items)}
            assert set(after) == set(before) - leaked
        elif name == "secret scan":
            assert set(after) == set(before)
            for d, r in after.items():
                assert not [s for s in plain_secrets(r.text or "") if s[1] > 0]
                if not plain_secrets(before[d].text or "") and "[SECRET]" not in (r.text or ""):
                    assert tuple(r) == tuple(before[d])
                assert r.n_chars == len(r.text)
        else:
            assert set(after) == set(before)
            for d, r in after.items():
                assert r.n_tokens == len(library.encode(before[d].text or "", add_special_tokens=False).ids)
            break
        assert docs.columns == columns


def test_run_is_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n in range(1, 11) if not any(re.match(rf"op{n}_", x) for x in names)] == []
    assert set(registry.QUERIES) <= set(names)
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 100


def test_odd_and_empty_tables(spark, odd, none, tmp_path):
    path = f"file://{tmp_path}"
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    for df in (odd, none):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = corpus_pipeline.written(stage(spark, docs, path), "odd")
            assert docs.columns == df.columns
        assert corpus_pipeline.encoded(spark, docs, path).count() == docs.count()
