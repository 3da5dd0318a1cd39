"""The pipeline's stages, each on its own input, against brute force."""

from collections import Counter

import corpus_pipeline
from nearfield.llm import near_dup, quality
from nearfield.llm.common import table, written

from .test_text_ops import brute_near, brute_suffix


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert [len(names), names[0], names[-1]] == [5, "quality rules", "packing"]

    good = written(stages["quality rules"](spark, docs, sf_dir), "t")
    assert good.columns == docs.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in quality.assess(docs).where("kept").collect())

    one = written(stages["near duplicates"](spark, good, sf_dir), "t")
    links = brute_near([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in links.items() if i == c)

    cut = written(stages["suffix-array dedup"](spark, one, sf_dir), "t")
    before = {r.doc_id: r for r in one.collect()}
    want = {k[0]: k for k in brute_suffix([(r.doc_id, r.text) for r in before.values()])}
    for r in cut.collect():
        assert (r.text == before[r.doc_id].text) == (want[r.doc_id][2] == 0)
        assert len(r.text.encode()) <= want[r.doc_id][1] - want[r.doc_id][2] and r.n_chars == len(r.text)

    mixed = written(stages["source mix"](spark, cut, sf_dir), "t")
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies.values()) <= {1, 2}

    packed = stages["packing"](spark, mixed, sf_dir)
    firsts = Counter(r.doc_id for r in packed.where("piece = 0").collect())
    assert firsts == copies


def test_run_and_empty(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_every_stage(spark, odd_docs, sf_dir):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "t")
        if name != "packing":
            assert docs.columns == odd_docs.columns
    assert near_dup.keep_one(odd_docs).count() > 0
