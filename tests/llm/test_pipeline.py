"""The pipeline's stages against brute force, each on what the one before kept."""

from collections import Counter

import pytest

import corpus_pipeline
from siteprofile.llm.queries import tokenizer_path

from .test_documents import brute_classes, expected_quality
from .test_rest import expected_lines, line_of


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]).coalesce(1)
    plain.write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("quality_rules", "line_dedup", "ngram_jaccard", "mixing", "packing")
    rows = docs.collect()
    out = []
    for stage in stages:
        docs = stage(spark, docs, folder)
        out.append(docs.collect())
    assert all(x.columns == spark.read.parquet(f"{folder}/documents.parquet").columns for x in (stages[0](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder),))
    # Quality rules: no host of this table is bad, so the base rules decide.
    assert {r.doc_id for r in out[0]} == {r.doc_id for r in rows if not expected_quality(r.text)[-1]}
    # Line dedup, by doc_id.
    label, seen, want = expected_lines([r.text for r in out[0]]), set(), {}
    for r in sorted(out[0], key=lambda r: r.doc_id):
        kept = []
        for x in r.text.split("\n"):
            group = label.get(line_of(x))
            if not line_of(x).strip() or group not in seen:
                kept.append(x)
            seen.add(group)
        if any(x.split() for x in kept):
            want[r.doc_id] = "\n".join(kept)
    assert {r.doc_id: r.text for r in out[1]} == want
    # One document of each near-duplicate group.
    assert sorted(r.doc_id for r in out[2]) == sorted({c for _, _, c in brute_classes(out[1])})
    assert {(r.doc_id, r.text) for r in out[2]} <= {(r.doc_id, r.text) for r in out[1]}
    # The mix has whole documents, at most three times each.
    copies = Counter((r.doc_id, r.text, r.source) for r in out[3])
    assert set(copies) <= {(r.doc_id, r.text, r.source) for r in out[2]} and max(copies.values()) <= 3
    # Packing keeps every token.
    encode = Tokenizer.from_file(tokenizer_path())
    assert sum(r.length for r in out[4]) == sum(n * (1 + len(encode.encode(t, add_special_tokens=False).ids)) for (_, t, _), n in copies.items())
    total = corpus_pipeline.run(spark, folder)
    assert sum(r.length for r in total.collect()) == sum(r.length for r in out[4])


def test_stages_of_an_empty_table(spark, no_docs, folder):
    plain = no_docs.select("doc_id", "text", "lang", "source", "n_chars", "_salt")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, plain, folder)
        assert out.count() == 0
        assert name == "packing" or out.columns == plain.columns
