"""The stages, their order and what each does to all rows."""

from __future__ import annotations

import struct

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers

from tokenizers import Tokenizer

from loomwork.llm import secrets, toxicity

from . import brute
from .conftest import corpus, frame


def test_stages(spark, sf_dir):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "secret scans", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, before = docs.columns, docs.count()
    left = [before]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == names
        left.append(docs.count())
    assert left[1] >= 0.8 * before and left[2] == left[1] and left[3] <= left[2] and left[4] == left[3]
    assert not any(brute.base_spans(r.text) for r in docs.collect())


def test_whole_pipeline_keeps_each_document_once(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in ends.values():
        assert sum(n for _, n, _ in pieces) == pieces[0][2]


def test_registered():
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(any(q.startswith(n) for q in entry.queries()) for n in names) and "pipeline" in entry.queries()


def stages(spark, docs, sf_dir):
    """Input and output of each stage, as rows by doc_id where that can be."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        yield name, docs, out
        docs = out


def test_stages_against_plain_versions(spark, sf_dir):
    """Every stage on all that its predecessor kept."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for name, before, after in stages(spark, docs, sf_dir):
        had = texts(before)
        if name == "toxicity":
            scores = toxicity.score_documents(before, *toxicity.trained(before, labels)).collect()
            assert texts(after) == {r.doc_id: had[r.doc_id] for r in scores if not r.predicted}
        elif name == "line dedup":
            gone = brute.removed_lines(list(had.items()))
            assert texts(after) == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, {})) for i, t in had.items()}
        elif name == "SimHash near-dedup":
            assert texts(after) == {i: had[i] for i, (_, least) in brute.near_fingerprints(list(had.items())).items() if i == least}
        elif name == "secret scans":
            spans = {r.doc_id: [(s.start, s.end) for s in r.all_spans] for r in secrets.scan(before).collect()}
            for i, text in texts(after).items():
                hidden, at = "", 0
                for start, end in spans[i]:
                    if start >= at:
                        hidden += had[i][at:start] + "[secret]"
                    at = max(at, end)
                assert text == hidden + had[i][at:]
            assert set(texts(after)) == set(had)
        else:
            encode = lambda t: struct.pack(f"<{len(x := tokenizer.encode(t, add_special_tokens=False).ids)}I", *x)
            assert brute.packing_faults(after.collect(), had, encode) == []


def test_stages_on_odd_rows_and_on_none(spark, tmp_path):
    """Null doc_ids and texts, repeated rows, long and odd texts, clashing columns, no labels; and empty tables."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [*corpus(), (None, None), (None, "a text without an id"), (1, "a b c d e f g h"), (1, "a b c d e f g h"), (200, "x" * 300_000), (201, None)]
    docs = frame(spark, odd)
    for name, before, after in stages(spark, docs, str(tmp_path)):
        if name == "packing":
            whole = after.where("start = 0").count()
            assert whole == before.count()
            continue
        assert after.columns == before.columns and after.schema.simpleString() == docs.schema.simpleString()
        assert after.where("doc_id = 200").count() == 1 and after.where("doc_id is null").count() == 2
        assert after.where("_gone = 1 and words = 'w' and place = 5").count() == after.count()
        if name != "SimHash near-dedup":
            assert after.count() == before.count()
    for name, before, after in stages(spark, docs.where("false"), str(tmp_path)):
        assert after.isEmpty()
