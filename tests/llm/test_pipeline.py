"""Every stage of the pipeline takes and returns documents and has its effect."""

import corpus_pipeline as pipeline
from rubrica.llm.base import DOCUMENT_COLUMNS, read_documents

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read_documents(spark, SF)
    counts = [docs.count()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == DOCUMENT_COLUMNS
        counts.append(docs.count())
        if name == "quality classifier":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            right = [(i in kept) == bool(q) for i, q in labels.items()]
            assert sum(right) / len(right) > 0.95
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4]
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, score_ string, _h string, _cut string, _spans string, row string, key string"


def test_stages_take_awkward_rows(spark):
    """NULL texts and ids, repeated rows, empty tables, columns that clash: foreign columns come back as they were."""
    words = " ".join(f"word{k}" for k in range(30))
    texts = [
        (1, words), (1, words), (2, words + " more"), (3, None), (None, "no id"), (None, words), (4, ""),
        (5, "mail ann@x.org\nline one\nline two\n"), (6, "other\nline one\nline two"), (None, None),
    ]
    rows = [(i, t, "en", "s", len(t or ""), *[f"f{k}"] * 7) for k, (i, t) in enumerate(texts)]
    for table in (spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([], COLUMNS)):
        n, docs = table.count(), table
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            found = out.collect()
            assert out.columns == docs.columns, name
            assert all(len({r.score, r.score_, r._h, r._cut, r._spans, r.row, r.key}) == 1 for r in found), name
            if name in ("line dedup", "private data"):
                assert len(found) == n
            if name == "near dedup" and n:
                assert sorted(r.doc_id for r in found if r.text and words in r.text) == [1]
                assert sum(r.doc_id is None for r in found) == 2
                assert sum(r.doc_id == 1 for r in found) == 1
            if name == "line dedup" and n:
                assert {r.doc_id: r.text for r in found}[6] == "other"
        pipeline.STAGES[-1][1](spark, docs, SF).count()
