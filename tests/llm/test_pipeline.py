"""The corpus pipeline's stages, one after the other, over documents with nulls, empties, repeats, copies and long lines."""

import os

import corpus_pipeline
import pytest

from scribeframe.llm import kernel

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def odd(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    first = base.orderBy("doc_id").limit(40).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [tuple(r) for r in first]
    own = {c: i for i, c in enumerate(base.columns)}
    make = lambda i, text, n=0, lang="en": tuple({"doc_id": i, "text": text, "lang": lang, "source": "s", "n_chars": n}[c] for c in own)
    kept = next(r for r in first if r.lang == "en" and len(r.text) > 400)
    rows += [make(900, None), make(901, "", lang=None), make(902, " \n "), make(None, kept.text), make(kept.doc_id, kept.text), make(903, kept.text + " more"), make(904, f"{kept.text[::-1]}\n{item}", None), make(905, "x" * 60_000), make(906, "\n".join([kept.text[:60][::-1]] * 50))]
    return spark.createDataFrame(rows, base.schema).repartition(3), kept, item


def test_stages_over_odd_rows(spark, odd):
    docs, kept, item = odd
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs.where("false"), SF).count() == 0
        before = docs.collect()
        docs = kernel.written(stage(spark, docs, SF), "odd")
        rows = docs.collect()
        seen[name] = rows
        if k < 4:
            assert docs.columns == columns
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before}
    quality, lines, near, clean, encoded = seen.values()
    for r in lines:  # whole lines go, nothing else changes
        own = [x.text for x in quality if x.doc_id == r.doc_id]
        assert r.text in own or any(set(r.text.split("\n")) <= {*(x or "").split("\n"), ""} for x in own)
        assert r.text in own or r.n_chars == len(r.text)
    repeated = next(r for r in lines if r.doc_id == 906)
    assert repeated.text.count(kept.text[:60][::-1]) == 1
    ids = [r.doc_id for r in near]
    assert None in ids and kept.doc_id in ids and 905 in ids
    # texts without words are copies of each other, but for rows without an id
    assert len({r.doc_id for r in near if not (r.text or "").split() and r.doc_id is not None}) <= 1
    assert 904 in ids and 904 not in [r.doc_id for r in clean] and all(item not in (r.text or "") for r in clean)
    assert len(encoded) == len(clean)
    texts = {(r.doc_id, r.text) for r in clean}
    assert all((r.doc_id, r.decoded) in texts for r in encoded) and all(len(r.ids or []) == r.n_pieces for r in encoded)
