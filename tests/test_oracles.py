"""Every query of the catalogue against its SQL, over the smallest driver tables."""

import hashlib
import json
import os
import re

import pytest
from oracles import same
from pyspark.sql import functions as F

from scribeframe.functions import text as T
from scribeframe.operators import export
from scribeframe.plans import catalogue, dispatch
from scribeframe.sources import documents

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def distance(a, b):
    """Edits from one list to another, by the definition's recursion over all pairs of prefixes."""
    row = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            row[i, j] = min(row[i - 1, j] + 1, row[i, j - 1] + 1, row[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return row[len(a), len(b)]


def test_wer_by_brute_force(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    cut = lambda x: [w for w in (T.fold(y) for y in x.split()) if w]
    for r in catalogue.wer(spark, SF).limit(60).collect():
        a, b = cut(texts[r.item_id]), cut(texts[r.item_id].replace("tion", "sion"))
        assert r.wer == round(distance(a, b) / max(1, len(a)) * 1_000_000)


def test_corrections_by_brute_force(spark):
    rules = [(r"(?<!\w)and the(?!\w)", "et le"), (r"(?<!\w)the(?!\w)", "le"), ("tion", "ción")]
    texts = {(r.doc, r.seg): r.text for r in catalogue._segments(spark, SF).collect()}
    rows = catalogue.corrections(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, pick = 0, lambda m: next(to for p, to in rules if re.fullmatch(p.split("(?!")[0].split(")")[-1], m.group(), re.I))
        new, n = re.subn("|".join(p for p, _ in rules), pick, texts[r.doc, r.seg], flags=re.I)
        assert (r.n, r.hash) == (n, hashlib.md5(new.encode()).hexdigest())


def test_json_export_by_reading_it(spark):
    own = {}
    for r in catalogue._segments(spark, SF).orderBy("doc", "seg").collect():
        own.setdefault(r.doc, []).append((r.seg, r.s, r.e, r.text))
    for r in export.render(catalogue._segments(spark, SF), "json").collect():
        assert [(x["seg"], x["s"], x["e"], x["text"]) for x in json.loads(r.content)["segments"]] == own[r.doc]


def test_whole_transcripts_break_no_rule(spark, tmp_path):
    """Every rule, on the documents as they are and typed."""
    catalogue._built(spark, SF).write.parquet(str(tmp_path / "t"))
    raw = spark.read.parquet(str(tmp_path / "t"))
    docs = raw.select("doc", F.from_json("json", documents.TRANSCRIPT).alias("d")).select("doc", "d.*").withColumn("title", F.col("id")).withColumn("id", F.col("doc"))
    assert docs.count() > 0 and dispatch.violations(docs, raw).collect() == []
    first = json.loads(raw.orderBy("doc").first().json)
    assert list(first["segments"][0]["words"][0]) == ["index", "start", "end", "text", "confidence", "speaker_id", "timing"] and first["provenance"]["parameters"] == {"beam_size": 5}


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
