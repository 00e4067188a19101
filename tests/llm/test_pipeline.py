import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from flightwords.llm import mixing, packing, toxicity
from flightwords.llm.common import SMALL_BATCHES, in_small_batches
from flightwords.session import materialize

from .data import SF, documents, records
from .test_dedup import _components
from .test_near_copies import _grams, _jaccard


def test_every_stage_against_a_plain_model(spark):
    """Each stage is judged on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = records(docs), materialize(stage(spark, docs, SF))
        seen[name] = (before, records(docs))
        assert name == "packing" or docs.columns == columns
    before, after = seen["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fold = lambda i: __import__("zlib").crc32(str(i).encode()) % 3
    toxic = {r["doc_id"]: r["toxic"] for r in records(labels)}
    model = toxicity.train(sorted((r["text"], toxic[r["doc_id"]] > 0) for r in before if fold(r["doc_id"]) != 1 and r["doc_id"] in toxic))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if model.score(r["text"])[0] < toxicity.THRESHOLD}
    before, after = seen["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())
    before, after = seen["near_dedup"]
    sets = [_grams(r["text"]) for r in before]
    heads = _components([(r["doc_id"],) for r in before], lambda i, j: _jaccard(sets[i], sets[j]) >= 0.8)
    assert sorted(r["doc_id"] for r in after) == sorted(set(heads))
    before, after = seen["mixing"]
    drawn = {r["doc_id"]: r["copies"] for r in records(mixing.copies(spark.createDataFrame([tuple(r.values()) for r in before], docs_schema(spark))))}
    assert Counter(r["doc_id"] for r in after) == Counter({k: v for k, v in drawn.items() if v})
    before, after = seen["packing"]
    assert sum(r["length"] for r in after if r["start"] == 0 or True) == sum(r["doc_tokens"] for r in after if r["start"] == 0)
    encoder = packing.Encoder(packing.vocabulary())
    whole = Counter((r["doc_id"], len(encoder.encode(r["text"])) // 4 + 1) for r in before)
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in after if r["start"] == 0) == whole
    at = np.array(sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in after))
    assert (at[:, 0] == np.concatenate([[0], np.cumsum(at[:, 1])[:-1]])).all()


def docs_schema(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").schema


def test_texts_reach_python_in_small_batches_and_rows_never(spark, capsys):
    """Large batches are held outside the executor's heap, several times over, and by the worker beside it."""
    texts = [(1, "so bad."), (1, "all good"), (None, "bad"), (None, "fine"), (2, None), (3, "bad"), (3, "bad"), (4, "good"), (4, "good")]
    docs = documents(spark, texts)
    model = toxicity.Model(-4.0, {"bad": 50.0})
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in records(kept)) == Counter(t for t in texts if "bad" not in (t[1] or ""))
    pieces = packing.pack(documents(spark, [(1, "a b " * 5_000), (None, None), (2, "")]))
    assert Counter(r["doc_tokens"] for r in records(pieces) if r["start"] == 0) == {10_001: 1, 1: 2}
    capsys.readouterr()
    for df in (kept, pieces, packing.pack(docs, ids=False)):
        df.explain()
    assert "InArrow" not in capsys.readouterr().out

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    before = [spark.conf.get(k) for k in SMALL_BATCHES]
    long = spark.range(0, 4_000, 1, 1).select(F.when(F.col("id") < 2_000, "x").otherwise(F.repeat(F.lit("x"), F.lit(20_000))).alias("text"))
    met = in_small_batches(spark, lambda: materialize(long.mapInArrow(sizes, "n long, size long"))).collect()
    assert sum(r["n"] for r in met) == 4_000 and max(r["n"] for r in met) == 1_000 and max(r["size"] for r in met) < 5 << 20
    assert [spark.conf.get(k) for k in SMALL_BATCHES] == before
