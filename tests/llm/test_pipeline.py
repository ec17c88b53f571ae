import math

import corpus_pipeline as cp

from clinloom.llm import ngram_jaccard, pfair_mix, quality_cnn, queries
from clinloom.session import materialize


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, kept[-1], sf_dir), f"test-{name}")
        assert name == cp.STAGES[-1][0] or out.columns == columns
        kept.append(out)
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in kept]
    model = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality_cnn.score(docs, model).collect()}
    assert ids[1] == {k for k, v in scores.items() if v >= 0.3}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum(k in ids[1] for k, v in labels.items() if v) >= 0.95 * sum(labels.values())
    groups = ngram_jaccard.join_components(kept[1], 5, 80, 100).collect()
    assert ids[2] == {r["component_id"] for r in groups}
    assert ids[2] == ids[3] == ids[4] == ids[5]
    assert [r["text"] for r in kept[3].orderBy("doc_id").collect()] != [r["text"] for r in kept[2].orderBy("doc_id").collect()]
    order = [r["doc_id"] for r in pfair_mix.in_schedule_order(pfair_mix.mix(kept[3])).select("doc_id").collect()]
    import glob

    import pyarrow.parquet as pq

    files = sorted(glob.glob(kept[4]._scratch_path.removeprefix("file:") + "/*.parquet"))
    assert [k for f in files for k in pq.read_table(f)["doc_id"].to_pylist()] == order


def test_run_equals_brute_force(spark, sf_dir):
    """The whole run against plain versions of its five stages, on all documents."""
    import public_tokenizers
    import test_ngram_jaccard
    import test_nnls_pack
    import test_pfair_mix
    import test_pii_brute_force
    import test_quality_cnn
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r["doc_id"]: r.asDict() for r in table.collect()}
    model = quality_cnn.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    logit = {k: test_quality_cnn.brute(model, (d["text"] or "").encode()) for k, d in docs.items()}
    cut = math.log(queries.QUALITY_KEEP / (1 - queries.QUALITY_KEEP))
    assert all(abs(x - cut) > 1e-3 for x in logit.values())
    kept = {k: d for k, d in docs.items() if logit[k] > cut}
    groups = test_ngram_jaccard.brute([(k, d["text"]) for k, d in kept.items()], 5, 80, 100)
    kept = {k: d for k, d in kept.items() if (str(k), str(k)) in {(i, c) for i, _, c in groups}}
    texts = {k: test_pii_brute_force.brute(queries.PII_KEY, d["text"])[0] for k, d in kept.items()}
    assert texts != {k: d["text"] for k, d in kept.items()} and len(kept) < len(docs)
    n = {s: sum(d["source"] == s for d in kept.values()) for s in {d["source"] for d in kept.values()}}
    size = pfair_mix.block_size(n)
    blocks = {s: -(-x // size) for s, x in n.items()}
    want = test_pfair_mix.slot_by_slot({s: x**0.5 for s, x in n.items()}, blocks, pfair_mix.fine_quantum(blocks))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}

    rows = [tuple(r) for r in cp.run(spark, sf_dir).collect()]
    test_nnls_pack.check(rows, ids)
    mixed = cp.mixture(spark, spark.createDataFrame([tuple(d.values()) for d in kept.values()], table.schema), sf_dir).collect()
    slots = [want[s, b][3] for s, b in sorted(want, key=lambda x: want[x][3])]
    sources = [r["source"] for r in mixed]
    at = 0
    for (s, b), _ in zip(sorted(want, key=lambda x: want[x][3]), slots, strict=True):
        length = min(size, n[s] - b * size)
        assert sources[at : at + length] == [s] * length
        at += length
    assert at == len(mixed) == len(kept)


def test_run_keeps_no_intermediate_documents(spark, sf_dir):
    import os

    from clinloom.session import scratch_root

    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    out = cp.run(spark, sf_dir)
    left = {x for x in set(os.listdir(root)) - before if "-" in x}
    assert [x for x in left if not x.startswith("pipeline-mixture")] == [] and out.count() > 0
    assert "sequence_id" in out.columns and cp.ORACLE_SQL is None
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "pseudonyms", "mixture", "packing"]


def test_registered():
    import __spark_entry__ as e

    numbers = [int(q[2:].split("_")[0]) for q in e.queries() if q[:2] == "op" and q[2].isdigit()]
    assert numbers == list(range(1, 14)) and "pipeline" in e.queries()


def test_stages_take_odd_and_empty_tables(spark, odd, empty, sf_dir):
    """Nulls, repeated rows, long texts, clashing columns; a stage keeps its input's columns, the last has its own."""
    for name, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
        out = stage(spark, odd, sf_dir)
        rows = out.count()
        if name != "packing":
            assert out.columns == odd.columns and rows <= odd.count(), name
        if name in ("pseudonyms", "mixture"):
            assert rows == odd.count(), name
