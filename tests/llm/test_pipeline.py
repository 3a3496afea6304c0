import hashlib
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm.quality import classify
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_suffix_dedup import brute as suffix_brute

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    one = corpus_pipeline.quality(spark, docs, SF)
    keep = {r.doc_id for r in classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("keep").collect()}
    rows = one.collect()
    assert one.columns == names and {r.doc_id for r in rows} == keep
    one = spark.createDataFrame(rows, docs.schema)

    two = corpus_pipeline.near_dedup(spark, one, SF)
    want = near_brute([(r.doc_id, r.text) for r in rows], 5)
    rows = two.collect()
    assert two.columns == names and {r.doc_id for r in rows} == {i for i, w in want.items() if w[2]}
    two = spark.createDataFrame(rows, docs.schema)

    three = corpus_pipeline.suffix_dedup(spark, two, SF)
    want = suffix_brute([(r.doc_id, r.text) for r in rows])
    rows = three.collect()
    assert three.columns == names and len(rows) == len(want)
    for r in rows:
        n = len(r.text.encode())
        assert r.n_chars == len(r.text) and n <= want[r.doc_id][0] - want[r.doc_id][1]
        if n == want[r.doc_id][0] - want[r.doc_id][1]:  # no cut inside a character
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]
    three = spark.createDataFrame(rows, docs.schema)

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*lib.encode(r.text, add_special_tokens=False).ids, 0] for r in rows}
    packed = corpus_pipeline.packing(spark, three, SF).collect()
    assert sum(r.length for r in packed) == sum(map(len, ids.values()))
    for r in packed:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))


def test_run_and_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (1, "a b c d e f", "en", "s", 11, 2), (1, "a b c d e f", "en", "s", 11, 3), (2, "x" * 150, None, "s", 150, 4)], "doc_id long, text string, lang string, source string, n_chars long, uid int")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == [0, 1, 2]
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) >= 1


def test_columns_with_our_names(spark, tmp_path):
    """Extra columns keep their values in every stage, whatever they are called."""
    names = ["kept", "s", "e", "gone", "_uid", "uid", "_doc", "row", "rep", "label", "keep", "a.b", "labelled", "c", "x", "piece"]
    texts = ["a b c d e f g h", "a b c d e f g h", "z" * 150, None, "z" * 150 + "tail", ""]
    rows = [(i, t, "en", "s", *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert len(got) >= 4 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {0, 2, 3, 4, 5}
    cut = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, docs, str(tmp_path)).collect()}
    assert cut == {0: texts[0], 1: texts[1], 2: "z" * 101, 3: "", 4: "tail", 5: ""} or cut[4] == "tail"
    assert len(corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()) == 6
