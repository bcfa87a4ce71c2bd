import base64
import random

import corpus_pipeline
from fairline.llm.decontaminate import find_items

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = step(spark, kept, SF)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        kept = spark.createDataFrame(after.collect(), docs.schema)
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert find_items(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    pieces = corpus_pipeline.packing(spark, kept, SF).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in kept.collect()}
    assert sorted(tuple(p) for p in corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()) == sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces)


def test_language_keeps_clean_texts_and_drops_random_letters_and_unlearned_scripts(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    clean &= {r["doc_id"] for r in docs.where("text rlike '[a-zA-Z]'").collect()}
    rng = random.Random(7)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(map(chr, range(0x4E00, 0x5E00)))]
    texts = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for _ in range(200)) for a in alphabets for _ in range(30)]
    texts += [base64.b64encode(rng.randbytes(900)).decode() for _ in range(30)]
    noise = spark.createDataFrame([(10**9 + i, t, None, "noise", len(t)) for i, t in enumerate(texts)], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(noise), folder).select("doc_id").collect()}
    assert len(clean) > 100 and clean <= left
    assert not {i for i in left if i >= 10**9}
    without = spark.createDataFrame([(1, "words of a language nobody labelled", None, "x", 35)], docs.schema)
    assert corpus_pipeline.language(spark, without, folder).count() == 0 and corpus_pipeline.language(spark, docs.limit(0), folder).count() == 0
