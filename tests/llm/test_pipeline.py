"""The corpus pipeline against a brute-force version of its stages, and its registration."""

import hashlib
import random
import struct

import public_tokenizers as P
import pytest

import __spark_entry__
import corpus_pipeline
from ionlake.llm import decontaminate as D
from ionlake.llm import quality_rules, toxicity
from tests.llm.test_duplicates import brute_similar, sellers
from tests.llm.test_models import BAD, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    rows, labels = [], []
    bench = [(i, prose(rng, 30)) for i in range(6)]
    for i in range(500):
        t = prose(rng, rng.randint(30, 150)).split()
        if i % 5 == 0:
            for _ in range(6):
                t.insert(rng.randrange(len(t)), rng.choice(BAD))
        if i % 17 == 0:
            t[5:5] = bench[i % 6][1].split()
        rows.append((i, " ".join(t), "en" if i % 2 else None, "s", 7))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(500, 560):
        w = rows[i - 490][1].split()
        rows.append((i, " ".join(w[:-1]) if i % 2 else " ".join(w).upper(), "en", "t", 7))
    rows += [(700, None, "en", "s", 0), (701, "", None, None, None), (702, prose(rng, 5), "en", "s", 3), rows[3], rows[4]]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, bench


def test_pipeline_equals_brute_force(spark, folder):
    from tokenizers import Tokenizer

    at, rows, bench = folder
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, at).collect())
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    left = [r for r, p in zip(rows, model.score([r[1] for r in rows]), strict=True) if p < toxicity.THRESHOLD]
    kept = {(r.doc_id, r.kept) for r in quality_rules.judge(spark.createDataFrame(left, docs.schema), "doc_id").collect()}
    left = [r for r in left if (r[0], True) in kept]
    first = {}
    for r, c in zip(left, brute_similar([r[1] for r in left]), strict=True):
        first[c] = min(r, first.get(c, r), key=lambda x: x[0])
    left = list(first.values())
    left = [r for r in left if not any(sellers(D.fold(b), D.fold(r[1])) <= D.budget(len(D.fold(b))) for _, b in bench)]
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for r in left:
        ids = lib.encode(r[1], add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
    assert got == sorted(want) and 200 < len(got) < 450


def test_stages_keep_columns_and_order(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
