"""BPE, token counts, sharding and URL lists against libraries and brute force."""

import hashlib
import random
import struct

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from ionlake.llm import bpe, sharding, token_counts, url_lists

HARD = [None, "", " \n\t", "Hello  wörld's", "a<|endoftext|>b <|startoftext|>", "x" * 3000, "ΟΔΟΣ ΣΑΣ İ é", "ab\x1ccd", "1234 !!?? ", "Ab" * 400, "中文 ꟍ ҈"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 9) for i, t in enumerate(HARD)] + [(3, HARD[3], None, 1), (None, "no id", "de", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_bpe_equals_library(docs):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = [tuple(r) for r in bpe.digests(docs, path, "doc_id").collect()]
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_bpe_random_words_equal_library():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBPE(path)
    rng = random.Random(7)
    for _ in range(300):
        t = "".join(rng.choices("abcdethinoersl'. ÉßÑ9!中", k=rng.randint(0, 400)))
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids


def test_bpe_full_columns(docs):
    rows = bpe.encode(docs, P.path("word_bpe_49k.json"), "doc_id").collect()
    assert len(rows) == docs.count() and all(len(r.ids) > 0 or r.decoded == "" for r in rows)
    assert bpe.encode(docs.limit(0), P.path("word_bpe_49k.json"), "doc_id").count() == 0


def test_token_counts(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(docs, path, "doc_id", limit=10, chunk=200, overlap=8).where("doc_id is not null").collect()
    for r in got:
        t = HARD[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 10)
    assert len(got) == len(HARD) + 1


def test_resync_equals_whole_encoding():
    path = P.path("piece_bpe_32k.model")
    r = token_counts.Resync(path, chunk=120, overlap=6)
    rng = random.Random(3)
    texts = ["a" * 2000, "=-" * 900, " " * 1500, "abab cdcd" * 100, "x\x00y" * 200, "▁ " * 300]
    texts += ["".join(rng.choices("abcdethe  \n▁中é😀", k=rng.randint(0, 2500))) for _ in range(120)]
    for t in texts:
        assert r.ids(t).tolist() == r.sp.encode(t)


def brute_table(shards, size):
    """The published filling, one preference list at a time."""
    prefs = []
    for s in shards:
        offset, skip = sharding.preferences(s, size)
        prefs.append([(offset + k * skip) % size for k in range(size)])
    owner, nxt, n = [-1] * size, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            while owner[prefs[i][nxt[i]]] >= 0:
                nxt[i] += 1
            owner[prefs[i][nxt[i]]] = i
            n += 1
            if n == size:
                return owner


def test_sharding_table_balance_and_disruption():
    names = [f"s{i}" for i in range(7)]
    t = sharding.fill_table(names, 211)
    assert t.tolist() == brute_table(names, 211)
    sizes = [(t == i).sum() for i in range(7)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.fill_table(names[:-1], 211)
    assert ((t != fewer) & (t != 6)).mean() < 0.15
    double = sharding.fill_table(["a", "b"], 211, [2.0, 1.0])
    assert abs((double == 0).mean() - 2 / 3) < 0.02
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_sharding_places_every_row(docs):
    df = docs.withColumn("slot", F.lit("clash"))
    out = sharding.place(df, ["doc_id"], sharding.fill_table(["a", "b", "c"], 101)).collect()
    assert len(out) == df.count() and all(0 <= r.shard < 3 and 0 <= r.slot < 101 for r in out)
    assert len({r.shard for r in out if r.doc_id == 3}) == 1
    assert sharding.place(df.limit(0), ["doc_id", "text"], sharding.fill_table(["a"], 3)).count() == 0


def brute_urls(caps, entries):
    out = []
    for page, url, at in caps:
        host = ""
        if url and "://" in url:
            host = url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].lower().rsplit("@", 1)[-1].split(":")[0].rstrip(".")
        names = [".".join(host.split(".")[i:]) for i in range(len(host.split(".")))]
        hit = None
        for n in names:
            on = [e for e in entries if e[1] == n and at is not None and e[3] is not None and e[2] is not None and e[3] <= at]
            if on:
                last = max(on, key=lambda e: (e[3], e[0]))
                if last[2] != "remove":
                    hit = last
                    break
        out.append((page, url, at, host, hit and hit[0], hit and hit[1], hit[2] if hit else "none"))
    return out


@pytest.mark.parametrize("bound", [1000, 0])
def test_url_lists_match_brute_force(spark, bound):
    rng = random.Random(5)
    hosts = ["a.b.c", "b.c", "c", "x.b.c", "d", "A.B.C:80", "u@b.c."]
    caps = [(i, rng.choice([f"http://{rng.choice(hosts)}/p?q#f", None, "junk", "http://"]), rng.choice([None, *range(12)])) for i in range(200)]
    caps += caps[:5]
    entries = [(i, rng.choice(["a.b.c", "b.c", "c", "d", None]), rng.choice(["block", "allow", "remove"]), rng.choice([None, *range(10)])) for i in range(30)]
    c = spark.createDataFrame(caps, "page_id long, url string, fetched long").withColumn("domain", F.lit("clash"))
    e = spark.createDataFrame(entries, "entry_id long, domain string, action string, effective long")
    got = [tuple(r) for r in url_lists.filter_urls(c, e, broadcast_rows=bound, salts=3).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute_urls(caps, [x for x in entries if x[1]]), key=key)
    assert url_lists.filter_urls(c.limit(0), e).count() == 0
    assert {r.decision for r in url_lists.filter_urls(c, e.limit(0)).collect()} == {"none"}
