"""SimHash near-duplicates and decontamination against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ionlake.llm import common
from ionlake.llm import decontaminate as D
from ionlake.llm import jaccard as J
from ionlake.llm import simhash as S


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def test_masks_cover_all_pairs_within_the_radius():
    masks, rng = S.covering_masks(3), random.Random(1)
    assert len(masks) == 15
    for _ in range(5000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(diff & m == 0 for m in masks)


def texts(rng, n):
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 150))) for _ in range(n // 4)]
    out = [None, "", "  ", "A b", "a B", "Ä ä x", "ä ä x"]
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_fingerprints_equal_definition():
    for t in texts(random.Random(2), 150):
        assert S.fingerprint(t) == brute_fp(t)


@pytest.mark.parametrize("block", [S.BLOCK, 3])
def test_near_duplicates_equal_brute_force(spark, block):
    rng = random.Random(4)
    rows = [(i * 3 + 1, t, "clash") for i, t in enumerate(texts(rng, 250))]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(df, block=block).collect()}
    fps = [brute_fp(t) for _, t, _ in rows]
    comp = brute_components(fps, 3)
    least = {}
    for (i, _, _), c in zip(rows, comp):
        least[c] = min(i, least.get(c, i))
    assert got == {(i, f"{f:016x}", least[c]) for (i, _, _), f, c in zip(rows, fps, comp)}
    kept = S.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values())) and kept.columns == df.columns


def test_dense_bucket_and_chains(spark):
    rng = np.random.default_rng(3)
    fps = set()
    while len(fps) < 400:  # a chain of small steps besides a ball
        fps.add(sum(1 << int(b) for b in rng.choice(64, 2, replace=False)))
    x = 2**40 - 1
    for b in range(0, 60, 2):
        x ^= 3 << b
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    comp = brute_components(fps, 3)
    for block in (S.BLOCK, 50):
        lab = {r.node: r.label for r in S.components(S.links(df, block=block)).collect()}
        groups = {}
        for f, c in zip(fps, comp):
            groups.setdefault(c, set()).add(lab.get(S._signed(f), S._signed(f)))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(-150, 150)] + [tuple(sorted(rng.sample(range(1000, 3000), 2))) for _ in range(900)] + [(-(2**63), 2**63 - 1), (7, 7)]
    df = spark.createDataFrame(links + links[:50], "a long, b long").repartition(5)
    rounds = sorted(map(tuple, S.components(df).collect()))
    assert sorted(map(tuple, S.components(df, small=len(links) // 2).collect())) == rounds  # too many: by rounds
    puts, put = [], S.Written.put
    monkeypatch.setattr(S.Written, "put", lambda self, x: puts.append(x) or put(self, x))
    assert sorted(map(tuple, S.components(df, small=J.SMALL).collect())) == rounds and len(puts) == 1
    assert S.components(df.limit(0), small=J.SMALL).count() == 0


def test_similar_sets_with_links_joined_by_rounds(spark, monkeypatch):
    df = spark.createDataFrame(similar_rows(120), "doc_id long, text string, label string")
    few = sorted(r.doc_id for r in J.keep_one(df).collect())
    monkeypatch.setattr(J, "SMALL", 1)
    assert sorted(r.doc_id for r in J.keep_one(df).collect()) == few


def test_memory_goes_back_once_a_task_is_through(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(len(calls)))
    out = common.trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(out) == 2 and not calls and list(out) == [4] and calls == [0]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).count() == 0 and S.keep_one(df).count() == 0


def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_dynamic_programming():
    rng = random.Random(9)
    for _ in range(300):
        p, t = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (90, 150))
        assert D.myers(D.myers_masks(p), len(p), t)[0] == sellers(p, t)


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, how = rng.randrange(len(s)), rng.random()
        if how < 0.4:
            s[i] = rng.choice("xyz ")
        elif how < 0.7:
            del s[i]
        else:
            s.insert(i, rng.choice("abc"))
    return "".join(s)


@pytest.mark.parametrize("block", [10**6, 150])
def test_matches_equal_brute_force(spark, block):
    rng = random.Random(11)
    items = [(i, " ".join("".join(rng.choices("abcde", k=5)) for _ in range(rng.randint(2, 30)))) for i in range(12)]
    items += [(90, items[3][1]), (91, None), (None, items[2][1])]
    docs = [(0, None), (1, ""), (2, "word " * 50)]
    for i in range(60):
        _, t = items[rng.randrange(12)]
        docs.append((i + 3, "Start of it\n" + edited(rng, t, rng.randint(0, len(t) // 8)).upper() + "\tand more " * rng.randint(0, 9)))
    docs += docs[5:7]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in D.matches(df, bench, block_chars=block).collect())
    want = []
    for i, t in docs:
        for n, item in items:
            p = D.fold(item)
            if n is not None and len(p) >= D.MIN_CHARS and (d := sellers(p, D.fold(t))) <= D.budget(len(p)):
                want.append((i, n, d))
    assert got == sorted(want) and len(want) > 20
    left = {r.doc_id for r in D.clean(df, bench, block_chars=block).collect()}
    assert left == {i for i, _ in docs} - {i for i, _, _ in want}
    assert D.matches(df, bench.limit(0)).count() == 0 and D.matches(df.limit(0), bench).count() == 0


def brute_similar(texts):
    """Component numbers by five-word shingle sets, all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def similar_rows(n=320):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(words, k=25))
    base = [" ".join(rng.choices(words, k=rng.randint(3, 150))) for _ in range(n // 8)]
    out = [None, "", "  ", "A b", "a B", "Ä ä x", "ä ä x"]
    while len(out) < n:
        w = rng.choice(base if len(out) % 3 else base[:1]).split()
        for _ in range(rng.randint(0, max(1, len(w) // 25))):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w) + (" " + line) * (len(out) % 4 == 0))
    return [(i * 3 + 1, t, "clash") for i, t in enumerate(out)]


@pytest.mark.parametrize("block, common", [(J.BLOCK, J.COMMON), (5, 3)])
def test_similar_sets_equal_brute_force(spark, block, common):
    rows = similar_rows()
    comp = brute_similar([t for _, t, _ in rows])
    least = {}
    for (i, _, _), c in zip(rows, comp, strict=True):
        least[c] = min(i, least.get(c, i))
    df = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, set string").repartition(5)
    got = J.keep_one(df, block=block, common=common)
    assert sorted(r.doc_id for r in got.collect()) == sorted(least.values()) and got.columns == df.columns
    assert len(least) < 0.7 * len(rows) and J.keep_one(df.limit(0)).count() == 0


def test_stage_drops_copies_beyond_the_fingerprint_radius(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        w = rng.choices(words, k=100)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:50], "other", *w[51:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum((brute_fp(a[1]) ^ brute_fp(b[1])).bit_count() > 3 for a, b in zip(rows[::2], rows[1::2], strict=True)) > 10
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()) == list(range(0, 60, 2))


@pytest.mark.parametrize("keep", [S.keep_one, J.keep_one])
def test_one_row_of_each_group(spark, keep):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    a, b, c, d = (" ".join(rng.choices(words, k=60)) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, b, "x"), (None, c, "x"), (None, c, "y"), (None, c.upper(), "z"), (None, d, "x"), (3, d, "x"), (None, a, "x")]
    got = [(r.doc_id, r.text.lower()) for r in keep(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (None, c), (3, d)], key=str)


def test_short_items_are_found_exactly(spark):
    items = [(1, "Short  answer"), (2, "tiny"), (3, "n" * 38), (4, " "), (5, None)]
    docs = [(1, "a SHORT\nanswer."), (2, "shorts answer, short answers"), (3, "tinynot tiny"), (4, "un-tiny?"), (5, "short bnswer " + "n" * 37), (6, "x " + "n" * 38), (7, "n" * 39)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.match_end) for r in D.matches(df, bench).collect())
    assert got == [(1, 1, 0, 14), (3, 2, 0, 12), (4, 2, 0, 7), (6, 3, 0, 40)]
    assert sorted(r.doc_id for r in D.clean(df, bench).collect()) == [2, 5, 7]
