"""Near duplicates and repeated substrings against brute force."""

import collections
import hashlib
import random
import re

import pytest

from tidewater.llm import common, near_dedup
from tidewater.llm.near_dedup import near_duplicates
from tidewater.llm.substrings import drop_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(ASCII))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        key = (i is None, i or 0)
        least[find(a)] = min(least.get(find(a), key), key)
    name = lambda key: None if key[0] else key[1]
    return sorted(((i, len(s), name(least[find(a)])) for a, (i, s) in enumerate(sets)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Groups of near copies of a base text at all similarities, some far from it but near to each other."""
    rng = random.Random(seed)
    rows = []
    for _ in range(6):
        base = [f"t{rng.randrange(400)}" for _ in range(rng.choice([20, 90, 200]))]
        for _ in range(14):
            once = edited(rng, base, rng.randrange(len(base) // 12 + 1)).split()
            rows.append(edited(rng, once, rng.randrange(4)))
    rows += [" ".join(f"u{rng.randrange(50)}" for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,percent,seed", [(3, 85, 1), (5, 80, 2)])
def test_components(docs_of, rough, k, percent, seed):
    rows = [(1000 + i if i is not None else None, t) for i, t, _ in rough] + corpus(seed)
    got = near_duplicates(docs_of(rows), shingle=k, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_large_group_in_blocks(docs_of, monkeypatch):
    rng = random.Random(3)
    base = [f"t{k}" for k in range(60)]
    rows = list(enumerate([*(edited(rng, base, rng.randrange(1, 5)) for _ in range(150)), *["same old text of copies"] * 100]))
    import tidewater.llm.near_dedup as module

    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "STAR", 8)
    got = near_duplicates(docs_of(rows), shingle=3, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 3, 85)


def test_no_documents(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    assert [(r.n_shingles, r.kept) for r in near_duplicates(docs_of([(1, None), (2, "")])).collect()] == [(0, True)] * 2


def test_low_percentages_are_refused(docs_of):
    for percent in (50, 79, 101):
        with pytest.raises(ValueError):
            near_duplicates(docs_of([(1, "a")]), percent=percent)


def test_hot_keys(docs_of, monkeypatch):
    """Hot bands, hubs, components and sets are dealt to several tasks and give the same; the largest long is an identifier like any other."""
    rng = random.Random(11)
    base = [f"t{k}" for k in range(80)]
    rows = [(i, edited(rng, base, rng.randrange(1, 4))) for i in range(250)] + [(None, "copies of one text with no identifier")] * 60 + [(5, "copies of one text with no identifier")] * 60
    rows += [(2**63 - 1, "only the last identifier has this text"), (2**63 - 1, rows[0][1]), (-(2**63), "first of all")]
    rows += [(1000 + k, " ".join(f"u{k}_{j}" for j in range(9))) for k in range(60)]
    for name, value in (("HOT_LEAST", 20), ("HOT_KEYS", 50), ("HOT_PARTS", 7)):
        monkeypatch.setattr(common, name, value)
    seen = []
    found = common.hot_keys
    monkeypatch.setattr(near_dedup, "hot_keys", lambda table, key, n=None: seen.append((key, len(out := found(table, key, n)))) or out)
    got = near_duplicates(docs_of(rows), shingle=3, percent=85).collect()
    assert {"band", "hub", "a", "u", "c", "comp", "digest"} <= {key for key, n in seen if n}
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows, 3, 85)


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 10)
    large = common.save(spark.range(3000).selectExpr("if(id % 3 > 0, 7, id) as k", "id"), "test")
    small = spark.range(0, 3000, 2).selectExpr("id as k", "id * 10 as x").union(spark.createDataFrame([(7, 70)], "k long, x long"))
    hot = common.hot_keys(large, "k")
    assert hot == [7]
    for how in ("inner", "left"):
        plain = large.join(small, "k", how).select("k", "id", "x")
        assert sorted(map(str, common.spread_join(large, small, "k", hot, how).select("k", "id", "x").collect())) == sorted(map(str, plain.collect()))


def brute_repeats(rows, n):
    last = 2**63
    docs = [(last if i is None else i, i, WORD.findall(t or "")) for i, t, *_ in rows]
    least = {}
    for key, _, w in docs:
        for j in range(len(w) - n + 1):
            window = tuple(w[j : j + n])
            least[window] = min(least.get(window, key), key)
    out = []
    for key, i, w in docs:
        gone = set()
        for j in range(len(w) - n + 1):
            if least[tuple(w[j : j + n])] < key:
                gone.update(range(j, j + n))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def test_repeats(docs_of, rough):
    rng = random.Random(5)
    passages = [[f"p{rng.randrange(300)}" for _ in range(rng.choice([12, 13, 14, 40]))] for _ in range(8)]
    rows = [(i, t) for i, t, _ in rough]
    for i in range(100, 180):
        words = [f"z{rng.randrange(200)}" for _ in range(rng.randrange(60))]
        for p in rng.sample(passages, rng.randrange(4)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(200, "a " * 30), (201, "a\n" * 14 + "b"), (200, "c a " * 15), (None, "a " * 13), (202, " ".join(f"p{k}" for k in range(40)))]
    rows += [(2**63 - 1, "q " * 20), (None, "q " * 20), (None, "r " * 20), (2**63 - 1, "r " * 20), (-(2**63), "r " * 14)]
    df = drop_repeats(docs_of(rows))
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute_repeats(rows, 13)
    assert drop_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("bucket", [1 << 10, 8 << 20])
def test_hot_passage(docs_of, monkeypatch, bucket):
    import tidewater.llm.substrings as module

    monkeypatch.setattr(module, "BUCKET_BYTES", bucket)  # small buckets make the passage's minimisers hot
    rows = [(i, f"x{i} " + "very common passage of more than thirteen words that a third of all documents hold in full" + f" y{i}") for i in range(300)]
    docs = docs_of(rows)
    hot = module.hot_minimisers(docs.select("text"), 300, 13, 3)
    assert len(hot) == (0 if bucket > 1 << 20 else len(hot) or -1)
    got = drop_repeats(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, 13)
    assert collections.Counter(r.n_removed for r in got) == {0: 1, 17: 299}


def test_many_texts_of_one_identifier(docs_of):
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(16)]
    rows = [(1, " ".join(passage)), (1, "short")]
    for i in (None, 7):
        for k in range(3000):
            words = [f"x{k}", *(f"z{rng.randrange(200)}" for _ in range(rng.randrange(12)))]
            if k % 3:
                at = rng.randrange(len(words) + 1)
                words[at:at] = passage
            rows.append((i, " ".join(words)))
    rows += rows[-5:] + [(None, rows[3][1])] * 40
    got = drop_repeats(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows, 13)
