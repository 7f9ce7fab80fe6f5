"""Exact dedup, mixing and personal data against plain Python."""

import collections
import hashlib
import re

import pytest

from tidewater.llm.exact_dedup import exact_dedup
from tidewater.llm.mixing import mix_sources, mixed_documents, radical_inverse
from tidewater.llm.pii import BASE, PATTERNS, find_pii, joined

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("keep,best", [("min", min), ("max", max)])
def test_exact_dedup(docs_of, rough, keep, best):
    df = exact_dedup(docs_of(rough), keep=keep)
    assert plain(df)
    groups = collections.defaultdict(list)
    for i, t, _ in rough:
        groups[(t or "").translate(ASCII)].append(i)
    expected = []
    for i, t, _ in rough:
        g = groups[(t or "").translate(ASCII)]
        expected.append((i, best([x for x in g if x is not None], default=None), len(g), hashlib.sha256((t or "").translate(ASCII).encode()).hexdigest()))
    got = [tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()]
    assert sorted((r[:4] for r in got), key=str) == sorted(expected, key=str)
    assert sum(r[4] for r in got) == len(groups)  # one of each text
    assert all(r[0] == r[1] for r in got if r[4])
    assert exact_dedup(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup(docs_of([]), keep="any")


@pytest.mark.parametrize("keep,best", [("min", min), ("max", max)])
def test_hot_text_over_many_ranges(docs_of, keep, best):
    """A text of two thirds of all rows, some without an identifier, over ranges of 20 rows; texts that differ after a long common start."""
    rows = [(i % 500 if i % 7 else None, "Copy" if i % 3 else "same start of all of these texts, which is longer than a head " + "x" * (i % 40)) for i in range(900)]
    rows += [(2**63 - 1, "copy"), (-(2**63), "last"), (3, "last"), (None, "alone")]
    df = exact_dedup(docs_of(rows), keep=keep, range_rows=20)
    assert plain(df) and "hashpartitioning(text_sha256" not in df._jdf.queryExecution().executedPlan().toString()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t.translate(ASCII)].append(i)
    want = collections.Counter((i, best([x for x in groups[t.translate(ASCII)] if x is not None], default=None), len(groups[t.translate(ASCII)])) for i, t in rows)
    got = df.collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_ranges(docs_of):
    """Rows of the content order are dealt evenly, and a hot text goes over several neighbouring ranges."""
    from pyspark.sql import functions as F

    from tidewater.llm.exact_dedup import range_of, splitters_of

    df = docs_of([(i, "copy" if i % 3 else f"{i:04}") for i in range(900)]).select("doc_id", "text")
    key = F.struct("text", "doc_id")
    splitters, n = splitters_of(df, key, 9)
    assert n == 8
    rows = [(r.text, r.doc_id, r.range) for r in df.withColumn("range", range_of(key, splitters, n)).collect()]
    assert [r[2] for r in sorted(rows)] == sorted(r[2] for r in rows)
    assert set(collections.Counter(r[2] for r in rows).values()) == {100}
    assert len({r[2] for r in rows if r[0] == "copy"}) == 6


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            break
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    return {s: 3 * sizes[s] if s in full else level * weight[s] for s in names}


@pytest.mark.parametrize("case", ["rough", "many", "one", "tiny"])
def test_mixing(docs_of, rough, case):
    rows = {
        "rough": rough,
        "many": [(i, " ".join(["w"] * (i * 7 % 90)), "hot" if i % 3 else f"s{i % 11}") for i in range(900)],
        "one": [(i, "a b c", "s") for i in range(50)],
        "tiny": [(1, "a", "x"), (2, " ".join("b" * 5000), "y"), (3, "c d", None)],
    }[case]
    df = mix_sources(docs_of(rows), block=64)
    assert plain(df)
    got = [r.asDict() for r in df.collect()]
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in got) == sorted((str(i), size(t), str(s)) for i, t, s in rows)
    per = collections.Counter()
    for _, t, s in rows:
        per[s] += size(t)
    targets = brute_targets(per)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(targets[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["slots"] == sorted(r["slots"]) and (r["slots"] or not r["taken"])
        taken[r["source"]] += r["taken"]
    for s in per:
        assert abs(taken[s] - targets[s]) <= 0.5 + 1e-6
    again = [r.asDict() for r in mix_sources(docs_of(rows[::-1]), block=64).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_of_nothing(docs_of):
    assert mix_sources(docs_of([])).count() == 0
    assert [r.taken for r in mix_sources(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_schedule_interleaves(docs_of):
    """In the order of the schedule, each stretch of the mix has the sources' shares."""
    rows = [(i, " ".join(["w"] * 8), f"s{i % 3}") for i in range(6000)]
    got = mix_sources(docs_of(rows), block=16).where("taken > 0").collect()
    order = [s for _, s in sorted((slot, r.source) for r in got for slot in r.slots)]
    for at in range(0, len(order) - 600, 600):
        part = collections.Counter(order[at : at + 600])
        for k in range(3):
            assert abs(part[f"s{k}"] - 100 * (k + 1)) <= 12
    mixed = [r.source for r in mixed_documents(docs_of(rows), block=16).collect()]
    first = collections.Counter(mixed[:600])
    assert all(abs(first[f"s{k}"] - 100 * (k + 1)) <= 12 for k in range(3))


def test_growth_keeps_blocks(docs_of):
    with pytest.raises(ValueError):
        mix_sources(docs_of([(1, "a b c")]), block=0.0000000005)


def test_mixed_documents(docs_of):
    rows = [(i, "a b c d", "big" if i < 80 else "small") for i in range(100)]
    docs = docs_of(rows)
    got = mixed_documents(docs, block=16)
    assert got.columns == docs.columns
    count = collections.Counter(r.source for r in got.collect())
    assert abs(count["big"] - 40) <= 1 and abs(count["small"] - 60) <= 1  # small stops at three times its size


def test_radical_inverse(spark):
    eight = spark.range(8)
    assert [r[0] for r in eight.select(radical_inverse(eight.id)).collect()] == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


# The base kinds' patterns as they are specified.
SPECIFIED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in SPECIFIED.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(docs_of, rough):
    texts = [
        "a@b.c_d@e.f %x@y.z a@@b.c a@b..c -@-.- é@ü.com x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.01 1.2.3", "😀 +1 (2) 3-4.567890123 ++1+2 +12345678 +1234567890123456 +49 30 1234567.",
        "4111-1111 1111 1111 4111 1111 1111 1112 1 2 3 12345678901234567890123", "1" * 3000 + " " + "a" * 3000 + "@" + "b.c" * 500, "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, GB82 WEST 1234 5698 7654 33",
        "ssn: 123-45-6789 then invoice 123-45-6789", "\x00 a@b.co \x85+49 (30) 12345-678",
        "IBANs: GB82 WEST 1234 5698 7654 32, DE89370400440532013000, DE89370400440532013000", "123-45-6789 is my social security number", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" commit 04dbebab91ab85687d33eeaaf9ac699e1188f962',
    ]
    rows = [*rough, *((100 + k, t) for k, t in enumerate(texts))]
    df = find_pii(docs_of(rows)).select("doc_id", joined(BASE).alias("base"), joined(tuple(PATTERNS)).alias("all"))
    assert plain(df)
    got = {r.doc_id: r for r in df.collect() if r.doc_id is not None}
    for i, t, *_ in rows:
        if i is not None:
            assert got[i].base == brute_spans(t or ""), (i, t and t[:50])
    assert got[105]["all"].endswith("iban:0:27,iban:32:54") and got[106]["all"] == "ssn:5:16"
    assert got[108]["all"] == "iban:7:34,iban:36:58,iban:60:82" and got[109]["all"] == "ssn:0:11" and got[110]["all"] == "secret:9:49"
    assert find_pii(docs_of([])).count() == 0


def test_scores_follow_context(docs_of):
    rows = [(1, "call +49 30 1234567"), (2, "part serial no. +49 30 1234567"), (3, "+49 30 1234567"), (4, "+49 30 1234567 (telefon)")]
    got = {r.doc_id: r.phone[0].score for r in find_pii(docs_of(rows)).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.4, 3: 0.7, 4: 1.0})


def test_many_matches(docs_of):
    """Positions in a text with thousands of matches; the work is n log n."""
    text = " ".join(f"user{i}é@mail{i}.org" if i % 2 else f"10.0.{i % 256}.1" for i in range(20_000))
    (row,) = find_pii(docs_of([(1, text)])).select(joined(BASE).alias("base")).collect()
    assert row.base == brute_spans(text)


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from tidewater.llm.pii import running_sums

    for n in (0, 1, 2, 3, 17, 64, 1000):
        values = [k * 7 % 11 for k in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        assert df.select(running_sums(F.col("v"))).first()[0] == [sum(values[: k + 1]) for k in range(n)]
