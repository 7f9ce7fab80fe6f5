"""The stages one by one against brute force, and all together."""

import collections
import os

import pytest

import corpus_pipeline
from tests.llm.test_dedup import ASCII, brute_components

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    before = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = [r.asDict() for r in out.collect()]
        if name == "bpe":
            assert len(after) == len(before) and all(r["n_tokens"] > 0 for r in after)
            break
        assert out.columns == columns
        if name == "quality":
            good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
            kept = {r["doc_id"] for r in after}
            assert len(good & kept) >= 0.97 * len(good) and len(after) < len(before)
        elif name == "exact_dedup":
            least = {}
            for r in before:
                key = (r["text"] or "").translate(ASCII)
                least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted(least.values())
        elif name == "near_dedup":
            found = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert sorted(r["doc_id"] for r in after) == sorted(i for i, _, c in found if i == c)
        else:
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            assert max(collections.Counter(r["doc_id"] for r in after).values()) <= 3
        docs, before = out, after


def test_dedup_decides_by_row(spark, docs_of):
    """Repeated rows, null identifiers, and one identifier over different texts, in both dedup stages."""
    base = [f"w{k}" for k in range(60)]
    near = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 60, 10)]
    other = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdefgh"]
    lone = [" ".join([*other[0].split()[:k], f"n{k}"]) for k in (28, 29)]  # near copies of other[0]
    rows = [(1, near[0]), (None, near[0].upper()), (None, near[1]), (2, near[2]), (2, near[2]), (2, near[3])]
    rows += [(None, t) for t in (*other[:3], *other[:3], other[0].upper(), *lone)] + [(5, other[3])] * 4 + [(5, other[4]), (6, other[3])]
    rows += [(7, other[5]), (7, lone[0]), (8, None), (8, ""), (None, None), (None, " "), (None, other[6]), (9, other[6])]
    docs = docs_of(rows)
    norm = lambda t: (t or "").translate(ASCII)
    least = {}
    for i, t in rows:
        least[norm(t)] = min(least.get(norm(t), (True, 0)), (i is None, i or 0))
    wanted = sorted(((None if none else i, t) for t, (none, i) in least.items()), key=str)
    exact = corpus_pipeline.distinct_documents(spark, docs, DATA)
    assert exact.columns == docs.columns
    assert sorted(((r.doc_id, norm(r.text)) for r in exact.collect()), key=str) == wanted

    for before in (rows, [(r.doc_id, r.text) for r in exact.collect()]):
        after = corpus_pipeline.without_near_copies(spark, docs_of(before), DATA)
        assert after.columns == docs.columns
        after = [(r.doc_id, r.text) for r in after.collect()]
        assert not collections.Counter(after) - collections.Counter(before)
        # one row of each component, with the component's smallest identifier; wordless rows all stay
        groups = components_of(before)
        assert len(after) == len(groups)
        for g in groups:
            found = [i for i, t in after if (i, t) in g]
            least = min((i is None, i or 0) for i, _ in g)
            assert {(i is None, i or 0) for i in found} == {least}
            assert len(found) == 1 or not (g[0][1] or "").strip()


def components_of(rows):
    """Rows by component, wordless rows alone."""
    named = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    groups = {}
    for k, _, c in named:
        groups.setdefault(c, []).append(rows[k])
    return list(groups.values())


def test_run(spark):
    df = corpus_pipeline.run(spark, DATA)
    assert df.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    rows = df.collect()
    assert rows and all(r.n_tokens == len(r.ids) > 0 and r.decoded for r in rows)


def test_odd_rows(spark, docs_of, rough):
    """Each stage on nulls, empty and long texts, repeated rows and columns with names that operators use, then on no rows at all."""
    docs = docs_of(rough)
    counts = lambda df: collections.Counter(map(str, df.collect()))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name == "bpe":
            assert len(out.collect()) == len(rough) and {r.n_tokens for r in out.collect() if r.decoded == ""} == {0}
        else:
            assert out.columns == docs.columns
        if name == "quality":
            assert not counts(out) - counts(docs)
        if name == "exact_dedup":
            assert out.count() == len({(t or "").translate(ASCII) for _, t, _ in rough})
        if name == "near_dedup":
            assert out.count() == len(components_of([r[:2] for r in rough]))
        if name == "mixing":
            worded = {str(r) for r in docs.where("text rlike '[^\\\\s]'").collect()}
            assert set(counts(out)) <= worded
        assert stage(spark, docs_of([]), DATA).count() == 0
