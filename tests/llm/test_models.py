"""Search, the classifiers, HTML and BPE."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe, html_blocks, quality, toxicity
from tidewater.llm.topk import top_k


def brute_top(rows, k, scale=1024):
    import math

    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a, (i, q) in enumerate(sound):
        if i is None or i % 3:
            continue
        found = sorted(((-hold(sum(x * y for x, y in zip(q, v))), j if j is not None else 2**63) for b, (j, v) in enumerate(sound) if b != a and len(v) == len(q)))[:k]
        out += [(i, r, j if j != 2**63 else None, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.01), (3, 3e5)])
def test_top_k(spark, seed, spread):
    rng = random.Random(seed)
    vec = lambda d: [float(np.float32(rng.gauss(0, spread))) for _ in range(d)]
    common = vec(5)
    rows = [(i, common if i % 4 == 0 else vec(5)) for i in range(150)]
    rows += [(3, rows[3][1]), (3, vec(5)), (6, rows[6][1]), (None, vec(5)), (151, None), (152, [1.0, None, 0, 0, 0]), (153, [float("nan")] * 5), (156, [float("inf")] * 5), (159, [1.0, 2.0]), (160, [2.0, 1.0]), (162, [])]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, score int").repartition(3)
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 3 == 0, k=7).collect()]
    assert sorted(got, key=str) == brute_top(rows, 7)


def test_top_k_of_large_components(spark):
    """Each component is cut off on its own; the largest long is an identifier; ties go to the smaller one."""
    rows = [(0, [0.0, 0.7]), (1, [2.0**52, 0.7]), (3, [-0.3, 2.0**43 + 0.5]), (2**63 - 1, [1.5, 0.7]), (None, [1.5, 0.7]), (6, [0.7, -0.7]), (9, [1.5, 0.7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 3 == 0, k=6).collect()]
    assert sorted(got, key=str) == brute_top(rows, 6)
    assert {r[3] for r in got if r[0] == 0 and r[2] == 1} == {716 * 716}
    too_large = spark.createDataFrame([(0, [1e308]), (3, [1.0]), (6, [2.0])], "vec_id long, embedding array<double>")
    assert {r.query_id for r in top_k(too_large, F.col("vec_id") % 3 == 0).collect()} == {3, 6}


def test_top_k_in_blocks(spark, monkeypatch):
    import tidewater.llm.topk as module

    monkeypatch.setattr(module, "BLOCK", 10)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, k=5).collect()
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=str) == brute_top(rows, 5)


def test_top_k_of_nothing(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 3 == 0).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(1200):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(10, 60))).capitalize() + "."
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        if toxic:
            text += " you " + rng.choice(["idiot", "Stupid", "trash", "blorgs"]) + "!"
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join([words[i % 300]] * 60), text.replace(" ", " | "), text.replace(" ", "### ")])
        docs.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(labelled, docs_of, rough):
    docs, labels = labelled
    trees = quality.fit_quality(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.score_quality(docs, trees).collect() if held_out(r.doc_id)]
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in got]) > 0.97
    again = quality.fit_quality(docs.repartition(5), labels)
    assert again.value == trees.value and again.feature == trees.feature
    odd = docs_of(rough)
    scored = quality.score_quality(odd, trees, "own").collect()
    assert len(scored) == len(rough) and all(0 <= r.own <= 1 for r in scored)
    assert quality.score_quality(docs_of([]), trees).count() == 0
    none = quality.fit_quality(docs, labels.where("doc_id < 0"))
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}
    clash = odd.withColumn("score", F.lit("x")).withColumn("a `b", F.lit(1)).withColumn("a.b", F.lit(1))
    again = quality.score_quality(clash, trees)
    assert again.columns == [*clash.columns, "score_"] and all(0 <= r.score_ <= 1 and r.score == "x" for r in again.collect())
    # repeated rows count once, several labels of one identifier too
    twice = quality.fit_quality(docs.union(docs), labels.union(labels))
    assert twice.value == trees.value
    assert quality.training_rows(docs, labels, "quality", 100).count() == 100


def test_trees_are_flat_arrays():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    trees = quality.fit_trees(x, (x[:, 1] > 0.2).astype(float), n_trees=20)

    def walk(node, row):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node]
        return trees.value[node]

    plain = [1 / (1 + np.exp(-trees.base - sum(walk(root, row) for root in trees.roots))) for row in x[:50]]
    assert np.allclose(trees.score(x[:50]), plain)


def test_statistics():
    x = quality.statistics(pa.array(["One two two.\nOne two two.", None, "", "ÄÖ!!! |"]))
    names = dict(zip(quality.FEATURES, x[0], strict=True))
    assert names["distinct_words"] == 0.5 and names["same_as_before"] == 0 and names["repeated_lines"] == 0.5 and names["top_word"] == pytest.approx(1 / 3)
    assert not x[1].any() and not x[2].any() and np.isfinite(x).all()
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.FEATURES))


def test_toxicity(labelled, docs_of, rough):
    docs, labels = labelled
    chain = toxicity.fit_toxicity(docs, labels)
    assert [len(m.chain) for m in chain.models] == [0, 1, 2] and chain.models[2].chain.any() and 0 < chain.threshold < 1
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score_toxicity(docs, chain).collect() if held_out(r.doc_id)]
    flagged = [r.score >= chain.threshold for r in got]
    assert np.mean([f for f, r in zip(flagged, got) if truth[r.doc_id]]) > 0.85
    assert np.mean([f for f, r in zip(flagged, got) if not truth[r.doc_id]]) < 0.01
    scored = toxicity.score_toxicity(docs_of([*rough, (99, "what an IDIOT, idiot")]), chain).collect()
    assert len(scored) == len(rough) + 1 and max(scored, key=lambda r: r.score).doc_id == 99
    assert toxicity.score_toxicity(docs_of([]), chain).count() == 0
    none = toxicity.fit_toxicity(docs, labels.where("doc_id < 0"))
    assert len({r.score for r in toxicity.score_toxicity(docs_of(rough), none).collect()}) == 1


def test_toxic_kinds():
    """Categories are clusters of the toxic rows; the threshold is the best cut between predictions."""
    doc = np.repeat(np.arange(60), 2)
    place = np.array([[0, 1] if i < 20 else [2, 3] if i < 40 else [4, 5] for i in range(60)]).ravel()
    toxic = np.array([1.0] * 40 + [0.0] * 60)
    doc, place = np.append(doc, np.arange(60, 100)), np.append(place, np.full(40, 4))
    toxic[40:] = 0
    kinds = toxicity.kinds_of(doc, place, 6, toxic)
    assert len(set(kinds[:20])) == len(set(kinds[20:40])) == 1 and {kinds[0], kinds[20]} == {0, 1} and set(kinds[40:]) == {-1}
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1, 0, 0])) == pytest.approx(0.55)
    assert toxicity.best_threshold(np.array([0.5, 0.5]), np.array([1.0, 1])) == 0.5 and toxicity.best_threshold(np.zeros(0), np.zeros(0)) == 0.5
    brute = max(((f1(p, c), c) for p in [np.random.default_rng(1).random(50)] for c in p), key=lambda x: x[0])[0]
    p = np.random.default_rng(1).random(50)
    assert f1(p, toxicity.best_threshold(p, LABELS)) == pytest.approx(brute)


LABELS = (np.random.default_rng(2).random(50) < 0.4).astype(float)


def f1(p, cut):
    chosen = p >= cut
    return 2 * (chosen * LABELS).sum() / (chosen.sum() + LABELS.sum())


def test_chain_by_brute_force(labelled):
    """score_toxicity against the models applied feature by feature."""
    docs, labels = labelled
    chain = toxicity.fit_toxicity(docs, labels)
    rows = docs.limit(40).collect()
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, chain).collect()}
    for row in rows:
        _, features = toxicity.features_of(pa.array([row.text]))
        at = [k for k, name in enumerate(chain.names.tolist()) if name in set(features.tolist())]
        p = []
        for m in chain.models:
            p.append(1 / (1 + np.exp(-(m.bias + sum(m.weights[k] for k in at) + sum(c * x for c, x in zip(m.chain, p, strict=True))))))
        assert [got[row.doc_id].p_kind_1, got[row.doc_id].p_kind_2, got[row.doc_id].score] == pytest.approx(p)


def test_blocks():
    page = """<html><head><title>no</title><style>p{}</style></head><body><!-- <p>no</p> --><nav><a href="/">Home</a></nav><p class='x y-z'>One&nbsp;&amp; <b>two
      three<br>four<p>five &copy six<script>var a = "</p>";</script></p><ul><li>a<li>b</ul><select><option>no</select>tail <a title="a>b">link</a></body></html> &am"""
    found = html_blocks.blocks_of(page)
    assert [b.text for b in found] == ["Home", "One & two three four", "five © six", "a", "b", "tail link", "&am"]
    assert found[1].path[:6] == ["html", "body", "p", "x", "y", "z"] and found[0].linked == 4
    assert html_blocks.blocks_of("") == [] and [b.text for b in html_blocks.blocks_of("plain <p")] == ["plain"]
    assert html_blocks.blocks_of("<script>never closed") == []


def test_blocks_of_an_open_head():
    inside = '<meta charset=utf-8><title>no</title><link rel=x><style>p{}</style><script>no()</script><template><div>no</div><p>no</p></template>'
    rest = "<article><h1>Title</h1><p>One <b>two</b></article>"
    with_end = html_blocks.blocks_of(f"<html><head>{inside}</head><body>{rest}</body></html>")
    assert [b.text for b in with_end] == ["Title", "One two"]
    assert html_blocks.blocks_of(f"<html><head>{inside}\n<body>{rest}") == with_end
    for page in (f"<html><head>{inside}{rest}", f"<head>{inside}<head>{rest}", f"<head>{inside}<img src=x>{rest}"):
        assert [b.text for b in html_blocks.blocks_of(page)] == ["Title", "One two"]
    assert [b.text for b in html_blocks.blocks_of(f"<head>{inside} bare text<p>more")] == ["bare text", "more"]
    assert html_blocks.blocks_of(f"<html><head>{inside}") == []


def test_blocks_of_math_object_button():
    page = "<p>So <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds</p><object data=x><p>instead</p></object><button>Press</button><p>end"
    assert [b.text for b in html_blocks.blocks_of(page)] == ["So a=2 holds", "instead", "Press", "end"]


def test_lstm_gradients():
    rng = np.random.default_rng(2)
    model = html_blocks.Labeller({k: v.astype(float) for k, v in html_blocks.Labeller.fresh(3).weights.items()})
    x, mask = rng.normal(size=(4, 3, html_blocks.WIDTH)), np.ones((4, 3), bool)
    mask[2:, 1] = False
    y = rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        p = model.score(x, mask)
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name, at in (("ahead_own", (2, 5)), ("back_in", (7, 70)), ("ahead_bias", (30,)), ("out", (25,)), ("back_own", (3, 50))):
        w = model.weights[name]
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-8)


def test_references_are_decoded_in_each_piece():
    assert [b.text for b in html_blocks.blocks_of("<p>AT&am<b>p;T</b> &amp; &#x41;&copy&nbsp;x</p>")] == ["AT&amp;T & A© x"]


def test_deep_pages():
    """Features come from a bounded number of ancestors; texts from all depths."""
    page = "".join(f"<div class=c{k}>t{k} " for k in range(20_000))
    found = html_blocks.blocks_of(page)
    assert [b.text for b in found] == [f"t{k}" for k in range(20_000)]
    assert max(len(b.path) for b in found) <= 3 * (html_blocks.NEAREST + html_blocks.OUTERMOST)


#: Layouts that the made-up pages weren't written after: the page, and its article.
LAYOUTS = {
    "table in an article": (
        "<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><article><h1>Rainfall in 2020</h1><p>The table shows the rainfall of each month in the valley.</p>"
        "<table><tr><th>Month</th><th>mm</th></tr><tr><td>January</td><td>80</td></tr><tr><td>March</td><td>72</td></tr></table><p>Spring was dry this year.</p></article>"
        "<aside><h3>Related articles</h3><ul><li><a href=x>Snow</a></li></ul></aside><footer>&copy; 2021</footer></body></html>",
        "Rainfall in 2020|The table shows the rainfall of each month in the valley.|Month|mm|January|80|March|72|Spring was dry this year.",
    ),
    "odd identifier": (
        '<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><div id="x1"><h1>A walk along the river</h1><p>The path starts at the old mill and follows the water for two miles.</p>'
        "<p>After the bridge it climbs through a wood of beech and oak.</p><p>Bring water in summer.</p><p>From the top you can see the town and, on clear days, the sea beyond the marshes to the east.</p></div>"
        "<footer>&copy; example.org &middot; All rights reserved</footer></body></html>",
        "A walk along the river|The path starts at the old mill and follows the water for two miles.|After the bridge it climbs through a wood of beech and oak.|Bring water in summer.|From the top you can see the town and, on clear days, the sea beyond the marshes to the east.",
    ),
    "plain boxes": (
        "<html><body><div><div><a href=/>Startseite</a> | <a href=/k>Kontakt</a></div><h1>Die Geschichte der Mühle</h1><div>Die Mühle wurde im Jahr 1780 gebaut und gehörte lange Zeit der Familie Weber. Sie steht am Ufer des kleinen Flusses.</div>"
        "<table><tr><th>Jahr</th><th>Besitzer</th></tr><tr><td>1780</td><td>Weber</td></tr></table><div>Heute ist in der Mühle ein Museum untergebracht, das jedes Jahr viele Besucher anzieht.</div></div></body></html>",
        "Die Geschichte der Mühle|Die Mühle wurde im Jahr 1780 gebaut und gehörte lange Zeit der Familie Weber. Sie steht am Ufer des kleinen Flusses.|Jahr|Besitzer|1780|Weber|Heute ist in der Mühle ein Museum untergebracht, das jedes Jahr viele Besucher anzieht.",
    ),
    "blog with comments": (
        '<html><body class="single"><div id="page"><header id="masthead"><h1 class="site-title"><a href="/">My Blog</a></h1><nav id="site-navigation"><ul class="menu"><li><a href=/>Home</a><li><a href=/about>About</a></ul></nav></header>'
        '<div id="content"><main><article class="post"><h1 class="entry-title">How to bake bread</h1><div class="entry-content"><p>Bread needs only flour, water, salt and time.</p><ol><li>Mix the flour and water.</li><li>Wait an hour.</li></ol>'
        "<pre><code>flour = 500\nwater = 350</code></pre><dl><dt>Crumb</dt><dd>The inner part of the loaf.</dd></dl></div></article>"
        '<div id="comments"><h2>2 comments</h2><ol class="comment-list"><li><b>Ann</b> says: <p>I tried this and it worked very well, thank you for the recipe!</p></li></ol></div></main>'
        '<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent Posts</h2><ul><li><a href=1>Soup</a></li></ul></section></aside></div><footer id="colophon">Proudly powered by example</footer></div></body></html>',
        "How to bake bread|Bread needs only flour, water, salt and time.|Mix the flour and water.|Wait an hour.|flour = 500 water = 350|Crumb|The inner part of the loaf.",
    ),
    "nothing around": ("<h1>Notes</h1><p>First note of the day.</p><p>Second.</p>", "Notes|First note of the day.|Second."),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_other_layouts(spark, name):
    page, article = LAYOUTS[name]
    assert html_blocks.main_text([page], html_blocks.labellers(spark)) == [article.replace("|", "\n")]


def test_main_text(spark):
    models = html_blocks.labellers(spark)
    right = total = 0
    for k in range(150):
        found, wanted = html_blocks.made_up_page(f"unseen:{k}")
        right, total = right + ((html_blocks.label(models, [found])[0] >= 0.5) == wanted).sum(), total + len(found)
    assert right / total > 0.98
    page = "<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article><h1>The title of it</h1><p>First paragraph of the text, with some words.</p><p>Second one &amp; last.</p></article><footer>&copy; example.org all rights</footer></body></html>"
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "v", "", 0), (None, "w", page, 0), (1, "u", page, 0)]
    got = html_blocks.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    want = "The title of it\nFirst paragraph of the text, with some words.\nSecond one & last."
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == sorted([("1", "u", want, len(want))] * 2 + [("2", "None", "", 0), ("3", "v", "", 0), ("None", "w", want, len(want))])
    assert html_blocks.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    path = bpe.default_path()
    with open(path, "rb") as f:
        return tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(f.read())


def test_bpe_matches_the_library(both):
    library, own = both
    rng = random.Random(6)
    letters = list("abcdefgh AB'strevmld.,!12é́\U0001f600\t\nßΣς中文ȩ|<>")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", " ", "a" * 999, "aaaa aaa aa a", "Σίσυφος ΟΔΟΣ", "I'LL don't 'S", "<|endoftext|>x<|startoftext|> <|x", "İstanbul ½ ①", "x" * 5000 + " the"]
    # letters of later versions of Unicode, alone and beside letters, numbers and symbols; capitals of them; a pair that isn't composed
    texts += ["\ua7ce", "\ua7cf!", "a\ua7cf", "\ua7cf", "1\ua7cf2 \U00016ea0x", "\u1c89\u1c8a \U00010d50", "\U00018e00\U00018e01# ok", "\U000323b0a", "\U00011935\U00011930e\u0301", "e\u0301 x"]
    ids, counts = own.encode(texts)
    edges = np.concatenate(([0], np.cumsum(counts)))
    decoded = own.decode(ids, counts)
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[edges[k] : edges[k + 1]].tolist() == e.ids, texts[k]
        assert decoded[k].decode() == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_on_tables(both, docs_of, rough):
    library, _ = both
    got = bpe.encode_and_decode(docs_of(rough)).collect()
    want = []
    for i, t, _ in rough:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(e), e, library.decode(e, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids, r.decoded) for r in got) == sorted(want)
    digests = bpe.encode_and_decode(docs_of(rough), digests=True).collect()
    assert sorted(r.ids_sha256 for r in digests) == sorted(hashlib.sha256(np.array(w[2], "<u4").tobytes()).hexdigest() for w in want)
    assert bpe.encode_and_decode(docs_of([])).count() == 0
