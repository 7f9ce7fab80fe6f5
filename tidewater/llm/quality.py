"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, SPACE, chunks, find_words, segment_hash, text_bytes
from .common import fresh, ship

#: Most labelled texts that the trees are fitted on: those of least hash.
TRAINING_ROWS = 20_000
#: Bytes of texts measured at once: each takes some 50 bytes of memory.
PIECE = 1 << 20
#: From this score on a document is predicted to be of good quality.
THRESHOLD = 0.3

# Classes of bytes. Upper and lower case and digits are ASCII's; bytes from 128 on are counted apart.
CLASSES = ("control", "blank", "newline", "upper", "lower", "digit", "stop", "comma", "quote", "bracket", "pipe", "bang", "symbol", "high")
CLASS = np.zeros(256, np.int64)
for _name, _bytes in (
    ("blank", b" \t\x0b\x0c"), ("newline", b"\n\r"), ("upper", bytes(range(65, 91))), ("lower", bytes(range(97, 123))), ("digit", b"0123456789"), ("stop", b".?;:"),
    ("comma", b","), ("quote", b"\"'`"), ("bracket", b"()[]{}<>"), ("pipe", b"|"), ("bang", b"!"), ("symbol", b"#$%&*+-/=@\\^_~"), ("high", bytes(range(128, 256))),
):
    CLASS[list(_bytes)] = CLASSES.index(_name)
FEATURES = (
    *(f"share_{c}" for c in CLASSES), "log_words", "word_length", "word_length_spread", "distinct_words", "top_word", "same_as_before", "capitalised", "all_upper",
    "ends_in_symbol", "ends_sentence", "one_letter", "long_words", "log_lines", "words_a_line", "repeated_lines", "distinct_pairs",
)


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def distinct_and_top(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each document has, and how often its most frequent one occurs."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(hashes):
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        distinct = np.bincount(d[head], minlength=n).astype(float)
        np.maximum.at(top, d[head], np.diff(np.append(head, len(h))).astype(float))
    return distinct, top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, of the whole text. Empty texts have zeros."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    of_byte = np.repeat(np.arange(n), sizes)
    shares = np.bincount(of_byte * len(CLASSES) + CLASS[data], minlength=n * len(CLASSES)).reshape(n, len(CLASSES)) / np.maximum(sizes, 1)[:, None]
    starts, ends, first = find_words(data, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    words = np.maximum(n_words, 1)
    lengths = (ends - starts).astype(float)
    mean = per_doc(lengths, doc, n) / words
    spread = np.sqrt(np.maximum(per_doc(lengths**2, doc, n) / words - mean**2, 0))
    hashes = segment_hash(LOWER[data], starts, ends)
    distinct, top = distinct_and_top(hashes, doc, n)
    inside = np.append(False, doc[1:] == doc[:-1])[: len(doc)]
    same = np.append(False, hashes[1:] == hashes[:-1])[: len(doc)] & inside
    pairs = hashes[1:] * np.uint64(31) + hashes[:-1] if len(hashes) > 1 else hashes[:0]
    pair_doc = doc[1:][inside[1:]] if len(doc) else doc
    distinct_pairs, _ = distinct_and_top(pairs[inside[1:]] if len(pairs) else pairs, pair_doc, n)
    kinds = CLASS[data]
    upper, symbol = CLASSES.index("upper"), (CLASSES.index("symbol"), CLASSES.index("bang"), CLASSES.index("pipe"))
    ups = np.concatenate(([0], np.cumsum(kinds == upper)))
    capital = kinds[starts] == upper if len(starts) else np.zeros(0, bool)
    shouted = (ups[ends] - ups[starts] >= 2) & (ups[ends] - ups[starts] >= 0.6 * lengths)
    last = kinds[ends - 1] if len(ends) else np.zeros(0, np.int64)
    # lines with something in them
    breaks = np.unique(np.concatenate((offsets, np.flatnonzero(kinds == CLASSES.index("newline")) + 1)))
    low, high = breaks[:-1], breaks[1:]
    filled = np.concatenate(([0], np.cumsum(~SPACE[data])))
    some = filled[high] > filled[low]
    low, high = low[some], high[some]
    line_doc = np.searchsorted(offsets, low, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n).astype(float)
    high = high - (kinds[high - 1] == CLASSES.index("newline"))
    distinct_lines, _ = distinct_and_top(segment_hash(data, low, high), line_doc, n)
    columns = [
        np.log1p(n_words), mean, spread, distinct / words, top / words, per_doc(same, doc, n) / words, per_doc(capital, doc, n) / words, per_doc(shouted, doc, n) / words,
        per_doc(np.isin(last, symbol), doc, n) / words, per_doc(last == CLASSES.index("stop"), doc, n) / words, per_doc(lengths == 1, doc, n) / words, per_doc(lengths > 20, doc, n) / words,
        np.log1p(n_lines), n_words / np.maximum(n_lines, 1), (n_lines - distinct_lines) / np.maximum(n_lines, 1), distinct_pairs / np.maximum(n_words - 1, 1),
    ]
    return np.column_stack([shares, *columns])


class Trees:
    """Boosted trees for a 0/1 label, all nodes in flat arrays. A leaf points to itself."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.roots: list[int] = []
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def node(self) -> int:
        k = len(self.feature)
        for column, x in ((self.feature, 0), (self.cut, np.inf), (self.left, k), (self.right, k), (self.value, 0.0)):
            column.append(x)
        return k

    def score(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.asarray(c) for c in (self.feature, self.cut, self.left, self.right, self.value))
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
            total += value[at]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Gradient boosting on logistic loss. Values are binned by quantiles once; each level's gradients and
    curvatures are summed in one histogram over (node, feature, bin)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    trees = Trees(float(np.log(share / (1 - share))), depth)
    if len(y) < 2 * least or len(np.unique(y)) < 2:
        return trees
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    total = np.full(n, trees.base)
    shift = np.arange(width) * bins
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = y - p, p * (1 - p)
        root = trees.node()
        trees.roots.append(root)
        at = np.full(n, root)
        level = [root]
        for d in range(depth + 1):
            slot = {node: k for k, node in enumerate(level)}
            live = np.flatnonzero(np.isin(at, level))
            if not len(live):
                break
            index = np.searchsorted(level, at[live])
            cells = (index[:, None] * (width * bins) + shift + binned[live]).ravel()
            shape = (len(level), width, bins)
            size = len(level) * width * bins
            g = np.bincount(cells, np.repeat(gradient[live], width), size).reshape(shape)
            h = np.bincount(cells, np.repeat(curve[live], width), size).reshape(shape)
            c = np.bincount(cells, minlength=size).reshape(shape)
            below_g, below_h, below_c = g.cumsum(2), h.cumsum(2), c.cumsum(2)
            all_g, all_h, all_c = below_g[:, :1, -1:], below_h[:, :1, -1:], below_c[:, :1, -1:]
            gain = below_g**2 / (below_h + ridge) + (all_g - below_g) ** 2 / (all_h - below_h + ridge) - all_g**2 / (all_h + ridge)
            gain = np.where((below_c >= least) & (all_c - below_c >= least), gain, 0)
            following = []
            for node, k in slot.items():
                f, b = np.unravel_index(int(np.argmax(gain[k])), (width, bins))
                if d == depth or gain[k, f, b] <= 1e-6 or b >= len(edges[f]):
                    trees.value[node] = rate * float(all_g[k, 0, 0] / (all_h[k, 0, 0] + ridge))
                    continue
                trees.feature[node], trees.cut[node] = int(f), float(edges[f][b])
                trees.left[node], trees.right[node] = trees.node(), trees.node()
                mine = live[at[live] == node]
                at[mine] = np.where(binned[mine, f] <= b, trees.left[node], trees.right[node])
                following += [trees.left[node], trees.right[node]]
            level = sorted(following)
            if not level:
                break
        total += np.asarray(trees.value)[at]
    return trees


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, doc_id, tkey, text) to (label, doc_id, tkey, x), the text's statistics."""
    for batch in chunks(batches, "text", PIECE):
        x = statistics(batch.column(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())], names=["label", "doc_id", "tkey", "x"])


def apply(batches: Iterator[pa.RecordBatch], shared, text_col: str) -> Iterator[pa.RecordBatch]:
    trees = shared.value
    for batch in chunks(batches, text_col, PIECE):
        score = trees.score(statistics(batch.column(batch.schema.get_field_index(text_col))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(label, doc_id, tkey, text): the rows of at most ``most`` different labelled texts, those of least hash, of the four folds in
    five that may be learnt from. Only identifiers and hashes are sorted and broadcast; texts stay where they are read, so rows that
    repeat one (doc_id, text) are all there. Of several labels of one identifier the least counts."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = labels.where((fold != 0) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label).cast("double")).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    keys = keyed.select("doc_id", "tkey").join(F.broadcast(known), "doc_id").distinct().orderBy(F.xxhash64("doc_id", "tkey"), "doc_id", "tkey").limit(most)
    return keyed.join(F.broadcast(keys), ["doc_id", "tkey"]).select("label", "doc_id", "tkey", "text")


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Trees:
    """Trees fitted on a bounded sample of labelled documents. Each text is measured by the task that reads it; the driver
    gets at most ``most`` rows of numbers, sorted, so that reruns agree.

    Nulls: rows with a null label or identifier are not learnt from; a null text counts as empty. Without labels, or with one kind of label only, or too few,
    the trees give every text the share of label 1 (one half where there is none). Repeated rows count once. Other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = training_rows(docs, labels, "quality", most).mapInArrow(measure, f"label double, doc_id {kind}, tkey long, x array<double>")
    found = measured.dropDuplicates(["doc_id", "tkey"]).orderBy(F.xxhash64("doc_id", "tkey"), "doc_id", "tkey").limit(most).toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return fit_trees(x, found["label"].to_numpy())


def score_quality(docs: DataFrame, trees: Trees, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with one more column, the last: 0 to 1, higher where label 1 is likelier. It is called ``name``, with underscores added
    where docs has a column of that name already. Every text is read whole; nothing is shuffled.

    Nulls: a null text counts as empty; an empty text has all statistics zero and its score like any other. Repeated rows
    are scored alike; an empty table gives none. All columns pass through as they are.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    # under plain names, whatever those of docs are
    plain = [f"c{k}" for k in range(len(docs.columns))]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)), T.StructField("score", T.DoubleType())])
    return docs.toDF(*plain).mapInArrow(_scorer(shared, plain[docs.columns.index(text_col)]), schema).toDF(*docs.columns, fresh(docs, name))


def _scorer(shared, text_col: str):
    def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return apply(batches, shared, text_col)

    return scorer


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = score_quality(docs.select("doc_id", "text"), trees)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
