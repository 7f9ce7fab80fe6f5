"""Substring deduplication by super-k-mers."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import FACTOR, INVERSE, chunks, find_words, gather, mix, powers, ranges, segment_hash, text_bytes
from .common import identifier, ship

#: About how many bytes of packed strings a bucket holds.
BUCKET_BYTES = 8 << 20
#: Bytes of texts whose strings a worker holds before it packs them: the more, the more strings of one bucket are compressed together.
HELD_BYTES = 24 << 20
#: About how long a packed string is, and how much longer the packed strings of a text are than the text.
STRING_BYTES, STRINGS_A_TEXT = 120, 3.4
#: Documents that hot minimisers are looked for in, about, and how many of them must have one at least.
SAMPLE, LEAST_SEEN = 4000, 8
#: Buckets that one task takes, one after the other, and about how many bytes of texts a task of the last join takes.
BUCKETS_A_TASK, JOIN_BYTES = 4, 64 << 20


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of words[i:i + length] for every i at which that many words are left."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(FACTOR, len(words)), dtype=np.uint64, out=sums[1:])
    return mix((sums[length:] - sums[:n]) * powers(INVERSE, n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    out = x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - step : width - step + len(x) - width + 1])


def minimisers(words: np.ndarray, first_word: np.ndarray, length: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its first word, its text and its minimiser."""
    n_windows = np.maximum(np.diff(first_word) - length + 1, 0)
    at = ranges(first_word[:-1], n_windows)
    least = sliding_min(window_hashes(words, minimiser), length - minimiser + 1)
    return at, np.repeat(np.arange(len(n_windows)), n_windows), least[at]


def name_minimisers(batches: Iterator[pa.RecordBatch], length: int, minimiser: int) -> Iterator[pa.RecordBatch]:
    """The different minimisers of each text."""
    for batch in chunks(batches, "text"):
        data, offsets = text_bytes(batch.column(0))
        starts, ends, first_word = find_words(data, offsets)
        if len(starts) >= length:
            _, doc, chosen = minimisers(segment_hash(data, starts, ends), first_word, length, minimiser)
            pairs = np.unique(np.column_stack([doc.astype(np.uint64), chosen]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].copy().view(np.int64))], names=["name"])


def hot_minimisers(texts: DataFrame, n_rows: int, length: int, minimiser: int) -> np.ndarray:
    """Minimisers of so many documents that their strings would fill a good part of a bucket, by a sample of about SAMPLE documents, read where they are:
    those in a third of all, whose neighbours make each string another. The list only decides which way windows
    travel, never whether they meet, so the result doesn't depend on it. It holds at most SAMPLE * (minimisers of a text) / LEAST_SEEN entries."""
    some = max(1, n_rows // SAMPLE)
    sampled = texts.sample(1 / some, seed=11) if some > 1 else texts
    enough = max(LEAST_SEEN, BUCKET_BYTES // (4 * STRING_BYTES) // some)
    names = sampled.mapInArrow(lambda it: name_minimisers(it, length, minimiser), "name long")
    found = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select("name").toArrow()
    return np.sort(found["name"].to_numpy().view(np.uint64))


def above(none: np.ndarray, docs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the identifier at a is larger than that at b; a null one is larger than all others."""
    return (none[a] > none[b]) | ((none[a] == none[b]) & (docs[a] > docs[b]))


def pack(none: np.ndarray, docs: np.ndarray, keys: np.ndarray, firsts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> bytes:
    """One bucket's share of a chunk: columns of numbers, then the packed strings."""
    parts = [none.astype("<i1"), docs.astype("<i8"), keys.astype("<i8"), firsts.astype("<i4"), counts.astype("<i4"), sizes.astype("<i4"), text]
    return struct.pack("<i", len(docs)) + zstandard.ZstdCompressor(level=5).compress(b"".join(p.tobytes() for p in parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<i", blob)
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    out, at = [], 0
    for kind in ("<i1", "<i8", "<i8", "<i4", "<i4", "<i4"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def cut(batches: Iterator[pa.RecordBatch], length: int, minimiser: int, n_buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts to super-k-mers: (bucket, blob), and spans that are settled already: (none, doc, key, from, to).

    The windows of a hot minimiser travel one by one, each to the bucket of its own hash.

    Within a chunk, equal super-k-mers travel once, with the smallest identifier: for the others the answer is
    known, every window of theirs starts in that document too. So a passage in a third of all documents
    sends one string per chunk. Strings are kept as places in the texts until HELD_BYTES of these have come together, then packed by bucket.
    """
    held: list[tuple[np.ndarray, ...]] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in chunks(batches, "text"):
        data, offsets = text_bytes(batch.column(2))
        none = batch.column(0).field("none").to_numpy(zero_copy_only=False).astype(np.int8)
        ids = batch.column(0).field("value").to_numpy(zero_copy_only=False)
        text_keys = batch.column(1).to_numpy(zero_copy_only=False)
        starts, ends, first_word = find_words(data, offsets)
        n_windows = np.maximum(np.diff(first_word) - length + 1, 0)
        if not n_windows.any():
            continue
        words = segment_hash(data, starts, ends)
        at, doc, chosen = minimisers(words, first_word, length, minimiser)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
        if len(hot):
            single = hot[np.minimum(np.searchsorted(hot, chosen), len(hot) - 1)] == chosen
            fresh |= single
            fresh[1:] |= single[:-1]
            chosen = np.where(single, window_hashes(words, length)[at], chosen)
        heads = np.flatnonzero(fresh)
        counts = np.diff(np.append(heads, len(at))) + length - 1  # words
        begin, owner, bucket = at[heads], doc[heads], (mix(chosen[heads]) % np.uint64(n_buckets)).astype(np.int64)
        whole = segment_hash(words, begin, begin + counts)
        order = np.lexsort((ids[owner], none[owner], whole))
        same = np.zeros(len(order), bool)
        same[1:] = (whole[order][1:] == whole[order][:-1]) & (counts[order][1:] == counts[order][:-1])
        leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        settled = order[above(none, ids, owner[order], owner[leader])]
        travels = np.ones(len(order), bool)
        travels[settled] = False
        if len(settled):
            rel = begin[settled] - first_word[owner[settled]]
            anywhere = mix(ids[owner[settled]].astype(np.uint64)) % np.uint64(n_buckets)  # these meet nobody
            yield spans_batch(none[owner[settled]], ids[owner[settled]], text_keys[owner[settled]], rel, rel + counts[settled], anywhere.astype(np.int64))
        # words with one space after each, then the strings of each bucket
        sizes = ends - starts + 1
        joined = gather(np.append(data, np.uint8(32)), starts, sizes)
        places = np.cumsum(sizes) - sizes
        joined[places + sizes - 1] = 32
        byte_at = np.append(places, len(joined))
        g = np.flatnonzero(travels)
        o, low = owner[g], byte_at[begin[g]]
        held.append((bucket[g], none[o], ids[o], text_keys[o], begin[g] - first_word[o], counts[g], byte_at[begin[g] + counts[g]] - low, low + size))
        texts.append(joined)
        size += len(joined)
        if size >= HELD_BYTES:
            yield packed_batch(held, np.concatenate(texts))
            held, texts, size = [], [], 0
    if held:
        yield packed_batch(held, np.concatenate(texts))


def packed_batch(held: list[tuple[np.ndarray, ...]], text: np.ndarray) -> pa.RecordBatch:
    """One blob for each bucket that has strings here."""
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.argsort(columns[0], kind="stable")
    bucket, *numbers, low = (c[order] for c in columns)
    long = numbers[-1]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    blobs = [pack(*(x[a:b] for x in numbers), gather(text, low[a:b], long[a:b])) for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=True)]
    n = len(blobs)
    blank = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges]), pa.array(blobs, pa.binary()), pa.nulls(n, pa.bool_()), blank, blank, blank, blank], names=NAMES)


SPAN = ["none", "doc", "key", "from", "to"]
NAMES = ["bucket", "blob", *SPAN]


def spans_batch(none: np.ndarray, doc: np.ndarray, key: np.ndarray, low: np.ndarray, high: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.nulls(n, pa.binary()), pa.array(none.astype(bool)), *[pa.array(x.astype(np.int64)) for x in (doc, key, low, high)]], names=NAMES)


def count_bucket(blobs: list[bytes], length: int) -> pa.RecordBatch | None:
    """Sorts the windows of one bucket; gives the spans of those that a smaller identifier has too."""
    parts = [unpack(b) for b in blobs]
    none, docs, keys, firsts, counts, sizes, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    stops = np.cumsum(sizes)
    starts, ends, first_word = find_words(text, np.concatenate(([0], stops)))
    words = segment_hash(text, starts, ends)
    n_windows = counts - length + 1
    at = ranges(first_word[:-1], n_windows)
    owner = np.repeat(np.arange(len(docs)), n_windows)
    place = firsts[owner] + (at - first_word[owner])
    hashes = window_hashes(words, length)[at]
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    twin = np.zeros(len(order) + 1, bool)
    twin[1:-1] = sorted_hashes[1:] == sorted_hashes[:-1]
    shared = order[twin[1:] | twin[:-1]]  # windows with a neighbour of the same hash
    if not len(shared):
        return None
    # the order by content: hash, then all words, then identifier
    columns = [docs[owner[shared]], none[owner[shared]], *[words[at[shared] + k] for k in range(length)], hashes[shared]]
    by = np.lexsort(columns)
    shared = shared[by]
    differs = np.zeros(len(shared), bool)
    differs[0] = True
    for c in columns[2:]:
        differs[1:] |= c[by][1:] != c[by][:-1]
    smallest = owner[shared][np.maximum.accumulate(np.where(differs, np.arange(len(shared)), 0))]
    hit = np.sort(shared[above(none, docs, owner[shared], smallest)])
    if not len(hit):
        return None
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit][1:] != owner[hit][:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(hit)) - 1
    o = owner[hit[head]]
    return spans_batch(none[o], docs[o], keys[o], place[hit[head]], place[hit[tail]] + length, np.zeros(len(head)))


def count_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket is in memory at a time."""
    now, held = None, []
    for batch in batches:
        buckets = batch.column(0).to_pylist()
        blobs = batch.column(1)
        settled = batch.filter(blobs.is_null())
        if settled.num_rows:
            yield settled.select(SPAN)
        for bucket, blob in zip(buckets, blobs, strict=True):
            if not blob.is_valid:
                continue
            if bucket != now:
                if held and (out := count_bucket(held, length)):
                    yield out.select(SPAN)
                now, held = bucket, []
            held.append(blob.as_py())
    if held and (out := count_bucket(held, length)):
        yield out.select(SPAN)


def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts, each compressed: the second shuffle that carries them is a third smaller."""
    shrink = zstandard.ZstdCompressor(level=1).compress
    for batch in chunks(batches, "text"):
        packed = pa.array([None if t is None else shrink(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], names=["doc_id", "id", "key", "packed"])


def unpressed(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, packed, spans) with their texts again, about ``most`` bytes at a time."""
    grow = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        packed = batch.column(1).to_pylist()
        sizes = np.cumsum([0] + [0 if p is None else zstandard.frame_content_size(p) for p in packed])
        at = 0
        while at < len(packed):
            stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            texts = pa.array([None if p is None else grow(p) for p in packed[at:stop]], pa.binary()).cast(pa.string())
            part = batch.slice(at, stop - at)
            yield pa.RecordBatch.from_arrays([part.column(0), texts, part.column(2)], names=["doc_id", "text", "spans"])
            at = stop


def drop_spans(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, packed, spans (a list of from, to); gives the counts and the kept words joined by a space."""
    for batch in unpressed(batches):
        data, offsets = text_bytes(batch.column(1))
        starts, ends, first_word = find_words(data, offsets)
        n_words = np.diff(first_word)
        spans = batch.column(2)
        flat = spans.flatten()
        per = np.diff(np.asarray(spans.offsets)) if len(spans) else np.zeros(0, int)
        if spans.null_count:
            per = np.where(np.asarray(spans.is_valid()), per, 0)
        covered = np.zeros(len(starts) + 1, np.int64)
        if len(flat):
            base = np.repeat(first_word[:-1], per)
            np.add.at(covered, base + flat.field(0).to_numpy(), 1)
            np.add.at(covered, base + flat.field(1).to_numpy(), -1)
        stays = np.cumsum(covered)[:-1] == 0
        kept = np.flatnonzero(stays)
        sizes = ends[kept] - starts[kept] + 1
        joined = gather(np.append(data, np.uint8(32)), starts[kept], sizes)
        if len(kept):
            joined[np.cumsum(sizes) - 1] = 32
        total = np.concatenate(([0], np.cumsum(sizes)))
        edges = total[np.searchsorted(kept, first_word)]
        raw = joined.tobytes()
        texts = [raw[a : b - 1] if b > a else b"" for a, b in zip(edges[:-1], edges[1:], strict=True)]
        removed = n_words - np.diff(np.searchsorted(kept, first_word))
        out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            out.append(pa.array(texts, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        yield pa.RecordBatch.from_arrays(out, names=names)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, minimiser: int = 3, with_text: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256`` and, where asked for, ``kept_text``.

    A window is ``length`` consecutive words of one document; each word covered by a window whose words
    also start in a document with a smaller identifier goes. Consecutive windows that share a minimiser
    (the ``minimiser`` consecutive words of least hash) travel as one packed string to the minimiser's bucket; equal
    windows have equal minimisers and so meet there, are sorted by all their words and counted. Windows of minimisers that a
    sample shows to be hot are dealt by their own hashes instead. Buckets hold about 8 MB of strings, by the size of the
    input, and are taken one at a time. Words are compared by 64-bit hashes, all of
    a window's words one by one; rows with the same identifier are told apart by the 64-bit hash of their texts.

    Nulls: a null text has no words; a null identifier comes after all others. Rows with the same identifier
    don't remove each other's words. An empty table gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    ident, text = identifier(F.col(id_col)), F.col(text_col).alias("text")
    rows = docs.select(ident.alias("id"), F.xxhash64(text_col).alias("key"), text)
    n_rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    n_buckets = max(64, int(size * STRINGS_A_TEXT) // BUCKET_BYTES)
    hot = hot_minimisers(docs.select(text), n_rows, length, minimiser)
    span = "none boolean, doc long, key long, `from` long, `to` long"
    packed = rows.mapInArrow(lambda it: cut(it, length, minimiser, n_buckets, hot), f"bucket long, blob binary, {span}")
    # as many tasks as the strings need, each with its share of the buckets
    n_tasks = -(-n_buckets // BUCKETS_A_TASK)
    dealt = packed.repartitionById(n_tasks, (F.col("bucket") % n_tasks).cast("int"))
    spans = dealt.sortWithinPartitions("bucket").mapInArrow(lambda it: count_windows(it, length), span)
    per_doc = spans.groupBy(F.struct("none", F.col("doc").alias("value")).alias("id"), "key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(F.col(id_col).alias("doc_id"), ident.alias("id"), F.xxhash64(text_col).alias("key"), text)
    whole = whole.mapInArrow(press, f"doc_id {kind}, id struct<none:boolean,value:bigint>, key long, packed binary")
    n_joined = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // JOIN_BYTES))
    joined = whole.repartition(n_joined, "id", "key").join(per_doc, ["id", "key"], "left").select("doc_id", "packed", "spans")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(lambda it: drop_spans(it, with_text), schema)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP10_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM windows), range(13) AS r(k) WHERE least < doc_id),
kept AS (SELECT x.doc_id, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.p) AS t
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) x ANTI JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
