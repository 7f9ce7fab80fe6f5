"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full sets confirm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, chunks, find_words, mix, ranges, segment_hash, text_bytes
from .common import discard, hot_keys, identifier, save, ship, spread_join
from .substrings import window_hashes

#: Bands of rows: at a similarity of 0.85 all bands miss with a probability of (1 - 0.85**4)**20 < 4e-7, above it less.
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, and how many may differ: samples that differ toggle two bits each at most, and two sets
#: of similarity 0.85 differ in more than 33 of 80 samples with a probability below 1e-7.
SKETCH_BITS, MOST_BITS = 512, 66
#: Members of a star that one group verifies; members of a bucket, and shingles in them, that one block compares.
STAR, BLOCK, BLOCK_SHINGLES = 128, 256, 1 << 20


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, ascending within the text, and how many each has."""
    data, offsets = text_bytes(texts)
    starts, ends, first_word = find_words(LOWER[data], offsets)
    words = segment_hash(LOWER[data], starts, ends)
    n_words = np.diff(first_word)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    at = ranges(first_word[:-1], n)
    owner = np.repeat(np.arange(len(n)), n)
    hashes = np.append(window_hashes(words, shingle), np.zeros(shingle, np.uint64))[at] if len(at) else np.zeros(0, np.uint64)
    short = n_words[owner] < shingle
    if short.any():
        o = owner[short]
        hashes[short] = segment_hash(words, first_word[o], first_word[o + 1])
    order = np.lexsort((hashes, owner))
    hashes = hashes[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(n))


def describe(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """id, tkey, text to id, tkey, size of the set, its digest, the keys of its bands and its odd sketch."""
    rng = np.random.default_rng(20240229)
    flips = rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
    factors = rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in chunks(batches, "text", 1 << 20):
        hashes, sizes = shingle_sets(batch.column(2), shingle)
        n, some = len(sizes), sizes > 0
        heads = (np.cumsum(sizes) - sizes)[some]
        digest = np.zeros((n, 2), np.uint64)
        bands = np.zeros((n, BANDS), np.uint64)
        toggles = np.zeros((n, SKETCH_BITS), np.uint8)
        if len(heads):
            for k, salt in enumerate((0x1234567, 0xFEDCBA9)):
                digest[some, k] = mix(np.add.reduceat(mix(hashes ^ np.uint64(salt)), heads) + sizes[some].astype(np.uint64))
            rows = np.flatnonzero(some)
            for j in range(SAMPLES):
                sample = np.minimum.reduceat(((hashes ^ flips[j]) * factors[j]) >> np.uint64(32), heads)
                own = mix(sample + np.uint64(j << 32))
                bands[some, j // ROWS] = mix(bands[some, j // ROWS] + own)
                toggles[rows, (own % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
        sketch = np.packbits(toggles, axis=1).view("<i8")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array([d.tobytes() for d in digest], pa.binary()),
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, bands.view(np.int64).reshape(-1)),
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (SKETCH_BITS // 64), sketch.reshape(-1)),
            ],
            names=["id", "tkey", "n", "digest", "bands", "sketch"],
        )


def may_be_similar(a_n: Column, b_n: Column, a: Column, b: Column, percent: int) -> Column:
    """Sizes and sketches don't rule the pair out."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (F.least(a_n, b_n) * 100 >= F.greatest(a_n, b_n) * percent) & (apart <= MOST_BITS)


def verify_stars(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, leaf, digest, text) sorted so that each group's hub comes first; gives the confirmed (hub, leaf)."""
    group, center = None, np.zeros(0, np.uint64)
    for batch in chunks(batches, "text"):
        hashes, sizes = shingle_sets(batch.column(4), shingle)
        edges = np.concatenate(([0], np.cumsum(sizes)))
        hubs, salts, leaves, digests = (batch.column(k).to_pylist() for k in range(4))
        found: list[tuple[bytes, bytes]] = []
        i = 0
        while i < batch.num_rows:
            if not leaves[i]:
                group, center = (hubs[i], salts[i]), hashes[edges[i] : edges[i + 1]]
                i += 1
                continue
            stop = i
            while stop < batch.num_rows and leaves[stop] and (hubs[stop], salts[stop]) == group:
                stop += 1
            if stop == i:
                raise RuntimeError("a star without its center")
            own = hashes[edges[i] : edges[stop]]
            at = np.minimum(np.searchsorted(center, own), len(center) - 1)
            both = np.bincount(np.repeat(np.arange(stop - i), sizes[i:stop]), weights=center[at] == own, minlength=stop - i).astype(np.int64)
            union = len(center) + sizes[i:stop] - both
            found += [(hubs[i + k], digests[i + k]) for k in np.flatnonzero(100 * both >= percent * union)]
            i = stop
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["a", "b"])


def compare_blocks(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    """One pair of blocks of a bucket: links between its components, confirmed on full sets. Pairs inside a
    component, also one that has just grown together here, are passed over; so at most one link a member comes out."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    side = table["side"].to_numpy()
    digest = table["digest"].to_pylist()
    names: dict[bytes, int] = {}
    comp = np.array([names.setdefault(c, len(names)) for c in table["comp"].to_pylist()])
    sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(comp), -1)
    hashes, n = shingle_sets(table["text"].combine_chunks(), shingle)
    at = np.cumsum(n) - n
    right = np.flatnonzero(side != 1)
    one_block = bool((side == 0).all())
    out: list[tuple[bytes, bytes]] = []
    for i in np.flatnonzero(side != 2):
        js = right[right > i] if one_block else right
        js = js[(comp[js] != comp[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
        if len(js):
            js = js[np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= MOST_BITS]
        if not len(js):
            continue
        own, others = hashes[at[i] : at[i] + n[i]], hashes[ranges(at[js], n[js])]
        found = own[np.minimum(np.searchsorted(own, others), n[i] - 1)] == others
        both = np.bincount(np.repeat(np.arange(len(js)), n[js]), weights=found, minlength=len(js))
        for j in js[100 * both >= percent * (n[i] + n[js] - both)]:
            if comp[j] != comp[i]:
                out.append((digest[i], digest[j]))
                comp[comp == comp[j]] = comp[i]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(2)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(v, c), saved: for every vertex of the edges (a, b) the smallest vertex it reaches. Each round takes the least label
    of all neighbours, then the label of that label; labels are written to the shared folder after each. A vertex with many
    neighbours and a label with many bearers are dealt to several tasks."""
    both = save(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "near-edges")
    hubs = hot_keys(both, "u")
    labels = save(both.groupBy("v").agg(F.min("u").alias("c")).select("v", F.least("v", "c").alias("c")), "near-labels")
    while True:
        heard = spread_join(both, labels.select(F.col("v").alias("u"), "c"), "u", hubs).groupBy("v").agg(F.min("c").alias("h"))
        nearer = save(labels.join(heard, "v").select("v", F.col("c").alias("old"), F.least("c", "h").alias("c")), "near-labels")
        up = nearer.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        after = save(spread_join(nearer, up, "c", hot_keys(nearer, "c")).select("v", "old", F.least("c", "cc").alias("c")), "near-labels", changed=F.count_if(F.col("c") != F.col("old")))
        changed = after._tidewater_counts["changed"]
        discard(labels, nearer)
        labels = after
        if not changed:
            discard(both)
            return labels


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b), saved, whose full sets are similar enough. A pair is a ray of the star around a; large stars are
    salted, and each text travels once per star."""
    per_hub = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    sized = spread_join(pairs, per_hub, "a", hot_keys(pairs, "a"))
    rays = save(sized.select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("salt"), F.lit(True).alias("leaf"), F.col("b").alias("digest")), "near-rays")
    centers = rays.select("hub", "salt", F.lit(False).alias("leaf"), F.col("hub").alias("digest")).distinct()
    wanted = rays.union(centers).join(classes.select("digest", "id", "tkey"), "digest")
    texts = wanted.join(docs, ["id", "tkey"]).select("hub", "salt", "leaf", "digest", "text").dropDuplicates(["hub", "salt", "leaf", "digest"])
    dealt = texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "leaf")
    links = save(dealt.mapInArrow(lambda it: verify_stars(it, shingle, percent), "a binary, b binary"), "near-links")
    discard(rays)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, with_rows: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept`` and, where asked for, ``text_key, chosen``.

    Documents are linked where the intersection of their sets of word shingles (A-Z lower-cased) is at least ``percent`` of the
    union; a component's identifier is the smallest one in it, and that document is kept.

    Equal sets form one class from the start, however many documents share it. Of the classes' MinHash samples, bands of
    four give buckets and all together an odd sketch: a bitmap of parities whose differing bits count the
    samples that differ. In each bucket all are first held against its hub; what the sketches allow is
    confirmed on full sets. Then buckets that still hold several components compare these with each
    other, in blocks bounded by members and by shingles, again by sketch and then by full sets, so that no link between different texts depends on
    the choice of the hub; inside the hub's component nothing is compared or sent, and each block gives a spanning set of links, not all
    pairs. Hot keys (a band, a hub, a component or a set that a good part of all rows shares) meet in partial aggregates; joins on
    them deal their rows to several tasks.

    Percentages below 80 are refused: bands and sketches are made for 80 and more (at 80 a pair is missed with a probability below 4e-5).
    Nulls: a null or wordless text has an empty set and is linked with nothing; a null identifier comes after all others.
    Fewer words than a shingle form one shingle. Rows with the same identifier and different texts are linked only by similarity.
    An empty table gives no rows. Other columns are ignored.
    ``kept`` goes by the identifier: all of a component's rows that share its smallest one have it. ``chosen`` goes by the row:
    it names one ``text_key`` (the text's 64-bit hash) of those, so that only equal texts under one identifier are chosen together.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is from 80 to 100")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(identifier(F.col(id_col)).alias("id"), F.xxhash64(text_col).alias("tkey"), F.col(text_col).alias("text"))
    described = rows.mapInArrow(lambda it: describe(it, shingle), "id struct<none:boolean,value:bigint>, tkey long, n long, digest binary, bands array<long>, sketch array<long>")
    table = save(described, "near-sets")
    classes = save(
        table.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "tkey")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).select("digest", "rep.id", "rep.tkey", "n", "bands", "sketch"),
        "near-classes",
    )
    banded = classes.select("digest", "n", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    hot_bands = hot_keys(banded, "band", BANDS * classes._tidewater_counts["rows"])
    sized = save(spread_join(banded, buckets, "band", hot_bands), "near-members")
    # a bucket's hub is the member that most others share bands with: in a group of near copies, the text they go back to
    weights = sized.groupBy("digest").agg(F.sum("size").alias("weight"))
    hubs = sized.join(weights, "digest").groupBy("band").agg(F.max(F.struct("weight", "digest")).alias("top")).select("band", F.col("top.digest").alias("hub"))
    members = save(spread_join(sized, hubs, "band", hot_bands).select("band", "digest", "n", "hub"), "near-members")
    discard(sized)
    about = classes.select("digest", "n", "sketch")
    met = members.where("digest != hub").select(F.col("hub").alias("a"), F.col("digest").alias("b")).distinct()
    sketched = spread_join(met, about.toDF("a", "a_n", "a_s"), "a", hot_keys(members, "hub")).join(about.toDF("b", "b_n", "b_s"), "b")
    first = save(sketched.where(may_be_similar(F.col("a_n"), F.col("b_n"), F.col("a_s"), F.col("b_s"), percent)).select("a", "b"), "near-pairs")
    links = confirm(first, classes, rows, shingle, percent)
    label = components(links)
    discard(first, links)

    # what is left: pairs of different components in one bucket
    labelled = save(members.join(label.select(F.col("v").alias("digest"), "c"), "digest", "left").select("band", "digest", "n", "hub", F.coalesce("c", "digest").alias("comp")), "near-members")
    discard(members)
    hub_comp = F.max(F.when(F.col("digest") == F.col("hub"), F.col("comp")))
    mixed = labelled.groupBy("band").agg(hub_comp.alias("main"), (F.min("comp") != F.max("comp")).alias("mixed")).where("mixed").drop("mixed")
    # the hub has met all the others; of the rest, those in its component need no comparison among themselves
    left = spread_join(labelled.where("digest != hub"), mixed, "band", hot_bands).select("band", "digest", "n", "comp", (F.col("comp") != F.col("main")).alias("apart"))
    left = save(left, "near-left")
    apart = F.col("apart").cast("long")
    counts = left.groupBy("band").agg(
        (F.sum(apart) / BLOCK).alias("rows_apart"), (F.sum(apart * F.col("n")) / BLOCK_SHINGLES).alias("n_apart"),
        (F.sum(1 - apart) / BLOCK).alias("rows_main"), (F.sum((1 - apart) * F.col("n")) / BLOCK_SHINGLES).alias("n_main"), F.count(F.lit(1)).alias("n_all"),
    ).where("n_all > 1 and rows_apart > 0")
    whole = (F.col("rows_apart") + F.col("rows_main") <= 1) & (F.col("n_apart") + F.col("n_main") <= 1)  # then all of the bucket is one group
    counts = counts.select(
        "band", whole.alias("whole"),
        F.when(whole, 1).otherwise(F.ceil(F.greatest("rows_apart", "n_apart"))).cast("int").alias("outer"),
        F.when(whole, 0).otherwise(F.ceil(F.greatest("rows_main", "n_main"))).cast("int").alias("inner"),
    )
    counted = save(spread_join(left, counts, "band", hot_bands).withColumn("apart", F.col("apart") | F.col("whole")).drop("whole"), "near-left")
    texts = counted.select("digest").distinct().join(classes.select("digest", "id", "tkey", "sketch"), "digest").join(rows, ["id", "tkey"]).select("digest", "sketch", "text").dropDuplicates(["digest"])
    with_block = counted.withColumn("own", F.pmod(F.xxhash64("digest"), F.when(F.col("apart"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    # rows apart: pairs of their blocks (others below outer), and each of their blocks with each of the component's (from outer on)
    others = F.when(F.col("apart"), F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") - 1))
    place = F.when(F.col("apart"), F.col("own")).otherwise(F.col("outer") + F.col("own"))
    dealt = with_block.withColumn("place", place).withColumn("other", F.explode(others)).select(
        "band", F.least("place", "other").alias("low"), F.greatest("place", "other").alias("high"),
        F.when(F.col("place") == F.col("other"), 0).when(F.col("place") < F.col("other"), 1).otherwise(2).alias("side"), "digest", "comp",
    )
    second = dealt.join(texts, "digest").groupBy("band", "low", "high").applyInArrow(_block_comparer(shingle, percent), "a binary, b binary")
    more = save(second.distinct(), "near-links")
    discard(labelled, left, counted)
    named = label.select("v", "c")
    ends = spread_join(more, named.toDF("a", "ca"), "a", hot_keys(more, "a"), "left")
    over = save(ends.join(named.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b"), "near-links")
    if over._tidewater_counts["rows"]:
        joined = components(over)
        alone = over.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(named, "v", "left_anti").withColumn("c", F.col("v"))
        further = joined.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        named = spread_join(named.unionByName(alone), further, "c", hot_keys(label, "c"), "left").select("v", F.coalesce("cc", "c").alias("c"))
    final = named.select(F.col("v").alias("digest"), F.col("c").alias("comp"))

    # the smallest identifier of each component, and the smallest text key under it
    owned = save(classes.join(final, "digest", "left").select("digest", "id", "tkey", F.coalesce("comp", "digest").alias("comp")), "near-owned")
    least = owned.groupBy("comp").agg(F.min(F.struct("id", "tkey")).alias("rep"))
    representative = spread_join(owned, least, "comp", hot_keys(owned, "comp")).select("digest", F.col("rep.id").alias("component_id"), F.col("rep.tkey").alias("component_key"))
    worded = table.select("id", "tkey", "n", "digest").where("n > 0")
    rest = spread_join(worded, representative, "digest", hot_keys(worded, "digest", table._tidewater_counts["rows"])).select("id", "tkey", "n", "component_id", "component_key")
    out = rest.union(table.where("n = 0").select("id", "tkey", "n", F.col("id").alias("component_id"), F.col("tkey").alias("component_key")))

    def restored(c: str) -> Column:
        return F.when(~F.col(c)["none"], F.col(c)["value"]).cast(kind)

    kept = F.col("id") == F.col("component_id")
    columns = [restored("id").alias("doc_id"), F.col("n").alias("n_shingles"), restored("component_id").alias("component_id"), kept.alias("kept")]
    if with_rows:
        columns += [F.col("tkey").alias("text_key"), (kept & (F.col("tkey") == F.col("component_key"))).alias("chosen")]
    result = save(out.select(*columns), "near-result")
    discard(table, classes, label, more, over, owned, *([joined] if over._tidewater_counts["rows"] else []))
    return result


def _block_comparer(shingle: int, percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return compare_blocks(batches, shingle, percent)

    return compare


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT e.b, reached.r FROM reached JOIN both_ways e ON e.a = reached.v WHERE reached.r < e.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT v, min(r) AS c FROM reached GROUP BY v) m ON m.v = d.doc_id
"""
