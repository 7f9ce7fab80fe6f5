"""Byte-pair encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import chunks, gather, ranges
from .common import ship

NONE = np.iinfo(np.int64).max
#: Words whose encodings are remembered in a worker before it starts afresh.
REMEMBERED = 200_000


# Letters and numbers that Unicode 16, the version by which the tokenizers library splits, added to 15.1, Python's; capitals of
# versions 16 and 17, by which it makes small letters; and the one pair that Python composes and the library doesn't.
ADDED = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x11DE0, 0x11DE9), (0x1246F, 0x1246F),
    (0x12475, 0x1247F), (0x12550, 0x12686), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x16FF4, 0x16FF6), (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}}
SMALL |= {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
APART = "\U00011935\U00011930"
#: Neither letter, number nor white space in any version.
PRIVATE = "\ue000"


def later_letters() -> re.Pattern:
    """Letters and numbers of the regex module that the library doesn't know as such: those that Python doesn't know and Unicode 16 hasn't added."""
    known = {c for low, high in ADDED for c in range(low, high + 1)}
    unassigned = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c not in known and unicodedata.category(chr(c)) == "Cn")
    later = sorted({*"".join(regex.findall(r"[\p{L}\p{N}]+", unassigned)), *map(chr, SMALL)})
    heads = [c for k, c in enumerate(later) if not k or ord(later[k - 1]) + 1 < ord(c)]
    tails = [c for k, c in enumerate(later) if k + 1 == len(later) or ord(c) + 1 < ord(later[k + 1])]
    return re.compile("[" + "".join(f"{a}-{b}" for a, b in zip(heads, tails, strict=True)) + "]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where it is printable,
    else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends in the tokenizers library's format, as sorted arrays."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.later = later_letters()
        names = dict(self.ids) | self.added
        self.size = max(names.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([self.ids[a] * self.size + self.ids[b] for a, b in pairs], np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], np.int64)
        self.final = np.array([self.ids[c + self.end] for c in letters], np.int64)
        texts = [b""] * self.size
        for name, i in names.items():
            texts[i] = name.encode()
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.text = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
        self.text_at, self.text_size = np.cumsum(lengths) - lengths, lengths
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, end to end, and how many each has.

        All words lie in one array. A round looks all neighbouring pairs up by binary search, takes each
        word's pair of lowest rank and merges it wherever it stands in that word; words without a pair are done.
        """
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.final[data[ends - 1]]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = np.arange(len(words))  # the words still under way
        while len(names):
            starts = np.cumsum(sizes) - sizes
            key = symbols[:-1] * self.size + symbols[1:]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[found] == key, self.ranks[found], NONE), NONE)
            rank[starts + sizes - 1] = NONE  # a pair doesn't reach into the next word
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((names[over], sizes[over], symbols[gone]))
                names, sizes, symbols, rank, least = names[~over], sizes[~over], symbols[~gone], rank[~gone], least[~over]
                found = np.append(found, 0)[~gone]
                starts = np.cumsum(sizes) - sizes
                if not len(names):
                    break
            else:
                found = np.append(found, 0)
            hit = rank == np.repeat(least, sizes)
            # of overlapping pairs, as in a run of one letter, every other one counts, from the left
            place = np.flatnonzero(hit)
            new_run = np.append(True, place[1:] != place[:-1] + 1)
            run_at = np.flatnonzero(new_run)
            within = np.arange(len(place)) - np.repeat(run_at, np.diff(np.append(run_at, len(place))))
            left = place[within % 2 == 0]
            symbols[left] = self.made[found[left]]
            keep = np.ones(len(symbols), bool)
            keep[left + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), starts)
            symbols = symbols[keep]
        count = np.zeros(len(words), np.int64)
        for n, s, _ in done:
            count[n] = s
        at = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for n, s, x in done:
            out[ranges(at[n], s)] = x
        return out, count

    def words_of(self, text: str, later: bool = False) -> list[str]:
        """The words of a text; ``later``: for texts with letters that the library takes for symbols."""
        if text.isascii():
            return self.pattern.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = APART.join(unicodedata.normalize("NFC", part) for part in text.split(APART))
        text = text.replace("Σ", "σ").lower()  # letters are lower-cased one by one: no final sigma
        if not later:
            return self.pattern.findall(text)
        text = text.translate(SMALL)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.later.sub(PRIVATE, text))]

    def pieces(self, text: str, later: bool = False) -> list[str | int]:
        if self.split_added is None or "<" not in text:
            return self.words_of(text, later)
        out: list[str | int] = []
        for part in self.split_added.split(text):
            out += [self.added[part]] if part in self.added else self.words_of(part, later)
        return out

    def has_later(self, word: str | int) -> bool:
        return isinstance(word, str) and not word.isascii() and self.later.search(word) is not None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of all texts, end to end, and how many each text has."""
        pieces = [self.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        fresh = list({w for p in pieces for w in p if w not in known})
        # letters that the library doesn't know are looked for in new words only; words with them are never remembered
        odd = {w for w in fresh if self.has_later(w)}
        if odd:
            pieces = [self.pieces(t, True) if not odd.isdisjoint(p) else p for t, p in zip(texts, pieces, strict=True)]
            fresh = list({w for p in pieces for w in p if w not in known})
        if fresh:
            own = [w for w in fresh if isinstance(w, str)]
            ids, counts = self.merge(own) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            whole = [w for w in fresh if not isinstance(w, str)]
            ids, counts = np.append(ids, np.array(whole, np.int64)), np.append(counts, np.ones(len(whole), np.int64))
            base = len(self.at)
            for k, w in enumerate(own + whole):
                known[w] = base + k
            self.at = np.append(self.at, len(self.flat) + np.cumsum(counts) - counts)
            self.count = np.append(self.count, counts)
            self.flat = np.append(self.flat, ids)
        n = np.array([len(p) for p in pieces], np.int64)
        codes = np.fromiter((known[w] for p in pieces for w in p), np.int64, int(n.sum()))
        for w in [w for w in fresh if self.has_later(w)] if odd else []:
            del known[w]
        sizes = self.count[codes]
        ids = self.flat[ranges(self.at[codes], sizes)]
        total = np.concatenate(([0], np.cumsum(sizes)))
        edges = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(total[edges])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The tokens' texts, joined by a space: the file names no decoder."""
        sizes = self.text_size[ids]
        raw = gather(self.text, self.text_at[ids], sizes).tobytes()
        total = np.concatenate(([0], np.cumsum(sizes)))
        edges = total[np.concatenate(([0], np.cumsum(counts)))]
        return [raw[a : b - 1] if b > a else b"" for a, b in zip(edges[:-1], edges[1:], strict=True)]


_loaded: dict[bytes, Vocabulary] = {}


def vocabulary(raw: bytes) -> Vocabulary:
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


def run(batches: Iterator[pa.RecordBatch], shared, digests: bool) -> Iterator[pa.RecordBatch]:
    own = vocabulary(shared.value)
    for batch in chunks(batches, "text", 1 << 20):
        ids, counts = own.encode([t or "" for t in batch.column(1).to_pylist()])
        texts = own.decode(ids, counts)
        edges = np.concatenate(([0], np.cumsum(counts)))
        if digests:
            small = ids.astype("<u4")
            sums = [hashlib.sha256(small[a:b].tobytes()).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            rest, names = [pa.array(sums), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["ids_sha256", "decoded_sha256"]
        else:
            rest, names = [pa.ListArray.from_arrays(edges.astype(np.int32), ids.astype(np.int32)), pa.array(texts, pa.binary()).cast(pa.string())], ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *rest], names=["doc_id", "n_tokens", *names])


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def encode_and_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids, decoded``, or with ``digests`` the SHA-256 of the
    identifiers (little-endian, 32 bits) and of the decoded text (UTF-8) in place of the last two.

    Identifiers are those of the tokenizers library for the vocabulary file at ``path``, without special tokens added; special
    tokens' strings in a text are their tokens. The file is read by the driver and broadcast: it has a
    fixed size. Words met before are looked up; new words of a batch are merged together. Nothing is shuffled.

    Nulls: a null text is empty and has no tokens; a null identifier is passed through. Repeated rows give repeated results, an empty table
    none. Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Path(path or default_path()).read_bytes())
    kind = docs.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: run(it, shared, digests), f"doc_id {kind}, n_tokens long, {rest}")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
