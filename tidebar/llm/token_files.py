"""Token ids as binary shard files with a minimal perfect hash index from document keys to shard offsets.

Files of a dataset, all integers little-endian:

- ``shard-NNNNN.ids``: the ids of the shard's documents one after another, ``width`` bytes each, nothing else.
- ``shard-NNNNN.ends``: per document the number of ids up to its end in the shard, 8 bytes each.
- ``index-NNNNN.mph``: the keys whose hash falls to this file, see :class:`Index`.
- ``meta.json``: width, number of index files, documents and ids of each shard.

Shards are contiguous ranges of ascending keys. A key is looked up by its hash
alone: index file, slot, fingerprint, shard offset. Files are written under
another name and renamed when whole, so a repeated task leaves the same files.
The folder must be one that every executor reaches and ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import col, partitions, small, whole
from tidebar.session import stage

LEVELS = 24
_U64 = np.uint64


# ---- the minimal perfect hash


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Other 64 bits for each level (the finisher of SplitMix64 over hash + level)."""
    with np.errstate(over="ignore"):
        x = h + _U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
        return x ^ (x >> _U64(31))


class Index:
    """A minimal perfect hash over 64-bit hashes by cascading bit arrays, with a record per key.

    Each level has two bits per key still left; a key that is alone at its place
    sets the bit, the others go on to the next level. The slot of a key is the
    number of bits set before its own. Keys left after the last level (those with
    equal hashes) are kept with hash and fingerprint behind the others. Records:
    fingerprint, shard, row in the shard, offset in ids, documents with the key.
    """

    FIELDS = ("fingerprint", "shard", "row", "offset", "copies")

    def __init__(self, sizes: np.ndarray, words: np.ndarray, records: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.records, self.rest = sizes, words, records, rest
        self.starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(words))].astype(np.int64)
        self.others = {(int(h), int(records[self.ranks[-1] + i, 0])): int(self.ranks[-1]) + i for i, h in enumerate(rest)}

    @classmethod
    def build(cls, hashes: np.ndarray, records: np.ndarray) -> Index:
        """``records``: unsigned 64-bit, one row of FIELDS per key. Two keys that share hash and fingerprint are an error."""
        left, sizes, arrays, ordered = np.arange(len(hashes)), [], [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 64) * 64
            place = (_mixed(hashes[left], level) % _U64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, np.uint8)
            bits[place[alone]] = 1
            sizes.append(size)
            arrays.append(np.packbits(bits, bitorder="little").view("<u8"))
            ordered.append(left[alone][np.argsort(place[alone])])
            left = left[~alone]
        if len({*zip(hashes[left].tolist(), records[left, 0].tolist())}) < len(left):
            raise ValueError("two keys share a hash and a fingerprint")
        order = np.concatenate([*ordered, left]) if len(hashes) else left
        words = np.concatenate(arrays) if arrays else np.zeros(0, "<u8")
        return cls(np.array(sizes, "<u4"), words, records[order], hashes[left])

    def find(self, hashes: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        """The record number of each key, -1 where the index has none with that fingerprint."""
        slot = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + (_mixed(hashes[left], level) % _U64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(_U64)
            hit = (word >> bit) & _U64(1) == 1
            below = np.bitwise_count(word & ((_U64(1) << bit) - _U64(1)))
            slot[left[hit]] = (self.ranks[at >> 6] + below)[hit]
            left = left[~hit]
        for i in left.tolist():
            slot[i] = self.others.get((int(hashes[i]), int(fingerprints[i])), -1)
        known = slot >= 0
        known[known] = self.records[slot[known], 0] == fingerprints[known]
        return np.where(known, slot, -1)

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.words), len(self.records), len(self.rest)], "<u4")
        return b"MPH1" + b"".join(x.tobytes() for x in (head, self.sizes, self.words, self.records, self.rest))

    @classmethod
    def load(cls, data: bytes) -> Index:
        levels, words, keys, rest = np.frombuffer(data, "<u4", 4, 4).tolist()
        sizes = np.frombuffer(data, "<u4", levels, 20)
        at = 20 + 4 * levels
        longs = np.frombuffer(data, "<u8", offset=at)
        n = len(cls.FIELDS) * keys
        return cls(sizes, longs[:words], longs[words : words + n].reshape(keys, len(cls.FIELDS)), longs[words + n : words + n + rest])


def _hashes(key: str) -> tuple[Column, Column]:
    """Hash and fingerprint of a key's text form; a null key is a key of its own."""
    form = F.coalesce(F.concat(F.lit("="), col(key).cast("string")), F.lit("-"))
    return F.xxhash64(form).alias("hash"), F.xxhash64(F.concat(F.lit("#"), form)).alias("fingerprint")


def _hashes_of(key) -> tuple[np.ndarray, np.ndarray]:
    """The same of one value, for integer and string keys."""
    form = "-" if key is None else f"={key}"
    return tuple(np.array([xxhash.xxh64_intdigest(p + form, 42)], np.uint64) for p in ("", "#"))


# ---- files


def _open(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder)


class _Whole:
    """A file that gets its name when it is closed without an error."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _open(folder)
        self.path, self.part = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.part)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def _put(folder: str, name: str, data: bytes) -> None:
    file = _Whole(folder, name)
    file.stream.write(data)
    file.close()


def _get(folder: str, name: str) -> bytes:
    fs, root = _open(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        return f.read()


# ---- writing

# Letters that are their own NFC form and whose lower case is one of these, and the pieces of lower-case texts of these and ASCII.
LATIN = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
LATIN_PIECES = re.compile(rf"[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{LATIN}]+", re.ASCII)
BEYOND_LATIN = re.compile(rf"[^\x00-\x7f{LATIN}]|<\|")

_loaded: dict = {}


class Coder:
    """Packed ids of whole texts by the tokenizers library, for vocabularies that lower-case and cut as ``LATIN_PIECES`` does.

    Such a vocabulary codes each piece for itself, so in texts of ASCII and Latin
    letters every distinct piece is given to the library once, as long as the
    ``limit`` of remembered pieces allows, many of them in one text: the last id of
    each is one that ends a word. Other texts, those with strings that begin like
    special tokens, and all texts of other vocabularies are given whole.
    """

    def __init__(self, spec: str, width: int, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.library, self.kind, self.limit = Tokenizer.from_str(spec), f"<u{width}", limit
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        given = json.loads(spec)
        self.by_piece = _cuts_pieces(given)
        self.last = np.zeros(max(given["model"]["vocab"].values()) + 1, bool)
        self.last[[i for token, i in given["model"]["vocab"].items() if token.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str], together: int = 4096):
        """The packed ids of pieces, in order."""
        for at in range(0, len(pieces), together):
            part = pieces[at : at + together]
            packed = self.whole([" ".join(part)])[0]
            ids = np.frombuffer(packed, self.kind)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) == len(part):
                yield from map(packed.__getitem__, map(slice, [0, *ends], ends))
            else:
                yield from self.whole(part)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_piece and (t.isascii() and "<|" not in t or not BEYOND_LATIN.search(t)) for t in texts]
        others = iter(self.whole([t for t, p in zip(texts, plain) if not p]))
        found = [LATIN_PIECES.findall(t.lower()) if p else None for t, p in zip(texts, plain)]
        asked = set().union(*(f for f in found if f))
        new = asked.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known, new = {}, asked
        ordered = list(new)
        self.known.update(zip(ordered, self.pieces(ordered)))
        get = self.known.__getitem__
        return [next(others) if f is None else b"".join(map(get, f)) for f in found]


def _cuts_pieces(spec: dict) -> bool:
    """Whether a tokenizer's normalizer and cuts are those that ``LATIN_PIECES`` stands for."""
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    special = [t["content"] for t in spec.get("added_tokens", [])]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == steps
        and (cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ({"Regex": pattern}, "Removed", True)
        and [{**c, "trim_offsets": True} for c in cuts[1:]] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        and all(t.startswith("<|") for t in special)
        and not spec.get("post_processor")
    )


def _coder(broadcast, width: int) -> Coder:
    """One per Python worker."""
    spec = broadcast.value
    if hash((spec, width)) not in _loaded:
        _loaded.clear()
        _loaded[hash((spec, width))] = Coder(spec, width)
    return _loaded[hash((spec, width))]


def write(
    df: DataFrame, key: str, text: str, tokenizer: str, folder: str, end_id: int = 1,
    shard_bytes: int = 64 << 20, index_keys: int = 1 << 16,
) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending order of ``key``.

    Texts are dealt in ranges of the key, about ``shard_bytes`` of text each, and a
    task codes its range and streams it to one shard; ids are never shuffled. The
    index is dealt by key hash into files of about ``index_keys`` keys, each built
    by one task. Ids take two bytes where the vocabulary fits, else four.

    Null and empty texts have the end id only. Null keys stand first and are one
    key; rows of equal keys stand in input order, may lie in several shards, and
    the index has their key once, with the place of the first and their number.
    An empty table gives a dataset without shards. Extra columns are left out.
    Strings of special tokens in a text become their ids, as the library does.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    width = 2 if max(Tokenizer.from_str(spec).get_vocab_size(True), end_id + 1) <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()
    sent = df.sparkSession.sparkContext.broadcast(spec)  # as large as the vocabulary
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def save(batches):
        shard, row, offset, files = TaskContext.get().partitionId(), 0, 0, []
        for batch in small(batches, 256):
            if not files:
                files = [_Whole(folder, f"shard-{shard:05d}.{kind}") for kind in ("ids", "ends")]
            coded = _coder(sent, width).encode(batch.column("text").to_pylist())
            n = np.array([len(x) // width + 1 for x in coded], np.int64)
            ends = offset + np.cumsum(n)
            files[0].stream.write(b"".join(x + end for x in coded))
            files[1].stream.write(ends.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.full(len(n), shard, np.int64)), pa.array(row + np.arange(len(n))), pa.array(ends - n), pa.array(n)],
                names=["key", "shard", "row", "offset", "n"],
            )
            row, offset = row + len(n), int(ends[-1])
        for file in files:
            file.close()

    total = df.agg(F.sum(F.octet_length(col(text)).cast("long"))).first()[0] or 0
    given = df.select(col(key).alias("key"), whole(text).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    dealt = given.repartitionByRange(max(-(-total // shard_bytes), partitions(df)), *order).sortWithinPartitions(*order).select("key", "text")
    kind = given.schema["key"].dataType.simpleString()
    entries = stage(dealt.mapInArrow(save, f"key {kind}, shard long, row long, offset long, n long"), "token-entries")
    # one row per shard
    sizes = entries.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).orderBy("shard").collect()

    place = F.shiftleft("shard", 40) + F.col("row")
    keyed = entries.select(*_hashes("key"), "key", place.alias("place"), "offset")
    # rows of a key stand together, so its first one has the smallest place and, in its shard, offset
    first = keyed.groupBy("key", "hash", "fingerprint").agg(
        F.min("place").alias("place"), F.min_by("offset", "place").alias("offset"), F.count("*").alias("copies")
    )
    n_keys = entries.agg(F.approx_count_distinct("key")).first()[0]
    buckets = max(1, -(-n_keys // index_keys))

    def build(rows: pa.Table) -> pa.Table:
        unsigned = lambda c: rows.column(c).to_numpy().view(np.uint64)
        at = unsigned("place")
        records = np.column_stack([unsigned("fingerprint"), at >> _U64(40), at & _U64((1 << 40) - 1), unsigned("offset"), unsigned("copies")])
        bucket = rows.column("bucket")[0].as_py()
        data = Index.build(unsigned("hash"), records.astype("<u8")).dump()
        _put(folder, f"index-{bucket:05d}.mph", data)
        return pa.table({"bucket": [bucket], "bytes": [len(data)]})

    bucketed = first.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    stage(bucketed.groupBy("bucket").applyInArrow(build, "bucket long, bytes long"), "token-index")
    meta = {"width": width, "buckets": buckets, "shards": [r["shard"] for r in sizes], "docs": [r["docs"] for r in sizes], "ids": [r["ids"] for r in sizes]}
    _put(folder, "meta.json", json.dumps(meta).encode())


# ---- reading


def _pieces(bounds: np.ndarray, most: int = 1 << 20):
    """Ranges of documents of about ``most`` ids together; a longer one is its own range."""
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1)
        yield a, b
        a = b


class Dataset:
    """A written folder: keyed access, and documents by their number in ascending key order."""

    def __init__(self, folder: str, meta: dict | None = None):
        self.folder = folder
        self.meta = meta or json.loads(_get(folder, "meta.json"))
        self.docs_before = np.r_[0, np.cumsum(self.meta["docs"])].astype(np.int64)
        self.ids_before = np.r_[0, np.cumsum(self.meta["ids"])].astype(np.int64)
        self.shard_place = {s: i for i, s in enumerate(self.meta["shards"])}
        self._index: tuple[int, Index | None] = -1, None
        self._shard: tuple[int, tuple] = -1, ()

    def index(self, bucket: int) -> Index | None:
        """One index file, a few MB at most; the last one is kept. None where no key falls to it."""
        if self._index[0] != bucket:
            fs, root = _open(self.folder)
            there = fs.get_file_info(f"{root}/index-{bucket:05d}.mph").type != pyarrow.fs.FileType.NotFound
            self._index = bucket, Index.load(_get(self.folder, f"index-{bucket:05d}.mph")) if there else None
        return self._index[1]

    def shard(self, place: int) -> tuple:
        if self._shard[0] != place:
            fs, root = _open(self.folder)
            for file in self._shard[1]:
                file.close()
            name = f"{root}/shard-{self.meta['shards'][place]:05d}"
            self._shard = place, tuple(fs.open_input_file(f"{name}.{kind}") for kind in ("ids", "ends"))
        return self._shard[1]

    def rows(self, number: int, count: int):
        """(ids before, ids as unsigned 32-bit) of ``count`` documents from ``number`` on, over shard borders."""
        width = self.meta["width"]
        while count:
            place = int(np.searchsorted(self.docs_before, number, "right")) - 1
            row = number - int(self.docs_before[place])
            here = min(count, self.meta["docs"][place] - row)
            ids, ends = self.shard(place)
            low = max(row - 1, 0)
            found = np.frombuffer(ends.read_at(8 * (row + here - low), 8 * low), "<u8").astype(np.int64)
            bounds = found if row else np.r_[0, found]
            for a, b in _pieces(bounds):
                data = np.frombuffer(ids.read_at(width * int(bounds[b] - bounds[a]), width * int(bounds[a])), f"<u{width}").astype("<u4")
                for i in range(a, b):
                    yield int(self.ids_before[place] + bounds[i]), data[bounds[i] - bounds[a] : bounds[i + 1] - bounds[a]]
            number, count = number + here, count - here

    def number(self, record: np.ndarray) -> int:
        return int(self.docs_before[self.shard_place[int(record[1])]]) + int(record[2])

    def get(self, key) -> list[np.ndarray]:
        """The ids of the documents with this key; an unknown key has none."""
        hashes, fingerprints = _hashes_of(key)
        bucket = int(hashes.view(np.int64)[0]) % self.meta["buckets"]
        index = self.index(bucket)
        slot = -1 if index is None else index.find(hashes, fingerprints)[0]
        if slot < 0:
            return []
        record = index.records[slot]
        return [ids.copy() for _, ids in self.rows(self.number(record), int(record[4]))]


def read(keys: DataFrame, key: str, folder: str, chunk: int = 1024) -> DataFrame:
    """(key, start, ids) of every document with one of the ``keys``, read from the files through the index.

    ``start`` counts the ids of all documents before it, ``ids`` are packed
    little-endian unsigned 32-bit integers. Keys are dealt by index file, then,
    in ``chunk`` documents at most, by their place in the shards, so that any
    number of documents of one key spreads over tasks and each task reads its
    shards front to back. Unknown keys have no row; a key asked for twice has its
    documents twice.
    """
    meta = Dataset(folder).meta
    given = keys.select(col(key).alias("key"), *_hashes(key))
    kind = given.schema["key"].dataType.simpleString()
    n = partitions(keys)

    def find(batches):
        data = Dataset(folder, meta)
        for batch in batches:
            unsigned = lambda c: batch.column(c).to_numpy().view(np.uint64)
            hashes, prints, buckets = unsigned("hash"), unsigned("fingerprint"), batch.column("bucket").to_numpy()
            for bucket in np.unique(buckets).tolist():
                index = data.index(bucket)
                if index is None:
                    continue
                own = np.flatnonzero(buckets == bucket)
                slots = index.find(hashes[own], prints[own])
                own, records = own[slots >= 0], index.records[slots[slots >= 0]]
                numbers = [data.number(r) for r in records]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(own)), pa.array(numbers, pa.int64()), pa.array(records[:, 4].astype(np.int64))],
                    names=["key", "number", "copies"],
                )

    bucketed = given.withColumn("bucket", F.pmod("hash", F.lit(meta["buckets"])))
    # hashed further within a file, so that few files still keep all tasks busy
    dealt = bucketed.repartition(n, "bucket", F.pmod("fingerprint", F.lit(n))).sortWithinPartitions("bucket")
    places = dealt.mapInArrow(find, f"key {kind}, number long, copies long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long"))).alias("skip")
    chunks = places.select("key", "number", "copies", starts)
    chunks = chunks.select("key", (F.col("number") + F.col("skip")).alias("number"), F.least(F.lit(chunk), F.col("copies") - F.col("skip")).alias("count"))
    chunks = stage(chunks, "token-asked")

    def fetch(batches):
        data = Dataset(folder, meta)
        for batch in small(batches, chunk):
            numbers, counts = batch.column("number").to_numpy(), batch.column("count").to_numpy()
            # rows that stand together are read together
            cut = np.flatnonzero(numbers[1:] != numbers[:-1] + counts[:-1]) + 1
            out, held = [], 0
            for run in np.split(np.arange(batch.num_rows), cut):
                wanted = np.repeat(run, counts[run])
                for i, (start, ids) in zip(wanted.tolist(), data.rows(int(numbers[run[0]]), len(wanted)) if len(run) else ()):
                    out.append((i, start, ids.tobytes()))
                    held += ids.nbytes
                    if held > 8 << 20:
                        yield made(batch, out)
                        out, held = [], 0
            yield made(batch, out)

    def made(batch, out):
        at, starts, ids = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column("key").take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "ids"]
        )

    ranged = chunks.repartitionByRange(n, "number").sortWithinPartitions("number")
    return ranged.mapInArrow(fetch, f"key {kind}, start long, ids binary")
