"""Filter audit, Merkle manifest and token files against plain Python and their SQL, on hostile small tables."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import compare
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebar.llm import audit, merkle, token_files
from tidebar.llm.common import importable
from tidebar.llm.queries import FILE_TOKENIZER, ORACLES, QUERIES
from tidebar.session import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, `a.b` int, cell int, leaf string"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def text(r):
    kinds = [lambda: None, lambda: "", lambda: " \n\t", lambda: "Same Text # of ALL", lambda: " ".join(r.choice(["a", "b", "Word", "ß漢", "$5"]) for _ in range(150))]
    kinds += [lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([5, 120, 3000])))] * 3
    kinds += [lambda: "<|endoftext|> It's 12 É́ " + "x" * r.randrange(400)]
    return r.choice(kinds)()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for i in range(300):
        lang = r.choice(["en", "en", "en", "de", "fr", "", None, "é"])
        t = text(r)
        out.append((i * 3 - 20, t, lang, r.choice(["s", None, ""]), r.choice([len(t or ""), None]), "p", 1, 2, "l"))
    out += [(1000, "lonely", "zz", "s", 6, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out + out[3:6] + [out[3]] + [(None, "Same Text # of ALL", "en", "s", 1, None, None, None, None)] * 2


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    importable(spark)
    at = str(tmp_path_factory.mktemp("data"))
    r = random.Random(6)
    labels = [(x[0], r.choice([0, 1, None]), r.choice([0, 1])) for x in rows[:200]] + [(None, 1, 1), (-20, 1, 0)]
    for to, n in ((at, len(rows)), (f"{at}/none", 0)):
        spark.createDataFrame(rows[:n], SCHEMA).repartition(3).write.parquet(f"{to}/all/documents.parquet")
        spark.createDataFrame(labels[:n], LABELS).coalesce(1).write.parquet(f"{to}/all/labels.parquet")
    return at


def sql(folder, name):
    con = compare.duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/all/{t}.parquet/*.parquet')")
    return con, ORACLES[name]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest"])
def test_equal_to_sql(spark, folder, name):
    assert compare.difference(QUERIES[name](spark, f"{folder}/all"), *sql(folder, name)) is None
    assert compare.difference(QUERIES[name](spark, "/root/testdata/sf0.001"), compare.connect("/root/testdata/sf0.001"), ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest", "op13_token_files"])
def test_empty_tables(spark, folder, name):
    assert QUERIES[name](spark, f"{folder}/none/all").count() == 0


def test_audit_of_any_filters(spark):
    """Three filters with null outcomes: each order applied row by row."""
    r = random.Random(1)
    data = [(r.choice(["x", None]), *(r.choice([True, False, None]) for _ in range(3)), r.random() < 0.5, r.choice([True, None])) for _ in range(200)]
    df = spark.createDataFrame(data, "p string, a boolean, b boolean, c boolean, good boolean, toxic boolean")
    got = {tuple(x) for x in audit.audit(df, F.col("p"), {"A": F.col("a"), "B": F.col("b"), "C": F.col("c")}, F.col("good"), F.col("toxic")).collect()}
    want, shapley = set(), collections.Counter()
    for part, order in itertools.product(["x", None], itertools.permutations("ABC")):
        left = [x for x in data if x[0] == part]
        own = left
        for k, f in enumerate(order):
            i = "ABC".index(f) + 1
            gone = [x for x in left if x[i]]
            left = [x for x in left if not x[i]]
            failing = sum(bool(x[i]) for x in own)
            alone = sum(bool(x[i]) and sum(map(bool, x[1:4])) == 1 for x in own)
            shapley[part, f] += len(gone)
            want.add((part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), alone, sum(bool(x[4]) for x in gone), sum(bool(x[5]) for x in gone)))
    assert got == {(*w, shapley[w[0], w[1][w[2] - 1]]) for w in want}


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(leaves, fanout):
    """Root and, per leaf, its (left, right) siblings."""
    nodes, of, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, p in enumerate(of):
            first = p - p % fanout
            paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])))
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        of = [p // fanout for p in of]
    return nodes[0], paths


@pytest.mark.parametrize("fanout, sizes", [(2, [1, 2, 3, 16, 17, 33, 300]), (3, [1, 9, 10, 82]), (16, [1, 16, 17, 257]), (2, [5]), (20, [21])])
def test_manifest_of_any_fanout(spark, fanout, sizes):
    data = [(f"p{p:02d}", i, f"v{i}") for p, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(random.Random(2).sample(data, len(data)), "p string, k long, v string")
    got = {(r["p"], r["k"]): r for r in merkle.manifest(df, "p", "k", ["k", "v"], fanout).collect()}
    leaves = {(p, k): sha(f"{len(str(k))}:{k}{len(v)}:{v}") for p, k, v in data}
    trees = [tree([leaves[f"p{p:02d}", i] for i in range(n)], fanout) for p, n in enumerate(sizes)]
    root, above = tree([t[0] for t in trees], fanout)
    for p, (subroot, paths) in enumerate(trees):
        for i, path in enumerate(paths):
            r = got.pop((f"p{p:02d}", i))
            assert (r["leaf"], r["subroot"], r["root"]) == (leaves[r["p"], i], subroot, root)
            assert [tuple(s) for s in r["path"]] == path + above[p]
    assert not got


def test_manifest_keeps_columns(spark, folder):
    given = spark.read.parquet(f"{folder}/all/documents.parquet")
    out = merkle.manifest(given, "lang", "doc_id", ["doc_id", "text"])
    assert out.columns == [c for c in given.columns if c != "leaf"] + ["leaf", "subroot", "root", "path"]
    assert out.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0 and out.count() == given.count()


def test_token_files(spark, folder, rows):
    t = Tokenizer.from_file(public_tokenizers.path(FILE_TOKENIZER))
    ids = [[*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows]
    got = QUERIES["op13_token_files"](spark, f"{folder}/all").collect()
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((r[0], len(x), c) for r, x, c in zip(rows, ids, crc))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))


def test_keyed_access(spark, folder, rows):
    """Many small shards and index files, string keys, one key with most rows, unknown keys."""
    docs = spark.read.parquet(f"{folder}/all/documents.parquet")
    many = docs.select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("k"), F.col("doc_id").cast("string"))).otherwise("hot").alias("a.b"), F.col("text").alias("key"))
    at, path = new_path(spark, "keyed"), public_tokenizers.path(FILE_TOKENIZER)
    token_files.write(many, "a.b", "key", path, at, end_id=70_000, shard_bytes=500, index_keys=20)
    t = Tokenizer.from_file(path)
    want = collections.defaultdict(collections.Counter)
    for r in many.collect():
        want[r["a.b"]][tuple([*t.encode(r["key"] or "", add_special_tokens=False).ids, 70_000])] += 1
    data = token_files.Dataset(at)
    assert data.meta["width"] == 4 and len(data.meta["shards"]) > 20 and data.meta["buckets"] > 3
    for key, texts in want.items():
        assert collections.Counter(map(lambda x: tuple(x.tolist()), data.get(key))) == texts
    assert not any(data.get(f"none{i}") for i in range(500))
    asked = spark.createDataFrame([("hot",), ("k4",), ("none",), ("k4",)], "`a.b` string")
    found = collections.defaultdict(collections.Counter)
    for r in token_files.read(asked, "a.b", at, chunk=7).collect():
        found[r["key"]][tuple(np.frombuffer(r["ids"], "<u4").tolist())] += 1
    twice = collections.Counter({k: 2 * n for k, n in want["k4"].items()})
    assert found == {"hot": want["hot"], "k4": twice}
    names = os.listdir(at.removeprefix("file://"))
    assert not [n for n in names if n.startswith(".") and not n.endswith(".crc")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_index_is_minimal_and_perfect(n):
    r = np.random.default_rng(n)
    hashes = r.integers(0, 1 << 63, n).astype(np.uint64)
    hashes[: n // 100] = hashes[0] if n else 0  # equal hashes are told apart by their fingerprints
    prints = r.integers(0, 1 << 63, n).astype(np.uint64)
    records = np.column_stack([prints, *(np.arange(n, dtype=np.uint64) + np.uint64(k) for k in range(4))])
    index = token_files.Index.load(token_files.Index.build(hashes, records).dump())
    slots = index.find(hashes, prints)
    assert sorted(slots.tolist()) == list(range(n)) and (index.records[slots] == records).all()
    assert (index.find(hashes, prints + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        token_files.Index.build(np.zeros(2, np.uint64), np.zeros((2, 5), np.uint64))


def test_pieces_equal_whole_texts():
    """Texts of all kinds of letters, coded piece by piece where that is safe, against the library."""
    spec = open(public_tokenizers.path(FILE_TOKENIZER)).read()
    library, r = Tokenizer.from_str(spec), random.Random(3)
    latin = [chr(c) for c in [*range(0xC0, 0x180), *range(0x61, 0x7B)] if c not in (0xD7, 0xF7, 0x130)] + list("'s't're've'm'll'd'S'LL") + list(" \t\n\x0b\x0c\r\x1c\x1f\x00\x7f")
    mixed = [*latin, *map(chr, range(0x80, 0x250)), "e\u0301", "\u0307", "漢", "¼", "ß", "\u2003", "“", "<|endoftext|>", "<|", "|>", "\u1e9e", "Σ", "ς", "\U0001f600", "ﬁ"]
    ascii_ = [chr(c) for c in range(128)]
    texts = ["".join(r.choice(kind) for _ in range(r.randrange(60))) for _ in range(2000) for kind in (latin, mixed, ascii_)]
    coder = token_files.Coder(spec, 2, limit=500)
    assert coder.by_piece and not token_files.Coder(open(public_tokenizers.path("byte_bpe_50k.json")).read(), 2).by_piece
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [np.array(e.ids, "<u2").tobytes() for e in library.encode_batch(part, add_special_tokens=False)]
        assert coder.encode(part) == want
    assert sum(not token_files.BEYOND_LATIN.search(t) for t in texts) > 3000
