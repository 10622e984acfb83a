"""The Merkle manifest and its proofs against a plain tree."""

import hashlib
import zlib

from pyspark.sql import functions as F

from foliant.llm import merkle
from foliant.llm.queries import QUERIES

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    text = row["text"]
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, p):
    out = []
    for level in tree[:-1]:
        first = p // 8 * 8
        out.append((level[first:p], level[p + 1 : first + 8]))
        p //= 8
    return out


def brute(rows):
    langs, out = {}, []
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = {x: levels([leaf(r) for r in langs[x]]) for x in order}
    tops = levels([trees[x][-1][0] for x in order])
    for k, x in enumerate(order):
        for p, r in enumerate(langs[x]):
            way = path(trees[x], p) + path(tops, k)
            found = leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0)
            for left, right in way:
                found = digest(*left, found, *right)
            root = tops[-1][0]
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], root, digest(*[d for pair in way for side in pair for d in side]), found, found == root, sum(len(a) + len(b) for a, b in way)))
    return sorted(out, key=repr)


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_manifest_query(spark, sf_dir):
    found = collected(QUERIES["op13_merkle_manifest"](spark, sf_dir))
    assert found == brute(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert 0 < sum(not r[6] for r in found) < len(found)


def test_manifest_odd_rows(spark):
    """Nulls in any column, repeated rows, ties, an empty language, ten languages (so a run of eight and one of two), a column too many."""
    rows = [(1, "s", "en", 3, "AbC"), (1, "s", "en", 3, "AbC"), (1, None, "en", None, None), (None, "s", "en", 1, "X"), (None, "s", "en", 1, "X"), (7, "s", None, 2, "ÄB"), (8, "s", "", 0, ""), (9, None, None, None, None)]
    rows += [(10 + i, "s", "fr", i, "Word " * (i + 1)) for i in range(65)] + [(100 + i, "q", f"l{i}", i, "T") for i in range(6)]
    docs = spark.createDataFrame([(*r, "more") for r in rows], f"{COLUMNS}, tree string").repartition(3)
    assert collected(merkle.verified(docs)) == brute(docs.collect())
    assert merkle.verified(docs.limit(0)).count() == 0
    alone = docs.where("doc_id = 7")
    (row,) = merkle.verified(alone).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["n_siblings"] == 0 and row["proof_sha256"] == digest()


def test_proofs_of_some_rows(spark):
    """Rows far apart, in partitions of their own, are proved by what they lack only; a changed row fails, and it alone."""
    rows = [(i, "s", "en" if i % 3 else "de", i, f"Text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, COLUMNS)
    wanted = spark.createDataFrame([(i,) for i in (0, 1, 5, 77, 300, 599, 1000)], "doc_id int")
    claim = merkle.leaf_digest([F.when(F.col("doc_id") == 77, F.lit("forged")).otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS])
    held = merkle.manifest(docs, claim)
    found = merkle.proofs(held, wanted, part=50)
    plain = {r[0]: r for r in brute(docs.collect())}
    got = {r["doc_id"]: r for r in found.collect()}
    assert sorted(got) == [0, 1, 5, 77, 300, 599]
    assert all(r["proof_sha256"] == plain[i][4] and r["leaf"] == plain[i][1] and r["n_siblings"] == plain[i][7] for i, r in got.items())
    assert {i for i, r in got.items() if r["folded_root"] != r["root"]} == {77}


def test_missing_is_least():
    """Without any one of the coordinates the top does not follow; with all of them it does."""
    leaves = [digest(str(i)) for i in range(100)]
    tree = levels(leaves)
    own = {3, 4, 70}
    lacking = merkle.missing(own, 100)
    fetched = {(level, p): tree[level][p] for level, places in lacking.items() for p in places}
    assert merkle.Climb({p: leaves[p] for p in own}, 100, fetched).top == tree[-1][0]
    for level, places in lacking.items():
        for p in places:
            below = set(range(p * 8**level, (p + 1) * 8**level))
            assert not below & own
