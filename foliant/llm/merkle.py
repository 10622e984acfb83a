"""Merkle manifest of a document table, proved by octopus multiproofs.

Every row is a leaf. Leaves of one language, in the order of doc_id, form a tree whose nodes are
the digests of runs of eight; the tops of the languages form one more tree of the same kind. A tree is a
table of nodes (tree, level, pos, digest). To prove its rows, a partition of leaves works out which node
coordinates it can't derive itself, each once, fetches them in one join, derives the nodes above its
leaves from both, and writes each leaf's own proof from what it then holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage, width

#: Children of a node, levels that one task builds at a time, and leaves of a partition that is proved at once.
ARITY, LEVELS, PART = 8, 4, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Key of the tree over the languages' tops; a language's own tree is "=" and its name, or "-" for none.
TOP = ""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields: "-" for null, else the count of UTF-8 bytes, ":" and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows (staged) with pos, each row's place in its tree by the order columns, and n, the rows of that tree.

    Rows are dealt by ranges of (tree, order) and numbered in their partition; only a count for each
    tree and partition is added up. Rows equal in all of these are dealt apart, in whatever order.
    """
    spare = free_name(rows, "dealt")
    dealt = rows.withColumn(spare, F.monotonically_increasing_id())
    keys = [tree, *order, spare]
    sorted_rows = dealt.repartitionByRange(width(rows), *keys).sortWithinPartitions(*keys).drop(spare)
    numbered = stage(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "numbered").withColumn("piece", F.shiftright("place", 33))
    pieces = numbered.groupBy(F.col(tree).alias("of_tree"), F.col("piece").alias("of_piece")).agg(F.min("place").alias("first"), F.count("*").alias("held"))
    # a tree has at most as many pieces as there are partitions
    lists = pieces.groupBy("of_tree").agg(F.array_sort(F.collect_list(F.struct("of_piece", "first", "held"))).alias("all"), F.sum("held").alias("n"))
    before = lambda x: F.aggregate(F.filter("all", lambda y: y["of_piece"] < x["of_piece"]), F.lit(0).cast("long"), lambda a, y: a + y["held"])
    offsets = lists.select("of_tree", "n", F.explode(F.transform("all", lambda x: F.struct(x["of_piece"].alias("of_piece"), x["first"].alias("first"), before(x).alias("before")))).alias("x")).select("of_tree", "n", "x.*")
    joined = numbered.join(offsets, (F.col(tree) == F.col("of_tree")) & (F.col("piece") == F.col("of_piece")))
    return joined.withColumn("pos", F.col("place") - F.col("first") + F.col("before")).select(*rows.columns, "pos", "n")


def above(nodes: dict[int, str], n: int) -> dict[int, str]:
    """The nodes over a level of n nodes, for the runs that are whole in the given ones."""
    out = {}
    for parent in sorted({p // ARITY for p in nodes}):
        run = range(parent * ARITY, min((parent + 1) * ARITY, n))
        out[parent] = digest([nodes[p] for p in run])
    return out


def height(n: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def grown(leaves: DataFrame) -> DataFrame:
    """leaves (tree, pos, n, digest) -> every node (tree, level, pos, digest), leaves at level 0.

    A task builds LEVELS levels over at most ARITY ** LEVELS nodes; the topmost of these are the leaves
    of the next round, so a tree of a milliard rows takes three.
    """
    schema = "tree string, level int, pos long, n long, digest string"
    level, row, parts = 0, leaves.select("tree", F.lit(0).alias("level"), "pos", "n", "digest"), []

    def build(block: pd.DataFrame) -> pd.DataFrame:
        tree, low, n = block["tree"].iloc[0], int(block["level"].iloc[0]), int(block["n"].iloc[0])
        nodes, out = dict(zip(block["pos"].tolist(), block["digest"].tolist(), strict=True)), []
        for k in range(low + 1, low + LEVELS + 1):
            if n == 1:
                break
            nodes, n = above(nodes, n), -(-n // ARITY)
            out += [(tree, k, p, n, d) for p, d in nodes.items()]
        return pd.DataFrame(out, columns=["tree", "level", "pos", "n", "digest"])

    while True:
        parts.append(row.select("tree", "level", "pos", "digest"))
        unfinished = row.where((F.col("n") > 1) & (F.col("level") == level))
        if unfinished.isEmpty():
            break
        block = F.floor(F.col("pos") / F.lit(ARITY**LEVELS)).alias("block")
        row = stage(unfinished.groupBy("tree", block).applyInPandas(build, schema), "nodes")
        level += LEVELS
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Manifest:
    """leaves: (doc_id, tree, digest, claim, pos, n); nodes: (tree, level, pos, digest), see _named() for level -1."""

    leaves: DataFrame
    nodes: DataFrame


def manifest(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """Leaves and nodes of all rows of documents, staged.

    claim: the digest of a row as someone else holds it, to be checked against the tree; the row's own if not
    given. Rows of one language ascend by doc_id (null first), then by leaf; rows equal in both
    are alike and keep one leaf each. Languages ascend with null first, by UTF-8 bytes; the empty
    name is a language of its own. Any column may be null; further columns are not looked at.
    """
    own = leaf_digest([F.col(c) for c in FIELDS])
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree")
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree, own.alias("digest"), (own if claim is None else claim).alias("claim")), "leaves")
    leaves = stage(placed(rows, "tree", ["doc_id", "digest", "claim"]), "placed")
    nodes = stage(grown(leaves), "forest")
    sizes = leaves.groupBy("tree").agg(F.first("n").alias("n"))
    tops = sizes.withColumn("level", F.expr(_height_sql("n"))).withColumn("pos", F.lit(0).cast("long")).join(nodes, ["tree", "level", "pos"])
    # "-" sorts before "=", and all other names share their first letter
    subroots = stage(tops.select(F.col("tree").alias("name"), "digest", F.lit(TOP).alias("tree")), "subroots")
    roots = stage(placed(subroots, "tree", ["name"]), "tops")
    return Manifest(leaves, stage(nodes.unionByName(grown(roots)), "nodes").unionByName(_named(roots)))


def _named(roots: DataFrame) -> DataFrame:
    """Where a language stands among the tops, as a row at level -1: pos is its place, digest the count of tops."""
    return roots.select(F.col("name").alias("tree"), F.lit(-1).alias("level"), "pos", F.col("n").cast("string").alias("digest"))


def _height_sql(n: str) -> str:
    """height() of a column, up to 8 ** 20 leaves."""
    return "case " + " ".join(f"when {n} <= {ARITY**k} then {k}" for k in range(21)) + " end"


def missing(have: set[int], n: int) -> dict[int, list[int]]:
    """For leaves at these places of a tree of n: by level, the least set of nodes from which, with the leaves, the top follows."""
    out, level = {}, 0
    while n > 1:
        parents = sorted({p // ARITY for p in have})
        lacking = [p for parent in parents for p in range(parent * ARITY, min((parent + 1) * ARITY, n)) if p not in have]
        if lacking:
            out[level] = lacking
        have, n, level = set(parents), -(-n // ARITY), level + 1
    return out


class Climb:
    """What a partition knows of one tree: its own leaves, the nodes fetched, and every node between them and the top."""

    def __init__(self, own: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> None:
        self.sizes, self.nodes, level = [n], [dict(own)], 0
        self.paths: dict[tuple[int, int], list[tuple[str, str]]] = {}
        lacking = missing(set(own), n)
        while n > 1:
            held = self.nodes[level]
            wanted = {p // ARITY for p in held}
            held |= {p: fetched[level, p] for p in lacking.get(level, ())}
            self.nodes.append(above({p: d for p, d in held.items() if p // ARITY in wanted}, n))
            n, level = -(-n // ARITY), level + 1
            self.sizes.append(n)

    @property
    def top(self) -> str:
        return self.nodes[-1][0]

    def path(self, p: int, level: int = 0) -> list[tuple[str, str]]:
        """(digests to the left, digests to the right) of the node in its run, from its level to the top."""
        if self.sizes[level] == 1:
            return []
        if (level, p) not in self.paths:
            first, held = p // ARITY * ARITY, self.nodes[level]
            left = "".join(held[q] for q in range(first, p))
            right = "".join(held[q] for q in range(p + 1, min(first + ARITY, self.sizes[level])))
            self.paths[level, p] = [(left, right), *self.path(p // ARITY, level + 1)]
        return self.paths[level, p]


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The top that a leaf and its siblings give."""
    for left, right in path:
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


PROOF = "doc_id long, leaf string, claim string, subroot string, root string, proof_sha256 string, folded_root string, n_siblings long"


def proofs(held: Manifest, wanted: DataFrame | None = None, part: int = PART) -> DataFrame:
    """(doc_id, leaf, claim, subroot, root, proof_sha256, folded_root, n_siblings), a row for each leaf, or for those whose doc_id is in wanted (doc_id).

    Partitions are stretches of `part` places of a tree, whichever of their leaves are wanted. proof_sha256 is the digest of all
    siblings, left to right, level by level; folded_root is what claim and siblings give.
    """
    chosen = held.leaves if wanted is None else held.leaves.join(wanted.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    marked = chosen.withColumn("part", F.floor(F.col("pos") / F.lit(part)))
    # where each partition's language stands among the tops comes with the first nodes it fetches
    named = held.nodes.where("level = -1").select("tree", F.col("pos").alias("tree_pos"), F.col("digest").cast("long").alias("n_trees"))
    parts = marked.groupBy("tree", "part").agg(F.array_sort(F.collect_list("pos")).alias("own"), F.first("n").alias("n"))  # at most `part` places
    parts = stage(parts.join(named, "tree"), "parts")

    def lacking(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = (row.tree, row.part)
                own = missing(set(row.own.tolist()), row.n)
                out += [(*key, row.tree, level, p) for level, places in own.items() for p in places]
                tops = missing({row.tree_pos}, row.n_trees)
                out += [(*key, TOP, level, p) for level, places in tops.items() for p in places]
                out.append((*key, TOP, height(row.n_trees), 0))  # the root itself, to compare with
            yield pd.DataFrame(out, columns=["of_tree", "part", "tree", "level", "pos"])

    asked = parts.mapInPandas(lacking, "of_tree string, part long, tree string, level int, pos long")
    known = held.nodes.where("level >= 0")
    fetched = asked.join(known, ["tree", "level", "pos"]).select("of_tree", "part", (F.col("tree") == TOP).alias("is_top"), "level", "pos", "digest")
    places = parts.select("tree", "part", "tree_pos", "n_trees")
    side = fetched.unionByName(places.select(F.col("tree").alias("of_tree"), "part", F.lit(True).alias("is_top"), F.lit(-1).alias("level"), F.col("tree_pos").alias("pos"), F.col("n_trees").cast("string").alias("digest")))
    return marked.groupBy("tree", "part").cogroup(side.groupBy("of_tree", "part")).applyInPandas(_expander(), PROOF)


def _expander() -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def expand(own: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        low, high, tree_pos, n_trees = {}, {}, 0, 0
        for is_top, level, pos, node in zip(side["is_top"].tolist(), side["level"].tolist(), side["pos"].tolist(), side["digest"].tolist(), strict=True):
            if level < 0:
                tree_pos, n_trees = pos, int(node)
            else:
                (high if is_top else low)[level, pos] = node
        root = high[height(n_trees), 0]
        tree = Climb(dict(zip(own["pos"].tolist(), own["digest"].tolist(), strict=True)), int(own["n"].iloc[0]), low)
        tops = Climb({tree_pos: tree.top}, n_trees, high).path(tree_pos)
        out = []
        for pos, leaf, claim in zip(own["pos"].tolist(), own["digest"].tolist(), own["claim"].tolist(), strict=True):
            path = tree.path(pos) + tops
            siblings = [x for pair in path for x in pair]
            out.append((leaf, claim, tree.top, root, digest(siblings), fold(claim, path), sum(map(len, siblings)) // 64))
        found = pd.DataFrame(out, columns=["leaf", "claim", "subroot", "root", "proof_sha256", "folded_root", "n_siblings"])
        found.insert(0, "doc_id", own["doc_id"].astype("Int64").to_numpy())
        return found

    return expand


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row after tampering: where 3 divides the unsigned crc32 of the decimal doc_id, the text's A-Z are lower case."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit, F.translate("text", _UPPER, _UPPER.lower())).otherwise(F.col("text"))
    return leaf_digest([text if c == "text" else F.col(c) for c in FIELDS])


def verified(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row.

    Leaves, nodes and proofs are those of the table; what is folded is the tampered row. A row without a
    doc_id is not tampered with. Repeated rows have a leaf and a proof each; an empty table gives no rows.
    """
    found = proofs(manifest(docs, tampered(docs)))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "n_siblings")
