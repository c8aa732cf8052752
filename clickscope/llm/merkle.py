"""Merkle manifest of a dataset, with proofs and folds by retained hash states.

Every row is a leaf.  Leaves of a group stand in id order; eight neighbours at a time are
hashed into their parent until one node, the group's subroot, is left, and the subroots
into the root in the same way.  A parent keeps a copy of its hash state before each child
slot, so a fold resumes at the changed child and reads what stands right of it only.

A leaf's place is its rank in one distributed sort (``rank.unique_rank``), and four levels
of the tree are made in one task from 4,096 neighbours: a chunk's size is fixed by places,
so a group that holds a third of all rows is many chunks like any other, and each round
leaves a 4,096th of the rows.  Proofs go the other way: a chunk's task gets the path above
its top node (one small row) beside its own nodes, in one cogroup.  Every round is a stored
table; the driver sees one number a round.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickscope.llm.common import broadcast_checked, materialize, ship
from clickscope.operators.rank import unique_rank

ship(__name__)

FANOUT = 8
CHUNK_LEVELS = 4
DIGEST = 32
_NODE = "gid long, pos long, n long, digest binary"
_PATH = "gid long, pos long, path binary, subroot binary"


def digest(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of the values as text: ``-`` for null, else the UTF-8 byte
    count, ``:`` and the value."""
    text = [v.cast("string") for v in values]
    framed = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text]
    return F.sha2(F.concat(*framed).cast("binary"), 256)


class Branch:
    """A parent node: children, own digest, and the hash state before each child slot."""

    __slots__ = ("children", "before", "digest")

    def __init__(self, children: list[bytes]):
        state, self.children, self.before = hashlib.sha256(), children, []
        for child in children:
            self.before.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in ``slot``: from the state before that slot."""
        state = self.before[slot].copy()
        state.update(replacement + b"".join(self.children[slot + 1:]))
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1:])


def _depth(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    depth = 0
    while n > 1:
        n, depth = -(-n // FANOUT), depth + 1
    return depth


def _grown(nodes: list[bytes], levels: int) -> list[list[Branch]]:
    """The levels of parents above neighbouring nodes (hex digests)."""
    made = []
    for _ in range(levels):
        made.append([Branch(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
        nodes = [b.digest for b in made[-1]]
    return made


def _pack(branch: Branch, slot: int) -> bytes:
    return bytes((slot, len(branch.children))) + b"".join(bytes.fromhex(c.decode()) for c in branch.children)


def _unpack(path: bytes) -> list[tuple[Branch, int]]:
    steps, at = [], 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        at += 2
        steps.append((Branch([path[at + i * DIGEST:at + (i + 1) * DIGEST].hex().encode() for i in range(n)]), slot))
        at += n * DIGEST
    return steps


def _chunk(levels: int) -> Column:
    return F.floor(F.col("pos") / F.lit(FANOUT ** levels)).cast("long")


def _chunk_nodes(part: pd.DataFrame) -> tuple[list[bytes], int]:
    return [bytes(d).hex().encode() for d in part["digest"]], _depth(int(part["n"].iloc[0]))


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The top node of each chunk, as a node of the next round."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        leaves, depth = _chunk_nodes(part)
        up = min(levels, depth)
        top = _grown(leaves, up)[-1][0].digest if up else leaves[0]
        n = int(part["n"].iloc[0])
        for _ in range(up):
            n = -(-n // FANOUT)
        return pd.DataFrame({"gid": [part["gid"].iloc[0]], "pos": [part["pos"].iloc[0] // FANOUT ** levels], "n": [n],
                             "digest": [bytes.fromhex(top.decode())]})

    return nodes.select("gid", "pos", "n", "digest").groupBy("gid", _chunk(levels).alias("chunk")).applyInPandas(run, _NODE)


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """``nodes`` and, round by round, the tops of their chunks until each group has one node."""
    made = [nodes]
    while (made[-1].agg(F.max("n")).first()[0] or 0) > 1:
        made.append(materialize(_tops(made[-1], levels), "merkle_nodes"))
    return made


def _below(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """The paths of ``nodes`` (a round), from those of their chunks' top nodes."""
    def run(part: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        leaves, depth = _chunk_nodes(part)
        grown, above = _grown(leaves, min(levels, depth)), bytes(top["path"].iloc[0])
        path = []
        for i in range(len(leaves)):
            own = []
            for level in grown:
                own.append(_pack(level[i // FANOUT], i % FANOUT))
                i //= FANOUT
            path.append(b"".join(own) + above)
        return pd.DataFrame({"gid": part["gid"].to_numpy(), "pos": part["pos"].to_numpy(), "path": path, "subroot": top["subroot"].iloc[0]})

    keyed = nodes.select("gid", "pos", "n", "digest", _chunk(levels).alias("chunk"))
    tops = paths.select("gid", F.col("pos").alias("chunk"), "path", "subroot")
    return keyed.groupBy("gid", "chunk").cogroup(tops.groupBy("gid", "chunk")).applyInPandas(run, _PATH)


def _folded(leaves: DataFrame, paths: DataFrame, id_type: T.DataType, levels: int) -> DataFrame:
    """Proofs and folds of all leaves of a chunk."""
    def run(part: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        nodes, depth = _chunk_nodes(part)
        grown, above, subroot = _grown(nodes, min(levels, depth)), _unpack(bytes(top["path"].iloc[0])), bytes(top["subroot"].iloc[0])
        rest = b"".join(branch.siblings(slot) for branch, slot in above)
        root = above[-1][0].digest if above else (grown[-1][0].digest if grown else nodes[0])
        proofs, folds = [], []
        for i, other in enumerate(part["other"]):
            proof, node = hashlib.sha256(), bytes(other).hex().encode()
            for level in grown:
                branch, slot, i = level[i // FANOUT], i % FANOUT, i // FANOUT
                proof.update(branch.siblings(slot))
                node = branch.fold(slot, node)
            proof.update(rest)
            for branch, slot in above:
                node = branch.fold(slot, node)
            proofs.append(proof.hexdigest())
            folds.append(node.decode())
        return pd.DataFrame({"id": part["id"], "leaf": [n.decode() for n in nodes], "subroot": subroot.hex(), "root": root.decode(),
                             "proof_sha256": proofs, "folded_root": folds})

    kind = T.StructType([T.StructField("id", id_type)] + [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")])
    keyed = leaves.select("gid", "pos", "n", "digest", "other", "id", _chunk(levels).alias("chunk"))
    tops = paths.select("gid", F.col("pos").alias("chunk"), "path", "subroot")
    return keyed.groupBy("gid", "chunk").cogroup(tops.groupBy("gid", "chunk")).applyInPandas(run, kind)


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """``id, group, digest, other`` with ``gid`` (a number for the group), ``pos`` (the leaf's
    place in it from 0) and ``n`` (the group's leaves).  Order: id, null first, then digest."""
    # the last column spreads rows that are equal throughout over the range partitions
    stored = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle_leaves")
    ranked = unique_rank(stored, ["group", "id", "digest", "row"], "rank")
    groups = materialize(ranked.groupBy(F.col("group").alias("_group")).agg((F.min("rank") - 1).alias("gid"), F.count(F.lit(1)).alias("n")), "merkle_groups")
    joined = ranked.join(broadcast_checked(groups), F.col("group").eqNullSafe(F.col("_group")))
    return joined.select("id", "group", "digest", "other", "gid", "n", (F.col("rank") - 1 - F.col("gid")).alias("pos"))


def folded_leaves(leaves: DataFrame, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root`` of leaves ``id, group, digest,
    other`` (binary digests; ``other`` takes the leaf's place in the fold)."""
    placed = placed_leaves(leaves)
    rounds = _rounds(placed, chunk_levels)
    subroots = rounds[-1].select("gid", "digest")
    # group numbers ascend with the groups' order: the subroots' places are their ranks
    ranked = unique_rank(subroots.select(F.col("gid").alias("ref"), "digest"), ["ref"], "rank")
    n = ranked.count()
    forest = _rounds(ranked.select(F.lit(0).cast("long").alias("gid"), (F.col("rank") - 1).alias("pos"), F.lit(n).cast("long").alias("n"), "digest"), chunk_levels)
    paths = forest[-1].select("gid", "pos", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"))
    for nodes in reversed(forest[:-1]):
        paths = materialize(_below(nodes, paths, chunk_levels), "merkle_paths")
    paths = (ranked.join(paths.select(F.col("pos").alias("_pos"), "path"), F.col("rank") - 1 == F.col("_pos"))
             .select(F.col("ref").alias("gid"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot")))
    if len(rounds) == 1:  # every group is one leaf
        return _folded(placed, materialize(paths, "merkle_paths"), leaves.schema["id"].dataType, chunk_levels)
    for nodes in reversed(rounds[1:-1]):
        paths = materialize(_below(nodes, paths, chunk_levels), "merkle_paths")
    return _folded(placed, paths, leaves.schema["id"].dataType, chunk_levels)


def merkle_manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang",
                    changed: dict[str, Column] | None = None, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """One row for each row of ``df``: the id, ``leaf``, its group's ``subroot``, ``root``,
    ``proof_sha256`` (of its siblings from the leaf to the root), ``folded_root`` (the root
    that the proof gives for the row with ``changed`` columns) and ``verified`` (it is the
    same root).

    Nulls are values of their own (``-``), a null group comes first, a null id first in its
    group; empty and long texts are leaves like others.  Rows of one id stand in the order
    of their digests, repeated rows on places of their own.  Extra columns are not read; an
    empty table gives an empty one."""
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    leaves = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.unhex(digest(*[F.col(c) for c in columns])).alias("digest"),
                       F.unhex(digest(*other)).alias("other"))
    done = folded_leaves(leaves, chunk_levels)
    return done.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


DOCUMENT_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tamper_check(docs: DataFrame, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """The manifest of documents, folded as if the texts of those whose CRC-32 of the decimal
    id is divisible by 3 had A-Z lower-cased.  (A null id has no CRC: nothing is changed.)"""
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle_manifest(docs, DOCUMENT_COLUMNS, changed={"text": F.when(chosen, lowered).otherwise(F.col("text"))}, chunk_levels=chunk_levels)
