"""Operator 11: Merkle manifest of a dataset: a tree over the rows of each group, and a tree over the groups' roots.

A level is one window: nodes of a group that share a parent (ARITY consecutive ones; the last run may be shorter) are one
partition of the window, and the list over its full frame, in order, gives both the parent's preimage and each node's
siblings. Parents are made distinct and are the nodes of the next level, so levels shrink by ARITY and no task ever sees
more than a run at a time. Proofs come back from the top: a node's proof is its own siblings before its parent's proof,
one join by (group, parent) for each level, over as many rows as the level has.

The digest of a node is the lowercase hex SHA-256 of its children's hex digests in order. A group of one row has that
row's leaf as its root. Groups are ordered by their key, as bytes, null first.

Defined results: a null field is hashed as `-`, an empty one as `0:`; rows with a null in the order stand first, ties are
ordered by their leaf; repeated rows each keep a leaf and a proof; an empty table has no rows and no root. Names of the
table's other columns do not matter: only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actmill.llm.arrays import checkpointed
from actmill.llm.ordering import numbered

ARITY = 3
_STEP = "array<struct<left: binary, right: binary>>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def sha256(text: Column) -> Column:
    """Lowercase hex of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 byte count, a colon and itself; - for null. No two lists of values hash the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return sha256(F.concat(*map(field, values)))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its siblings give, level by level."""
    return F.aggregate(proof, leaf, lambda acc, s: sha256(F.concat(hexed(s["left"]), acc, hexed(s["right"]))))


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of all siblings' hex digests, from the leaf's level to the root's, left to right."""
    return sha256(F.array_join(F.transform(proof, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""))


def _level(nodes: DataFrame) -> DataFrame:
    """nodes(group, place, held, digest) with parent, left and right siblings, and above: the parent's digest."""
    dealt = nodes.withColumn("parent", F.floor(F.col("place") / ARITY))
    run = F.collect_list("digest").over(Window.partitionBy("group", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = (F.col("place") % ARITY).cast("int")
    joined = lambda part: F.array_join(F.transform(part, hexed), "")
    seen = dealt.withColumn("run", run)
    return seen.select(
        "group", "place", "held", "parent", F.unhex(joined(F.slice("run", F.lit(1), at))).alias("left"), F.unhex(joined(F.slice("run", at + 2, F.lit(ARITY)))).alias("right"),
        F.unhex(sha256(joined(F.col("run")))).alias("above"),
    )


def tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels from below, each a written table, and roots(group, depth, digest): depth is the number of levels below a root.

    nodes has group string, place from 0, held (nodes of the group) and digest binary.
    """
    levels, depth = [], 0
    roots = nodes.filter("held = 1").select("group", F.lit(0).alias("depth"), "digest")
    most = nodes.agg(F.max("held")).first()[0] or 0
    while most > 1:
        done = checkpointed(_level(nodes.filter("held > 1")))
        levels.append(done)
        most, depth = -(-most // ARITY), depth + 1
        held = F.ceil(F.col("held") / ARITY)
        nodes = done.select("group", F.col("parent").alias("place"), held.alias("held"), F.col("above").alias("digest")).dropDuplicates(["group", "place"])
        roots = roots.unionByName(nodes.filter("held = 1").select("group", F.lit(depth).alias("depth"), "digest"))
    return levels, roots


def proved(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(group, place, proof, *rest) of the lowest nodes, from tops(group, depth, proof, *rest) of the roots.

    proof has a (left, right) pair of binary sibling digests for each level. What else tops carries goes down with it.
    """
    rest = [c for c in tops.columns if c not in ("group", "depth", "proof")]
    at = lambda depth: tops.filter(F.col("depth") == depth).select("group", F.lit(0).cast("long").alias("place"), "proof", *rest)
    below = at(len(levels))
    for depth in range(len(levels) - 1, -1, -1):
        parents = below.select("group", F.col("place").alias("parent"), F.col("proof").alias("further"), *rest)
        own = F.array(F.struct("left", "right"))
        below = levels[depth].join(parents, ["group", "parent"]).select("group", "place", F.concat(own, "further").cast(_STEP).alias("proof"), *rest).unionByName(at(depth))
    return below


def manifest(rows: DataFrame, group: Column, order: list[Column], leaf: Column, keep: list[Column]) -> DataFrame:
    """keep and leaf of each row, with subroot, root (hex) and proof: everything that checks a row against the root.

    Rows are read once; what travels is keep, the order's columns and 32 bytes a digest.
    """
    kept = [f"keep_{i}" for i in range(len(keep))]
    by = [f"by_{i}" for i in range(len(order))]
    named = [F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit("-")).alias("group"), F.unhex(leaf).alias("digest")]
    ready = checkpointed(rows.select(*named, *(c.alias(n) for c, n in zip(keep, kept, strict=True)), *(c.alias(n) for c, n in zip(order, by, strict=True))))
    leaves = checkpointed(numbered(ready, "group", [*(F.col(n).asc_nulls_first() for n in by), F.col("digest")]).drop(*by))
    levels, roots = tree(leaves.select("group", "place", "held", "digest"))
    # The groups' roots are the leaves of the upper tree; its one group is the dataset.
    sub = checkpointed(roots.select(F.lit("").alias("group"), F.col("group").alias("of"), "depth", "digest"))
    ranked = checkpointed(numbered(sub, "group", [F.col("of")]))
    upper, top = tree(ranked.select("group", "place", "held", "digest"))
    root = top.first()
    tops = proved(upper, top.select("group", "depth", F.array().cast(_STEP).alias("proof")))
    subroots = ranked.join(tops, ["group", "place"]).select(F.col("of").alias("group"), "depth", "proof", hexed(F.col("digest")).alias("subroot"))
    proofs = proved(levels, checkpointed(subroots))
    hex_root = F.lit(None if root is None else bytes(root["digest"]).hex()).cast("string")
    out = leaves.join(proofs, ["group", "place"])
    return out.select(*(F.col(n) for n in kept), hexed(F.col("digest")).alias("leaf"), "subroot", hex_root.alias("root"), "proof").toDF(*(rows.select(*keep).columns), "leaf", "subroot", "root", "proof")


def tampering_report(docs: DataFrame) -> DataFrame:
    """The manifest of documents, and which of them still fold to the root after newlines were deleted from some texts.

    A text is tampered with where the CRC-32 of its decimal doc_id is even; a row with a null doc_id never is.
    """
    of = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    # Only what differs from the leaf is carried: null where the text is untouched.
    found = F.when(touched, F.unhex(of(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))).alias("found")
    told = manifest(docs, F.col("source"), [F.col("doc_id")], of(F.col("text")), [F.col("doc_id"), found])
    back = folded(F.coalesce(hexed(F.col("found")), F.col("leaf")), F.col("proof"))
    out = told.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
