"""Merkle manifest of a data set: a root, and for each row the proof that it belongs to it.

Each row is a leaf. The leaves of a source, by ascending id, are the base of a tree of fanout 16,
whose root is the source's; the sources' roots, by ascending source, are the base of one more tree.

Spark ranks the leaves over all tasks, however many of them one source has, and deals them to
aligned blocks of 256 consecutive leaves, the partitions of the exchange. A block hashes its own two
levels. The levels above come from a butterfly exchange: in each round up to 16 blocks, which stand
at the same place below 16 neighbouring nodes, swap the roots of their subtrees. Each then has the
siblings of its own node, and hashes the parent itself, redundantly, so after the last round each
block holds the root and the upper part of its leaves' proofs and nothing is passed down again.
Where the last node of a level has fewer blocks than its neighbours, they send their root to more
partners, in turn. No exchange gathers more than 16 digests, and blocks take part as one narrow row.

All of it is DataFrame expressions. Defined results: a NULL field is the leaf's `-`; NULL sources
are one source, before all others; NULL ids come first in their source and are never tampered with;
rows of equal ids stand by their digests, and equal rows are leaves of their own; an empty table has
no rows. Only the five columns of the leaf are read, texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qagrade.llm.common import narrow, stored
from qagrade.operators.index import row_index
from qagrade.sources.scratch import scoped

FANOUT = 16
BLOCK = FANOUT * FANOUT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEVELS = "array<struct<l: string, r: string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as its length in bytes and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _above(n: Column) -> Column:
    """How many nodes the next level has."""
    return F.floor((n + FANOUT - 1) / FANOUT)


def _joined(digests: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(digests, start, length), "")


def _parents(digests: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: F.sha2(_joined(digests, i * FANOUT + 1, F.lit(FANOUT)), 256))


def _siblings(digests: Column, i: Column) -> Column:
    """Left and right siblings of the digest at `i` in its run."""
    first = i - i % FANOUT
    return F.struct(
        _joined(digests, first + 1, i - first).alias("l"), _joined(digests, i + 2, first + FANOUT - 1 - i).alias("r")
    )


def _blocks(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, n, pos, digest, extra) to one row a block: up to 256 leaves in order and their
    next level up, stored."""
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    rows = leaves.groupBy("tree", "n", block).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "extra"))).alias("leaves")
    )
    digests = F.transform("leaves", lambda x: x["digest"])
    first = F.when(F.col("n") > 1, _parents(digests)).otherwise(digests)
    return stored(rows.withColumn("nodes", first), "blocks")


def _levels(condition: Column, *levels: Column) -> Column:
    return F.when(condition, F.array(*levels).cast(_LEVELS)).otherwise(F.array().cast(_LEVELS))


def _climbed(blocks: DataFrame, most: int) -> DataFrame:
    """tree, block, root and the upper levels of its proofs, of every block, by butterfly rounds.

    `most` is the number of leaves of the largest tree.
    """
    two = _above(F.col("n")) > 1
    root = F.when(two, F.sha2(F.array_join("nodes", ""), 256)).otherwise(F.col("nodes")[0])
    count = _above(_above(F.col("n"))).alias("blocks")
    state = blocks.select("tree", "block", count, root.alias("root"), F.array().cast(_LEVELS).alias("levels"))
    state, width = stored(state, "roots"), 1
    while width < -(-most // BLOCK):
        state = stored(_swapped(state, width), "roots")
        width *= FANOUT
    return state


def _swapped(state: DataFrame, width: int) -> DataFrame:
    """One round: nodes of `width` blocks meet their siblings; trees that are done pass through."""
    node, residue = F.floor(F.col("block") / width), F.col("block") % width
    rows = state.withColumns({"node": node, "residue": residue})
    rows = rows.withColumns(
        {"group": F.floor(F.col("node") / FANOUT), "digit": (F.col("node") % FANOUT).cast("int"), "real": F.lit(True)}
    )
    own = F.col("blocks") - F.col("node") * width  # blocks of this node, if it is the last one
    ragged = rows.where((F.col("digit") > 0) & (own < width) & (F.col("residue") + own < width))
    spare = ragged.withColumn("residue", F.explode(F.sequence(F.col("residue") + own, F.lit(width - 1).cast("long"), own)))
    spare = spare.withColumns({"real": F.lit(False), "levels": F.array().cast(_LEVELS)})
    met = Window.partitionBy("tree", "group", "residue")
    swap = F.array_sort(F.collect_list(F.struct("digit", "root")).over(met))
    rows = rows.unionByName(spare).withColumn("swap", swap).where("real")
    side = lambda wanted: F.array_join(F.transform(F.filter("swap", wanted), lambda x: x["root"]), "")
    rows = rows.withColumns(
        {"l": side(lambda x: x["digit"] < F.col("digit")), "r": side(lambda x: x["digit"] > F.col("digit"))}
    )
    open_ = F.col("blocks") > width
    parent = F.sha2(F.concat("l", "root", "r"), 256)
    return rows.select(
        "tree", "block", "blocks", F.when(open_, parent).otherwise(F.col("root")).alias("root"),
        F.concat("levels", _levels(open_, F.struct("l", "r"))).alias("levels"),
    )


def _leaf_rows(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """Every leaf with all levels of its proof, from the leaf up, and the other columns of `upper`."""
    rows = blocks.join(upper, ["tree", "block"])
    digests = F.transform("leaves", lambda x: x["digest"])
    rows = rows.withColumn("digests", digests)
    one, two = F.col("n") > 1, _above(F.col("n")) > 1

    def proved(leaf: Column, i: Column) -> Column:
        run = F.floor(i / FANOUT).cast("int")
        own = F.concat(_levels(one, _siblings(F.col("digests"), i)), _levels(two, _siblings(F.col("nodes"), run)))
        return F.struct(leaf["digest"].alias("digest"), leaf["extra"].alias("extra"), own.alias("own"))

    kept = [c for c in upper.columns if c not in ("tree", "block", "blocks", "levels")]
    rows = rows.select(*kept, "levels", F.inline(F.transform("leaves", proved)))
    return rows.select(*kept, "digest", "extra", F.concat("own", "levels").alias("levels"))


def folded(leaf: Column, levels: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(levels, leaf, lambda node, x: F.sha2(F.concat(x["l"], node, x["r"]), 256))


def proof_digest(levels: Column) -> Column:
    return F.sha2(F.array_join(F.transform(levels, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def tampered_rows(doc_id: Column) -> Column:
    """Where the manifest is tried: ids whose checksum 5 divides."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@scoped
def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and `levels`, the siblings left and right of the leaf's ancestors
    from the leaf up, of every row; `tampered` is the leaf of the tried rows with their text's A-Z
    lowered, and the leaf itself elsewhere."""
    rows = narrow(docs, *FIELDS)
    fields = [F.col(c) for c in FIELDS]
    changed = leaf_digest(*fields[:-1], F.translate("text", _UPPER, _LOWER))
    leaves = rows.select("doc_id", "source", leaf_digest(*fields).alias("leaf"), F.when(tampered_rows(F.col("doc_id")), changed).alias("changed"))
    leaves = stored(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    ranked = row_index(leaves, ["source", "doc_id", "leaf", "tie"], "place")
    sources = ranked.groupBy("source").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    sources = stored(row_index(stored(sources, "sources"), ["start"], "tree"), "sources")
    most, trees = sources.agg(F.max("n"), F.count("*")).first()
    extra = F.struct("doc_id", F.coalesce("changed", "leaf").alias("changed")).alias("extra")
    placed = ranked.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    blocks = _blocks(placed.select("tree", "n", (F.col("place") - F.col("start")).alias("pos"), F.col("leaf").alias("digest"), extra))
    upper = _climbed(blocks, most or 0)
    # the sources' roots are the leaves of one more tree, whose proofs continue those of the rows
    roots = upper.where("block = 0").select(F.lit(0).cast("long").alias("top"), "tree", "root")
    tops = _blocks(roots.select(F.col("top").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("pos"), F.col("root").alias("digest"), F.col("tree").alias("extra")))
    tops = _leaf_rows(tops, _climbed(tops, trees))
    tops = stored(tops.select(F.col("extra").alias("tree"), F.col("root").alias("top"), F.col("levels").alias("further")), "tops")
    whole = upper.join(tops, "tree").select("tree", "block", "blocks", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("levels", "further").alias("levels"))
    found = _leaf_rows(blocks, whole)
    return found.select("extra.doc_id", F.col("digest").alias("leaf"), "subroot", "root", "levels", F.col("extra.changed").alias("tampered"))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, a digest of the leaf's proof, the root that the leaf, tampered
    with where it is tried, gives with its siblings, and whether that is the root."""
    rows = manifest(docs).withColumn("folded_root", folded(F.col("tampered"), F.col("levels")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("levels")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
