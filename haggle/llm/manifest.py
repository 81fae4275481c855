"""A Merkle manifest of a table: leaves of rows, a tree for each group, a tree over the groups.

Nodes of a level are numbered; node p has its parent at p / 8. Windows are as wide as
a run of eight: lag and lead columns at offsets 1 to 7, masked by a node's slot and its
run's length, are its siblings, and the first child's row hashes the run. No window
spans a group, and a run's rows already lie where its parent is joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haggle.llm.vectors import stored

#: Children of a node.
WIDTH = 8


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts' concatenated bytes."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def number(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `pos`, from 0 in `order` inside each group, and `n`, the group's rows.

    One range sort by (group, order); a range's rows of a group follow one another, so a
    row's place is its place there plus the rows of the group in earlier ranges. A group
    spread over many ranges is never brought together. The result is written once."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stored(ranged.withColumns({"__at": F.monotonically_increasing_id(), "__range": F.spark_partition_id()}), "ordered")
    spans = placed.groupBy("__range", group).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    # one row per range and group
    mine = Window.partitionBy(group).orderBy("__range")
    before = F.coalesce(F.sum("__rows").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumns({"__before": before, "n": F.sum("__rows").over(Window.partitionBy(group))}).drop("__rows")
    out = placed.join(spans, ["__range", group]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))
    return out.drop("__range", "__at", "__first", "__before")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (group, pos, n, digest, ...) with `up`, the parent's number, and `left` and `right`: the
    concatenated digests of the run's others before and behind."""
    run = Window.partitionBy("group", "up").orderBy("pos")
    slot = F.col("pos") % WIDTH
    length = F.least(F.lit(WIDTH), F.col("n") - F.col("pos") + slot)
    before = [F.when(slot >= k, F.lag("digest", k).over(run)) for k in range(WIDTH - 1, 0, -1)]
    behind = [F.when(slot + k < length, F.lead("digest", k).over(run)) for k in range(1, WIDTH)]
    placed = nodes.withColumn("up", F.shiftright("pos", 3))
    return placed.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *behind)})


def parents(nodes: DataFrame) -> DataFrame:
    """The next level, of groups that still have several nodes."""
    above = with_siblings(nodes.where("n > 1").select("group", "pos", "n", "digest")).where(F.col("pos") % WIDTH == 0)
    n = F.floor((F.col("n") + WIDTH - 1) / WIDTH).cast("long")
    return above.select("group", F.col("up").alias("pos"), n.alias("n"), digest(F.col("digest"), F.col("right")).alias("digest"))


def climb(leaves: DataFrame) -> list[DataFrame]:
    """Levels (group, pos, n, digest) of the trees, from `leaves` up; each further one is written and has an eighth of the rows below."""
    levels = [leaves]
    while not levels[-1].where("n > 1").isEmpty():
        levels.append(stored(parents(levels[-1]), "nodes"))
    return levels


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level with `path`, the (left, right) of each node and its ancestors from below, and what `above` has besides.

    `above` (group, path, ...) is what a group's top hands down: one row for each group.
    Every join is on a node's parent, which has eight children at most."""
    step = F.array(F.struct("left", "right"))
    more = [c for c in above.columns if c not in ("group", "path")]
    below = None
    for level in reversed(levels):
        own = [c for c in level.columns if c not in ("group", "n")]
        tops = level.where("n = 1").join(above, "group").select("group", *own, "path", *more)
        if below is not None:
            up = below.select("group", F.col("pos").alias("up"), F.col("path").alias("__path"), *more)
            inner = with_siblings(level.where("n > 1")).join(up, ["group", "up"])
            tops = tops.unionByName(inner.select("group", *own, F.concat(step, "__path").alias("path"), *more))
        below = tops if level is levels[0] else stored(tops, "paths")
    return below


def manifest(docs: DataFrame, fields: list[Column], tampered: list[Column], is_tampered: Column, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """One row per row: its id, leaf, subroot, root, proof (an array of left and right siblings by
    level), proof_sha256, folded_root and verified.

    A leaf is the digest of all `fields`. Inside a group of `group_col` leaves ascend by id, null
    ids first, then by leaf, so repeated rows stand side by side, each with a place of its
    own; every eight nodes become their digest until one is left, the subroot, and the
    subroots, in order of the group (null first, by bytes), likewise become the root.
    Where `is_tampered` holds, the fold starts from the digest of `tampered`.

    A null field is `-`, an empty one `0:`. A long text is hashed whole, once or twice, and
    goes no further. Other columns are not read, whatever their names; no rows, no result.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaf = digest(*[field(c) for c in fields])
    found = F.when(is_tampered, digest(*[field(c) for c in tampered]))
    rows = docs.select(F.col(id_col).alias("id"), group.alias("group"), leaf.alias("digest"), found.alias("found"))
    # written before the range sort, which reads its input twice: texts are hashed once
    leaves = stored(number(stored(rows, "hashes"), "group", ["id", "digest"]), "leaves")
    trees = climb(leaves)

    tops = trees[0].where("n = 1").select("group", "digest")
    for level in trees[1:]:
        tops = tops.unionByName(level.where("n = 1").select("group", "digest"))
    one = tops.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest")
    subroots = stored(number(one, "group", ["of"]), "subroots")
    crown = climb(subroots)
    # the top of the crown is one row
    root = crown[-1].where("n = 1").select("group", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    above = descend(crown, root).select(F.col("of").alias("group"), "path", F.col("digest").alias("subroot"), "root")
    paths = descend(trees, stored(above, "groups"))

    folded = F.aggregate("path", F.coalesce("found", "digest"), lambda at, s: digest(s["left"], at, s["right"]))
    siblings = F.array_join(F.flatten(F.transform("path", lambda s: F.array(s["left"], s["right"]))), "")
    out = paths.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", F.col("path").alias("proof"), digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
