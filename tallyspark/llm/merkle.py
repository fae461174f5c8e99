"""A Merkle manifest of a dataset: radix-ranked tries over its rows, one for each group and one over the groups.

A row's leaf is the SHA-256 of its fields, each with its length.  A group's leaves
ascend by id; every ``fanout`` consecutive nodes become the hash of their digests, until
one is left, and the groups' last nodes, by group, likewise.  A row's proof is the
digests beside its path.  To verify it, the leaf is folded with them.

**Ranks without a sort.**  A row's key is its id in hexadecimal digits, then its leaf,
then a number that tells equal rows apart.  Rows are counted by (group, leading digits)
with as many digits as give buckets of ``bucket`` rows at even spread.  A bucket with more
rows is counted again two digits further (behind what all its keys share), as often as
needed.  The counts of a level are summed to those of the level above; in each parent the
up to 256 children get the rows before them from a window, added to the parent's own.  So
a row's rank is what stands before its bucket, and its place in the bucket.

**Trie.**  A node at height h is keyed by its rank's digits of base ``fanout`` without the
last h, and holds what shares that prefix.  The longest prefixes are reduced first, ``height``
digits at once in one group of ``fanout ** height`` nodes, then their prefixes, until one node a
group is left.  Paths come down the same way.

No group of one task grows with the data, whatever ids and groups look like: neither a
group with most rows, nor one id or one row that a third of all rows have.  Everything is
DataFrame expressions.

Defined results: null fields are hashed as ``-``; null ids come first in their group, the
null group first of all; rows with one id follow one another by their leaf, equal rows in any
order (each has the proof of its own place); without rows there is no manifest and the result
is empty.  Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace

PATH = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field of a row as it is hashed: its length in bytes, a colon, itself; or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hexadecimal(value: Column) -> Column:
    """16 digits that ascend as 64-bit numbers do, nulls first."""
    return F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(value.bitwiseXOR(F.lit(-(2**63)))), 16, "0")), F.lit("0" * 17))


def shared_digits(a: Column, b: Column, most: Column) -> Column:
    """How many leading digits two keys have in common."""
    return F.size(F.filter(F.sequence(F.lit(1), most), lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))


def matched(rows: DataFrame, few: DataFrame, on: list[str], most: int, how: str = "inner") -> DataFrame:
    """A join whose right side is broadcast if it has at most ``most`` rows."""
    return rows.join(F.broadcast(few) if few.limit(most + 1).count() <= most else few, on, how)


class Ranked(NamedTuple):
    rows: DataFrame  # with the columns rank and group_rows
    groups: DataFrame  # (group, group_rows)


def ranks(rows: DataFrame, work: Workspace, bucket: int = 4096, broadcast_rows: int = 20_000) -> Ranked:
    """Ranks from 0 in each ``group`` by the hexadecimal text ``key``, which no two rows of a group share."""
    span = rows.agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.max(F.length("key")).alias("most")).first()
    low, high = span["low"] or "", span["high"] or ""
    same = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
    levels = 1
    while 256**levels * bucket < span["n"]:
        levels += 1
    depth, key = same + 2 * levels, F.col("key")
    named = rows.withColumn("bucket", F.substring(key, F.lit(1), F.lit(depth)))
    tables, parents, asked = [], [F.substring("bucket", 1, same + 2 * n) for n in range(levels)], named
    while True:
        summed = asked.groupBy("group", "bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), *([F.min("parent").alias("parent")] if tables else []))
        counts = work.saved(summed)
        tables.append(counts)
        heavy = counts.where((F.col("n") > bucket) & (F.col("low") < F.col("high"))).select("group", "bucket", (shared_digits(F.col("low"), F.col("high"), F.least(F.length("low"), F.length("high"))) + 2).alias("deeper"))
        if heavy.isEmpty():
            break
        split = matched(named, heavy, ["group", "bucket"], broadcast_rows, "left").withColumn("parent", F.when(F.col("deeper").isNotNull(), F.col("bucket")))
        named = work.saved(split.withColumn("bucket", F.coalesce(F.substring(key, F.lit(1), F.col("deeper")), "bucket")).drop("deeper"))
        asked = named.where("parent is not null")
        named = named.drop("parent")
    # counts of the first table, level by level from the top; every later table has its parents in the one before
    before = Window.partitionBy("group", "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lead = F.coalesce(F.sum("n").over(before), F.lit(0))
    groups = work.saved(tables[0].groupBy("group").agg(F.sum("n").alias("group_rows")))
    above = groups.select("group", F.substring(F.lit(low), F.lit(1), F.lit(same)).alias("parent"), F.lit(0).cast("long").alias("base"))
    finest = []
    for n in range(levels):
        at = tables[0].groupBy("group", parents[n].alias("parent"), (parents[n + 1] if n + 1 < levels else F.col("bucket")).alias("bucket")).agg(F.sum("n").alias("n"))
        above = _based(at.withColumn("lead", lead), above)
    finest.append(above)
    for counts in tables[1:]:
        above = _based(counts.select("group", "parent", "bucket", "n").withColumn("lead", lead), above)
        finest.append(above)
    bases = finest[0].select("group", F.col("parent").alias("bucket"), "base")
    for one in finest[1:]:
        bases = bases.union(one.select("group", F.col("parent").alias("bucket"), "base"))
    # a key that ends where its bucket's digits do has the bucket's name as its own, and its base
    bases = work.saved(bases.distinct().join(groups, "group"))
    place = F.row_number().over(Window.partitionBy("group", "bucket").orderBy("key")) - 1
    return Ranked(matched(named, bases, ["group", "bucket"], broadcast_rows).withColumn("rank", F.col("base") + place).drop("bucket", "base", "key"), groups)


def _based(counts: DataFrame, above: DataFrame) -> DataFrame:
    """Buckets with what stands before them in their group; ``parent`` is then the bucket itself, for the next level."""
    return counts.join(above, ["group", "parent"]).select("group", F.col("bucket").alias("parent"), (F.col("base") + F.col("lead")).alias("base"))


def levels_of(leaves: Column, whole: Column, fanout: int, height: int) -> Column:
    """The nodes of a subtree, height by height; a tree that is ``whole`` ends with one node, others have all heights."""
    runs = lambda last: F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / fanout).cast("int")), lambda r: digest(F.array_join(F.slice(last, r * fanout + 1, F.lit(fanout)), "")))
    step = lambda done, _: F.when(whole & (F.size(F.element_at(done, -1)) == 1), done).otherwise(F.concat(done, F.array(runs(F.element_at(done, -1)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.array(leaves), step)


def path_of(levels: Column, place: Column, fanout: int) -> Column:
    """What stands left and right of a leaf's path in its run, at each height."""

    def beside(nodes: Column, h: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fanout)), h)).cast("int")
        first = at - at % fanout
        joined = lambda start, count: F.array_join(F.slice(nodes, start + 1, count), "")
        return F.struct(joined(first, at - first).alias("before"), joined(at + 1, first + fanout - 1 - at).alias("after"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


class Trie:
    """The tries of all groups: ``nodes`` has (group, rank, group_rows, node) and columns to carry, put in ``carried``."""

    def __init__(self, nodes: DataFrame, work: Workspace, carried: Sequence[str], fanout: int, height: int, broadcast_rows: int = 8192):
        self.work, self.fanout, self.height, self.most = work, fanout, height, broadcast_rows
        self.width, self.stages, carry = fanout**height, [], list(carried)
        while True:
            held = F.array_sort(F.collect_list(F.struct("rank", "node", *carry)))
            reduced = nodes.groupBy("group", F.expr(f"rank div {self.width}").alias("prefix"), "group_rows").agg(held.alias("held"))
            levels = levels_of(F.col("held")["node"], F.col("group_rows") <= self.width, fanout, height)
            stage = work.saved(reduced.select("group", "prefix", "group_rows", "held", F.element_at(F.element_at(levels, -1), 1).alias("top")))
            self.stages.append(stage)
            nodes = stage.select("group", F.col("prefix").alias("rank"), F.expr(f"(group_rows + {self.width - 1}) div {self.width}").alias("group_rows"), F.col("top").alias("node"))
            carry = []
            if stage.where("prefix > 0").isEmpty():
                break

    def roots(self) -> DataFrame:
        """(group, root)."""
        return self.stages[-1].select("group", F.col("top").alias("root"))

    def paths(self, above: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The carried columns and ``columns`` of every leaf with its ``path``, the group's own path in ``above`` last."""
        above = above.withColumn("prefix", F.lit(0).cast("long"))
        for n in range(len(self.stages) - 1, -1, -1):
            stage = self.stages[n].drop("top")
            met = matched(stage, above, ["group", "prefix"], self.most)
            levels = levels_of(F.col("held")["node"], F.col("group_rows") <= self.width, self.fanout, self.height)
            # bound to a variable, so the levels are made once a subtree and not once a leaf
            each = F.flatten(F.transform(F.array(levels), lambda made: F.transform("held", lambda x, i: F.struct(x.alias("leaf"), path_of(made, i, self.fanout).alias("own")))))
            flat = met.select("group", "path", *columns, F.explode(each).alias("one"))
            full = F.concat("one.own", "path")
            if n:
                above = self.work.saved(flat.select("group", F.col("one.leaf.rank").alias("prefix"), full.alias("path"), *columns))
            else:
                return flat.select("one.leaf.*", full.alias("path"), *columns)


def manifest(
    rows: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
    tampered: dict[str, Column] | None = None, fanout: int = 2, height: int = 10, bucket: int = 4096,
) -> DataFrame:
    """(id, leaf, path, subroot, root, forged): the manifest of all rows; ``forged`` is the leaf with the fields that ``tampered`` replaces.

    ``path`` has what to put before and after a node's digest at each height, so
    ``folded(leaf, path)`` is the root.
    """
    if fanout < 2 or height < 1:
        raise ValueError("a tree needs a fanout of two and a height of one at least")
    work = Workspace(rows.sparkSession)
    leaf = lambda put: digest(F.concat(*(field(put.get(c, F.col(c))) for c in fields)))
    group = F.coalesce(F.concat(F.lit("1"), F.hex(F.col(group_col).cast("string"))), F.lit("0"))
    leaves = work.saved(rows.select(F.col(id_col).cast("long").alias("id"), group.alias("group"), leaf({}).alias("node"), leaf(tampered or {}).alias("forged"), F.monotonically_increasing_id().alias("number")))
    key = F.concat(hexadecimal(F.col("id")), "node", F.lpad(F.hex("number"), 16, "0"))
    forged = F.when(F.col("forged") != F.col("node"), F.col("forged")).alias("forged")  # most are the leaf itself
    ranked = ranks(leaves.select("group", "id", "node", forged, key.alias("key")), work, bucket)
    trie = Trie(ranked.rows, work, ["id", "forged"], fanout, height)
    roots = trie.roots()
    top_ranked = ranks(roots.select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("group").alias("of"), F.col("root").alias("node")), work, bucket)
    top = Trie(top_ranked.rows, work, ["of"], fanout, height)
    whole = top.roots().select("group", F.array().cast(PATH).alias("path"), "root")
    groups = top.paths(whole, ["root"]).select(F.col("of").alias("group"), F.col("node").alias("subroot"), "path", "root")
    found = trie.paths(work.saved(groups), ["subroot", "root"])
    return found.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "path", "subroot", "root", F.coalesce("forged", "node").alias("forged"))


def proof(path: Column) -> Column:
    """The hash of all digests beside a path, from the leaf up."""
    return digest(F.aggregate(path, F.lit(""), lambda text, s: F.concat(text, s["before"], s["after"])))
