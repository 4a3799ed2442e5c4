"""Consolidating pairwise links into groups: one identifier for everything linked directly or through others.

Vertices get dense numbers in the order of their names, so the least number of a group is its least name and
all the iterating is done on numbers. Most links of a large match graph lie in one giant component:
it is peeled first, by breadth-first frontier joins from the vertex with the most links, and joined away. What remains
is labelled by minimum propagation: every vertex takes the least of its neighbours, by an order that is drawn anew each
round, and the graph is replaced by its image, in which linked vertices are still linked and the others still are
not. A fixed order would walk a long chain one step a round; with a new one the image is smaller by a constant factor, so all rounds
together cost little more than the first. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.scratch import Scratch

ROUNDS = 200
#: frontier rounds of the peeling; a component deeper than that is contracted as far as it was reached
PEEL = 8


def _numbered(names: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, id): ids in the order of the names. Sorted by ranges, counted by partition, so nothing is gathered."""
    ranged = names.repartitionByRange("name").sortWithinPartitions("name")
    return scratch.put(ranged.select("name", F.monotonically_increasing_id().alias("id")))


def _peel(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id): what the vertex with the most links reaches within the rounds."""
    top = edges.groupBy("src").count().orderBy(F.col("count").desc(), "src").limit(1).select(F.col("src").alias("id"))  # one row
    reached = frontier = scratch.put(top)
    for _ in range(PEEL):
        step = edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = scratch.put(step.join(reached, "id", "left_anti"))
        if frontier.isEmpty():
            break
        reached = scratch.put(reached.unionByName(frontier))
    return reached


def _image(edges: DataFrame, taken: DataFrame) -> DataFrame:
    """The links between what the ends of the links have taken, loops and repeats dropped. ``taken`` is (id, label); an end that took nothing stays."""
    one = taken.select(F.col("id").alias("src"), F.col("label").alias("a"))
    two = taken.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    moved = edges.join(one, "src", "left").join(two, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    return moved.filter("src <> dst").distinct()


def _propagate(edges: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, label): one label within each component of the symmetric edges, or None without edges."""
    taken: list[DataFrame] = []
    for turn in range(ROUNDS):
        if edges.isEmpty():
            break
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("draw"), F.col(c).alias("id"))  # noqa: B023, E731
        least = edges.groupBy("src").agg(F.min(drawn("dst")).alias("least"))
        step = scratch.put(least.select(F.col("src").alias("id"), F.least("least", drawn("src"))["id"].alias("label")))
        taken.append(step)
        after = scratch.put(_image(edges, step))
        if turn:
            scratch.drop(edges)
        edges = after
    else:
        raise RuntimeError(f"links remain after {ROUNDS} rounds")
    labels = None
    for step in reversed(taken):  # from the smallest graph back to the first
        if labels is None:
            labels = step
        else:
            later = labels.select(F.col("id").alias("label"), F.col("label").alias("later"))
            labels = scratch.put(step.join(later, "label", "left").select("id", F.coalesce("later", "label").alias("label")))
    return labels


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(name, group): every name that occurs in a link, with the least name of its component.

    Links are undirected; a link with a null end is dropped, a link of a name to itself makes the name a group of its own,
    repeated links count once. Names compare by code points. An empty table gives an empty table. One number reaches the driver.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = scratch.put(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    names = _numbered(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), scratch)
    one, two = names.select(F.col("name").alias("a"), F.col("id").alias("src")), names.select(F.col("name").alias("b"), F.col("id").alias("dst"))
    numbered = pairs.join(one, "a").join(two, "b").select("src", "dst").filter("src <> dst")
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    edges = scratch.put(numbered.select(both.alias("e")).select("e.src", "e.dst"))
    if edges.isEmpty():
        return names.select("name", F.col("name").alias("group"))

    reached = _peel(edges, scratch)
    first = reached.agg(F.min("id").alias("id")).collect()[0]["id"]  # one number
    peeled = scratch.put(reached.select("id", F.lit(first).cast("bigint").alias("label")))
    # without the links inside what was reached; those that lead out of it, if the rounds did not do, now lead out of its least vertex
    rest = _propagate(scratch.put(_image(edges, peeled)), scratch)
    labels = names.select("id").join(peeled, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    if rest is not None:
        later = rest.select(F.col("id").alias("label"), F.col("label").alias("later"))
        labels = labels.join(later, "label", "left").select("id", F.coalesce("later", "label").alias("label"))
    labels = scratch.put(labels)
    heads = labels.groupBy("label").agg(F.min("id").alias("head"))
    named = heads.join(names.select(F.col("id").alias("head"), F.col("name").alias("group")), "head").select("label", "group")
    return scratch.put(labels.join(names, "id").join(named, "label").select("name", "group"))


def passages(records: DataFrame) -> DataFrame:
    """(a, b): the two passages each record links, as work_id, one space and unit.

    The unit is the ref before its first '#', outer spaces removed; a record with a null or empty unit, or a null work, on either side links nothing.
    """
    unit = lambda ref: F.trim(F.substring_index(ref, "#", 1))
    ui, uj = unit(F.col("ref_i")), unit(F.col("ref_j"))
    ok = (ui != "") & (uj != "") & F.col("work_i").isNotNull() & F.col("work_j").isNotNull()
    return records.filter(ok).select(F.concat_ws(" ", "work_i", ui).alias("a"), F.concat_ws(" ", "work_j", uj).alias("b"))


def grouped_passages(records: DataFrame, least: int = 3) -> DataFrame:
    """(work_id, unit, group_id): passages in groups of at least ``least``."""
    found = components(passages(records))
    big = found.groupBy("group").count().filter(F.col("count") >= least).select("group")
    kept = found.join(big, "group")
    return kept.select(F.substring_index("name", " ", 1).alias("work_id"), F.expr("substring(name, instr(name, ' ') + 1)").alias("unit"), F.col("group").alias("group_id"))
