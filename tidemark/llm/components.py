"""Connected components of a graph in a DataFrame, by alternating large and small stars.

Every round joins each node's neighbours to the smallest node it knows of; a few rounds leave stars around the smallest
node of each component. Each round is written to the shared folder. Only whether it is done reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import scratch

#: Ids are broadcast up to this many rows (of 16 bytes), beyond that what they select is shuffled to them.
SENT = 1_000_000
#: Of each kind, so many others of a mixed bucket are compared with each of its nodes; so many next sketches make one of its orders.
DRAWS, PATH = 3, 3
#: Buckets up to so many nodes are compared in full without the rounds that make the pairs of larger ones few.
SMALL = 64
#: Nodes of a bucket whose comparison is completed are dealt to parts of about so many; two parts are one group of a join.
PART = 256
#: Nodes and words of a part where links are found inside groups (dealt()): a task holds two parts and their nodes' counts of common runs.
HELD, VOLUME = 2048, 500_000


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.coalesce(F.bool_or((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0)), F.lit(False))).first()[0]


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the smallest node of its component."""
    one, two = F.col(a), F.col(b)
    now = edges.filter(one != two).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v"))
    now = scratch.table(now.dropDuplicates(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.table(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).dropDuplicates(), "edges")
        scratch.drop(now)
        now = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).dropDuplicates())


def _ids(pairs: DataFrame) -> DataFrame:
    """(x): the nodes of the pairs, once each; broadcast where a count shows that they are few."""
    ids = scratch.table(pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).dropDuplicates(), "ids")
    return sent(ids)


def sent(table: DataFrame) -> DataFrame:
    """A written table of a few narrow columns, broadcast up to SENT rows, else shuffled by whatever joins it."""
    return F.broadcast(table) if table.count() <= SENT else table


def linked(nodes: DataFrame, contents, near, may, draws: int = DRAWS, facts: DataFrame | None = None, within=None) -> DataFrame:
    """(node, root) of the components that all near pairs of all buckets make; nodes without a near one are absent.

    nodes: (node, size, sketches), each node once; nodes of equal sketch share a bucket. contents(ids) gives node and what near()
    needs of each node x of ids; near(pairs of a and b, contents) gives the pairs that are near; may(size, size) must hold for
    near pairs. Where facts (node, size) is given, its size, of any type, is what may() gets; it is joined to nodes of shared
    buckets only, so that buckets are made without it, and nodes needs no size. Of the pairs, contents() is asked for each round's.

    All nodes of a bucket are compared with its smallest node, and near ones joined. In buckets whose nodes are then in several
    components, each node is compared with 2 * draws more, if they aren't in its component: `draws` nodes of the bucket drawn by
    hash, and those before it in `draws` orders, each an order of the bucket's nodes by some of their next sketches, which brings
    nodes together that share more sketches. In buckets that are in several components even so, and in those of up to SMALL nodes
    without these draws, all pairs of nodes of different components are compared at last (between()), so that no link is lost;
    the rounds before only make these pairs few. No pair is compared twice.

    Where within(members, contents) is given, it finds the links between the components of each bucket by itself, without a row
    for each pair; it gets (group, i, j, k, node, root) of dealt() and contents with sketches, and takes the place of the rounds after the first.
    """
    bucket = Window.partitionBy("sketch")
    carried = ["size"] if facts is None else []
    member = nodes.select(F.explode("sketches").alias("sketch"), "node", *carried)
    member = member.withColumn("lead", F.min(F.struct("node", *carried)).over(bucket)).withColumn("n", F.count("*").over(bucket))
    member = scratch.table(member.filter("n > 1").select("sketch", "node", *carried, "lead", "n"), "buckets")
    star = member.filter(F.col("node") != F.col("lead.node"))
    if facts is None:
        star = star.filter(may(F.col("size"), F.col("lead.size")))
    star = star.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).dropDuplicates()
    if facts is not None:
        ids = sent(scratch.table(member.select(F.col("node").alias("x")).dropDuplicates(), "ids"))
        known = scratch.table(facts.join(ids, F.col("node") == F.col("x"), "left_semi").select("node", "size"), "facts")
        one, two = (known.select(F.col("node").alias(x), F.col("size").alias(f"of_{x}")) for x in "ab")
        star = star.join(one, "a").join(two, "b").filter(may(F.col("of_a"), F.col("of_b"))).select("a", "b")
    star = scratch.table(star, "pairs")

    def links_of(pairs: DataFrame) -> DataFrame:
        texts = contents(_ids(pairs))
        found = scratch.table(near(pairs, texts), "links")
        scratch.drop(texts)
        return found

    roots = scratch.table(connected(links_of(star)), "roots")

    root = F.coalesce("root", "node")
    mixed = member.select("sketch", "node", *carried, "n").join(roots, "node", "left").withColumn("root", root)
    mixed = mixed.withColumn("several", F.min("root").over(bucket) != F.max("root").over(bucket)).filter("several").drop("several")
    if facts is not None:
        mixed = mixed.join(known, "node")
    mixed = scratch.table(mixed.select("sketch", "node", "size", "root", "n"), "mixed")
    scratch.drop(member)
    rejoined = lambda links, roots: scratch.table(connected(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
    if within:
        scratch.drop(star)
        mixed, dealt_out = mixed.drop("n"), mixed
        ids = sent(scratch.table(mixed.select(F.col("node").alias("x")).dropDuplicates(), "ids"))
        texts = contents(ids)
        signed = nodes.join(ids, F.col("node") == F.col("x"), "left_semi").select("node", "sketches")
        more = scratch.table(within(dealt(mixed), texts.join(signed, "node")), "links")
        scratch.drop(dealt_out)
        scratch.drop(texts)
        return roots if more.isEmpty() else rejoined(more, roots)

    tested = star
    large = mixed.filter(F.col("n") > SMALL).drop("n")
    if not large.isEmpty():
        ids = sent(scratch.table(large.select(F.col("node").alias("x")).dropDuplicates(), "ids"))
        j = F.array_position("sketches", F.col("sketch")).cast("int")
        following = F.slice(F.concat("sketches", "sketches"), j + 1, F.least(F.lit(PATH * draws), F.size("sketches")))
        paths = nodes.join(ids, F.col("node") == F.col("x"), "left_semi").select(F.col("node").alias("x"), "sketches")
        placed = large.join(paths, F.col("node") == F.col("x")).select("sketch", "node", "size", "root", following.alias("path"))
        mine, others = F.struct("node", "size", "root"), {}
        for turn in range(draws):
            others[f"drawn{turn}"] = F.min(F.struct(F.xxhash64("node", "sketch", F.lit(turn)).alias("by"), mine.alias("it"))).over(bucket)["it"]
            others[f"before{turn}"] = F.lag(mine).over(bucket.orderBy(F.slice("path", PATH * turn + 1, PATH), "node"))
        places = scratch.table(placed.select("node", "size", "root", *[c.alias(n) for n, c in others.items()]), "places")
        apart = lambda o: (F.col("root") != F.col(f"{o}.root")) & may(F.col("size"), F.col(f"{o}.size"))
        pairs = [places.filter(apart(o)).select(F.least("node", f"{o}.node").alias("a"), F.greatest("node", f"{o}.node").alias("b")) for o in others]
        pairs = scratch.table(reduce(DataFrame.unionByName, pairs).dropDuplicates().join(tested, ["a", "b"], "left_anti"), "pairs")
        scratch.drop(places)
        more = links_of(pairs)
        tested = tested.unionByName(pairs)
        if not more.isEmpty():
            roots = rejoined(more, roots)

    last = mixed.select("sketch", "node", "size").join(roots, "node", "left").withColumn("root", root)
    pairs = scratch.table(between(last, may).join(tested, ["a", "b"], "left_anti"), "pairs")
    scratch.drop(mixed)
    if pairs.isEmpty():
        return roots
    more = links_of(pairs)
    scratch.drop(pairs)
    return roots if more.isEmpty() else rejoined(more, roots)


def dealt(members: DataFrame, part: int = HELD, volume: int = VOLUME) -> DataFrame:
    """(group, i, j, k, node, root): buckets of several components in groups in which any two nodes of a bucket meet once.

    members: (sketch, node, size, root). Buckets of the same nodes are one. A bucket's nodes are dealt to parts of about `part` nodes
    and `volume` words; k is a node's part, and parts i and j meet in group (i, j).
    """
    bucket = Window.partitionBy("sketch")
    same = F.struct(F.count("*").over(bucket).alias("n"), *[F.bit_xor(F.xxhash64("node", F.lit(t))).over(bucket).alias(f"h{t}") for t in (1, 2)])
    parts = F.ceil(F.greatest(F.count("*").over(bucket) / part, F.sum("size").over(bucket) / volume)).cast("int")
    rows = members.select(same.alias("group"), "node", "root", parts.alias("parts")).dropDuplicates(["group", "node"])
    rows = rows.withColumn("k", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("group", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "node", "root")


def between(members: DataFrame, may, part: int = PART) -> DataFrame:
    """(a, b): all pairs of nodes that share a sketch, are of different roots and may be near, once each. members: (sketch, node, size, root).

    A bucket's nodes are dealt to parts, and a node meets each part of its bucket in a group of its own: no task has a whole bucket's pairs.
    """
    bucket = Window.partitionBy("sketch")
    mixed = members.withColumn("several", F.min("root").over(bucket) != F.max("root").over(bucket)).withColumn("n", F.count("*").over(bucket)).filter("several")
    parts = F.ceil(F.col("n") / part).cast("int")
    dealt = mixed.withColumn("parts", parts).withColumn("k", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    one = dealt.select("sketch", F.col("k").alias("i"), F.explode(F.sequence("k", F.col("parts") - 1)).alias("j"), F.struct("node", "size", "root").alias("x"))
    two = dealt.select("sketch", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"), F.struct("node", "size", "root").alias("y"))
    met = one.join(two, ["sketch", "i", "j"]).filter((F.col("i") < F.col("j")) | (F.col("x.node") < F.col("y.node")))
    met = met.filter((F.col("x.root") != F.col("y.root")) & may(F.col("x.size"), F.col("y.size")))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).dropDuplicates()
