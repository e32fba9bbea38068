"""Near-duplicates by a chosen-path set similarity join over word shingles.

Documents are branched into the nodes of independent trees by selected minwise tokens: those that agree on the token a
node selects go on together. Few documents share even one token with others, so most leave after the first level. The
documents of a small node are compared exhaustively. Those of a larger one are compared by what they add to the node's
most central text, and those that have too little of it for that are branched on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.llm.common import Scratch, mix, text_pieces, windows, words

#: Words of a shingle; a link needs PERCENT of the union in common.
WORDS, PERCENT = 5, 75
#: Minwise functions: two per tree for the first two levels, further ones for deeper levels; all give a sketch bit.
TREES, SELECTABLE, FUNCTIONS = 20, 80, 512
#: A node of at most so many documents is compared exhaustively.
SMALL = 128
#: Per cent of a set that lie in the hub: from NEAR on it is compared by its difference from the hub, below FAR it is
#: branched on. If one of two linked sets has FAR or more the other has at least 3/7, so a link has both sides in either.
NEAR, FAR = 40, 60
#: Sketch bits that may differ. At the threshold 64 of 512 do on average, 98 is 4.5 standard deviations more.
MAX_DIFFERENT = 98
BITS = ("b1", "b2", "b3", "b4", "b5", "b6", "b7", "b8")

_RNG = np.random.RandomState(77)
_A = (_RNG.randint(0, 2**31, FUNCTIONS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _RNG.randint(0, 2**32, FUNCTIONS, dtype=np.int64).astype(np.uint32)


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of the distinct shingles of texts, in this order; short texts are one shingle."""
    text, _, _, hashes = words(data, at, lower=True)
    n = np.bincount(text, minlength=len(at) - 1)
    size = n[text] if len(text) else n[:0]
    first = np.cumsum(n) - n
    owners, found = [], []
    for k in range(1, WORDS + 1):
        wins = windows(hashes, k)
        if k == WORDS:
            good = np.flatnonzero((text[:len(wins)] == text[k - 1:]) & (size[:len(wins)] >= k)) if len(wins) else np.zeros(0, int)
        else:
            good = first[n == k]
        owners.append(text[good])
        found.append(wins[good] + np.uint64(k % WORDS))
    owner, value = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _prints(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which tell sets apart."""
    return tuple(np.add.reduceat(mix(value ^ np.uint64(salt)), starts).view(np.int64) for salt in (0x5851F42D, 0xDA3E39CB94B95BDB))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, p1, p2 (fingerprint of the set), b1 to b8 (bit sketch) and sig (minwise tokens) per document."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for _, data, at in text_pieces(b.column(1)):
                n = len(at) - 1
                owner, value = shingle_sets(data, at)
                count = np.bincount(owner, minlength=n)
                full, starts = np.flatnonzero(count), (np.cumsum(count) - count)[count > 0]
                least = np.zeros((n, FUNCTIONS), np.uint32)
                prints = np.zeros((2, n), np.int64)
                if len(full):
                    short = (value >> np.uint64(32)).astype(np.uint32)
                    for i in range(FUNCTIONS):
                        least[full, i] = np.minimum.reduceat(short * _A[i] + _B[i], starts)
                    prints[:, full] = _prints(value, starts)
                bits = np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31) == 1, axis=1).view(np.int64)
                sig = np.ascontiguousarray(least[:, :SELECTABLE]).tobytes()
                step = 4 * SELECTABLE
                parts.append((count, prints[0], prints[1], *bits.T, [sig[i:i + step] for i in range(0, len(sig), step)]))
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3 + len(BITS))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols], pa.array([s for p in parts for s in p[-1]], pa.binary())],
                ["doc_id", "n_shingles", "p1", "p2", *BITS, "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        sketch, f"doc_id {kind}, n_shingles long, p1 long, p2 long, {', '.join(f'{b} long' for b in BITS)}, sig binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """p1, p2 and the whole set of shingle hashes per document with a word."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, at in text_pieces(b.column(0)):
                owner, value = shingle_sets(data, at)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                if len(starts):
                    p1, p2 = _prints(value, starts)
                    offsets = pa.array(np.append(starts, len(value)), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p1), pa.array(p2), pa.ListArray.from_arrays(offsets, pa.array(value.view(np.int64)))], ["p1", "p2", "shingles"])

    return docs.select(F.col("text").cast("string")).mapInArrow(sets, "p1 long, p2 long, shingles array<long>")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """cls, comp: the least class of each connected component, for every class in ``links`` but that one itself.

    Alternates two steps until nothing changes: every node sends its larger neighbours to its least one, then its
    smaller neighbours. Nodes of many neighbours are summed up as minima, never gathered.
    """
    edges, last = links.select(F.col("a").alias("u"), F.col("b").alias("v")), None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
        large = both.join(least, both["u"] == least["w"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        kept, seen = scratch.keep_seen(
            small.select("e.u", "e.v").where("u <> v").distinct(), "stars", sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if id(edges) in scratch.kept:
            scratch.drop(edges)
        edges = kept
        state = (seen["n"], seen["sum"])
        if state == last:
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("comp"))
        last = state


def _one() -> Column:
    """What is compared of a class without its set."""
    return F.struct("cls", "n", "common", *BITS, "comp")


def _different(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in BITS), F.lit(0))


def _may_link(a: str, b: str) -> Column:
    """What sizes, sketches and the numbers of shingles that others have too allow."""
    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    sizes = F.least(col(a, "n"), col(b, "n")) * 100 >= F.greatest(col(a, "n"), col(b, "n")) * PERCENT
    # the union of two sets is at least their sizes less what they can have in common
    shared = F.least(col(a, "common"), col(b, "common")) * (100 + PERCENT) >= (col(a, "n") + col(b, "n")) * PERCENT
    return sizes & shared & (_different(a, b) <= MAX_DIFFERENT) & (col(a, "comp") != col(b, "comp"))


class Join:
    """One run: the classes of equal sets, the links confirmed so far and the sets read so far."""

    def __init__(self, docs: DataFrame):
        self.docs, self.scratch = docs, Scratch(docs.sparkSession, "chosen-path")
        self.rows = self.scratch.keep(sketches(docs), "rows")
        distinct = self.rows.where("n_shingles > 0").groupBy("p1", "p2", F.col("n_shingles").alias("n")).agg(
            F.min("doc_id").alias("doc"), *[F.any_value(c).alias(c) for c in (*BITS, "sig")])
        self.classes = self.scratch.keep(distinct.withColumn("cls", F.monotonically_increasing_id()), "classes")
        self.links: list[DataFrame] = []
        self.fresh = False
        self.checked: DataFrame | None = None
        self.sets: DataFrame | None = None
        self.comps: DataFrame | None = None
        self.grouped: DataFrame | None = None

    def known(self, members: DataFrame) -> DataFrame:
        """Adds the component known so far."""
        if self.comps is None:
            return members.withColumn("comp", F.col("cls"))
        return members.join(self.comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def read_sets(self, need: DataFrame, many: bool = False) -> None:
        """Sets of the classes in ``need`` not read yet: from the text of one document of each class.

        ``many``: as many as grow with the documents, so they are met by a shuffle and never broadcast.
        """
        need = need.select("cls").distinct()
        if self.sets is not None:
            need = need.join(self.sets.select("cls"), "cls", "left_anti")
        need, seen = self.scratch.keep_seen(need.join(self.classes, "cls").select("cls", "doc", "p1", "p2"), "need")
        if not seen["n"]:
            return
        wanted = need.select("doc").distinct()
        texts = self.docs.select("doc_id", "text").join(
            wanted.hint("merge") if many else wanted, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
        read = full_sets(texts).join(need, ["p1", "p2"]).groupBy("cls").agg(F.any_value("shingles").alias("shingles")).withColumn(
            "half", F.transform("shingles", lambda h: F.shiftright(h, 32).cast("int"))).withColumn(
            "lost", F.size("shingles") - F.size(F.array_distinct("half")))
        read = self.scratch.keep(read, "sets")
        self.sets = read if self.sets is None else self.sets.union(read)

    def confirm(self, pairs: DataFrame) -> None:
        """Check pairs of classes on their full sets and keep the links."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs, seen = self.scratch.keep_seen(pairs, "pairs")
        if not seen["n"]:
            return
        self.checked = pairs if self.checked is None else self.checked.union(pairs)
        self.read_sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")))

        def joined(rows: DataFrame, column: str, slack: Column) -> DataFrame:
            left, right = (self.sets.select(
                F.col("cls").alias(k), F.col(column).alias(f"s{k}"), F.size("shingles").alias(f"n{k}"), F.col("lost").alias(f"l{k}")) for k in "ab")
            both = F.size(F.array_intersect("sa", "sb")) + slack
            return rows.join(left, "a").join(right, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * PERCENT).select("a", "b")

        # most pairs fall short already by the hashes cut to half their bits, which may match more often but for
        # those that coincide within one set, at most as many as either set loses; the others are confirmed on the full sets
        likely = self.scratch.keep(joined(pairs, "half", F.least("la", "lb")), "likely")
        links, seen = self.scratch.keep_seen(joined(likely, "shingles", F.lit(0)), "links")
        if seen["n"]:
            self.links.append(links)
            self.fresh = True

    def update(self) -> None:
        """Bring the known components up to the links confirmed since."""
        if self.fresh:
            self.fresh = False
            every = self.links[0]
            for more in self.links[1:]:
                every = every.union(more)
            self.comps = components(self.scratch, every)
            self.links = [self.comps.select(F.col("comp").alias("a"), F.col("cls").alias("b"))]

    def nodes(self, paths: DataFrame) -> tuple[DataFrame, dict]:
        """Rows (path, cls, common, n, BITS) of nodes with two documents or more, with the node's size.

        Only path and class are shuffled for all; most leave here, and the others then get their sketches.
        """
        slim = paths.select("path", "cls", "common")
        sizes = slim.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        return self.scratch.keep_seen(
            slim.join(sizes, "path").join(self.classes.select("cls", "n", *BITS), "cls"), "nodes", most=F.max("size"))

    def centres(self, known: DataFrame) -> DataFrame:
        """path, hub: the class whose sketch is nearest to the majority of the node's bits, the text that others are copies of."""
        bits = [F.sum(F.shiftright(b, i).bitwiseAND(1)).alias(f"{b}_{i}") for b in ("b1", "b2") for i in range(64)]
        half = F.col("of") / 2

        def majority(b: str) -> Column:
            total = F.lit(0).cast("long")
            for i in range(64):
                total = total.bitwiseOR(F.when(F.col(f"{b}_{i}") > half, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
            return total

        middle = known.groupBy("path").agg(F.count(F.lit(1)).alias("of"), *bits).select(
            "path", majority("b1").alias("m1"), majority("b2").alias("m2"))
        away = F.bit_count(F.col("b1").bitwiseXOR(F.col("m1"))) + F.bit_count(F.col("b2").bitwiseXOR(F.col("m2")))
        return known.join(middle, "path").groupBy("path").agg(F.min(F.struct(away.alias("away"), _one().alias("hub")))["hub"].alias("hub"))

    def hub_pairs(self, members: DataFrame, most: int, first: bool) -> DataFrame:
        """Each document of a node with the node's least class, and in larger nodes with its most central one too.

        Beyond the first level small nodes are left to the exhaustive comparison.
        """
        known = self.known(members if first else members.where(F.col("size") > SMALL))
        hubs = known.groupBy("path").agg(F.min(_one()).alias("hub"))
        if most > SMALL:
            hubs = hubs.union(self.centres(known.where(F.col("size") > SMALL)))
        return known.withColumn("me", _one()).join(hubs, "path").where(_may_link("me", "hub")).select(
            F.col("cls").alias("a"), F.col("hub.cls").alias("b"))

    def open_nodes(self, members: DataFrame) -> DataFrame:
        """Rows of nodes that hold documents of different components."""
        known = self.known(members)
        mixed = known.groupBy("path").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("path")
        return known.join(mixed, "path", "left_semi").drop("comp")

    def rest(self, members: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
        """(pairs to confirm, rows that branch on), leaving out nodes in one component; ``large``: some are not small."""
        known = self.scratch.keep(self.known(members), "known")
        by_comp = known.groupBy("path", "comp").agg(F.count(F.lit(1)).alias("k"))
        shape = by_comp.groupBy("path").agg(F.sum("k").alias("total"), F.max(F.struct("k", "comp")).alias("main")).where("total > main.k")
        shape = self.scratch.keep(shape.select("path", "total", F.col("main.comp").alias("main")), "shape")
        small, big = shape.where(F.col("total") <= SMALL), shape.where(F.col("total") > SMALL)
        pairs, far = self.differences(self.scratch.keep(known.join(big.select("path"), "path", "left_semi"), "large")) if large else (None, None)
        grouped = known.withColumn("hub", F.lit(None).cast("long")) if self.grouped is None else known.join(self.grouped, "cls", "left")
        one = _one().withField("hub", F.col("hub"))
        outside = grouped.join(small, "path").where(F.col("comp") != F.col("main")).select("path", one.alias("out"))
        inside = grouped.join(small.select("path"), "path").select("path", one.alias("other"))
        apart = F.col("out.hub").isNull() | F.col("other.hub").isNull() | (F.col("out.hub") != F.col("other.hub"))
        every = outside.join(inside, "path").where(apart & _may_link("out", "other")).select(F.col("out.cls").alias("a"), F.col("other.cls").alias("b"))
        return every if pairs is None else every.union(pairs), far

    def differences(self, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs of larger nodes to confirm, rows that branch on).

        Two sets have in common at most what the one with less of the hub has of it, and the extras, shingles out of the
        hub, that both hold. So two sets of different components either need common extras, and then meet on one of
        their rarest, or have enough of the hub for their sizes. Copies just too far from the hub to be linked with it
        are of the second kind only with smaller sets, and few share extras.
        """
        hubs = self.scratch.keep(self.centres(known).join(known.select("path", "size").distinct(), "path"), "centres")
        # nodes whose hubs are alike and of one component are one group
        chosen = hubs.groupBy(F.col("hub.comp").alias("main")).agg(F.max(F.struct("size", "hub"))["hub"].alias("first"))
        alike = _different("hub", "first") <= MAX_DIFFERENT
        groups = self.scratch.keep(hubs.join(chosen, F.col("hub.comp") == F.col("main")).select(
            "path", "main", F.when(alike, F.col("first.cls")).otherwise(F.col("hub.cls")).alias("hub")), "groups")
        base = self.scratch.keep(self.sets.join(groups.select(F.col("hub").alias("cls")).distinct(), "cls").select(
            F.col("cls").alias("hub"), F.col("shingles").alias("base")), "base")
        # written first, so that sets are met by a broadcast of few rows and only else by a shuffle
        rows = self.scratch.keep(known.join(groups, "path").select("hub", "main", "cls", "n", "common", *BITS, "comp").distinct(), "grouped-rows")
        apart = rows.join(self.sets.select("cls", "shingles"), "cls").join(base, "hub").withColumn("extra", F.array_except("shingles", "base"))
        apart = self.scratch.keep(apart.select("hub", "main", "cls", "n", _one().alias("me"), "extra", (F.col("n") - F.size("extra")).alias("shared")), "apart")
        far = self.scratch.keep(known.join(groups, "path").join(
            apart.where(F.col("shared") * 100 < F.col("n") * FAR).select("hub", "cls"), ["hub", "cls"], "left_semi").select("path", "cls", "common"), "far")
        near = apart.where(F.col("shared") * 100 >= F.col("n") * NEAR)
        # two classes of one group need not be compared in small nodes any more
        hub = near.groupBy("cls").agg(F.min("hub").alias("hub"))
        self.grouped = self.scratch.keep(hub if self.grouped is None else self.grouped.union(hub.join(self.grouped, "cls", "left_anti")), "grouped")
        outside = F.col("me.comp") != F.col("main")
        pair = F.col("out.cls").alias("a"), F.col("other.cls").alias("b")

        # extras that occur in one component only lead to no pair and so come first in the order
        extras = near.select("hub", "me.comp", F.explode("extra").alias("shingle"))
        held = self.scratch.keep(extras.groupBy("hub", "shingle").agg(
            F.count(F.lit(1)).alias("k"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("hub", "shingle", "k"), "held")
        # what more than half of a group hold is as good as the hub's: the hub need not be the text that they are copies of
        counted = near.groupBy("hub").agg(F.count(F.lit(1)).alias("of"), F.min("n").alias("least"))
        wide = held.join(counted, "hub").where("k * 2 > of").groupBy("hub").agg(F.collect_list("shingle").alias("wide"))
        near = near.join(counted.join(wide, "hub", "left"), "hub").withColumn(
            "extra", F.when(F.col("wide").isNull(), F.col("extra")).otherwise(F.array_except("extra", "wide")))
        near = self.scratch.keep(near.select("hub", "main", "cls", "n", "me", "extra", (F.col("n") - F.size("extra")).alias("shared"), "least"), "near")
        ordered = near.select("hub", "cls", F.explode("extra").alias("shingle")).join(held, ["hub", "shingle"]).groupBy("hub", "cls").agg(
            F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("order"))
        other = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100))
        # of extras all but one less than a link needs; of two sets that share so many, one lies among these of both
        needs = F.greatest(F.ceil((F.col("n") + other) * PERCENT / (100 + PERCENT)) - F.col("shared"), F.lit(1))
        first = F.greatest(F.size("order") - needs + 1, F.lit(0)).cast("int")
        keys = near.join(ordered, ["hub", "cls"]).select(
            "hub", "main", "me", F.explode(F.slice("order", F.lit(1), first)["shingle"]).alias("shingle"))
        keys = self.scratch.keep(keys, "keys")
        by_extra = keys.where(outside).select("hub", "shingle", F.col("me").alias("out")).join(
            keys.select("hub", "shingle", F.col("me").alias("other")), ["hub", "shingle"]).where(_may_link("out", "other")).select(*pair)

        def enough(shared: Column, n: Column, of: Column) -> Column:
            return shared * (100 + PERCENT) >= (n + of) * PERCENT

        sizes = near.select("hub", F.col("n").alias("of")).distinct()
        lone = near.where(outside).join(sizes, "hub").where(
            (F.least("n", "of") * 100 >= F.greatest("n", "of") * PERCENT) & enough(F.col("shared"), F.col("n"), F.col("of")))
        by_size = lone.select("hub", "of", F.col("me").alias("out")).join(
            near.select("hub", F.col("n").alias("of"), F.col("me").alias("other"), "shared"), ["hub", "of"]).where(
            enough(F.col("shared"), F.col("out.n"), F.col("of")) & _may_link("out", "other")).select(*pair)
        return by_extra.union(by_size), far

    def commons(self, active: DataFrame) -> DataFrame:
        """cls, found: how many shingles of a class occur in another class of ``active``.

        Two classes have no more than that in common, which rules out most documents that share a passage, or are
        copies too far from each other, without comparing pairs.
        """
        active = self.scratch.keep(active.select("cls").distinct(), "active")
        self.read_sets(active)
        single = self.sets.join(active, "cls", "left_semi").select("cls", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
            F.count(F.lit(1)).alias("k"), F.min("cls").alias("cls")).where("k = 1").groupBy("cls").agg(F.count(F.lit(1)).alias("own"))
        sizes = self.sets.join(active, "cls", "left_semi").select("cls", F.size("shingles").cast("long").alias("n"))
        return self.scratch.keep(sizes.join(single, "cls", "left").select("cls", (F.col("n") - F.coalesce("own", F.lit(0))).alias("found")), "commons")

    def narrowed(self, members: DataFrame, commons: DataFrame) -> DataFrame:
        """Rows of nodes less the documents that cannot link with any other of their node by ``commons``."""
        known = members.drop("common", "size").join(commons, "cls").withColumnRenamed("found", "common")
        least = known.groupBy("path").agg(F.min("n").alias("least"))
        other = F.greatest("least", F.ceil(F.col("n") * PERCENT / 100))
        return known.join(least, "path").where(
            F.col("common") * (100 + PERCENT) >= (F.col("n") + other) * PERCENT).drop("least")

    def branch(self, members: DataFrame) -> DataFrame:
        """The next level's paths: every node selects one token, and half of the nodes a second one.

        A pair at the threshold then keeps 1.125 paths a level on average, so that a tree may lose it only early on,
        and the independent trees make up for it.
        """
        chosen = members.join(self.classes.select("cls", "sig"), "cls")

        def child(j: int) -> Column:
            which = 2 * TREES + F.pmod(F.xxhash64("path", F.lit(j)), F.lit(SELECTABLE - 2 * TREES)).cast("int")
            return F.xxhash64("path", F.lit(j), F.substring(F.col("sig"), which * 4 + 1, F.lit(4)))

        second = F.when(F.xxhash64("path", F.lit("second")) % 2 == 0, F.array(child(0), child(1))).otherwise(F.array(child(0)))
        return chosen.select("cls", "common", F.explode(second).alias("path"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of (doc_id, text, …).

    Documents whose sets of lower-case word shingles share 75 % of their union or more are linked; component_id is the
    smallest doc_id reachable over links, kept marks the document of that id. Equal sets are one class and always
    linked, so copies are never compared. Texts without a word have no set and are linked with nothing. A null doc_id
    counts only if its whole component has no other; rows of the same doc_id keep one id, each text with its own
    links; other columns are ignored; an empty table gives no rows.

    Links are confirmed on full sets. What may be missed is a pair that no tree leads to one small node: every tree
    selects two tokens at once to begin with, so of pairs at the very threshold 1 in 10^7 is missed where the nodes are
    small then (0.4375 to the power of 20); and 3 in 10^6 of them by the sketch. More similar pairs are safer.
    """
    run = Join(docs)
    first = F.array(*[F.xxhash64(F.lit(t), F.substring(F.col("sig"), F.lit(8 * t + 1), F.lit(8))) for t in range(TREES)])
    members, seen = run.nodes(run.classes.select("cls", F.col("n").alias("common"), F.explode(first).alias("path")))
    level, pending = 1, None
    while seen["n"]:
        if level == 1 or seen["most"] > SMALL:
            hubs = run.hub_pairs(members, seen["most"], level == 1)
            if level == 1:
                hubs = run.scratch.keep(hubs, "hubs")
                run.read_sets(hubs.select(F.explode(F.array("a", "b")).alias("cls")).union(members.where(F.col("size") > SMALL).select("cls")), many=True)
            run.confirm(hubs if pending is None else hubs.union(pending))
            run.update()
            pending = None
        if level == 1:
            open_ = run.scratch.keep(run.open_nodes(members), "open")
            members, seen = run.nodes(run.narrowed(open_, run.commons(open_)))
        pairs, far = run.rest(members, bool(seen["n"]) and seen["most"] > SMALL)
        pending = pairs if pending is None else pending.union(pairs)
        if far is None:
            break
        members, seen = run.nodes(run.branch(far))
        level += 1
    if pending is not None:
        run.confirm(pending)
        run.update()
    classes = run.known(run.classes.select("cls", "p1", "p2", F.col("n").alias("n_shingles"), "doc"))
    least = classes.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = run.scratch.keep(classes.join(least, "comp").select("p1", "p2", "n_shingles", "component_id"), "named")
    out = run.rows.select("doc_id", "n_shingles", "p1", "p2").join(named, ["p1", "p2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
