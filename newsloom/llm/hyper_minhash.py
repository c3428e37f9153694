"""Near-duplicates by HyperMinHash: documents whose sets of four-word shingles have a Jaccard similarity of 0.8 or more, and what these link.

The sketch of a set has REGISTERS buckets. A shingle's 64-bit hash names its bucket; the least rest of the hashes of a bucket is
compressed to its number of leading zeros and the MANTISSA bits that follow the first one, 16 bits in all (0: no shingle). Two
sets agree in a register with the probability of their similarity or more, whether few or many of their shingles are there.

Four registers are a band, one long; sets that agree in bands that aren't empty meet. Two sets at 0.8 agree in 26 of 64 bands on average, and in fewer than AGREE
with a probability of 2e-12; sets of fewer than SHORT shingles, which fill few bands, meet at one. Pairs that met are estimated from all registers: the share of registers in agreement, less those that agree by the
collisions that the compression makes (expected_collisions). The estimate's deviation is 0.025 at 0.8, so pairs below LIKELY are discarded at no risk, and the rest are
confirmed on the full sets, which are made again from the texts of the documents that need it.

Sets are compared once however many documents have them. While the sets of some bands make more than PAIRS pairs for each row, and each round takes a quarter of them or more, each set meets one leader of its bands
instead, which joins a large group of near copies without its square of pairs, and what lies in one component need not meet again. What is crowded then has passages in common
rather than being similar. Its sets meet at their rarest shingles instead, exactly: the COMMON commonest shingles come last, and two similar sets have one of the first n // 5 + 1 in common. How
common a shingle is decides how many pairs are met, never which are found. A set that has more than a fifth of its shingles alone is similar to no other of them.

Groups that are crowded still are split by what their sets differ in from the group's leader. The sets S and T differ in what either's difference from the leader has and the other's lacks, so if they are similar
and not both linked with the leader, much of these differences is common; they meet at the rarest parts of them. Near copies of one text that are just under the similarity, each changed
in places of its own, share nearly all shingles but few differences, so they no longer make the square of their number.

Cases: a null text has no words; sets without shingles are empty and linked with nothing, not with each other either; null identifiers belong to their group, whose id is the least that is not
null, and a group of null identifiers alone has the id null, of which all rows are kept; repeated rows are one set; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import bounded_batches
from newsloom.llm.near_copies import alike, bits_of, lists, set_bits, tagged
from newsloom.operators.graph import connected_components
from newsloom.session import materialize, release

#: Registers, their bits, and how many of these are mantissa; the others hold the leading zeros of the hashes' last REST bits.
REGISTERS, WIDTH, MANTISSA, BAND = 256, 16, 10, 4
BANDS, REST = REGISTERS // BAND, 32
#: Bands in which sets must agree, but for those of fewer than SHORT shingles.
AGREE, SHORT = 3, 64
#: Estimates under LIKELY are discarded. Leaders go first while there are more than PAIRS pairs for each row; lists of at most FEW identifiers are broadcast.
LIKELY, PAIRS, FEW, COMMON = 0.65, 8, 1 << 18, 1 << 16


def sketch(bits: np.ndarray) -> np.ndarray:
    """BANDS longs of four registers each, of the distinct hashes of a set."""
    h, rest = bits.view(np.uint64), np.uint64(REST)
    h = np.sort((h >> rest) * np.uint64(REGISTERS) >> rest << rest | h & np.uint64((1 << REST) - 1))
    bucket = (h >> rest).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = (h[first] & np.uint64((1 << REST) - 1)).astype(np.int64)
    high = np.frexp(least.astype(np.float64))[1].astype(np.int64) - 1  # the highest bit that is set; REST bits are exact in a double
    below = least << MANTISSA >> np.maximum(high, 0) & ((1 << MANTISSA) - 1)
    registers = np.zeros(REGISTERS, np.uint16)
    registers[bucket[first]] = (REST - high) << MANTISSA | below
    return registers.view("<i8")


def sketches(docs: DataFrame, words: int = 4, id_column: str = "doc_id") -> DataFrame:
    """(id, key, fp, n, regs) for each document: fp names its set of n shingles; key tells texts with one id apart."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [set_bits(t, words) for t in map(pa.StringScalar.as_py, b.column("text"))]
            columns = [pa.array([fp for fp, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), lists([sketch(x) for _, x in found], np.int64)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), *columns], ["id", "key", "fp", "n", "regs"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"id {kind}, key long, fp long, n long, regs array<long>")


def filled(x: Column) -> Column:
    """How many of the four 16-bit registers in a long are not 0: each one's bits are folded into its lowest."""
    for step in (8, 4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, step))
    return F.bit_count(x.bitwiseAND(F.lit(sum(1 << WIDTH * i for i in range(BAND)))))


def counted(longs: Column) -> Column:
    """Registers that are not 0, of an array of longs."""
    return F.aggregate(longs, F.lit(0), lambda n, x: n + filled(x))


def expected_collisions(n: Column, m: Column) -> Column:
    """Registers in which the sketches of disjoint sets of n and m shingles agree by chance.

    With a and b shingles to a bucket, the least hashes are about exponential, x and x + dx with a density of a b exp(-(a + b) x), and
    a register is about ln 2 x / 2^MANTISSA wide there, which gives the integral over a bucket's range.
    """
    a, b = n / F.lit(float(REGISTERS)), m / F.lit(float(REGISTERS))
    s = a + b
    return F.lit(REGISTERS * float(np.log(2)) / (1 << MANTISSA)) * a * b * (1 - (1 + s) * F.exp(-s)) / (s * s)


def estimate(left: str, right: str) -> Column:
    """The Jaccard similarity by two sketches: agreeing registers less expected collisions, over those that either fills."""
    a, b = F.col(f"{left}.regs"), F.col(f"{right}.regs")
    either = counted(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    differ = counted(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))
    # Only shingles that the sets don't share collide: the differing registers' share of what would collide if all did not.
    chance = expected_collisions(F.col(f"{left}.n"), F.col(f"{right}.n")) * differ / either
    return (either - differ - chance) / either


def likely(left: str, right: str) -> Column:
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    return alike(n, m, F.abs(n - m)) & (estimate(left, right) >= LIKELY)


def rarest(sets: DataFrame, known: np.ndarray, often: np.ndarray) -> DataFrame:
    """sets (fp, own, bits) with n and first instead of bits: the n // 5 + 1 that are first in the order of their counts; known (sorted) are often, and others 0."""
    known, often = (known, often) if len(known) else (np.zeros(1, np.int64), np.zeros(1, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = []
            for bits in (x.values.to_numpy() for x in b.column("bits")):
                at = np.minimum(np.searchsorted(known, bits), len(known) - 1)
                first.append(bits[np.argsort(np.where(known[at] == bits, often[at], 0), kind="stable")[: len(bits) // 5 + 1]])
            n = pc.cast(pc.list_value_length(b.column("bits")), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("fp"), b.column("own"), n, lists(first, np.int64)], ["fp", "own", "n", "first"])

    return sets.select("fp", "own", "bits").mapInArrow(run, "fp long, own long, n long, first array<long>")


class Search:
    """rows (g, w, fp, rest, x): the sets of a group meet, which counts as w bands. sets: what is known of each set, and its component.

    Two sets of a group are similar only if 18 * (what they have in common) is x of one and x of the other or more: 8 n of a set of n shingles, and
    9 d - n where it is its d differences from a leader that meet. They meet at the first that they have in common, from which on rest may be in common.
    """

    def __init__(self, prints: DataFrame, docs: DataFrame, words: int, id_column: str):
        self.docs, self.words, self.id_column = docs, words, id_column
        row = F.min(F.struct(F.isnull("id").alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "key")).alias("row")
        sets = prints.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("regs").alias("regs"), row)
        self.sets = materialize(sets.withColumn("component", F.col("fp")), "sets")
        # A set of three shingles or fewer is similar to no other; nor do sets meet in a band that is empty in both.
        bands = F.filter(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.get("regs", i) != 0)
        rows = self.sets.where("n > 3").select("fp", "n", "regs", F.explode(bands).alias("band"))
        self.rows = self.shared(rows.select(F.xxhash64("band", F.get("regs", F.col("band"))).alias("g"), F.lit(1).alias("w"), "fp", F.col("n").alias("rest"), (F.col("n") * 8).alias("x")))

    def shared(self, rows: DataFrame) -> DataFrame:
        """rows of which a group's sets lie in several components."""
        found = materialize(rows.distinct(), "bands")
        several = found.join(self.sets.select("fp", "component"), "fp").groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        several = materialize(several.where("low <> high").select("g"), "several")
        out = materialize(found.join(several, "g").select("g", "w", "fp", "rest", "x"), "rows")
        release(found, several)
        return out

    def crowds(self) -> DataFrame:
        """(g, n, pairs): a group's sets, and its pairs of different components."""
        n = F.col("k").cast("double")
        each = self.rows.join(self.sets.select("fp", "component"), "fp").groupBy("g", "component").agg(F.count("*").alias("k"))
        each = each.groupBy("g").agg(F.sum("k").alias("n"), F.sum(n).alias("all"), F.sum(n * n).alias("inside"))
        return each.select("g", "n", ((F.col("all") * F.col("all") - F.col("inside")) / 2).alias("pairs"))

    def texts(self, fps: DataFrame) -> tuple[DataFrame, int]:
        """(fp, text) of one document of each of some sets, and how many these are; rows repeated with its id and text come too."""
        wanted = materialize(self.sets.join(fps, "fp", "left_semi").select("fp", "row.*"), "wanted")
        n = wanted.count()
        texts = self.docs.select(F.isnull(self.id_column).alias("none"), F.coalesce(F.col(self.id_column), F.lit(0)).alias("id"), F.xxhash64("text").alias("key"), "text")
        return texts.join(F.broadcast(wanted) if n <= FEW else wanted, ["none", "id", "key"]).select("fp", "text"), n

    def bits(self, fps: DataFrame) -> DataFrame:
        """(fp, bits) of some sets."""
        texts, n = self.texts(fps)
        found = materialize(bits_of(texts, self.words), "bits")
        if found.count() > n:
            found, again = materialize(found.dropDuplicates(["fp"]), "bits"), found
            release(again)
        return found

    def confirm(self, pairs: DataFrame) -> None:
        """Join the components of those of pairs (left, right) that are similar."""
        ends = pairs.join(tagged(self.sets.select("fp", "n", "regs", "component"), "l"), F.col("left") == F.col("l_fp"))
        ends = ends.join(tagged(self.sets.select("fp", "n", "regs", "component"), "r"), F.col("right") == F.col("r_fp"))
        pairs = materialize(ends.where((F.col("l.component") != F.col("r.component")) & likely("l", "r")).select("left", "right"), "met")
        both, bits = self.both(pairs)
        a, b = F.size("b_left"), F.size("b_right")
        found = materialize(both.where(alike(a, b, a + b - F.size(F.array_intersect("b_left", "b_right")) * 2)).select("left", "right"), "similar")
        release(pairs, bits)
        self.link(found)
        release(found)

    def both(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(left, right, b_left, b_right) of pairs (left, right), and the table of the sets that these are made of."""
        bits = self.bits(pairs.select(F.explode(F.array("left", "right")).alias("fp")).distinct())
        few = F.broadcast if pairs.count() <= FEW else lambda df: df  # noqa: E731  # a short list spares the sets a shuffle
        found = bits.select(F.col("fp").alias("right"), F.col("bits").alias("b_right")).join(few(pairs), "right")
        lefts = bits.join(few(pairs.select(F.col("left").alias("fp")).distinct()), "fp", "left_semi")
        return found.join(lefts.select(F.col("fp").alias("left"), F.col("bits").alias("b_left")), "left"), bits

    def link(self, found: DataFrame) -> None:
        """Join the components of similar pairs (left, right)."""
        if not found.isEmpty():
            of = self.sets.select("fp", "component")
            links = found.join(of.withColumnsRenamed({"fp": "left", "component": "a"}), "left").join(of.withColumnsRenamed({"fp": "right", "component": "b"}), "right")
            labels = connected_components(links.select(F.col("a").alias("left"), F.col("b").alias("right")))  # of components, not of all sets
            old = self.sets
            sets = old.join(labels.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left")
            self.sets = materialize(sets.withColumn("component", F.coalesce("joined", "component")).drop("joined"), "sets")
            release(old, labels)

    def leaders(self, rows: DataFrame, turn: int = 0) -> DataFrame:
        """(g, rank, top, m): each group's leader, and its x there."""
        most = F.shiftleft(F.least(F.count("*"), F.lit(127)), 56).bitwiseOR(F.col("fp").bitwiseAND(F.lit((1 << 56) - 1)))  # one leader for all groups that tie
        ranks = materialize(rows.groupBy("fp").agg((F.xxhash64(F.col("fp"), F.lit(turn)) if turn else most).alias("rank")), "ranks")
        lead = rows.join(ranks, "fp").groupBy("g").agg(F.max(F.struct("rank", F.col("fp").alias("top"), F.col("x").alias("m"))).alias("top"))
        lead = materialize(lead.select("g", "top.*"), "leaders")
        release(ranks)
        return lead

    def lead(self, turn: int) -> None:
        """Compare each set with one leader of its groups; the set that is in most groups leads first, then any."""
        lead = self.leaders(self.rows, turn)
        met = self.rows.join(lead, "g").where((F.col("fp") != F.col("top")) & alike(F.col("x"), F.col("m"), F.abs(F.col("x") - F.col("m"))))  # x is 8 n here
        self.confirm(met.groupBy(F.col("fp").alias("right")).agg(F.max_by("top", "rank").alias("left")).select("left", "right"))
        old = self.rows
        self.rows = self.shared(old)
        release(old, lead)

    def refine(self) -> None:
        """The sets of crowded groups meet at their rarest shingles."""
        crowded = materialize(self.crowds().where(F.col("pairs") > PAIRS * F.col("n")).select("g"), "crowded")
        bits = self.bits(self.rows.join(crowded, "g").select("fp").distinct())
        each = bits.select("fp", F.explode("bits").alias("b")).groupBy("b").agg(F.count("*").alias("k"), F.min("fp").alias("fp"))
        each = materialize(each.select(F.when(F.col("k") == 1, F.col("fp")).alias("alone"), F.when(F.col("k") > 1, F.col("b")).alias("b"), "k"), "counts")
        own = each.where("k = 1").groupBy(F.col("alone").alias("fp")).agg(F.count("*").alias("own"))
        common = sorted((r["b"], r["k"]) for r in each.where("k > 1").orderBy(F.desc("k"), "b").limit(COMMON).collect())
        able = bits.join(own, "fp", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(F.col("own") * 5 <= F.size("bits"))
        first = rarest(able, np.array([b for b, _ in common], np.int64), np.array([k for _, k in common], np.int64))
        old = self.rows
        first = first.select("fp", "own", "n", F.posexplode("first").alias("at", "g"))
        first = first.select("g", F.lit(AGREE).alias("w"), "fp", (F.col("n") - F.greatest("at", "own")).alias("rest"), (F.col("n") * 8).alias("x"))
        self.rows = self.shared(old.join(crowded, "g", "left_anti").unionByName(first))
        release(old, crowded, bits, each)

    def split(self) -> bool:
        """The sets of groups that are crowded still are compared with the groups' leaders and meet at their rarest differences from these; whether that left fewer pairs by a quarter or more, and is kept."""
        crowded = materialize(self.crowds().where(F.col("pairs") > PAIRS * F.col("n")), "crowded")
        before = crowded.agg(F.sum("pairs")).first()[0]
        if not before:
            release(crowded)
            return False
        members = materialize(self.rows.join(crowded.select("g"), "g"), "members")
        lead = self.leaders(members)
        pairs = materialize(members.join(lead, "g").where("fp <> top").select(F.col("top").alias("left"), F.col("fp").alias("right")).distinct(), "met")
        both, bits = self.both(pairs)
        d = F.concat(F.array_except("b_left", "b_right"), F.array_except("b_right", "b_left"))
        differ = both.select("left", "right", F.size("b_left").cast("long").alias("m"), F.size("b_right").cast("long").alias("n"), d.alias("d"))
        differ = materialize(differ.withColumn("x", F.size("d") * 9 - F.col("n")).drop("n"), "differ")  # similar to the leader: x <= m
        self.link(differ.where("x <= m").select("left", "right"))
        # The partner of a set that is similar to the leader is not, or they are linked.
        low = differ.groupBy("left").agg(F.min("x").alias("least"), F.min(F.when(F.col("x") > F.col("m"), F.col("x"))).alias("far"))
        low = materialize(low, "low")
        of = F.when(F.col("x") > F.col("m"), F.col("least")).otherwise(F.col("far")).alias("low")
        each = differ.join(low, "left").select("left", F.col("right").alias("fp"), "x", F.size("d").alias("all"), of, F.explode("d").alias("d"))
        each = materialize(each.where("low is not null").select(F.xxhash64("left", "d").alias("g"), "left", "fp", "x", "all", "low"), "each")
        counts = materialize(each.groupBy("g").agg(F.count("*").alias("k")), "counts")
        at = F.row_number().over(Window.partitionBy("left", "fp").orderBy("k", "g")) - 1
        met = each.join(counts, "g").select("g", "k", "fp", "x", "low", (F.col("all") - at).cast("long").alias("rest"))
        met = met.where("k > 1 and 18 * rest >= x + low").select("g", F.lit(AGREE).alias("w"), "fp", "rest", "x")
        found = self.shared(met)
        old, self.rows = self.rows, found
        kept = 4 * self.pairs() <= 3 * before
        if kept:
            self.rows = materialize(old.join(crowded.select("g"), "g", "left_anti").unionByName(found), "rows")
        else:
            self.rows, old = old, None
        release(old, found, crowded, members, lead, pairs, bits, differ, low, each, counts)
        return kept

    def pairs(self) -> int:
        return int(self.crowds().agg(F.sum("pairs")).first()[0] or 0)

    def run(self) -> None:
        left, turn = self.pairs(), 0
        while left > PAIRS * self.rows.count():
            self.lead(turn)
            left, before, turn = self.pairs(), left, turn + 1
            if 4 * left > 3 * before:
                self.refine()
                break
        while self.split() and self.pairs() > PAIRS * self.rows.count():
            pass
        known = materialize(self.rows.join(self.sets.select("fp", "component"), "fp"), "known")
        bands = F.when(F.least("a.x", "b.x") < 8 * SHORT, AGREE).otherwise(F.col("a.w"))  # x is 8 n in bands
        met = meeting(known, bands).groupBy("left", "right").agg(F.sum("bands").alias("bands"))
        self.confirm(met.where(F.col("bands") >= AGREE).select("left", "right"))
        release(known, self.rows)


def meeting(rows: DataFrame, bands: Column) -> DataFrame:
    """(left, right, bands): pairs of rows of a group, in different components, that may have as much in common as the similarity needs."""
    a, b = rows.alias("a"), rows.alias("b")
    met = (F.col("a.g") == F.col("b.g")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.component") != F.col("b.component")) & (F.least("a.rest", "b.rest") * 18 >= F.col("a.x") + F.col("b.x"))
    return a.join(b, met).select(F.col("a.fp").alias("left"), F.col("b.fp").alias("right"), bands.alias("bands"))


def near_duplicates(docs: DataFrame, words: int = 4, id_column: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id, kept): the size of each document's set, the least id that is reachable, and whether that is its own."""
    prints = materialize(sketches(docs, words, id_column), "sketches")
    search = Search(prints, docs, words, id_column)
    search.run()
    classes = prints.where("n > 0").groupBy("fp").agg(F.min("id").alias("first")).join(search.sets.select("fp", "component"), "fp")
    classes = materialize(classes, "classes")
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    of = materialize(classes.join(least, "component").select("fp", "component_id"), "of")  # plain tables: Spark can split a hot set's partition
    thin = prints.select("id", "fp", "n")
    found = thin.where("n > 0").join(of, "fp").select("id", "n", "component_id").unionAll(thin.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    release(classes, search.sets)
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
