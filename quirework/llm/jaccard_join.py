"""N-gram Jaccard join: grouped prefix join over distinct word shingles.

Two sets with Jaccard similarity of t or more share one of their first n - ceil(t n) + 1 shingles
under any common order. The order here puts shingles that many documents hold last (from a sketch of
fixed size; a wrong estimate costs time, not results), then goes by hash.

1. Documents with equal sets are one node; nodes with equal prefixes and sizes are one group, whose
   least node is its head.
2. Group pairs: groups meet at shared prefix shingles. Within a shingle and size class every head is
   first compared with one pivot only, so a family of m copies costs m pairs, not m squared. Every
   member is verified against its head.
3. Where that leaves nodes of a shingle with more than ``CROWD`` heads in different components,
   ``ROUNDS`` more rounds compare each node outside the component that has most nodes at the shingle with
   up to PIVOTS others that share a shingle beside it too, drawn anew for each shingle and round, until
   families have joined.
4. Members: nodes of one group, or at one shingle, that are in different components even then are
   expanded into pairs. One side holds only nodes outside the component that has most nodes at the
   shingle, so what joined before is not compared with itself, and a pair is made at its first common
   shingle: not where one of the ``EARLIER`` shingles before it is shared too, nor where too few are left
   behind it. Pairs that pass the size and bitmap filters are verified on whole sets.

Pairs inside one component are not expanded, since they can't change it. Verification counts the
intersection of whole sets: documents link when 100 * intersection >= ``percent`` * union.

Words are runs of bytes outside white space, A-Z lower-cased. Fewer words than ``size`` give the
whole sequence as one shingle. Null texts and texts without words have no shingles, link with
nothing and are their own component. Rows with equal doc_id are separate documents that share their
number; a null doc_id joins components but can't name one (a component of such rows alone has a null
id). Shingles and sets are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, Words, buffers, in_bits, key_batch, mix, random_words, release_shuffles, repeated_bits, spans, text_key
from .components import components
from .repeats import keyed, same_row

SIZE = 5
PERCENT = 80
PARITY = 8  # 64-bit words of the least whole parity bitmap, and of the folded ones
NARROW = 2  # words of those that travel with every open place of the last round
CROWD = 8
ROUNDS = 2
PIVOTS = 4
EARLIER = 8
BESIDE = 4
COUNTERS = 1 << 22
KEPT_COUNTERS = 1 << 16
FOLDED = [f"p{k}" for k in range(PARITY)]
_SHIFT = np.uint64(64 - 22)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    words = Words(data, offsets, lower=True)
    factors = random_words(size + 1, 31) | np.uint64(1)
    h, n = words.hash, len(words.hash)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        full += h[j : j + len(full)] * factors[j]
    full = mix(full)
    for i, m in enumerate(words.count):
        at = words.at[i]
        if m >= size:
            yield np.unique(full[at : at + m - size + 1])
        elif m:
            yield mix((h[at : at + m] * factors[:m]).sum(keepdims=True) + factors[size:] * np.uint64(m))
        else:
            yield np.zeros(0, np.uint64)


def _each(batch: pa.RecordBatch, column: int, size: int) -> Iterator[np.ndarray]:
    data, offsets = buffers(batch.column(column))
    for i, j in spans(offsets, 1 << 18):
        yield from shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)


def common_shingles(docs: DataFrame, size: int, least: int = 8) -> np.ndarray:
    """A level for each of COUNTERS hash ranges: 0, or the log2 of how often documents hold it.

    Only ranges seen ``least`` times in one batch are counted, and the KEPT_COUNTERS largest kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_each(batch, 0, size))
            if not sets:
                continue
            at, n = np.unique((np.concatenate(sets) >> _SHIFT).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at[n >= least]), pa.array(n[n >= least])], names=["at", "n"])

    counted = keyed(docs).select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    levels = np.zeros(COUNTERS, np.uint8)
    for at, n in counted.orderBy(F.desc("n"), "at").limit(KEPT_COUNTERS).collect():
        levels[at] = max(1, int(n).bit_length())
    return levels


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def parity(own: np.ndarray, words: int = PARITY) -> np.ndarray:
    """A bitmap in which each member of the set flips one bit.

    Half as many words give the halves' exclusive or, so bitmaps of different sizes stay comparable."""
    at = (mix(own + np.uint64(77)) % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(at, minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parity_words(n: int) -> int:
    """Two bits a member, a power of two of words: 0.25 to 0.5 bytes a word of text."""
    return max(PARITY, 1 << (-(-2 * n // 64) - 1).bit_length())


def differing(a: str, b: str) -> Column:
    """How many bits of two parity arrays differ, once the longer is folded to the shorter's size."""

    def folded(x: str, y: str) -> Column:
        size = F.least(F.size(x), F.size(y))
        half = F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > size, half).otherwise(F.col(x))

    each = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def profiles(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """doc_id, text_key, n (set size), sig (of the set), gid (of prefix and size), p0 to p7 (parity folded to
    PARITY words), bits (parity), prefix."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = held.value
        for batch in batches:
            ns, sigs, gids, wholes, prefixes = [], [], [], [], []
            for own in _each(batch, 2, size):
                n = len(own)
                level = lv[(own >> _SHIFT).astype(np.int64)]
                ordered = own[np.lexsort((own, level))] if level.any() else own
                head = ordered[: prefix_length(n, percent)] if n else own
                ns.append(n)
                sigs.append(int(mix(mix(own).sum(keepdims=True) + np.uint64(n)).view(np.int64)[0]))
                gids.append(int(mix(mix(head).sum(keepdims=True) * np.uint64(3) + np.uint64(n)).view(np.int64)[0]))
                wholes.append(parity(own, parity_words(n)))
                prefixes.append(head)
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
            arrays = [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), pa.array(gids, pa.int64())]
            folded = [np.bitwise_xor.reduce(w.reshape(-1, PARITY), axis=0) for w in wholes]
            arrays += [pa.array([w[k] for w in folded], pa.int64()) for k in range(PARITY)]
            arrays += [pa.array(wholes, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n", "sig", "gid", *FOLDED, "bits", "prefix"])

    words = ", ".join(f"{c} long" for c in FOLDED)
    return keyed(docs).mapInArrow(run, f"doc_id long, text_key long, n long, sig long, gid long, {words}, bits array<long>, prefix array<long>")


def prefix_shingles(nodes: DataFrame, bits: np.ndarray | None) -> DataFrame:
    """Without ``bits`` the prefix shingles as ``key``; with them gid, n, at, shingle of those held."""
    held = nodes.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, sizes = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
            if held.value is None:
                yield key_batch(flat)
                continue
            pick = np.flatnonzero(in_bits(held.value, flat))
            row = np.repeat(np.arange(len(sizes)), sizes)[pick]
            at = pick - (np.cumsum(sizes) - sizes)[row]
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(2)), pa.array(at, pa.int32()), pa.array(flat[pick].view(np.int64))], names=["gid", "n", "at", "shingle"])

    given = nodes.select("gid", "n", "prefix")
    return given.mapInArrow(run, "key long" if bits is None else "gid long, n long, at int, shingle long")


def whole_sets(texts: DataFrame, size: int) -> DataFrame:
    """``texts``: sig, text. The set of each as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = list(_each(part, 1, size))
                at = np.concatenate([[0], np.cumsum([len(p) for p in sets])]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["sig", "members"])

    return texts.mapInArrow(run, "sig long, members array<long>")


def hopeful(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and whole bitmaps still allow.

    Each member of the symmetric difference flips one bit, so it has at least as many as bits differ."""
    a = nodes.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    b = nodes.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    total = F.col("na") + F.col("nb")
    both = pairs.join(b, "b").join(a, "a").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.filter((total - differing("ba", "bb")) * (100 + percent) >= total * 2 * percent).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    a = sets.select(F.col("sig").alias("a"), F.col("members").alias("sa"))
    b = sets.select(F.col("sig").alias("b"), F.col("members").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("common") * 100 >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def links_of(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, size: int, percent: int) -> Stage:
    """Pairs verified on the whole sets of the few texts that ``hopeful`` leaves."""
    left = Stage(hopeful(pairs, nodes, percent), "jaccard-hopeful")
    release_shuffles(docs.sparkSession)
    wanted = left.df.select(F.col("a").alias("sig")).union(left.df.select("b")).distinct()
    reps = nodes.select("sig", "doc_id", "text_key").join(wanted, "sig").hint("shuffle_hash")
    given = keyed(docs)
    sets = Stage(whole_sets(given.join(reps, same_row(given, reps)).select("sig", "text"), size), "jaccard-sets")
    release_shuffles(docs.sparkSession)
    links = Stage(verified(left.df, sets.df, percent).distinct(), "jaccard-links")
    left.drop()
    sets.drop()
    return links


def step_of(n: str, percent: int) -> Column:
    """Size class: sizes of similar sets are at most one class apart."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")


def narrowed(words: int) -> list[Column]:
    """The folded bitmap, folded on to ``words`` words."""
    return [reduce(lambda a, b: a.bitwiseXOR(b), (F.col(c) for c in FOLDED[k::words])).alias(f"p{k}") for k in range(words)]


def close(percent: int, words: int) -> Column:
    """Whether sizes and folded bitmaps of ``words`` words let x and y be similar enough. A bitmap tells texts
    apart that have up to about twice as many shingles as it has bits."""
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in FOLDED[:words]))
    both = F.col("x.n") + F.col("y.n")
    return (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & ((both - differ) * (100 + percent) >= both * 2 * percent)


def _places(percent: int) -> tuple[Column, Column, Column]:
    """How many shingles x and y must share, and how many they can, before the one at hand and from it on."""
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / F.lit(100 + percent))
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    return need, F.least("x.at", "y.at"), left


def first_common(percent: int) -> Column:
    """False where the shingle can't be the first that x and y share, as one shortly before it is shared
    too, or where, if it is the first, what follows can't hold enough others."""
    need, _, left = _places(percent)
    return ~F.arrays_overlap("x.earlier", "y.earlier") & (left >= need)


def placed_alike(percent: int) -> Column:
    """False where x and y hold the shingle so far apart in the common order that they can't share enough."""
    need, before, left = _places(percent)
    return before + left >= need


def merged(roots: DataFrame, links: DataFrame) -> Stage:
    """Components after ``links`` between nodes that have ``roots``: links are lifted to roots first."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = components(lifted, "jaccard")
    moved = roots.join(above.df.withColumnRenamed("root", "top"), roots["root"] == above.df["node"], "left").select(roots["node"], F.coalesce("top", "root").alias("root"))
    fresh = above.df.join(roots, "node", "left_anti").select("node", "root")
    out = Stage(moved.union(fresh), "jaccard-roots")
    above.drop()
    return out


def unsettled(shared: DataFrame, nodes: DataFrame, roots: DataFrame, crowd: int) -> tuple[Stage, Stage]:
    """(all nodes with their root, the rows of members at shingles that hold several roots and more than
    ``crowd`` heads). Among these rows of the same member, ``beside`` (with a crowd) holds the BESIDE shingles
    before and behind it, ``earlier`` (without one) the EARLIER before it; what two members in different
    components share is among the rows of both."""
    member = nodes.select("gid", "sig", "n", *FOLDED).join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    member = Stage(member, "jaccard-members")
    # the roots that each group holds, which is one in nearly all cases, decide which shingles stay open
    of_group = member.df.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    placed = shared.filter(F.col("heads") > crowd).select("gid", "at", "shingle")
    opened = placed.select("gid", "shingle").join(of_group, "gid").groupBy("shingle").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo != hi").select("shingle")
    rows = placed.join(opened, "shingle", "left_semi").join(member.df, "gid")
    rows = rows.select("shingle", "sig", "root", "n", "at", *(FOLDED if crowd else narrowed(NARROW)))
    places = Window.partitionBy("sig").orderBy("at")
    if crowd:
        around = F.collect_list("shingle").over(places.rowsBetween(-BESIDE, BESIDE))
        rows = rows.withColumn("beside", F.array_remove(around, F.col("shingle")))
    else:
        rows = rows.withColumn("earlier", F.collect_list("shingle").over(places.rowsBetween(-EARLIER, -1)))
    return member, Stage(rows, "jaccard-open")


def with_main(held: DataFrame, key: str) -> DataFrame:
    """``held`` with ``main``, the component that has most rows at the key, where there are several."""
    most = held.groupBy(key, "root").agg(F.count("*").alias("m")).groupBy(key).agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    return held.join(most.select(key, "main"), key)


def drawn(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of open members outside their shingle's main component with pivots of other components:
    for each shingle and size class the member of least hash in each of PIVOTS parts, drawn anew for each
    shingle and ``turn``. A pair that shares the shingle alone and nothing beside it shares it by chance and is
    left to ``remaining``."""
    draw = F.xxhash64("sig", "shingle", F.lit(turn))
    part = F.pmod(F.xxhash64("sig", F.lit(turn)), F.lit(PIVOTS))
    rows = rows.withColumn("step", step_of("n", percent))
    pivots = rows.groupBy("shingle", "step", part.alias("part")).agg(F.min_by(F.struct("sig", "root", "n", "at", "beside", *FOLDED), draw).alias("p")).select("shingle", "step", "p.*")
    alike = (F.size("x.beside") == 0) | (F.size("y.beside") == 0) | F.arrays_overlap("x.beside", "y.beside")
    met = with_main(rows, "shingle").filter("root != main").alias("x").join(pivots.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.root") != F.col("y.root")) & placed_alike(percent) & alike & close(percent, PARITY))
    return met.select(F.greatest("x.sig", "y.sig").alias("a"), F.least("x.sig", "y.sig").alias("b")).distinct()


def remaining(rows: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) across components that the filters allow: at shared shingles and inside groups."""

    def across(held: DataFrame, key: str, words: int, more: Column) -> DataFrame:
        sided = with_main(held, key)
        apart = (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.sig") > F.col("y.sig")))
        met = sided.filter("root != main").alias("x").join(sided.alias("y"), apart & more & close(percent, words))
        return met.select(F.greatest("x.sig", "y.sig").alias("a"), F.least("x.sig", "y.sig").alias("b"))

    # members of one group share the whole prefix, which other groups needn't hold, so they meet at the group
    return across(rows, "shingle", NARROW, first_common(percent)).union(across(member, "gid", PARITY, F.lit(True))).distinct()


def rooted(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, root (names a component that has shingles) for every row."""
    spark = docs.sparkSession
    profiled = Stage(profiles(docs, common_shingles(docs, size), size, percent), "jaccard-profiles")
    nodes = Stage(profiled.df.filter("n > 0").dropDuplicates(["sig"]), "jaccard-nodes")
    found = Stage(profiled.df.select("doc_id", "text_key", "n", "sig"), "jaccard-documents")
    profiled.drop()
    release_shuffles(spark)
    heads = nodes.df.groupBy("gid").agg(F.min("sig").alias("head"), F.count("*").alias("in_group"))
    grouped = nodes.df.join(heads, "gid")

    # group pairs: shared prefix shingles of heads; the bitmap keeps out shingles that one head has alone
    bits = repeated_bits(prefix_shingles(nodes.df, None))
    release_shuffles(spark)
    every = prefix_shingles(grouped.filter("sig = head"), bits)
    again = every.groupBy("shingle").agg(F.count("*").alias("heads")).filter("heads > 1")
    shared = Stage(every.join(again, "shingle"), "jaccard-shared")
    release_shuffles(spark)
    sized = shared.df.select("shingle", "gid", step_of("n", percent).alias("step"))
    pivots = sized.groupBy("shingle", "step").agg(F.min("gid").alias("pivot"), F.count("*").alias("m")).filter("m > 1").drop("m")
    met = sized.join(pivots, ["shingle", "step"]).filter("gid != pivot").select("gid", "pivot").distinct()
    stars = met.join(heads.select("gid", F.col("head").alias("a")), "gid").join(heads.select(F.col("gid").alias("pivot"), F.col("head").alias("b")), "pivot").select("a", "b")
    inside = grouped.filter("sig != head").select(F.col("sig").alias("a"), F.col("head").alias("b"))
    first = Stage(stars.union(inside), "jaccard-pairs")
    links = links_of(docs, first.df, nodes.df, size, percent)
    roots = components(links.df, "jaccard")
    first.drop()
    links.drop()

    for turn in range(ROUNDS + 1):
        member, rows = unsettled(shared.df, nodes.df, roots.df, CROWD if turn < ROUNDS else 0)
        release_shuffles(spark)
        pairs = drawn(rows.df, turn, percent) if turn < ROUNDS else remaining(rows.df, member.df, percent)
        links = links_of(docs, pairs, nodes.df, size, percent)
        if not links.df.isEmpty():
            then = merged(roots.df, links.df)
            roots.drop()
            roots = then
        for stage in (member, rows, links):
            stage.drop()
    for stage in (shared, nodes):
        stage.drop()
    release_shuffles(spark)

    named = found.df.join(roots.df.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "root", "left")
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), own.alias("component_id"), "root")


def linked(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for every row."""
    return rooted(docs, size, percent).drop("root")


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each component, its least doc_id (null ids come
    last; least text fingerprint on a tie; of rows equal in both the one of least fingerprint over all
    columns). Rows without shingles are nobody's copies and all stay."""
    found = rooted(docs, **options)
    copies = found.filter("n_shingles > 0").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "n")).alias("one")
    one = copies.groupBy("root").agg(first).select("one.doc_id", "one.text_key", (F.col("one.n") > 1).alias("again"))
    bare = found.filter("n_shingles = 0").select("doc_id", "text_key", F.lit(False).alias("again")).distinct()
    stay = Stage(one.union(bare), "jaccard-stay").df.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "again")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"), text_key())

    def held(again: bool) -> DataFrame:
        wanted = stay.filter(F.col("again") == again)
        return row.join(wanted, row["doc_id"].eqNullSafe(wanted["_doc"]) & (row["text_key"] == wanted["_key"]), "left_semi")

    # only rows that repeat in doc_id and text are grouped
    equal = held(True).groupBy("doc_id", "text_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return held(False).select("row.*").union(equal.select("row.*"))
