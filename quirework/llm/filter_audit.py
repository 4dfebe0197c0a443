"""Filter interaction audit: a subset-zeta transform over the failure masks of each part.

Every document gets a mask with one bit for each filter it fails. Documents are counted by part and
mask, in all, with label quality 1 and with label toxic 1, so all that follows works on 2^k counts a
part. The zeta transform adds up, filter by filter, what each subset of filters lets through; a step of
an order is then the difference between two neighbouring subsets, and the Shapley sum of a filter is the
sum of these over all orders.

The last filter finds texts that a smaller doc_id holds too. Equal texts are found by SHA-256 in one
exchange of narrow rows by document, then by counts of text, part and mask, so a text that a third of
all rows hold is a few rows by the time texts meet.

Null texts are empty, a null lang is the part ''. Equal rows each count; of rows that share the least
doc_id of their text none fails the last filter. A row without doc_id is no copy and makes none, and
has no labels. A document is good, or toxic, if any label row of its id says so. An empty table has no
parts and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def text_filters() -> dict[str, Column]:
    """Letter -> whether ``text`` fails; the duplicate filter comes after these."""
    text = F.col("text")
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """part, mask (of ``filters``, in their order), and long pass_*, copy_* for each of COUNTS: rows that
    pass and that fail the duplicate filter."""
    bits = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(filters.values())), F.lit(0))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = given.select("doc_id", "part", bits.alias("mask"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_sha"))
    said = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(x) == 1).cast("int")).alias(y) for x, y in (("quality", "good"), ("toxic", "toxic"))))
    kind = ["text_sha", "part", "mask", "good", "toxic"]
    both = rows.join(said, "doc_id", "left").fillna(0, ["good", "toxic"])
    # rows of one id first: the least id of a text may be held by several rows
    by_id = both.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    kinds = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(named).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    of_text = Window.partitionBy("text_sha")
    stay = F.col("unnamed") + F.when(F.col("first.doc_id") == F.min("first.doc_id").over(of_text), F.col("first.n")).otherwise(0)
    sides = kinds.withColumn("stay", stay).withColumn("copy", F.col("n") - F.col("stay"))
    weight = {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    return sides.groupBy("part", "mask").agg(*(F.sum(F.col(side) * weight[c]).alias(f"{name}_{c}") for side, name in (("stay", "pass"), ("copy", "copy")) for c in COUNTS))


def survivors(counts: DataFrame, k: int) -> DataFrame:
    """part and, for each of COUNTS, an array: at i how many rows fail no filter outside the set i."""
    half = 1 << (k - 1)

    def at(side: str, c: str, m: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(f"{side}_{c}"))), F.lit(0))

    found = counts.groupBy("part").agg(*(F.array(*(at(side, c, m) for side in ("pass", "copy") for m in range(half))).alias(c) for c in COUNTS))

    def with_bit(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) != 0, F.get(F.col(c), i.bitwiseXOR(F.lit(bit)))).otherwise(0))

    for j in range(k):  # one pass of the zeta transform for each filter
        found = found.withColumns({c: with_bit(c, 1 << j) for c in COUNTS})
    return found


def order_steps(found: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of ``letters`` and step."""
    orders = ["".join(p) for p in permutations(letters)]
    full = (1 << len(letters)) - 1
    steps = found.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    earlier = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    bit_of = lambda text: sum((F.when(F.contains(text, F.lit(x)), 1 << j).otherwise(0) for j, x in enumerate(letters)), F.lit(0))
    steps = steps.withColumns({"letter": letter, "bit": bit_of(letter), "before": bit_of(earlier)})
    after = F.col("before").bitwiseOR(F.col("bit"))
    left = lambda c, applied: F.get(F.col(c), F.lit(full).bitwiseXOR(applied))
    lost = lambda c: left(c, F.col("before")) - left(c, after)
    failing = left("n", F.lit(0)) - left("n", F.col("bit"))
    alone = left("n", F.lit(full).bitwiseXOR(F.col("bit"))) - left("n", F.lit(full))
    out = steps.select("part", "filter_order", "step", "letter", left("n", after).alias("kept"), lost("n").alias("removed"), (failing - lost("n")).alias("redundant"), alone.alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, duplicates: str = "E") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters``: letter -> failure condition over ``text``; ``duplicates``: the letter of the filter of
    copies. With k filters in all a part has k! * k rows."""
    filters = text_filters() if filters is None else filters
    letters = "".join(filters) + duplicates
    return order_steps(survivors(mask_counts(docs, labels, filters), len(letters)), letters)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (coalesce(w.doc_id > first, false))::INT AS mask,
    coalesce(good, 0) AS good, coalesce(said.toxic, 0) AS toxic FROM w LEFT JOIN said ON w.doc_id = said.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, bit,
    sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed, sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
    sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM x
"""
