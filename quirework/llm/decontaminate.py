"""Benchmark decontamination: BM25 over test items, searched block-max WAND fashion by every passage.

The inverted index holds the test items; each training passage is a query. A passage's score for an
item is BM25 over their shared terms as a share of the item's score for itself, so one threshold
serves items of any length.

Search follows WAND's rule that an item whose terms' upper bounds can't reach the threshold is never
scored: the terms with the least bounds that together stay under half the threshold don't open an
item; the others, rare ones, do, through short posting lists. What they add up to, plus the
maximum that the item's block can still get from the rest (of all terms first, then of those that the
passage holds), must reach the threshold; then the item is scored in full. All of a block of texts runs
through the first steps at once, term by term, so this is block-max WAND's bound without its cursor
that skips from document to document.

Every hit is verified: of the item's question (all but its last sentence) and of its answer (the last
sentence, or the last quarter of a single one) the share of words inside n-grams that the passage
and its surroundings also hold must reach ``overlap``.

The items' index is broadcast, in parts of at most ``most_bytes`` of item text (checked); each part
is one more pass over the documents. Document frequencies and the mean length are those of all items,
counted by Spark, so the parts don't matter to the result. Items are classed by length, and passages of a class are twice
its largest length with half as overlap, so an item lies whole in one of them.

Null and empty texts hold nothing; items without words match nothing. Rows that repeat are each
reported. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, Words, buffers, mix, spans
from .toxicity import tokens_of

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
GRAM = 5
BLOCK = 64
MOST_BYTES = 32 << 20


def lowered() -> Column:
    """Lower-cased by Spark, so that letters beyond A-Z match in either case too."""
    return F.coalesce(F.lower("text").cast("binary"), F.lit(b"")).alias("text")


@dataclass
class Item:
    item_id: int
    terms: np.ndarray  # fingerprints of its words, in order
    question: int  # how many of them are the question's


@dataclass
class Index:
    items: list[Item]
    span: int  # the most words that items of the class may have
    terms: np.ndarray  # sorted fingerprints
    at: np.ndarray  # of each term's postings
    item: np.ndarray
    impact: np.ndarray  # share of the item's own score
    opens: np.ndarray  # whether a term opens items
    quiet: np.ndarray  # sorted: term * blocks + block, for terms that don't open and blocks that hold them
    most: np.ndarray  # the largest impact there
    rest: np.ndarray  # for each block of items, the most that terms which don't open can add


def parse(item_id: int, text: bytes) -> Item:
    data = np.frombuffer(text, np.uint8)
    words = tokens_of(data, np.array([0, len(data)]))
    ends = [i for i in range(len(data)) if data[i] in b".?!\n" and words.count[0] and words.start[0] < i < words.start[-1]]
    n = len(words.hash)
    question = int((words.start < ends[-1]).sum()) if ends else n - n // 4
    return Item(item_id, words.hash, min(max(question, 1), n) if n else 0)


@dataclass
class Totals:
    """Statistics of all test items, whatever part of them an index holds."""

    items: int
    mean: float  # words
    terms: np.ndarray  # sorted; at least those of the part
    df: np.ndarray


def build(items: list[Item], span: int, threshold: float, totals: Totals) -> Index:
    n = len(items)
    lengths = np.array([len(i.terms) for i in items], float)
    pairs = [np.unique(i.terms, return_counts=True) for i in items]
    terms = np.unique(np.concatenate([p[0] for p in pairs]))
    term = np.concatenate([np.searchsorted(terms, p[0]) for p in pairs])
    item = np.concatenate([np.full(len(p[0]), k) for k, p in enumerate(pairs)])
    tf = np.concatenate([p[1] for p in pairs]).astype(float)
    df = totals.df[np.searchsorted(totals.terms, terms)]
    idf = np.log1p((totals.items - df + 0.5) / (df + 0.5))
    score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / totals.mean))
    impact = score / np.bincount(item, score, n)[item]
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    at = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
    bound = np.maximum.reduceat(impact, at[:-1])
    by_bound = np.argsort(bound, kind="stable")
    quiet = by_bound[np.cumsum(bound[by_bound]) < threshold / 2]
    opens = np.ones(len(terms), bool)
    opens[quiet] = False
    blocks = -(-n // BLOCK)
    shut = ~opens[term]
    place = term[shut] * blocks + item[shut] // BLOCK  # sorted, as postings are
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    most = np.maximum.reduceat(impact[shut], first) if len(place) else np.zeros(0)
    return Index(items, span, terms, at, item, impact, opens, place[first], most, np.bincount(place[first] % blocks, most, blocks))


def block_most(index: Index, seen: np.ndarray, block: int) -> float:
    """The most that an item of the block can get from those of the terms ``seen`` that don't open."""
    place = seen * len(index.rest) + block
    slot = np.minimum(np.searchsorted(index.quiet, place), max(0, len(index.quiet) - 1))
    return float(index.most[slot][index.quiet[slot] == place].sum()) if len(index.quiet) else 0.0


def index_items(rows: list[tuple[int, bytes]], threshold: float, totals: Totals | None = None) -> list[Index]:
    """An index for each class of lengths (powers of two); ``totals``: of all items, if these are a part."""
    classes: dict[int, list[Item]] = {}
    for item_id, text in rows:
        item = parse(item_id, text)
        if len(item.terms):
            classes.setdefault(max(4, int(len(item.terms) - 1).bit_length()), []).append(item)
    if totals is None and classes:
        every = [i for c in classes.values() for i in c]
        terms, df = np.unique(np.concatenate([np.unique(i.terms) for i in every]), return_counts=True)
        totals = Totals(len(every), float(np.mean([len(i.terms) for i in every])), terms, df)
    return [build(classes[c], 1 << c, threshold, totals) for c in sorted(classes)]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the next."""
    if not count.sum():
        return np.zeros(0, np.int64)
    return np.arange(count.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)


def search(index: Index, words: Words, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item, first word, words, score) of each passage and item at or above the threshold."""
    h, n = words.hash, len(words.hash)
    if not n:
        return
    slot = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = index.terms[slot] == h
    step = max(8, index.span)
    number = np.maximum(1, -(-(words.count - step) // step))  # passages of each row: words p * step on, 2 * step long
    first = np.concatenate([[0], np.cumsum(number)])
    place = np.arange(n) - words.at[words.row]
    late = np.minimum(place // step, number[words.row] - 1)
    inside = known & index.opens[slot]
    token = np.flatnonzero(inside)
    if not len(token):
        return
    # a word lies in the passage that starts in its own step and in the one before
    passage = np.concatenate([first[words.row[token]] + late[token], first[words.row[token]] + late[token] - 1])
    both = np.concatenate([token, token])
    fits = (np.concatenate([late[token], late[token] - 1]) >= 0) & (np.concatenate([np.zeros(len(token)), place[token] - (late[token] - 1) * step]) < 2 * step)
    key = np.unique(passage[fits] * len(index.terms) + slot[both[fits]])  # each term once for a passage
    passage, term = key // len(index.terms), key % len(index.terms)
    count = index.at[term + 1] - index.at[term]
    posting = _ranges(index.at[term], count)
    pair = np.repeat(passage, count) * len(index.items) + index.item[posting]
    found, where = np.unique(pair, return_inverse=True)
    opened = np.bincount(where, index.impact[posting])
    hopeful = np.flatnonzero(opened + index.rest[(found % len(index.items)) // BLOCK] >= threshold)
    if not len(hopeful):
        return
    row_of = np.repeat(np.arange(words.rows), number)
    for one, so_far in zip(found[hopeful], opened[hopeful], strict=True):
        p, k = int(one // len(index.items)), int(one % len(index.items))
        row = int(row_of[p])
        begin = int(words.at[row] + (p - first[row]) * step)
        end = int(min(begin + 2 * step, words.at[row + 1]))
        seen = np.unique(slot[begin:end][known[begin:end]])
        if so_far + block_most(index, seen, k // BLOCK) < threshold - 1e-9:
            continue
        size = index.at[seen + 1] - index.at[seen]
        all_ = _ranges(index.at[seen], size)
        score = float(index.impact[all_][index.item[all_] == k].sum())
        if score >= threshold:
            yield row, k, begin, end - begin, score


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x100000001B3) + h[j : j + len(out)])
    return out


def overlaps(item: Item, near: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and the answer's words inside n-grams that ``near`` also holds."""
    n = min(GRAM, len(item.terms))
    hit = np.isin(_grams(item.terms, n), _grams(near, n))
    held = np.zeros(len(item.terms), bool)
    for j in range(n):
        held[j : j + len(hit)] |= hit
    q = item.question
    question = float(held[:q].mean())
    return question, float(held[q:].mean()) if q < len(held) else question


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every contaminated pair."""
    spark = docs.sparkSession
    counts, n, mean = _totals(items)
    found: DataFrame | None = None
    part: list[tuple[int, bytes]] = []
    held = 0

    def look() -> None:
        nonlocal found, part, held
        own = np.unique(np.concatenate([np.zeros(0, np.uint64), *(parse(*p).terms for p in part)]))
        wanted = spark.createDataFrame(pa.table({"term": own.view(np.int64)}))
        df = np.array(sorted((r[0], r[1]) for r in counts.df.join(wanted, "term").collect()), np.int64).reshape(-1, 2)  # the part's terms
        order = np.argsort(df[:, 0].view(np.uint64)) if len(df) else np.zeros(0, np.int64)
        df = df[order]
        totals = Totals(n, mean, np.ascontiguousarray(df[:, 0]).view(np.uint64), df[:, 1])
        one = _pass(docs, index_items(part, threshold, totals), threshold, overlap)
        found = one if found is None else found.union(one)
        part, held = [], 0

    for row in items.select(F.col("item_id").cast("long"), lowered()).orderBy("item_id", "text").toLocalIterator():
        if part and held + len(row[1]) > most_bytes:
            look()
        part.append((row[0], bytes(row[1])))
        held += len(row[1])
    if part or found is None:
        look()
    counts.drop()
    return found


def _totals(items: DataFrame) -> tuple[Stage, int, float]:
    """(term, in how many items), items that have words, their mean number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (text,) in zip(batch.column(0).to_pylist(), strict=True):
                h = parse(0, text).terms
                if len(h):
                    own = np.unique(h)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.append(len(h), np.zeros(len(own) - 1, np.int64)))], names=["term", "words"])

    each = items.select(lowered()).mapInArrow(run, "term long, words long")
    counts = Stage(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("words").alias("words"), F.sum(F.when(F.col("words") > 0, 1).otherwise(0)).alias("items")), "bm25-terms")
    words, n = counts.df.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("items"), F.lit(0))).first()
    return counts, int(n), words / max(1, n)


def _pass(docs: DataFrame, indexes: list[Index], threshold: float, overlap: float) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(indexes)
    names = ["doc_id", "text_key", "item_id", "score", "question_overlap", "answer_overlap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, keys, out = batch.column(0), batch.column(1), []
            data, offsets = buffers(batch.column(2))
            for i, j in spans(offsets, 1 << 19):
                words = tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for index in held.value:
                    best: dict[tuple[int, int], tuple[float, float, float]] = {}
                    for row, k, begin, n, score in search(index, words, threshold):
                        lo, hi = words.at[row], words.at[row + 1]
                        q, a = overlaps(index.items[k], words.hash[max(lo, begin - index.span) : min(hi, begin + n + index.span)])
                        if q >= overlap and a >= overlap:
                            best[row, k] = max(best.get((row, k), (0.0, 0.0, 0.0)), (score, q, a))
                    out += [(doc[i + row].as_py(), keys[i + row].as_py(), index.items[k].item_id, *v) for (row, k), v in sorted(best.items())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.float64()] * 3, strict=True)], names=names)

    from .common import text_key

    return docs.select(F.col("doc_id").cast("long"), text_key(), lowered()).mapInArrow(run, "doc_id long, text_key long, item_id long, score double, question_overlap double, answer_overlap double")


def drop_leaks(docs: DataFrame, items: DataFrame, **options: float) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    from .common import text_key

    leaks = find(docs, items, **options).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long"), text_key())
    return row.join(leaks, row["doc_id"].eqNullSafe(leaks["_doc"]) & (row["text_key"] == leaks["_key"]), "left_anti").select("row.*")
