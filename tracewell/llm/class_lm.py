"""Class-based n-gram language model (Brown clusters).

The probability of a text is the product, over its words and a final end, of a transition between word classes and
the emission of the word by its class. Every training word is assigned to a class by exchange clustering:

* the ``CORE`` most frequent words are exchanged in rounds: each goes to the class that makes the corpus likeliest given the
  class counts of the round before, all words at once, from sums over the table of bigrams between them (words
  outside are one class there);
* every other word, down to those seen once, then goes to the class that makes its own occurrences likeliest, given how
  often each core class follows it and comes before it. That evidence is a row for each word and batch, and a word's class
  is chosen where its rows meet; only the class-by-class counts go to all tasks.

The number of classes grows with the vocabulary (its cube root). Transitions are counted over all training texts with
every word in its class. Unknown words have a class of their own, as likely anywhere as a single word model has them.

Counts are distributed: words are counted on the executors and never gathered. Counts and classes of up to ``FREQUENT`` of
the most frequent words go to the tasks (so that common words are no hot keys); all others are looked up by a join on the
word, once for each text that has it. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch
from tracewell.llm.sums import PARTS, in_parts, summed
from tracewell.llm.words import Powers, binaries, word_pieces

CORE = 4096
FREQUENT = 1 << 18
LEAST_CLASSES = 8
ROUNDS = 8
HALF = 0.5  # of an occurrence, for the unknown word
SMOOTH = 0.1  # added to every transition count
BACKED = 0.02  # part of a transition's probability that does not look at the class before
PART_TYPES = 256
TABLE_TASKS = 12
GROUP_TOKENS = 1 << 21  # of texts that are looked up together
EVIDENCE_ROWS = 1 << 13  # rows of a partial product


def class_count(words: int) -> int:
    return max(LEAST_CLASSES, int(np.ceil(words ** (1 / 3))))


def found_at(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_hashes):
        return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == hashes


def batch_words(column: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch's rows, one after another, and each row's first."""
    counts = np.zeros(len(column), dtype=np.int64)
    hashes = [np.zeros(0, dtype=np.uint64)]
    for words, _ in word_pieces(column, powers, 0):
        hashes.append(words.hash)
        counts[words.row0 : words.row0 + words.rows] += words.lengths()
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(counts)))


def with_ends(values: np.ndarray, first: np.ndarray, end) -> np.ndarray:
    """The rows' values, and after each row's that of its end."""
    out = np.full(len(values) + len(first) - 1, end, dtype=values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = values
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        keys, counts = np.unique(batch_words(batch.column(0), powers)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "uses"])


def most_frequent(counts: DataFrame, most: int) -> pa.Table:
    """``(word, uses)`` of words as frequent as ``most`` of them allow: all from some count on, found from how many words there are
    in each of some hundred ranges of counts. Nothing is sorted and no task holds more than a range's rows."""
    step = F.floor(F.log2("uses") * 16).cast("int")
    held = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"])
    total, least = 0, None
    for r in held:
        total += r["n"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return counts.limit(0).toArrow()
    return counts.where(step >= least).toArrow()


# ---- core words: types are their places by hash, then words outside, then ends

def _count_bigrams(core):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, known = Powers(), core.value
        outside, end, types = len(known), len(known) + 1, len(known) + 2
        for batch in batches:
            hashes, first = batch_words(batch.column(0), powers)
            at, there = found_at(known, hashes)
            kind = with_ends(np.where(there, at, outside), first, end)
            before = np.concatenate(([end], kind[:-1]))  # a text begins after an end
            keys, counts = np.unique(before * types + kind, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["bigram", "uses"])

    return count


def _by_class(assigned, classes: int):
    """Of each type, how often each class follows it and comes before it."""

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of = assigned.value
        types = len(class_of)
        total = np.zeros(2 * types * classes)
        for batch in batches:
            bigram, uses = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left, right = bigram // types, bigram % types
            total += np.bincount(left * classes + class_of[right], uses, minlength=len(total))
            total += np.bincount((types + right) * classes + class_of[left], uses, minlength=len(total))
        yield in_parts(total.reshape(2 * types, classes), PART_TYPES)

    return by_class


def class_counts(bigrams: DataFrame, class_of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    assigned = bigrams.sparkSession.sparkContext.broadcast(class_of)
    # the table has (CORE + 2)**2 rows at most; each task sends an array, so few tasks read it
    few = bigrams.select("bigram", "uses").coalesce(TABLE_TASKS)
    total = summed(few.mapInArrow(_by_class(assigned, classes), PARTS), (2 * len(class_of), classes))
    return total[: len(class_of)], total[len(class_of) :]


def class_gains(after: np.ndarray, class_of: np.ndarray, classes: int) -> np.ndarray:
    """What one occurrence of a word gains in each class: by the class that follows (the first rows) and by that before (the
    others), without its emission, which is the last row."""
    pairs = np.zeros((classes + 2, classes + 2))
    np.add.at(pairs, class_of, after)
    follow = np.log(pairs + SMOOTH) - np.log(pairs.sum(axis=1, keepdims=True) + SMOOTH * (classes + 2))  # [class, next]
    emission = -np.log(pairs.sum(axis=0)[:classes] + HALF)
    return np.concatenate([follow[:classes].T, follow[:, :classes], emission[None]])


def exchanged(after: np.ndarray, before: np.ndarray, class_of: np.ndarray, classes: int) -> np.ndarray:
    """Each core word in the class that suits it best by the class counts so far."""
    gains, words = class_gains(after, class_of, classes), len(class_of) - 2
    n = classes + 2
    gain = after[:words] @ gains[:n] + before[:words] @ gains[n : 2 * n] + before[:words].sum(axis=1)[:, None] * gains[-1]
    moved = class_of.copy()
    moved[:words] = gain.argmax(axis=1)
    return moved


def cluster_core(texts: DataFrame, core: np.ndarray, uses: np.ndarray, classes: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """The core words' classes, and ``class_gains`` by them. Words outside are class ``classes``, ends the next."""
    held = texts.sparkSession.sparkContext.broadcast(core)
    bigrams = scratch.keep(texts.select("text").mapInArrow(
        _count_bigrams(held), "bigram long, uses long").groupBy("bigram").agg(F.sum("uses").alias("uses")), "bigrams")
    class_of = np.concatenate([np.zeros(len(core), np.int64), [classes, classes + 1]])
    class_of[np.lexsort((core, -uses))] = np.arange(len(core)) % classes  # by frequency rank
    for _ in range(ROUNDS):
        moved = exchanged(*class_counts(bigrams, class_of, classes + 2), class_of, classes)
        settled = (moved == class_of).all()
        class_of = moved
        if settled:
            break
    gains = class_gains(class_counts(bigrams, class_of, classes + 2)[0], class_of, classes)
    scratch.drop(bigrams)
    return class_of[:-2], gains


# ---- every other word

def _evidence(core, classes: int):
    """Of each word outside the core, a row a batch: the classes after and before its occurrences."""

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, (known, class_of) = Powers(), core.value
        for batch in batches:
            hashes, first = batch_words(batch.column(0), powers)
            at, there = found_at(known, hashes)
            kind = np.where(there, class_of[at], classes) if len(known) else np.full(len(hashes), classes)
            kind = with_ends(kind, first, classes + 1)
            place = np.arange(len(hashes)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
            place = place[~there]
            before = np.where(place > 0, kind[place - 1], classes + 1)
            word = np.concatenate([hashes[~there]] * 2)
            code = np.concatenate([kind[place + 1], classes + 2 + before]).astype(np.uint16)
            order = np.argsort(word, kind="stable")
            word, code = word[order], code[order]
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[begin].view(np.int64)), binaries(code, np.append(begin, len(word)))], ["word", "codes"])

    return evidence


def _choose(gains):
    """Words come sorted; each one's rows are added up and it goes to the class that gains most."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains.value.astype(np.float32)
        held_word, held_sum, held_uses = None, None, 0

        def chosen(word, total, uses):
            best = (total + uses[:, None].astype(np.float32) * table[-1]).argmax(axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array(word), pa.array(uses.astype(np.int64)), pa.array(best.astype(np.int32))], ["word", "uses", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0).to_numpy()
            codes = [np.frombuffer(c, dtype=np.uint16) for c in batch.column(1).to_pylist()]
            size = np.array([len(c) for c in codes], dtype=np.int64)
            total = np.empty((len(words), table.shape[1]), dtype=np.float32)
            edges = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), EVIDENCE_ROWS), side="right")
            edges = np.unique(np.append(edges, [0, len(words)]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                ends = np.cumsum(size[lo:hi])
                total[lo:hi] = np.add.reduceat(table[np.concatenate(codes[lo:hi])], ends - size[lo:hi], axis=0)
            begin = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            total, uses, words = np.add.reduceat(total, begin, axis=0), np.add.reduceat(size, begin) // 2, words[begin]
            if held_word == words[0]:
                total[0] += held_sum
                uses[0] += held_uses
            elif held_word is not None:
                yield chosen(np.array([held_word]), held_sum[None], np.array([held_uses]))
            held_word, held_sum, held_uses = words[-1], total[-1].copy(), uses[-1]
            if len(words) > 1:
                yield chosen(words[:-1], total[:-1], uses[:-1])
        if held_word is not None:
            yield chosen(np.array([held_word]), held_sum[None], np.array([held_uses]))

    return choose


def learn_classes(texts: DataFrame, scratch: Scratch) -> tuple[dict, DataFrame]:
    """What goes to all tasks, of bounded size, and ``(word, uses, class)`` of all words of ``texts(text)``."""
    spark = texts.sparkSession
    counts = scratch.keep(texts.select("text").mapInArrow(_count_words, "word long, uses long").groupBy("word").agg(
        F.sum("uses").alias("uses")), "counts")
    facts = counts.agg(F.count("*").alias("distinct"), F.sum("uses").alias("uses")).first()
    ends = texts.count()
    classes = class_count(facts["distinct"])
    top = most_frequent(counts, CORE)
    word, uses = top.column("word").to_numpy().view(np.uint64), top.column("uses").to_numpy()
    order = np.argsort(word)
    core, core_uses = word[order], uses[order]
    class_of, gains = cluster_core(texts, core, core_uses, classes, scratch)

    sent = spark.sparkContext.broadcast((core, class_of))
    rows = texts.select("text").mapInArrow(_evidence(sent, classes), "word long, codes binary")
    chosen = rows.repartition("word").sortWithinPartitions("word").mapInArrow(
        _choose(spark.sparkContext.broadcast(gains)), "word long, uses long, class int")
    columns = [pa.array(core.view(np.int64)), pa.array(core_uses, pa.int64()), pa.array(class_of.astype(np.int32))]
    of_core = spark.createDataFrame(pa.table(columns, names=["word", "uses", "class"]), "word long, uses long, class int")
    words = scratch.keep(chosen.unionByName(of_core), "words")

    frequent = most_frequent(words.select("word", "uses"), FREQUENT)  # the same words as of the counts
    least = min(frequent.column("uses").to_pylist(), default=1)
    table = words.where(F.col("uses") >= least).toArrow() if frequent.num_rows else words.limit(0).toArrow()
    word = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    sums = np.zeros((2, classes))
    for r in words.groupBy("class").agg(F.sum("uses").alias("uses")).collect():
        sums[0, r["class"]] = r["uses"]
    scratch.drop(counts)
    return {
        "classes": classes,
        "frequent": word[order],
        "uses": table.column("uses").to_numpy()[order],
        "class": table.column("class").to_numpy()[order],
        "class_uses": sums[0],
        "ends": ends,
        "tokens": int(facts["uses"] or 0) + ends,
        "distinct": int(facts["distinct"]) + (ends > 0),
    }, words


# ---- texts as sequences of classes

SEQUENCES = "row long, doc_id long, held_out boolean, tokens long, kinds binary, rare binary"
LOOKED = "bucket int, row long, nth int, word long"
RESOLVED = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary")


def _sequences(model):
    """Each text as its words' classes; a word that is not among the frequent ones as the (negative) number of its hash."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, m = Powers(), model.value
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            hashes, first = batch_words(batch.column(2), powers)
            rows = batch.num_rows
            at, frequent = found_at(m["frequent"], hashes)
            kind = at.astype(np.int32)  # the place among the frequent
            row = np.repeat(np.arange(rows), np.diff(first))[~frequent]
            word = hashes[~frequent]
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            fresh = np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))[: len(word)]
            starts = np.zeros(rows + 1, dtype=np.int64)
            np.cumsum(np.bincount(row[fresh], minlength=rows), out=starts[1:])
            nth = np.empty(len(word), dtype=np.int64)
            nth[order] = np.cumsum(fresh) - 1 - starts[:-1][row]
            kind[~frequent] = -1 - nth
            ids = [pa.array(row_id + np.arange(rows)), batch.column(0), batch.column(1), pa.array(np.diff(first) + 1)]
            yield pa.RecordBatch.from_arrays(
                [*ids, binaries(kind, first), binaries(word[fresh].view(np.int64), starts)],
                ["row", "doc_id", "held_out", "tokens", "kinds", "rare"])
            row_id += rows

    return sequences


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
        size = np.array([len(x) for x in words], dtype=np.int64)
        if not size.sum():
            continue
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        columns = [batch.column(i).to_numpy().repeat(size) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(nth.astype(np.int32)), pa.array(np.concatenate(words))], ["bucket", "row", "nth", "word"])


def _resolve(model):
    """Of some texts: the classes of all words, and what does not depend on transitions."""

    def resolve(texts: pa.Table, looked: pa.Table) -> pa.Table:
        m = model.value
        classes = m["classes"]
        whole = np.log10(m["tokens"] + HALF * (m["distinct"] + 1))
        with np.errstate(divide="ignore"):
            class_total = np.log10(m["class_uses"])
        texts = texts.sort_by("row")
        row = texts.column("row").to_numpy()
        kinds = [np.frombuffer(k, dtype=np.int32) for k in texts.column("kinds").to_pylist()]
        first = np.concatenate(([0], np.cumsum([len(k) for k in kinds]))).astype(np.int64)
        kind = np.concatenate([np.zeros(0, np.int32), *kinds])
        rare = np.array([len(x) // 8 for x in texts.column("rare").to_pylist()], dtype=np.int64)
        begin = np.cumsum(rare) - rare
        rare_class = np.full(int(rare.sum()), classes + 1, dtype=np.int32)  # unknown
        rare_uses = np.zeros(len(rare_class), dtype=np.int64)
        at = begin[np.searchsorted(row, looked.column("row").to_numpy())] + looked.column("nth").to_numpy()
        rare_class[at], rare_uses[at] = looked.column("class").to_numpy(), looked.column("uses").to_numpy()
        owner = np.repeat(np.arange(len(kinds)), np.diff(first))
        far = np.flatnonzero(kind < 0)
        near = np.flatnonzero(kind >= 0)
        uses, held = np.zeros(len(kind), dtype=np.int64), np.zeros(len(kind), dtype=np.int32)
        place = begin[owner[far]] - 1 - kind[far]
        uses[far], held[far] = rare_uses[place], rare_class[place]
        uses[near], held[near] = m["uses"][kind[near]], m["class"][kind[near]]
        known = uses > 0
        emitted = np.zeros(len(kind))
        emitted[known] = np.log10(uses[known]) - class_total[held[known]]
        rows = len(kinds)
        sums = lambda values: np.bincount(owner, values, minlength=rows)
        end = np.log10(m["ends"] + HALF) - whole
        sequence = with_ends(held, first, classes)
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": texts.column("tokens"),
            "n_known": pa.array(sums(known).astype(np.int64) + int(m["ends"] > 0)),
            "base_score": pa.array(sums(np.log10(uses + HALF) - whole) + end),
            "emitted": pa.array(sums(emitted)),
            "classes": binaries(sequence, first + np.arange(rows + 1)),
        })

    return resolve


def steps(column: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class pairs of a batch of sequences (as ``before * (classes + 2) + class``), and each row's first."""
    rows = [np.frombuffer(c, dtype=np.int32) for c in column.to_pylist()]
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
    kind = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int64)
    before = np.concatenate(([classes], kind[:-1]))[: len(kind)]  # a sequence ends with an end
    return before * (classes + 2) + kind, first


def _count_steps(classes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(steps(batch.column(0), classes)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["step", "uses"])

    return count


def transitions(pairs: np.ndarray, unknown: float) -> np.ndarray:
    """log10 probabilities of the next class, from counts ``[class, next]`` of the learnt classes and the end. Unknown words
    come with the same probability everywhere and are followed by what is frequent."""
    n = len(pairs)
    anywhere = (pairs.sum(axis=0) + SMOOTH) / (pairs.sum() + SMOOTH * n)
    here = (pairs + SMOOTH) / (pairs.sum(axis=1, keepdims=True) + SMOOTH * n)
    follow = np.full((n + 1, n + 1), unknown)
    follow[:n, :n] = (1 - unknown) * ((1 - BACKED) * here + BACKED * anywhere)
    follow[n, :n] = (1 - unknown) * anywhere
    return np.log10(follow)


def _score(follow, classes: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = follow.value.ravel()
        for batch in batches:
            pair, first = steps(batch.column(6), classes)
            total = np.add.reduceat(table[pair], first[:-1]) if len(pair) else np.zeros(batch.num_rows)
            made = pa.array(total + batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], made], [*batch.schema.names[:5], "score"])

    return score


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of ``docs(doc_id, text)``, learning from rows
    that are not held out. Scores are log10 probabilities; ``base_score`` is that of single words.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z as a-z; each text has an end as its last token. Null
    text is empty: its end alone. Without training texts all words are unknown. Repeated rows each count and each
    return a row. Texts of any length are read whole, in pieces."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "class-lm")
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    model, words = learn_classes(rows.where("NOT held_out"), scratch)
    classes = model["classes"]
    sent = spark.sparkContext.broadcast(model)
    texts = scratch.keep(rows.mapInArrow(_sequences(sent), SEQUENCES), "sequences")
    tokens = texts.agg(F.sum("tokens")).first()[0] or 0
    buckets = int(max(1, -(-tokens // GROUP_TOKENS)))
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    rare = texts.select("bucket", "row", "rare").mapInArrow(_rare_words, LOOKED)
    # one plan at every size: both sides by word
    looked = rare.hint("merge").join(words.select("word", "uses", "class"), "word").select("bucket", "row", "nth", "uses", "class")
    resolved = texts.groupBy("bucket").cogroup(looked.groupBy("bucket")).applyInArrow(_resolve(sent), RESOLVED)
    resolved = scratch.keep(resolved, "resolved")

    pairs = np.zeros((classes + 1, classes + 1))
    counted = resolved.where("NOT held_out").select("classes").mapInArrow(_count_steps(classes), "step long, uses long")
    for r in counted.groupBy("step").agg(F.sum("uses").alias("uses")).toLocalIterator():
        pairs[divmod(r["step"], classes + 2)] = r["uses"]
    unknown = min(0.5, HALF / (model["tokens"] + HALF * (model["distinct"] + 1)))  # without training texts, less than all
    follow = spark.sparkContext.broadcast(transitions(pairs, unknown))
    scored = resolved.mapInArrow(
        _score(follow, classes), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
