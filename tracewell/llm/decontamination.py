"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words. Over the benchmark's terms, passages are TF-IDF vectors; a randomised SVD of all windows of all
documents and of the items (which together weigh as much), computed over tasks' rows, gives the latent space. It starts from the
items' own directions and multiplies them once by all windows (a Nyström approximation), so the fit reads the documents once. Every
window is then projected into the space, and each item finds the windows near it by cosine. What it finds is checked on words: the
longest common subsequence with the item, and, where that is short of certain (a paraphrase), the item's answer.

A space of bounded rank does not hold every item. An item of whose length it keeps less than ``LEAST_KEPT`` also finds windows by its
rarest words: a passage that passes the check has a known number of those at least, or all of its answer's ("anchors").

Terms that no item has cannot be shared, so they have no column. Document frequencies count all documents, the fit all windows,
repeated ones as often as they occur. The benchmark is the query set: it goes to the tasks in blocks of ``BLOCK_ITEMS`` items at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch
from tracewell.llm.sums import PARTS, in_parts, summed
from tracewell.llm.words import Powers, binaries, word_slices

BLOCK_ITEMS = 4096
PART_WORDS = 64  # longer items are sought in parts of so many words
STRIDE = 21
WINDOW = 4 * STRIDE  # so that some window holds the whole of any part
RANK, EXTRA, ROUNDS = 96, 8, 2
DOCUMENTS = -1  # in place of a term: how many there are
COSINE = 0.3
LEAST_KEPT = 0.1
SURE, LEAST_SHARED = 0.75, 0.55  # parts of an item's words in common order: alone, and with its answer
ANSWER_TERMS = 3
ANCHORS = 60  # per cent of an item's words, the rarest
PART_TERMS = 512  # rows of a partial product that travel together
PART_ROWS = 32
SLICE_WORDS = 1 << 17
AT_ONCE = 1 << 22  # cells of windows by terms, or by items, that a task has at once


def term_bytes() -> np.ndarray:
    letters = np.zeros(256, dtype=bool)
    letters[48:58] = letters[97:123] = letters[128:] = True
    return letters


class Items:
    """A block of benchmark items: their terms' hashes (sorted), and each item's terms as places in those."""

    def __init__(self, ids: list, texts: list, answers: list):
        words = next(word_slices(pc.utf8_lower(pa.array(texts, pa.string())), Powers(), term_bytes(), 1 << 62))
        self.terms = np.unique(words.hash)
        place = np.searchsorted(self.terms, words.hash)
        parts = [(i, at) for i in range(words.rows) for at in range(words.first[i], words.first[i + 1], PART_WORDS)]
        # a short last part is sought with the words before it
        spans = [(i, max(words.first[i], min(at, words.first[i + 1] - PART_WORDS))) for i, at in parts]
        self.ids = np.array([ids[i] for i, _ in spans], dtype=np.int64)
        self.words = [place[at : min(at + PART_WORDS, words.first[i + 1])] for i, at in spans]
        said = next(word_slices(pc.utf8_lower(pa.array([a or "" for a in answers], pa.string())), Powers(), term_bytes(), 1 << 62))
        self.answers = [
            np.searchsorted(self.terms, h) if len(h) and np.isin(h, self.terms).all() else None
            for h in (said.hash[said.first[i] : said.first[i + 1]] for i, _ in spans)
        ]


class Placed:
    """Words of some rows as places in the items' terms: ``first[i]:first[i + 1]`` are row i's, ``row0`` is the first row's number.
    ``known`` says of each word whether it is such a term."""

    def __init__(self, row0: int, first: np.ndarray, place: np.ndarray, known: np.ndarray):
        self.row0, self.rows, self.first, self.place, self.known = row0, len(first) - 1, first, place, known

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)


def place_type(terms: int) -> np.dtype:
    """Of places and, behind the last one, of a word that is no term."""
    return np.dtype(np.uint16 if terms < 1 << 16 else np.uint32)


def _placed(items):
    """Texts as places of their words, so that they are tokenised once."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, letters, terms = Powers(), term_bytes(), items.value["terms"]
        kind = place_type(len(terms))
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for words in word_slices(pc.utf8_lower(batch.column(1)), powers, letters):
                place, known = _places(terms, words.hash)
                place = np.where(known, place, len(terms)).astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(words.row0, words.rows), binaries(place, words.first)], ["doc_id", "places"])

    return placed


def placed_slices(column: pa.Array, terms: int) -> Iterator[Placed]:
    """The rows of a column of places, some ``SLICE_WORDS`` words at a time."""
    kind = place_type(terms)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
    offsets = (offsets - offsets[0]) // kind.itemsize
    row, rows = 0, len(column)
    while row < rows:
        last = min(max(int(np.searchsorted(offsets, offsets[row] + SLICE_WORDS)), row + 1), rows)
        place = data[offsets[row] : offsets[last]].astype(np.int64)
        yield Placed(row, offsets[row : last + 1] - offsets[row], place, place < terms)
        row = last


def _frequencies(terms: int):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, docs = np.zeros(terms, dtype=np.int64), 0
        for batch in batches:
            for words in placed_slices(batch.column(0), terms):
                row = np.repeat(np.arange(words.rows), words.lengths())
                pair = np.unique(row[words.known] * terms + words.place[words.known])
                count += np.bincount(pair % terms, minlength=terms)
                docs += words.rows
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, DOCUMENTS)), pa.array(np.append(count[held], docs))], ["term", "documents"])

    return frequencies


def _places(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return place, terms[place] == hashes


def anchors(items, held: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, set[int], int]]]:
    """Of the items ``of``: term lists as postings, and of each list its item, its terms and how many of them a passage
    needs. A passage that shares ``SURE`` of an item's words has those of the item's rarest words that are left if all it lacks are
    among them; one that gives the answer has all of the answer's terms."""
    lists: list[tuple[int, set[int], int]] = []
    answers = answer_terms(items, held)
    for i in of.tolist():
        words, answer = items.words[i], set(answers[i].tolist())
        rare = set(words[np.argsort(held[words], kind="stable")][: -(-len(words) * ANCHORS // 100)].tolist())
        lists.append((i, rare, max(1, len(rare) - (len(words) - int(np.ceil(SURE * len(words)))))))
        lists.append((i, answer, len(answer)))
    terms = np.array([t for _, rare, _ in lists for t in sorted(rare)], dtype=np.int64)
    owners = np.repeat(np.arange(len(lists)), [len(rare) for _, rare, _ in lists])
    order = np.argsort(terms, kind="stable")
    return np.searchsorted(terms[order], np.arange(len(items.terms) + 1)), owners[order], lists


def answer_terms(items, held: np.ndarray) -> list[np.ndarray]:
    """The answers' terms; an item without a known answer has its rarest terms for one."""
    return [
        np.unique(a) if a is not None else np.unique(w)[np.argsort(held[np.unique(w)], kind="stable")[:ANSWER_TERMS]]
        for a, w in zip(items.answers, items.words)
    ]


def anchored_windows(words: Placed, place: np.ndarray, known: np.ndarray, anchored) -> dict[tuple[int, int], set[int]]:
    """``{(row, window): items}`` of windows with enough of some item's anchors."""
    first, owners, lists = anchored
    need = np.array([n for _, _, n in lists])
    at = np.flatnonzero(known)
    many = first[place[at] + 1] - first[place[at]]
    at, nth = np.repeat(at, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    which = owners[first[place[at]] + nth]
    row = np.searchsorted(words.first, at, side="right") - 1
    key = row * len(need) + which
    order = np.argsort(key, kind="stable")
    key, at, row, which = key[order], at[order], row[order], which[order]
    last = np.arange(len(at)) + need[which] - 1
    inside = last < len(at)
    last = np.minimum(last, max(len(at) - 1, 0))
    hit = np.flatnonzero(inside & (key[last] == key) & (at[last] - at < WINDOW)) if len(at) else at
    begin, row = words.first[:-1][row[hit]], row[hit]
    low = np.maximum(-(-(at[last[hit]] - begin + 1 - WINDOW) // STRIDE), 0)
    high = (at[hit] - begin) // STRIDE
    found: dict[tuple[int, int], set[int]] = {}
    for r, lo, hi, i in zip(row.tolist(), low.tolist(), high.tolist(), which[hit].tolist()):
        for w in range(lo, hi + 1):
            found.setdefault((r, w), set()).add(lists[i][0])
    return found


def window_blocks(words: Placed) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first block of ``STRIDE`` words (one window begins in each), and each block's row."""
    blocks = -(-words.lengths() // STRIDE)
    first = np.concatenate(([0], np.cumsum(blocks)))
    return first, np.repeat(np.arange(words.rows), blocks)


def sums_of_rows(table: np.ndarray, index: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each group the sum of the rows of ``table`` that ``index[begin : begin + many]`` names: the first rows of all groups, then
    the second ones, and so on, larger groups first, so that whole blocks are added at once."""
    order = np.argsort(-many, kind="stable")
    begin, size = begin[order], np.sort(-many)
    sums = np.zeros((len(begin), table.shape[1]), dtype=table.dtype)
    for k in range(int(-size[0]) if len(size) else 0):
        more = int(np.searchsorted(size, -k))  # groups of more than k rows
        sums[:more] += table[index[begin[:more] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def window_vectors(words: Placed, place: np.ndarray, known: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Each window in the latent space: words are projected once, summed by block, and four blocks are a window."""
    first, owner = window_blocks(words)
    at = np.flatnonzero(known)
    row = np.searchsorted(words.first, at, side="right") - 1
    block = first[row] + (at - words.first[row]) // STRIDE
    sums = np.zeros((first[-1] + WINDOW // STRIDE - 1, basis.shape[1]), dtype=np.float32)
    begin = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(at)])
    sums[block[begin]] = sums_of_rows(basis, place[at], begin, np.diff(np.append(begin, len(at))))
    out = sums[: first[-1]].copy()
    last = first[1:][owner]
    for k in range(1, WINDOW // STRIDE):  # not beyond the row's last block
        more = np.arange(first[-1]) + k < last
        out[more] += sums[np.flatnonzero(more) + k]
    return out


class Overlaps:
    """How many of an item's words a window can share at most: those whose term it has."""

    def __init__(self, items: list[np.ndarray], terms: int):
        self.terms = terms
        self.distinct = np.full((len(items), max((len(w) for w in items), default=1) or 1), terms, dtype=np.int64)
        self.counts = np.zeros(self.distinct.shape, dtype=np.int64)
        for i, w in enumerate(items):
            found, times = np.unique(w, return_counts=True)
            self.distinct[i, : len(found)], self.counts[i, : len(found)] = found, times

    def most(self, has: np.ndarray, window: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Of pairs; ``has`` says of each window and term whether it has it, the last column being no term."""
        out = np.zeros(len(window), dtype=np.int64)
        step = max(1, AT_ONCE // self.distinct.shape[1])
        for lo in range(0, len(window), step):
            part = slice(lo, lo + step)
            there = has[window[part, None], self.distinct[item[part]]]
            out[part] = (there * self.counts[item[part]]).sum(axis=1)
        return out


def windows_with_terms(block: np.ndarray, term: np.ndarray, begin: np.ndarray, lo: int, hi: int, terms: int) -> np.ndarray:
    """Which terms the windows from ``lo`` to ``hi`` have, from words' blocks (ascending), their terms and the first blocks of
    their rows."""
    has = np.zeros((hi - lo, terms + 1), dtype=bool)
    part = slice(*np.searchsorted(block, (lo, hi + WINDOW // STRIDE - 1)))
    for k in range(WINDOW // STRIDE):
        window = block[part] - k
        ok = (window >= np.maximum(begin[part], lo)) & (window < hi)
        has[window[ok] - lo, term[part][ok]] = True
    return has


def tf_idf(rows: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of the rows' vectors, of length 1 each."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pair, times = np.unique(row * len(weight) + np.concatenate([*rows, np.zeros(0, np.int64)]), return_counts=True)
    pair = pair.astype(np.int64)
    row, term = pair // len(weight), pair % len(weight)
    value = times * weight[term]
    length = np.sqrt(np.bincount(row, value**2, minlength=len(rows)))
    return row, term, value / np.maximum(length[row], 1e-12)


def project(rows: list[np.ndarray], weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, tuple]:
    row, term, value = vectors = tf_idf(rows, weight)
    out = np.zeros((len(rows), basis.shape[1]))
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.add.reduceat(basis[term] * value[:, None], first, axis=0)
    return out, vectors


def window_lengths(term: np.ndarray, block: np.ndarray, row: np.ndarray, last: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared lengths of the windows' TF-IDF vectors, from words in order of their term, then place; ``last`` is the block behind
    each block's row."""
    blocks, span = len(last), WINDOW // STRIDE
    squares = weight[term] ** 2
    # of each block: what its words add to a window that reaches so many blocks further, alone and with equal ones
    gained = np.zeros((span, blocks + span))
    gained[0, :blocks] = np.bincount(block, squares, minlength=blocks)
    at, apart = np.arange(len(term)), 0
    while len(at):
        apart += 1
        at = at[at + apart < len(term)]
        far = block[at + apart] - block[at]
        near = (term[at + apart] == term[at]) & (row[at + apart] == row[at]) & (far < span)
        at, far = at[near], far[near]
        gained[:, :blocks] += np.bincount(far * blocks + block[at], 2 * squares[at], minlength=span * blocks).reshape(span, blocks)
    gained = np.cumsum(gained, axis=0)
    out = np.zeros(blocks)
    for k in range(span):
        more = np.flatnonzero(np.arange(blocks) + k < last)
        out[more] += gained[span - 1 - k, more + k]
    return out


def add_gram(words: Placed, weight: np.ndarray, basis: np.ndarray, total: np.ndarray) -> int:
    """Adds ``XᵀX Q`` of all windows of some texts to ``total``, and says how many windows have terms. ``basis`` is ``Q`` times the
    terms' weights."""
    first, owner = window_blocks(words)
    at = np.flatnonzero(words.known)
    if not len(at):
        return 0
    # 16-bit places are sorted by their digits
    at = at[np.argsort(words.place[at].astype(place_type(len(weight))), kind="stable")]
    term, row = words.place[at], np.searchsorted(words.first, at, side="right") - 1
    block = first[row] + (at - words.first[row]) // STRIDE
    begin, last = first[:-1][owner], first[1:][owner]
    length = window_lengths(term, block, row, last, weight)
    held = length > 0
    latent = window_vectors(words, words.place, words.known, basis)
    latent *= np.where(held, 1 / np.where(held, length, 1), 0).astype(np.float32)[:, None]
    back = latent.copy()  # of each block: the sum over the windows it is in
    for k in range(1, WINDOW // STRIDE):
        more = np.flatnonzero(np.arange(len(owner)) - k >= begin)
        back[more] += latent[more - k]
    heads = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    many = np.diff(np.append(heads, len(term)))
    # frequent terms' words are added up some at a time first
    parts = -(-many // PART_ROWS)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(heads, parts) + nth * PART_ROWS
    sums = sums_of_rows(back, block, begin, np.minimum(np.repeat(heads + many, parts) - begin, PART_ROWS))
    total[term[heads]] += np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0) * weight[term[heads], None]
    return int(held.sum())


def _gram_times(weights, basis):
    """Partial sums of ``XᵀX Q`` of all windows of a task's texts; one more row holds the number of windows."""

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = weights.value, basis.value
        weighted = (q * weight[:, None]).astype(np.float32)
        total = np.zeros((len(q) + 1, q.shape[1]))
        for batch in batches:
            for words in placed_slices(batch.column(0), len(weight)):
                total[-1, 0] += add_gram(words, weight, weighted, total)
        yield in_parts(total, PART_TERMS)

    return times


def item_gram_times(rows: list[np.ndarray], weight: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``XᵀX Q`` of the items, some at a time."""
    total = np.zeros_like(q)
    for at in range(0, len(rows), 512):
        latent, (row, term, value) = project(rows[at : at + 512], weight, q)
        order = np.argsort(term, kind="stable")
        if len(order):
            first = np.flatnonzero(np.append(True, np.diff(term[order]) != 0))
            total[term[order][first]] += np.add.reduceat((latent[row] * value[:, None])[order], first, axis=0)
    return total


def latent_basis(texts: DataFrame, items, weights) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix of all windows of ``texts(places)`` and the items, all items weighing as
    much as all windows. Subspace iteration on the items, the query set, is the start; one distributed pass over the texts multiplies it
    by all rows, and the Nyström approximation from that product gives the vectors. The driver holds ``terms x (RANK + EXTRA)`` values."""
    context, weight, rows = texts.sparkSession.sparkContext, weights.value, items.value["words"]
    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((len(weight), min(len(weight), RANK + EXTRA))))
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(item_gram_times(rows, weight, q) + 1e-9 * q)
    product = summed(
        texts.select("places").mapInArrow(_gram_times(weights, context.broadcast(q)), PARTS), (len(q) + 1, q.shape[1]))
    windows, product = product[-1, 0], product[:-1]
    product += max(1.0, windows / max(1, len(rows))) * item_gram_times(rows, weight, q)
    # A ~ Y (QᵀY)^-1 Yᵀ: its leading eigenvectors are the left singular vectors of Y (QᵀY)^-1/2
    core = q.T @ product
    size, turned = np.linalg.eigh((core + core.T) / 2)
    sure = size > 1e-7 * max(size.max(initial=0), 1e-300)
    u, _, _ = np.linalg.svd(product @ (turned[:, sure] / np.sqrt(size[sure])), full_matrices=False)
    return u[:, :RANK]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table per step in one integer's bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


FOUND = "doc_id long, item_id long, start long, cosine double, shared double, answered boolean"


def _retrieve(model):
    """Windows near items, and what the check on words says of them."""

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = SimpleNamespace(**model.value)
        block = SimpleNamespace(**m.items)
        terms = block.terms
        basis = (m.basis * m.weight[:, None]).astype(np.float32)
        wanted, _ = project(block.words, m.weight, m.basis)
        wanted = (wanted / np.maximum(np.linalg.norm(wanted, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        answers = [set(a.tolist()) for a in answer_terms(block, -m.weight)]
        sizes = np.array([len(w) for w in block.words])
        overlaps = Overlaps(block.words, len(terms))
        at_once = max(16, AT_ONCE // max(len(terms), len(sizes)))
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []

            def check(words, place, known, row: int, window: int, item: int, cosine: float) -> None:
                begin = words.first[row] + window * STRIDE
                span = slice(begin, min(begin + WINDOW, words.first[row + 1]))
                passage = place[span][known[span]]
                shared = common_subsequence(block.words[item], passage) / len(block.words[item])
                said = answers[item] <= set(passage.tolist())
                if shared >= SURE or (shared >= LEAST_SHARED and said):
                    out.append((ids[words.row0 + row], int(block.ids[item]), window * STRIDE, cosine, shared, said))

            for words in placed_slices(batch.column(1), len(terms)):
                place, known = words.place, words.known
                vectors = window_vectors(words, place, known, basis)
                first, owner = window_blocks(words)
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors /= np.maximum(size, 1e-12)
                at = np.flatnonzero(known)
                row = np.searchsorted(words.first, at, side="right") - 1
                of_word = first[row] + (at - words.first[row]) // STRIDE, place[at], first[row]
                near: set[tuple[int, int]] = set()
                for lo in range(0, len(vectors), at_once):
                    cosines = vectors[lo : lo + at_once] @ wanted.T
                    i, j = np.nonzero(cosines >= COSINE)
                    if not len(i):
                        continue
                    has = windows_with_terms(*of_word, lo, lo + len(cosines), len(terms))
                    enough = overlaps.most(has, i, j) >= LEAST_SHARED * sizes[j]  # else the subsequence is too short
                    for w, item in zip(i[enough].tolist(), j[enough].tolist()):
                        near.add((lo + w, item))
                        r = int(owner[lo + w])
                        check(words, place, known, r, lo + w - int(first[r]), item, float(cosines[w, item]))
                if m.anchored:
                    for (row, window), found in sorted(anchored_windows(words, place, known, m.anchored).items()):
                        w = int(first[row]) + window
                        for j in sorted(found):
                            if (w, j) not in near:
                                check(words, place, known, row, window, j, float(vectors[w] @ wanted[j]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "cosine", "shared", "answered"])

    return retrieve


def kept_lengths(words: list[np.ndarray], weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of each item's (squared) length that the latent space holds."""
    return (project(words, weight, basis)[0] ** 2).sum(axis=1)


def _item_blocks(benchmark: DataFrame, answer: str | None) -> Iterator[Items]:
    rows = benchmark.select("item_id", "text", F.col(answer) if answer else F.lit(None).cast("string")).where(
        "item_id IS NOT NULL AND text IS NOT NULL")
    block: list = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK_ITEMS:
            yield Items(*zip(*block))
            block = []
    if block:
        yield Items(*zip(*block))


def contaminated(docs: DataFrame, benchmark: DataFrame, answer: str | None = None) -> DataFrame:
    """``(doc_id, item_id, start, cosine, shared, answered)``: the best passage of each document for each benchmark
    item it gives away. ``shared`` is the part of the item's words that the passage has in the item's order.

    Items of more than ``PART_WORDS`` words are sought part by part. Words are runs of letters and digits in lower case. ``answer`` names a benchmark column; without one (or where
    it is null or not in the item) an item's heaviest terms stand for its answer. Null and empty texts match
    nothing; a passage without a ``doc_id`` is not reported; rows that repeat a ``doc_id`` are one document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    found = None
    for block in _item_blocks(benchmark, answer):
        if not len(block.terms):
            continue
        items = spark.sparkContext.broadcast(vars(block))
        texts = scratch.keep(docs.select("doc_id", "text").mapInArrow(_placed(items), "doc_id long, places binary"), "places")
        counts = texts.select("places").mapInArrow(_frequencies(len(block.terms)), "term long, documents long").groupBy("term").agg(
            F.sum("documents").alias("documents")).toArrow().to_pydict()
        count = dict(zip(counts["term"], counts["documents"]))
        held = np.array([count.get(t, 0) for t in range(len(block.terms))])
        weight = np.log((count.get(DOCUMENTS, 0) + 1) / (held + 1)) + 0.05
        weights = spark.sparkContext.broadcast(weight)
        basis = latent_basis(texts, items, weights)
        weak = np.flatnonzero(kept_lengths(block.words, weight, basis) < LEAST_KEPT)
        model = spark.sparkContext.broadcast({
            "items": vars(block), "weight": weight, "basis": basis,
            "anchored": anchors(block, held, weak) if len(weak) else None})
        part = scratch.keep(texts.where("doc_id IS NOT NULL").mapInArrow(_retrieve(model), FOUND), "found")
        scratch.drop(texts)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], FOUND)
    best = F.max(F.struct("shared", "cosine", (-F.col("start")).alias("start"), "answered")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.start")).alias("start"), "best.cosine", "best.shared", "best.answered")
