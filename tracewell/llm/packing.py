"""Packing tokenised documents into sequences by linear grouping.

Large pieces are ranked by length and cut into groups of equal cardinality; a group's lengths are rounded up to
its longest. For those few sizes the cheapest mix of configurations (multisets of sizes that fit a sequence) is
found by column generation. Actual pieces are then substituted for sizes, and what is small, or left over, goes
best-fit into the room that remains, longest first.

The sizes and configurations come from the histogram of all lengths, which has ``capacity`` entries at most.
Substitution and best fit run in shards of about ``SHARD_PIECES`` pieces dealt out at random, so no key can be
hot and no task holds more than a shard.
"""

from __future__ import annotations

import os
import string
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import Scratch

SHARD_PIECES = 4096
GROUPS = 24
SMALL = 10  # pieces of up to capacity / SMALL tokens are small
UNITS = 512  # lengths are rounded up to capacity / UNITS for the configurations
CACHED_PARTS = 1_000_000  # stems, ends and other words that a worker process holds
STEMS = 10_000  # looked up at once
IDS_AT_ONCE = 1 << 18
WORD_END = "</w>"
# letters whose lower-cased normal form (NFC) ends with a mark, which the tokenizer joins with punctuation
NOT_LETTERS_IN_NFC = "[\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40\ufb41\ufb43\ufb44\ufb46-\ufb4e]"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- tokens

def _worker_cache(key: str) -> dict:
    """A dict that lives as long as the worker process, so that tasks share what they have looked up."""
    home = sys.modules.setdefault("_tracewell_worker", types.ModuleType("_tracewell_worker"))
    return home.__dict__.setdefault(key, {})


class WordIds:
    """Ids of words, as little-endian unsigned 32-bit integers, by a tokenizer that drops white space, folds case
    and never joins letters with what follows them: a text then has the ids of its words, and a word of letters
    and final punctuation those of the two. Such parts are looked up once; ``ids[first[i]:first[i + 1]]`` are those of
    part i. Stems of ``letters_of`` go to the tokenizer's model as they are, which saves most of the time; others are
    looked up many at a time, and a token that ends a word ends a stem.
    """

    def __init__(self, tokenizer, suffix: str):
        self.tokenizer, self.letters = tokenizer, letters_of(tokenizer)
        self.known = frozenset(map(chr, self.letters))
        self.ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.parts, self.ids, self.first = {"": 0}, np.zeros(0, "<u4"), np.zeros(2, dtype=np.int64)

    def of(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and each word's first."""
        if len(self.parts) > CACHED_PARTS:
            self._forget()
        stems, ends = stems_and_ends(words)
        part = self._numbers(pa.concat_arrays([stems, ends])).reshape(2, -1).T.ravel()  # a word's stem, then its end
        start, count = self.first[part], self.first[part + 1] - self.first[part]
        first = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(count[::2] + count[1::2], out=first[1:])
        return self.ids[ranges(start, count)], first

    def _numbers(self, parts: pa.StringArray) -> np.ndarray:
        coded = parts.dictionary_encode()
        values = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist()
        number = np.fromiter(map(self.parts.get, values, repeat(-1)), np.int64, len(values))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [values[i] for i in new]
            self._add(fresh)
            number[new] = [self.parts[part] for part in fresh]
        return number[coded.indices.to_numpy()]

    def _add(self, parts: list[str]) -> None:
        direct, stems, others = [], [], []
        for part in parts:
            (direct if self.known.issuperset(part) else stems if part.isalpha() else others).append(part)
        tokenize = self.tokenizer.model.tokenize
        found = [_joined([[t.id for t in tokenize(part.translate(self.letters))] for part in direct])]
        found += [self._ids_of_stems(stems[at : at + STEMS]) for at in range(0, len(stems), STEMS)]
        found.append(self._ids_of_each(others))
        self.parts.update(zip(chain(direct, stems, others), range(len(self.parts), len(self.parts) + len(parts))))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        counts = np.concatenate([count for _, count in found])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(counts))

    def _ids_of_stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)
        ids = np.array(joined[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(stems):
            return ids, np.diff(ends, prepend=0)
        return self._ids_of_each(stems)  # some stem is more than one run of letters to the tokenizer

    def _ids_of_each(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _joined([e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)])


def letters_of(tokenizer) -> dict[int, str]:
    """What the tokenizer hands to its model for each letter below U+0300, where no two letters make up one; nothing if
    it does not hand on the letters of a word one by one, all together."""

    def handed(text: str) -> list[str]:
        normal = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        return [part for part, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    if any(any(map(str.isalpha, t.content)) and not t.special for t in tokenizer.get_added_tokens_decoder().values()):
        return {}
    letters = {c: handed(chr(c)) for c in range(0x300) if chr(c).isalpha()}
    letters = {c: parts[0] for c, parts in letters.items() if len(parts) == 1}
    return letters if handed("".join(map(chr, letters))) == ["".join(letters.values())] else {}


def _joined(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``start[i]``, ``start[i] + 1``, … ``count[i]`` of them, for each i."""
    before = np.cumsum(count) - count
    places = np.repeat(start - before, count)
    places += np.arange(len(places))
    return places


def stems_and_ends(words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Words of letters and final punctuation as those two, A-Z as a-z; other words as they are and an empty end."""
    plain = pc.ascii_lower(words)
    stems = pc.ascii_rtrim(plain, characters=string.punctuation)
    split = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False)
    odd = np.flatnonzero(split & ~pc.string_is_ascii(stems).to_numpy(zero_copy_only=False))
    split[odd] = ~pc.match_substring_regex(stems.take(pa.array(odd)), NOT_LETTERS_IN_NFC).to_numpy(zero_copy_only=False)
    stem_bytes = pc.binary_length(stems).to_numpy().astype(np.int64)
    offsets = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
    count = np.where(split, np.diff(offsets) - stem_bytes, 0)
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[ranges(offsets[:-1] + stem_bytes, count)]
    ends = np.append(0, np.cumsum(count)).astype(np.int32)
    ends = pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(data))
    return pc.if_else(pa.array(split), stems, words), ends


def _crcs(ids: np.ndarray, first: np.ndarray, words: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[int]:
    """CRC-32 of the pieces of the ids of ``words`` (numbers of words) that begin, ascending, at ``begin``."""
    count = np.diff(first)[words]
    place = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(count, out=place[1:])
    out, at = [], 0
    while at < len(begin):  # some pieces at a time, as their ids need much more room than the words
        stop = int(np.searchsorted(begin, begin[at] + IDS_AT_ONCE))
        low = int(np.searchsorted(place, begin[at], side="right")) - 1
        high = int(np.searchsorted(place, begin[stop - 1] + length[stop - 1]))
        part = ids[ranges(first[words[low:high]], count[low:high])]
        starts = (begin[at:stop] - place[low]).tolist()
        out += [zlib.crc32(part[s : s + n]) for s, n in zip(starts, length[at:stop].tolist())]
        at = stop
    return out


def _pieces(model, capacity: int, end_id: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        held = _worker_cache(f"words {zlib.crc32(model.value.encode())}")
        if "ids" not in held:
            held["ids"] = WordIds(Tokenizer.from_str(model.value), WORD_END)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), " ")
            coded = split.flatten().dictionary_encode()
            ids, first = held["ids"].of(coded.dictionary)
            after = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))
            words = np.insert(coded.indices.to_numpy(), after[1:], len(first) - 1)  # a text ends with one word more
            ids, first = np.append(ids, np.array([end_id], "<u4")), np.append(first, len(ids) + 1)
            place = np.append(0, np.cumsum(np.diff(first)[words]))[after + np.arange(len(after))]
            total = np.diff(place)
            many = -(-total // capacity)
            row = np.repeat(np.arange(batch.num_rows), many)
            piece = ranges(np.zeros(len(many), dtype=np.int64), many)
            start = piece * capacity
            length = np.minimum(total[row] - start, capacity)
            crcs = _crcs(ids, first, words, place[row] + start, length)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(crcs, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every document's ids and ``end_id``, cut after each
    ``capacity`` ids. Null and empty texts are ``end_id`` alone. The vocabulary must drop white space."""
    with open(tokenizer_file, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    return docs.select("doc_id", "text").mapInArrow(_pieces(model, capacity, end_id), PIECES)


# ---- configurations

def size_groups(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """``(longest, pieces)`` of the groups of large pieces, longest first. ``lengths`` ascend."""
    large = (lengths > capacity // SMALL) & (lengths < capacity) & (counts > 0)
    lengths, counts = lengths[large][::-1], counts[large][::-1]
    total = int(counts.sum())
    if not total:
        return []
    each = -(-total // GROUPS)
    before = np.cumsum(counts) - counts
    groups = {}
    for g in range(-(-total // each)):
        first = np.searchsorted(before, g * each, side="right") - 1
        groups[int(lengths[first])] = groups.get(int(lengths[first]), 0) + min(each, total - g * each)
    return sorted(groups.items(), reverse=True)


def _best_configuration(sizes: np.ndarray, worth: np.ndarray) -> tuple[float, np.ndarray]:
    """The multiset of sizes (in units) of most worth that fits."""
    best, choice = np.zeros(UNITS + 1), np.full(UNITS + 1, -1)
    for room in range(1, UNITS + 1):
        fits = np.flatnonzero(sizes <= room)
        best[room], choice[room] = best[room - 1], -1
        if len(fits):
            value = best[room - sizes[fits]] + worth[fits]
            top = int(value.argmax())
            if value[top] > best[room] + 1e-12:
                best[room], choice[room] = value[top], fits[top]
    taken, room = np.zeros(len(sizes)), UNITS
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            taken[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[UNITS]), taken


def configurations(groups: list[tuple[int, int]], capacity: int) -> list[tuple[float, list[int]]]:
    """``(sequences, pieces per group)`` of the linear programme's optimum: fewest sequences that hold all
    groups at their rounded lengths. A basis has one configuration per group; while some configuration is worth
    more than a sequence at the basis' prices, it replaces the one that runs out first."""
    if not groups:
        return []
    sizes = np.array([-(-length * UNITS // capacity) for length, _ in groups])
    wanted = np.array([n for _, n in groups], dtype=float)
    basis = np.diag((UNITS // sizes).astype(float))
    for _ in range(40 * len(groups)):
        prices = np.linalg.solve(basis.T, np.ones(len(groups)))
        worth, taken = _best_configuration(sizes, np.maximum(prices, 0))
        if worth <= 1 + 1e-7:
            break
        amounts, change = np.linalg.solve(basis, wanted), np.linalg.solve(basis, taken)
        ratio = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = taken
    amounts = np.linalg.solve(basis, wanted)
    return [(float(a), [int(x) for x in basis[:, i]]) for i, a in enumerate(amounts) if a > 1e-9]


# ---- packing

class BestFit:
    """Open sequences by room left; ``mask`` has a bit for each room that some sequence has."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_room = capacity, 0, {}
        self.room: list[int] = []

    def put_back(self, sequence: int) -> None:
        room = self.room[sequence]
        self.by_room.setdefault(room, []).append(sequence)
        self.mask |= 1 << room

    def open(self, used: int) -> int:
        self.room.append(self.capacity - used)
        self.put_back(len(self.room) - 1)
        return len(self.room) - 1

    def place(self, length: int) -> int:
        fitting = self.mask >> length
        if not fitting:
            return self.open(length)
        room = length + (fitting & -fitting).bit_length() - 1
        held = self.by_room[room]
        sequence = held.pop()
        if not held:
            self.mask ^= 1 << room
        self.room[sequence] -= length
        self.put_back(sequence)
        return sequence


def pack_shard(lengths: list[int], capacity: int, groups: list[tuple[int, int]], mix: list[tuple[float, list[int]]],
               total: int) -> list[int]:
    """Each piece's sequence."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sequence = [-1] * len(lengths)
    bins = BestFit(capacity)
    bounds = [longest for longest, _ in groups]
    queues: list[list[int]] = [[] for _ in groups]
    rest = []
    g = 0
    for i in order:
        if capacity // SMALL < lengths[i] < capacity and groups:
            while g + 1 < len(groups) and lengths[i] <= bounds[g + 1]:
                g += 1
            queues[g].append(i)
        else:
            rest.append(i)
    for amount, taken in sorted(mix, key=lambda m: -sum(n * b for n, b in zip(m[1], bounds))):
        for _ in range(int(amount * len(lengths) / max(total, 1))):
            held = [q.pop() for q, n in zip(queues, taken) for _ in range(min(n, len(q)))]
            if held:
                at = bins.open(sum(lengths[i] for i in held))
                for i in held:
                    sequence[i] = at
    rest += [i for q in queues for i in q]
    for i in sorted(rest, key=lambda i: -lengths[i]):
        sequence[i] = bins.place(lengths[i])
    return sequence


def _pack(capacity: int, groups, mix, total: int):
    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        sequence = np.array(pack_shard(lengths, capacity, groups, mix, total), dtype=np.int64)
        length = np.array(lengths, dtype=np.int64)
        order = np.argsort(sequence, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = sequence[order][1:] != sequence[order][:-1]
        offset = np.empty(len(order), dtype=np.int64)
        offset[order] = before - np.repeat(before[fresh], np.diff(np.append(np.flatnonzero(fresh), len(order))))
        shard = int(table.column("shard")[0].as_py())
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array((shard << 32) + sequence)).append_column(
            "offset", pa.array(offset))

    return pack


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of ``token_pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    One row per piece. Rows that repeat or lack a ``doc_id`` are documents of their own; an empty table gives no
    rows; other columns are not read."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(token_pieces(docs, tokenizer_file, capacity, end_id), "pieces")
    histogram = np.array(
        [(r["length"], r["count"]) for r in pieces.groupBy("length").count().collect()], dtype=np.int64).reshape(-1, 2)
    histogram = histogram[histogram[:, 0].argsort()]
    total = int(histogram[:, 1].sum())
    groups = size_groups(histogram[:, 0], histogram[:, 1], capacity)
    mix = configurations(groups, capacity)
    shards = max(1, round(total / SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        _pack(capacity, groups, mix, total), f"{PIECES}, sequence_id long, offset long")
