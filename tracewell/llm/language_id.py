"""Language identification with language-bitmask n-gram filters.

Each language's set of characteristic n-grams (four bytes of lower-case UTF-8; anything but letters is one
space) goes into a Bloom filter. The filters are bit-sliced: one slot holds one bit per language, so the AND of
an n-gram's slots is the mask of all languages that contain it. More than ``MASK_BITS`` languages take several masks a slot. A text's popcounts per language, corrected for
each filter's false-positive rate, decide.

An n-gram is characteristic of a language when its rate there is at least ``MIN_RATE`` (so a language has at
most ``1 / MIN_RATE`` of them, which bounds the filters whatever the input) and at least ``RELATIVE`` of its rate
in any language (so foreign passages in a language's texts teach it little). Rates count all training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import bound_batches
from tracewell.llm.words import byte_column, mix

GRAM = 4
MIN_RATE = 2e-5
RELATIVE = 0.2
SLOTS = 1 << 20
HASHES = 3
MASK_BITS = 62
UNKNOWN = "und"
SLICE_BYTES = 1 << 19


def letters_table() -> np.ndarray:
    table = np.full(256, 0x20, dtype=np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, n-grams, each row's first)`` of some rows at a time, or of a piece of a long row. A row reads as if a space
    stood before and after it; n-grams with an inner space are left out, so a row can be cut wherever no letter stands."""
    offsets, data = byte_column(pc.utf8_lower(column))
    table, row, rows = letters_table(), 0, len(offsets) - 1
    at = 0  # in the row
    while row < rows:
        begin = int(offsets[row]) + at
        if offsets[row + 1] - begin > SLICE_BYTES:
            end, last = _cut(data, table, begin + SLICE_BYTES, int(offsets[row + 1])), row + 1
            part = np.array([0, end - begin], dtype=np.int64)
        else:
            last = int(np.searchsorted(offsets, begin + SLICE_BYTES, side="left"))
            last = min(max(last, row + 1), rows) if not at else row + 1
            part = offsets[row : last + 1] - begin
            part[0] = 0
            end = int(offsets[last])
        n = last - row
        body = table[data[begin:end]]
        owner = np.repeat(np.arange(n), np.diff(part))
        text = np.full(len(body) + 2 * n, 0x20, dtype=np.uint8)
        text[np.arange(len(body)) + 2 * owner + 1] = body
        begin = part + 2 * np.arange(n + 1)
        blank = text == 0x20
        keep = np.ones(len(text), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[begin[:-1]] = True
        kept_before = np.zeros(len(text) + 1, dtype=np.int64)
        np.cumsum(keep, out=kept_before[1:])
        text, edge = text[keep], kept_before[begin]
        code = np.zeros(max(len(text) - GRAM + 1, 0), dtype=np.uint32)
        ok = np.ones(len(code), dtype=bool)
        for k in range(GRAM):
            code = (code << np.uint32(8)) | text[k : k + len(code)]
            if 0 < k < GRAM - 1:
                ok &= text[k : k + len(ok)] != 0x20
        for k in range(1, GRAM):  # not across rows
            late = edge[1:] - k
            ok[late[(late >= 0) & (late < len(ok))]] = False
        places = np.flatnonzero(ok)
        yield row, code[places], np.searchsorted(places, edge)
        if end < offsets[last]:
            at = end - int(offsets[row])
        else:
            row, at = last, 0


def _cut(data: np.ndarray, table: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on where no letter stands."""
    while at < end:
        blank = np.flatnonzero(table[data[at : min(at + 4096, end)]] == 0x20)
        if len(blank):
            return at + int(blank[0])
        at += 4096
    return end


def slots(code: np.ndarray) -> list[np.ndarray]:
    value = mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (value >> np.uint64(32)) | np.uint64(1)
    return [((value + np.uint64(i) * step) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        index = langs.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
        names = langs.dictionary
        found = []
        for row, code, first in grams(batch.column(0)):
            owner = np.repeat(index[row : row + len(first) - 1], np.diff(first))
            found.append((owner << np.uint64(32)) | code)
        if not found:
            continue
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [
                names.take(pa.array((keys >> np.uint64(32)).astype(np.int64))).cast(pa.string()),
                pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)),
                pa.array(counts.astype(np.int64)),
            ],
            ["lang", "gram", "uses"],
        )


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        where = slots(batch.column(0).to_numpy().astype(np.uint32))
        columns = [pa.concat_arrays([batch.column(i)] * HASHES) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(where)), *columns], ["slot", "nth", "mask"])


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # [nth, slot]: languages nth * MASK_BITS on, as bits
    false_positives: np.ndarray  # per language
    usual: str | None  # the language of most training n-grams; decides where no n-gram is known


def fit(texts: DataFrame) -> LanguageFilters:
    """Learns from ``texts(text, lang)``; rows with a null in either teach nothing.

    What reaches the driver is bounded by the languages: each with its count, and a mask a slot for ``MASK_BITS`` of them."""
    bound_batches(texts.sparkSession)
    known = texts.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    counts = known.mapInArrow(_count, "lang string, gram long, uses long").groupBy("lang", "gram").agg(
        F.sum("uses").alias("uses")).cache()
    try:
        totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("uses").alias("total")).collect()}
        languages = sorted(totals)
        masks = np.zeros((-(-len(languages) // MASK_BITS), SLOTS), dtype=np.int64)
        if languages:
            facts = texts.sparkSession.createDataFrame(
                [(name, float(totals[name]), i // MASK_BITS, 1 << i % MASK_BITS) for i, name in enumerate(languages)],
                "lang string, total double, nth int, bit long")
            rates = counts.join(F.broadcast(facts), "lang").select("gram", (F.col("uses") / F.col("total")).alias("rate"), "nth", "bit")
            held = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("rate", "nth", "bit")).alias("by"))
            member = F.filter("by", lambda x: (x["rate"] >= MIN_RATE) & (x["rate"] >= RELATIVE * F.col("top")))
            rows = held.select("gram", F.inline(member)).select("gram", "nth", "bit").mapInArrow(_slot_rows, "slot long, nth int, mask long")
            table = rows.groupBy("slot", "nth").agg(F.bit_or("mask").alias("mask")).toArrow()
            masks[table.column("nth").to_numpy(), table.column("slot").to_numpy()] = table.column("mask").to_numpy()
    finally:
        counts.unpersist()
    filled = np.array([np.count_nonzero((masks[i // MASK_BITS] >> i % MASK_BITS) & 1) / SLOTS for i in range(len(languages))])
    usual = max(languages, key=lambda name: (totals[name], name)) if languages else None
    return LanguageFilters(languages, masks, filled**HASHES, usual)


def _decide(model, width: int, text_at: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = LanguageFilters(**model.value)
        names, wrong = filters.languages, filters.false_positives
        for batch in batches:
            text = batch.column(text_at)
            rows = batch.num_rows
            share, size = np.zeros((rows, len(names))), np.zeros(rows, dtype=np.int64)
            for row, code, first in grams(text):
                here = slice(row, row + len(first) - 1)
                where = slots(code)
                mask = np.bitwise_and.reduce([filters.masks[:, s] for s in where])  # of every n-gram
                size[here] += np.diff(first)
                for i in range(len(names)):
                    ones = np.zeros(len(code) + 1, dtype=np.int64)
                    np.cumsum((mask[i // MASK_BITS] >> i % MASK_BITS) & 1, out=ones[1:])
                    share[here, i] += ones[first[1:]] - ones[first[:-1]]
            share = np.clip((share / np.maximum(size, 1)[:, None] - wrong) / (1 - wrong), 0, 1)
            lettered = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            total = share.sum(axis=1)
            best = share.argmax(axis=1) if names else np.zeros(rows, dtype=np.int64)
            top = share[np.arange(rows), best] if names else np.zeros(rows)
            pick = [
                UNKNOWN if not (ok and names) else names[b] if t > 0 else filters.usual
                for ok, b, t in zip(lettered, best, top)
            ]
            score = np.where(lettered & (total > 0), top / np.where(total > 0, total, 1), 0.0)
            columns = [batch.column(i) for i in range(width)]
            columns += [pa.array(pick, type=pa.string()), pa.array(score), pa.array(np.where(lettered, top, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return decide


def detect(docs: DataFrame, filters: LanguageFilters, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs(text, ...)`` and ``lang_pred``, ``score``, ``coverage``.

    ``lang_pred`` is ``und`` where the text is null or has no letter (or nothing was learnt), the commonest
    learnt language where no n-gram is known; ties go to the first language by name. ``score`` is the best
    language's part of all languages' corrected shares, ``coverage`` its corrected share of the text's n-grams.
    ``columns`` that bear those names are replaced. One row per row, no exchange."""
    bound_batches(docs.sparkSession)
    kept = [c for c in columns if c not in ("lang_pred", "score", "coverage")]
    rows = docs.select(*kept, *([] if "text" in kept else ["text"]))  # the text travels once
    schema = ", ".join(f"c{i} {rows.schema[i].dataType.simpleString()}" for i in range(len(kept)))
    model = docs.sparkSession.sparkContext.broadcast(vars(filters))
    n = len(kept)
    made = f"c{n} string, c{n + 1} double, c{n + 2} double"
    found = rows.mapInArrow(_decide(model, n, rows.columns.index("text")), f"{schema}, {made}" if kept else made)
    return found.toDF(*kept, "lang_pred", "score", "coverage")


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose ``crc32(doc_id) mod 4`` is not 2 and predicts all of them:
    ``(doc_id, held_out, lang_pred, score, coverage)``. A null ``doc_id`` counts as not held out."""
    rows = docs.select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    return detect(rows, fit(rows.where("NOT held_out")), ["doc_id", "held_out"])


def held_out(doc_id: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))
