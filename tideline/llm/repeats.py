"""Exact removal of repeated 200-byte strings through a prefix-free parse of the corpus and its dictionary's suffix array."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, release, text_of, text_tag

#: Bytes of a repeated string, and of the rolling hash whose minima trigger phrases.
LENGTH, GRAM = 200, 32
#: Phrases of one trigger that are sorted in one task at most; windows of more are dealt out by their hashes.
CROWD = 4096
#: Phrases that occur more often are found by a broadcast of them, if its size allows, as no task should hold all their places.
COMMON = 1000
#: Bytes of phrases that are sorted together.
SORTED = 1 << 22
_CHUNK = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        with np.errstate(over="ignore"):
            table = np.full(n, base, _U)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers[name][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


class Rolling:
    """Hashes modulo 2**64 of any substring of some bytes, each byte mapped to a random odd number first.

    Strings this short can't exploit the modulus: its known collisions need at least 1024 bytes, and longer
    phrases take part only together with their trigger and length.
    """

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.inverse = _power("inverse", pow(_BASE, -1, 1 << 64), n)
        self.sums = np.zeros(n, _U)
        np.cumsum(_VALUES[data] * _power("base", _BASE, n)[:-1], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(_U).max, _U)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _phrases(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, counts, leads (bytes before the trigger), triggers and hashes of the phrases of ``data`` (at least LENGTH bytes).

    A phrase is the run of LENGTH-byte windows whose smallest GRAM-byte hash is the same occurrence. The
    trigger is chosen by each window's own bytes, so equal windows lie at equal places of phrases with equal
    triggers. Phrases overlap by LENGTH - 1 bytes; each window belongs to one.
    """
    rolling = Rolling(data)
    with np.errstate(over="ignore"):
        n = len(data)
        at = np.arange(n - GRAM + 1)
        grams = _mix(rolling.at(at, at + GRAM))
        packed = (grams & _U(0xFFFFFFFFFF000000)) | at.astype(_U)
        least = _sliding_minimum(packed, LENGTH - GRAM + 1)
        trigger = (least & _U(0xFFFFFF)).astype(np.int64)
        starts = np.r_[0, np.flatnonzero(np.diff(trigger)) + 1]
        counts = np.diff(np.r_[starts, n - LENGTH + 1])
        gram = grams[trigger[starts]]
        whole = rolling.at(starts, starts + counts + LENGTH - 1)
        whole = _mix(whole ^ _mix(counts.astype(_U) + gram))
    return starts, counts, trigger[starts] - starts, gram, whole


def _chunks(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of pieces that overlap by LENGTH - 1 bytes: each window lies in one piece."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - LENGTH + 1, _CHUNK):
        yield start, data[start : start + _CHUNK + LENGTH - 1]


def _rows(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column(name).cast(pa.large_binary())]


class _Rows:
    """Collects rows as arrays for each text and gives them out as record batches of bounded size."""

    def __init__(self, batch: pa.RecordBatch, names: list[str], limit: int = 100_000):
        self.batch, self.names, self.limit = batch, names, limit
        self.clear()

    def clear(self) -> None:
        self.at: list[int] = []
        self.sizes: list[int] = []
        self.columns: list[list[np.ndarray]] = [[] for _ in self.names]
        self.held = 0

    def add(self, row: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.at.append(row)
        self.sizes.append(len(columns[0]))
        for store, x in zip(self.columns, columns):
            store.append(x)
        self.held += len(columns[0])
        if self.held >= self.limit:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = pa.array(np.repeat(np.array(self.at, np.int64), np.array(self.sizes, np.int64)))
            made = [pa.array(x.view(np.int64) if x.dtype == _U else x) for x in map(np.concatenate, self.columns)]
            yield pa.RecordBatch.from_arrays([*(self.batch.column(c).take(rows) for c in ("doc_id", "tag")), *made], ["doc_id", "tag", *self.names])
            self.clear()


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = _Rows(batch, ["start", "windows", "lead", "gram", "phrase"])
        for i, text in enumerate(_rows(batch)):
            for offset, data in _chunks(text):
                starts, counts, leads, grams, phrases = _phrases(data)
                yield from out.add(i, (starts + offset).astype(np.int32), counts.astype(np.int32), leads.astype(np.int32), grams, phrases)
        yield from out.rest()


def parse(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, start, windows, lead, gram, phrase): the phrases of each text, by row content (doc_id, tag)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_tag().alias("tag"), text_of().alias("text")).where(F.octet_length("text") >= LENGTH)
    return rows.mapInArrow(_parse_batches, f"doc_id {kind}, tag long, start int, windows int, lead int, gram long, phrase long")


def _phrase_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each given phrase."""
    names = ["gram", "start", "lead", "alone", "bytes"]
    for batch in batches:
        at, out, held = [], [[] for _ in names], 0
        parts = batch.column("parts").to_pylist()

        def rows() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "tag")]
            return pa.RecordBatch.from_arrays([*keys, *map(pa.array, out, kinds)], ["doc_id", "tag", *names])

        for i, text in enumerate(_rows(batch)):
            for x in parts[i]:
                data = text[x["start"] : x["start"] + x["windows"] + LENGTH - 1]
                at.append(i)
                for column, v in zip(out, (x["gram"], x["start"], x["lead"], x["alone"], data)):
                    column.append(v)
                held += len(data)
            if held > SORTED:
                yield rows()
                at, out, held = [], [[] for _ in names], 0
        yield rows()


def repeated_suffixes(phrases: list[bytes], leads: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, window) of each window that is equal to one of another phrase of its group, with the same lead.

    The suffixes of the phrases are sorted by group, by distance from the trigger and by their bytes, eight at a
    time; those that are alone after some bytes leave the order, and those that agree on LENGTH bytes are left.
    """
    data = np.frombuffer(b"".join(phrases) + bytes(8), np.uint8)
    words = np.zeros(len(data) - 7, _U)
    for i in range(8):
        words |= data[i : i + len(words)].astype(_U) << _U(56 - 8 * i)
    sizes = np.array([len(x) for x in phrases], np.int64)
    windows = sizes - LENGTH + 1
    starts = np.cumsum(sizes) - sizes
    phrase = np.repeat(np.arange(len(phrases)), windows)
    window = np.arange(len(phrase)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[phrase] + window
    kind = groups[phrase].astype(np.int64) * (int(leads.max(initial=0)) + 1) + leads[phrase] - window
    for k in range(LENGTH // 8):
        word = words[at + 8 * k]
        order = np.lexsort((word, kind))
        kind, word, phrase, window, at = (x[order] for x in (kind, word, phrase, window, at))
        new = np.r_[True, (kind[1:] != kind[:-1]) | (word[1:] != word[:-1])][: len(kind)]
        kind = np.cumsum(new)
        kept = ~(new & np.r_[new[1:], True][: len(new)])
        kind, phrase, window, at = (x[kept] for x in (kind, phrase, window, at))
        if not len(kind):
            break
    return phrase, window


def _suffix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, start, end) of the repeated windows of phrases that occur once; the rows come sorted by gram."""
    held: list[pa.RecordBatch] = []

    def sort(rows: pa.RecordBatch) -> pa.RecordBatch:
        grams = rows.column("gram").to_numpy()
        groups = np.cumsum(np.r_[True, grams[1:] != grams[:-1]])
        bytes_ = [x.as_buffer().to_pybytes() for x in rows.column("bytes")]
        phrase, window = repeated_suffixes(bytes_, rows.column("lead").to_numpy(), groups)
        kept = rows.column("alone").to_numpy(zero_copy_only=False)[phrase]
        order = np.lexsort((window[kept], phrase[kept]))
        phrase, window = phrase[kept][order], window[kept][order]
        # windows that follow one another are one interval
        first = np.r_[True, (phrase[1:] != phrase[:-1]) | (window[1:] != window[:-1] + 1)][: len(phrase)]
        last = np.r_[first[1:], True][: len(phrase)]
        of, from_ = pa.array(phrase[first]), rows.column("start").to_numpy()[phrase[first]].astype(np.int64)
        columns = [rows.column(c).take(of) for c in ("doc_id", "tag")]
        ends = from_ + window[last] + LENGTH
        return pa.RecordBatch.from_arrays([*columns, pa.array(from_ + window[first], pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "tag", "start", "end"])

    for batch in batches:
        for k in range(0, batch.num_rows, CROWD):
            held.append(batch.slice(k, CROWD))
            if sum(b.nbytes for b in held) < SORTED:
                continue
            rows = pa.concat_batches(held)
            grams = rows.column("gram").to_numpy()
            whole = int(np.searchsorted(grams, grams[-1]))  # the last trigger's phrases may go on
            if whole:
                yield sort(rows.slice(0, whole))
            held = [rows.slice(whole)]
    if held and sum(b.num_rows for b in held):
        yield sort(pa.concat_batches(held))


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each window of each given phrase; those that phrases of a batch share are known to be repeated
    (``known``) and come once more, as ``known`` without a place, to be met by other batches' windows.
    """
    for batch in batches:
        parts, out = batch.column("parts").to_pylist(), _Rows(batch, ["start", "alone", "phrase", "one", "two"], 1 << 62)
        for i, text in enumerate(_rows(batch)):
            data = np.frombuffer(text, np.uint8)
            for x in parts[i]:
                start, n = x["start"], x["windows"]
                at = np.arange(n)
                rolling = Rolling(data[start : start + n + LENGTH - 1])
                with np.errstate(over="ignore"):
                    one = _mix(rolling.at(at, at + LENGTH) + _U(x["gram"] % (1 << 64)))
                    # a hash of its two halves, which no sum of the first tells
                    two = _mix(_mix(rolling.at(at, at + LENGTH // 2)) * _U(_BASE) + rolling.at(at + LENGTH // 2, at + LENGTH))
                full = lambda v, kind: np.full(n, v, kind)
                list(out.add(i, (start + at).astype(np.int32), full(x["alone"], bool), full(x["phrase"], np.int64), one, two))
        for rows in out.rest():
            one, two, phrase = (rows.column(c).to_numpy() for c in ("one", "two", "phrase"))
            order = np.lexsort((phrase, two, one))
            new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])][: len(order)]
            kind = np.cumsum(new) - 1
            low = phrase[order][np.flatnonzero(new)]
            high = phrase[order][np.r_[np.flatnonzero(new)[1:] - 1, len(order) - 1]]
            known = np.empty(len(order), bool)
            known[order] = (low != high)[kind]
            first = np.zeros(len(order), bool)
            first[order] = new
            alone = rows.column("alone").to_numpy(zero_copy_only=False)
            # a known window says so once for its place and once for all batches; others are rows to be decided
            kept = np.flatnonzero((known & alone) | first | (~known & alone))
            picked = rows.take(pa.array(kept))
            columns = [picked.column(c) for c in ("doc_id", "tag", "start", "alone", "phrase", "one", "two")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(known[kept]), pa.array(first[kept])], ["doc_id", "tag", "start", "alone", "phrase", "one", "two", "known", "first"])


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of what is left of each text after its intervals (starts, ends) are removed."""
    for batch in batches:
        n_removed, n_spans, digest, sizes = [], [], [], []
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        for text, s, e in zip(_rows(batch), starts, ends):
            spans = merged(s or [], e or [])
            hashed, last = hashlib.sha256(), 0
            view = memoryview(text)
            for a, b in spans:
                hashed.update(view[last:a])
                last = b
            hashed.update(view[last:])
            sizes.append(len(text))
            n_removed.append(sum(b - a for a, b in spans))
            n_spans.append(len(spans))
            digest.append(hashed.hexdigest())
        cols = [pa.array(x, pa.int64()) for x in (sizes, n_removed, n_spans)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _with_text(docs: DataFrame, parts: DataFrame, part, run, schema: str) -> DataFrame:
    """``run`` over the texts of ``docs`` and, as ``parts``, the rows of ``parts`` for each."""
    grouped = parts.groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(F.collect_list(part).alias("parts"))
    texts = docs.select("doc_id", text_tag().alias("tag"), text_of().alias("text"))
    texts = texts.join(grouped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "tag", "text", "parts").mapInArrow(run, f"doc_id {kind}, tag long, {schema}")


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, starts, ends): byte intervals covered by LENGTH-byte strings that start elsewhere too.

    1. Parse: each window lies in one phrase, and equal windows lie at equal distance from equal triggers. Phrases
       go to the shared folder as hashes, without text.
    2. The dictionary: distinct phrases and how often the parse has them. All windows of one that occurs again are
       repeated.
    3. One that occurs once may share windows with other phrases of its trigger. The suffixes of a trigger's
       phrases are sorted by their bytes; neighbours that agree on LENGTH bytes are repeated. Phrases overlap by
       LENGTH - 1 bytes, so no suffix needs to go on into the phrases that follow in the parse: in the corpus's order a
       suffix of the dictionary stands for as many places as its phrase has.
    4. A trigger of more than CROWD phrases is too much for a task. Its windows are dealt out by 128 bits of hashes.

    Phrases are told apart by their 64-bit hashes together with those of their triggers.
    """
    phrases = materialize(parse(docs))
    place = F.struct("doc_id", "tag", "start", "windows", "lead")
    counted = materialize(phrases.groupBy("gram", "phrase").agg(F.count("*").alias("n"), F.min(place).alias("first")).select("gram", "phrase", "n", "first.*"))
    found = [materialize(_places_of(phrases, counted.where("n > 1")))]
    release(phrases)

    # only triggers of several phrases have something to compare; those of one are most of all
    mixed = materialize(counted.groupBy("gram").agg(F.count("*").alias("phrases")).where("phrases > 1"))
    crowded = checked_broadcast(mixed.where(F.col("phrases") > CROWD))
    sparse = counted.join(crowded.select("gram"), "gram", "left_anti").join(mixed.where(F.col("phrases") <= CROWD), "gram")
    dictionary = materialize(sparse.unionByName(counted.join(crowded, "gram")))
    release(counted, mixed)
    part = F.struct("gram", "phrase", "start", "windows", "lead", (F.col("n") == 1).alias("alone"))
    few = _with_text(docs, dictionary.where(F.col("phrases") <= CROWD), part, _phrase_batches, "gram long, start int, lead int, alone boolean, bytes binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found.append(few.repartition("gram").sortWithinPartitions("gram").mapInArrow(_suffix_batches, f"doc_id {kind}, tag long, start int, end int"))
    crowd = dictionary.where(F.col("phrases") > CROWD)
    windows = None
    if not crowd.isEmpty():
        schema = "start int, alone boolean, phrase long, one long, two long, known boolean, first boolean"
        windows = materialize(_with_text(docs, crowd, part, _window_batches, schema))
        end = (F.col("start") + LENGTH).alias("end")
        found.append(windows.where("alone and known").select("doc_id", "tag", "start", end))
        met = windows.where("first").groupBy("one", "two").agg(F.min("phrase").alias("low"), F.max("phrase").alias("high"), F.bool_or("known").alias("known"))
        met = met.where("known or low <> high").select("one", "two")
        found.append(windows.where("alone and not known").join(met, ["one", "two"], "left_semi").select("doc_id", "tag", "start", end))

    spans = reduce(DataFrame.union, found).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("at"))
    spans = materialize(spans.select("doc_id", "tag", F.col("at.start").alias("starts"), F.col("at.end").alias("ends")))
    release(found[0], dictionary, *([windows] if windows is not None else []))
    return spans


def _places_of(phrases: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, tag, start, end) of all occurrences of the phrases that ``repeated`` (gram, phrase, n) names."""
    keys, end = ["gram", "phrase"], (F.col("start") + F.col("windows") + LENGTH - 1).alias("end")
    rare = repeated.where(F.col("n") <= COMMON).select(*keys)
    common = checked_broadcast(repeated.where(F.col("n") > COMMON).select(*keys))
    rows = phrases.join(common, keys, "left_semi").union(phrases.join(common, keys, "left_anti").join(rare, keys, "left_semi"))
    return rows.select("doc_id", "tag", "start", end)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``.

    Texts are UTF-8 bytes; a null text is empty. A byte goes if a LENGTH-byte string that covers it also
    starts anywhere else, in its own text or another's, judged on the input. Repeated rows repeat each other.
    Texts shorter than LENGTH bytes keep all; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = repeated_intervals(docs).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "starts", "ends")
    rows = docs.select("doc_id", text_tag().alias("tag"), text_of().alias("text"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag")), "left")
    return rows.select("doc_id", "text", "starts", "ends").mapInArrow(_cut_batches, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
