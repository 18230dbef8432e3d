"""Byte-level BPE: a fold of ranked merges over the corpus's distinct words, and decoding."""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import json
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice
from struct import pack
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, text_of

#: Chunks that a worker process remembers of each kind; beyond that it forgets them and begins again.
CACHE_CHUNKS = 400_000
#: Distinct chunks that a task counts before it passes their words on.
COUNTED = 400_000
#: Characters of a text, words of a text of other patterns, and rows of a result that are held at a time.
SEGMENT, RUN, ROWS = 1 << 20, 100_000, 512
#: Words of at most so many bytes are folded; a fold takes time by the square of them.
FOLD_BYTES = 64
#: Bytes of the folded words that workers are sent at most, those of the most frequent words.
DICTIONARY_BYTES = 64 << 20
#: Bits of an id in a packed pair: vocabularies may have 2**20 ids.
ID_BITS = 20

#: Marks that are words of their own after letters.
MARKS = frozenset(".,;:!?")

_IRREGULAR = re.compile(r"\s\s|\A\s|\s\Z")
#: White space other than the space.
_ODD = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]
_CUT = re.compile(r"\S \S")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return _ranks(lines.read())


def _ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


# The fold, in Spark's own functions


def pair_table(ranks: dict[bytes, int]) -> list[int]:
    """The literal rank map: a hash table of all pairs of pieces whose concatenation is a piece, as packed numbers.

    A pair of ids a, b that merges into id r is a << 40 | b << 20 | r in one of its two slots, the rest is -1.
    """
    pairs = []
    for piece, r in ranks.items():
        for i in range(1, len(piece)):
            a, b = ranks.get(piece[:i]), ranks.get(piece[i:])
            if a is not None and b is not None:
                pairs.append(a << 2 * ID_BITS | b << ID_BITS | r)
    if ranks and max(ranks.values()) >> ID_BITS:
        raise ValueError(f"ids must be below {1 << ID_BITS}")
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    while (table := _placed(pairs, size)) is None:
        size *= 2
    return table


def _slots(key: int, size: int) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(pack("<q", key), 42)
    return h & (size - 1), h >> 32 & (size - 1)


def _placed(entries: list[int], size: int) -> list[int] | None:
    """Each entry in one of the two slots of its pair, moving others to theirs; None if that fails."""
    table = [-1] * size
    for entry in entries:
        at = _slots(entry >> ID_BITS, size)[0]
        for _ in range(200):
            entry, table[at] = table[at], entry
            if entry < 0:
                break
            one, two = _slots(entry >> ID_BITS, size)
            at = two if at == one else one
        else:
            return None
    return table


def fold_merges(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of the UTF-8 bytes of ``word``: each step of a fold merges the leftmost pair of the lowest rank, if any is left.

    The state is the array of ids so far, at first one for each byte; ranks come from the literal ``pair_table``.
    """
    pairs = pair_table(ranks)
    table = F.from_json(F.lit(json.dumps(pairs)), "array<bigint>")
    singles = F.from_json(F.lit(json.dumps([ranks.get(bytes([b])) for b in range(256)])), "array<bigint>")
    mask, low = F.lit(len(pairs) - 1), F.lit((1 << ID_BITS) - 1)
    letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")

    def rank(table: Column, a: Column, b: Column) -> Column:
        key = F.shiftleft(a, ID_BITS).bitwiseOR(b)
        h = F.xxhash64(key)
        one = F.get(table, h.bitwiseAND(mask).cast("int"))
        two = F.get(table, F.shiftrightunsigned(h, 32).bitwiseAND(mask).cast("int"))
        hit = lambda e: F.shiftright(e, ID_BITS) == key
        return F.when(hit(one), one.bitwiseAND(low)).when(hit(two), two.bitwiseAND(low))

    def step(table: Column, ids: Column) -> Column:
        best = F.array_min(F.transform(ids, lambda a, i: F.shiftleft(rank(table, a, F.get(ids, i + 1)), 16).bitwiseOR(i)))
        at = lambda m: m.bitwiseAND(F.lit(0xFFFF)).cast("int")
        joined = lambda m: F.concat(F.slice(ids, F.lit(1), at(m)), F.array(F.shiftright(m, 16)), F.slice(ids, at(m) + 3, F.size(ids)))
        return _bound(best, lambda m: F.when(m.isNull(), ids).otherwise(joined(m)))

    steps = F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2)))
    first = F.transform(letters, lambda c: F.get(singles, F.ascii(c)))
    # the table is bound once: each mention of the literal would be a copy in every plan
    return _bound(table, lambda t: F.aggregate(steps, first, lambda ids, _: step(t, ids)))


def _bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


@contextmanager
def _terse(spark: SparkSession) -> Iterator[None]:
    """Plans of jobs begun here are described without their columns: Spark keeps descriptions as long as the driver
    lives, and each would hold the literal rank map as text, several times.
    """
    key = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        yield
    finally:
        spark.conf.set(key, before)


# Texts as words


class Splitter:
    """Cuts texts into chunks whose words do not depend on what surrounds them.

    With ``spaced`` the pattern's words never reach across the place before a single space that has other
    characters than white space on both sides; texts are cut there, which costs far less than matching words. Letters
    alone, after a space or not, are one word then, and a mark of MARKS that ends a chunk is a word of its own.
    """

    def __init__(self, pattern: str, spaced: bool):
        self.pattern, self.spaced = regex.compile(pattern), spaced
        self.chunk = regex.compile(r"\s*\S+|\s+")

    def runs(self, text: str) -> Iterator[tuple[list[str], list[str]]]:
        """(chunks, then pieces that a space precedes), in order, a bounded number at a time."""
        if not self.spaced:
            found = (m.group() for m in self.pattern.finditer(text))
            while run := list(islice(found, RUN)):
                yield run, []
            return
        start, end = 0, 0
        while end < len(text):
            cut = _CUT.search(text, start + SEGMENT) if len(text) - start > SEGMENT else None
            end = cut.start() + 1 if cut else len(text)
            part = text[start + (start > 0) : end]
            space = [" ", *(x for x in _ODD if x in part)]
            # a search for each pair is faster than the expression, while there are few
            perhaps = len(space) > 2 or part[0].isspace() or part[-1].isspace() or any(a + b in part for a in space for b in space)
            if perhaps and _IRREGULAR.search(part):
                yield self.chunk.findall(text[start:end]), []
            else:
                pieces = part.split(" ")
                yield ([], pieces) if start else (pieces[:1], pieces[1:])
            start = end

    def words(self, lead: str, chunk: str) -> list[str]:
        """The words of a chunk that ``lead``, a space or nothing, precedes."""
        if not self.spaced:
            return [chunk]
        if chunk.isalpha():
            return [lead + chunk]
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return [lead + chunk[:-1], chunk[-1]]
        return self.pattern.findall(lead + chunk)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the leftmost pair of the lowest rank merges until none is left. O(n log n)."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    rank_of = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := rank_of(word[i : ends[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, ends[after[j]]))
        if (h := before[i]) >= 0 and (r := rank_of(word[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    return [ranks[word[i : ends[i]]] for i in range(n) if alive[i]]


# The dictionary of folded words


class Folded(NamedTuple):
    """Words and their ids by the hash of the word, sorted, with the first place of each hash prefix."""

    keys: bytes
    starts: bytes
    words: tuple[bytes, bytes]  # ends, then the bytes themselves
    ids: tuple[bytes, bytes]
    bits: int

    @staticmethod
    def of(table: pa.Table) -> Folded:
        keys = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys, table = keys[order], table.select(["word", "ids"]).take(pa.array(order)).combine_chunks()
        bits = max(1, len(keys).bit_length())
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        starts = np.r_[np.searchsorted(keys, edges), len(keys)].astype(np.uint32)
        del edges, order
        words, lists = table.column("word").combine_chunks().cast(pa.binary()), table.column("ids").combine_chunks()
        ends = lambda x: np.cumsum(x).astype(np.uint32).tobytes()
        sizes = pc.binary_length(words).to_numpy()
        return Folded(
            keys.tobytes(), starts.tobytes(), (ends(sizes), words.buffers()[2].to_pybytes()),
            (ends(lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.uint32).tobytes()), bits,
        )


def _count_batches(splitter: Splitter, ranks: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words that are no piece themselves and not too long to fold."""
    plain, spaced = Counter(), Counter()

    def counted() -> pa.RecordBatch:
        words: dict[str, int] = {}
        for lead, chunks in (("", plain), (" ", spaced)):
            for chunk, n in chunks.items():
                for word in splitter.words(lead, chunk):
                    words[word] = words.get(word, 0) + n
            chunks.clear()
        kept = [w for w in words if (b := w.encode()) not in ranks and len(b) <= FOLD_BYTES]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(list(map(words.__getitem__, kept)), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            for chunks, pieces in splitter.runs(text.as_py()):
                plain.update(chunks)
                spaced.update(pieces)
                if len(plain) + len(spaced) > COUNTED:
                    yield counted()
    yield counted()


def distinct_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, spaced: bool) -> DataFrame:
    """(word, n): the distinct words of the texts, without those that are pieces or longer than FOLD_BYTES."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _count_batches(Splitter(pattern, spaced), sent.value, batches)

    counted = docs.select(text_of().alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def fold(docs: DataFrame, ranks: dict[bytes, int], pattern: str, spaced: bool, limit: int | None = None) -> Folded | None:
    """The distinct words of the corpus with their ids by ``fold_merges``, to be sent to the workers.

    Their size grows with the corpus, so it is checked: only the most frequent words, by powers of two of their
    number, whose entries are sure to fit in ``limit`` bytes (DICTIONARY_BYTES) are folded. Workers merge the others as they meet
    them, with the same ids. The words to fold are written first, so that the plan with the literal rank map is one
    stage without a shuffle, which Spark neither plans nor describes again while it runs.
    """
    spark = docs.sparkSession
    words = materialize(distinct_words(docs, ranks, pattern, spaced).withColumn("level", F.floor(F.log2("n"))))
    size = F.lit(24) + 5 * F.octet_length("word")
    levels = words.groupBy("level").agg(F.sum(size).alias("size"), F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    held, count, least = 0, 0, None
    for r in levels:
        if held + r["size"] > (DICTIONARY_BYTES if limit is None else limit):
            break
        held, count, least = held + r["size"], count + r["n"], r["level"]
    if not count:
        release(words)
        return None
    # few bytes, much work for each: dealt out by number, not by size
    chosen = materialize(words.where(F.col("level") >= least).select("word").repartition(max(1, -(-count // 20_000)), "word"))
    release(words)
    with _terse(spark):
        found = Folded.of(chosen.select("word", F.xxhash64("word").alias("h"), fold_merges(F.col("word"), ranks).cast("array<int>").alias("ids")).toArrow())
    pa.default_memory_pool().release_unused()
    release(chosen)
    return found


# Whole texts


class _Known(dict):
    """The encoding of chunks met lately, made when it is missing."""

    def __init__(self, codec: Codec, lead: str):
        super().__init__()
        self.codec, self.lead = codec, lead

    def __missing__(self, chunk: str) -> tuple[bytes, ...]:
        made = self.codec.encoded(self.lead, chunk)
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        if len(chunk) <= FOLD_BYTES:
            self[chunk] = made
        return made


class Codec:
    """Encodes and decodes in one process. Of each chunk it gives the ids as decimals, each after a space, and the bytes
    that they decode to, if ``digest``; and the ids as 32-bit numbers, if ``packed``.
    """

    def __init__(self, ranks: dict[bytes, int], splitter: Splitter, folded: Folded | None, digest: bool = True, packed: bool = True):
        self.ranks, self.splitter, self.digest, self.packed = ranks, splitter, digest, packed
        self.pieces = {i: p for p, i in ranks.items()}
        self.decimals = {i: b" %d" % i for i in self.pieces}
        self.plain, self.spaced = _Known(self, ""), _Known(self, " ")
        self.shift = None
        if folded:
            view = lambda x, kind: memoryview(x).cast(kind)
            self.keys, self.starts, self.shift = view(folded.keys, "Q"), view(folded.starts, "I"), 64 - folded.bits
            self.word_ends, self.words, self.id_ends, self.ids = view(folded.words[0], "I"), folded.words[1], view(folded.ids[0], "I"), view(folded.ids[1], "I")

    def looked_up(self, word: bytes) -> list[int] | None:
        """The ids of a folded word."""
        if self.shift is None:
            return None
        h = xxhash.xxh64_intdigest(word, 42)
        slot = h >> self.shift
        for k in range(self.starts[slot], self.starts[slot + 1]):
            if self.keys[k] == h and self.words[self.word_ends[k] - len(word) : self.word_ends[k]] == word:
                return self.ids[self.id_ends[k - 1] if k else 0 : self.id_ends[k]].tolist()
        return None

    def encoded(self, lead: str, chunk: str) -> tuple[bytes, ...]:
        ids: list[int] = []
        for word in self.splitter.words(lead, chunk):
            said = word.encode()
            if (r := self.ranks.get(said)) is not None:
                ids.append(r)
            else:
                ids += self.looked_up(said) or merge(said, self.ranks)
        out = (b"".join([self.decimals[i] for i in ids]), self.decode(ids)) if self.digest else ()
        return (*out, array("i", ids).tobytes()) if self.packed else out

    def encode(self, text: str) -> Iterator[list[tuple[bytes, ...]]]:
        for chunks, pieces in self.splitter.runs(text):
            yield [*map(self.plain.__getitem__, chunks), *map(self.spaced.__getitem__, pieces)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


_codecs: dict[str, Codec] = {}


def encode(docs: DataFrame, vocabulary: str, pattern: str, ids: bool = True, count: bool = False, digest: bool = False, spaced: bool = False) -> DataFrame:
    """The rows of ``docs`` without text, with ``ids`` (array<int>), ``n_tokens``, or digests of ids and decoded bytes.

    ``vocabulary`` is a rank file on the driver; its bytes go to the workers, a bound set by the file. Each
    match of ``pattern`` is encoded by itself; what no match covers is left out. ``spaced`` promises that
    ``pattern`` is of the kind that Splitter cuts at spaces. The distinct words of all texts are folded first
    (``fold``) and looked up then; words too long or too rare for that are merged where they occur. A null text
    is empty and has no ids. Long texts are encoded in runs, and digests are updated run by run. Repeated rows
    stay; an empty table gives no rows; other columns stay unless they have a name of those added.
    """
    with open(vocabulary, "rb") as f:
        lines = f.read()
    folded = fold(docs.select("text"), _ranks(lines), pattern, spaced)
    sent, name = docs.sparkSession.sparkContext.broadcast((lines, folded)), uuid.uuid4().hex
    keep = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "ids_sha256", "decoded_sha256")]
    made = {"ids": "ids array<int>"} if ids else {}
    if count or digest:
        made["n_tokens"] = "n_tokens long"
    if digest:
        made |= {c: f"{c} string" for c in ("ids_sha256", "decoded_sha256")}
    packed = ids or not digest
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _codecs:
            _codecs.clear()
            _codecs[name] = Codec(_ranks(sent.value[0]), Splitter(pattern, spaced), sent.value[1], digest, packed)
        codec = _codecs[name]
        gc.disable()  # it would look through the remembered chunks again and again; none of them is in a cycle
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            sizes, held, said, read = [], [], [], []
            for text in batch.column("__text"):
                n, ids_hash, read_hash = 0, hashlib.sha256(), hashlib.sha256()
                for part in codec.encode(text.as_py()):
                    if digest:
                        decimals = b"".join([x[0] for x in part])
                        ids_hash.update(decimals if n else decimals[1:])
                        read_hash.update(b"".join([x[1] for x in part]))
                    if packed:
                        numbers = b"".join([x[-1] for x in part])
                        if ids:
                            held.append(numbers)
                    n += len(numbers) // 4 if packed else decimals.count(b" ")
                sizes.append(n)
                said.append(ids_hash.hexdigest())
                read.append(read_hash.hexdigest())
            columns = {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(said, pa.string()), "decoded_sha256": pa.array(read, pa.string())}
            if ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(held), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [columns[c] for c in made], [*keep, *made])

    return docs.select(*keep, text_of().alias("__text")).mapInArrow(run, ", ".join([*kinds, *made.values()]))


def decode(df: DataFrame, vocabulary: str) -> DataFrame:
    """``df`` with ``decoded`` (binary) for its ``ids``: the pieces of the ids, concatenated by Spark.

    The pieces are a literal array by id, so its size is the vocabulary's. An id outside it raises an error.
    """
    ranks = load_ranks(vocabulary)
    size = max(ranks.values()) + 1
    table = [""] * size
    for piece, i in ranks.items():
        table[i] = piece.hex()
    pieces = F.from_json(F.lit(json.dumps(table)), "array<string>")
    return df.withColumn("decoded", F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at(pieces, i + 1)), "")))
