"""Token ids in succinct shards: a wavelet matrix for each run of documents, kept in one compressed file image.

File image (version 2, little-endian): the magic bytes, then a header of unsigned 64-bit numbers (documents, tokens,
planes, and the stored length of each of three sections), then the sections, each compressed with zstandard: document
ids (signed 64-bit), a byte for each that is 1 where the id is null, and document lengths (unsigned 64-bit). For each plane
follow, for each chunk of 65,536 bits, the ones in it and its stored length (unsigned 64-bit each: the directory for rank and
select), and after all these the chunks, plane by plane, each compressed on its own, or as it is where that isn't shorter.
So an access, a count or a lookup opens only the chunks that it needs.
Planes run from the most significant bit down; below each, ids with a zero stand before ids with a one, in order.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, kept_by_worker, small_join, work_dir

MAGIC = b"LATWM002"
_SHIFT = 16  # bits of a position inside a chunk
_BYTES = 1 << _SHIFT >> 3
_BLOCK = 8  # 64-bit words for one entry of a chunk's own rank directory


class _Plane:
    """Bits with rank and select in a few steps; all arguments and results may be arrays. Chunks are opened when needed."""

    def __init__(self, n: int, ones: list[int], stored: list):
        """ones: in each chunk; stored: each chunk's bits, packed (an array) or as in a file image (bytes)."""
        self.n, self.stored = n, stored
        self.before = np.concatenate(([0], np.cumsum(ones, dtype=np.int64)))
        self.zeros = n - int(self.before[-1])
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, bits: np.ndarray) -> _Plane:
        stored = [np.packbits(bits[i : i + (1 << _SHIFT)], bitorder="little") for i in range(0, len(bits), 1 << _SHIFT)]
        ones = [np.count_nonzero(bits[i : i + (1 << _SHIFT)]) for i in range(0, len(bits), 1 << _SHIFT)]
        return cls(len(bits), ones, stored)

    def packed(self, c: int) -> np.ndarray:
        """The bits of chunk c."""
        own = self.stored[c]
        if isinstance(own, np.ndarray):
            return own
        size = (min(self.n, (c + 1) << _SHIFT) - (c << _SHIFT) + 7) >> 3
        return np.frombuffer(own if len(own) == size else zstandard.ZstdDecompressor().decompress(own), np.uint8)

    def _chunk(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, ones before each block of words), with an empty block behind."""
        if c not in self._open:
            own = self.packed(c) if c < len(self.stored) else np.zeros(0, np.uint8)
            words = np.concatenate([own, np.zeros(-len(own) % (8 * _BLOCK) + 8 * _BLOCK, np.uint8)]).view("<u8")
            ones = np.bitwise_count(words).astype(np.int64).reshape(-1, _BLOCK).sum(1)
            self._open[c] = words, np.cumsum(ones) - ones
        return self._open[c]

    def bits(self) -> np.ndarray:
        parts = [self.packed(c) for c in range(len(self.stored))]
        return np.unpackbits(np.concatenate(parts) if parts else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)

    def _by_chunk(self, i, inside):
        """inside(words, blocks, positions in the chunk, chunk) for each chunk that positions i lie in, put together."""
        i = np.asarray(i, np.int64)
        flat, out = i.ravel(), np.zeros(i.size, np.int64)
        where = flat >> _SHIFT
        for c in np.unique(where).tolist():
            own = where == c
            out[own] = inside(*self._chunk(c), flat[own] & ((1 << _SHIFT) - 1), c)
        return out.reshape(i.shape)

    def bit(self, i):
        return self._by_chunk(i, lambda words, _, at, c: (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64))

    def rank1(self, i):
        """Ones before position i (0 to n)."""

        def inside(words, blocks, at, c):
            word, block = at >> 6, (at >> 6) // _BLOCK
            out = self.before[min(c, len(self.before) - 1)] + blocks[block]
            for k in range(_BLOCK - 1):
                out = out + np.where(block * _BLOCK + k < word, np.bitwise_count(words[block * _BLOCK + k]), 0)
            return out + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

        return self._by_chunk(i, inside)

    def rank0(self, i):
        return np.asarray(i, np.int64) - self.rank1(i)

    def select(self, k, bit: int):
        """Position of the k-th (from 0) one or zero; k must be in range. The directory names the chunk, bisection over rank
        the place in it."""
        k = np.asarray(k, np.int64)
        ahead = self.before if bit else np.minimum(np.arange(len(self.before)) << _SHIFT, self.n) - self.before
        c = np.searchsorted(ahead, k, "right") - 1
        low, high = c << _SHIFT, np.minimum((c + 1) << _SHIFT, self.n)
        rank = self.rank1 if bit else self.rank0
        while np.any(low + 1 < high):
            mid = (low + high) >> 1
            below = rank(mid) <= k
            low, high = np.where(below & (low + 1 < high), mid, low), np.where(below | (low + 1 >= high), high, mid)
        return low


class WaveletMatrix:
    """A sequence of unsigned ids with access, counting and occurrence lookup."""

    def __init__(self, planes: list[_Plane], n: int):
        self.planes, self.n = planes, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        x = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes = []
        for b in range(depth - 1, -1, -1):
            bits = (x & x.dtype.type(1 << b)) != 0
            planes.append(_Plane.of(bits))
            # By places: masks take longer where bits are mixed.
            x = np.concatenate((x[np.flatnonzero(~bits)], x[np.flatnonzero(bits)]))
        return cls(planes, len(ids))

    def __len__(self) -> int:
        return self.n

    def to_array(self) -> np.ndarray:
        """All ids at once: the planes are undone from the last to the first."""
        depth = len(self.planes)
        x = np.zeros(self.n, np.uint16 if depth <= 16 else np.uint32)
        for b, plane in enumerate(reversed(self.planes)):
            bits, zeros = plane.bits(), plane.zeros
            up = np.empty_like(x)
            up[np.flatnonzero(~bits)] = x[:zeros]
            up[np.flatnonzero(bits)] = x[zeros:] | x.dtype.type(1 << b)
            x = up
        return x.astype(np.uint32)

    def access(self, i):
        """The ids at positions i."""
        i, out = np.asarray(i, np.int64), np.zeros(np.shape(i), np.int64)
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.rank1(i)
            out = out << 1 | bit
            i = np.where(bit == 1, plane.zeros + ones, i - ones)
        return out

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        depth = len(self.planes)
        if symbol < 0 or symbol >> depth:
            return 0, 0
        for k, plane in enumerate(self.planes):
            ends = plane.rank1(np.array([low, high]))
            low, high = (plane.zeros + ends if symbol >> (depth - 1 - k) & 1 else np.array([low, high]) - ends).tolist()
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol stands before position i."""
        return self.count(symbol, 0, i)

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        low, high = self._range(symbol, low, self.n if high is None else high)
        return high - low

    def occurrences(self, symbol: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ascending positions of symbol in [low, high), by select on the way up."""
        low, high = self._range(symbol, low, self.n if high is None else high)
        at = np.arange(low, high)
        depth = len(self.planes)
        for k in range(depth - 1, -1, -1):
            plane, bit = self.planes[k], symbol >> (depth - 1 - k) & 1
            at = plane.select(at - plane.zeros if bit else at, bit)
        return at

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of symbol."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        return int(self.occurrences(symbol)[k])


class Shard:
    """Documents in order, their ids in one wavelet matrix."""

    def __init__(self, doc_ids: list, lengths: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.lengths, self.matrix = doc_ids, lengths, matrix
        self.starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))

    @classmethod
    def build(cls, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> Shard:
        return cls(doc_ids, np.asarray(lengths, np.int64), WaveletMatrix.build(ids))

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document by random access."""
        return self.matrix.access(np.arange(self.starts[k], self.starts[k + 1]))

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        null = np.array([x is None for x in self.doc_ids], np.uint8)
        ids = np.array([x or 0 for x in self.doc_ids], "<i8")
        sections = [pack(x.tobytes()) for x in (ids, null, self.lengths.astype("<u8"))]
        head = [len(self.doc_ids), self.matrix.n, len(self.matrix.planes), *map(len, sections)]
        directory, stored = [], []
        for plane in self.matrix.planes:
            for c in range(len(plane.stored)):
                own = plane.packed(c).tobytes()
                short = pack(own)
                stored.append(short if len(short) < len(own) else own)
                directory += [int(plane.before[c + 1] - plane.before[c]), len(stored[-1])]
        return b"".join([MAGIC, np.array(head, "<u8").tobytes(), *sections, np.array(directory, "<u8").tobytes(), *stored])

    @classmethod
    def from_bytes(cls, image: bytes) -> Shard:
        """Opens an image; planes stay compressed until they are asked."""
        if image[:8] != MAGIC:
            raise ValueError("not a token shard")
        _, tokens, depth, *sizes = np.frombuffer(image, "<u8", 6, 8).tolist()
        open_, at, parts = zstandard.ZstdDecompressor().decompress, 56, []
        for n in sizes:
            parts.append(open_(image[at : at + n]))
            at += n
        per = -(-tokens >> _SHIFT) if tokens else 0
        directory = np.frombuffer(image, "<u8", 2 * per * depth, at).astype(np.int64).reshape(depth, per, 2)
        at += directory.size * 8
        view, planes = memoryview(image), []
        for own in directory:
            stored = []
            for n in own[:, 1].tolist():
                stored.append(view[at : at + n])
                at += n
            planes.append(_Plane(tokens, own[:, 0].tolist(), stored))
        ids, null = np.frombuffer(parts[0], "<i8").tolist(), parts[1]
        return cls([None if z else x for x, z in zip(ids, null, strict=True)], np.frombuffer(parts[2], "<u8").astype(np.int64), WaveletMatrix(planes, tokens))


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops blanks and splits at them, remembering the ids of words.

    Valid for tokenizers whose normalizer composes (NFC) and lower-cases and, like the pre-tokenizer, never joins characters
    across ASCII blanks, which splits runs of letters from runs of ASCII punctuation, and whose model ends each pre-token with
    end_mark. Whether a tokenizer is one is looked up in its description and tried on PROBES; any other encodes whole texts.
    Arrow splits the texts and finds their different words, so that each of these is looked up once for a chunk of texts. Words that
    are letters once normalised, with punctuation (no apostrophe) at their end or none, are taken apart, their letters
    encoded many at a time and cut at end_mark; all others are encoded one by one. Letters of LETTERS are lower-cased one by one,
    which NFC leaves as they are: they need no normalizer, and no pattern to find where they end. Memory is bounded: beyond limit
    words, all are forgotten.
    """

    PROBES = ("The cat's tail, it\u2019s   on\tthe mat.\nEnd!", "\u0130@ \u0958. \u00dcn\u00ef na\u00efve; Stra\u00dfe! \u0391\u03a3, e\u0301a?", "don't WE'LL 12,5 x_1 (a) $%& __a__ end", "a.b c\u00a0d\u3000e\x85f <|x|>")

    PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'

    #: The Latin letters before U+0250, but for the one whose lower case is two characters.
    LETTERS = "".join(x for x in map(chr, range(0x250)) if x.isalpha() and x != "\u0130")

    _TOGETHER = 64  # words in a text for the tokenizer, and texts in a call

    def __init__(self, path: str, end_id: int = 1, end_mark: str = "</w>", limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = self.lean = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for x, i in vocab.items() if x.endswith(end_mark)]] = True
        self.end_id, self.limit = end_id, limit
        self._forget()
        self.by_word = self._described(end_mark)
        if self.by_word:
            lengths, ids = self.documents(list(self.PROBES))
            told = [self.encode(x) + [end_id] for x in self.PROBES]
            self.by_word = lengths.tolist() == list(map(len, told)) and ids.tolist() == [i for x in told for i in x]
            self._forget()

    def _described(self, end_mark: str) -> bool:
        """Whether the tokenizer is as the class wants it; if so, lean is one of its model for lower-case words of LETTERS."""
        told = json.loads(self.tokenizer.to_str())
        steps = (told["normalizer"] or {}).get("normalizers", [told["normalizer"] or {}])
        split = (told["pre_tokenizer"] or {}).get("pretokenizers", [told["pre_tokenizer"] or {}])
        fit = {x.get("type") for x in steps} == {"NFC", "Replace", "Lowercase"} and split[0].get("type") == "Split" and told["model"].get("end_of_word_suffix") == end_mark
        # Added tokens of letters alone would be found in words; a text of words holds no others.
        plain = all(re.search(r"[^\w\s]", x["content"]) for x in told["added_tokens"])
        if fit and plain and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in split[1:]] == [("ByteLevel", False, False)]:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            self.lean = Tokenizer(self.tokenizer.model)
            self.lean.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        return fit

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        # Place 0 is a document's end, place 1 is nothing.
        self.places, self.used = {"": 1}, 2
        self.pool, self.pool_used = np.full(1 << 16, self.end_id, np.uint32), 1
        self.begins, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.sizes[0] = 1

    def _add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Gives words the next places; ids are theirs one after the other."""
        n, m = self.used + len(words), self.pool_used + len(ids)
        while n > len(self.begins):
            self.begins, self.sizes = np.concatenate((self.begins, self.begins)), np.concatenate((self.sizes, self.sizes))
        while m > len(self.pool):
            self.pool = np.concatenate((self.pool, self.pool))
        self.begins[self.used : n] = self.pool_used + np.cumsum(sizes) - sizes
        self.sizes[self.used : n] = sizes
        self.pool[self.pool_used : m] = ids
        self.places.update(zip(words, range(self.used, n), strict=True))
        self.used, self.pool_used = n, m

    def _add_lists(self, words: list[str]) -> None:
        lists = [self.encode(x) for x in words]
        if words:
            self._add(words, np.fromiter(map(len, lists), np.int64, len(lists)), np.array([i for x in lists for i in x], np.uint32))

    def _add_plain(self, cores: list[str], tokenizer) -> None:
        """Adds words of letters. Texts of few words take less time for a word than long ones."""
        k = self._TOGETHER
        for i in range(0, len(cores), k * k):
            part = cores[i : i + k * k]
            texts = [part[j : j + k] for j in range(0, len(part), k)]
            told = [x.ids for x in tokenizer.encode_batch_fast([" ".join(x) for x in texts], add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(told), np.int64)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            # The words of each text end where it ends.
            last = np.cumsum([len(x) for x in told])
            if np.array_equal(np.searchsorted(ends, last, "right"), np.cumsum([len(x) for x in texts])) and np.isin(last, ends).all():
                self._add(part, np.diff(ends, prepend=0), ids)
            else:  # some word isn't one pre-token
                self._add_lists(part)

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the words at places."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.begins[places] - ends + sizes, sizes)
        shift += np.arange(len(shift))
        return sizes, self.pool[shift]

    def _found(self, words: list[str]) -> np.ndarray:
        """Their places, -1 for those that are new."""
        return np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))

    def _looked_up(self, cores: list[str], letters: list[str], rest: list[str]) -> list[np.ndarray]:
        """The places of each; new ones are added. cores: lower-case, of LETTERS; letters: of any others; rest: encoded one by one."""
        kinds = cores, letters, rest
        found = [self._found(x) for x in kinds]
        new = [list(dict.fromkeys(x[i] for i in np.flatnonzero(at < 0).tolist())) for x, at in zip(kinds, found, strict=True)]
        if any(new):
            if len(self.places) + sum(map(len, new)) > self.limit:
                self._forget()
                new = [[y for y in dict.fromkeys(x) if y] for x in kinds]
                found = [np.full(len(x), -1) for x in kinds]
            self._add_plain(new[0], self.lean)
            self._add_plain(new[1], self.tokenizer)
            self._add_lists(new[2])
            for x, at in zip(kinds, found, strict=True):
                missing = np.flatnonzero(at < 0)
                at[missing] = self._found([x[i] for i in missing.tolist()])
        return found

    def _pairs(self, words: pa.StringArray) -> np.ndarray:
        """Two places for each word: those of its letters and of the punctuation behind them."""
        size, listed = pc.binary_length, lambda x: x.to_numpy(zero_copy_only=False).tolist()  # in less time than to_pylist()
        cores, tails = pc.ascii_rtrim(words, self.PUNCTUATION), pc.utf8_ltrim(words, self.LETTERS)
        plain = pc.equal(pc.add(size(cores), size(tails)), size(words))
        cores, tails = (pc.dictionary_encode(x.filter(plain)) for x in (pc.utf8_lower(cores), tails))
        letters, odd_tails = [], []
        odd = listed(words.filter(pc.invert(plain)))
        is_word = np.zeros(len(odd), bool)
        for k, word in enumerate(odd):
            core = word.rstrip(self.PUNCTUATION)
            is_word[k] = bool(core) and unicodedata.normalize("NFC", core).lower().isalpha()
            if is_word[k]:
                letters.append(core)
            odd_tails.append(word[len(core) :] if is_word[k] else word)
        own, ends = listed(cores.dictionary), listed(tails.dictionary)
        own, letters, rest = self._looked_up(own, letters, ends + odd_tails)
        out, plain = np.ones((len(words), 2), np.int64), plain.to_numpy(zero_copy_only=False)
        out[plain, 0], out[plain, 1] = own[cores.indices.to_numpy()], rest[tails.indices.to_numpy()]
        first = np.ones(len(odd), np.int64)
        first[is_word] = letters
        out[~plain, 0], out[~plain, 1] = first, rest[len(ends) :]
        return out

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths with the end id, ids of all one after the other)."""
        if not self.by_word:
            own = [self.encode(t or "") + [self.end_id] for t in texts]
            return np.fromiter(map(len, own), np.int64, len(own)), np.array([i for x in own for i in x], np.uint32)
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        # Splits at just the blanks that WORD leaves out; at a text's ends there may be empty words.
        split = pc.ascii_split_whitespace(pa.array([t.encode("utf-8", "replace") if t else b"" for t in texts], pa.binary()).cast(pa.string()))
        words = pc.dictionary_encode(split.flatten())
        pairs = self._pairs(words.dictionary)
        counts = np.diff(split.offsets.to_numpy())
        place = np.zeros((len(words) + len(texts), 2), np.int64)
        place[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = pairs[words.indices.to_numpy()]
        ends = np.cumsum(counts + 1)
        place[ends - 1] = 0, 1
        sizes, ids = self._gather(place.ravel())
        return np.add.reduceat(sizes, 2 * (ends - counts - 1)), ids


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_tokens: int = 1 << 19) -> None:
    """Encodes docs(doc_id, text, ...) in ascending doc_id order and writes shards of about shard_tokens ids to path.

    Null texts are empty documents of the end id alone; null doc_ids come first; rows of one doc_id are ordered by their
    texts' hash, exact repeats stay repeats. A document is never split over shards; one of more ids is a shard of its own.
    Texts are read whole. An empty table writes no shard. Other columns are not read.
    path becomes a Parquet folder of one row for each shard: part and seq (its place in the order), counts and the file image.
    """

    def run(batches):
        from pyspark import TaskContext

        part, seq, encoder = TaskContext.get().partitionId(), 0, kept_by_worker(("encoder", tokenizer, end_id), lambda: WordEncoder(tokenizer, end_id))
        held_ids, held_lengths, held, total = [], [], [], 0

        def flush():
            nonlocal seq, held_ids, held_lengths, held, total
            shard = Shard.build(held_ids, np.concatenate(held_lengths), np.concatenate(held))
            row = [part, seq, len(held_ids), shard.matrix.n, shard.to_bytes()]
            seq += 1
            held_ids, held_lengths, held, total = [], [], [], 0
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_tokens", "image"])

        for doc_ids, texts in chunks(batches, 1, max_chars=1_000_000):
            lengths, ids = encoder.documents(texts)
            held_ids += doc_ids
            held_lengths.append(lengths)
            held.append(ids)
            total += len(ids)
            if total >= shard_tokens:
                yield flush()
        if held_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, seq int, n_docs long, n_tokens long, image binary").write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, n_docs, n_tokens, image, base): base is the number of ids in all shards before."""
    shards = spark.read.parquet(path)
    index = shards.select("part", "seq", "n_tokens")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    # One row for each partition that wrote: as many rows as there were tasks.
    parts = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("ahead"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    bases = small_join(index, parts, ["part"]).select("part", "seq", (F.col("ahead") + inside).alias("base"))
    return small_join(shards, bases, ["part", "seq"])


def documents_of(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, decoded from the file images: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""

    def run(batches):
        for batch in batches:
            for image, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                shard = Shard.from_bytes(image.as_py())
                ids = shard.matrix.to_array().astype("<u4")
                view, ends = memoryview(ids).cast("B"), shard.starts.tolist()
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                cols = [pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + base), pa.array(shard.lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(ends, ends[1:], strict=False)], pa.list_(pa.int64())))
                yield pa.record_batch(cols, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return shards.select("image", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def occurrences(shards: DataFrame, symbol: int, places: bool = True) -> DataFrame:
    """Where a token id stands, looked up in the shards' planes without decoding the documents: doc_id and position (counted over
    all shards) of each occurrence, or with places false doc_id and n, the number of occurrences in each document that has any."""

    def run(batches):
        for batch in batches:
            for image, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                shard = Shard.from_bytes(image.as_py())
                at = shard.matrix.occurrences(symbol)
                own = np.searchsorted(shard.starts, at, "right") - 1
                if not places:
                    own, at = np.unique(own, return_counts=True)
                cols = [pa.array([shard.doc_ids[k] for k in own.tolist()], pa.int64()), pa.array(at if not places else at + base, pa.int64())]
                yield pa.record_batch(cols, names)

    names = ["doc_id", "position" if places else "n"]
    return shards.select("image", "base").mapInArrow(run, f"doc_id long, {names[1]} long")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Writes the shards of docs to path (a new shared folder if None) and returns what documents_of() reads from them."""
    spark = docs.sparkSession
    path = path or work_dir(spark, "tokens")
    write_shards(docs, path, tokenizer, end_id)
    return documents_of(read_shards(spark, path))
