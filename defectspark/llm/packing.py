"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Documents become token pieces of at most ``length`` ids. Only the histogram of piece lengths, one
count per possible length, reaches the driver. There, patterns of two or three lengths that fill
a sequence exactly get repeat counts by non-negative least squares; the counts are rounded to what
the histogram holds, and the rest is packed best fit, longest first. The plan is run-length coded
over the ranks of the pieces, so each piece finds its place by its exact rank alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectspark.llm.common import TEXT_ROWS, give_back, global_rank, store

# What a chunk may be made of to be cut by the pattern below; others go through the tokenizer whole.
_SIMPLE = "^[\\x{21}-\\x{7e}\\x{c0}-\\x{ff}]+\\z"
# How the tokenizer cuts a chunk of small letters: fixed by its file.
_PART = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+"
# White space that is no blank for the tokenizer, or none for the split below.
_ODD_BLANK = "[\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WORD_END = "</w>"
_TOGETHER = 2000
_HELD = 300_000
_SLICE_BYTES = 2_000_000


def _ragged(pool: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``pool[offset:offset + size]`` of every item, one after the other."""
    total = int(size.sum())
    kind = np.int32 if max(total, len(pool)) < 2**31 else np.int64
    shift = (offset - (np.cumsum(size) - size)).astype(kind)
    at = np.repeat(shift, size)
    at += np.arange(total, dtype=kind)
    return pool[at]


class _Pool:
    """Strings with their ids in one array; the number of a string says where they lie."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.offset, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, strings: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        first = len(self.number)
        self.number.update(zip(strings, range(first, first + len(strings))))
        self.offset = np.concatenate([self.offset, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])

    def numbers(self, strings: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of distinct strings; those not met before are learned."""
        get = self.number.get
        found = np.fromiter([get(s, -1) for s in strings], np.int64, len(strings))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = len(self.number) + np.arange(len(new))
            missing = [strings[i] for i in new.tolist()]
            self.add(missing, *learn(missing))
        return found


class ChunkEncoder:
    """Token ids of texts for a tokenizer that drops white space.

    Such a tokenizer treats chunks between blanks independently. The distinct chunks of a slice of
    texts are found by dictionary encoding. Chunks of plain Latin letters, digits and marks are cut
    as the tokenizer does, all at once, and only parts that were not met before go through it;
    other chunks, and strings that may be special tokens, go through it whole. Ids are then gathered
    by number, so no word is touched one by one.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism; threads only cost memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pool = _Pool()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True

    def _each(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64)

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that the tokenizer keeps apart between blanks, many at a time."""
        groups = [parts[i:i + _TOGETHER] for i in range(0, len(parts), _TOGETHER)]
        ids, sizes = [], []
        for some, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            found = np.asarray(encoded.ids, "<u4")
            # The last token of a part says so.
            size = np.diff(np.flatnonzero(self.closes[found]), prepend=-1)
            if len(size) != len(some) or size.sum() != len(found):
                found, size = self._each(some)
            ids.append(found)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _chunks(self, chunks: pa.Array) -> _Pool:
        """The ids of distinct chunks, numbered as they come; an empty chunk has none."""
        empty = pc.equal(chunks, "")
        plain = pc.and_(pc.match_substring_regex(chunks, _SIMPLE), pc.invert(pc.match_substring(chunks, "<|")))
        cut = pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), pattern=_PART, replacement="\\0 ")
        lists = pc.split_pattern(pc.utf8_rtrim(cut, " "), " ")
        coded = lists.flatten().dictionary_encode()
        numbers = self.pool.numbers(coded.dictionary.to_pylist(), self._parts)
        parts = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        other = pc.and_(pc.invert(plain), pc.invert(empty))
        # Whole chunks live in the same pool as parts: a part is plain, such a chunk is not or holds a mark of its own.
        whole = self.pool.numbers(chunks.filter(other).to_pylist(), self._each)
        size = self.pool.size[parts]
        ends = np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        out = _Pool()
        sizes = np.zeros(len(chunks), np.int64)
        is_plain, is_other = (m.to_numpy(zero_copy_only=False) for m in (plain, other))
        sizes[is_plain], sizes[is_other] = np.diff(ends), self.pool.size[whole]
        out.size, out.offset = sizes, np.cumsum(sizes) - sizes
        out.ids = np.empty(int(sizes.sum()), "<u4")
        spots = np.repeat(is_plain, sizes)
        out.ids[spots] = _ragged(self.pool.ids, self.pool.offset[parts], size)
        out.ids[~spots] = _ragged(self.pool.ids, self.pool.offset[whole], self.pool.size[whole])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the place where each text's ids begin, with the end."""
        if len(self.pool.number) > _HELD:
            self.pool = _Pool()
        odd = pc.match_substring_regex(texts, _ODD_BLANK)
        if pc.any(odd).as_py():
            # Blanks of the tokenizer become spaces; what else is white space is taken for a letter by this split.
            lists = pc.split_pattern(pc.replace_substring_regex(texts, "[ \\n\\t\\r]+", " "), " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        chunks = self._chunks(coded.dictionary)
        words = coded.indices.to_numpy(zero_copy_only=False)
        size = chunks.size[words]
        ids = _ragged(chunks.ids, chunks.offset[words], size)
        ends = np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, ends


def _pieces_of(encoder: ChunkEncoder, texts: pa.Array, length: int, with_ids: bool) -> pa.ListArray:
    ids, ends = encoder.encode(texts)
    # A closing 0 after every document.
    closed = np.zeros(len(ids) + len(texts), "<u4")
    spots = np.ones(len(closed), bool)
    spots[ends[1:] + np.arange(len(texts))] = False
    closed[spots] = ids
    first = ends + np.arange(len(ends))
    size = np.diff(first)
    count = -(-size // length)
    piece = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = piece * length
    begin = np.repeat(first[:-1], count) + start
    lengths = np.minimum(np.repeat(size, count) - start, length)
    raw = memoryview(closed.tobytes())
    cuts = [raw[4 * a:4 * (a + n)] for a, n in zip(begin.tolist(), lengths.tolist())]
    columns = {
        "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start.astype(np.int64)), "length": pa.array(lengths.astype(np.int64)),
        "ids_crc32": pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
    }
    if with_ids:
        columns["ids"] = pa.array([bytes(c) for c in cuts], pa.binary())
    rows = pa.StructArray.from_arrays(list(columns.values()), list(columns))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), rows)


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: the other columns, then ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``).

    A document is its token ids and a closing 0; null counts as empty, which leaves the 0 alone.
    Only documents over ``length`` are cut. Columns of these names are replaced.
    """
    kind = "array<struct<piece:int,start:long,length:long,ids_crc32:long" + (",ids:binary" if with_ids else "") + ">>"
    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    @F.arrow_udf(kind)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = ChunkEncoder(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch, "")
            slice_no = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // _SLICE_BYTES
            edges = [0, *(np.flatnonzero(np.diff(slice_no)) + 1).tolist(), len(texts)]
            parts = [_pieces_of(encoder, texts.slice(a, b - a), length, with_ids) for a, b in zip(edges, edges[1:]) if b > a]
            yield pa.concat_arrays(parts) if parts else _pieces_of(encoder, texts, length, with_ids)
            batch = texts = parts = None  # gone before the next batch comes
        del encoder
        give_back()

    rest = [c for c in docs.columns if c not in (text, *names)]
    return docs.select(*rest, F.explode(cut(F.col(text))).alias("__p")).select(*rest, *[F.col(f"__p.{n}").alias(n) for n in names])


def patterns_for(length: int, present: np.ndarray) -> np.ndarray:
    """Every pair and triple of present lengths that sums to ``length``; a pair has a leading 0."""
    found = []
    for a in [0, *np.flatnonzero(present[1:]) + 1]:
        low = np.arange(max(a, 1), (length - a) // 2 + 1)
        high = length - a - low
        ok = (high >= low) & (present[low] > 0) & (present[high] > 0)
        found.append(np.stack([np.full(ok.sum(), a), low[ok], high[ok]], axis=1))
    return np.concatenate(found).astype(np.int32) if found else np.zeros((0, 3), np.int32)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = 250) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the counts, by accelerated projected gradient."""
    size = len(counts)
    flat = patterns.T.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        total = np.bincount(flat, weights=np.tile(x, 3), minlength=size)
        total[0] = 0
        return total

    def back(r: np.ndarray) -> np.ndarray:
        return r[patterns[:, 0]] + r[patterns[:, 1]] + r[patterns[:, 2]]

    v = np.ones(len(patterns))
    for _ in range(12):
        v = back(used(v))
        v /= np.linalg.norm(v)
    bound = 1.05 * np.linalg.norm(back(used(v)))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        step = np.maximum(y - back(used(y) - counts) / bound, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = step + (t - 1) / s * (step - x)
        x, t = step, s
    return x


class Plan:
    """Run-length coded places: ``n`` pieces of one length from a rank on go to as many sequences at one offset."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.astype(np.int64).copy()
        self.next_rank = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.sequences = 0
        self.entries: list[tuple[int, int, int]] = []

    def place(self, size: int, n: int, sequence: int, offset: int) -> None:
        self.entries.append((int(self.next_rank[size]), sequence, offset))
        self.next_rank[size] += n
        self.left[size] -= n

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.asarray(sorted(self.entries), dtype=np.int64).reshape(-1, 3)
        return rows[:, 0], rows[:, 1], rows[:, 2]


def plan_packing(counts: np.ndarray, length: int) -> Plan:
    """Place every piece: full ones alone, then fitted patterns, then best fit for what is left."""
    plan = Plan(counts)
    if plan.left[length]:
        n = int(plan.left[length])
        plan.place(length, n, plan.open(n), 0)
    patterns = patterns_for(length, plan.left)
    if len(patterns):
        repeats = fit_repeats(patterns, plan.left.astype(float))
        for i in np.lexsort((np.arange(len(repeats)), -repeats)):
            if repeats[i] < 0.05:
                break
            sizes = [int(s) for s in patterns[i] if s]
            n = min(max(1, round(float(repeats[i]))), *[int(plan.left[s]) // sizes.count(s) for s in sizes])
            if n > 0:
                first, offset = plan.open(n), 0
                for s in sorted(sizes, reverse=True):
                    plan.place(s, n, first, offset)
                    offset += s
    _best_fit(plan, length)
    return plan


def _best_fit(plan: Plan, length: int) -> None:
    groups: list[list[tuple[int, int, int]]] = [[] for _ in range(length + 1)]  # by room: first sequence, how many, used
    has = np.zeros(length + 1, dtype=bool)

    def add(room: int, group: tuple[int, int, int]) -> None:
        groups[room].append(group)
        has[room] = True

    for size in range(length, 0, -1):
        while left := int(plan.left[size]):
            rooms = np.argmax(has[size:]) if has[size:].any() else -1
            if rooms >= 0:
                room = size + int(rooms)
                first, n, used = groups[room].pop()
                has[room] = bool(groups[room])
                k = min(n, left)
                plan.place(size, k, first, used)
                if n > k:
                    add(room, (first + k, n - k, used))
                if room > size:
                    add(room - size, (first, k, used + size))
                continue
            each = length // size
            n = max(left // each, 1)
            first, times = plan.open(n), min(each, left)
            for k in range(times):
                plan.place(size, n, first, k * size)
            if length - times * size:
                add(length - times * size, (first, n, times * size))


def pack(rows: DataFrame, ties: list[str], length: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``length`` column: 1 to ``length``), as few sequences as it can.

    ``ties`` fixes the order of pieces of one length; rows that agree on all of it are
    interchangeable. An empty table gives an empty result. No piece is cut or dropped.
    """
    rows = store(rows, "packing-pieces", TEXT_ROWS)  # ranging reads its input twice; tokens are made once
    ranked = global_rank(rows, ["length", *ties], "__rank", "packing")
    counts = np.zeros(length + 1, dtype=np.int64)
    for size, n in ranked.groupBy("length").count().collect():
        counts[size] = n
    held = rows.sparkSession.sparkContext.broadcast(plan_packing(counts, length).arrays())

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(ranks: pd.Series) -> pd.DataFrame:
        first, sequence, offset = held.value
        at = np.searchsorted(first, ranks.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + ranks.to_numpy() - first[at], "offset": offset[at]})

    return ranked.withColumn("__at", place("__rank")).select(
        *rows.columns, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: (``sequence_id``, ``ids`` bytes) of pieces that carry ``ids``; a sequence is bounded by its length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(spark: SparkSession, docs: DataFrame, length: int = 2048) -> DataFrame:
    """Pieces of (doc_id, text) documents with their places; the registered form of the operator."""
    cut = pieces(docs.select("doc_id", "text"), tokenizer_path(), length)
    return pack(cut, ["doc_id", "piece", "ids_crc32"], length)
