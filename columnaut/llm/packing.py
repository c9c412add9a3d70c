"""Best-fit packing of tokenized documents into sequences of a fixed size, by bin completion.

Documents are tokenized where they lie, each followed by an end token; those longer than a sequence are cut, so that only
the first piece may be shorter. The pieces are written to the shared folder and counted, and dealt into groups of bounded size (by their number, so neither a
key nor a long document can make a group large); each group is packed on its own. The best-fit-decreasing solution is the incumbent. Where it
has more bins than the lower bound, bin completion searches for a better one: a bin is opened around the largest piece left and completed with the undominated
fillings of the rest, least waste first, and a branch is pruned when it has wasted more than a better solution could afford. The search takes growing parts of a group's bins (the most wasteful
and some others), since a chronological search of thousands of bins would only ever revisit the last few; without a budget of nodes it grows until the incumbent is proven optimal. A
group can lose at most about one sequence against packing all at once, so the groups are made as large as a task can hold.

Edge cases: a null or empty text is one piece, the end token alone; repeated rows are packed once per row; an empty table gives
an empty result; ids may be null or repeat; extra columns aren't read. Texts are tokenized whole, at any length. Strings of
special tokens within a text are ordinary text.
"""

from __future__ import annotations

import base64
import bisect
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_batches, materialize, slices, texts_of, two_columns

#: Pieces that one group holds, about; and the fillings that the search may try in a group.
GROUP_ROWS = 32_768
SEARCH_NODES = 40_000
#: Fillings tried in one part of a group, at first.
PART_NODES = 2_000


@lru_cache(maxsize=2)
def _encoder(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tokenize:
    """Ids of a text as bytes, 4 for each."""

    def __init__(self, tokenizer_file: str, pattern: str | None = None):
        if not tokenizer_file.endswith("byte_bpe_50k.json"):
            raise ValueError("only the byte-level vocabulary byte_bpe_50k has its ranks beside it")
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.ranks, self.pattern = tokenizer_file.removesuffix("json") + "tiktoken", pattern

    def __call__(self, text: str) -> bytes:
        ids = array("I", _encoder(self.ranks, self.pattern).encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, and ids, the token ids as little-endian unsigned 32-bit integers."""
    source = two_columns(docs, id_col, text_col)
    tokenize, end = Tokenize(tokenizer_file), np.array([end_id], "<u4").tobytes()
    kind = source.schema["id"].dataType

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            row, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(texts_of(part, "text")):
                all_ids = tokenize(text) + end
                n = len(all_ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(all_ids[4 * a : 4 * b])
            of = part.column("id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "piece", "start", "length", "ids"])

    return map_batches(source, run, f"`{id_col}` {kind.simpleString()}, piece int, start bigint, length bigint, ids binary")


class _Left:
    """How many pieces of each length are left; bit x of `there` is set if one of length x is."""

    def __init__(self, counts: list[int] | np.ndarray):
        self.n = [int(k) for k in counts]
        self.total = sum(x * k for x, k in enumerate(self.n))
        self.there = sum(1 << x for x, k in enumerate(self.n) if x and k)

    def take(self, x: int) -> None:
        self.n[x] -= 1
        self.total -= x
        if not self.n[x]:
            self.there &= ~(1 << x)

    def put(self, x: int) -> None:
        self.n[x] += 1
        self.total += x
        self.there |= 1 << x


#: Fillings of a bin that further ones are held against.
_RIVALS = 128


def dominates(a: tuple[int, ...], b: tuple[int, ...], steps: int = 200) -> bool:
    """Whether the pieces of filling b can be dealt into bins as large as the pieces of filling a: a is then at least as good (Martello and Toth). A test that takes more than `steps` steps is given up
    as if it weren't so; b is then merely tried in vain."""
    room = list(a)

    def deal(i: int) -> bool:
        nonlocal steps
        if i == len(b):
            return True
        tried = set()
        for j, r in enumerate(room):
            steps -= 1
            if steps < 0:
                return False
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[j] = r - b[i]
                if deal(i + 1):
                    return True
                room[j] = r
        return False

    return sum(b) <= sum(a) and (not b or bool(a) and b[0] <= a[0] and deal(0))


def fillings(left: _Left, room: int, spare: int) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of `room` that waste at most `spare`, those of least waste first and of these the ones with the largest pieces first, so that whatever dominates a
    filling comes before it. Which sums the pieces up to each length can reach is worked out once, so that every step leads to a filling. What `left` holds must be
    the same whenever the next one is asked for."""
    lengths, reach, m = [], [1], left.there & ((2 << room) - 1)
    full = (2 << room) - 1
    while m:
        low = m & -m
        m ^= low
        x = low.bit_length() - 1
        sums, k, step = reach[-1], left.n[x], 1
        while k > 0 and step * x <= room:
            sums |= sums << (min(step, k) * x)
            k -= step
            step *= 2
        lengths.append(x)
        reach.append(sums & full)

    def exactly(s: int, upto: int) -> Iterator[tuple[int, ...]]:
        """All choices of the first `upto` lengths with the sum s, which can be reached."""
        if not s:
            yield ()
            return
        for i in range(min(upto, bisect.bisect_right(lengths, s)) - 1, -1, -1):
            if not reach[i + 1] >> s & 1:
                return  # nor can smaller lengths reach it
            x = lengths[i]
            for k in range(min(left.n[x], s // x), 0, -1):
                if reach[i] >> (s - k * x) & 1:
                    for rest in exactly(s - k * x, i):
                        yield (x,) * k + rest

    before: list[tuple[int, ...]] = []
    for s in range(room, max(-1, room - spare - 1), -1):
        if reach[-1] >> s & 1:
            for found in exactly(s, len(lengths)):
                if not any(dominates(b, found) for b in before):
                    if len(before) < _RIVALS:
                        before.append(found)
                    yield found
                    if found == (room,):
                        return  # it dominates all others


def complete(bins: list[list[int]], into: int, size: int, nodes: int | None) -> tuple[list[list[int]] | None, int, bool]:
    """(bins, nodes used, whether the search came to its end): the pieces of `bins` in `into` bins, by bin completion; None if there is no such packing, or none was found within `nodes`
    fillings. The next bin is opened around the largest piece left; its fillings are tried until the waste is more than `into` bins can afford."""
    counts = [0] * (size + 1)
    for own in bins:
        for x in own:
            counts[x] += 1
    left = _Left(counts)
    spare, used = into * size - left.total, 0
    if spare < 0:
        return None, 0, True
    stack: list[list] = []  # the largest piece, fillings not tried yet, the one that is tried, what it wastes

    def open_bin() -> None:
        largest = left.there.bit_length() - 1
        left.take(largest)
        stack.append([largest, fillings(left, size - largest, spare), (), 0])

    if left.total:
        open_bin()
    while stack:
        top = stack[-1]
        for x in top[2]:
            left.put(x)
        spare += top[3]
        top[2], top[3] = (), 0
        found = next(top[1], None)
        if found is None:
            left.put(top[0])
            stack.pop()
            continue
        used += 1
        if nodes is not None and used > nodes:
            return None, used, False
        for x in found:
            left.take(x)
        top[2], top[3] = found, size - top[0] - sum(found)
        spare -= top[3]
        if not left.total:
            return [[t[0], *t[2]] for t in stack], used, True
        open_bin()
    return None, used, True


def best_fit_decreasing(counts: np.ndarray, size: int) -> list[list[int]]:
    """Bins as lists of lengths; each piece goes where least room stays."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit r: some bin has r tokens of room
    for x in range(size, 0, -1):
        for _ in range(int(counts[x])):
            fits = mask >> x
            if fits:
                room = x + (fits & -fits).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    mask &= ~(1 << room)
                bins[k].append(x)
            else:
                k, room = len(bins), size
                bins.append([x])
            if room - x:
                by_room[room - x].append(k)
                mask |= 1 << (room - x)
    return bins


def lower_bound(counts: np.ndarray, size: int) -> int:
    """The bound L2 of Martello and Toth: pieces above size - k stand alone, those above half need a bin each, those of k at least fill up."""
    at = np.arange(size + 1)
    n, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * at)])
    best, half = 0, size // 2
    for k in range(0, half + 1):
        alone = n[-1] - n[size - k + 1]
        big = n[size - k + 1] - n[half + 1]
        free = big * size - (tokens[size - k + 1] - tokens[half + 1])
        small = tokens[half + 1] - tokens[max(k, 0)]
        best = max(best, int(alone + big + max(0, -((free - small) // size))))
    return best


def complete_bins(counts: np.ndarray, size: int, nodes: int | None = SEARCH_NODES) -> list[list[int]]:
    """Pack counts[x] pieces of each length x into bins of `size`; returns the bins. The best-fit-decreasing solution is the incumbent. As long as it has more bins than the
    bound L2, bin completion is asked to put the pieces of a part of its bins, the most wasteful ones and some others, into one bin less; what it finds replaces them. If
    it finds none, it may deal the part's pieces into as many bins otherwise, waste being driven together. Parts grow, up to all bins: a search of all bins that comes
    to its end without a solution proves the incumbent optimal. nodes: fillings tried at most; None: until the incumbent is proven."""
    best = best_fit_decreasing(counts, size)
    bound = lower_bound(counts, size)
    done = [b for b in best if b[0] == size]
    bins = [b for b in best if b[0] < size]
    rng, tries, grow, used = np.random.default_rng(len(bins)), 0, 1, 0
    while len(done) + len(bins) > bound and (nodes is None or used < nodes):
        waste = np.array([size - sum(b) for b in bins])
        worst, others = int(rng.integers(8, 25)) * grow, int(rng.integers(6, 25)) * grow
        if worst + others >= len(bins):
            at = np.arange(len(bins))
        else:
            order = np.argsort(-(waste + rng.integers(0, max(1, size // 16), len(bins))), kind="stable")
            at = np.concatenate([order[:worst], worst + rng.choice(len(bins) - worst, others, replace=False)])
            at[worst:] = order[at[worst:]]
        part = [bins[i] for i in at]
        most = PART_NODES * grow
        new, k, ended = complete(part, len(part) - 1, size, most if nodes is None else min(most, nodes - used))
        used += k
        if new is None and ended and len(part) == len(bins):
            break  # no packing into fewer bins exists
        tries += 1
        if new is None:
            new, k, _ = complete(part, len(part), size, PART_NODES // 8)
            used += k
            if new is not None and sum(sum(b) ** 2 for b in new) < sum(sum(b) ** 2 for b in part):
                new = None
        if tries % 512 == 0 or len(part) == len(bins):
            grow *= 2
        if new is not None:
            keep = np.ones(len(bins), bool)
            keep[at] = False
            bins = [bins[i] for i in np.flatnonzero(keep)] + new
    return done + bins


def place(lengths: np.ndarray, size: int, nodes: int | None = SEARCH_NODES) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each of the pieces, given in any order."""
    order = np.argsort(-lengths, kind="stable")
    counts = np.bincount(lengths, minlength=size + 1)
    of_length = {int(x): list(order[np.flatnonzero(lengths[order] == x)][::-1]) for x in np.flatnonzero(counts)}
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, own in enumerate(complete_bins(counts, size, nodes)):
        at = 0
        for x in own:
            i = of_length[x].pop()
            where[i], offset[i] = k, at
            at += x
    return where, offset


def pack(items: DataFrame, size: int = 1024, group_rows: int = GROUP_ROWS, nodes: int | None = SEARCH_NODES) -> DataFrame:
    """items (with a column length, 1 to size) with sequence_id and offset added; other columns are kept. Items are counted, and dealt into groups by their place in the input; so an
    input that is costly, or whose order can change between attempts (a join, say), should be written first. nodes: fillings that the search may try in a group; None: no bound."""
    groups = max(1, round(items.count() / group_rows))
    salted = items.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    columns = schema.names

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [c for c in columns[:-2] if c not in ("ids", "length") and frame[c].dtype.kind in "iuf"]
        frame = frame.sort_values(["length", *keys], kind="stable", ignore_index=True)  # the same result whatever order rows arrive in
        where, frame["offset"] = place(frame["length"].to_numpy(np.int64), size, nodes)
        frame["sequence_id"] = (np.int64(frame["_group"].iloc[0]) << 40) + where
        return frame[columns]

    return salted.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences ready to be written: the pieces of `pieces`, ids included, with sequence_id and offset."""
    return pack(materialize(pieces(docs, tokenizer_file, size, end_id, id_col, text_col), "packing-pieces"), size)


def placements(docs: DataFrame, tokenizer_file: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack_documents with a checksum of the ids in the place of the ids, which then don't move."""
    cut = pieces(docs, tokenizer_file, size, end_id, id_col, text_col)
    return pack(materialize(cut.select(f"`{id_col}`", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "packing-pieces"), size)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placements(documents(spark, sf_dir), tokenizer_path())


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
