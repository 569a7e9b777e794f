"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents longer than a sequence are cut; full pieces fill a sequence each and only remainders and short documents are packed.
Pieces are dealt by a hash of their row's number into groups of bounded size. In each group best-fit decreasing fills the bins; then
all underfull bins move, exchange one for one, or exchange two for one document with each other wherever that increases the sum of
squared fills, until no such step is left; bins that empty go. The bins that stay underfull
in all groups are taken up once more, in groups of their own, so that the borders of groups cost next to nothing.

Null texts count as empty: one piece that holds the closing id alone. Repeated rows and equal ids are pieces of their own. Empty
tables give empty results. Columns of the same names as the result's are replaced.
"""

from __future__ import annotations

import bisect
import heapq
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read, steps
from .tokens import load

LIMIT = 2048
#: Documents of one packing group, on average.
GROUP = 2000
#: Fills under this are taken up by the second round.
FULL_ENOUGH = 0.999
#: Stretches of text (and words) that one worker process remembers, and words that the library gets as one text.
REMEMBERED, LINES = 400_000, 500
#: Stretches of one word, or of two with a line's end between, of letters that all versions of Unicode have; one mark after each.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+"
WORDS = rf"^(?P<a>{LETTERS})(?P<b>[.,;:!?]?)(?:\n(?P<c>{LETTERS})(?P<d>[.,;:!?]?))?$"
MARKS = pa.array(["", *".,;:!?"])
#: White space that has a space beside it or stands where no stretch could.
SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
APART = rf"^{SPACE}| {SPACE}| $"


class Ragged:
    """Lists of ids in one array, each from one of ``ends`` to the next."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.ends = flat, ends

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Ragged:
        return cls(np.concatenate([np.zeros(0, "<u4"), *lists]), np.append(0, np.cumsum([*map(len, lists)], dtype=np.int64)))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def joined(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.append(self.ends, self.ends[-1] + other.ends[1:]))

    def taken(self, slots: np.ndarray) -> Ragged:
        sizes = self.ends[slots + 1] - self.ends[slots]
        ends = np.append(0, np.cumsum(sizes))
        return Ragged(self.flat[np.repeat(self.ends[slots] - ends[:-1], sizes) + np.arange(ends[-1])], ends)


NONE = Ragged.of([])


class Memory:
    """The ids of strings that came before; beyond ``REMEMBERED`` it starts afresh, which costs time only."""

    def __init__(self):
        self.strings, self.ids, self.new = pa.array([], pa.string()), NONE, None

    def found(self, strings: pa.Array, learned) -> tuple[np.ndarray, Ragged]:
        """A table of ids and the place of each of the distinct ``strings`` in it; those not met before are learned."""
        place = pc.index_in(strings, value_set=self.strings)
        missing = place.is_null()
        unmet = strings.filter(missing)
        fresh, missing = learned(unmet), missing.to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy().astype(np.int64)
        place[missing] = len(self.strings) + np.arange(len(unmet))
        self.new = (unmet, fresh, missing)
        return place, self.ids.joined(fresh)

    def remember(self, which: np.ndarray | None = None) -> None:
        """Keep the strings learned last, or those of them among ``which`` of the strings asked for."""
        strings, ids, missing = self.new
        if which is not None:
            strings, ids = strings.filter(pa.array(which[missing])), ids.taken(np.flatnonzero(which[missing]))
        if len(self.strings) + len(strings) > REMEMBERED:
            self.strings, self.ids = pa.array([], pa.string()), NONE
        self.strings, self.ids, self.new = pa.concat_arrays([self.strings, strings]), self.ids.joined(ids), None


class Coder:
    """Ids of texts under a byte-level vocabulary, as little-endian 32-bit numbers, all of them by the library.

    No pre-token goes across a space, except in runs of white space. So a text is cut at its spaces, each distinct stretch is encoded once
    with the space before it, and a text's ids are put together from those of its stretches. Stretches that come again are
    remembered. Texts with white space beside a space or with special strings are encoded whole.
    """

    made: dict[str, Coder] = {}

    def __init__(self, vocab_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec, self.tokenizer = load(vocab_path), Tokenizer.from_file(vocab_path)
        pre = spec["pre_tokenizer"] or {}
        #: Whether the vocabulary's own rule splits texts as described; texts of other vocabularies are encoded whole.
        self.by_stretch = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.special = "|".join(re.escape(x["content"]) for x in spec["added_tokens"])
        self.mark = self.ids(["\n"])[0][0]
        self.marks = Ragged.of(self.ids([*MARKS.to_pylist(), "\n"]))
        self.stretches, self.pieces = Memory(), Memory()

    @classmethod
    def of(cls, vocab_path: str) -> Coder:
        return cls.made.setdefault(vocab_path, cls.made.get(vocab_path) or cls(vocab_path))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learned(self, pieces: pa.Array) -> Ragged:
        """The ids of pieces without white space but for a space in front."""
        # many go as one text, a line each; a line's end is a pre-token of its own there
        pieces = pieces.to_pylist()
        coded = self.ids(["\n".join(pieces[i : i + LINES]) + "\n" for i in range(0, len(pieces), LINES)])
        ids = np.concatenate([NONE.flat, *coded])
        ends = np.flatnonzero(ids == self.mark)
        assert len(ends) == len(pieces), "one line's end for each piece"
        return Ragged(np.delete(ids, ends), np.append(0, ends - np.arange(len(ends))))

    def coded(self, stretches: pa.Array, lead: str) -> Ragged:
        """The ids of ``lead`` and each stretch; stretches may hold white space, but not begin with it."""
        parts = pc.extract_regex(stretches, WORDS)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        rest = stretches.filter(pa.array(~plain)).to_pylist()
        others = Ragged.of(self.ids([lead + s for s in rest]))
        first, mark, second, mark2 = (parts.filter(pa.array(plain)).field(k) for k in range(4))
        two = pc.not_equal(second, "").to_numpy(zero_copy_only=False)
        words = pa.concat_arrays([pc.binary_join_element_wise(lead, first, ""), second.filter(pa.array(two))]).dictionary_encode()
        place, table = self.pieces.found(words.dictionary, self.learned)
        self.pieces.remember()
        # each stretch as a word, a mark, a line's end, a word and a mark, of which all but the first may be nothing
        slots = np.full((5, len(first)), len(table), np.int64)
        place = place[words.indices.to_numpy()]
        slots[0], slots[3, two] = place[: len(first)], place[len(first) :]
        slots[1], slots[4] = (len(table) + pc.index_in(m, value_set=MARKS).to_numpy() for m in (mark, mark2))
        slots[2, two] = len(table) + len(MARKS)
        made = table.joined(self.marks).taken(slots.T.ravel())
        made = Ragged(made.flat, made.ends[::5])
        out = np.empty(len(stretches), np.int64)
        out[plain], out[~plain] = np.arange(len(made)), len(made) + np.arange(len(others))
        return made.joined(others).taken(out)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        column = column.fill_null("")
        whole = pc.match_substring_regex(column, APART + (f"|{self.special}" if self.special else "")).to_numpy(zero_copy_only=False)
        if not self.by_stretch:
            whole = np.ones(len(column), bool)
        out: list = [None] * len(column)
        for i in range(0, int(whole.sum()), 64):
            some = np.flatnonzero(whole)[i : i + 64]
            for k, ids in zip(some.tolist(), self.ids(column.take(pa.array(some)).to_pylist()), strict=True):
                out[k] = ids
        rest = np.flatnonzero(~whole)
        if len(rest):
            for k, ids in zip(rest.tolist(), self.joined(column.take(pa.array(rest))), strict=True):
                out[k] = ids
        return out

    def joined(self, column: pa.Array) -> list[np.ndarray]:
        lists = pc.split_pattern(column, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        distinct = values.dictionary_encode()
        at = distinct.indices.to_numpy().astype(np.int64)
        place, table = self.stretches.found(distinct.dictionary, lambda unmet: self.coded(unmet, " "))
        self.stretches.remember(np.bincount(at, minlength=len(place)) > 1)
        # a text's first stretch follows no space
        heads = values.take(pa.array(offsets[:-1])).dictionary_encode()
        slot = place[at]
        slot[offsets[:-1]] = len(table) + heads.indices.to_numpy()
        ids = table.joined(self.coded(heads.dictionary, "")).taken(slot)
        border = ids.ends[offsets]
        return [ids.flat[a:b] for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True)]


def pieces_of(docs: DataFrame, vocab_path: str, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, closing: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece."""
    schema = f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = np.array([closing], "<u4").tobytes()

    def run(batches):
        coder = Coder.of(vocab_path)

        def work(part):
            out, rows = ([], [], [], []), []
            for row, ids in enumerate(coder.encode(part.column(part.schema.get_field_index(text)))):
                n, ids = len(ids) + 1, ids.tobytes() + end
                first = n % limit or limit
                cuts = [0, *range(first, n + 1, limit)] if n > limit else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for c, v in zip(out, (k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        c.append(v)
                    rows.append(row)
            column = part.column(part.schema.get_field_index(doc_id))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([column.take(pa.array(rows, pa.int64())), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=[doc_id, "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist()
            for a, b in steps(lengths):
                yield work(batch.slice(a, b - a))

    return docs.select(doc_id, text).mapInArrow(run, schema)


def best_fit(sizes: list[int], limit: int) -> list[list[int]]:
    """Bins of positions in ``sizes``: each item, largest first, goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    rooms: dict[int, list[int]] = defaultdict(list)
    free: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(free, sizes[i])
        if at == len(free):
            b, room = len(bins), limit
            bins.append([])
        else:
            room = free[at]
            b = rooms[room].pop()
            if not rooms[room]:
                free.pop(at)
        bins[b].append(i)
        if room := room - sizes[i]:
            if not rooms[room]:
                bisect.insort(free, room)
            rooms[room].append(b)
    return bins


class Open:
    """Underfull bins and, for each, the distinct sizes of nothing, of one and of two of its documents."""

    def __init__(self, bins: list[list[int]], sizes: list[int], limit: int):
        self.bins, self.sizes, self.limit = bins, sizes, limit
        self.fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
        self.turn = np.zeros(len(bins), np.int64)
        made = [self.sums(k) for k in range(len(bins))]
        #: bin, turn in which it was so, number of documents and their size together; rows of earlier turns no longer hold
        self.rows = np.concatenate(made, axis=1) if made else np.zeros((4, 0), np.int64)

    def sums(self, k: int) -> np.ndarray:
        one = np.array(sorted({self.sizes[i] for i in self.bins[k]}), np.int64)
        items = np.array([self.sizes[i] for i in self.bins[k]], np.int64)
        a, b = np.triu_indices(len(items), 1)
        two = np.unique(items[a] + items[b])
        many = np.repeat([0, 1, 2], [1, len(one), len(two)])
        return np.stack([np.full(len(many), k), np.full(len(many), self.turn[k]), many, np.concatenate([[0], one, two])])

    def change(self, k: int, out: list[int], back: list[int]) -> None:
        self.bins[k] = [i for i in self.bins[k] if i not in out] + back
        self.fill[k] = sum(self.sizes[i] for i in self.bins[k])
        self.turn[k] += 1
        self.rows = np.concatenate([self.rows, self.sums(k)], axis=1)
        held = self.rows[1] == self.turn[self.rows[0]]
        if 2 * held.sum() < len(held):
            self.rows = self.rows[:, held]

    def best(self, k: int, gives: bool):
        """The step of ``k`` with another bin that raises the sum of squared fills most, ``k`` giving or taking: (giver, taker, documents and
        size given, documents and size given back), or None. A net size d that goes from a to b raises it by 2 d (fill b - fill a + d)."""
        bin_, turn, many, size = self.rows
        other = (turn == self.turn[bin_]) & (bin_ != k) & (self.fill[bin_] < self.limit)
        own_many, own = self.rows[2:, (bin_ == k) & (turn == self.turn[k])]
        found = None
        # of three documents at most, one at least is given
        for given, returned in ((1, (0, 1, 2)), (2, (0, 1))):
            mine = np.sort(own[own_many == given]) if gives else np.sort(own[np.isin(own_many, returned)])
            theirs = np.flatnonzero(other & (np.isin(many, returned) if gives else many == given))
            if not len(mine) or not len(theirs):
                continue
            value, of = size[theirs], bin_[theirs]
            if gives:
                # the largest that their room holds in place of what comes back
                at = np.searchsorted(mine, value + self.limit - self.fill[of], "right") - 1
                net = np.where(at >= 0, mine[at] - value, 0)
                low, high = self.fill[k], self.fill[of]
            else:
                at = np.searchsorted(mine, value - (self.limit - self.fill[k]))
                net = np.where(at < len(mine), value - mine[np.minimum(at, len(mine) - 1)], 0)
                low, high = self.fill[of], self.fill[k]
            gain = np.where(net > 0, 2 * net * (high - low + net), 0)
            x = int(gain.argmax())
            if gain[x] > 0 and (found is None or gain[x] > found[0]):
                there = int(mine[at[x]])
                sums = (there, int(value[x])) if gives else (int(value[x]), there)
                found = (gain[x], *((k, int(of[x])) if gives else (int(of[x]), k)), given, returned, *sums)
        return found and found[1:]

    def members(self, k: int, counts: tuple[int, ...], size: int) -> list[int]:
        """Documents of a bin, as many as ``counts`` allow, of that size together."""
        if not size:
            return []
        of = {self.sizes[i]: i for i in self.bins[k]}
        if 1 in counts and size in of:
            return [of[size]]
        for x, i in enumerate(self.bins[k]):
            for j in self.bins[k][x + 1 :]:
                if self.sizes[i] + self.sizes[j] == size:
                    return [i, j]
        raise AssertionError("a size of no documents")

    def step(self, a: int, b: int, given: int, returned: tuple[int, ...], size: int, back: int) -> None:
        out, home = self.members(a, (given,), size), self.members(b, returned, back)
        self.change(a, out, home)
        self.change(b, home, out)


def search(bins: list[list[int]], sizes: list[int], limit: int) -> list[list[int]]:
    """Local search over all underfull bins, the emptiest first: moves and exchanges of one for one, two for one and one for two, as
    long as any raises the sum of squared fills; bins that empty go. A bin is looked at again, as giver and as taker,
    whenever it has changed, so that at the end no step is left."""
    full = [b for b in bins if sum(sizes[i] for i in b) >= limit]
    some = Open([b for b in bins if sum(sizes[i] for i in b) < limit], sizes, limit)
    queue = [(int(f), k, 0) for k, f in enumerate(some.fill)]
    heapq.heapify(queue)
    while queue:
        _, k, turn = heapq.heappop(queue)
        if turn != some.turn[k] or not some.bins[k] or some.fill[k] >= limit:
            continue
        # bins as best fit left them all have their turn to give, so that none need be asked to take
        found = some.best(k, True) or (some.best(k, False) if turn else None)
        if found:
            some.step(*found)
            for x in found[:2]:
                heapq.heappush(queue, (int(some.fill[x]), x, int(some.turn[x])))
    return full + [b for b in some.bins if b]


def packed(pieces: DataFrame, limit: int, groups: int, round_: int) -> DataFrame:
    """Each piece with its bin ``sequence_id``, its place ``offset`` there, and the fill of the bin."""
    cols = [c for c in pieces.columns if c not in ("sequence_id", "offset", "fill")]
    schema = ", ".join([f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in cols] + ["sequence_id long, offset long, fill long"])

    def pack(key, table):
        # pieces come in any order; the order of their rows makes reruns equal
        table = table.select([*cols]).sort_by([("row", "ascending"), ("piece", "ascending")])
        sizes = table.column("length").to_pylist()
        bins = search(best_fit(sizes, limit), sizes, limit)
        number, place, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                number[i], place[i] = k, at
                at += sizes[i]
            fill[b] = at
        # two bits of round, then the group, then 24 bits of bin: more bins than a group can hold
        number += (round_ << 60) | (key[0].as_py() << 24)
        for name, column in (("sequence_id", number), ("offset", place), ("fill", fill)):
            table = table.append_column(name, pa.array(column))
        return table

    return pieces.select(*cols, F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("grp")).groupBy("grp").applyInArrow(pack, schema)


def pack(docs: DataFrame, vocab_path: str, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT, rows: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    rows = docs.count() if rows is None else rows
    # a row's number, fixed as it is written, deals also equal rows to different groups
    pieces = cut(pieces_of(docs, vocab_path, text, doc_id, limit).withColumn("row", F.monotonically_increasing_id()))
    out = [doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = pieces.where(F.col("length") == limit).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    first = cut(packed(pieces.where(F.col("length") < limit), limit, max(1, round(rows / GROUP)), 1))
    short = F.col("fill") < int(limit * FULL_ENOUGH)
    left = first.where(short)
    # a group leaves a few underfull bins; those of many groups make one group of the second round
    again = packed(left.drop("fill"), limit, max(1, left.count() // GROUP), 2)
    return whole.select(out).unionByName(first.where(~short).select(out)).unionByName(again.select(out))


def op7(spark, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    from .queries import tokenizer

    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), vocab_path or tokenizer("byte_bpe_50k.json"))
