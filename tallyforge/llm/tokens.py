"""Token counts by rank-synchronous merging of ragged numpy arrays.

A text is normalised and split into pre-tokens as the vocabulary file says: by patterns where all its characters have been in Unicode
for long, else by the library's own normaliser and pre-tokeniser, as versions of Unicode differ in newer letters. Pre-tokens not met before are laid out as one
ragged array of symbols; each round finds every sequence's lowest-ranked adjacent pair and merges all its occurrences at once,
until no sequence has a known pair. What survives is the number of tokens.

Null and empty texts have 0 tokens; repeated rows are counted each; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_step

#: Pre-tokens remembered by one Python worker; beyond this the memory starts afresh, which costs time only.
REMEMBERED = 400_000
#: Pre-tokens merged in one numpy call.
MERGED = 50_000
#: Fixed value: how byte-level vocabularies split a text when the file names no pattern.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts of letters and marks that every version of Unicode knows alike and that no normal form changes.
SETTLED = regex.compile("[\x00-\u024f\u2010-\u2027\u2030-\u205e]*")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def white(pattern: str) -> str:
    r"""Unicode's white space for ``\s``: Python's own also takes the separators U+001C to U+001F."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Splitter:
    """Texts to pre-tokens, as a vocabulary file describes it."""

    def __init__(self, spec: dict, library=None):
        self.library = library
        steps = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        kinds = [x["type"] for x in steps.get("normalizers", [steps])]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        pre = spec["pre_tokenizer"]
        split = [x["pattern"]["Regex"] for x in pre.get("pretokenizers", [pre]) if x["type"] == "Split"]
        self.find = regex.compile(white(split[0] if split else BYTE_LEVEL)).findall
        self.strings = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, self.strings))) if self.strings else None

    def segments(self, text: str) -> tuple[list[str], list[str]]:
        """The stretches between special strings, and those strings."""
        if self.special is None or "<" not in text and not self.special.search(text):
            return [text], []
        return self.special.split(text), self.special.findall(text)

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower() if self.lower else text

    def pieces(self, text: str) -> list[str]:
        if self.library is None or text.isascii() or SETTLED.fullmatch(text):
            return self.find(self.normal(text))
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]


class RankMerger:
    """Counts of the symbols that survive all merges."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        prefix = model.get("continuing_subword_prefix") or ""
        self.size = len(vocab) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b.removeprefix(prefix)] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        letters = byte_letters()
        self.first = np.array([vocab.get(c, len(vocab)) for c in letters], dtype=np.int64)
        self.last = np.array([vocab.get(c + self.suffix, len(vocab)) for c in letters], dtype=np.int64)

    def counts(self, pieces: list[str]) -> np.ndarray:
        coded = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        done = np.zeros(len(coded), np.int64)
        raw = np.frombuffer(b"".join(coded), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(lengths)
        if len(raw):
            at = ends[lengths > 0] - 1
            sym[at] = self.last[raw[at]]
        seq = np.repeat(np.arange(len(coded)), lengths)
        while len(sym):
            # the rank of each adjacent pair of one sequence, or a number beyond all ranks
            keys = sym[:-1] * self.size + sym[1:]
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = (self.keys[found] == keys) & (seq[:-1] == seq[1:])
            rank = np.append(np.where(known, self.ranks[found], 1 << 40), 1 << 40)
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            sizes = np.diff(np.append(starts, len(seq)))
            best = np.minimum.reduceat(rank, starts)
            ended = best == 1 << 40
            done[seq[starts[ended]]] = sizes[ended]
            hit = (rank == np.repeat(best, sizes)) & (rank < 1 << 40)
            # in a run of overlapping occurrences every other one merges, from the left
            at = np.flatnonzero(hit)
            if len(at):
                run = np.cumsum(np.append(True, np.diff(at) != 1))
                head = at[np.append(True, np.diff(run) != 0)]
                at = at[(at - head[run - 1]) % 2 == 0]
                sym[at] = self.made[found[at]]
            keep = ~np.repeat(ended, sizes)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return done


def load(vocab_path: str) -> dict:
    with open(vocab_path, encoding="utf-8") as f:
        return json.load(f)


def count_tokens(docs: DataFrame, vocab_path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit; columns of these names are replaced.

    ``vocab_path`` is a vocabulary file that every executor can open.
    """
    keep = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["n_bytes long, n_tokens long, over_limit boolean"])

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = load(vocab_path)
        splitter, merger, memory = Splitter(spec, Tokenizer.from_file(vocab_path)), RankMerger(spec), {}

        def work(texts, part):
            n_bytes = [len(t.encode()) for t in texts]
            split, extra = [], []
            for t in texts:
                between, special = splitter.segments(t)
                split.append([p for s in between for p in splitter.pieces(s)])
                extra.append(len(special))
            unmet = [*{p for pieces in split for p in pieces if p not in memory}]
            if len(memory) + len(unmet) > REMEMBERED:
                memory.clear()
                unmet = [*{p for pieces in split for p in pieces}]
            for i in range(0, len(unmet), MERGED):
                memory.update(zip(unmet[i : i + MERGED], merger.counts(unmet[i : i + MERGED]).tolist(), strict=True))
            n = [e + sum(map(memory.__getitem__, pieces)) for e, pieces in zip(extra, split, strict=True)]
            return {c: part.column(part.schema.get_field_index(c)) for c in keep} | {"n_bytes": n_bytes, "n_tokens": n, "over_limit": [x > limit for x in n]}

        yield from by_step(text, work)(batches)

    return docs.select(*keep, F.col(text)).mapInArrow(run, schema)


def op5(spark, sf_dir: str, vocab_path: str | None = None) -> DataFrame:
    from .queries import tokenizer
    from .common import read

    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), vocab_path or tokenizer("word_bpe_49k.json"))
