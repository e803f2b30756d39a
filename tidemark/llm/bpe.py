"""Byte-level BPE by backtracking over longest matches.

The vocabulary's byte strings, mapped byte for byte to Latin-1 characters, form an Aho-Corasick automaton. Each piece of
text is encoded from left to right: take the longest token that matches here; if it may not follow the one before, try
the next shorter token that is a prefix of it; if none is left, mark the place as unreachable and take the last token
back. Two tokens may stand side by side exactly if BPE, run on their joined bytes, yields the two again, which is
memoised per pair. Places are marked once, so the work is linear in the piece, and the result equals that of running
the merges in order of rank.

Many texts are encoded at a time. They are cut at spaces, where the pattern always ends a piece, and only the distinct
units are split into pieces; the automaton runs once over all distinct pieces; these go through the backtracking in step,
one step of all of them at a time, each with its own places, marks and stack; the ids of the texts are then gathered from
those of the pieces. Nothing is kept between groups but the memo of pairs, whose size is fixed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .shared import tidy

#: Memoised pairs, a power of two: a pair has one place, and a newer pair takes it over.
PAIRS = 2**21
#: Bytes of text that are encoded together; a longer text is a group of its own.
GROUP = 8_000_000
#: Bytes of a piece that goes through the backtracking in step; the places of one are the bits of a word.
SHORT = 63
#: Stands between joined pieces; no byte of a token is mapped to it.
GAP = "\u0100"
#: Texts with a space beside other white space, and the places between units of those.
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
IRREGULAR = f" {_WHITE}|{_WHITE} "
#: Units that are not split together with others.
ALONE = f"^$|^{_WHITE}| |{_WHITE}$"
BETWEEN = re.compile(r"(?<=\S) (?=\S)").split
#: Patterns by which no piece goes on over a space between two other characters.
CUT_AT_SPACES = {public_tokenizers.PATTERN}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def gathered(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``begin`` and have ``lens`` elements, one after another."""
    total = int(lens.sum())
    return flat[np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(total)] if total else flat[:0]


class Bpe:
    """Encoder and decoder for one rank file; ``pattern`` splits text into pieces that are encoded apart."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        self.split = regex.compile(pattern).findall
        self.cuts = pattern in CUT_AT_SPACES
        # The two tokens whose merge makes a token; None for single bytes. Tokens that merges can't reach are left out.
        self.parts: dict[int, tuple[int, int] | None] = {}
        auto = ahocorasick.Automaton()
        for token, i in ranks.items():
            if len(token) == 1:
                self.parts[i] = None
            else:
                left = self._merge(token, i)
                if len(left) != 2:
                    continue
                self.parts[i] = (ranks[left[0]], ranks[left[1]])
            auto.add_word(token.decode("latin-1"), i)
        auto.make_automaton()
        self.matches, self.longest = auto.iter, auto.iter_long
        self.sizes = np.array([len(t) for t in self.table], np.int64)
        # The longest token that is a proper prefix of a token, or -1.
        self.shorter = np.full(len(self.table) + 1, -1, np.int64)
        for token, i in ranks.items():
            for k in range(len(token) - 1, 0, -1):
                j = ranks.get(token[:k])
                if j is not None and j in self.parts:
                    self.shorter[i] = j
                    break
        self.words = pa.array(self.table, pa.large_binary())
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.strings = list(map(str, range(len(self.table))))

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """Merges of rank below ``below`` in order of rank, the leftmost of equals first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= below:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def together(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left``?

        Both are undone merge by merge, the later one first. What remains at the seam would have merged across it if
        that merge has a lower rank than the one that was undone last on its side.
        """
        ranks, table, parts = self.ranks, self.table, self.parts
        limit = len(table)  # merges of this rank or above come too late to matter
        while True:
            across = ranks.get(table[left] + table[right])
            if across is not None and across < limit:
                return False
            l, r = parts[left], parts[right]
            if l is None and r is None:
                return True
            # At equal ranks the left one was merged first, so the right one is undone first.
            if r is None or (l is not None and left > right):
                limit, left = left, l[1]
            else:
                limit, right = right + 1, r[0]

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``together`` of many pairs, memoised."""
        keys = left * len(self.table) + right
        place = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (PAIRS - 1)
        out = self.pair_fits[place]
        miss = np.flatnonzero(self.pair_keys[place] != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            fits = np.fromiter((self.together(*divmod(k, len(self.table))) for k in new.tolist()), bool, len(new))
            out[miss] = fits[back]
            self.pair_keys[place[miss]], self.pair_fits[place[miss]] = keys[miss], out[miss]
        return out

    def piece(self, piece: bytes) -> list[int]:
        """One piece of any length."""
        n, sizes, shorter = len(piece), self.sizes.tolist(), self.shorter.tolist()
        longest = {end - sizes[i]: i for end, i in self.matches(piece.decode("latin-1"))}  # by the place before its start
        known: dict[tuple[int, int], bool] = {}
        blocked, out, at, token = set(), [], 0, longest.get(-1, -1)
        while at < n:
            while token >= 0:
                if at + sizes[token] not in blocked:
                    if not out:
                        break
                    key = (out[-1], token)
                    if key not in known:
                        known[key] = self.together(*key)
                    if known[key]:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at - 1] if at < n else -1
            else:
                blocked.add(at)
                token = out.pop()
                at -= sizes[token]
        return out

    def _greedy(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the longest matches from left to right end, and their tokens."""
        found = np.fromiter(chain.from_iterable(self.longest(text)), np.int64)
        return found[::2] + 1, found[1::2]

    def _in_step(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (flat) and numbers of ids of pieces, none of them longer than SHORT bytes.

        Longest matches are looked up once for all pieces, from their beginnings, and then from those places that the
        backtracking comes to and that no earlier look-up has passed.
        """
        n, sizes = len(pieces), np.array([len(p) for p in pieces], np.int64)
        text, starts = GAP.join([p.decode("latin-1") for p in pieces]), np.cumsum(sizes + 1) - sizes - 1
        ends, tokens = self._greedy(text)
        longest = np.full(len(text) + 1, -2, np.int64)
        longest[ends - self.sizes[tokens]] = tokens
        owner = np.searchsorted(starts, ends - 1, "right") - 1
        depth = np.bincount(owner, minlength=n)
        step = np.arange(len(tokens)) - (np.cumsum(depth) - depth)[owner]
        stack = np.empty((n, int(sizes.max())), np.int32)
        stack[owner, step] = tokens
        # Up to the first two that may not stand side by side this is what backtracking does too.
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = inner[~self.fit(tokens[inner], tokens[inner + 1])]
        live, which = np.unique(owner[bad], return_index=True)
        left = bad[which]
        at, cand, blocked, one = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.uint64), np.uint64(1)
        depth[live], at[live], cand[live] = step[left] + 1, ends[left] - starts[live], self.shorter[tokens[left + 1]]
        while len(live):
            token, place, deep = cand[live], at[live], depth[live]
            end = place + self.sizes[token]
            ok = (token >= 0) & ((blocked[live] >> end.astype(np.uint64)) & one == 0)
            check = np.flatnonzero(ok & (deep > 0))
            ok[check] = self.fit(stack[live[check], deep[check] - 1].astype(np.int64), token[check])
            took, dead, tries = live[ok], live[~ok & (token < 0)], live[~ok & (token >= 0)]
            stack[took, deep[ok]] = token[ok]
            depth[took] += 1
            at[took] = end[ok]
            cand[tries] = self.shorter[cand[tries]]
            if len(dead):
                blocked[dead] |= one << at[dead].astype(np.uint64)
                depth[dead] -= 1
                last = stack[dead, depth[dead]].astype(np.int64)
                at[dead] -= self.sizes[last]
                cand[dead] = self.shorter[last]
            going = took[at[took] < sizes[took]]
            new = going[longest[starts[going] + at[going]] == -2]
            if len(new):
                a, rest = starts[new] + at[new], sizes[new] - at[new]
                ends, tokens = self._greedy(GAP.join([text[i:j] for i, j in zip(a.tolist(), (a + rest).tolist(), strict=True)]))
                begin = np.cumsum(rest + 1) - rest - 1
                owner = np.searchsorted(begin, ends - 1, "right") - 1
                longest[a[owner] + ends - self.sizes[tokens] - begin[owner]] = tokens
            cand[going] = longest[starts[going] + at[going]]
            live = np.concatenate([going, tries, dead])
        return stack[np.arange(stack.shape[1]) < depth[:, None]], depth

    def pieces(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct pieces: all their ids, where each one's begin, and how many it has."""
        n = len(pieces)
        if n < 5000:
            whole = np.fromiter((self.ranks.get(p, -1) for p in pieces.to_pylist()), np.int64, n)
        else:  # worth a table of all tokens
            whole = pc.fill_null(pc.index_in(pieces, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        flats, begin, lens = [whole], np.arange(n), np.ones(n, np.int64)
        held = n
        todo = np.flatnonzero((whole < 0) & (sizes <= SHORT))
        if len(todo):
            ids, lens[todo] = self._in_step(pieces.take(pa.array(todo)).to_pylist())
            begin[todo] = held + np.cumsum(lens[todo]) - lens[todo]
            flats.append(ids)
            held += len(ids)
        for i in np.flatnonzero((whole < 0) & (sizes > SHORT)).tolist():
            ids = np.array(self.piece(pieces[i].as_py()))
            begin[i], lens[i] = held, len(ids)
            flats.append(ids)
            held += len(ids)
        return np.concatenate(flats).astype(np.int32), begin, lens

    def units(self, units: pa.Array, heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, places and numbers as of ``pieces``, of distinct units, which a space precedes, and then of heads."""
        n = len(units) + len(heads)
        alone = pc.match_substring_regex(units, ALONE).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(~alone), np.flatnonzero(alone)
        order = np.concatenate([plain, rest, len(units) + np.arange(len(heads))])
        said: list[str] = []
        if len(plain):
            some = units if len(plain) == len(units) else units.take(pa.array(plain))
            said = self.split(" " + " ".join(some.to_pylist()))
        n_plain, counts = len(said), []
        for x in [*(" " + x for x in units.take(pa.array(rest)).to_pylist()), *heads.to_pylist()]:
            own = self.split(x)
            counts.append(len(own))
            said += own
        if not said:
            return np.empty(0, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        coded = pa.array(said, pa.large_string()).dictionary_encode()
        del said
        distinct = coded.dictionary.cast(pa.large_binary())
        flat, begin, lens = self.pieces(distinct)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # A piece that begins with a space begins a unit here, as plain units hold none themselves.
        opens = pc.starts_with(distinct, b" ").to_numpy(zero_copy_only=False)[codes[:n_plain]]
        first = np.concatenate([np.flatnonzero(opens), n_plain + np.cumsum([0, *counts], dtype=np.int64)])
        upto = np.concatenate([[0], np.cumsum(lens[codes])])[first]
        where, size = np.empty(n, np.int64), np.empty(n, np.int64)
        where[order], size[order] = upto[:-1], np.diff(upto)
        return gathered(flat, begin[codes], lens[codes]), where, size

    def encode_many(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another (int32), and how many each text has; a null text is empty.

        A piece never goes on over a space between two other characters, and the pattern looks no further back than its
        piece: so the units that begin with such spaces are encoded apart. Of other patterns whole texts are split.
        """
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        column = pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")
        if self.cuts and not pc.any(pc.match_substring_regex(column, IRREGULAR)).as_py():
            split = pc.split_pattern(column, " ")
            first = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
            values = split.flatten()
            inner = np.ones(len(values), bool)
            inner[first] = False
            heads, units = values.take(pa.array(first)), values.filter(pa.array(inner))
            counts = np.diff(np.append(first, len(values))) - 1
        else:
            said, more, sizes = [], [], []
            for t in column.to_pylist():
                parts = BETWEEN(t) if self.cuts else [t]
                said.append(parts[0])
                more += parts[1:]
                sizes.append(len(parts) - 1)
            heads, units, counts = pa.array(said, pa.large_string()), pa.array(more, pa.large_string()), np.array(sizes, np.int64)
        coded = units.dictionary_encode()
        flat, begin, lens = self.units(coded.dictionary, heads)
        # A text's units follow its head.
        first = np.cumsum(counts + 1) - counts - 1
        order = np.empty(len(units) + len(heads), np.int64)
        inner = np.ones(len(order), bool)
        inner[first] = False
        order[first] = len(coded.dictionary) + np.arange(len(heads))
        order[inner] = coded.indices.to_numpy(zero_copy_only=False)
        each = lens[order]
        return gathered(flat, begin[order], each), np.add.reduceat(each, first)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=1)
def load(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def slices(batch: pa.RecordBatch, size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose last column, a text, has about ``size`` bytes; one longer text makes a part of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - 1) // size
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a or batch.num_rows == 0:
            yield batch.slice(a, b - a)


def encode_column(path: str, pattern: str, kind: str):
    """For mapInArrow over (key columns..., text): the key columns, then ids (list) or digests of ids and decoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in (p for batch in batches for p in slices(batch)):
            keys = [part.column(i) for i in range(part.num_columns - 1)]
            flat, counts = bpe.encode_many(part.column(part.num_columns - 1))
            if kind == "ids":
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                more = [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
            else:
                ids_digest, back_digest, at, ids = [], [], 0, flat.tolist()
                for end in accumulate(counts.tolist()):
                    own = ids[at:end]
                    ids_digest.append(hashlib.sha256(",".join(map(bpe.strings.__getitem__, own)).encode()).hexdigest())
                    back_digest.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                    at = end
                more = [pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(back_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(keys + more, [f"c{i}" for i in range(len(keys) + len(more))])

    return run


def tokenize(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens and ids of every whole text, however long.

    A null or empty text has no tokens and an empty list. Repeated rows are encoded alike, an empty table gives an empty
    result. Of ``keep``, columns that are named like a result are replaced by it.
    """
    ship(docs.sparkSession)
    rows = docs.select(*[c for c in dict.fromkeys(keep) if c.lower() not in {"n_tokens", "ids"}], F.col("text").alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_tokens bigint", "ids array<int>"])
    return rows.mapInArrow(tidy(encode_column(path, pattern, "ids")), schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids joined by commas and of the bytes decoded from them.

    A null text counts as empty: no tokens, and the digests of nothing. Every row gives a row, with null and repeated ids
    too; other columns are not read, texts may have any length, and an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(encode_column(path, pattern, "digest")), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
