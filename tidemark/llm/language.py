"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed into phrases, each the longest match in the
language's text from where the last one ended; the language that needs the fewest phrases, normalised by log2 of its
text's length, wins. Texts are folded first: lower case, everything that is no letter becomes a space. Every letter of the
labelled texts has a symbol of its own, however many there are; a letter that they lack is a phrase of its own.

An automaton's transitions lie in one array: a state is a number, a transition of it lies that number plus the symbol
further on and names its state, so an automaton needs little more than one entry a transition whatever the script.

Whole texts are parsed, cut into blocks of BLOCK symbols that are stepped side by side. Each block is parsed as if a phrase
began there; then each block's parse is carried on into the next one until both begin a phrase at the same place, from
where they are one. Where they never do, the next block is carried on again. So the count is that of the parse from the
text's first letter to its last, and blocks leave no trace in it.

The labelled text is a bounded sample of whole documents: of each language at most ``docs_per_language`` that have at most
``longest`` characters, in the order of a hash of their id, until they have ``chars_per_language`` characters together. A
language all of whose documents are longer learns from its shortest one. All texts are predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..ship import ship
from .bpe import slices
from .shared import fresh, tidy

BLOCK = 256
#: Bytes of text that are parsed together.
GROUP = 2_000_000
LETTER = regex.compile(r"\p{L}").search
_LOW = np.int64(2**32 - 1)


def fold(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def _no_letters() -> np.ndarray:
    return np.array([not chr(c).isalpha() for c in range(0x110000)], np.int8)


@dataclass
class Automaton:
    """``moves`` has the number of a state in its upper half and that of the next state in its lower half."""

    lang: str
    moves: np.ndarray
    start: int  # a state without transitions, in which a phrase is about to begin
    first: np.ndarray  # by symbol: the state after a phrase's first one
    bits: float


def transitions(text: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence of symbols: by state the next state by symbol; 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


def laid_out(states: list[dict[int, int]], n_symbols: int) -> tuple[np.ndarray, int, int]:
    """Moves in one array, the number of the root, and one that no state has. States with many transitions first, each where all of its fit."""
    room = sum(map(len, states)) + len(states) + 2 * n_symbols + 64
    free, unused = np.ones(room * 2, bool), np.ones(room * 2, bool)
    number = [0] * len(states)
    last = 0  # the next search begins here; what is left free goes to states of one transition
    singles = []
    for s in sorted(range(len(states)), key=lambda s: -len(states[s])):
        if len(states[s]) < 2:
            singles.append(s)
            continue
        syms = np.array(sorted(states[s]))
        at = last
        while True:
            window = min(256, len(free) - at - n_symbols)
            if window <= 0:
                free, unused = np.append(free, np.ones(room, bool)), np.append(unused, np.ones(room, bool))
                continue
            fits = unused[at : at + window].copy()
            for c in syms.tolist():
                fits &= free[at + c : at + c + window]
            i = int(fits.argmax())
            if fits[i]:
                break
            at += window
        last = b = at + i
        number[s] = b
        unused[b] = False
        free[b + syms] = False
    places, taken = iter(np.flatnonzero(free[n_symbols:]) + n_symbols), set(np.flatnonzero(~unused).tolist())
    ends, later = [], []
    for s in singles:
        if not states[s]:
            ends.append(s)
            continue
        (c,) = states[s]
        for k, p in enumerate(later[:8]):
            if p - c not in taken:
                del later[k]
                break
        else:
            p = next(places)
            while p - c in taken:
                later.append(p)
                p = next(places)
        number[s] = int(p) - c
        taken.add(number[s])
    top = max(taken, default=0) + 1
    for s in ends:
        number[s] = top
        top += 1
    moves = np.full(top + n_symbols + 2, -1, np.int64)
    for s, d in enumerate(states):
        for c, t in d.items():
            moves[number[s] + c] = (number[s] << 32) | number[t]
    return moves, number[0], top


def learned(samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, list[Automaton]]:
    """The letters of all samples, in order, and an automaton for each language. Symbols: 0 a letter that no sample has,
    1 what is no letter, then the letters."""
    letters = np.array(sorted({ord(c) for _, s in samples for c in s.lower() if c.isalpha()}), np.int64)
    table, out = symbols(letters), []
    for lang, s in sorted(dict(samples).items()):
        moves, root, none = laid_out(transitions(table[fold(s)].tolist()), len(letters) + 2)
        step = moves[root : root + len(letters) + 2]
        out.append(Automaton(lang, moves, none, np.where(step >> 32 == root, step & _LOW, none).astype(np.int32), float(np.log2(max(len(s), 2)))))
    return letters, out


def symbols(letters: np.ndarray) -> np.ndarray:
    """Symbol by code point."""
    table = _no_letters().astype(np.int32)
    table[letters] = np.arange(len(letters)) + 2
    return table


def phrases(texts: list[np.ndarray], auto: Automaton) -> np.ndarray:
    """How many phrases each text has; texts are symbols, none of them empty."""
    sizes = np.array([len(t) for t in texts])
    per = -(-sizes // BLOCK)
    n, firsts = int(per.sum()), np.cumsum(per) - per
    lens = np.full(n, BLOCK)
    lens[firsts + per - 1] = sizes - (per - 1) * BLOCK
    flat = np.zeros(n * BLOCK, np.int32)
    at = np.repeat(firsts * BLOCK - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    flat[at] = np.concatenate(texts)
    order = np.argsort(-lens, kind="stable")  # so that the blocks that still have symbols come first
    rows = np.ascontiguousarray(flat.reshape(n, BLOCK)[order].T)
    lens = lens[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    live = np.searchsorted(-lens, -np.arange(BLOCK), "left")  # blocks of more than t symbols

    index, move, after_, goes_ = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int32), np.empty(n, bool)

    def step(state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Does the phrase go on, and the state after this symbol; both in buffers that the next call uses again."""
        k = len(row)
        i, m, to, goes = index[:k], move[:k], after_[:k], goes_[:k]
        np.add(state, row, out=i)
        np.take(auto.moves, i, out=m, mode="clip")
        halves = m.view(np.int32).reshape(k, 2)  # little endian
        np.equal(halves[:, 1], state, out=goes)
        np.take(auto.first, row, out=to, mode="clip")
        np.copyto(to, halves[:, 0], where=goes)
        return goes, to

    begins = np.zeros((BLOCK, n), bool)
    state = np.full(n, auto.start, np.int32)
    for t in range(int(lens[0])):
        k = live[t]
        goes, state[:k] = step(state[:k], rows[t, :k])
        np.logical_not(goes, out=begins[t, :k])
    count = begins.sum(axis=0, dtype=np.int64)
    # Blocks that go on a text, by their place, and the state that enters them.
    follows = np.ones(n, bool)
    follows[firsts] = False
    before = place[np.flatnonzero(follows) - 1]
    todo = place[np.flatnonzero(follows)]
    prior, after = np.full(n, -1), np.full(n, -1)
    prior[todo], after[before] = before, todo
    more, leaves = np.zeros(n, np.int64), state.copy()
    while len(todo):
        more[todo] = 0
        active, s = todo, leaves[prior[todo]]
        out = state.copy()  # where both parses meet a block is left as by its own
        for t in range(BLOCK):
            ended = lens[active] == t
            if ended.any():
                out[active[ended]] = s[ended]
                active, s = active[~ended], s[~ended]
            if not len(active):
                break
            goes, to = step(s, rows[t, active])
            own = begins[t, active]
            apart = goes | ~own
            more[active] += (~goes & ~own).astype(np.int64) - (goes & own)
            active, s = active[apart], to[apart]
        out[active] = s
        changed = todo[out[todo] != leaves[todo]]
        leaves[todo] = out[todo]
        todo = after[changed]
        todo = todo[todo >= 0]
    return np.add.reduceat((count + more)[place], firsts)


def classify(texts: list[str | None], letters: np.ndarray, autos: list[Automaton]) -> tuple[list[str], list[float]]:
    """Language and score of each text: 1 - fewest / second fewest normalised phrases (1 if one language is known).

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language is known. Of languages
    that tie the first by name wins, with score 0.
    """
    out, score = ["und"] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and LETTER(t)] if autos else []
    if not todo:
        return out, score
    table = symbols(letters)
    coded = [table[fold(texts[i])] for i in todo]
    costs = np.stack([phrases(coded, a) * a.bits for a in autos])
    best = costs.argmin(axis=0)
    ordered = np.sort(costs, axis=0)
    sure = 1 - ordered[0] / ordered[1] if len(autos) > 1 else np.ones(len(todo))
    for i, b, s in zip(todo, best, sure, strict=True):
        out[i], score[i] = autos[b].lang, float(s)
    return out, score


def learn(docs: DataFrame, docs_per_language: int = 96, chars_per_language: int = 32_000, longest: int = 2_000) -> tuple[tuple[str, str], ...]:
    """Labelled text by language from ``docs`` (doc_id, text, lang): null languages and texts without letters teach nothing.

    Each language's documents are ranked by a hash; the limit is pushed below the shuffle, so no task sees more than
    that many of a language from each partition. At most ``docs_per_language`` documents of ``longest`` characters of each
    language come to the driver, or one longer one.
    """
    n = F.length("text")
    beyond = F.when(n > longest, n).otherwise(0)
    order = Window.partitionBy("lang").orderBy(beyond, F.xxhash64(F.col("doc_id").cast("string"), F.col("lang")), "doc_id", "text")
    some = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "text")
    ranked = some.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs_per_language)
    rows = ranked.where((n <= longest) | (F.col("_n") == 1)).orderBy("lang", "_n").collect()
    found: dict[str, str] = {}
    for r in rows:
        if len(found.get(r.lang, "")) < chars_per_language:
            found[r.lang] = found.get(r.lang, "") + r.text + "\n"
    return tuple(sorted(found.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with two more columns, from ``text`` alone; their names must be new.

    The automata are built here once and sent with the code: about a megabyte for a language of 32,000 characters.
    """
    ship(docs.sparkSession)
    letters, autos = learned(samples)
    rows = docs.select(*[c for c in docs.columns if c != "text"], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, GROUP)):
            got, sure = classify(part.column(part.num_columns - 1).to_pylist(), letters, autos)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string()), pa.array(sure, pa.float64())], [*part.schema.names, pred, score])

    found = rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))
    return found.select(*docs.columns, pred, score)


def held_out(ident: str = "doc_id"):
    """crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default), held_out, lang_pred, score; learns from rows that aren't held out.

    A null or empty text, and one without letters, is ``und`` with score 0; a row with a null id is predicted but not
    learned from, as are rows without a language. Repeated rows are predicted alike, texts of any length as a whole, and an
    empty table gives an empty result. Of ``keep``, columns that are named like a result are replaced by it.
    """
    samples = learn(docs.where("doc_id IS NOT NULL").where(~held_out()))
    keep = [c for c in dict.fromkeys(keep or ["doc_id"]) if c.lower() not in {"held_out", "lang_pred", "score"}]
    rows = docs.select(*keep, *[c for c in ("doc_id", "text") if c not in keep])
    pred, score = fresh(rows, "lang_pred"), fresh(rows, "score")
    return identify(rows, samples, pred, score).select(*keep, held_out().alias("held_out"), F.col(pred).alias("lang_pred"), F.col(score).alias("score"))
