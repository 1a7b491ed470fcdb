"""Language-model scoring by online logistic context mixing.

A token is a string of binary decisions: a Huffman code over a lexicon of the most frequent training tokens (those seen
once stand for what is new, so they are not in it), or the code's escape. Bit predictors look up hashed contexts: the place in
the code alone, the same with the token before and with the two before, and a match model (what followed the last place in this text with the same
two tokens before). Predictions are mixed in the logistic domain by weights that a gate chooses (state of the match, depth in
the code). Within a text the weights are refined online: it is coded in blocks of doubling length, and after each block
the weights take a gradient step on what was just coded, so every bit is predicted from what came before it alone.

Which token an escape stands for is told by three distributions, mixed by weights that a gate chooses (how many escapes
the text had before): the exact counts of all tokens outside the lexicon in all training texts, the text's own escapes so
far, and a spelling in bytes, whose bits are mixed from hashed contexts of two and four bytes. The bits of all decisions
make up the text's code length.

The counts come from all training texts. Those of tokens outside the lexicon stay in a table that grows with the input
and is joined; those of hashed contexts are counted by tasks into tables of fixed size, which are summed by slice and
broadcast, as the lexicon is. Token counts for the base score are exact: the lexicon's are broadcast, all others joined.

The weights' starting values are fitted on all training texts as well. While a task counts, it notes of each text's
decisions what the counts of the texts before said (in levels: a table of fixed size) and which bit came; the sums over all tasks
are what logistic regressions need. An escape's weights come from all training texts' escapes, scored with the text's own
occurrences taken off all counts.

Cases: a null text is the empty one (one token, the end); repeated rows are scored alike and each counts in training;
without training rows all counts are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, stored, table

LEXICON = 1 << 18
#: Slots of the hashed tables, as powers of two: those of the token before and of the two before, and those of byte contexts.
BITS = (22, 22, 20, 20)
#: Tokens before this rank are contexts of their own, others go by their last two bytes.
OWN_CONTEXT = 4096
#: The first block's tokens; each further block is twice as long.
BLOCK = 32
ADD = 0.4
RATE = 0.15

END = b""
GATES, INPUTS = 8, 4
BYTE_CONTEXTS = (2, 4)
CHUNK = 1 << 15
#: A counting task gets so many tokens at least where there are enough for all cores: each sends tables of full size.
TASK_TOKENS = 1 << 22
#: Tokens and their offsets, in bytes, that a task counts at once.
COUNTED_BYTES = 64 << 20
#: What predictors say, as levels for the fit of the weights: steps and most steps to a side, of a node's own chance and of tables.
OWN_STEP, OWN_LEVELS = 0.15, 5
STEP, LEVELS = 0.6, 15
#: Decisions by gate's depth, what the match model says (nothing, 0, 1), the level of each other input, bit; and those of bytes.
SAID = (GATES // 2, 3, 2 * OWN_LEVELS + 1, 2 * LEVELS + 1, 2 * LEVELS + 1, 2)
SAID_BYTES = (2 * LEVELS + 1, 2 * LEVELS + 1, 2)
#: Gates of what an escape stands for: by the powers of two of the escapes before.
ESCAPE_GATES = 8


def tokens(text: str | bytes | None) -> list[bytes]:
    """Words, lower-cased in A-Z, then the end."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    found = raw.lower().split()  # bytes split at the six ASCII blanks alone
    found.append(END)
    return found


def _words(column: pa.Array) -> pa.ListArray:
    """tokens() of each text, by Arrow: its ASCII blanks are the same six."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(column.fill_null("")))
    # a last blank makes an empty word at the end; an empty text is one such word already
    blank = pc.if_else(pc.equal(pc.binary_length(text), 0), "", " ").cast(text.type)
    return pc.ascii_split_whitespace(pc.binary_join_element_wise(text, blank, pa.scalar("", text.type)))


class Tokens(NamedTuple):
    """Tokens of a run of texts."""

    sizes: np.ndarray  # how many each text has
    distinct: list[bytes]  # the different ones, as they first come
    which: np.ndarray  # which of these each token is


def split(column: pa.Array) -> Tokens:
    """Each text's tokens, without a Python object for each."""
    words = _words(column)
    coded = words.flatten().dictionary_encode()
    # no word holds a blank, so they come over as one string
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.binary())), b" ")[0].as_py()
    return Tokens(np.diff(words.offsets.to_numpy()).astype(np.int64), joined.split(b" ") if len(words) else [], coded.indices.to_numpy())


def gathered(found: list[list[bytes]]) -> Tokens:
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(t, len(number)) for x in found for t in x], np.int64)
    return Tokens(np.array([len(x) for x in found], np.int64), list(number), which)


class Code(NamedTuple):
    """A prefix code: symbol s has the decisions first[s] to first[s + 1] of the other arrays."""

    first: np.ndarray
    nodes: np.ndarray
    bits: np.ndarray
    stretch: np.ndarray  # the node's own chance of a 1
    gate: np.ndarray  # by depth
    packed: np.ndarray  # node, gate and bit in one number, to be read at once


def huffman(weights: np.ndarray) -> Code:
    return unfolded(*tree(weights))


def tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's parent and side, and each inner node's own chance of a 1."""
    n = len(weights)
    order = np.argsort(weights, kind="stable")
    # inner nodes are made in the order of their weights; of equal ones a leaf goes first
    leaves, inner = [*weights[order].tolist(), math.inf], []
    number, i, j = order.tolist(), 0, 0
    parent, side, mass = np.zeros(2 * n, np.int32), np.zeros(2 * n, np.int8), np.zeros((n, 2))
    for node in range(n, 2 * n - 1):
        both = 0.0
        for k in (0, 1):
            if j < len(inner) and inner[j] < leaves[i]:
                below, w, j = n + j, inner[j], j + 1
            else:
                below, w, i = number[i], leaves[i], i + 1
            parent[below], side[below], mass[node - n, k] = node, k, w
            both += w
        inner.append(both)
    return parent, side, np.log((mass[:, 1] + ADD) / (mass[:, 0] + ADD)).astype(np.float32)


def unfolded(parent: np.ndarray, side: np.ndarray, stretch: np.ndarray) -> Code:
    n = len(stretch)
    root = 2 * n - 2
    depth, at = np.zeros(n, np.int32), np.arange(n, dtype=np.int32)
    while (below := at != root).any():
        depth += below
        at = np.where(below, parent[at], root)
    first = np.concatenate([[0], np.cumsum(depth, dtype=np.int64)]).astype(np.int32)
    nodes, bits, gate = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int8), np.zeros(first[-1], np.int8)
    # from the leaves up, all symbols at once
    symbol, at = np.arange(n), np.arange(n, dtype=np.int32)
    for up in range(1, depth.max() + 1 if n else 0):
        keep = depth[symbol] >= up
        symbol, at = symbol[keep], at[keep]
        down = depth[symbol] - up
        node, bit = parent[at] - n, side[at]
        place = first[symbol] + down
        nodes[place], bits[place], gate[place] = node, bit, np.minimum(down >> 1, GATES // 2 - 1)
        at = parent[at]
    return Code(first, nodes, bits, stretch[nodes], gate, nodes << 3 | gate << 1 | bits)


def _at(code: Code, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, gate and bit."""
    packed = _take(code.packed, place)
    return packed >> 3, packed >> 1 & GATES // 2 - 1, packed & 1


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    # all indexes lie within the array; clipping is the faster way to read
    return values.take(at, mode="clip")


class Lexicon:
    """Names and trees, from which the rest is unfolded where it is used: the driver sends a lexicon and uses none of that."""

    def __init__(self, names: bytes, trees: tuple):
        self.names, self.trees = names, trees  # names: the tokens, compressed

    @cached_property
    def number(self) -> dict[bytes, int]:
        """token -> rank; the escape is len(number)."""
        return {t: i for i, t in enumerate(zstandard.decompress(self.names).split(b" "))}

    @cached_property
    def context(self) -> np.ndarray:
        """Of each rank, and of an escape that is none."""
        return np.array([i if i < OWN_CONTEXT else _suffix(t) for t, i in self.number.items()] + [OWN_CONTEXT], np.int32)

    @cached_property
    def code(self) -> Code:
        return unfolded(*self.trees[0])

    @cached_property
    def byte_code(self) -> Code:
        return unfolded(*self.trees[1])

    def __reduce__(self):
        return Lexicon, (self.names, self.trees)


def lexicon(counted: list[bytes], counts: np.ndarray, others: int) -> Lexicon:
    """counted: tokens, most frequent first, and their counts; others: occurrences of all other training tokens."""
    names = b" ".join([*counted, b""])
    letters = np.ones(256) + np.bincount(np.frombuffer(names, np.uint8), minlength=256)
    trees = tree(np.append(counts, max(others, 1)).astype(np.float64)), tree(letters)
    return Lexicon(zstandard.compress(names[:-1]), trees)


def _suffix(t: bytes) -> int:
    return OWN_CONTEXT + 1 + zlib.crc32(t[-2:]) % 1024


def _expand(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all decisions of the symbols in turn: the index of the symbol, the place in the code's arrays."""
    first = _take(code.first, symbols)
    n = _take(code.first[1:], symbols) - first
    index = np.repeat(np.arange(len(symbols)), n)
    place = np.repeat(first - (np.cumsum(n, dtype=np.int64) - n), n)
    place += np.arange(len(index))
    return index, place


def _begin(code: Code, symbols: np.ndarray) -> np.ndarray:
    """Where each symbol's decisions begin in what _expand() returns."""
    n = (code.first[symbols + 1] - code.first[symbols]).astype(np.int64)
    return np.cumsum(n) - n


def _hashed(context: np.ndarray) -> np.ndarray:
    h = context.astype(np.uint32) * np.uint32(0x9E3779B1)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)


def _slot(hashed: np.ndarray, index: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The slots of decisions in a table of 2**bits, from their symbols' contexts and their nodes."""
    h = node.view(np.uint32) * np.uint32(0x9E3779B1)
    h ^= _take(hashed, index)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - bits)
    return h.view(np.int32)


class Slice(NamedTuple):
    """Tokens of a run of texts."""

    doc: np.ndarray
    at: np.ndarray  # place in its text
    symbol: np.ndarray  # rank or escape
    context: np.ndarray  # of the token before
    further: np.ndarray  # of the two tokens before
    guess: np.ndarray  # what the match model expects, -1 if nothing
    spelled: np.ndarray  # indexes of escaped tokens
    rare: list[bytes]  # the different ones among them
    rare_id: np.ndarray  # which of these each escaped token is
    letters: np.ndarray  # the different ones' bytes and ends
    letter_runs: np.ndarray  # how many of these each has
    letter_contexts: list[np.ndarray]


def _previous(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key has occurred before, and the last place before each."""
    h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    width = np.uint64(max(1, len(key).bit_length()))
    packed = np.sort((h >> width << width) | np.arange(len(key), dtype=np.uint64))
    place = (packed & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
    k, h = key[place], packed >> width
    same = k[1:] == k[:-1]
    if (mixed := (h[1:] == h[:-1]) & ~same).any():
        # different keys under one hash lie among each other: such places are sorted by the keys themselves
        run = np.isin(h, h[1:][mixed])
        place[run] = place[run][np.lexsort((place[run], key[place[run]], h[run]))]
        k = key[place]
        same = k[1:] == k[:-1]
    i = np.flatnonzero(same)
    return place[i + 1], place[i]


def read(found: list[list[bytes]] | Tokens, lex: Lexicon, match: bool = True) -> Slice:
    """match: whether to look for what the match model expects."""
    sizes, distinct, which = found if isinstance(found, Tokens) else gathered(found)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    escape = len(lex.number)
    known = np.fromiter(map(lex.number.get, distinct, repeat(-1)), np.int64, len(distinct))
    fresh = np.flatnonzero(known < 0)
    rare = [distinct[i] for i in fresh]
    known[fresh] = escape + 1 + np.arange(len(rare))
    classes = lex.context[np.minimum(known, escape)]
    classes[fresh] = [_suffix(t) for t in rare]
    ids, own = known[which], classes[which]
    spelled = np.flatnonzero(ids > escape)
    symbol = np.minimum(ids, escape).astype(np.int32)
    context = np.full(len(doc), OWN_CONTEXT, np.int32)
    context[1:] = np.where(at[1:] > 0, own[:-1], OWN_CONTEXT)
    # of two tokens by what they are, not by their classes
    whole = np.zeros(len(doc), np.uint32)
    whole[1:] = np.where(at[1:] > 0, symbol[:-1].astype(np.uint32) + np.uint32(1), np.uint32(0))
    further = np.zeros(len(doc), np.uint32)
    further[1:] = np.where(at[1:] > 0, whole[:-1], np.uint32(0))
    further = (whole * np.uint32(0x2545F491) + further * np.uint32(0x9E3779B1) + np.uint32(1)).view(np.int32)
    # the last earlier place of the same text with the same two tokens before
    guess = np.full(len(doc), -1, np.int32)
    later = np.flatnonzero(at >= 2)
    if match and len(later):
        pair = (ids[later - 2] * (escape + 2 + len(fresh)) + ids[later - 1]) * len(sizes) + doc[later]
        now, last = _previous(pair)
        guess[later[now]] = symbol[later[last]]
    # bytes of the different escaped tokens, with contexts that begin anew at each
    letters = np.frombuffer(b" ".join([*rare, b""]), np.uint8).astype(np.int32) if rare else np.zeros(0, np.int32)
    lengths = np.array([len(t) + 1 for t in rare], np.int64)
    inside = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    contexts = []
    for n in BYTE_CONTEXTS:
        c = np.zeros(len(letters), np.uint32)
        for back in range(1, n + 1):
            before = np.zeros(len(letters), np.uint32)
            before[back:] = letters[:-back]
            c = c * np.uint32(0x01000193) + np.where(inside >= back, before + np.uint32(1), np.uint32(0))
        contexts.append(c)
    return Slice(doc, at, symbol, context, further, guess, spelled, rare, ids[spelled] - escape - 1, letters, lengths, contexts)


def no_counts() -> list[np.ndarray]:
    """[bit, slot] of each table; a slot's two counts lie beside each other."""
    return [np.zeros((1 << b, 2), np.int32).T for b in BITS]


def nothing_said() -> list[np.ndarray]:
    return [np.zeros(math.prod(shape), np.int64) for shape in (SAID, SAID_BYTES)]


def own_levels(code: Code) -> np.ndarray:
    """The first part of the cells of what is said: of each place in the code, by its gate and the node's own chance."""
    level = np.clip(np.rint(code.stretch / np.float32(OWN_STEP)), -OWN_LEVELS, OWN_LEVELS).astype(np.int32) + np.int32(OWN_LEVELS)
    return (code.gate * np.int32(3 * SAID[2]) + level) * np.int32(SAID[3] * SAID[4] * 2) + code.bits


def _level(counts: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """What the counts so far say at the slots, as a level around 0."""
    x = counts.view(np.int64).take(slot, mode="clip").view(np.int32).astype(np.float32)
    x += np.float32(ADD)
    np.log(x, out=x)
    x = x[1::2] - x[::2]
    x *= np.float32(1 / STEP)
    np.rint(x, out=x)
    return np.clip(x, -LEVELS, LEVELS, out=x)


def count(s: Slice, lex: Lexicon, into: list[np.ndarray], said: list[np.ndarray] | None = None, own: np.ndarray | None = None) -> None:
    """Add the slice's decisions to the tables. said: gets what the tables said before that; own: own_levels() then."""
    flat = [t.T.reshape(-1) for t in into]
    code = lex.code
    index, place = _expand(code, s.symbol)
    node, _, bit = _at(code, place)
    slots = [_slot(_hashed(c), index, node, BITS[k]).astype(np.int64) for k, c in enumerate((s.context, s.further))]
    if said is not None:
        on, other = _matching(s.symbol, s.guess, code, place, node)
        first, second = (_level(flat[k], slot) for k, slot in enumerate(slots))
        first *= np.float32(SAID[4] * 2)
        second *= np.float32(2)
        first += second
        cell = _take(own, place)
        cell += first.astype(np.int32)
        cell[on] += (code.bits[other].astype(np.int32) + np.int32(1)) * np.int32(SAID[2] * SAID[3] * SAID[4] * 2)
        cell += np.int32(LEVELS * (SAID[4] + 1) * 2)
        said[0] += np.bincount(cell, minlength=len(said[0]))
    for t, slot in zip(flat, slots, strict=False):
        slot *= 2
        slot += bit
        np.add.at(t, slot, np.int32(1))
    index, place = _expand(lex.byte_code, s.letters)
    node, bit = lex.byte_code.nodes[place], lex.byte_code.bits[place]
    times = np.repeat(np.bincount(s.rare_id, minlength=len(s.rare)), s.letter_runs)[index].astype(np.int32)
    slots = [_slot(_hashed(c), index, node, BITS[k]).astype(np.int64) for k, c in enumerate(s.letter_contexts, 2)]
    if said is not None:
        first, second = (_level(t, slot).astype(np.int32) + LEVELS for t, slot in zip(flat[2:], slots, strict=True))
        said[1] += np.bincount((first * SAID_BYTES[1] + second) * 2 + bit, minlength=len(said[1]))
    for t, slot in zip(flat[2:], slots, strict=True):
        np.add.at(t, 2 * slot + bit, times)


class Model(NamedTuple):
    lex: Lexicon
    stretch: list[np.ndarray]  # of each table's slots
    weights: np.ndarray  # [gate, input]
    byte_weights: np.ndarray  # [context]
    byte_counts: tuple = ()  # of each table of bytes, [bit, slot]

    def __reduce__(self):
        sent = len(self.byte_counts)
        return _received_model, (self.lex, self.stretch[: len(self.stretch) - sent], self.weights, self.byte_weights, [_pack(c.ravel()) for c in self.byte_counts])


def _received_model(lex: Lexicon, stretch: list[np.ndarray], weights: np.ndarray, byte_weights: np.ndarray, packed: list[bytes]) -> Model:
    """Tables are sent in half precision, but for those of bytes: as packed counts."""
    counts = tuple(_unpack(c).reshape(2, -1).astype(np.float32) for c in packed)
    return Model(lex, [t.astype(np.float32) for t in [*stretch, *(stretched(*c) for c in counts)]], weights, byte_weights, counts)


def _came(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The probability of the bits that came. z is used up."""
    z *= np.float32(1) - np.float32(2) * bit
    np.clip(z, np.float32(-30), np.float32(30), out=z)
    np.exp(z, out=z)
    z += np.float32(1)
    return np.reciprocal(z, out=z)


def _told(stretch: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return _take(stretch, slot).astype(np.float32, copy=False)


def _byte_inputs(s: Slice, m: Model) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    index, place = _expand(m.lex.byte_code, s.letters)
    node = m.lex.byte_code.nodes[place]
    return index, [_told(m.stretch[k], _slot(_hashed(c), index, node, BITS[k])) for k, c in enumerate(s.letter_contexts, 2)], m.lex.byte_code.bits[place]


def _matching(symbol: np.ndarray, guess: np.ndarray, code: Code, place: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decisions at which the match model speaks, and the expected token's places in the code there."""
    token = np.flatnonzero(guess >= 0)
    own, expected = symbol[token], guess[token]
    n = (code.first[own + 1] - code.first[own]).astype(np.int64)
    on = np.repeat(_begin(code, symbol)[token] - (np.cumsum(n) - n), n)
    on += np.arange(len(on))
    # while the expected token's code has agreed with all decisions so far
    other = np.repeat(code.first[expected].astype(np.int64) - code.first[own], n) + place[on]
    agrees = (other < np.repeat(code.first[expected + 1], n)) & (_take(code.nodes, other) == node[on])
    return on[agrees], other[agrees]


def _token_inputs(s: Slice, m: Model, chosen: np.ndarray) -> tuple:
    """Of all decisions of the chosen tokens: index into chosen, inputs of the tables, bit, gate; where the match model speaks and what it says."""
    code = m.lex.code
    symbol, guess = s.symbol[chosen], s.guess[chosen]
    index, place = _expand(code, symbol)
    node, gate, bit = _at(code, place)
    on, other = _matching(symbol, guess, code, place, node)
    gate[on] += GATES // 2
    inputs = [_take(code.stretch, place), *(_told(m.stretch[k], _slot(_hashed(c[chosen]), index, node, BITS[k])) for k, c in enumerate((s.context, s.further)))]
    return index, inputs, bit.astype(np.int8), gate, on, 2.0 * code.bits[other].astype(np.float32) - 1


def bits(s: Slice, m: Model, n_docs: int, rate: float = RATE) -> np.ndarray:
    """The code length of each text in bits."""
    total = np.zeros(n_docs)
    w = [np.tile(m.weights[:, k].astype(np.float32), n_docs) for k in range(INPUTS)]
    block = np.log2(s.at / BLOCK + 1).astype(np.int8)
    last = np.zeros(n_docs, np.int8)
    np.maximum.at(last, s.doc, block)
    # what a text's last block teaches is of no use any more
    step = 2 * block + (last[s.doc] == block)
    order = np.argsort(step, kind="stable")
    ends = np.searchsorted(step[order], np.arange(step.max() + 2 if len(step) else 1))
    for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if lo == hi:
            continue
        chosen = order[lo:hi]
        index, x, bit, gate, on, says = _token_inputs(s, m, chosen)
        cell = _take(s.doc[chosen] * np.int64(GATES), index)
        cell += gate
        z = _take(w[0], cell)
        z *= x[0]
        for v, a in zip(w[1:-1], x[1:], strict=True):
            told = _take(v, cell)
            told *= a
            z += told
        z[on] += w[-1][cell[on]] * says
        p = _came(z, bit)
        total -= np.bincount(s.doc[chosen], np.add.reduceat(np.log(p), _begin(m.lex.code, s.symbol[chosen])), minlength=n_docs)
        if k % 2:
            continue
        miss = (np.float32(1) - p) * (np.float32(2) * bit - np.float32(1))
        n = np.bincount(cell, minlength=n_docs * GATES)
        scale = rate / np.sqrt(np.maximum(n, 1))
        for j, step in enumerate((*(np.bincount(cell, miss * a, n_docs * GATES) for a in x), np.bincount(cell[on], miss[on] * says, n_docs * GATES))):
            w[j] += (step * scale).astype(np.float32)
    return total / math.log(2)


def spelled(s: Slice, m: Model) -> np.ndarray:
    """The natural logarithm of the probability that each different escaped token is spelled so."""
    if not len(s.letters):
        return np.zeros(0)
    _, x, bit = _byte_inputs(s, m)
    z = sum(v * a for v, a in zip(m.byte_weights.astype(np.float32), x, strict=True))
    letters = np.add.reduceat(np.log(_came(z, bit)).astype(np.float64), _begin(m.lex.byte_code, s.letters))
    return np.add.reduceat(letters, np.cumsum(s.letter_runs) - s.letter_runs)


def spelled_alone(s: Slice, m: Model, which: np.ndarray, times: np.ndarray) -> np.ndarray:
    """spelled() of the escaped tokens `which`, with so many occurrences of each taken off the counts that tell it."""
    runs = s.letter_runs[which]
    if not len(runs):
        return np.zeros(0)
    begin, starts = np.cumsum(runs) - runs, np.cumsum(s.letter_runs) - s.letter_runs
    at = np.repeat(starts[which] - begin, runs) + np.arange(runs.sum())
    code, letters = m.lex.byte_code, s.letters[at]
    index, place = _expand(code, letters)
    node, bit = code.nodes[place], code.bits[place]
    off = np.repeat(times, runs)[index]
    z = np.zeros(len(index), np.float32)
    for k, v in enumerate(m.byte_weights.astype(np.float32)):
        slot = _slot(_hashed(s.letter_contexts[k][at]), index, node, BITS[2 + k])
        zeros, ones = (np.maximum(m.byte_counts[k][b][slot] - off * (bit == b), 0) for b in (0, 1))
        z += v * np.log((ones + ADD) / (zeros + ADD)).astype(np.float32)
    return np.add.reduceat(np.add.reduceat(np.log(_came(z, bit)).astype(np.float64), _begin(code, letters)), begin)


def recalled(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """For each escaped token the gate, and the share that it has of its text's escapes before."""
    doc = s.doc[s.spelled].astype(np.int64)
    at = np.arange(len(doc))
    new = np.concatenate([[True], doc[1:] != doc[:-1]])[: len(doc)]
    before = at - np.maximum.accumulate(np.where(new, at, 0))
    pair = doc * (len(s.rare) + 1) + s.rare_id
    order = np.argsort(pair, kind="stable")
    first = np.concatenate([[True], pair[order][1:] != pair[order][:-1]])[: len(doc)]
    same = np.zeros(len(doc), np.int64)
    same[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    gate = np.minimum(np.ceil(np.log2(before + 1)), ESCAPE_GATES - 1).astype(np.int64)
    return gate, same / np.maximum(before, 1)


def mixture(gate: np.ndarray, sources: np.ndarray, rounds: int = 30, times: np.ndarray | None = None) -> np.ndarray:
    """Weights [gate, source] of distributions, by expectation-maximisation over what each gives the tokens that came ([token, source],
    each so many times)."""
    times = np.ones(len(gate)) if times is None else times
    w = np.full((ESCAPE_GATES, sources.shape[1]), 1 / sources.shape[1])
    for _ in range(rounds):
        part = w[gate] * sources
        part *= (times / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        for g in range(ESCAPE_GATES):
            n = times[gate == g].sum()
            w[g] = (part[gate == g].sum(axis=0) + 1) / (n + sources.shape[1])
    # before any escape there is none to recall, so its weight goes to the others
    w[0, 1] = 0
    return w / w.sum(axis=1, keepdims=True)


def _regression(x: np.ndarray, zeros: np.ndarray, ones: np.ndarray, start: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Logistic regression (no constant) of bits over inputs [cell, input] that came so often with each bit, drawn to start a little."""
    v = start.astype(np.float64)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        n = zeros + ones
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(v))
        v = v - np.clip(np.linalg.solve(h, x.T @ (n * p - ones) + (v - start)), -0.5, 0.5)
    return v


def fitted(said: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starting weights [gate, input] and those of bytes, from what count() noted of all training texts."""
    weights = np.tile(np.array([0.4, 0.4, 0.4, 0.5]), (GATES, 1))
    cells = said[0].reshape(SAID)
    for gate in range(GATES):
        part = cells[gate % (GATES // 2)]
        part = part[:1] if gate < GATES // 2 else part[1:]
        at = np.nonzero(part.sum(axis=-1))
        says = 2.0 * at[0] - 1 if gate >= GATES // 2 else np.zeros(len(at[0]))
        x = np.column_stack([(at[1] - OWN_LEVELS) * OWN_STEP, (at[2] - LEVELS) * STEP, (at[3] - LEVELS) * STEP, says])
        weights[gate] = _regression(x, part[..., 0][at], part[..., 1][at], weights[gate])
    part = said[1].reshape(SAID_BYTES)
    at = np.nonzero(part.sum(axis=-1))
    byte_weights = _regression((np.column_stack(at) - LEVELS) * STEP, part[..., 0][at], part[..., 1][at], np.full(len(BYTE_CONTEXTS), 0.4))
    return weights.astype(np.float32), byte_weights.astype(np.float32)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def token_counts(training: DataFrame) -> DataFrame:
    """token, n over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held))
            held.clear()
            return pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], names=["token", "n"])

        for batch in slices(batches):
            held.append(_words(batch.column(0)).flatten())
            size += held[-1].nbytes
            if size > COUNTED_BYTES:
                yield out()
                size = 0
        if held:
            yield out()

    return training.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """In half precision, as the tables are sent to every executor."""
    return np.log((ones + ADD) / (zeros + ADD)).astype("<f2")


def _pack(counts: np.ndarray, kind: str = "<u4") -> bytes:
    """Byte by byte of all numbers: most have but one that is not 0."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype(kind).view(np.uint8).reshape(-1, int(kind[2])).T))


def _unpack(raw: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(int(kind[2]), -1).T).view(kind).ravel().astype(np.int64)


def tables(training: DataFrame, lex: Lexicon, n_tokens: int) -> Model:
    """Counts of the hashed contexts over all training texts as each table's stretched chances, and the weights."""
    spark = training.sparkSession
    sent = spark.sparkContext.broadcast(lex)
    n_said = -(-sum(math.prod(shape) for shape in (SAID, SAID_BYTES)) // (2 * CHUNK))
    n_chunks, n_tokens_chunks = sum(1 << b for b in BITS) // CHUNK, sum(1 << b for b in BITS[:2]) // CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, said, seen = no_counts(), nothing_said(), 0
        own = own_levels(sent.value.code)
        for batch in slices(batches, most_bytes=1 << 18):
            texts = batch.column(0)
            at = 0
            while at < len(texts):
                # no more texts at once than have been counted: the later ones would say nothing of each other
                some = texts.slice(at, max(1, seen))
                count(read(split(some), sent.value), sent.value, into, said, own)
                at, seen = at + len(some), seen + len(some)
        if seen:
            k = 0
            for t in into:
                for at in range(0, t.shape[1], CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(t[:, at : at + CHUNK].ravel())], pa.binary())], names=["chunk", "counts"])
                    k += 1
            all_said = np.zeros(n_said * 2 * CHUNK, np.int64)
            all_said[: sum(map(len, said))] = np.concatenate(said)
            for part in np.split(all_said, n_said):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(part)], pa.binary())], names=["chunk", "counts"])
                k += 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = _unpack(raw)
                held[k] = held[k] + c if k in held else c
        for k, c in held.items():
            # sums over all tasks may be beyond 32 bits
            made = stretched(*c.reshape(2, CHUNK)).tobytes() if k < n_tokens_chunks else _pack(c, "<u8")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([made], pa.binary())], names=["chunk", "made"])

    few = max(spark.sparkContext.defaultParallelism, n_tokens // TASK_TOKENS)
    parts = training.select("text").coalesce(few).mapInArrow(run, "chunk int, counts binary").repartition(n_chunks, "chunk").mapInArrow(add, "chunk int, made binary").collect()
    # chunk by chunk, as the driver has little room
    stretch, of_bytes, all_said = np.zeros((n_chunks, CHUNK), "<f2"), np.zeros((2, n_chunks - n_tokens_chunks, CHUNK), np.float32), np.zeros((n_said, 2 * CHUNK), np.int64)
    while parts:
        k, raw = parts.pop()
        if k < n_tokens_chunks:
            stretch[k] = np.frombuffer(raw, "<f2")
        elif k < n_chunks:
            c = _unpack(raw, "<u8").reshape(2, CHUNK)
            stretch[k], of_bytes[:, k - n_tokens_chunks] = stretched(*c), c
        else:
            all_said[k - n_chunks] = _unpack(raw, "<u8")
    said = all_said.ravel()
    weights, byte_weights = fitted([said[: math.prod(SAID)], said[math.prod(SAID) :][: math.prod(SAID_BYTES)]])
    both = np.split(stretch.ravel(), np.cumsum([1 << b for b in BITS])[:-1])
    return Model(lex, both, weights, byte_weights, tuple(np.split(of_bytes.reshape(2, -1), np.cumsum([1 << b for b in BITS[2:]])[:-1], axis=1)))


def _escapes(tail: DataFrame, n_tail: int) -> np.ndarray:
    """The weights of an escape's distributions, from all training texts' escapes; a text's own tokens are taken off the counts.
    Weights depend on the distributions' ratios alone, which are summed up in steps of half a power of two."""
    each = tail.filter(~F.col("held_out")).select((F.col("c") - F.size("recall")).alias("c"), F.col("alone"), F.explode("recall").alias("x"))
    gate = F.floor(F.col("x") / 2).cast("int")
    step = lambda p: F.when(p > 0, F.round(2 * (F.log2(p) - F.col("alone") / math.log(2))).cast("int"))
    cells = each.select(gate.alias("gate"), step(F.col("c") / n_tail).alias("by_count"), step((F.col("x") - 2 * gate).cast("double")).alias("by_recall"))
    found = cells.groupBy("gate", "by_count", "by_recall").agg(F.count(F.lit(1)).alias("n")).toArrow()
    # relative to the greatest of the three
    logs = np.column_stack([*(found[c].cast(pa.float64()).fill_null(-math.inf).to_numpy() / 2 for c in ("by_count", "by_recall")), np.zeros(found.num_rows)])
    sources = np.exp2(logs - logs.max(axis=1, keepdims=True)) if found.num_rows else logs
    return mixture(found["gate"].to_numpy(), sources, times=found["n"].to_numpy().astype(np.float64))


def report(docs: DataFrame, most_lexicon: int = LEXICON, most_tuning: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.
    most_tuning bounds nothing any more (all training texts tune the weights) and is there for callers that name it."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", _held_out().alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    counts = stored(token_counts(training), "mixing-counts")
    n_all, v_all = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    # a histogram of counts tells from which count on the lexicon holds; a global top-k would send that many rows from every task to one
    least = n_lexicon = 0
    for c, k in sorted(((r[0], r[1]) for r in counts.filter("n > 1").groupBy("n").count().collect()), reverse=True):
        n_lexicon += k
        if n_lexicon > most_lexicon:
            break
        least = c
    collected = counts.filter(F.col("n") >= (least or 2**62)).toArrow().sort_by([("n", "descending"), ("token", "ascending")])
    top, n_top = collected["token"].to_pylist(), collected["n"].to_numpy()
    floor = math.log10(n_all + 0.1 * (v_all + 1))
    lex = lexicon(top or [END], n_top if top else np.ones(1), n_all - int(n_top.sum()))
    n_rows = training.count()
    model = tables(training, lex, n_all)
    n_tail = max(n_all - int(n_top.sum()), 1)
    # without any frequent token the lexicon is the end alone, which every training text has
    heads = np.log10((n_top if top else np.array([n_rows])) + 0.1) - floor
    known = max(len(top), 1)
    sent = spark.sparkContext.broadcast((model, heads))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, head = sent.value
        task = TaskContext.get().partitionId() << 40
        row = 0
        for batch in slices(batches, most_bytes=1 << 20):
            texts = batch.column(1)
            found = split(texts)
            s = read(found, m.lex)
            k = len(texts)
            length = bits(s, m, k)
            gate, recall = recalled(s)
            plain = np.flatnonzero(s.symbol < known)
            base = np.bincount(s.doc[plain], head[s.symbol[plain]], minlength=k)
            n_head = np.bincount(s.doc[plain], minlength=k) * (n_rows > 0)
            # the escaped tokens of each text, once each, with the logarithm of the spelling's probability and what each occurrence recalls
            pair = s.doc[s.spelled].astype(np.int64) * (len(s.rare) + 1) + s.rare_id
            order = np.argsort(pair, kind="stable")
            other, first = np.unique(pair[order], return_index=True)
            ends = np.searchsorted(other, np.arange(k + 1) * (len(s.rare) + 1)).astype(np.int32)
            which, times = other % (len(s.rare) + 1), np.diff(np.append(first, len(order)))
            learnt = ~batch.column(2).to_numpy(zero_copy_only=False)[other // (len(s.rare) + 1)]
            alone = np.zeros(len(other))
            alone[learnt] = spelled_alone(s, m, which[learnt], times[learnt])
            each = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array((2 * gate + recall)[order].astype(np.float32)))
            parts = [pa.array(s.rare, pa.binary()).take(pa.array(which)), pa.array(spelled(s, m)[which]), pa.array(alone), each]
            tails = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, names=["token", "spelled", "alone", "recall"]))
            size = np.maximum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(task + row + np.arange(k)), pa.array(found.sizes), pa.array(n_head.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(-length * math.log10(2)), pa.array(size), tails],
                names=["doc_id", "held_out", "row", "n_tokens", "n_head", "head", "coded", "n_bytes", "tail"],
            )
            row += k

    scored = stored(rows.mapInArrow(run, "doc_id long, held_out boolean, row long, n_tokens long, n_head long, head double, coded double, n_bytes long, tail array<struct<token:binary,spelled:double,alone:double,recall:array<float>>>"), "mixing-scored")
    tail = scored.select("row", "held_out", F.explode("tail").alias("t")).select("row", "held_out", "t.*").join(counts, "token", "left")
    tail = stored(tail.select("row", "held_out", F.coalesce("n", F.lit(0)).alias("c"), "spelled", "alone", "recall"), "mixing-tail")
    weights = _escapes(tail, n_tail)
    c, times = F.col("c"), F.size("recall")
    by_count, by_recall, by_spelling = (F.array(*map(F.lit, weights[:, j].tolist())) for j in range(3))

    def told(total, x):
        gate = F.floor(x / 2).cast("int")
        told_by_all = F.log10(F.get(by_count, gate) * c / n_tail + F.get(by_recall, gate) * (x - 2 * gate) + F.get(by_spelling, gate) * F.exp("spelled"))
        # the spelling of a very long token is too unlikely for a double, and its logarithm then null
        return total + F.greatest(told_by_all, F.log10(F.get(by_spelling, gate)) + F.col("spelled") * math.log10(math.e))

    coded = F.aggregate(F.transform("recall", lambda x: x.cast("double")), F.lit(0.0), told)
    by_row = tail.groupBy("row").agg(F.sum(times * (F.log10(c + 0.1) - floor)).alias("more"), F.sum(F.when(c > 0, times).otherwise(0)).alias("more_known"), F.sum(coded).alias("more_coded"))
    score = F.col("coded") + F.coalesce("more_coded", F.lit(0.0))
    return scored.join(by_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("head") + F.coalesce("more", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
