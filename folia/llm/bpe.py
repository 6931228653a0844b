"""Byte-level BPE over many pieces at once: exact merging in step, and greedy tokens with verification.

Symbols are numbered by birth: 0-255 are the bytes, 256 + k is what merge k makes, so a smaller
number is an earlier merge. ``Vocabulary.ids`` turns symbols into the public file's ids.
"""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

import numpy as np

NONE = np.int64(-1)
NEVER = np.int64(1) << 40
#: Bytes that greedy tokens are proposed for at a time; a longer piece is proposed in parts of so many, side by side.
PART = 64


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in the JSON form of byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Merges of a byte-level BPE as numpy tables. Of bounded size: that of the public file."""

    left: np.ndarray  # of symbol 256 + k: the left part
    right: np.ndarray
    ids: np.ndarray  # symbol -> id
    texts: list[bytes]  # symbol -> bytes
    keys: np.ndarray = field(init=False)  # sorted left << 32 | right
    made: np.ndarray = field(init=False)  # the symbol that the pair at the same place makes
    edges: np.ndarray = field(init=False)  # sorted node << 8 | byte of the tree of all symbols
    child: np.ndarray = field(init=False)
    accepts: np.ndarray = field(init=False)  # node -> symbol or -1
    lengths: np.ndarray = field(init=False)  # symbol -> bytes

    def __post_init__(self) -> None:
        keys = self.left.astype(np.int64) << 32 | self.right
        order = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[order], order.astype(np.int64) + 256
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        nodes: dict[tuple[int, int], int] = {}
        accepts = [-1]
        for symbol, text in enumerate(self.texts):
            at = 0
            for byte in text:
                nxt = nodes.get((at, byte))
                if nxt is None:
                    nxt = nodes[at, byte] = len(accepts)
                    accepts.append(-1)
                at = nxt
            accepts[at] = symbol
        edges = np.fromiter((a << 8 | b for a, b in nodes), np.int64, len(nodes))
        order = np.argsort(edges)
        self.edges, self.child = edges[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.accepts = np.array(accepts, np.int64)
        # symbols that exact merging never gives, not even for their own text, are never proposed
        left, right = self.left.astype(np.int64), self.right.astype(np.int64)
        alone = compatible(self, left, right, np.arange(len(left)) + 256)
        whole = np.append(np.ones(256, bool), alone)
        while not np.array_equal(whole[256:], now := alone & whole[left] & whole[right]):
            whole[256:] = now
        self.accepts[(self.accepts >= 0) & ~whole[self.accepts]] = -1

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, -1 if none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.made[at], NONE)


def parse_vocabulary(data: bytes) -> Vocabulary:
    """From the bytes of a JSON file (vocab and merges) or a file of base64 tokens with ranks."""
    if data.lstrip()[:1] == b"{":
        model = json.loads(data)["model"]
        letters = _byte_letters()
        text = lambda s: bytes(letters[c] for c in s)
        ids = {text(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        pairs = [tuple(text(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    else:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        pairs = [_last_merge(t, ids) for t in sorted((t for t in ids if len(t) > 1), key=ids.__getitem__)]
    texts = [bytes([b]) for b in range(256)]
    number = {t: k for k, t in enumerate(texts)}
    left, right = [], []
    for a, b in pairs:
        left.append(number[a])
        right.append(number[b])
        number.setdefault(a + b, len(texts))
        texts.append(a + b)
    return Vocabulary(np.array(left, np.int64), np.array(right, np.int64), np.array([ids[t] for t in texts], np.int32), texts)


def _last_merge(token: bytes, ids: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge makes the token, found by merging its bytes by ranks below its own."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        ranks = [ids.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:], strict=False)]
        k = min(range(len(ranks)), key=ranks.__getitem__)
        if ranks[k] == 1 << 40:
            raise ValueError(f"{token!r} can't be made by merges")
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


def flatten(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    offs = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=offs[1:])
    return flat, offs


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1] and so on."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


def merge_in_step(vocab: Vocabulary, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, number of them for each piece): pieces of any length, laid end to end, merged exactly, all in step.

    In each step the adjacent pairs are joined with the merges, and each piece applies its lowest-ranked one
    wherever it stands, from the left. Pieces without any more are done and leave; only pairs beside a new symbol are joined anew.
    """
    n_pieces = len(counts)
    symbols, piece = flat.astype(np.int64), np.repeat(np.arange(n_pieces), counts)
    out_symbols, out_piece = [], []
    inner = piece[1:] == piece[:-1] if len(piece) else np.zeros(0, bool)
    made = np.full(len(symbols), NEVER)
    pair = np.flatnonzero(inner)
    new = vocab.merged(symbols[pair], symbols[pair + 1])
    made[pair] = np.where(new < 0, NEVER, new)
    while len(symbols):
        head = np.ones(len(piece), bool)
        head[1:] = piece[1:] != piece[:-1]
        starts = np.flatnonzero(head)
        lowest = np.minimum.reduceat(made, starts)
        size = np.diff(np.append(starts, len(piece)))
        if (lowest == NEVER).any():
            done = np.repeat(lowest == NEVER, size)
            out_symbols.append(symbols[done])
            out_piece.append(piece[done])
            symbols, piece, made = symbols[~done], piece[~done], made[~done]
            size, lowest = size[lowest < NEVER], lowest[lowest < NEVER]
            if not len(symbols):
                break
        hit = made == np.repeat(lowest, size)
        # where a symbol could go with either neighbour, pairs are taken from the left: every second of a run
        at = np.flatnonzero(hit)
        run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        touched = np.zeros(len(symbols), bool)
        touched[at] = True
        symbols, piece, made, touched = symbols[keep], piece[keep], made[keep], touched[keep]
        touched[:-1] |= touched[1:].copy()
        pair = np.flatnonzero(touched)
        made[pair] = NEVER
        pair = pair[pair + 1 < len(symbols)]
        pair = pair[piece[pair] == piece[pair + 1]]
        new = vocab.merged(symbols[pair], symbols[pair + 1])
        made[pair] = np.where(new < 0, NEVER, new)
    if not out_symbols:
        return np.zeros(0, np.int64), np.zeros(n_pieces, np.int64)
    symbols, piece = np.concatenate(out_symbols), np.concatenate(out_piece)
    return symbols[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=n_pieces)


def greedy(vocab: Vocabulary, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, place in flat at which each ends), in order of places: in each range the longest symbol that fits, again
    and again, for all ranges in step."""
    flat = np.append(flat, 256)  # no edge has this
    at, end = starts.copy(), ends
    node, best, best_end = np.zeros_like(at), np.full_like(at, -1), at.copy()
    symbols, places = [], []
    while len(at):
        byte = np.where(at < end, flat[np.minimum(at, len(flat) - 1)], 256)
        key = node << 8 | byte
        place = np.minimum(np.searchsorted(vocab.edges, key), len(vocab.edges) - 1)
        go = (vocab.edges[place] == key) & (byte < 256)
        node = np.where(go, vocab.child[place], 0)
        at = at + go
        sym = np.where(go, vocab.accepts[node], NONE)
        hit = sym >= 0
        best, best_end = np.where(hit, sym, best), np.where(hit, at, best_end)
        stop = ~go
        if stop.any():
            symbols.append(best[stop])
            places.append(best_end[stop])
            at = np.where(stop, best_end, at)
            best = np.where(stop, NONE, best)
            keep = ~(stop & (at >= end))
            at, end, node, best, best_end = (x[keep] for x in (at, end, node, best, best_end))
    if not symbols:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol, place = np.concatenate(symbols), np.concatenate(places)
    order = np.argsort(place)
    return symbol[order], place[order]


def compatible(vocab: Vocabulary, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Whether exact merging leaves the symbols a, b of each pair side by side.

    The merges that made the two are undone from the latest: if at some time the parts that touch
    would have merged across the border before the merge that was undone last, the pair can't stay. ``limit``: merges
    across the border count from the first only if they are earlier than these.
    """
    ok = np.ones(len(a), bool)
    live = np.arange(len(a))
    a, b = a.copy(), b.copy()
    limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
    while len(live):
        made = vocab.merged(a, b)
        bad = (made >= 0) & (made < limit)
        ok[live[bad]] = False
        later = a > b  # a was made by a later merge than b; at a tie, the left one is merged first
        cut = np.where(later, a, b)
        base = cut < 256
        # where the later of the two is a byte, both are bytes: nothing is left to undo
        keep = ~bad & ~base
        live, a, b, later, cut = (x[keep] for x in (live, a, b, later, cut))
        new_a = np.where(later, vocab.right[cut - 256], a)
        new_b = np.where(later, b, vocab.left[cut - 256])
        # a merge across the border comes first if it is earlier, or equal and further left
        limit = np.where(later, cut, cut + 1)
        a, b = new_a, new_b
    return ok


class Encoder:
    """Pieces to ids with what one process has seen so far; forgetting it changes no result."""

    def __init__(self, vocab: Vocabulary, keep: int = 300_000) -> None:
        self.vocab, self.keep = vocab, keep
        self.tokens = self.redone = 0
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.offs = np.zeros(1 << 14, np.int64)
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)

    def _stay(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs of symbols stay side by side; each different pair is worked out once."""
        new = np.setdiff1d(keys, self.pair_keys)
        if len(new):
            ok = compatible(self.vocab, new >> 32, new & 0xFFFFFFFF)
            keys_all, ok_all = np.append(self.pair_keys, new), np.append(self.pair_ok, ok)
            order = np.argsort(keys_all)
            self.pair_keys, self.pair_ok = keys_all[order], ok_all[order]
        return self.pair_ok[np.searchsorted(self.pair_keys, keys)]

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of new pieces of any length.

        Greedy tokens are proposed for all, and every adjacent pair is checked. Tokens whose adjacent pairs all can stay
        are what exact merging gives, so only around a pair that can't is a stretch of tokens merged exactly,
        and its borders are checked again, with twice the tokens around what fails again, until nothing fails.
        """
        flat, offs = flatten(pieces)
        parts = -(-np.diff(offs) // PART)
        starts = np.repeat(offs[:-1], parts) + ranges(np.zeros(len(parts), np.int64), parts) * PART
        symbols, ends = greedy(self.vocab, flat, starts, np.minimum(starts + PART, np.repeat(offs[1:], parts)))
        border = np.zeros(len(flat) + 1, bool)
        border[offs] = True
        pair = np.flatnonzero(~border[ends[:-1]])
        self.tokens += len(symbols)
        around = 1
        while len(pair):
            bad = pair[~self._stay(symbols[pair] << 32 | symbols[pair + 1])]
            if not len(bad):
                break
            # stretches of tokens around failing pairs, within their pieces; those that share tokens are one
            piece = np.searchsorted(offs, ends[bad], "right") - 1
            first, last = np.searchsorted(ends, offs[piece], "right"), np.searchsorted(ends, offs[piece + 1], "left")
            lo, hi = np.maximum(bad + 1 - around, first), np.minimum(bad + around, last) + 1
            new = np.append(True, lo[1:] >= np.maximum.accumulate(hi)[:-1])
            lo, hi = lo[new], np.maximum.reduceat(hi, np.flatnonzero(new))
            self.redone += int((hi - lo).sum())
            begin = np.where(lo > 0, ends[lo - 1], 0)
            size = ends[hi - 1] - begin
            merged, counts = merge_in_step(self.vocab, flat[ranges(begin, size)], size)
            length = self.vocab.lengths[merged]
            inner = np.cumsum(length) - np.repeat(np.cumsum(size) - size, counts) + np.repeat(begin, counts)
            old = np.ones(len(symbols), bool)
            old[ranges(lo, hi - lo)] = False
            fresh = np.append(np.zeros(int(old.sum()), bool), np.ones(len(merged), bool))
            symbols, ends = np.append(symbols[old], merged), np.append(ends[old], inner)
            order = np.argsort(ends)
            symbols, ends, fresh = symbols[order], ends[order], fresh[order]
            # what was merged exactly is right within; only the pairs at its borders are open
            pair = np.flatnonzero((fresh[1:] != fresh[:-1]) | (np.isin(ends[:-1], begin) & fresh[1:]))
            pair = pair[~border[ends[pair]]]
            around *= 2
        counts = np.diff(np.searchsorted(ends, offs, "right"))
        ends_of = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(counts, out=ends_of[1:])
        return self.vocab.ids[symbols], ends_of

    def indices(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in what is known; new ones are encoded first."""
        found = list(map(self.known.get, pieces))
        if None in found:
            new = list({p for p, k in zip(pieces, found, strict=True) if k is None})
            if len(self.known) + len(new) > self.keep and self.known:
                self.forget()
                return self.indices(pieces)
            ids, offs = self._encode([p.encode("utf-8") for p in new])
            n, end = len(self.known), int(self.offs[len(self.known)])
            self.known.update(zip(new, range(n, n + len(new)), strict=True))
            while len(self.offs) < n + len(new) + 1:
                self.offs = np.append(self.offs, np.zeros_like(self.offs))
            while len(self.flat) < end + len(ids):
                self.flat = np.append(self.flat, np.zeros_like(self.flat))
            self.flat[end : end + len(ids)] = ids
            self.offs[n : n + len(new) + 1] = offs + end
            found = list(map(self.known.__getitem__, pieces))
        return np.array(found, np.int64)

    def counts(self, index: np.ndarray) -> np.ndarray:
        return self.offs[index + 1] - self.offs[index]

    def gather(self, index: np.ndarray) -> np.ndarray:
        """All ids of these pieces, one after another."""
        count = self.counts(index)
        total = int(count.sum())
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.offs[index] - (ends - count), count) + np.arange(total)]
