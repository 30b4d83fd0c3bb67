"""Byte-level BPE: merges compiled into a lazily determinised transducer, and a streaming UTF-8 decoder."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import KEPT, map_columns, to_bytes

#: Bounds of the per-process tables: states of the transducer, pairs of tokens and spines remembered, and pieces remembered
#: in each of two generations.
MAX_STATES, MAX_PAIRS, MAX_SPINES, MAX_PIECES = 40_000, 160_000, 20_000, 160_000
#: Bytes that may be left of a piece for it to be ended without new states; longer ones go from state to state.
SHORT = 64
#: Visits after which a state's arcs are kept.
WARM = 16


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from the text of a rank file: base64 token, space, rank, on each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


#: Rank of a pair that isn't a token.
_NEVER = 1 << 60
#: Stands for the token before the first.
_NONE = -1
#: Bits of a token id in the key of a pair of tokens.
_ID = 20


class State(dict):
    """Arcs (byte -> next state, tokens settled by it), once taken, and what the state stands for."""

    __slots__ = ("before", "text", "last", "live", "warm", "end")

    def __init__(self, before: int, text: bytes, last: list[int | None], live: list[tuple[int, dict]]):
        """last: the last token at each position; live: the live positions, each with what can follow in the trie."""
        self.before, self.text, self.last, self.live = before, text, last, live
        self.warm, self.end = 0, None


class Transducer:
    """Left-to-right BPE as a finite-state transducer, determinised as inputs reach its states.

    A token sequence is the BPE encoding of its text exactly if each two neighbours encode, joined, to themselves.
    So each prefix of a text has one last token: the one that ends there and fits the last token of the prefix
    before it. Positions from which some vocabulary token could still run on are live; what the paths of all live
    positions share can't change any more and is emitted. A state is the last token emitted and the bytes read
    since, with the last token at each of their positions and the live ones; the lookahead is bounded by the
    longest token. Arcs are made when first taken, then kept.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << _ID:
            raise ValueError("too many tokens")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        #: The vocabulary's trie. A node: byte -> (token that ends with it, or -1; the node after it, or None).
        self.trie: dict[int, tuple[int, dict | None]] = {}
        for t, i in ranks.items():
            node = self.trie
            for b in t[:-1]:
                end, after = node.get(b, (-1, None))
                if after is None:
                    after = {}
                    node[b] = end, after
                node = after
            node[t[-1]] = i, node.get(t[-1], (-1, None))[1]
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], list] = {}
        self.states: dict[tuple[int, bytes], State] = {}
        self.start = State(_NONE, b"", [_NONE], [(0, self.trie)])

    def merge(self, text: bytes, least: int = 1) -> list[bytes]:
        """The encoding by the merges themselves, down to `least` parts: the pair of lowest rank first, the leftmost of equals."""
        ranks = self.ranks
        parts = [text[i : i + 1] for i in range(len(text))]
        pairs = [ranks.get(text[i : i + 2], _NEVER) for i in range(len(text) - 1)]
        while len(parts) > least:
            low = min(pairs)
            if low == _NEVER:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
        return parts

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts that stand at one end of a token while it is made, largest first: each with the rank that makes
        it and the rank of the merge that uses it up."""
        got = self.spines.get((token, right))
        if got is None:
            if len(self.spines) >= MAX_SPINES:
                self.spines.clear()
            got, t, used = [], self.tokens[token], _NEVER
            while True:
                made = self.ranks[t] if len(t) > 1 else -1
                got.append((t, made, used))
                if len(t) == 1:
                    break
                used, t = made, self.merge(t, 2)[right]
            self.spines[token, right] = got
        return got

    def _fits(self, before: int, token: int) -> bool:
        """By the spines: joined, the tokens stay apart unless two parts that exist at one time make a token over their
        border. Of equal ranks the left one merges first. A token of lower rank than its parts is left to the merges."""
        for x, made_x, used_x in self.spine(before, True):
            for y, made_y, used_y in self.spine(token, False):
                r = self.ranks.get(x + y)
                if r is not None:
                    if r < made_x or r < made_y:
                        whole = [self.tokens[before], self.tokens[token]]
                        return self.merge(b"".join(whole)) == whole
                    if r < used_x and r <= used_y:
                        return False
        return True

    def fit(self, before: int, token: int) -> bool:
        """Whether token may follow the token before it (none at the start)."""
        key = before << _ID | token
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= MAX_PAIRS:
                self.fits.clear()
            if before == _NONE:
                got = self.merge(self.tokens[token]) == [self.tokens[token]]
            else:
                got = self.fit(_NONE, token) and self._fits(before, token)
            self.fits[key] = got
        return got

    def _step(self, last: list[int | None], live: list[tuple[int, dict]], byte: int) -> list[tuple[int, dict]]:
        """Appends the last token at the position after a byte; returns the positions live there."""
        known, end, on = self.fits, None, []
        for s, node in live:
            to = node.get(byte)
            if to is not None:
                token, after = to
                if end is None and token >= 0:
                    fit = known.get(last[s] << _ID | token)
                    if fit or fit is None and self.fit(last[s], token):
                        end = token
                if after is not None:
                    on.append((s, after))
        if end is not None:
            on.append((len(last), self.trie))
        last.append(end)
        return on

    def _path(self, last: list[int | None], at: int) -> list[int]:
        """The tokens up to a position."""
        out, sizes = [], self.sizes
        while at:
            token = last[at]
            if token is None:
                raise ValueError("the ranks don't cover this byte sequence")
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def _arc(self, state: State, byte: int) -> tuple[State, list[int]]:
        """The next state for a byte and the tokens that are settled by it."""
        last = list(state.last)
        live = self._step(last, state.live, byte)
        if not live:
            raise ValueError("the ranks don't cover this byte sequence")
        # the latest position that the paths of all live positions share: always move the one that is furthest
        at = {s for s, _ in live}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - self.sizes[last[far]])
        cut = at.pop()
        text = state.text + bytes((byte,))
        if not cut:
            return State(state.before, text, last, live), []
        return State(last[cut], text[cut:], last[cut:], [(s - cut, node) for s, node in live]), self._path(last, cut)

    def _known(self, state: State) -> State:
        if len(self.states) >= MAX_STATES:
            self.states.clear()
            self.start.clear()
        return self.states.setdefault((state.before, state.text), state)

    def finish(self, state: State) -> list[int]:
        """The tokens still held back at the end of the input."""
        if state.end is None:
            state.end = self._path(state.last, len(state.last) - 1)
        return state.end

    def _tail(self, state: State, rest: bytes) -> list[int]:
        """The tokens of a state followed by a short rest, without making states on the way."""
        last, live = list(state.last), state.live
        for b in rest:
            live = self._step(last, live, b)
        return self._path(last, len(last) - 1)

    def encode(self, piece: bytes) -> list[int]:
        state, out = self.start, []
        for i, b in enumerate(piece):
            arc = state.get(b)
            if arc is None:
                if state.warm >= WARM:  # arcs are kept where a state is met again and again: most words of a corpus come once
                    arc = self._arc(state, b)
                    arc = state[b] = self._known(arc[0]), arc[1]
                else:
                    state.warm += 1
                    if len(piece) - i <= SHORT:
                        return out + self._tail(state, piece[i:])
                    arc = self._arc(state, b)
            state, got = arc
            if got:
                out += got
        return out + self.finish(state)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Slots in which a piece leaves its mark when first seen.
_MARKS = 1 << 21


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; others run through the transducer.

    A piece is remembered from its second sight on, as most words of a corpus come once. There are two generations:
    when the younger one is full it becomes the older one, and what is asked for again comes back from there.
    """

    def __init__(self, machine: Transducer):
        self.machine, self.older, self.marks, self.marked = machine, {}, bytearray(_MARKS), 0

    def __missing__(self, piece: str) -> bytes:
        got = self.older.pop(piece, None)
        if got is None:
            got = _pack(self.machine.encode(piece.encode()))
            mark = hash(piece) % _MARKS
            if not self.marks[mark]:
                self.marks[mark] = 1
                self.marked += 1
                if 2 * self.marked > _MARKS:
                    self.marks, self.marked = bytearray(_MARKS), 0
                return got
            if len(piece) > 64:
                return got
        if len(self) >= MAX_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = got
        return got


#: A public split pattern, and what it comes to on ASCII texts.
_ASCII_FORM = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""": r"""'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
}


class Encoder:
    """Texts to ids: each match of the pattern by itself, no special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.find = regex.compile(pattern).findall
        #: Texts of ASCII only are split by a plainer pattern where it is known to split alike.
        self.find_ascii = re.compile(_ASCII_FORM[pattern]).findall if pattern in _ASCII_FORM else self.find
        self.pieces = _Pieces(Transducer(ranks))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, (self.find_ascii if text.isascii() else self.find)(text))), dtype="<u4")


class Utf8Machine:
    """Incremental UTF-8: feed() returns what is complete, up to three bytes of an open sequence are the state."""

    def __init__(self):
        self.held = b""

    def feed(self, chunk: bytes) -> str:
        data, cut = self.held + chunk, 0
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead >= 0xC0:  # a sequence starts here; open if it wants more bytes than there are
                cut = back if (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > back else 0
                break
            if lead < 0x80:
                break
        self.held = data[len(data) - cut :]
        return data[: len(data) - cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids to bytes by table, and to text as a stream."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = np.array([b""] * (max(ranks.values(), default=-1) + 1), dtype=object)
        for t, i in ranks.items():
            self.table[i] = t

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[ids].tolist())

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of chunks of ids as they come; characters split over tokens or chunks come out whole."""
        machine = Utf8Machine()
        for ids in chunks:
            if text := machine.feed(self.decode_bytes(ids)):
                yield text
        if text := machine.close():
            yield text


_MADE: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def tables(raw: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """One encoder and decoder per process and vocabulary: states found by one task serve the next."""
    KEPT["bpe"] = _MADE.clear
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _MADE:
        ranks = read_ranks(raw)
        _MADE[key] = (Encoder(ranks, pattern), Decoder(ranks))
    return _MADE[key]


#: Ids decoded at a time by the streaming round trip.
CHUNK = 1 << 16


def _kernel(raw: bytes, pattern: str, with_ids: bool):
    def make():
        enc, dec = tables(raw, pattern)
        def kernel(texts):
            gc.disable()  # the tables hold no cycles, and walking them again and again takes longer than the encoding
            try:
                return encoded(texts)
            finally:
                gc.enable()

        def encoded(texts):
            n, ids_sha, text_sha, all_ids, ends = [], [], [], [], [0]
            for t in to_bytes(texts):
                ids = enc.encode(t.decode("utf-8", "replace"))
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                h = hashlib.sha256()
                for part in dec.stream(ids[k : k + CHUNK] for k in range(0, len(ids), CHUNK)):
                    h.update(part.encode())
                text_sha.append(h.hexdigest())
                if with_ids:
                    all_ids.append(ids.view(np.int32))
                    ends.append(ends[-1] + len(ids))
            out = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            if with_ids:
                flat = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
            return out

        return kernel

    return make


def bpe_encode(docs: DataFrame, vocabulary: str | bytes, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """All columns of docs and n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids array<int>.

    vocabulary is the path of a rank file (read on the driver; rank files are a few MB, and one over 32 MB is
    refused) or its bytes. Null and empty texts have no tokens and decode to nothing. Texts of any length are
    encoded whole; each row stands for itself, so repeated rows come back alike and an empty table stays empty.
    Input columns with the names of the results are replaced. No shuffle.
    """
    from .common import BROADCAST_BYTES

    raw = vocabulary
    if isinstance(raw, str):
        with open(raw, "rb") as f:
            raw = f.read()
    if len(raw) > BROADCAST_BYTES:
        raise ValueError(f"a vocabulary of {len(raw)} bytes is over the bound of {BROADCAST_BYTES}")
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(("token_ids", T.ArrayType(T.IntegerType())))
    return map_columns(docs, _kernel(raw, pattern, with_ids), [text_col], docs.columns, fields, keeps="bpe")
