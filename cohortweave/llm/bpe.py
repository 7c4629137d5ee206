"""Byte-level BPE as a lazily determinised finite-state transducer.

A pretoken's bytes are read one by one.  What may still come are tokens that have
begun and are not complete: *hypotheses*, each a node of the tokens' trie and the token
that ends where it begins.  A state is a set of hypotheses; reading a byte moves all
of them at once (the subset construction), and states and their moves are made when
first met.  At most ``max_states`` are kept, further ones are made anew each time.

A move tells the last token of the encoding of what has been read: the one token that
ends here and is *compatible* with the token before it (two tokens are compatible if
merging their joined bytes gives just these two).  So each prefix has one chain of
boundaries.  A later token can only start where a hypothesis does; boundaries that the
chains of all hypotheses share are final, and the tokens before them are given out.
The lookahead that needs is bounded by the longest token.

The trie's nodes are linked to their longest proper suffix in the trie, so the longest
hypothesis names all of them and a state is that node with the tokens before them.

Decoding is streamed: ids become bytes, and a finite automaton over byte classes tells
after each byte whether a character is complete; an incomplete one waits.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm._chunks import CHUNK, Memory, groups

MAX_STATES = 300_000
MAX_PAIRS = 1_000_000
#: Bytes of one pretoken after which tokens whose boundaries are final are given out.
FLUSH = 4096
_REMEMBERED = 80_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Transducer:
    """The merges of one rank table, compiled lazily; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.child: dict[int, int] = {}  # the tokens' trie: node * 256 + byte to node
        self.ends_token, self.goes_on, self.depth, self.way = [-1], [True], [0], [(0, 0)]
        for t, rank in ranks.items():
            node = 0
            for byte in t:
                self.goes_on[node] = True
                key = node << 8 | byte
                to = self.child.get(key, -1)
                if to < 0:
                    to = self.child[key] = len(self.goes_on)
                    self.ends_token.append(-1)
                    self.goes_on.append(False)
                    self.depth.append(self.depth[node] + 1)
                    self.way.append((node, byte))
                node = to
            self.ends_token[node] = rank
        self.max_states = max_states
        self.suffix: dict[int, int] = {0: 0}  # a node's longest proper suffix in the trie
        self.lists: dict[int, tuple[int, ...]] = {}
        self.reads: dict[int, tuple[int, tuple, tuple]] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[bytes, tuple[list, list] | None] = {}
        self.ids: dict[tuple, int] = {(0, (-1,)): 0}
        self.states: list[tuple[int, tuple[int, ...]]] = [(0, (-1,))]
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, piece: bytes, below: float = float("inf")) -> list[bytes]:
        """The merges of ranks under ``below``: the lowest rank first, the leftmost of equal ones."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _sides(self, token: bytes) -> tuple[list, list] | None:
        """How a token's merges leave its two edges: the parts that stood at its left and at its right edge,
        each with the rank of the merge that ended it.  None for a token that merging does not make.
        """
        got = self.edges.get(token, False)
        if got is False:
            never = float("inf")
            if len(token) == 1:
                got = ([(token, never)], [(token, never)])
            else:
                halves, rank = self.merged(token, self.ranks[token]), self.ranks[token]
                first, second = (self._sides(h) for h in halves) if len(halves) == 2 else (None, None)
                got = None
                if first and second:
                    left = [(t, rank if t == halves[0] else e) for t, e in first[0]]
                    right = [(t, rank if t == halves[1] else e) for t, e in second[1]]
                    got = ([*left, (token, never)], [*right, (token, never)])
            self.edges[token] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` then ``b`` are how their joined bytes are encoded; a negative ``a``: whether merging makes ``b``.

        Merges run in the order of their ranks, so the parts at the common edge are
        joined only if that merge comes before those that end either of them.
        """
        right, get = self._sides(self.bytes_of[b]), self.ranks.get
        if right is None:
            return False
        if a >= 0:
            for x, x_ends in self._sides(self.bytes_of[a])[1]:
                for y, y_ends in right[0]:
                    r = get(x + y)
                    if r is not None and r < x_ends and r <= y_ends:
                        return False
        return True

    def _shorter(self, node: int) -> int:
        got = self.suffix.get(node)
        if got is None:
            parent, byte = self.way[node]
            got = self.suffix[node] = self._walk(self._shorter(parent), byte) if parent else 0
        return got

    def _walk(self, node: int, byte: int) -> int:
        """The longest suffix of a node's bytes and ``byte`` that is in the trie."""
        while True:
            to = self.child.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                return 0
            node = self._shorter(node)

    def _hypotheses(self, node: int) -> tuple[int, ...]:
        """Depths of the hypotheses in the node's state, the longest first; at last 0, that of a token yet to begin."""
        got = self.lists.get(node)
        if got is None:
            depths, at = [], node
            while at:
                if self.goes_on[at]:
                    depths.append(self.depth[at])
                at = self._shorter(at)
            got = self.lists[node] = (*depths, 0)
        return got

    def _read(self, node: int, byte: int) -> tuple[int, tuple, tuple]:
        """How a byte moves the hypotheses: the next node, the tokens that become complete (longest first, each
        with the place of its hypothesis), and the place of each hypothesis that goes on.
        """
        to, place = self._walk(node, byte), {d: k for k, d in enumerate(self._hypotheses(node))}
        complete, at = [], to
        while at:
            if self.ends_token[at] >= 0:
                complete.append((place[self.depth[at] - 1], self.ends_token[at]))
            at = self._shorter(at)
        got = self.reads[node << 8 | byte] = (to, tuple(complete), tuple(place[d - 1] for d in self._hypotheses(to)[:-1]))
        return got

    def _move(self, node: int, before: tuple[int, ...], byte: int) -> tuple[int, tuple[int, ...], int]:
        """The next node, the tokens before its hypotheses, and the last token of what has been read."""
        to, complete, goes_on = self.reads.get(node << 8 | byte) or self._read(node, byte)
        pairs = self.pairs
        for k, token in complete:
            key = before[k] << 20 | token
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) > MAX_PAIRS:
                    pairs.clear()
                fits = pairs[key] = self.compatible(before[k], token)
            if fits:
                return to, (*[before[k] for k in goes_on], token), token
        raise ValueError(f"no token ends with byte {byte}")

    def _chain(self, last: list[int], to: int) -> list[int]:
        """The tokens up to a boundary, from the last token of each prefix."""
        out, size = [], self.size
        while to > 0:
            token = last[to]
            out.append(token)
            to -= size[token]
        out.reverse()
        return out

    def _final(self, last: list[int], node: int) -> int:
        """The last boundary that the chains of all hypotheses share."""
        n, size = len(last) - 1, self.size
        cut = n
        for d in self._hypotheses(node):
            at = n - d
            while cut != at:
                if cut > at:
                    cut -= size[last[cut]]
                else:
                    at -= size[last[at]]
        return cut

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pretoken; a pretoken that is a token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        last = [-1]  # the last token of each prefix, from the last final boundary on
        moves, ids, states = self.moves, self.ids, self.states
        state, node, before = 0, 0, (-1,)
        for byte in piece:
            if state >= 0:
                step = moves.get(state << 8 | byte)
                if step is not None:
                    state, token = step
                    last.append(token)
                    continue
                node, before = states[state]
            node, before, token = self._move(node, before, byte)
            last.append(token)
            key = (node, before)
            to = ids.get(key, -1)
            if to < 0 and len(states) < self.max_states:
                to = ids[key] = len(states)
                states.append(key)
            if state >= 0 and to >= 0:
                moves[state << 8 | byte] = (to, token)
            state = to
            if len(last) > FLUSH:
                cut = self._final(last, node)
                out += self._chain(last, cut)
                last = last[cut:]
        return out + self._chain(last, len(last) - 1)


class Utf8:
    """UTF-8 as a finite automaton: ``step[state, byte]`` is the next state, ``held[state]`` the bytes read of an
    incomplete character.  0: a character is complete; ``BAD``: no character goes on like this.
    """

    BAD = 11
    held = np.array([0, 1, 1, 2, 1, 2, 3, 1, 1, 1, 1, 0])

    @staticmethod
    def table() -> np.ndarray:
        step = np.full((12, 256), Utf8.BAD, np.uint8)
        step[0, :0x80] = 0
        for state, lo, hi in ((1, 0xC2, 0xDF), (2, 0xE1, 0xEF), (4, 0xF1, 0xF3), (7, 0xE0, 0xE0), (8, 0xED, 0xED), (9, 0xF0, 0xF0), (10, 0xF4, 0xF4)):
            step[0, lo : hi + 1] = state
        for state, to in ((1, 0), (2, 3), (3, 0), (4, 5), (5, 6), (6, 0)):
            step[state, 0x80:0xC0] = to
        step[7, 0xA0:0xC0], step[8, 0x80:0xA0] = 3, 3  # neither overlong forms nor surrogates
        step[9, 0x90:0xC0], step[10, 0x80:0x90] = 5, 5
        return step


class Utf8Stream:
    """Token ids in, complete characters out; an incomplete character at the end waits (three bytes at most).

    The automaton reads whole tokens: how each token moves each state is computed once
    (``after``).  Bytes that no continuation can make valid come out as U+FFFD.
    """

    def __init__(self, bytes_of: list[bytes], after: np.ndarray) -> None:
        self.bytes_of, self.after = bytes_of, after
        self.state, self.rest = 0, b""

    @staticmethod
    def lifted(bytes_of: list[bytes]) -> np.ndarray:
        """``after[state, token]``: the automaton's state after all bytes of a token."""
        step, sizes = Utf8.table(), np.array([len(t) for t in bytes_of])
        state = np.repeat(np.arange(12, dtype=np.uint8)[:, None], len(bytes_of), 1)
        for k in range(int(sizes.max(initial=0))):
            some = np.flatnonzero(sizes > k)
            byte = np.array([bytes_of[t][k] for t in some.tolist()])
            state[:, some] = step[state[:, some], byte]
        return state

    def feed(self, ids: np.ndarray) -> str:
        data = self.rest + b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        unfinished = np.flatnonzero(self.after[0, ids])
        state, at = self.state, 0
        if state:
            unfinished = np.r_[0, unfinished]
        for k in unfinished.tolist():  # between these tokens the state is 0
            if k < at:
                continue
            at = k
            while at < len(ids):
                state = int(self.after[state, ids[at]])
                at += 1
                if not state or state == Utf8.BAD:
                    break
            if state == Utf8.BAD:
                return self._replaced(data)
        self.state = state
        cut = len(data) - int(Utf8.held[state])
        self.rest = data[cut:]
        return data[:cut].decode("utf-8")

    def _replaced(self, data: bytes) -> str:
        """Byte by byte, where some bytes are not UTF-8."""
        step, out, state, start = Utf8.table(), [], 0, 0
        for k, byte in enumerate(data):
            to = step[state, byte]
            if to == Utf8.BAD:
                if state:  # the bytes so far are one bad character; this byte begins anew
                    out.append("�")
                    start, to = k, step[0, byte]
                if to == Utf8.BAD:
                    out.append("�")
                    start, state = k + 1, 0
                    continue
            state = int(to)
            if not state:
                out.append(data[start : k + 1].decode("utf-8"))
                start = k + 1
        self.state, self.rest = state, data[start:]
        return "".join(out)

    def close(self) -> str:
        rest, self.rest, self.state = self.rest, b"", 0
        return "�" if rest else ""


class ByteBPE:
    """Encoder and streaming decoder of one rank file; short pieces are remembered."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        if pattern is None:
            from public_tokenizers import PATTERN as pattern  # noqa: N811
        self.fst = Transducer(load_ranks(path))
        self.split = regex.compile(pattern)
        self.pretokens = Memory(lambda p: ",".join(map(str, self.fst.encode(p.encode("utf-8", "surrogatepass")))), _REMEMBERED)
        self.chunks = Memory(lambda c: ",".join([self.pretokens[p] for p in self.split.findall(c)]), _REMEMBERED)
        self.bytes_of = [self.fst.bytes_of.get(k, b"") for k in range(max(self.fst.bytes_of) + 1)]
        self.after = Utf8Stream.lifted(self.bytes_of)

    def encode_joined(self, texts: list[str]) -> Iterator[str]:
        """For each text its ids in decimal, joined by commas."""
        for t in texts:
            yield ",".join(map(self.chunks.__getitem__, CHUNK.findall(t)))

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.encode_joined([text])).split(",") if x]

    def decode_stream(self, ids: Iterable[int] | np.ndarray, step: int = 1024) -> Iterator[str]:
        """Text as it becomes complete, ``step`` tokens at a time."""
        ids, machine = np.asarray(ids, np.int64), Utf8Stream(self.bytes_of, self.after)
        for at in range(0, len(ids), step):
            yield machine.feed(ids[at : at + step])
        yield machine.close()


@functools.cache
def _loaded(ranks_path: str) -> ByteBPE:
    return ByteBPE(ranks_path)


def round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` for every row.

    Null and empty texts have no token (the hashes are of nothing).  Repeated rows
    stay; null ids and extra columns don't matter; an empty table gives an empty one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks_path)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for texts in groups(t.as_py() for t in b.column(1)):
                for joined in bpe.encode_joined(texts):
                    ids = np.fromstring(joined, np.int64, sep=",") if joined else np.empty(0, np.int64)  # read anew, as from a file of ids
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                    digest = hashlib.sha256()
                    for part in bpe.decode_stream(ids, 1 << 16):
                        digest.update(part.encode("utf-8", "surrogatepass"))
                    text_hash.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(df: DataFrame, ranks_path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """``df`` with an array column of token ids (null texts: empty)."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _loaded(ranks_path)
        for s in batches:
            yield pd.Series([bpe.encode(t or "") for t in s])

    return df.withColumn(out_col, ids(F.col(text_col).cast("string")))
