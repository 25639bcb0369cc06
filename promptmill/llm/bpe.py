"""Byte-level BPE by a lazily determinised transducer, and incremental decoding.

The encoding of a prefix is fixed but for its end: a token can still be replaced as long as the
bytes since some earlier point may begin a longer token. A state of the transducer holds, for
every such point, the place in the trie of token bytes and the token that ends at the point.
Reading a byte moves every point in the trie and finds the one token that now ends the prefix
(the only one whose merges and those of its predecessor do not cross). The tokens on which all
points agree are emitted at the end of a piece, or after each ``WINDOW`` of a long one; what is
held back is bounded by that and the longest token. States and their transitions are built when
first met and kept up to ``MAX_STATES``; then the table starts anew, as lazily built automata do.

Pieces are read side by side, a byte of each at a time, so that numpy follows all known
transitions and builds all new ones of that byte at once.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptmill.llm.language_id import text_slices
from promptmill.llm.pretokens import encode_slice
from promptmill.llm.tasks import CACHES, arrow_map, bound_batches, ddl

MAX_STATES = 120_000
MAX_PAIRS = 300_000
MAX_PIECES = 400_000
SLICE_CHARS = 500_000
ROWS = 500  # texts that are Python strings at a time
BLOCK_BYTES = 1 << 18  # pieces that are read side by side
FEW = 24  # fewer pieces are read one after the other
WINDOW = 4096  # bytes of a piece that may be held back, besides the longest token
LOW = (1 << 32) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes pieces of bytes with ranked merges. Every single byte must be a token.

    Points are numbers: the node in the upper 32 bits, the last token plus one in the lower ones.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, max_pairs: int = MAX_PAIRS):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.bytes_of = {i: b for b, i in ranks.items()}
        # the trie of token bytes: children by node and byte in one number, the token that ends at a node, and the depth
        self.child: dict[int, int] = {}
        token, depth = [-1], [0]
        for b, i in ranks.items():
            node = 0
            for c in b:
                step = node << 8 | c
                node = self.child.get(step)
                if node is None:
                    node = self.child[step] = len(token)
                    token.append(-1)
                    depth.append(depth[step >> 8] + 1)
            token[node] = i
        self.token, self.depth = array("q", token), array("q", depth)
        edge = np.fromiter(self.child, np.int64, len(self.child))
        order = np.argsort(edge)
        self.edge, self.target = edge[order], np.fromiter(self.child.values(), np.int64, len(edge))[order]
        self.inner = np.zeros(len(token), bool)
        self.inner[edge >> 8] = True
        self.size = np.zeros(max(ranks.values(), default=0) + 1, np.int64)  # bytes of a token
        self.size[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        self.pairs: dict[int, bool] = {}  # by both tokens in one number
        self.split: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[bytes, int] = {}  # numbers by points
        self.points, self.begin, self.ended = array("q"), array("q", [0]), array("q")
        self.moves: dict[int, int] = {}  # by state and byte in one number
        self.start = self._state(array("q", [0]).tobytes())

    def _state(self, points: bytes) -> int:
        n = self.states.get(points)
        if n is None:
            n = self.states[points] = len(self.states)
            self.points.frombytes(points)
            self.begin.append(len(self.points))
            self.ended.append(self.points[-1] - 1)  # the last point is the end of what was read
        return n

    def merged(self, text: bytes, until: int = 1) -> list[bytes]:
        """Parts of ``text`` after merging the lowest rank again and again, down to ``until`` parts."""
        parts = [text[i: i + 1] for i in range(len(text))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte, and for a token that merges never make."""
        if token not in self.split:
            parts = self.merged(self.bytes_of[token], 2)
            whole = len(parts) == 2 and all(p in self.ranks for p in parts)
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if whole else None
        return self.split[token]

    def _fits(self, last: int, token: int) -> bool:
        """Whether ``token`` can stand behind ``last`` (-1: at the beginning).

        The merges inside the two tokens are undone, the latest first; the parts that then meet
        must not have a merge of their own that would have come before the undone one.
        """
        key = last << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.max_pairs:
                self.pairs.clear()
            if last < 0:
                known = self.merged(self.bytes_of[token]) == [self.bytes_of[token]]
            else:
                known = self._fits(-1, last) and self._fits(-1, token) and self._apart(last, token)
            self.pairs[key] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        before = 1 << 60
        while True:
            if self.ranks.get(self.bytes_of[left] + self.bytes_of[right], 1 << 60) < before:
                return False
            a, b = self._halves(left), self._halves(right)
            if a and (not b or left > right):
                before, left = left, a[1]
            elif b:
                before, right = right + 1, b[0]  # of equal ranks the left one merges first
            else:
                return True

    def _points(self, state: int) -> array:
        return self.points[self.begin[state]: self.begin[state + 1]]

    def _known(self, last: int, token: int) -> bool:
        known = self.pairs.get(last << 32 | token)
        return self._fits(last, token) if known is None else known

    def _move(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        points, ended = array("q"), -1
        for point in self._points(state):
            node, last = self.child.get((point >> 32) << 8 | byte), (point & LOW) - 1
            if node is None:
                continue
            if ended < 0 <= self.token[node] and self._known(last, self.token[node]):
                ended = self.token[node]
            if self.inner[node]:
                points.append(node << 32 | last + 1)
        if ended < 0:
            raise ValueError("a byte is no token")
        points.append(ended + 1)
        n = self.moves[state << 8 | byte] = self._state(points.tobytes())
        return n

    def _move_all(self, steps: np.ndarray) -> list[int]:
        """``_move`` for many states and bytes (in one number, all different) at once."""
        low, high = (np.frombuffer(self.begin, np.int64)[(steps >> 8) + k] for k in (0, 1))
        count = high - low
        owner = np.repeat(np.arange(len(steps)), count)
        point = np.frombuffer(self.points, np.int64)[np.arange(len(owner)) + (low - np.cumsum(count) + count)[owner]]
        edge = (point >> 32) << 8 | (steps & 255)[owner]
        at = np.minimum(np.searchsorted(self.edge, edge), len(self.edge) - 1)
        alive = self.edge[at] == edge
        owner, last, node = owner[alive], (point[alive] & LOW) - 1, self.target[at[alive]]
        token = np.frombuffer(self.token, np.int64)[node]
        # the longest token first; the next ones are tried for those that are left
        ended = np.full(len(steps), -1)
        left = np.flatnonzero(token >= 0)
        while len(left):
            turn = np.ones(len(left), bool)
            turn[1:] = owner[left[1:]] != owner[left[:-1]]
            tried = left[turn]
            pair, which = np.unique(last[tried] << 32 | token[tried], return_inverse=True)
            fits = np.array([self._known(k >> 32, k & LOW) for k in pair.tolist()], bool)[which]
            ended[owner[tried[fits]]] = token[tried[fits]]
            left = left[~turn]
            left = left[ended[owner[left]] < 0]
        if (ended < 0).any():
            raise ValueError("a byte is no token")
        stay = self.inner[node]
        count = np.bincount(owner[stay], minlength=len(steps)) + 1
        stop = np.cumsum(count)
        points = np.empty(stop[-1], np.int64)
        ends = np.zeros(len(points), bool)
        ends[stop - 1] = True
        points[ends], points[~ends] = ended + 1, node[stay] << 32 | last[stay] + 1
        raw, state = points.tobytes(), self._state
        after = [state(raw[a:b]) for a, b in zip((8 * (stop - count)).tolist(), (8 * stop).tolist(), strict=True)]
        self.moves.update(zip(steps.tolist(), after, strict=True))
        return after

    def _read(self, states: np.ndarray, read: np.ndarray) -> np.ndarray:
        """The states after one more byte of many pieces."""
        steps, which = np.unique(states << 8 | read, return_inverse=True)
        after = list(map(self.moves.get, steps.tolist()))
        new = [i for i, n in enumerate(after) if n is None]
        if new:
            for i, n in zip(new, self._move_all(steps[new]), strict=True):
                after[i] = n
        return np.array(after, np.int64)[which]

    def _rest(self, piece: bytes, at: int, points: bytes, ended: np.ndarray) -> bytes:
        """Ids of a long piece, of which ``at`` bytes are read up to these points: ``ended`` has the tokens that ended at each.

        After every window, the tokens on which all points agree are emitted.
        """
        out: list[bytes] = []
        first, size = 0, self.size  # ``ended`` begins with the token that ends at byte ``first``
        while at < len(piece):
            if len(self.states) > self.max_states:
                self._reset()
            state, moves, seen = self._state(points), self.moves, []
            for byte in piece[at: at + WINDOW]:
                step = moves.get(state << 8 | byte)
                state = self._move(state, byte) if step is None else step
                seen.append(state)
            at += len(seen)
            points = self._points(state).tobytes()
            ended = np.concatenate((ended, np.array([self.ended[n] for n in seen], np.int32)))
            places = {at - self.depth[p >> 32] for p in self._points(state)} if at < len(piece) else {at}
            while len(places) > 1:  # back from the last one until all are the same
                last = max(places)
                places.remove(last)
                places.add(last - int(size[ended[last - first - 1]]))
            agreed = places.pop()
            back, tokens = agreed, []
            while back > first:
                tokens.append(int(ended[back - first - 1]))
                back -= int(size[tokens[-1]])
            out.append(array("I", reversed(tokens)).tobytes())
            ended, first = ended[agreed - first:], agreed
        return b"".join(out)

    def _run(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of some pieces, the longest first."""
        if len(self.states) > self.max_states:
            self._reset()
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ended = np.empty(len(data), np.int32)
        states, at = np.full(len(pieces), self.start), 0
        more = np.searchsorted(-size, -np.arange(WINDOW + 1))  # pieces of more than so many bytes
        while at < WINDOW and more[at] >= FEW:
            place = first[: more[at]] + at
            states = self._read(states[: more[at]], data[place])
            ended[place] = np.frombuffer(self.ended, np.int64)[states]
            at += 1
        long = int(np.searchsorted(-size, -at))
        points = [self._points(n).tobytes() for n in states[:long].tolist()]
        out = [self._rest(pieces[i], at, points[i], ended[a: a + at]) for i, a in enumerate(first[:long].tolist())]
        # back from the end of every other piece
        emit, back, low = np.zeros(len(data), bool), (first + size)[long:], first[long:]
        while len(back):
            emit[back - 1] = True
            back = back - self.size[ended[back - 1]]
            back, low = back[back > low], low[back > low]
        count = np.concatenate(([0], np.cumsum(emit)))
        raw, cut = ended[emit].astype(np.uint32).tobytes(), (4 * count[np.append(first, len(data))[long:]]).tolist()
        return out + [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces as 32-bit values; a piece that is a token itself is that token."""
        whole = list(map(self.ranks.get, pieces))
        out = [b"" if i is None else array("I", [i]).tobytes() for i in whole]
        left = [k for k, i in enumerate(whole) if i is None and pieces[k]]
        left.sort(key=lambda k: len(pieces[k]), reverse=True)
        low = 0
        while low < len(left):
            high, held = low, 0
            while high < len(left) and (held < BLOCK_BYTES or high == low):
                held += len(pieces[left[high]])
                high += 1
            for k, ids in zip(left[low:high], self._run([pieces[k] for k in left[low:high]]), strict=True):
                out[k] = ids
            low = high
        return out

    def encode(self, piece: bytes) -> list[int]:
        return array("I", self.encode_all([piece])[0]).tolist()


class StreamDecoder:
    """Ids to text piece by piece: bytes of an unfinished character wait for the next ids.

    ``errors`` says what becomes of bytes that are no UTF-8, as in ``bytes.decode``.
    """

    def __init__(self, bytes_of: dict[int, bytes], errors: str = "replace"):
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)

    def decode(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        for ids in chunks:
            text = self.feed(ids)
            if text:
                yield text
        rest = self.feed((), True)
        if rest:
            yield rest


_kept: dict[str, tuple[Transducer, dict]] = {}
CACHES.append(_kept)


def machine(path: str, content: bytes, room: float = 1.0) -> tuple[Transducer, dict]:
    """The transducer of a rank file and the pieces it has met, kept by a Python worker between tasks."""
    if path not in _kept:
        _kept.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _kept[path] = Transducer(ranks, int(MAX_STATES * room), int(MAX_PAIRS * room)), {}
    return _kept[path]


def few_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, len(batch), ROWS))


def encoded(texts: list[str], transducer: Transducer, known: dict, room: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts, end to end, and the first of each; every match of the public pattern is encoded by itself."""
    return encode_slice(texts, known, lambda pieces: transducer.encode_all([p.encode("utf-8", "surrogatepass") for p in pieces]), int(MAX_PIECES * room))


def encode(docs: DataFrame, path: str, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``ids array<int>`` of every row; a null text has no ids."""
    content = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())  # a vocabulary, some MB
    bound_batches(docs.sparkSession)
    chosen = docs.select(*keys, F.col(text).cast("string").alias("_text"))

    def run(batches):
        transducer, known = machine(path, content.value)
        for batch in few_rows(batches):
            for at, part in text_slices(batch.column("_text").to_pylist(), SLICE_CHARS):
                ids, first = encoded(part, transducer, known)
                lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(part)) for k in keys), lists], [*keys, "ids"])

    return arrow_map(chosen, run, f"{ddl(chosen, keys)}, ids array<int>")


def decode(rows: DataFrame, path: str, keys: list[str], ids: str = "ids", chunk: int = 4096) -> DataFrame:
    """``keys`` and the text of every row of ids (null: empty), decoded in chunks; broken UTF-8 becomes replacement characters."""
    content = rows.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    chosen = rows.select(*keys, F.col(ids).alias("_ids"))

    def run(batches):
        transducer, _ = machine(path, content.value)
        for batch in batches:
            texts = ["".join(_decoded(transducer, x or [], chunk, "replace")) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string())], [*keys, "text"])

    return arrow_map(chosen, run, f"{ddl(chosen, keys)}, text string")


def _decoded(transducer: Transducer, ids: list[int], chunk: int, errors: str) -> Iterator[str]:
    return StreamDecoder(transducer.bytes_of, errors).decode(ids[i: i + chunk] for i in range(0, len(ids), chunk))


def round_trip(docs: DataFrame, path: str, keys: list[str], text: str = "text", chunk: int = 4096, room: float = 1.0) -> DataFrame:
    """``keys``, ``n_tokens``, ``ids_sha256`` (little-endian unsigned 32-bit ids), ``decoded_sha256`` (bytes decoded from the ids).

    A null text is encoded as an empty one. Repeated rows give repeated results. ``room`` scales the tables
    that a worker keeps (results do not depend on it): less memory, more work.
    """
    content = docs.sparkSession.sparkContext.broadcast(open(path, "rb").read())
    bound_batches(docs.sparkSession)
    chosen = docs.select(*keys, F.col(text).cast("string").alias("_text"))

    def run(batches):
        transducer, known = machine(path, content.value, room)
        for batch in few_rows(batches):
            for at, part in text_slices(batch.column("_text").to_pylist(), SLICE_CHARS):
                ids, first = encoded(part, transducer, known, room)
                raw, cut = ids.astype("<u4").tobytes(), first.tolist()
                listed, back, code = ids.tolist(), [], []
                for a, b in zip(cut, cut[1:], strict=False):
                    code.append(hashlib.sha256(raw[4 * a: 4 * b]).hexdigest())
                    digest = hashlib.sha256()
                    for piece in _decoded(transducer, listed[a:b], chunk, "surrogatepass"):
                        digest.update(piece.encode("utf-8", "surrogatepass"))
                    back.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, len(part)) for k in keys), pa.array(np.diff(first)), pa.array(code), pa.array(back)],
                    [*keys, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(chosen, run, f"{ddl(chosen, keys)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
