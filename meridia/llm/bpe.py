"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

The tokens that merging by rank gives for a string are the only sequence in which
every two neighbours, merged alone, stay as they are.  So merges compile into a
nondeterministic transducer whose states are a place in the trie of tokens and
the token before it.  Its places are determinised on the fly: a state is the set
of places that the last bytes allow, with the tokens that may end there, and
transitions are kept by (state, byte).  Of the tokens that may end at a byte,
exactly one can follow the token before it, which is kept for each of the last
places; tokens leave as soon as all alternatives agree on them, which open ones
began no more bytes ago than the longest token has.
"""

from __future__ import annotations

import base64
import gc
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Kept, bound_batches

#: Transitions, pairs and cached pieces are dropped and built anew beyond these sizes.
MAX_MOVES, MAX_PAIRS, MAX_PIECES, MAX_PIECE_CHARS = 400_000, 300_000, 400_000, 64
#: Bytes of a piece after which the tokens that are settled leave.
LOOKAHEAD = 1 << 12
#: Patterns of which a space after a character that is not white space always begins a match.
SPACE_BEGINS = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)
#: Bytes of texts whose new words are encoded together.
BLOCK = 1 << 20
_NEVER = 1 << 60
_LONG_TEXT = 1 << 22


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge_by_rank(ranks: dict[bytes, int], text: bytes) -> list[bytes]:
    """The definition: join the neighbours of the lowest rank, leftmost first, until none is left."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes one piece (a match of the split pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.size[-1] = 0  # the start
        self.trie: dict[int, int] = {}  # node << 8 | byte -> node
        self.above, self.depth = [0], [0]  # by node: its parent << 8 | byte, its bytes
        self.ends: dict[int, int] = {}  # node -> token
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.trie.get(key, 0)
                if not node:
                    node = self.trie[key] = len(self.above)
                    self.above.append(key)
                    self.depth.append(self.depth[key >> 8] + 1)
            self.ends[node] = rank
        self.spines: dict[int, tuple | None] = {}
        self.pairs: dict[int, dict[int, bool]] = {}  # token -> token after it -> they stay apart
        self.known = 0  # pairs
        self._reset()

    def _reset(self) -> None:
        # a state is a set of trie nodes, all suffixes of the longest of them, which names it
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}  # state << 8 | byte -> state, what may end there
        self.rest: dict[int, int] = {0: 0}  # state -> the state of the same set without its longest node
        self.final: dict[int, tuple[tuple[int, int], ...]] = {0: ()}  # state -> (token, bytes) that may end there
        # the run over the piece before: bytes, the state and the last token of each prefix
        self.seen, self.run, self.last = b"", [0], [-1]

    def _to(self, state: int, byte: int) -> int:
        """The state after a byte: the longest node of the set that goes on, and its suffixes."""
        while True:
            node = self.trie.get(state << 8 | byte)
            if node is not None or not state:
                return node or 0
            state = self._rest(state)

    def _rest(self, state: int) -> int:
        todo = []
        while state not in self.rest:
            todo.append(state)
            state = self.above[state] >> 8
        for node in reversed(todo):  # from the shortest prefix on
            key = self.above[node]
            self.rest[node] = self._to(self.rest[key >> 8], key & 255) if key >> 8 else 0
        return self.rest[todo[0] if todo else state]

    def _final(self, state: int) -> tuple[tuple[int, int], ...]:
        todo = []
        while state not in self.final:
            todo.append(state)
            state = self._rest(state)
        found = self.final[state]
        for node in reversed(todo):
            token = self.ends.get(node)
            if token is not None and self._spines(token) is not None:
                found = ((token, self.size[token]), *found)
            self.final[node] = found
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        to = self._to(state, byte)
        self.moves[state << 8 | byte] = move = (to, self._final(to))
        return move

    def _spines(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """The pieces at the right and at the left edge of a token while it is merged,
        each with the rank of the merge that ends it; None if merging doesn't give the token."""
        known = self.spines.get(token, 0)
        if known != 0:
            return known
        text = self.token[token]
        parts, right, left, last = [text[i : i + 1] for i in range(len(text))], [], [], -1
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER or rank < last:  # ranks always rise in vocabularies that were learned by merging
                break
            last = rank
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        ends = None
        if len(parts) == 1:
            ends = (right + [(text, _NEVER)], left + [(text, _NEVER)])
        self.spines[token] = ends
        return ends

    def _follows(self, left: int, right: int) -> bool:
        """Whether ``right`` can come after ``left`` (-1: the start): no merge joins them."""
        ok = self.pairs[left].get(right) if left in self.pairs else None
        if ok is None:
            b = self._spines(right)
            if b is None or left < 0:
                return b is not None
            ok, ours, theirs, i, j, get = True, self._spines(left)[0], b[1], 0, 0, self.ranks.get
            while True:  # the pieces that meet at the border, in the order of merges
                (x, x_end), (y, y_end) = ours[i], theirs[j]
                rank = get(x + y, _NEVER)
                if rank < x_end and rank <= y_end and rank != _NEVER:
                    ok = False
                    break
                if x_end == y_end == _NEVER:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if self.known >= MAX_PAIRS:
                self.pairs, self.known = {}, 0
            self.pairs.setdefault(left, {})[right] = ok
            self.known += 1
        return ok

    def _settled(self, last: list[int], open_bytes: int) -> int:
        """The place up to which all alternatives agree: those that are open began in the last bytes."""
        places = set(range(max(0, len(last) - 1 - open_bytes), len(last)))
        while len(places) > 1:
            place = max(places)
            places.remove(place)
            places.add(place - self.size[last[place]])
        return places.pop()

    def _back(self, last: list[int], place: int) -> list[int]:
        """The tokens from the start of ``last`` to a place."""
        out, size = [], self.size
        while place > 0:
            token = last[place]
            out.append(token)
            place -= size[token]
        out.reverse()
        return out

    def _read(self, piece: bytes, run: list[int], last: list[int]) -> None:
        """Append the state and the last token after each byte."""
        moves, pairs, state, none = self.moves, self.pairs, run[-1], {}
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state, tokens = move
            for token, size in tokens:  # each prefix has one encoding, so one alternative ends here
                left = last[-size]
                ok = pairs.get(left, none).get(token)
                if ok is None:
                    ok = self._follows(left, token)
                    pairs = self.pairs
                if ok:
                    last.append(token)
                    break
            run.append(state)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece; a piece that is a token itself is that token.

        The run over bytes that the piece before began with too is not repeated.
        """
        rank = self.ranks.get(piece)
        if rank is not None:
            return (rank,)
        if len(piece) <= LOOKAHEAD:
            if len(self.moves) >= MAX_MOVES:
                self._reset()
            same = 0
            for a, b in zip(self.seen, piece):  # noqa: B905 - to the end of the shorter one
                if a != b:
                    break
                same += 1
            run, last = self.run[: same + 1], self.last[: same + 1]
            self._read(piece[same:], run, last)
            self.seen, self.run, self.last = piece, run, last
            return tuple(self._back(last, len(piece)))
        out, state, last = [], 0, [-1]
        for at in range(0, len(piece), LOOKAHEAD):
            if at:  # what all alternatives share leaves
                place = self._settled(last, self.depth[state])
                out += self._back(last, place)
                del last[:place]
                if len(self.moves) >= MAX_MOVES:
                    self._reset()
            run = [state]
            self._read(piece[at : at + LOOKAHEAD], run, last)
            state = run[-1]
        return (*out, *self._back(last, len(last) - 1))


class Encoder:
    """Encodes texts: each match of the split pattern by the transducer, with a cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError("a byte-level vocabulary has every single byte")
        self.pattern, self.transducer = regex.compile(pattern), Transducer(ranks)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.gap = regex.compile(r"\s ") if pattern in SPACE_BEGINS else None

    def _keep(self, piece: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(piece) <= MAX_PIECE_CHARS:
            if len(self.pieces) >= MAX_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _piece(self, piece: str) -> tuple[int, ...]:
        return self._keep(piece, self.transducer.encode(piece.encode("utf-8", "surrogatepass")))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """A stretch of text that begins and ends with a match; of one match only, it is that piece."""
        pieces = self.pattern.findall(chunk)
        if len(pieces) == 1 and pieces[0] == chunk:
            return self._piece(chunk)
        return tuple(chain.from_iterable([self.pieces.get(p) or self._piece(p) for p in pieces]))

    def _parts(self, text: str) -> tuple[list[str], bool]:
        """What is looked up: words up to spaces if each space begins a match (True), else matches."""
        if self.gap is None or self.gap.search(text):
            return self.pattern.findall(text), False
        first, *more = text.split(" ")
        return [first, *[" " + part for part in more]], True

    def _learn(self, parts: list[str], encode: Callable[[str], tuple[int, ...]]) -> None:
        """Parts not seen before, in order, so that neighbours begin alike."""
        new = set(parts).difference(self.pieces)
        if len(self.pieces) + len(new) > MAX_PIECES:
            self.pieces.clear()
            new = set(parts)
        for part in sorted(new):
            self._keep(part, encode(part))

    def _ids(self, parts: list[str], encode: Callable[[str], tuple[int, ...]]) -> np.ndarray:
        found = list(map(self.pieces.get, parts))
        if None in found:  # too long to be kept, or dropped
            found = [encode(part) if ids is None else ids for part, ids in zip(parts, found, strict=True)]
        return np.fromiter(chain.from_iterable(found), np.int32)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text; new words of all of them are encoded together."""
        split = [self._parts(text) if len(text) <= _LONG_TEXT else None for text in texts]
        for whole, encode in ((False, self._piece), (True, self._chunk)):
            self._learn(list(chain.from_iterable([x[0] for x in split if x and x[1] == whole])), encode)
        return [self._ids(x[0], self._chunk if x[1] else self._piece) if x else self._long(text) for x, text in zip(split, texts, strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def _long(self, text: str) -> np.ndarray:
        """A very long text: some matches at a time."""
        found, ids = (m[0] for m in self.pattern.finditer(text)), []
        while len(part := self._ids(list(islice(found, 100_000)), self._piece)):
            ids.append(part)
        return np.concatenate(ids)


#: The UTF-8 automaton.  States: 0 between characters, 1-3 so many continuation bytes to come,
#: 4 after E0, 5 after ED, 6 after F0, 7 after F4, 8 an error.
def _utf8_table() -> np.ndarray:
    t = np.full((9, 256), 8, np.uint8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0], t[0, 0xE0], t[0, 0xE1:0xF0], t[0, 0xED] = 1, 4, 2, 5
    t[0, 0xF0], t[0, 0xF1:0xF4], t[0, 0xF4] = 6, 3, 7
    t[1, 0x80:0xC0], t[2, 0x80:0xC0], t[3, 0x80:0xC0] = 0, 1, 2
    t[4, 0xA0:0xC0], t[5, 0x80:0xA0], t[6, 0x90:0xC0], t[7, 0x80:0x90] = 1, 1, 2, 2
    return t


_UTF8 = _utf8_table()


class StreamDecoder:
    """Decodes tokens as they come; bytes of an unfinished character wait for the next ones.

    The automaton's moves over whole tokens are tabled, so a stream costs one
    look-up for a token.  Bytes that are not UTF-8 become U+FFFD, one for each
    longest part of a character.
    """

    def __init__(self, tokens: list[bytes | None]):
        self.tokens = pa.array([t or b"" for t in tokens], pa.large_binary())
        self.known = np.array([t is not None for t in tokens])
        size = np.array([len(t or b"") for t in tokens])
        self.moves = np.repeat(np.arange(9, dtype=np.uint8)[:, None], len(tokens), axis=1)  # state, token -> state
        data, first = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8), np.cumsum(size) - size
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > k)
            self.moves[:, on] = _UTF8[self.moves[:, on], data[first[on] + k][None]]
        self.reset()

    def reset(self) -> None:
        self.state, self.held = 0, b""

    def bytes_of(self, ids: np.ndarray) -> pa.Array:
        """The bytes of each token; all of them lie in one buffer, in order."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.tokens.take(pa.array(ids))

    def whole(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the streams that end at these places are UTF-8 as they are.

        From each token that doesn't end between characters the automaton runs
        until it is there again; these runs go on in step.
        """
        odd = np.flatnonzero(self.moves[0][ids])
        row = np.searchsorted(ends, odd, side="right")
        stop, at, state = ends[row], odd + 1, self.moves[0][ids[odd]]
        live = np.arange(len(odd))
        while len(live := live[(state[live] != 0) & (state[live] != 8) & (at[live] < stop[live])]):
            state[live] = self.moves[state[live], ids[at[live]]]
            at[live] += 1
        after, true, k = np.searchsorted(odd, at).tolist(), [], 0
        while k < len(odd):  # runs that begin inside another one are none
            true.append(k)
            k = after[k]
        good = np.ones(len(ends), bool)
        good[row[true][state[true] != 0]] = False
        return good

    def feed(self, ids: np.ndarray) -> bytes:
        """The text that the next tokens complete, in UTF-8."""
        taken = self.bytes_of(ids)
        data = self.held + b"".join(taken.to_pylist())
        state, i = self.state, 0
        steps = self.moves[0][ids]  # from between characters; runs that stay there need no steps
        odd = np.flatnonzero(steps).tolist()
        while i < len(ids) and state != 8:
            if state == 0:
                k = bisect_left(odd, i)
                if k == len(odd):
                    break
                i = odd[k]
            state = int(self.moves[state, ids[i]])
            i += 1
        if state == 0:
            self.state, self.held = 0, b""
            return data
        if state == 8:  # not UTF-8: replace what is broken, keep an unfinished end
            return self._replaced(data, final=False)
        self.state = state
        cut = len(data) - 1
        while data[cut] & 0xC0 == 0x80:
            cut -= 1
        self.held = data[cut:]
        return data[:cut]

    def _replaced(self, data: bytes, final: bool) -> bytes:
        out, state, start = bytearray(), 0, 0
        table = _UTF8
        k = 0
        while k < len(data):
            after = int(table[state, data[k]])
            if after == 8:
                if state == 0:
                    out += b"\xef\xbf\xbd"
                    k += 1
                else:  # the part so far is broken; this byte begins anew
                    out += b"\xef\xbf\xbd"
                state, start = 0, k
                continue
            k += 1
            state = after
            if state == 0:
                out += data[start:k]
                start = k
        self.state, self.held = (0, b"") if final else (state, data[start:])
        if final and state:
            out += b"\xef\xbf\xbd"
        return bytes(out)

    def finish(self) -> bytes:
        """What is left: an unfinished character is broken."""
        return self._replaced(self.held, final=True)


_kept = Kept()


def _encoder(key: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """This worker's encoder; a function of the module, as what a task's own function refers to is copied for each task."""
    return _kept.take(key, lambda: Encoder(ranks, pattern))


def _task_over() -> None:
    _kept.rest()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Adds ``ids`` (array<int>): the text's tokens, without special tokens.

    ``docs`` needs ``text``; its other columns are kept (an ``ids`` column is replaced).
    Null and empty texts have no tokens; repeated rows give the same tokens each,
    an empty table gives an empty one.  A very long text is cut into matches some
    at a time.  Equal to merging by rank within each match of ``pattern``;
    characters that no match covers are left out.  The vocabulary is shipped to
    the workers once.
    """
    docs = docs.drop("ids")
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, *shipped.value)
        gc.disable()  # its millions of tuples hold no cycles; scanning them takes a fifth of the time
        try:
            yield from coded(encoder, batches)
        finally:
            gc.enable()
            _task_over()

    def coded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = K.string_buffers(batch.column("text"))
            for i, j in K.row_blocks(offsets, BLOCK):
                part = batch.slice(i, j - i)
                found = encoder.encode_all([text or "" for text in part.column("text").to_pylist()])
                at = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=at[1:])
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, docs.withColumn("ids", F.array().cast("array<int>")).schema)


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Replaces ``ids`` by ``decoded``: the text of the tokens, decoded as a stream.

    Null and empty ids give an empty text, an empty table an empty one.  An id
    outside the vocabulary is an error.  Bytes that are not UTF-8 become U+FFFD.
    """
    tokens = tokens.drop("decoded")
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shipped = tokens.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder(shipped.value)
        for batch in batches:
            column = batch.column("ids")
            values, at = np.asarray(column.flatten()), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()))
            for i, j in K.row_blocks(at, 1 << 18):
                ids = values[at[i] : at[j]]
                taken = decoder.bytes_of(ids)
                ends = np.asarray(pa.Array.from_buffers(pa.int64(), len(taken) + 1, [None, taken.buffers()[1]], offset=taken.offset))[at[i : j + 1] - at[i]]
                data, good = taken.buffers()[2] or pa.py_buffer(b""), decoder.whole(ids, at[i + 1 : j + 1] - at[i])
                if good.all():  # all bytes are text as they are
                    decoded = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends), data)
                else:  # something is not UTF-8: go through these rows as streams
                    texts = []
                    for k in range(i, j):
                        if good[k - i]:
                            texts.append(data[int(ends[k - i]) : int(ends[k - i + 1])].to_pybytes())
                            continue
                        decoder.reset()
                        texts.append(b"".join([decoder.feed(values[n : min(at[k + 1], n + 65536)]) for n in range(at[k], at[k + 1], 65536)]) + decoder.finish())
                    decoded = pa.array(texts, pa.large_binary()).view(pa.large_string())
                rest = [name for name in batch.schema.names if name != "ids"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, j - i) for n in rest), decoded.cast(pa.string())], [*rest, "decoded"])

    return tokens.mapInArrow(run, tokens.drop("ids").withColumn("decoded", F.lit("")).schema)
