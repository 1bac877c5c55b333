"""Byte-level BPE: vocabularies, pre-tokens, and encoding by a lazily determinised transducer.

The transducer reads a pre-token byte by byte. It relies on two facts about merge tables whose
every usable token encodes as itself: the encoding of each prefix of a text ends in exactly one
token, and a token may follow another just when the pair alone encodes as that pair. A state
holds the last token that is settled and the bytes since; a transition adds one byte, finds the
one token that ends there, and emits the tokens on which every possible continuation agrees.
Since a token has bounded length, so has the lookahead. States and transitions are made when a
text first needs them, and the tables start anew when they hold max_states states.
"""

from __future__ import annotations

import base64
import json
from itertools import chain

import numpy as np
import regex


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_json(path: str) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]], dict[str, int]]:
    """Of a byte-level tokenizer.json: ids by bytes, (rank, merged id) by pair of ids, added tokens by text."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    letters = byte_letters()
    raw = {s: bytes(letters[c] for c in s) for s in j["model"]["vocab"]}
    ids = {raw[s]: i for s, i in j["model"]["vocab"].items()}
    merges = {}
    for rank, pair in enumerate(j["model"]["merges"]):
        a, b = (bytes(letters[c] for c in s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
        merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
    return ids, merges, {t["content"]: t["id"] for t in j["added_tokens"]}


#: Above every rank.
NEVER = 1 << 60


def merge_by_rank(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The ids of one pre-token: join the leftmost adjacent pair of least rank until no pair is in the vocabulary."""
    get = ranks.get
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < NEVER:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


#: Ids have fewer bits than this; a merge's rank and id share one number.
ID_BITS = 24


class Merger:
    """The ids of one pre-token by a table of pair merges, the leftmost of equal rank first."""

    def __init__(self, ids: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.merges = merges
        self.byte_ids = [ids.get(bytes((b,))) for b in range(256)]
        self.packed = {pair: rank << ID_BITS | made for pair, (rank, made) in merges.items()}

    def __call__(self, word: bytes) -> list[int]:
        byte_ids = self.byte_ids
        parts = [byte_ids[b] for b in word]
        if len(parts) > 256:
            return merge_long(parts, self.merges)
        get, mask = self.packed.get, (1 << ID_BITS) - 1
        pairs = [get(p, NEVER) for p in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            parts[i] = least & mask
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(pairs):
                pairs[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts


def merge_long(parts: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merger's work for long pre-tokens: a heap of candidate pairs over a linked list, n log n."""
    from heapq import heapify, heappop, heappush

    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(m[0], i, p[0], p[1], m[1]) for i, p in enumerate(zip(parts, parts[1:])) if (m := merges.get(p))]
    heapify(heap)
    while heap:
        _, i, a, b, made = heappop(heap)
        j = after[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j] = made, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (m := merges.get((parts[x], parts[y]))):
                heappush(heap, (m[0], x, parts[x], parts[y], m[1]))
    return [p for p in parts if p >= 0]


#: Above every rank, where ranks are 32-bit numbers; and an id that no pair has.
NO_RANK, NO_ID = 1 << 24, (1 << ID_BITS) - 1


class PairRanks:
    """The ranks of many pairs of ids at once, from a hash table in arrays; where a slot is taken, the next one is meant."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        keys = self.key(*np.array(list(merges), np.int64).reshape(-1, 2).T)
        ranks = np.array([rank for rank, _ in merges.values()], np.int32)
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, NEVER), np.full(1 << bits, NO_RANK, np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] == NEVER
            self.keys[at[free]] = keys[free]  # of several for one slot, one gets it
            done = self.keys[at] == keys
            self.ranks[at[done]] = ranks[done]
            keys, ranks, at = keys[~done], ranks[~done], at[~done] + 1 & self.last

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << ID_BITS | right

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK for pairs that don't merge."""
        keys = self.key(left, right)
        at = self.slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NO_RANK)
        more = np.flatnonzero((held != keys) & (held != NEVER))
        at = at[more]
        while len(more):
            at = at + 1 & self.last
            held = self.keys[at]
            found, on = held == keys[more], (held != keys[more]) & (held != NEVER)
            out[more[found]] = self.ranks[at[found]]
            more, at = more[on], at[on]
        return out


class BatchMerger:
    """Merger's work for many different pre-tokens at once.

    A pre-token is a column of ids, linked to the next and the one before. A round joins in each
    column the leftmost pair of least rank and ranks the two pairs beside it anew. Columns are of
    pre-tokens of similar length; longer ones than the last of SIZES go to a Merger.
    """

    SIZES, COLUMNS, ROW_BITS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64), 8192, 6

    def __init__(self, ids: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.alone, self.rank = Merger(ids, merges), PairRanks(merges)
        self.byte_ids = np.array([ids.get(bytes((b,)), NO_ID) for b in range(256)], np.int32)
        self.made = np.zeros(max((rank for rank, _ in merges.values()), default=0) + 1, np.int32)
        for rank, made in merges.values():
            self.made[rank] = made
        self.byte_ranks = self.rank(self.byte_ids.repeat(256), np.tile(self.byte_ids, 256))

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token (of one byte at least) as little-endian 32-bit numbers."""
        if (self.byte_ids == NO_ID).any():
            raise ValueError("the vocabulary lacks a byte")
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        size = np.searchsorted(self.SIZES, lengths)
        for i in np.flatnonzero(size == len(self.SIZES)).tolist():
            out[i] = np.array(self.alone(words[i]), "<u4").tobytes()
        for k, rows in enumerate(self.SIZES):
            of_size = np.flatnonzero(size == k)
            for at in range(0, len(of_size), self.COLUMNS):
                some = of_size[at : at + self.COLUMNS]
                numbers = some.tolist()
                for i, made in zip(numbers, self.columns([words[i] for i in numbers], lengths[some], rows)):
                    out[i] = made
        return out

    def columns(self, words: list[bytes], lengths: np.ndarray, rows: int) -> list[bytes]:
        n, never = len(words), NO_RANK << self.ROW_BITS
        raw = np.frombuffer(b"".join(w.ljust(rows) for w in words), np.uint8).reshape(n, rows).T
        row = np.arange(rows + 1)[:, None]
        # the row at the end has no ids: what follows a last id and comes before a first one
        ids = np.full((rows + 1, n), NO_ID, np.int32)
        ids[:rows] = np.where(row[:rows] < lengths, self.byte_ids[raw], NO_ID)
        ranks = np.full((rows + 1, n), never, np.int32)
        pairs = self.byte_ranks[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        ranks[: rows - 1] = np.where((row[1:rows] < lengths) & (pairs < NO_RANK), pairs << self.ROW_BITS | row[: rows - 1], never)
        after = (np.minimum(row + 1, rows) * n + np.arange(n)).ravel()
        before = ((row - 1) % (rows + 1) * n + np.arange(n)).ravel()
        flat, flat_ranks = ids.reshape(-1), ranks.reshape(-1)
        while len(go := np.flatnonzero((least := ranks.min(axis=0)) < never)):
            least = least[go]
            i = (least & (1 << self.ROW_BITS) - 1) * n + go
            j, made = after[i], self.made[least >> self.ROW_BITS]
            k, h = after[j], before[i]
            flat[i], flat[j], flat_ranks[j] = made, NO_ID, never
            after[i], before[k] = k, i
            both = self.rank(np.concatenate([made, flat[h]]), np.concatenate([flat[k], made]))
            places = np.concatenate([i, h])
            flat_ranks[places] = np.where(both < NO_RANK, both << self.ROW_BITS | places // n, never)
        ids = ids[:rows].T
        held = ids != NO_ID
        ends = 4 * held.sum(axis=1).cumsum()
        whole, ends = ids[held].astype("<u4").tobytes(), ends.tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


class Transducer:
    """Encodes pre-tokens by the ranks of a vocabulary; see the module's text."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.proper = {t[:k] for t in ranks for k in range(1, len(t))}
        self.fits: dict[tuple[int, int], bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states; state 0 is the start of a pre-token."""
        self.states: list[tuple[int, bytes, tuple[tuple[int, int, int], ...], tuple[int, ...]]] = [(-1, b"", (), (0,))]
        self.number: dict[tuple, int] = {(-1, b""): 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: list[tuple[int, ...] | None] = [()]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a single byte or a token that doesn't encode as itself."""
        if token not in self.made_of:
            self.made_of[token] = self.last_merge(self.bytes_of[token])
        return self.made_of[token]

    def last_merge(self, word: bytes) -> tuple[int, int] | None:
        # every merge but the last stays within one half, so some cut leaves two halves that are tokens
        # by themselves and that no earlier merge joins
        if merge_by_rank(self.ranks, word) != [self.ranks[word]]:
            return None
        least = [word[i : i + 1] for i in range(len(word))]
        while len(least) > 2:
            pairs = [self.ranks.get(a + b, NEVER) for a, b in zip(least, least[1:])]
            i = pairs.index(min(pairs))
            least[i : i + 2] = [least[i] + least[i + 1]]
        return tuple(self.ranks[x] for x in least) if len(least) == 2 else None

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens alone encode as themselves; left -1: whether the right one does.

        Undoes the merges of both, the latest first. They don't survive if, at some step, the two
        parts at the seam would merge before the merge that was just undone.
        """
        if len(self.fits) > 4 * self.max_states:
            self.fits.clear()
        a, b, known = left, right, None
        if len(self.bytes_of[right]) > 1 and self.halves(right) is None:
            known = False
        elif left < 0:
            known = True
        limit = NEVER
        while known is None:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < limit:
                known = False
                break
            one, two = self.halves(a), self.halves(b)
            if one is None and two is None:
                known = True
            elif two is None or one is not None and a > b:
                # of equal rank the leftmost merges first, and the seam is to the right of what was undone
                limit, a = a, one[1]
            else:
                limit, b = b + 1, two[0]
        self.fits[left, right] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens settled by one more byte."""
        settled, tail, last, live = self.states[state]
        tail += bytes((byte,))
        n, get, fits, proper = len(tail), self.ranks.get, self.fits.get, self.proper
        # last[i]: of the one token that ends after i + 1 bytes of the tail, its id, its start, and
        # the ends of it and the tokens before it as bits; live: where a token may have begun
        found, still, shared = None, [], -1
        for start in live:
            word = tail[start:]
            left, _, path = last[start - 1] if start else (settled, 0, 0)
            if found is None and (token := get(word)) is not None:
                if (known := fits((left, token))) or known is None and self.may_follow(left, token):
                    found = (token, start, path | 1 << n)
            if word in proper:
                still.append(start)
                shared &= path
        if found is None:
            raise ValueError("the vocabulary lacks a byte, or one of its tokens can't be followed")
        last = (*last, found)
        emitted: list[int] = []
        # what all paths to where a later token may start have in common is settled
        if shared := shared & found[2]:
            j = cut = shared.bit_length() - 1
            while j:
                token, j, _ = last[j - 1]
                emitted.append(token)
            emitted.reverse()
            settled, tail, n = emitted[-1], tail[cut:], n - cut
            # no live path has a token across the cut, so what starts before it is never read
            last = tuple((t, s - cut, p >> cut & ~1) if s >= cut else (-1, 0, 0) for t, s, p in last[cut:])
            still = [s - cut for s in still]
        # the settled token matters as long as a token may begin right after it
        key = (settled, tail) if not still or not still[0] else (tail, last)
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append((settled, tail, last, (*still, n)))
            self.ends.append(None)
        made = self.moves[state << 8 | byte] = (to, tuple(emitted))
        return made

    def end(self, state: int) -> tuple[int, ...]:
        """The tokens left when the pre-token ends here."""
        if (made := self.ends[state]) is None:
            _, tail, last, _ = self.states[state]
            out, j = [], len(tail)
            while j > 0:
                token, j, _ = last[j - 1]
                out.append(token)
            made = self.ends[state] = tuple(reversed(out))
        return made

    def encode(self, word: bytes) -> tuple[int, ...]:
        if len(self.states) > self.max_states:
            self.reset()
        moves, state, out = self.moves, 0, []
        for byte in word:
            step = moves.get(state << 8 | byte) or self.move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return (*out, *self.end(state))


class Pieces(dict):
    """What each piece comes to, remembered from about its second time on, up to twice a bound.

    When the bound is reached the older half goes, but for what has been used since. Pieces met
    once, most of all different ones, are known by a mark at their hash alone.
    """

    MARKS = 1 << 21

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}
        self.marks, self.marked = bytearray(self.MARKS), 0

    def __missing__(self, piece: str):
        if piece in self.old:
            made = self.old[piece]
        else:
            made, at = self.make(piece), hash(piece) % self.MARKS
            if not self.marks[at]:
                if self.marked > self.MARKS // 4:
                    self.marks, self.marked = bytearray(self.MARKS), 0
                self.marks[at] = 1
                self.marked += 1
                return made
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = made
        return made


class Encoder:
    """Texts to what `whole` makes of their pre-tokens, combined by the pieces between spaces.

    The pattern must take a space and the letters after it as one pre-token, and letters without
    a space before them too.
    """

    def __init__(self, pattern: str, whole, limit: int = 300_000):
        find = regex.compile(pattern).findall
        self.whole, self.limit = whole, limit
        word = Pieces(whole, 100_000)
        self.find = lambda s: [word[t] for t in find(s)]

    def of(self, combine):
        """A function from a text to the list of combine(values of its pre-tokens), a value for each piece."""
        find, whole = self.find, self.whole

        def make(piece: str):
            if piece.isalpha():
                return combine([whole(" " + piece)])
            # beside other white space, or at an end, a space is part of a longer run
            if not piece or piece[0].isspace() or piece[-1].isspace():
                return None
            return combine(find(" " + piece))

        at = Pieces(make, self.limit).__getitem__

        def run(text: str) -> list:
            if not text:
                return []
            first, *rest = text.split(" ")
            if rest and (not first or first[0].isspace() or first[-1].isspace()):
                return [combine(find(text))]
            out = [combine(find(first)), *map(at, rest)]
            return [combine(find(text))] if None in out else out

        return run


def flat(parts) -> tuple[int, ...]:
    return tuple(chain.from_iterable(parts))


class Utf8Stream:
    """Decodes a stream of byte pieces, cutting them only between characters.

    The state is the bytes of a character that has begun, at most three. A byte that can't go on
    with it, or none at the end, becomes U+FFFD as bytes.decode(errors="replace") has it.
    """

    def __init__(self):
        self.begun = b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """How many bytes at the end belong to a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
                if need <= back:
                    return 0
                # the second byte of some characters has a narrower range
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))
                return back if back == 1 or low <= data[1 - back] <= high else 0
        return 0

    def feed(self, piece: bytes) -> str:
        data = self.begun + piece
        keep = self.open_bytes(data)
        self.begun = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.begun = self.begun, b""
        return data.decode("utf-8", "replace")


def decode(ids, bytes_of, step: int = 4096):
    """The text of ids in order, in pieces of about `step` tokens."""
    stream = Utf8Stream()
    for i in range(0, len(ids), step):
        yield stream.feed(b"".join(map(bytes_of.__getitem__, ids[i : i + step])))
    yield stream.close()
