"""Byte-level BPE encoding and decoding by lazily determinised transducers.

Encoding.  A token sequence is what the ranked merges give exactly if every two
neighbouring tokens are what the merges give for those two alone.  So reading a
word byte by byte, one token ends at each position: the one that is compatible
with the token ending where it starts.  A state of the transducer holds, for
every position that may still start a longer token, the vocabulary trie node
reached since then and the token before it.  Beside the state run the chains of
tokens not yet emitted; what they all begin with is emitted.  States and their
transitions are made when first met and remembered; merges are only ever run on
two neighbouring tokens.

Decoding.  A UTF-8 state machine is composed with the tokens' bytes: each
(state, token) pair yields the characters it completes and the bytes left over,
so text comes out while ids come in, whatever bytes a token cuts.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import nullcontext

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.shipping import ship_package
from flowsieve.llm.shared import tidy

RANKS_FILE = "byte_bpe_50k.tiktoken"
# Words a coder remembers, about 250 bytes each with its share of states; beyond this they are made anew.
MEMO = 300_000
# A fifth as many states.
WORDS_PER_STATE = 5
LONG_WORD = 64
LOOKAHEAD = 256
# A node and the token before it (0: none) in one number.
SHIFT, MASK = 24, (1 << 24) - 1


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, data.splitlines()) if word}


def near_pattern(pattern: str, below: int = 0x250) -> re.Pattern | None:
    """``pattern`` for texts whose characters all lie below ``below``, with its classes spelled out.

    The plain engine is faster but has no classes for letters and numbers; None if it cannot read the result.
    """
    def chars(test) -> str:
        return "".join(re.escape(chr(i)) for i in range(below) if test(chr(i)))

    classes = {r"\p{L}": chars(lambda c: unicodedata.category(c)[0] == "L"),
               r"\p{N}": chars(lambda c: unicodedata.category(c)[0] == "N"),
               r"\s": chars(lambda c: regex.match(r"\s", c) is not None)}
    classes[r"\S"] = "^" + classes[r"\s"]
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, at)), None)
        if name:
            if inside and name == r"\S":
                return None
            out.append(classes[name] if inside else f"[{classes[name]}]")
            at += len(name)
            continue
        if pattern[at] == "\\":
            out.append(pattern[at:at + 2])
            at += 2
            continue
        inside = pattern[at] == "[" or inside and pattern[at] != "]"
        out.append(pattern[at])
        at += 1
    try:
        return re.compile("".join(out))
    except re.error:
        return None


def _unrolled(chain) -> list[int]:
    out = []
    while chain is not None:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def _shared(chains: list) -> tuple[list[int], list]:
    """The tokens that all chains begin with, and the chains without them."""
    lists = [_unrolled(chain) for chain in chains]
    agreed, shortest = 0, min(map(len, lists))
    while agreed < shortest and all(one[agreed] == lists[0][agreed] for one in lists):
        agreed += 1
    rest = []
    for one in lists:
        chain = None
        for token in one[agreed:]:
            chain = (token, chain)
        rest.append(chain)
    return lists[0][:agreed], rest


class Encoder:
    """The lazily determinised transducer of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, memory: int = MEMO):
        self.ranks, self.memory = ranks, memory
        self.words = {rank: word for word, rank in ranks.items()}
        self.findall = regex.compile(pattern).findall
        near = near_pattern(pattern)
        self.near = near.findall if near else self.findall
        self.far = re.compile(r"[^\x00-\u024f]").search
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                child = self.children[node].get(byte)
                if child is None:
                    child = len(self.children)
                    self.children[node][byte] = child
                    self.children.append({})
                    self.token.append(-1)
                node = child
            self.token[node] = rank
        self.split_of: dict[int, tuple[int, int] | None] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self._forget_states()

    def _forget_states(self) -> None:
        # A state is (trie node, token before) for every position that may still start a token; the last is the end.
        start = (0,)
        self.states: list[tuple[int, ...]] = [start]
        self.number = {start: 0}
        self.next: list[dict[int, tuple]] = [{}]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for bytes and for tokens no merges make."""
        word = self.words[token]
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges keep the two tokens apart, each whole (left -1: right alone).

        Time is the rank merged last.  The token before the border is the right end of ``left``, the one after
        it the left end of ``right``; going back in time each falls into its halves.  A merge across the border
        happens if both sides stood there when its rank came, and of equal ranks the left one comes first.
        """
        split, ranks, words = self.split_of, self.ranks, self.words
        if right not in split:
            split[right] = self._halves(right)
        if len(words[right]) > 1 and split[right] is None:
            return False
        if left < 0:
            return True
        until = len(ranks) + 256
        while True:
            across = ranks.get(words[left] + words[right])
            if across is not None and across < until:
                return False
            earlier = split[left] if left in split else split.setdefault(left, self._halves(left))
            later = split[right] if right in split else split.setdefault(right, self._halves(right))
            if earlier is not None and (later is None or left > right):
                until, left = left, earlier[1]
            elif later is not None:
                until, right = right + 1, later[0]
            else:
                return True

    def _transition(self, state: int, byte: int) -> tuple:
        """(next state, positions that go on, position where a token ends, that token)."""
        reached, kept, source, ended = [], [], 0, -1
        children, tokens = self.children, self.token
        for at, started in enumerate(self.states[state]):
            node, last = started >> SHIFT, (started & MASK) - 1
            child = children[node].get(byte)
            if child is None:
                continue
            token = tokens[child]
            if token >= 0 and ended < 0 and self.compatible(last, token):
                source, ended = at, token
            if children[child]:
                reached.append(child << SHIFT | last + 1)
                kept.append(at)
        if ended < 0:
            raise ValueError("the rank table lacks single bytes")
        reached.append(ended + 1)
        following = tuple(reached)
        number = self.number.get(following)
        if number is None:
            number = len(self.states)
            self.number[following] = number
            self.states.append(following)
            self.next.append({})
        out = (number, kept, source, ended)
        self.next[state][byte] = out
        return out

    def stream(self, data: bytes) -> Iterator[int]:
        """Tokens of one word, emitted once no position in use can change them.

        Each position of the state holds the tokens before it as a chain; what the chains share is emitted
        every LOOKAHEAD bytes, and at once where only one position is left.
        """
        state, chains, following = 0, [None], self.next
        for at, byte in enumerate(data, 1):
            state, kept, source, ended = following[state].get(byte) or self._transition(state, byte)
            if kept:
                chain = (ended, chains[source])
                chains = [chains[i] for i in kept]
                chains.append(chain)
                if at % LOOKAHEAD == 0:
                    shared, chains = _shared(chains)
                    yield from shared
            else:
                yield from _unrolled((ended, chains[source]))
                chains = [None]
        yield from _unrolled(chains[-1])

    def split(self, text: str) -> list[str]:
        return self.near(text) if text.isascii() or not self.far(text) else self.findall(text)

    def word(self, word: str) -> tuple[int, ...]:
        known = self.memo.get(word)
        if known is None:
            data = word.encode()
            rank = self.ranks.get(data)
            known = (rank,) if rank is not None else tuple(self.stream(data))
            if len(self.states) >= self.memory // WORDS_PER_STATE:
                self._forget_states()
            if len(self.memo) >= self.memory:
                self.memo.clear()
            if len(word) <= LONG_WORD:
                self.memo[word] = known
        return known

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        memo, word = self.memo, self.word
        for piece in self.split(text):
            ids += memo.get(piece) or word(piece)
        return ids


class Utf8:
    """States of incremental UTF-8: how many bytes may follow, and in which range the next one lies."""

    def __init__(self):
        self.start = 0
        self.states: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.number = {(0, 0, 0): 0}
        self.steps: list[list[int]] = []
        at = 0
        while at < len(self.states):
            self.steps.append([self._step(self.states[at], byte) for byte in range(256)])
            at += 1

    def _step(self, state: tuple[int, int, int], byte: int) -> int:
        left, low, high = state
        if left == 0:
            if byte < 0x80:
                return 0
            if 0xC2 <= byte <= 0xDF:
                following = (1, 0x80, 0xBF)
            elif 0xE0 <= byte <= 0xEF:
                following = (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
            elif 0xF0 <= byte <= 0xF4:
                following = (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
            else:
                return -1
        elif low <= byte <= high:
            following = (left - 1, 0x80, 0xBF) if left > 1 else (0, 0, 0)
        else:
            return -1
        if following not in self.number:
            self.number[following] = len(self.states)
            self.states.append(following)
        return self.number[following]


class Decoder:
    """Ids to text; a transition per (state, bytes left over, token) is remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words = {rank: word for word, rank in ranks.items()}
        self.machine = Utf8()
        self.known: dict[tuple[int, bytes, int], tuple[int, bytes, str]] = {}
        self.whole: dict[int, str] = {}
        for token in self.words:
            try:
                state, _, text = self._feed(0, b"", token)
            except UnicodeDecodeError:
                continue
            if state == 0:
                self.whole[token] = text

    def _feed(self, state: int, rest: bytes, token: int) -> tuple[int, bytes, str]:
        data, whole = rest + self.words[token], 0
        for at in range(len(rest), len(data)):
            state = self.machine.steps[state][data[at]]
            if state < 0:
                raise UnicodeDecodeError("utf-8", data, at, at + 1, "ids do not decode to UTF-8")
            if state == 0:
                whole = at + 1
        out = (state, data[whole:], data[:whole].decode())
        if len(self.known) >= MEMO:
            self.known.clear()
        self.known[(state, rest, token)] = out
        return out

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids as they come; each piece ends on a whole character."""
        state, rest = 0, b""
        for token in ids:
            state, rest, text = self.known.get((state, rest, token)) or self._feed(state, rest, token)
            if text:
                yield text
        if rest:
            raise UnicodeDecodeError("utf-8", rest, 0, len(rest), "ids end inside a character")

    def decode(self, ids: list[int]) -> str:
        # Where every token ends on a whole character the machine is in its start state throughout.
        texts = [self.whole.get(token) for token in ids]
        return "".join(self.stream(ids) if None in texts else texts)


_kept: dict[tuple[int, str, int], tuple[Encoder, Decoder]] = {}


def coders(data: bytes, pattern: str, memory: int = MEMO, keep: bool = False) -> tuple[Encoder, Decoder]:
    """The coders of a rank table; with ``keep`` a worker's tasks share them, else their memory ends with a task."""
    key = (hash(data), pattern, memory)
    found = _kept.get(key)
    if found is None:
        gc.set_threshold(200_000, 50, 50)  # the coders only hold what they keep
        ranks = read_ranks(data)
        found = Encoder(ranks, pattern, memory), Decoder(ranks)
        if keep:
            _kept[key] = found
    return found


def _broadcast(spark, path: str | None, pattern: str | None):
    ship_package(spark)
    with open(path or public_tokenizers.path(RANKS_FILE), "rb") as file:
        return spark.sparkContext.broadcast(file.read()), pattern or public_tokenizers.PATTERN


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): whole texts as token ids.

    A null text counts as empty and gives no ids; repeated rows give repeated results; other
    columns are not read.  The rank file (``path``, under a megabyte) is broadcast.
    """
    data, pattern = _broadcast(df.sparkSession, path, pattern)

    def run(batches):
        encoder, _ = coders(data.value, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [encoder.encode(t or "") for t in batch["text"]]})

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"doc_id {dict(source.dtypes)['doc_id']}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of token ids; null or no ids give an empty text, broken UTF-8 is an error."""
    data, pattern = _broadcast(df.sparkSession, path, None)

    def run(batches):
        _, decoder = coders(data.value, pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"],
                                "text": [decoder.decode([] if i is None else list(i)) for i in batch["ids"]]})

    source = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInPandas(run, f"doc_id {dict(source.dtypes)['doc_id']}, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
               pattern: str | None = None, memory: int = MEMO, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ids and of the text decoded from them.

    Both coders run in one pass, so ids never leave the worker.  ``memory`` is how many words a coder remembers;
    with ``keep`` the tasks of a worker share one, which suits a job that does nothing else.  Neither changes the
    result.  Nulls and ties as in ``encode``.
    """
    data, pattern = _broadcast(df.sparkSession, path, pattern)

    def run(batches):
        # Coders that tasks share stay, and so does their memory.
        with nullcontext() if keep else tidy():
            yield from digests(batches)

    def digests(batches):
        encoder, decoder = coders(data.value, pattern, memory, keep)
        names = {token: str(token) for token in encoder.words}
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = encoder.encode(text or "")
                rows.append((len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(decoder.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, "
                                   "decoded_sha256 string")
