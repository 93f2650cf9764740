"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer.

The encoder never simulates merges. An Aho-Corasick automaton over all tokens finds
the longest token at each byte of a piece; a token is taken if it is compatible with
the one before it, otherwise the next shorter prefix token is tried, and when none is
left the encoder steps back. Two tokens are compatible if merging the joined bytes
from scratch leaves exactly these two, which the merge ranks along their touching
edges decide. Positions from which no encoding goes on are marked, so every position
is tried a bounded number of times. Many pieces at once go through the same steps side
by side, in arrays. Decoding copies byte ranges by a table of offsets.
"""

from __future__ import annotations

import functools
import json
import struct
from collections.abc import Callable, Collection, Iterator
from itertools import chain
from operator import indexOf

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.spark import bounded_batches
from leafmill.llm.words import slices

# The split pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_BYTES = 24 << 20  # of memory per worker and share of a cache, about; results don't depend on it
ENTRY_BYTES = 220  # of an entry beside its characters and ids
CACHED = 200_000  # pairs of tokens whose compatibility is kept
PAIR_SLOTS = 1 << 19  # of the table of such pairs in arrays; a pair takes the place of another one in its slot
SPREAD = np.int64(0x1E3779B97F4A7C15)  # odd, spreads pairs over the slots
NEVER = np.iinfo(np.int32).max  # the rank of no merge
WORDS = 1 << 16  # looked up at once
CHARS = 1 << 19  # of pieces encoded side by side, about
PAIRS = 1 << 14  # of tokens compared at once
FEW, LONG = 64, 4096  # so few pieces, and such long ones, are encoded one by one
BETWEEN = "\u0100"  # stands between pieces; no character of theirs, which stand for bytes

# White space other than a blank and a line break, and line breaks beside blanks.
_BLANKS = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", " \n", "\n ")
_WIDE = regex.compile(r"[^\S\x00-\x7f]").search


def _has_wide_blank(text: str) -> bool:
    return not text.isascii() and _WIDE(text) is not None


class Cache(dict):
    """Results by string, in two generations: a full one becomes the older, from which what is asked for again returns."""

    def __init__(self, make: Callable[[str], bytes], share: float = 1.0):
        self.make = make
        self.most = int(CACHE_BYTES * share) // 2
        self.size = 0
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        made = self.older.get(text)
        if made is None:
            made = self.make(text)
        self.turn(ENTRY_BYTES + len(text) + len(made))
        self.put([text], [made])
        return made

    def turn(self, more: int = 0) -> None:
        """Let the results become the older ones if these bytes more don't fit in."""
        if self.size + more > self.most:
            self.older = self.copy()
            self.clear()
            self.size = 0

    def put(self, texts: Collection[str], made: list[bytes]) -> None:
        self.update(zip(texts, made, strict=True))
        self.size += ENTRY_BYTES * len(texts) + sum(map(len, texts)) + sum(map(len, made))

    def take(self, texts: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """The results of different strings, and the strings whose results are to be made."""
        found = dict(zip(texts, map(self.get, texts), strict=True))
        new = [text for text, made in found.items() if made is None]
        older = list(map(self.older.get, new))
        back = {text: made for text, made in zip(new, older, strict=True) if made is not None}
        found |= back
        self.put(back, list(back.values()))
        return found, [text for text, made in zip(new, older, strict=True) if made is None]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [hidden.get(b, chr(b)) for b in range(256)]


class Codec:
    """Tables of one vocabulary and its merges, held once per worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = {c: b for b, c in enumerate(byte_alphabet())}
        vocabulary = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.raw: dict[int, str] = {i: "".join(chr(alphabet[c]) for c in s) for s, i in vocabulary.items() if s not in self.added}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for order, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            token = vocabulary[left + right]
            key = (vocabulary[left], vocabulary[right])
            self.merged.setdefault(key, token)
            if token not in self.parts:
                self.parts[token], self.rank[token] = key, order
        self.by_bytes = {s: i for i, s in self.raw.items()}
        automaton = ahocorasick.Automaton()
        for s, i in self.by_bytes.items():
            if len(s) == 1 or self._whole(i):
                automaton.add_word(s, i)
        automaton.make_automaton()
        self.automaton = automaton
        self.usable = dict(automaton.items())
        self.compatible = functools.lru_cache(CACHED)(self._compatible)
        self.shorter = functools.lru_cache(CACHED)(self._shorter)
        self.find = regex.compile(PIECES).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else lambda t: [t]
        self.pieces = Cache(self.merged_ids, 0.25)  # few: marks, numbers, and words that no space precedes
        self.after_space = Cache(lambda w: self.merged_ids(" " + w) if w.isalpha() else self.stretch_ids(" " + w), 1.75)
        self.sizes = {i: len(s) for i, s in self.raw.items()}
        size = max([*self.raw, *self.added.values()]) + 1
        self._arrays(size)
        spans = [b""] * size
        for i, s in self.raw.items():
            spans[i] = s.encode("latin-1")
        for s, i in self.added.items():
            spans[i] = s.encode()
        self.blob = np.frombuffer(b"".join(spans), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(s) for s in spans])))

    def _arrays(self, size: int) -> None:
        """Tables for many pieces at once: prefixes of tokens, sizes, shorter tokens, pairs that were met."""
        self.between = size
        self.automaton.add_word(BETWEEN, size)
        self.automaton.make_automaton()
        prefixes = {"": 0}
        steps, tokens = [], [-1]  # prefix and next byte; the token that a prefix is
        self.shorter_of = np.full(size, -1, np.int64)
        for s in sorted(self.usable):  # after its prefixes
            longest, at = -1, 0
            for n in range(1, len(s) + 1):
                start, at = at, prefixes.setdefault(s[:n], len(tokens))
                if at == len(tokens):
                    steps.append(start << 8 | ord(s[n - 1]))
                    tokens.append(-1)
                elif tokens[at] >= 0:
                    longest = tokens[at]
            tokens[at] = self.usable[s]
            self.shorter_of[self.usable[s]] = longest
        order = np.argsort(steps)  # the step at i leads to prefix i + 1
        self.steps, self.step_to, self.token_at = np.array(steps)[order], order + 1, np.array(tokens)
        self.size_of = np.ones(size + 1, np.int64)
        self.size_of[list(self.sizes)] = list(self.sizes.values())
        parts = np.full((size, 2), -1, np.int32)
        rank = np.full(size, NEVER, np.int32)
        parts[list(self.parts)] = list(self.parts.values())
        rank[list(self.rank)] = list(self.rank.values())
        self.edges = []  # for each side the tokens that stand there in turn, and the ranks that end them
        for side in (0, 1):
            edge, ends = [np.arange(size, dtype=np.int32)], [np.full(size, NEVER, np.int32)]
            while (inner := np.where(edge[-1] >= 0, parts[edge[-1], side], np.int32(-1))).max() >= 0:
                ends.append(rank[edge[-1]])
                edge.append(inner)
            self.edges.append((np.stack(edge, 1), np.stack(ends, 1)))
        joins = np.array([a << 32 | b for a, b in self.merged])
        order = np.argsort(joins)
        self.joins, self.join_rank = joins[order], rank[np.array(list(self.merged.values()))[order]]
        self.pairs = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_fits = np.zeros(PAIR_SLOTS, bool)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of a token in turn, with the rank that ends each."""
        found: list[tuple[int, float]] = [(token, float("inf"))]
        while token in self.parts:
            ends = self.rank[token]
            token = self.parts[token][side]
            found.append((token, ends))
        return found

    def _crossing(self, a: int, b: int, before: float) -> bool:
        """Whether some merge joins a's right edge to b's left edge while both stand there."""
        for x, x_ends in self._edge(a, 1):
            for y, y_ends in self._edge(b, 0):
                joined = self.merged.get((x, y))
                if joined is not None:
                    at = self.rank[joined]
                    if at < x_ends and at <= y_ends and at < before:
                        return True
        return False

    def _compatible(self, a: int, b: int) -> bool:
        return not self._crossing(a, b, float("inf"))

    def _whole(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token back."""
        whole = self.__dict__.setdefault("_known", {})
        if token not in whole:
            whole[token] = token not in self.parts or (
                all(self._whole(p) for p in self.parts[token])
                and not self._crossing(*self.parts[token], self.rank[token])
            )
        return whole[token]

    def _shorter(self, token: int) -> int | None:
        s = self.raw[token]
        return next((self.usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.usable), None)

    def merged_ids(self, text: str) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers."""
        s = text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1")
        known = self.usable.get(s)
        if known is not None:
            return known.to_bytes(4, "little")
        greedy = [token for _, token in self.automaton.iter_long(s)]  # the longest token at each end of the one before
        sizes, compatible, shorter = self.sizes, self.compatible, self.shorter
        try:
            first = indexOf(map(compatible, greedy, greedy[1:]), False) + 1
        except ValueError:  # all of them are compatible
            return struct.pack(f"<{len(greedy)}I", *greedy)
        ids, token, n = greedy[:first], greedy[first], len(s)
        at, dead, ahead = sum(map(sizes.__getitem__, ids)), bytearray(n + 1), None
        while True:
            end = at + sizes[token]
            if not dead[end] and (not ids or compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at == n:
                    return struct.pack(f"<{len(ids)}I", *ids)
                ahead = ahead or self.automaton.iter_long(s, at)
                token = next(ahead)[1]
                continue
            ahead = None  # it goes on behind the token that is given up
            fewer = shorter(token)
            while fewer is None:
                dead[at] = 1
                token = ids.pop()
                at -= sizes[token]
                fewer = shorter(token)
            token = fewer

    def _all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """As _compatible, for many pairs."""
        (xs, x_ends), (ys, y_ends) = self.edges[1], self.edges[0]
        x, y = xs[left], ys[right]
        row, i, j = np.nonzero((x >= 0)[:, :, None] & (y >= 0)[:, None, :])
        pair = x[row, i].astype(np.int64) << 32 | y[row, j]
        place = np.minimum(np.searchsorted(self.joins, pair), len(self.joins) - 1)
        joined = np.flatnonzero(self.joins[place] == pair)
        row, i, j, at = row[joined], i[joined], j[joined], self.join_rank[place[joined]]
        fits = np.ones(len(left), bool)
        fits[row[(at < x_ends[left[row], i]) & (at <= y_ends[right[row], j])]] = False
        return fits

    def all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each token is compatible with the one behind it."""
        pairs = left << 32 | right
        slots = (pairs * SPREAD >> 40) % PAIR_SLOTS
        fits = self.pair_fits[slots]
        new = np.flatnonzero(self.pairs[slots] != pairs)
        if len(new):
            unknown, which = np.unique(pairs[new], return_inverse=True)
            some = [unknown[i : i + PAIRS] for i in range(0, len(unknown), PAIRS)]
            fits[new] = np.concatenate([self._all_compatible(u >> 32, u & 0xFFFFFFFF) for u in some])[which]
            _, last = np.unique(slots[new], return_index=True)  # one pair for each slot
            self.pairs[slots[new[last]]] = pairs[new[last]]
            self.pair_fits[slots[new[last]]] = fits[new[last]]
        return fits

    def longest(self, raw: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest token at each place that ends before a stop."""
        found = np.full(len(at), -1)
        rows, prefix = np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(rows):
            step = prefix << 8 | raw[at]
            place = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            known = self.steps[place] == step
            rows, prefix, at, stop = rows[known], self.step_to[place[known]], at[known] + 1, stop[known]
            token = self.token_at[prefix]
            found[rows] = np.where(token < 0, found[rows], token)
            inside = at < stop
            rows, prefix, at, stop = rows[inside], prefix[inside], at[inside], stop[inside]
        return found

    def merged_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each of many pieces, as from merged_ids."""
        made: dict[str, bytes] = {}
        for some in slices([t for t in texts if len(t) < LONG], CHARS):
            if len(some) >= FEW:
                made.update(zip(some, self._side_by_side(some), strict=True))
        return [made[t] if t in made else self.merged_ids(t) for t in texts]

    def _side_by_side(self, texts: list[str]) -> list[bytes]:
        joined = BETWEEN.join([t if t.isascii() else t.encode("utf-8", "surrogatepass").decode("latin-1") for t in texts])
        raw = np.frombuffer(joined.encode("latin-1", "replace"), np.uint8)
        greedy = np.array([token for _, token in self.automaton.iter_long(joined)])
        ends = np.cumsum(self.size_of[greedy])
        between = greedy == self.between
        piece = np.cumsum(between)  # of each token; the mark before a piece counts to it
        stops = np.append(ends[between] - 1, len(raw))
        taken = np.full(len(raw) + 1, -1)  # the token that ends at each place
        taken[ends] = np.where(between, -1, greedy)
        inner = np.flatnonzero(~between[1:] & ~between[:-1])
        clash = inner[~self.all_compatible(greedy[inner], greedy[inner + 1])] + 1
        late, first = np.unique(piece[clash], return_index=True)
        clash = clash[first]
        begun = np.full(len(texts), len(greedy))
        begun[late] = clash
        taken[ends[np.arange(len(greedy)) >= begun[piece]]] = -1
        left = self._step_back(raw, taken, late, ends[clash - 1], greedy[clash], stops[late])
        ids = taken[taken >= 0].astype("<u4").tobytes()
        cuts = (4 * np.cumsum(taken >= 0)[stops]).tolist()
        made = [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        for k in left.tolist():
            made[k] = self.merged_ids(texts[k])
        return made

    def _step_back(self, raw: np.ndarray, taken: np.ndarray, piece: np.ndarray, at: np.ndarray, token: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Go on with pieces from a place where a token is tried, side by side; the last few are left, and returned."""
        dead = np.zeros(len(taken), bool)
        while len(piece) >= FEW // 4:
            end, before = at + self.size_of[token], taken[at]
            good = ~dead[end]
            asked = np.flatnonzero(good & (before >= 0))
            good[asked] = self.all_compatible(before[asked], token[asked])
            taken[end[good]] = token[good]
            bad = np.flatnonzero(~good)
            at = np.where(good, end, at)
            fewer = self.shorter_of[token[bad]]
            back = bad[fewer < 0]
            token[bad] = fewer
            while len(back):
                place = at[back]
                dead[place] = True
                given_up = taken[place]
                taken[place] = -1
                at[back] -= self.size_of[given_up]
                token[back] = self.shorter_of[given_up]
                back = back[token[back] < 0]
            rest = at < stop
            piece, at, token, stop, good = piece[rest], at[rest], token[rest], stop[rest], good[rest]
            token[good] = self.longest(raw, at[good], stop[good])
        return piece

    def stretches(self, words: list[str]) -> dict[str, bytes]:
        """The ids of the stretches of a space and each of different words; new ones are encoded together."""
        self.after_space.turn()
        self.pieces.turn()
        found, new = self.after_space.take(words)
        odd = [w for w in new if not w.isalpha()]
        cut = self.cut_all(odd)
        spaced, others = [], []
        for piece in dict.fromkeys(chain.from_iterable(cut)):
            if piece[0] == " " and piece[1:].isalpha():
                spaced.append(piece[1:])
            else:
                others.append(piece)
        behind, after = self.after_space.take(spaced)
        ids, alone = self.pieces.take(others)
        after = list(dict.fromkeys(chain(filter(str.isalpha, new), after)))
        made = self.merged_all([" " + w for w in after] + alone)
        after_made, alone_made = made[: len(after)], made[len(after) :]
        self.after_space.put(after, after_made)
        self.pieces.put(alone, alone_made)
        known = dict(zip(after, after_made, strict=True))
        found |= known
        ids |= zip(alone, alone_made, strict=True)
        ids |= ((" " + w, known[w] if made is None else made) for w, made in behind.items())
        odd_made = [b"".join(map(ids.__getitem__, pieces)) for pieces in cut]
        self.after_space.put(odd, odd_made)
        found |= zip(odd, odd_made, strict=True)
        return found

    def cut_all(self, words: list[str]) -> list[list[str]]:
        """The pieces of the stretches of a space and each word; those without other white space are cut at once."""
        plain = [w for w in words if w.isprintable() and " " not in w]
        cut: dict[str, list[str]] = {w: [] for w in plain}
        order = iter(plain)
        pieces: list[str] = []
        for piece in self.find("".join(["\n " + w for w in plain])):
            if piece == "\n":
                pieces = cut[next(order)]
            else:
                pieces.append(piece)
        return [cut[w] if w in cut else self.find(" " + w) for w in words]

    def stretch_ids(self, text: str) -> bytes:
        """The ids of a stretch that neither starts nor ends inside a run of white space."""
        if text.removeprefix(" ").isalpha():  # one piece of letters
            return self.merged_ids(text)
        first, *others = self.find(text)
        word = first[1:]
        # a word behind a space is kept once, whatever follows it
        ids = self.after_space[word] if first[0] == " " and word.isalpha() else self.pieces[first]
        return b"".join([ids, *map(self.pieces.__getitem__, others)])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        The texts are cut before single spaces between other characters, where the split
        pattern always cuts, so that frequent stretches are encoded once.
        """
        parts: list[tuple[bytes, int]] = []  # ids, and how many words follow them
        words: list[str] = []
        ends = []
        for text in texts:
            for part in self.split(text):
                if part in self.added:
                    parts.append((self.added[part].to_bytes(4, "little"), 0))
                elif part:
                    cut = part.split(" ")
                    if "" in cut or _has_wide_blank(part) or any(x in part for x in _BLANKS):
                        cut = self._rejoined(cut)
                    parts.append((self.stretch_ids(cut[0]) if cut[0] else b"", len(cut) - 1))
                    words += cut[1:]
            ends.append(len(parts))
        found: list[bytes] = []
        for at in range(0, len(words), WORDS):
            some = words[at : at + WORDS]
            found += map(self.stretches(list(dict.fromkeys(some))).__getitem__, some)
        made, at, begun = [], 0, 0
        for end in ends:
            out = []
            for ids, n in parts[begun:end]:
                out.append(ids)
                out += found[at : at + n]
                at += n
            made.append(b"".join(out))
            begun = end
        return made

    @staticmethod
    def _rejoined(words: list[str]) -> list[str]:
        """Put back together what was cut inside a run of white space."""
        whole, open_words = [], [words[0]]
        for w in words[1:]:
            last = open_words[-1]
            if not w or not last or w[0].isspace() or last[-1].isspace():
                open_words.append(w)
            else:
                whole.append(" ".join(open_words))
                open_words = [w]
        whole.append(" ".join(open_words))
        return whole

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        first = self.offsets[tokens]
        sizes = self.offsets[tokens + 1] - first
        ends = np.cumsum(sizes)
        at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[at].tobytes().decode("utf-8", "replace")


@functools.lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): whole texts as token ids, and the ids as text again.

    ``ids`` is binary, little-endian unsigned 32-bit integers. Texts that contain the
    string of an added token get its id. Null and empty texts give no ids and an empty
    text; every row gives a row, repeated ones too; other columns are not read.
    ``path`` names the vocabulary file on the workers.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)  # lives on between the tasks of a worker, with its caches
        for batch in batches:
            done = 0
            for part in slices(batch.column(1).to_pylist()):
                ids = tool.encode_all(part)
                names = batch.column(0).slice(done, len(part))
                done += len(part)
                texts = [tool.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([names, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
