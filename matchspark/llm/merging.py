"""Byte-pair merging in vectorised rounds, and word-wise encoders for three public vocabularies.

One round works on flat numpy arrays that hold the symbols of many words: the smallest pair rank of
each word is found by a segmented minimum, all leftmost non-overlapping pairs of that rank are merged
at once, and the arrays are compacted. Words without a known pair leave; rounds end when none is left.

Merging equal pairs at once equals taking them one after the other from the left as long as no pair
that a merge creates has a rank as small as the current one. Where one has, only the leftmost pair of
that word is merged in that round, so the result is exact for every vocabulary.

A word takes a round for each distinct rank in it, so a very long one is cut first: a merge across two neighbouring
symbols needs a rule whose left part ends in the one and whose right part begins with the other. Where the vocabulary has
no such rule, what lies on both sides is merged by itself, all stretches in the same rounds. What is still long after some
rounds is cut again between the symbols of that moment, which reach less far than single characters.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cached_property

import numpy as np

NO_PAIR = np.int64(1) << 62
CODE_POINTS = 0x110000
LONG = 64  # words of more symbols are cut where no rule joins two neighbours; results are the same at every value


class PairTable:
    """Open hash table from (left symbol, right symbol) to (rank, merged symbol), probed by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, joints: np.ndarray,
                 rules: Callable[[], Iterable[tuple[list[int], list[int]]]]):
        """``joints``: for each rule the last first-round symbol of its left part and the first one of its right part.

        ``rules``: for each rule all symbols that its left part may end in, and all that its right part may begin with.
        """
        self.joints = np.unique((joints[:, 0].astype(np.int64) << 32) | joints[:, 1].astype(np.int64))
        self._rules = rules
        self.bits = max(4, int(np.ceil(np.log2(4 * len(left) + 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.slot = np.zeros(1 << self.bits, np.int64)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        self.rank = np.append(rank.astype(np.int64), NO_PAIR)
        self.merged = np.append(merged.astype(np.int64), -1)
        todo, at = np.arange(len(key)), self._home(key)
        while len(todo):
            free = self.keys[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.slot[at[put]] = key[todo[put]], todo[put]
            todo, at = todo[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    @cached_property
    def later_joints(self) -> np.ndarray:
        """Neighbours of any round that a rule may reach across; built when a word needs them."""
        return np.unique(np.fromiter(((a << 32) | b for tails, heads in self._rules() for a in tails for b in heads), np.int64))

    def _home(self, key: np.ndarray) -> np.ndarray:
        mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - self.bits - 3) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair, the last row for unknown pairs."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._home(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.slot[at], len(self.rank) - 1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.slot[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def _ends(text: str, symbol: dict[str, int]) -> list[int]:
    return [symbol[text[i:]] for i in range(len(text)) if text[i:] in symbol]


def _begins(text: str, symbol: dict[str, int]) -> list[int]:
    return [symbol[text[:i]] for i in range(1, len(text) + 1) if text[:i] in symbol]


def _stretches(symbols: np.ndarray, sizes: np.ndarray, joints: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the parts that merge by themselves, and the word of each part."""
    if not len(sizes) or sizes.max() <= LONG:
        return sizes, np.arange(len(sizes))
    ends = np.cumsum(sizes)
    first = np.zeros(len(symbols), bool)
    first[ends - sizes] = True
    inside = np.flatnonzero(np.repeat(sizes > LONG, sizes) & ~first)
    key = (symbols[inside - 1].astype(np.int64) << 32) | symbols[inside].astype(np.int64)
    known = joints()
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    first[inside[known[at] != key]] = True
    starts = np.flatnonzero(first)
    return np.diff(np.r_[starts, len(symbols)]), np.searchsorted(ends, starts, side="right")


def merge_rounds(symbols: np.ndarray, sizes: np.ndarray, table: PairTable, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of all words, one after another, and how many each word has; words have a symbol at least.

    ``level`` counts how often what is left of long words was cut anew; each level runs twice the rounds of the one before.
    """
    words = len(sizes)
    sizes, owner = _stretches(symbols, sizes, (lambda: table.later_joints) if level else (lambda: table.joints))
    word = np.repeat(np.arange(len(sizes)), sizes)
    done_symbols, done_words, rounds = [], [], 0
    while len(symbols):
        if rounds == 32 << level:
            length = np.bincount(word, minlength=len(sizes))
            long = length[word] > LONG
            if long.any():
                which = np.flatnonzero(length > LONG)
                merged, counts = merge_rounds(symbols[long], length[which], table, level + 1)
                done_symbols.append(merged)
                done_words.append(np.repeat(which, counts))
                symbols, word = symbols[~long], word[~long]
                if not len(symbols):
                    break
        rounds += 1
        row = np.full(len(symbols), len(table.rank) - 1)
        inside = np.flatnonzero(word[1:] == word[:-1])
        row[inside] = table.find(symbols[inside], symbols[inside + 1])
        rank = table.rank[row]
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        length = np.diff(np.r_[starts, len(symbols)])
        least = np.repeat(np.minimum.reduceat(rank, starts), length)
        active = least < NO_PAIR
        if not active.all():
            done_symbols.append(symbols[~active])
            done_words.append(word[~active])
            symbols, word, row, rank, least = symbols[active], word[active], row[active], rank[active], least[active]
            if not len(symbols):
                break
        take = rank == least
        at = np.arange(len(symbols))
        before = np.maximum.accumulate(np.where(take, -1, at))
        take &= (at - before) % 2 == 1
        chosen = np.flatnonzero(take)
        chosen = _without_conflicts(chosen, symbols, word, row, rank, table)
        symbols = symbols.copy()
        symbols[chosen] = table.merged[row[chosen]]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done_words:
        return np.zeros(0, np.int64), np.zeros(words, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(owner[word], minlength=words)


def _without_conflicts(chosen, symbols, word, row, rank, table):
    """Keep only the first choice in words where a new pair would rank as small as the current one."""
    of = word[chosen]
    several = np.r_[False, of[1:] == of[:-1]]
    crowd = several | np.r_[several[1:], False]
    if not crowd.any():
        return chosen
    i = chosen[crowd]
    new, current = table.merged[row[i]], rank[i]
    end = len(symbols)
    left, right = np.maximum(i - 1, 0), np.minimum(i + 2, end - 1)
    has_left, has_right = (i > 0) & (word[left] == word[i]), (i + 2 < end) & (word[right] == word[i])
    none = len(table.rank) - 1
    lowest = np.minimum(
        table.rank[np.where(has_left, table.find(symbols[left], new), none)],
        table.rank[np.where(has_right, table.find(new, symbols[right]), none)],
    )
    lowest = np.minimum(lowest, table.rank[table.find(new, new)])
    clash = np.zeros(int(word[-1]) + 1, bool)
    clash[word[i[lowest <= current]]] = True
    return chosen[~(several & clash[of])]


class WordMemory:
    """Maps 64-bit word hashes to numbers, whole arrays at a time; starts anew when ``limit`` words are known."""

    def __init__(self, limit: int) -> None:
        self.limit, self.bits = limit, int(np.ceil(np.log2(limit * 3)))
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.count = 0

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where unknown."""
        at = self._home(key)
        out = self.slot[at]
        open_ = np.flatnonzero((self.keys[at] != key) & (out >= 0))
        out[open_] = -1
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            slot, same = self.slot[at], self.keys[at] == key[open_]
            out[open_[same & (slot >= 0)]] = slot[same & (slot >= 0)]
            more = ~same & (slot >= 0)
            open_, at = open_[more], at[more]
        return out

    def add(self, key: np.ndarray) -> None:
        """Number new, different words in the order given."""
        todo, at = np.arange(len(key)), self._home(key)
        while len(todo):
            order = np.arange(len(todo))
            claim = np.full(len(todo), -1)
            free = self.slot[at] < 0
            where, first = np.unique(at[free], return_index=True)
            claim[order[free][first]] = where
            put = claim >= 0
            self.keys[at[put]], self.slot[at[put]] = key[todo[put]], self.count + todo[put]
            todo, at = todo[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
        self.count += len(key)


class WordCoder:
    """Encodes texts word by word with a bounded memory of words seen; a subclass says what a word is.

    Words are cut and hashed on byte arrays, so a word that was seen costs no Python object. ``remember``
    bounds the words kept, ``long_word`` the bytes of a word that may be kept (a polynomial hash of a short
    word has no systematic collisions); results don't depend on the first.
    """

    remember = 400_000
    long_word = 64
    piece_bytes = 1 << 20
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self) -> None:
        self.memory = WordMemory(self.remember)
        self._forget()

    def _forget(self) -> None:
        self.memory.clear()
        self.place = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def prepare(self, text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in bytes; texts are divided by a byte 255."""
        raise NotImplementedError

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each text; NULL is empty."""
        flat, counts, part, size = [], [], [], 0
        for text in texts:
            part.append(self.prepare(text) if text else b"")
            size += len(part[-1])
            if size >= self.piece_bytes:
                for out, new in zip((flat, counts), self._encode(part), strict=True):
                    out.append(new)
                part, size = [], 0
        if part:
            for out, new in zip((flat, counts), self._encode(part), strict=True):
                out.append(new)
        if not counts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(flat), np.concatenate(counts)

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\xff".join([*texts, b""])
        data = np.frombuffer(joined, np.uint8)
        starts, ends = self.cuts(data)
        number = self._numbers(joined, data, starts, ends)
        first, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        total = np.r_[0, np.cumsum(size)]
        flat = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        edges = np.r_[0, np.searchsorted(starts, text_ends)]
        return flat, np.diff(total[edges])

    def _numbers(self, joined: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word; unknown words are encoded first. Long words get a number of their own each time."""
        if self.memory.count + len(self.ends) > 2 * self.remember or len(self.ids) > 16 * self.remember:
            self._forget()
        key = word_hashes(data, starts, ends, self.BASE)
        long = ends - starts > self.long_word
        number = self.memory.find(key).astype(np.int64)
        number[long] = -1
        known = number >= 0
        number[known] = self.place[number[known]]
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number
        short = missing[~long[missing]]
        new_keys, pick, back = np.unique(key[short], return_index=True, return_inverse=True)
        pick = np.r_[short[pick], missing[long[missing]]]
        ids, sizes = self.encode_words([joined[s:e] for s, e in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)])
        base = len(self.ends) - 1
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        number[short] = base + back
        number[missing[long[missing]]] = base + len(new_keys) + np.arange(int(long[missing].sum()))
        if self.memory.count + len(new_keys) <= self.remember:
            self.memory.add(new_keys)
            self.place = np.concatenate([self.place, base + np.arange(len(new_keys))])
        return number


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """64-bit hashes of slices of bytes from one running sum: a polynomial in powers of ``base``, then mixed."""
    powers, inverse = _powers(len(data) + 1, base)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=running[1:])
    key = (running[ends] - running[starts]) * inverse[starts]
    key ^= (ends - starts).astype(np.uint64) << np.uint64(56)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(size: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64; kept for pieces of usual size only."""
    kept = _POWERS.get(int(base))
    if kept is not None and len(kept[0]) >= size:
        return kept[0][:size], kept[1][:size]
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        a = np.full(max(size, (1 << 20) + 4096), b, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    if size <= 1 << 22:
        _POWERS[int(base)] = (out[0], out[1])
    return out[0][:size], out[1][:size]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class PieceCoder(WordCoder):
    """A sentencepiece BPE model with byte fallback, dummy prefix and no other normalisation."""

    SPACE = "▁"

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(size)]
        odd = [i for i in range(size) if lib.is_control(i) or lib.is_unknown(i)]
        byte_of = {i: int(pieces[i][1:-1], 16) for i in range(size) if lib.is_byte(i)}
        normal = {p: i for i, p in enumerate(pieces) if i not in byte_of and i not in odd}
        if any(self.SPACE in p.lstrip(self.SPACE) for p in normal):
            raise ValueError("a piece has a space after other characters; words can't be encoded by themselves")
        symbol = dict(normal)
        for piece in normal:
            for char in piece:
                symbol.setdefault(char, size + CODE_POINTS + ord(char))
        pairs = [
            (symbol[p[:k]], symbol[p[k:]], -lib.get_score(i), i)
            for p, i in normal.items()
            for k in range(1, len(p))
            if p[:k] in symbol and p[k:] in symbol
        ]
        left, right, score, merged = (np.array(x) for x in zip(*pairs, strict=True))
        self.start = np.arange(CODE_POINTS) + size + CODE_POINTS
        for text, i in normal.items():
            if len(text) == 1:
                self.start[ord(text)] = i
        joints = [
            (ord(p[k - 1]), ord(p[k])) for p in normal for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol
        ]
        self.table = PairTable(left, right, np.unique(score, return_inverse=True)[1], merged, self.start[np.array(joints)], lambda: (
            (_ends(p[:k], symbol), _begins(p[k:], symbol))
            for p in normal for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol
        ))
        self.size = size
        self.byte_ids = np.zeros(256, np.int64)
        for i, b in byte_of.items():
            self.byte_ids[b] = i
        self.unknown_id = lib.unk_id()
        self.has_bytes = len(byte_of) == 256
        self.text_of = [
            b"" if i in odd and i != self.unknown_id
            else b" \xe2\x81\x87 " if i == self.unknown_id
            else b"" if i in byte_of
            else pieces[i].replace(self.SPACE, " ").encode()
            for i in range(size)
        ]
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(byte_of)] = True
        self.byte_of = byte_of
        self.odd = np.zeros(size, bool)
        self.odd[[i for i in odd if i != self.unknown_id]] = True
        super().__init__()

    def prepare(self, text: str) -> bytes:
        """The text behind the space of the dummy prefix; a space mark in the text is a space."""
        return b" " + text.replace(self.SPACE, " ").encode("utf-8", "surrogatepass")

    def cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A word starts at each run of spaces."""
        space = data == 32
        starts = np.flatnonzero(space & ~np.r_[False, space[:-1]])
        return starts, _ends_before(data, starts)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = code_points(b"\n".join(words).decode("utf-8", "surrogatepass"))
        sizes = np.array([len(w) for w in words])
        lead = (np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80
        sizes = np.add.reduceat(lead, np.r_[0, np.cumsum(sizes)[:-1]]).astype(np.int64)
        keep = np.ones(len(flat), bool)
        keep[(np.cumsum(sizes + 1) - 1)[:-1]] = False
        flat = flat[keep]
        symbols, sizes = merge_rounds(self.start[np.where(flat == 32, ord(self.SPACE), flat)], sizes, self.table)
        return self._to_ids(symbols, sizes)

    def _to_ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the ids of their UTF-8 bytes."""
        strange = np.flatnonzero(symbols >= self.size)
        if not len(strange):
            return symbols, sizes
        if not self.has_bytes:
            symbols = symbols.copy()
            symbols[strange] = self.unknown_id
            return symbols, sizes
        coded = [chr(int(s) - self.size - CODE_POINTS).encode("utf-8", "surrogatepass") for s in symbols[strange]]
        width = np.ones(len(symbols), np.int64)
        width[strange] = [len(b) for b in coded]
        word = np.repeat(np.arange(len(sizes)), sizes)
        out = np.repeat(symbols, width)
        ends = np.cumsum(width)
        begin = ends[strange] - width[strange]
        spread = np.repeat(begin - np.r_[0, np.cumsum(width[strange])[:-1]], width[strange])
        out[spread + np.arange(width[strange].sum())] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return out, np.bincount(np.repeat(word, width), minlength=len(sizes))

    def decode(self, ids: np.ndarray) -> str:
        """Text of a list of ids; the space of the dummy prefix goes, runs of byte ids become characters."""
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= self.size:
            raise ValueError("id out of range")
        bytes_at = np.flatnonzero(self.is_byte[ids])
        texts = self.text_of
        if not len(bytes_at):
            out = b"".join([texts[i] for i in ids.tolist()])
        else:
            values, parts, run = ids.tolist(), [], bytearray()
            for i in values:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(_characters(run))
                    run = bytearray()
                parts.append(texts[i])
            if run:
                parts.append(_characters(run))
            out = b"".join(parts)
        first = int(np.argmax(~self.odd[ids])) if self.odd[ids].any() else 0
        if not self.is_byte[ids[first]] and ids[first] != self.unknown_id and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


def _characters(run: bytearray) -> bytes:
    """Valid UTF-8 as it is, each other byte as the replacement character."""
    run, out = bytes(run), []
    while run:
        try:
            run.decode("utf-8")
            out.append(run)
            break
        except UnicodeDecodeError as e:
            out += [run[: e.start], "\ufffd".encode()]
            run = run[e.start + 1 :]
    return b"".join(out)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteCoder(WordCoder):
    """A byte-level BPE vocabulary of the tokenizers library, given as its JSON text.

    Two kinds are known: plain (spaces belong to the following word) and lower-casing with word ends.
    The added tokens of the JSON are found in a text first, the leftmost and then the longest; each is one id, and what
    lies between them is encoded as a text of its own.
    """

    #: How the two vocabularies cut a text before merging.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    CUT_FOLDED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.folds = spec["normalizer"] is not None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and self.folds:
                raise ValueError(f"added token {t['content']} is not found by its bare content")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = _byte_letters()
        if self.folds:
            import regex

            self.cut = regex.compile(self.CUT_FOLDED + "| ").findall
            joints = [(vocab[a[-1]], vocab[b if b in (b[0], b[0] + self.suffix) else b[0]]) for a, b in merges]
            rules = np.array([(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(merges)])
            self.table = PairTable(*rules.T, np.array(joints), lambda: ((_ends(a, vocab), _begins(b, vocab)) for a, b in merges))
            self.inner = np.array([vocab[c] for c in letters])
            self.last = np.array([vocab[c + self.suffix] for c in letters])
        else:
            import tiktoken

            if any(vocab[a + b] != len(letters) + k for k, (a, b) in enumerate(merges)):
                raise ValueError("ids don't follow the order of the merges, so they can't serve as ranks")
            byte = {c: bytes([b]) for b, c in enumerate(letters)}
            ranks = {b"".join(byte[c] for c in t): i for t, i in vocab.items() if t not in self.added}
            self.lib = tiktoken.Encoding("own", pat_str=self.CUT, mergeable_ranks=ranks, special_tokens={})
            self.width = np.zeros(max([*vocab.values(), *self.added.values()]) + 1, np.int64)
            for t, i in [*ranks.items(), *((t.encode(), i) for t, i in self.added.items())]:
                self.width[i] = len(t)
        super().__init__()

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = list(texts)
        if not any(t and any(mark in t for mark in self.added) for t in texts):
            return super().encode(texts)
        between, owner, mark = [], [], []  # mark: id of the added token after it, -1 at the end of a text
        for k, text in enumerate(texts):
            cut = self.marks.split(text) if text else [text]
            between += cut[::2]
            owner += [k] * len(cut[::2])
            mark += [*(self.added[t] for t in cut[1::2]), -1]
        flat, counts = super().encode(between)
        mark = np.array(mark, np.int64)
        marked = mark >= 0
        flat = np.insert(flat, np.cumsum(counts)[marked], mark[marked])
        return flat, np.bincount(owner, weights=counts + marked, minlength=len(texts)).astype(np.int64)

    def cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that can be encoded by themselves."""
        if self.folds:
            blank = BLANK[data] | (data == 255)
            before = np.r_[True, blank[:-1]]
            return np.flatnonzero(~blank & before), np.flatnonzero(np.r_[blank[1:], True] & ~blank) + 1
        edge = data == 255
        text_start = np.r_[True, edge[:-1]] & ~edge
        sure = ~(BLANK | UNSURE)[np.r_[data[1:], 255]]
        starts = np.flatnonzero(text_start | (data == 32) & sure)
        return starts, _ends_before(data, starts)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.folds:
            return self._encode_folded(words)
        ids, sizes = [np.zeros(0, np.int64)], np.zeros(len(words), np.int64)
        spaced = [k for k, w in enumerate(words) if w[:1] == b" "]
        plain = [k for k, w in enumerate(words) if w[:1] != b" "]
        order = np.array(spaced + plain, np.int64)
        text = b"".join([words[k] for k in spaced]).decode("utf-8", "surrogatepass")
        found = self.lib.encode_ordinary(text) if text else []
        for k in plain:
            single = self.lib.encode_ordinary(words[k].decode("utf-8", "surrogatepass"))
            sizes[k] = len(single)
            ids.append(np.array(single, np.int64))
        flat = np.array(found, np.int64)
        if spaced:
            ends = np.cumsum([len(words[k]) for k in spaced])
            owner = np.searchsorted(ends, np.cumsum(self.width[flat]) - 1, side="right")
            sizes[spaced] = np.bincount(owner, minlength=len(spaced))
        ids[0] = flat
        joined, by = np.concatenate(ids), sizes[order]
        begin = np.r_[0, np.cumsum(by)[:-1]]
        place = np.empty(len(words), np.int64)
        place[order] = begin
        total = np.r_[0, np.cumsum(sizes)]
        return joined[np.repeat(place - total[:-1], sizes) + np.arange(total[-1])], sizes

    def _encode_folded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words at once: divided by spaces, which the cut then gives back as dividers."""
        text = unicodedata.normalize("NFC", b" ".join(words).decode("utf-8", "surrogatepass"))
        pieces = self.cut(text.replace("Σ", "σ").lower())
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        is_gap = np.fromiter((p == b" " for p in coded), bool, len(coded))
        owner = np.cumsum(is_gap)[~is_gap]
        coded = [p for p in coded if p != b" "]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[flat]
        if len(sizes):
            ends = np.cumsum(sizes) - 1
            symbols[ends] = self.last[flat[ends]]
        ids, per_piece = merge_rounds(symbols, sizes, self.table)
        return ids, np.bincount(np.repeat(owner, per_piece), minlength=len(words))


def _ends_before(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A word ends at the next start or before the next byte 255."""
    edges = np.flatnonzero(data == 255)
    follow = np.r_[starts[1:], len(data)]
    at = np.searchsorted(edges, starts)
    return np.minimum(follow, edges[np.minimum(at, len(edges) - 1)])


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of characters that may be white space to some library; no cut is made before them.
UNSURE = np.zeros(256, bool)
UNSURE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xFF]] = True
