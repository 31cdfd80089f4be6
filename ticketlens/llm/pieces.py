"""Token ids of whole texts, from remembered pre-tokens.

White space never stands inside a token of the supported tokenizers, so the ids of a text
are those of its pieces between ASCII white space, one after the other. Pieces of plain
characters are cut into pre-tokens by the kind of their bytes, for many texts at once; a
pre-token is merged once and then found in a table by its bytes. What is plain is proved
with the library itself when the encoder is made; every other piece goes through the
library whole, and is remembered in the same way."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex
from tokenizers import Tokenizer

#: Characters that are tried for being plain: printable ASCII and the letters of Latin-1.
TRIED = [chr(c) for c in (*range(0x21, 0x7F), *range(0xC0, 0x100))]
#: Kinds of bytes.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
#: Bytes of text taken at a time; longest remembered bytes; slots and ids of the table.
SLAB_BYTES, KEY_BYTES, SLOTS, POOL = 2_000_000, 24, 1 << 20, 1 << 22


def check_supported(tokenizer_json: str) -> None:
    """Raises unless no token can hold white space: a normalizer that makes one space of a run
    of it, a splitter that keeps only what its pattern matches, added tokens without any."""
    model = json.loads(tokenizer_json)
    steps = (model.get("normalizer") or {}).get("normalizers", [])
    cuts = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
    right = (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["behavior"] == "Removed"
        and cuts[0]["invert"]
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and not regex.search(r"\s", "".join(cuts[0]["pattern"].get("Regex", " ")))
        and not (model.get("truncation") or model.get("padding") or model["model"].get("dropout"))
        and all(
            not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or regex.search(r"\s", t["content"]))
            for t in model.get("added_tokens", [])
        )
    )
    if not right or any(regex.search(cuts[0]["pattern"]["Regex"], c) for c in " \t\n\v\f\r"):
        raise ValueError("only tokenizers whose tokens never hold white space are supported")


class Encoder:
    """Encodes texts as arrays of ids in two bytes where the vocabulary fits, else in four."""

    def __init__(self, tokenizer_json: str):
        check_supported(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: The first two bytes of added tokens: pieces that hold them are not plain.
        self.marks = sorted({a[:2] for a in added})
        self._prove()
        self.keys = np.zeros((3, SLOTS), np.uint64)
        self.sizes = np.zeros(SLOTS, np.uint8)
        self.at, self.count = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint8)
        self.pool, self.filled = np.zeros(POOL, self.dtype), 0
        #: Where the ids of each piece stand in the pool, and how many: as many as it has room for.
        self.made: dict[bytes, tuple[int, int]] = {}

    def _cuts(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _kind(self, c: str) -> int:
        """How the library groups a character with itself, letters and digits."""
        shown = self._cuts(f"a{c}b{c}{c}1")
        for kind, parts in (
            (LETTER, [f"a{c}b{c}{c}", "1"]),
            (DIGIT, ["a", c, "b", c, c, "1"]),
            (OTHER, ["a", c, "b", c + c, "1"]),
        ):
            if shown == parts and (kind != OTHER or all(self._cuts(c + x + x) == [c, x + x] for x in map(chr, range(97, 123)))):
                return kind
        return ODD

    def _prove(self) -> None:
        """Tables of the kind and of the lower case of each byte: of ASCII, and of the second
        byte of the letters behind 0xC3. All others are odd."""
        normal = self.tokenizer.normalizer.normalize_str
        self.kind, self.lower = np.full((2, 256), ODD, np.uint8), np.tile(np.arange(256, dtype=np.uint8), (2, 1))
        self.kind[0, list(b" \t\n\v\f\r")] = SPACE
        self.spelled = {}
        plain: dict[int, str] = {LETTER: "", DIGIT: "", OTHER: ""}
        for c in TRIED:
            low, raw = normal(c), c.encode()
            kind = self._kind(low) if len(low) == 1 and normal(f"a{c}{c}1") == f"a{low}{low}1" else ODD
            if kind == ODD or len(low.encode()) != len(raw) or low.encode()[:-1] != raw[:-1]:
                continue
            self.kind[len(raw) - 1, raw[-1]] = kind
            self.lower[len(raw) - 1, raw[-1]] = low.encode()[-1]
            self.spelled[ord(low)] = "".join(s for s, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(low))
            plain[kind] += low
        together = (self._cuts(plain[LETTER]), self._cuts(plain[DIGIT]), self._cuts(plain[OTHER]))
        if together != ([plain[LETTER]], list(plain[DIGIT]), [plain[OTHER]]):
            raise ValueError("the kinds of characters are not what the pre-tokens are cut by")

    def _units(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lower-cased bytes, and start, end and oddness of each pre-token or odd piece."""
        kind, low = self.kind[0][raw], self.lower[0][raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        second = raw[lead + 1]
        kind[lead] = kind[lead + 1] = self.kind[1][second]
        low[lead + 1] = self.lower[1][second]
        for mark in self.marks:
            hits = raw[: len(raw) - len(mark) + 1] == mark[0]
            for i in range(1, len(mark)):
                hits &= raw[i : len(raw) - len(mark) + 1 + i] == mark[i]
            kind[np.flatnonzero(hits)] = ODD
        solid = kind != SPACE
        edge = np.zeros(len(raw) + 1, bool)  # a text starts here
        edge[bounds] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        pieces = np.flatnonzero(begins)
        odd_at = np.flatnonzero(kind == ODD)
        odd = np.zeros(len(pieces), bool)
        odd[np.searchsorted(pieces, odd_at, "right") - 1] = True
        cut = begins.copy()
        cut[1:] |= solid[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        starts = np.flatnonzero(cut)
        if odd.any():  # odd pieces are not cut
            piece = np.searchsorted(pieces, starts, "right") - 1
            starts = starts[~odd[piece] | begins[starts]]
            piece = np.searchsorted(pieces, starts, "right") - 1
            odd = odd[piece]
        else:
            odd = np.zeros(len(starts), bool)
        # A unit ends where the next one starts, or at the white space or text end before it.
        stop = ~solid
        stop[bounds[1:-1][bounds[1:-1] < len(raw)]] = True
        stops = np.append(np.flatnonzero(stop), len(raw))
        following = np.append(starts[1:], len(raw))
        ends = np.minimum(following, stops[np.searchsorted(stops, starts, "right")])
        return low, starts, ends, odd

    def _make(self, piece: bytes, odd: bool) -> list[int]:
        if odd:
            return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(piece.decode().translate(self.spelled))]

    def _slab(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some whole texts, and where those of each text start."""
        text, starts, ends, odd = self._units(raw, bounds)
        if self.filled + len(raw) > len(self.pool):  # no more ids than bytes
            self.sizes[:], self.filled = 0, 0
            self.made.clear()
            if len(raw) > len(self.pool):
                self.pool = np.zeros(len(raw), self.dtype)
        for a, b in zip(starts[odd].tolist(), ends[odd].tolist()):  # odd pieces stay as they are
            text[a:b] = raw[a:b]
        padded = np.concatenate([text, np.zeros(KEY_BYTES + 8, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(padded) - 7,), (1,))
        sizes = ends - starts
        key = []
        for part in range(3):
            left = np.clip(sizes - 8 * part, 0, 8).astype(np.uint64)
            keep = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
            key.append(words[starts + 8 * part] & keep)
        with np.errstate(over="ignore"):
            mixed = (key[0] ^ (key[1] * np.uint64(0x9E3779B97F4A7C15))) + key[2] * np.uint64(0xD1B54A32D192ED03)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        slot = (mixed >> np.uint64(64 - 20)).astype(np.int64)
        known = (self.sizes[slot] == sizes) & (self.keys[0][slot] == key[0]) & (self.keys[1][slot] == key[1])
        known &= self.keys[2][slot] == key[2]
        at, count = self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        missed = np.flatnonzero(~known)
        for i, a, b, o in zip(missed.tolist(), starts[missed].tolist(), ends[missed].tolist(), odd[missed].tolist()):
            piece = text[a:b].tobytes()
            place = self.made.get(piece)
            if place is None:
                ids = self._make(piece, o)
                place = self.made[piece] = self.filled, len(ids)
                self.pool[self.filled : self.filled + len(ids)] = ids
                self.filled += len(ids)
            at[i], count[i] = place
        # One piece of each slot is found there next time, if it is short enough.
        short = missed[(sizes[missed] <= KEY_BYTES) & (count[missed] < 256)]
        own, one = np.unique(slot[short], return_index=True)
        one = short[one]
        self.sizes[own], self.at[own], self.count[own] = sizes[one], at[one], count[one]
        for part in range(3):
            self.keys[part][own] = key[part][one]
        before = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(at - before[:-1], count) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, bounds)]

    def encode(self, raw: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text, given the bytes of all and where each starts (and ends)."""
        first = 0
        while first + 1 < len(bounds):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + SLAB_BYTES, "right")) - 1)
            low, high = int(bounds[first]), int(bounds[last])
            if high - low > 2 * SLAB_BYTES:
                yield np.concatenate([self._slab(raw[a:b], np.array([0, b - a]))[0] for a, b in _runs(raw, low, high)])
            elif high > low:
                ids, cuts = self._slab(raw[low:high], bounds[first : last + 1] - low)
                yield from (ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            else:
                yield from [np.zeros(0, self.dtype)] * (last - first)
            first = last

    def ids(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), np.uint8)
        return next(self.encode(raw, np.array([0, len(raw)]))).tolist()


def _runs(raw: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
    """A long text cut at white space, after about SLAB_BYTES each."""
    while low < high:
        end = min(low + SLAB_BYTES, high)
        while end < high and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield low, end
        low = end
