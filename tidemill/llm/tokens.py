"""Operator 9: token counts by overlap resynchronisation, and the byte-level BPE encoder.

A text above ``chunk`` characters is encoded in overlapping chunks.  Token byte
offsets are cumulative token lengths.  Two neighbouring chunks are spliced at a
*proven stable* boundary in their overlap: a place where the pre-tokenizer always
splits, whatever stands further left or right.  By the byte-level pattern no match
goes on

* from a character that is no white space to white space;
* from white space other than a space to anything that is no white space;
* between a letter and a digit, from a letter or digit to another character that is
  no white space, or from such a character to a digit;
* from such a character, but an apostrophe, to a letter.

Characters count by classes that Unicode 3.2 and today's tables agree on, and a
place inside an added token, or so near the overlap's edge that it could be, is
none.  Both encodings must have a token boundary at the place, too.  An overlap
without such a place is doubled, before anything is encoded, up to the whole left
chunk; a chunk without any grows to the right, twice as long each time.  So every
character is looked at and encoded a bounded number of times.

Nulls and empty texts have 0 tokens.  Rows are mapped one by one, so ties,
repeated rows and empty tables need no rule; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, small_batches, text_array

#: The split pattern of byte-level BPE with ``use_regex``.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK, OVERLAP = 32_768, 256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Kinds(dict):
    """Classes of characters by the pattern, filled as they are met: space, white, Letter, Digit, Other, Quote, unsure."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c == " ":
            kind = "s"
        elif c in WHITE:
            kind = "w"
        elif c == "'":
            kind = "Q"
        else:
            old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
            kind = "u" if old[0] != new[0] or new[0] in "CZ" else {"L": "L", "N": "D"}.get(new[0], "O")
        self[code] = kind
        return kind


_KINDS = _Kinds()
#: Between two kinds, the places that are always split.
_WHITE_BUT_SPACE = re.compile(r"[^\S ]")
_SPLITS = re.compile(r"(?<=[LDOQ])(?=[sw])|(?<=w)(?=[LDOQ])|(?<=L)(?=[DOQ])|(?<=D)(?=[LOQ])|(?<=O)(?=[LD])|(?<=Q)(?=D)")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by character."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary (.json of ``tokenizers``), run by tiktoken's merge loop.

    Added tokens inside texts are one id, as the library's default has it.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(alphabet.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = special
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for b, i in ranks.items():
            self.lengths[i] = len(b)
        for s, i in special.items():
            self.lengths[i] = len(s.encode())
        self.ranks = ranks
        self.stable = not any(re.search(r"\s", s) for s in special)
        self.longest = max(map(len, special), default=0)
        self._enc = tiktoken.Encoding("byte_bpe", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._maybe_special = re.compile("|".join(map(re.escape, special))) if special else None
        self._reset()

    def encode(self, text: str) -> np.ndarray:
        if self._maybe_special is not None and self._maybe_special.search(text):
            return np.array(self._enc.encode(text, allowed_special="all"), np.uint32)
        return self._enc.encode_to_numpy(text, disallowed_special=())

    # -- whole columns ---------------------------------------------------------
    def encode_column(self, texts: pa.Array, tail: int | None = None, keep: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets); ``tail`` is an id to put after each text.

        Texts are cut before each space (stable boundaries), each distinct piece is
        encoded once and the ids are gathered by numpy.  A text with a space next to
        other white space is encoded whole.  At most ``keep`` pieces stay in memory.
        """
        odd = pc.match_substring_regex(texts, r"[\s\p{Z}\x{85}\x0b\x1c-\x1f] | [\s\p{Z}\x{85}\x0b\x1c-\x1f]").to_numpy(zero_copy_only=False).astype(bool)
        if not self.stable:
            odd[:] = True
        plain = pc.if_else(pa.array(~odd), texts, "")
        lists = pc.split_pattern(plain, " ")
        off = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        base = off[0]
        off = off - base
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        n_inner = len(names)
        slot = self._slots(names, keep)
        # the first piece of a text has no space before it; odd texts are one piece
        heads = pc.list_element(lists, 0).to_numpy(zero_copy_only=False) if len(texts) else []
        whole = iter(texts.filter(pa.array(odd)).to_pylist())
        parts = [self.encode(next(whole)) if odd[i] else self.encode(heads[i]) if heads[i] else _NONE for i in range(len(texts))]
        parts.append(np.array([tail] if tail is not None else [], np.uint32))
        own = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate([self._flat[: self._used], *parts])
        size = np.concatenate([self._len[slot], own])
        at = np.concatenate([self._start[slot], self._used + np.cumsum(own) - own])
        codes = codes.copy()
        codes[off[:-1]] = n_inner + np.arange(len(texts))
        if tail is not None:
            codes = np.insert(codes, off[1:], n_inner + len(texts))
            off = off + np.arange(len(texts) + 1)
        each = size[codes]
        ids = flat[ragged(at[codes], each)]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, ends[off]

    def encode_words(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, keep: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, where each word's ids begin in it, how many there are); each word has a space before it.

        ``keys`` are the sorted distinct 64-bit hashes of the words, ``starts`` and ``ends`` their bytes in ``flat``.
        A word is read only when its hash is new.
        """
        if len(self._keys) > keep:
            self._reset()
        at = np.searchsorted(self._keys, keys)
        new = np.flatnonzero(self._keys.take(at, mode="clip") != keys) if len(self._keys) else np.arange(len(keys))
        if len(new):
            size = ends[new] - starts[new] + 1
            ends = np.cumsum(size)
            spaced = flat[ragged(starts[new] - 1, size)]
            spaced[ends - size] = 0x20
            text = spaced.tobytes().decode()
            slot = len(self._start) + np.arange(len(new))
            if _WHITE_BUT_SPACE.search(text) or (self._maybe_special and self._maybe_special.search(text)):
                self._add(text[1:].split(" "))
            else:  # encoded as one text and cut at the spaces
                ids = self._enc.encode_to_numpy(text, disallowed_special=())
                last = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
                self._pool(ids.astype(np.uint32), np.append(0, last[:-1]), np.diff(last, prepend=0))
            self._keys, self._key_slot = np.insert(self._keys, at[new], keys[new]), np.insert(self._key_slot, at[new], slot)
            at = np.searchsorted(self._keys, keys)
        slot = self._key_slot[at]
        return self._flat, self._start[slot], self._len[slot]

    def _slots(self, names: np.ndarray, keep: int) -> np.ndarray:
        """Where the ids of each piece (with a space before it) lie in the pool."""
        if len(self._pieces) > keep:
            self._reset()
        get = self._pieces.get
        slot = np.array([get(s, -1) for s in names], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            missing = names[new].tolist()
            first = len(self._start)
            self._add(missing)
            slot[new] = first + np.arange(len(missing))
            self._pieces.update(zip(missing, range(first, first + len(missing))))
        return slot

    def _add(self, missing: list[str]) -> None:
        """Encode pieces (with a space before each) and put their ids into the pool."""
        simple = [bool(s) and len(s.split()) == 1 and s[0] > " " and not s[0].isspace() and not s[-1].isspace() and not (self._maybe_special and self._maybe_special.search(s)) for s in missing]
        # pieces without white space are encoded as one text and cut at the spaces
        joined = [s for s, ok in zip(missing, simple) if ok]
        ids = self._enc.encode_to_numpy(" " + " ".join(joined), disallowed_special=()) if joined else _NONE
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(s.encode()) + 1 for s in joined])) + 1 if joined else np.zeros(0, np.int64)
        rest = [self.encode(" " + s) for s, ok in zip(missing, simple) if not ok]
        lens = np.empty(len(missing), np.int64)
        mask = np.array(simple, bool)
        lens[mask] = np.diff(ends, prepend=0)
        lens[~mask] = [len(r) for r in rest]
        order = np.concatenate([np.flatnonzero(mask), np.flatnonzero(~mask)])
        starts = np.empty(len(missing), np.int64)
        starts[order] = np.cumsum(lens[order]) - lens[order]
        self._pool(np.concatenate([ids, *rest]).astype(np.uint32), starts, lens)

    def _pool(self, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        self._start = np.concatenate([self._start, self._used + starts])
        self._len = np.concatenate([self._len, lens])
        self._grow(ids)

    def _reset(self) -> None:
        self._pieces: dict[str, int] = {}
        self._flat, self._used = np.zeros(1 << 16, np.uint32), 0
        self._start, self._len = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._keys, self._key_slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _grow(self, ids: np.ndarray) -> None:
        need = self._used + len(ids)
        if need > len(self._flat):
            self._flat = np.concatenate([self._flat[: self._used], np.zeros(max(need, 2 * len(self._flat)) - self._used, np.uint32)])
        self._flat[self._used : need] = ids
        self._used = need

    # -- overlap resynchronisation ----------------------------------------------
    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return sum(len(p) for p in self.spliced(text, chunk, overlap))

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
        """Runs of ids that together equal ``encode(text)``."""
        if len(text) <= chunk or not self.stable:
            yield self.encode(text)
            return
        plan = self._plan(text, chunk, overlap)
        at, end, places = plan[0]
        left = self.encode(text[at:end])
        for begin, next_end, next_places in plan[1:]:
            right = self.encode(text[begin:next_end])
            cut = self._common(left, right, text, begin, end, places)
            if cut is None:  # places are proven, so this is not expected
                left = self.encode(text[at:next_end])
            else:
                yield left[: cut[0]]
                left, at = right[cut[1] :], cut[2]
            end, places = next_end, next_places
        yield left

    def _plan(self, text: str, chunk: int, overlap: int) -> list[tuple[int, int, list[int]]]:
        """(begin, end, proven places in the overlap with the next chunk) of each chunk."""
        out, begin, fresh = [], 0, 0
        while True:
            size = chunk
            while True:
                end = min(len(text), fresh + size)
                if end == len(text):
                    return [*out, (begin, end, [])]
                wide, places = min(overlap, end - fresh), []
                while not (places := self._places(text, end - wide, end)) and wide < end - fresh:
                    wide = min(2 * wide, end - fresh)
                if places:
                    break
                size *= 2
            out.append((begin, end, places))
            begin, fresh = end - wide, end

    def _places(self, text: str, start: int, end: int, most: int = 8) -> list[int]:
        """The first proven places of an overlap, far enough inside it that all added tokens around them are seen."""
        margin = max(1, self.longest)
        inside = [m.span() for m in self._maybe_special.finditer(text, start, end)] if self._maybe_special else []
        out = []
        for m in _SPLITS.finditer(text[start:end].translate(_KINDS), margin, max(margin, end - start - margin + 1)):
            p = start + m.start()
            if p <= end - margin and not any(a < p < b for a, b in inside):
                out.append(p)
                if len(out) == most:
                    break
        return out

    def _common(self, left: np.ndarray, right: np.ndarray, text: str, begin: int, end: int, places: list[int]) -> tuple[int, int, int] | None:
        """(tokens of left before, tokens of right before, place) at the first of the places where both have a token boundary."""
        l_end, r_end = np.cumsum(self.lengths[left]), np.cumsum(self.lengths[right])
        for p in places:
            x, y = int(l_end[-1]) - len(text[p:end].encode()), len(text[begin:p].encode())
            i, j = int(np.searchsorted(l_end, x)), int(np.searchsorted(r_end, y))
            if i < len(l_end) and j < len(r_end) and l_end[i] == x and r_end[j] == y:
                return i + 1, j + 1, p
        return None


_NONE = np.zeros(0, np.uint32)


@functools.lru_cache(maxsize=4)
def load_bpe(name: str) -> ByteBpe:
    return ByteBpe(tokenizer_path(name))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; a narrow map without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = load_bpe(tokenizer)
        for b in batches:
            texts = text_array(b)
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            n = np.array([bpe.count(t, chunk, overlap) if t else 0 for t in texts.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n_bytes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
