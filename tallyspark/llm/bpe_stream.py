"""Operator 12: byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

A merge list has a sufficient lookahead L: a boundary that the merges leave at least L symbols
before the end of what is known stays one, whatever follows (``lookahead``). So the transducer
keeps the symbols of a word that are not settled yet, merges them whenever a window is full,
emits every token that ends L or more before the window's end and starts the next window behind
it. What is emitted never changes, and memory is a window, however long a word is.

Texts are read in slices, cut at white space, which the tokenizer drops and joins nothing across.
Words of Latin text are found, told apart and looked up for many texts at once (numpy over their
bytes); a new word that fits a window goes through all its merges together with the other new
ones of its length, a longer one through the transducer, and the ids of the words seen last are
remembered. A slice without white space is fed piece by piece. Decoding feeds ids through a state machine that
carries an unfinished character and whether a separator is due.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .text import joined, word_hashes

SLICE = 1 << 20
BATCH = 1 << 20
PIECE = 1 << 14
TOGETHER = 32
WINDOW = 256
MEMO = 1_000_000
DECODE_IDS = 1 << 16
NEVER = 1 << 30
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: What the fast path stands for (fixed values of the tokenizer's file); any other file goes through its own rules.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = regex.compile(_SPLIT.replace(r"\s", r"\p{White_Space}"))
_LATIN_END = "Ȁ"  # two bytes of UTF-8 up to here, the first one C8 at most
GAP, LETTER, DIGIT, OTHER = range(4)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from 256 on."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def lookahead(pairs: list[tuple[int, int]], product: list[int], size: Callable[[int], int]) -> int:
    """Sufficient lookahead of a merge list, in symbols: ``pairs`` by rank, the id each makes, and ids' sizes.

    A merge (a, b) can hang on text behind b in two ways: b may be taken first by a merge
    with what follows it (of lower rank), or b may not come to be, as one of the tokens at its right end
    is taken before. ``taken`` is the farthest that merges of a token with what follows reach so far,
    ``formed`` the farthest for a token's coming to be. Each step goes to lower ranks only,
    so one pass in order of rank is enough, and the farthest reach of any merge is the answer.
    """
    taken: dict[int, int] = {}
    formed: dict[int, int] = {}
    best = 0
    for (a, b), c in zip(pairs, product):
        behind = max(taken.get(b, 0), formed.get(b, 0))
        formed[c] = behind
        taken[a] = max(taken.get(a, 0), size(b) + behind)
        best = max(best, taken[a])
    return best


class Model:
    """Merges, base symbols and text rules of a tokenizer file. Raises ValueError for one the transducer does not cover."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bpe, vocab = spec["model"], spec["model"]["vocab"]
        if bpe["type"] != "BPE" or bpe.get("dropout") or bpe.get("continuing_subword_prefix") or bpe.get("byte_fallback") or bpe.get("ignore_merges"):
            raise ValueError("not a plain merge list")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or _SPACE.search(t["content"].encode()) for t in spec["added_tokens"]):
            raise ValueError("an added token is matched by other rules than its string")
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.fast = (spec["normalizer"] or {}).get("normalizers") == _NORMAL and spec["pre_tokenizer"]["pretokenizers"][0].get("pattern") == {"Regex": _SPLIT}
        if not self.fast:
            raise ValueError("the tokenizer's text rules are not known to be local")
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        suffix = bpe.get("end_of_word_suffix") or ""
        try:
            self.inner = [vocab[c] for c in byte_letters()]
            self.final = [vocab[c + suffix] for c in byte_letters()]
        except KeyError as e:
            raise ValueError("a byte has no symbol") from e
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"]]
        pairs = [(vocab[a], vocab[b]) for a, b in merges]
        self.product = [vocab[a + b] for a, b in merges]
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        self._by_key = np.argsort(keys, kind="stable")
        self._keys = keys[self._by_key]
        self.products = np.array(self.product, np.int64)
        self.kinds = np.array([_kind(chr(c)) for c in range(ord(_LATIN_END))], np.uint8)
        self.inners, self.finals = np.array(self.inner), np.array(self.final)
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(pairs)}
        made = {c: r for r, c in enumerate(self.product)}
        if len(made) < len(merges) or any(made.get(x, -1) >= r for r, pair in enumerate(pairs) for x in pair):
            raise ValueError("merges are not in the order in which their parts are made")
        self.size = dict.fromkeys([*self.inner, *self.final], 1)
        for (a, b), c in zip(pairs, self.product):
            self.size[c] = self.size[a] + self.size[b]
        self.lookahead = lookahead(pairs, self.product, self.size.__getitem__)
        self.window = self.lookahead + max(self.size.values()) + WINDOW
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        self.decoder = (spec.get("decoder") or {}).get("type")
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError("unknown decoder")

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a few symbols, least rank first and leftmost first."""
        rank, product = self.rank, self.product
        ranks = [rank.get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == NEVER:
                break
            i = ranks.index(r)
            ids[i : i + 2] = [product[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 32 | ids[i + 1], NEVER)
        return ids

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._by_key[at], NEVER)

    def merge_many(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words of one length (rows): rows of ids, and how many of each row count."""
        out, sizes, who = ids.copy(), np.full(len(ids), ids.shape[1]), np.arange(len(ids))
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while ids.shape[1] > 1:
            n = ids.shape[1]
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(at)), at]
            live = least < NEVER
            if not live.all():
                out[who[~live], :n], sizes[who[~live]] = ids[~live], n
                who, ids, ranks, at, least = who[live], ids[live], ranks[live], at[live], least[live]
            if not len(who):
                return out, sizes
            row, cols = np.arange(len(who)), np.arange(n - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            ids[row, at] = self.products[least]
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), axis=1)
            for k, some in ((at - 1, at > 0), (at, at < n - 2)):
                r, c = row[some], k[some]
                ranks[r, c] = self.ranks(ids[r, c], ids[r, c + 1])
        out[who, :1], sizes[who] = ids, 1
        return out, sizes

    def normal(self, text: str) -> str:
        """Normalised text without regard to white space; Latin text by Python's rules, which agree there."""
        if text.isascii() or max(text) < _LATIN_END:
            return text.lower()
        return self.library.normalizer.normalize_str(text)

    def split(self, text: str) -> list[bytes]:
        """Words of normalised text, as bytes."""
        if text.isascii() or max(text) < _LATIN_END:
            return [w.encode() for w in _WORDS.findall(text)]
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


class Transducer:
    """Symbols in, settled tokens out. ``feed`` takes bytes of a word, ``close`` ends it."""

    def __init__(self, model: Model, out: array):
        self.model, self.out, self.pending = model, out, b""

    def feed(self, data: bytes) -> None:
        """Emit what is settled. The last byte waits: whether it ends the word decides its symbol."""
        m = self.model
        if len(self.pending) + len(data) <= m.window:
            self.pending += data
            return
        data, at = self.pending + data, 0
        while len(data) - at > m.window:
            known = data[at : at + m.window]
            settled = 0
            for token in m.merge([m.inner[b] for b in known]):
                end = settled + m.size[token]
                if end > m.window - m.lookahead:
                    break
                self.out.append(token)
                settled = end
            at += settled
        self.pending = data[at:]

    def close(self) -> None:
        m, word = self.model, self.pending
        if word:
            self.out.extend(m.merge([*(m.inner[b] for b in word[:-1]), m.final[word[-1]]]))
            self.pending = b""


def _kind(c: str) -> int:
    return GAP if regex.match(r"\p{White_Space}", c) else LETTER if regex.match(r"\p{L}", c) else DIGIT if regex.match(r"\p{N}", c) else OTHER


def latin_words(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes of normalised Latin text that ends with a space."""
    kind = kinds[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        kind[lead] = kind[lead + 1] = kinds[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    start = np.empty(len(data), bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= (kind == DIGIT) & ((data & 0xC0) != 0x80)
    start &= kind != GAP
    # an apostrophe that starts a word and is followed by a contraction's letters
    q = np.flatnonzero(start & (data == 39))
    q = q[kind[q + 1] == LETTER]
    if len(q):
        one, two = data[q + 1], data[np.minimum(q + 2, len(data) - 1)]
        size = np.where(np.isin(one, list(b"stmd")), 1, 0)
        size[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 2
        q, size = q[size > 0], size[size > 0]
        start[q + 1] = False
        rest = q + 1 + size
        start[rest] = kind[rest] != GAP
    last = kind != GAP
    last[:-1] &= start[1:] | (kind[1:] == GAP)
    return np.flatnonzero(start), np.flatnonzero(last) + 1


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices [start, start + size) of ``values``, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Run:
    """An array that grows at its end, in memory that doubles (what is not yet filled takes no room)."""

    def __init__(self, kind: type | str):
        self.kept, self.size = np.empty(1024, kind), 0

    def __len__(self) -> int:
        return self.size

    @property
    def all(self) -> np.ndarray:
        return self.kept[: self.size]

    def extend(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.kept):
            wider = np.empty(max(size, 2 * len(self.kept)), self.kept.dtype)
            wider[: self.size] = self.all
            self.kept = wider
        self.kept[self.size : size] = more
        self.size = size


class Memo:
    """Ids of words by a 64-bit hash of their bytes; the bytes are compared at each look-up.

    Words lie one after the other in ``text`` and their ids in ``ids``, as numbers of ``kind``; ``text_end`` and ``ids_end`` say where each ends.
    """

    def __init__(self, kind: type = np.uint32):
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.text, self.ids = Run(np.uint8), Run(kind)
        self.text_end, self.ids_end = Run(np.int64), Run(np.int64)
        self.text_end.extend(np.zeros(1, np.int64))
        self.ids_end.extend(np.zeros(1, np.int64))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 if there is none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.slots[at], -1).astype(np.int64)

    def add(self, hashes: np.ndarray, text: np.ndarray, text_size: np.ndarray, ids: np.ndarray, ids_size: np.ndarray) -> np.ndarray:
        """Remember new words (``hashes`` ascending); returns their slots."""
        slots = len(self.slots) + np.arange(len(hashes))
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, place, hashes), np.insert(self.slots, place, slots)
        self.text_end.extend(len(self.text) + np.cumsum(text_size))
        self.ids_end.extend(len(self.ids) + np.cumsum(ids_size))
        self.text.extend(text)
        self.ids.extend(ids)
        return slots

    def words(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of these slots start in ``text``, and their sizes."""
        at = self.text_end.all[slot]
        return at, self.text_end.all[slot + 1] - at

    def found(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these slots start in ``ids``, and how many they are."""
        at = self.ids_end.all[slot]
        return at, self.ids_end.all[slot + 1] - at


class Encoder:
    """Ids of whole texts. About MEMO words are remembered at most, their ids as ``kind``; then all are forgotten."""

    def __init__(self, model: Model, kind: type = np.uint32):
        self.model, self.kind, self.memo = model, kind, Memo(kind)

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Slices of Latin text go together, BATCH bytes at a time; others alone."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting, size = [], 0
        for k, text in enumerate(texts):
            for part in slices(text):
                place = len(out[k])
                out[k].append(None)
                plain = self._latin(part)
                if plain is None:
                    out[k][place] = self._alone(part)
                    continue
                waiting.append((k, place, plain))
                size += len(plain)
                if size >= BATCH:
                    self._flush(waiting, out)
                    waiting, size = [], 0
        self._flush(waiting, out)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]

    def _latin(self, part: bytes) -> bytes | None:
        """A slice in lower case, if numpy can take it: two-byte letters at most, bounded, no special token."""
        if len(part) > 4 * SLICE or self.model.special is not None and b"<|" in part and self.model.special.search(part):
            return None
        part = part.lower() if part.isascii() else part.decode().lower().encode()
        return None if _BEYOND_LATIN.search(part) else part

    def _flush(self, waiting: list, out: list) -> None:
        if waiting:
            data, starts, ends = joined([x[2] for x in waiting])
            ids, word_at, sizes = self._together(data)
            edge = np.concatenate(([0], np.cumsum(sizes)))
            first, last = edge[np.searchsorted(word_at, starts)], edge[np.searchsorted(word_at, ends)]
            for (k, place, _), a, b in zip(waiting, first.tolist(), last.tolist()):
                out[k][place] = ids[a:b]

    def _together(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words of ``data``, the words' starts, and the number of ids of each."""
        begin, end = latin_words(data, self.model.kinds)
        if not len(begin):
            return np.zeros(0, np.uint32), begin, np.zeros(0, np.int64)
        hashes, first, which = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        size = end - begin
        if len(self.memo.slots) + len(hashes) > MEMO:
            self.memo = Memo(self.kind)
        memo = self.memo
        slot = memo.find(hashes)
        new = np.flatnonzero(slot < 0)
        if len(new):
            ids, ids_size = self._merged(data, begin[first[new]], size[first[new]])
            slot[new] = memo.add(hashes[new], gathered(data, begin[first[new]], size[first[new]]), size[first[new]], ids, ids_size)
        slot = slot[which]
        at, known = memo.words(slot)
        same = known == size
        differ = gathered(memo.text.all, at[same], size[same]) != gathered(data, begin[same], size[same])
        (ids_at, ids_size), ids = memo.found(slot), memo.ids.all
        odd = np.flatnonzero(~same)
        if differ.any():
            odd = np.union1d(odd, np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(differ), "right")])
        if len(odd):  # words whose hash another word has
            more, more_size = self._merged(data, begin[odd], size[odd])
            ids_at[odd], ids_size[odd] = len(ids) + np.cumsum(more_size) - more_size, more_size
            ids = np.concatenate((ids, more))
        return gathered(ids, ids_at, ids_size), begin, ids_size

    def _merged(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        m, found, counts = self.model, [None] * len(begin), np.zeros(len(begin), np.int64)
        for n in np.unique(size).tolist():
            these = np.flatnonzero(size == n)
            if n > TOGETHER:
                for k in these.tolist():
                    found[k] = self._word(data[begin[k] : begin[k] + n].tobytes())
                    counts[k] = len(found[k])
                continue
            letters = data[begin[these][:, None] + np.arange(n)]
            symbols = m.inners[letters]
            symbols[:, -1] = m.finals[letters[:, -1]]
            rows, counts[these] = m.merge_many(symbols)
            for k, row, c in zip(these.tolist(), rows.astype(np.uint32), counts[these].tolist()):
                found[k] = row[:c]
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), counts

    def _word(self, word: bytes) -> np.ndarray:
        t = Transducer(self.model, array("I"))
        t.feed(word)
        t.close()
        return np.array(t.out, np.uint32)

    def _alone(self, part: bytes) -> np.ndarray:
        """Ids of a slice by its own: its parts between white space, special tokens among them."""
        out = array("I")
        for x in part.split():
            out.frombytes(self._part(x))
        return np.array(out, np.uint32)

    def _plain(self, part: bytes) -> bytes:
        """Ids of a part without special tokens."""
        out = array("I")
        if len(part) > PIECE:
            self._stream(part, out)
        else:
            m, t = self.model, Transducer(self.model, out)
            for w in m.split(m.normal(part.decode())):
                t.feed(w)
                t.close()
        return out.tobytes()

    def _part(self, part: bytes) -> bytes:
        """Ids of a part without ASCII white space; special tokens are found in the text as it is."""
        m = self.model
        if m.special is None or not m.special.search(part):
            return self._plain(part)
        out, at = [], 0
        for hit in m.special.finditer(part):
            out += [self._plain(part[at : hit.start()]), array("I", [m.specials[hit[0].decode()]]).tobytes()]
            at = hit.end()
        return b"".join([*out, self._plain(part[at:])])

    def _stream(self, part: bytes, out: array) -> None:
        """A part of any length, piece by piece; a word may run on over many pieces."""
        m, t, tail = self.model, Transducer(self.model, out), ""
        for piece in pieces(part.decode()):
            text = m.normal(piece)
            words = m.split(tail + text)
            if tail:
                more = words[0][len(tail.encode()) :]
                if more:
                    t.feed(more)
                if len(words) > 1:
                    t.close()
                words = words[1:]
            for word in words[:-1]:
                t.feed(word)
                t.close()
            if words:
                t.feed(words[-1])
            last = words[-1] if words else b""
            end = text[-1:]
            if (last[:1] == b"'" and len(last) > 1 and end.isalpha()) or (end and not m.split(end)):
                t.close()  # a contraction, or white space
                tail = ""
            else:
                tail = "-" if end == "'" else end  # one letter of the same kind that starts no contraction
        t.close()


_BEYOND_LATIN = re.compile(b"[\xc8-\xff]")


def slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of about SLICE bytes, cut in front of white space; without any, a slice goes on."""
    at, n = 0, len(text)
    while at < n:
        hit = _SPACE.search(text, at + SLICE) if n - at > SLICE else None
        end = hit.start() if hit else n
        yield text if end - at == n else text[at:end]
        at = end


def joins_back(c: str) -> bool:
    """Whether a character may combine with what stands before it (so a text is not cut there)."""
    return c >= "̀" and (unicodedata.combining(c) != 0 or c in _seconds())


_second_parts: set[str] = set()


def _seconds() -> set[str]:
    """Characters that stand second in a composition, the parts of Korean syllables included."""
    if not _second_parts:
        for i in range(0x110000):
            d = unicodedata.decomposition(chr(i))
            if d and not d.startswith("<") and " " in d:
                _second_parts.update(chr(int(x, 16)) for x in d.split()[1:])
        _second_parts.update(map(chr, range(0x1160, 0x1200)))
    return _second_parts


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut where neither a composed character nor a contraction can be parted."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and (joins_back(text[end]) or _may_contract(text, end)):
            end += 1
        yield text[at:end]
        at = end


def _may_contract(text: str, end: int) -> bool:
    """Whether a cut at ``end`` might part an apostrophe from the letters of its contraction."""
    if text[end - 1] == "'":
        return text[end].lower() in "stmdrvl"
    return text[end - 2 : end - 1] == "'" and text[end - 1 : end + 1].lower() in ("re", "ve", "ll")


class Decoder:
    """Ids in, text out: an incremental state machine from token bytes to characters.

    Without a decoder in the tokenizer's file, tokens' strings are joined by a space; with a
    byte-level one their bytes are, and bytes that are no UTF-8 become U+FFFD. Ids that the
    vocabulary does not have give nothing.
    """

    def __init__(self, model: Model):
        byte_level = model.decoder == "ByteLevel"
        self.joint = b"" if byte_level else b" "
        known = {i: self.joint + (self._bytes(model, t) if byte_level else t.encode()) for i, t in model.tokens.items()}
        pieces = [known.get(i, b"") for i in range(max(known) + 1)]
        self.letters = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([*map(len, pieces), 0])
        self.start = np.cumsum(self.size) - self.size
        self.reset()

    @staticmethod
    def _bytes(model: Model, token: str) -> bytes:
        return bytes(model.byte_of[c] for c in token) if all(c in model.byte_of for c in token) else token.encode()

    def reset(self) -> None:
        self.characters, self.started = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: np.ndarray | list[int]) -> str:
        ids = np.minimum(np.asarray(ids, np.int64), len(self.size) - 1)
        data = gathered(self.letters, self.start[ids], self.size[ids]).tobytes()
        if data and not self.started:
            self.started, data = True, data[len(self.joint) :]
        return self.characters.decode(data)

    def close(self) -> str:
        out = self.characters.decode(b"", True)
        self.reset()
        return out


_models: dict[str, Model] = {}


def load(path: str) -> Model:
    """The model of a file; read once a worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) of every row's whole text.

    ``tokenizer``: a tokenizers file with a merge list over bytes whose rules drop white space (its
    truncation and padding are not used, its special tokens not added, but found where a text
    holds them). A null text is empty, an empty one has no ids; null and repeated doc_ids and
    equal rows stay rows of their own; further columns are ignored; an empty table gives no
    rows. A row is encoded where it is read, without a shuffle.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            ids = encoder.texts(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(list(map(len, ids)), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(load(path))
    return _encoders[path]


def _ids(blob: bytes) -> Iterator[np.ndarray]:
    """Ids of a row of ``encode``, some at a time."""
    for i in range(0, len(blob), 4 * DECODE_IDS):
        yield np.frombuffer(blob[i : i + 4 * DECODE_IDS], "<u4")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of the rows of ``encode`` (further columns are ignored, special tokens kept)."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load(tokenizer))
        for batch in batches:
            texts = ["".join([*map(decoder.feed, _ids(blob)), decoder.close()]) for blob in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of ``encode``; a text is decoded and hashed some ids at a time."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer)
        decoder = Decoder(model)
        numbers = [b" %d" % i for i in range(max(model.tokens) + 1)]
        digits, size = np.frombuffer(b"".join(numbers), np.uint8), np.array(list(map(len, numbers)))
        start = np.cumsum(size) - size
        for batch in batches:
            counts, out_ids, out_texts = [], [], []
            for blob in batch["ids"].to_pylist():
                of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in _ids(blob):
                    of_ids.update(gathered(digits, start[ids], size[ids])[0 if n else 1 :].tobytes())
                    of_text.update(decoder.feed(ids).encode())
                    n += len(ids)
                of_text.update(decoder.close().encode())
                counts.append(n)
                out_ids.append(of_ids.hexdigest())
                out_texts.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(out_ids), pa.array(out_texts)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
