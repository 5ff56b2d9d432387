"""Token ids of the tokenizers library, with a cache of the parts that texts share.

Both vocabularies split a text before merging, and no token crosses such a split. So parts
between splits that are certain from the bytes alone are encoded once and looked up after;
the ids are those of encoding each whole text at once, which the tests compare. Texts are cut,
and their ids put together, by Arrow; Python sees the distinct parts of a call only.
"""

from __future__ import annotations

import codecs
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabulon.llm.shared import worker_cache

#: Parts that a worker's cache holds before it starts anew.
HELD = 600_000
#: Words that are held as Arrow's bytes, some 40 each.
WORDS = 1_500_000
_GROUP, _FEW = 400, 100
#: Runs of these marks, and of Latin letters, are what both vocabularies split a text into. The
#: apostrophe, which may begin a part of its own, is none of them.
_MARKS = rb"[!-&(-/:-@\[-`{-~]"
_LATIN = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
_LOWER = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
#: By byte: whether it is one of ``_LATIN`` by itself (1), one of ``_MARKS`` (2), neither (0).
_KIND = np.array([1 if re.fullmatch(_LATIN, bytes([x])) else 2 if re.fullmatch(_MARKS, bytes([x])) else 0 for x in range(256)], np.uint8)
#: Bytes that are one of ``_LATIN`` with the byte C3 before them.
_AFTER_C3 = np.array([bool(re.fullmatch(_LATIN, bytes([0xC3, x]))) for x in range(256)])


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _per_line(tok, mapped: bool = False):
    """The tokenizer's own merges for a text whose lines are parts that it splits no further and
    that it leaves as they are: without the search for splits, which costs more than the merges.
    ``mapped``: the text is written in the letters that stand for bytes."""
    from tokenizers import Tokenizer, pre_tokenizers as P

    out = Tokenizer(tok.model)
    split = P.CharDelimiterSplit("\n")
    out.pre_tokenizer = split if mapped else P.Sequence([split, P.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.LargeBinaryArray:
    """Values of these sizes in bytes that follow each other in data."""
    place = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=place[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data))])


def _letters_and_marks(parts: pa.LargeBinaryArray) -> tuple[np.ndarray, pa.LargeBinaryArray, pa.LargeBinaryArray]:
    """Which parts are of ``_LATIN`` and ``_MARKS`` after them, if any; those parts' letters and marks."""
    _, place, data = parts.buffers()
    place = np.frombuffer(place, np.int64)[parts.offset : parts.offset + len(parts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)[place[0] : place[-1]]
    place = place - place[0]
    sizes = np.diff(place)
    pair = np.r_[(raw[:-1] == 0xC3) & _AFTER_C3[raw[1:]], np.zeros(min(1, len(raw)), bool)]
    pair[place[1:][sizes > 0] - 1] = False
    kind = _KIND[raw]
    kind[pair] = 1
    kind[1:][pair[:-1]] = 1
    letters, marks = (np.cumsum(np.r_[False, kind == k], dtype=np.int64 if len(kind) >> 31 else np.int32) for k in (1, 2))
    n, m = (x[place[1:]] - x[place[:-1]] for x in (letters, marks))
    plain = (n > 0) & (n + m == sizes) & (letters[place[:-1] + n] - letters[place[:-1]] == n)
    of = np.repeat(plain, sizes)
    return plain, _binary(raw[of & (kind == 1)], n[plain]), _binary(raw[of & (kind == 2)], m[plain])


def _alphabet() -> str:
    """By byte: the letter that stands for it in tokens of bytes; a newline is left as it is."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    letters = {b: chr(b) if b in own else chr(next(others)) for b in range(256)}
    return "".join((letters | {10: "\n"}).values())


class _Cached:
    #: Matches a part of letters and marks after them, as two groups.
    plain: re.Pattern

    def __init__(self, path: str):
        self.tok = _load(path)
        self.lines = _per_line(self.tok)
        self.cache: dict[bytes, bytes | None] = {}

    def whole(self, text: bytes) -> bytes:
        return np.array(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _singly(self, words: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _jointly(self, words: list[str], glue: str, mark: np.ndarray, at_end: bool, unsplit: bool = False) -> list[bytes]:
        """Words of letters, encoded many at a time; ``mark`` tells the ids that end (or begin)
        a word. Where they don't give one a word, the words are encoded singly. ``unsplit``:
        they are of ``_LATIN`` or ``_LOWER``, so each can be a line of its own."""
        out: list[bytes] = []
        groups = [words[i : i + _GROUP] for i in range(0, len(words), _GROUP)]
        line = "\n" + glue if unsplit and not at_end else "\n" if unsplit else glue
        texts = [line.join(g) if at_end else glue + line.join(g) for g in groups]
        for group, x in zip(groups, (self.lines if unsplit else self.tok).encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(x.ids, "<u4")
            at = np.flatnonzero(mark[ids])
            if len(at) != len(group):
                out += self._singly([w if at_end else glue + w for w in group])
                continue
            cuts = [0, *(at + 1).tolist()] if at_end else [*at.tolist(), len(ids)]
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _learn_plain(self, new: set[bytes]) -> list[bytes]:
        """Learn the parts of Latin letters and marks after them; returns the others."""
        match, cache, other = self.plain.fullmatch, self.cache, []
        if b"" in new:  # of an empty text, or before white space at a text's start
            cache[b""] = b""
            new = new.difference([b""])
        alone = [w for w in new if w.isalpha() and w.islower()]
        tailed, cores, marks = [], [], []
        for w in new.difference(alone):
            m = match(w)
            if m is None:
                other.append(w)
            elif m[2]:
                tailed.append(w)
                cores.append(m[1])
                marks.append(m[2])
            else:
                alone.append(w)
        alone += set(cores).difference(cache, alone)
        cache.update(zip(alone, self._letters(alone), strict=True))
        kinds = list(set(marks))
        ids = dict(zip(kinds, self._singly([x.decode() for x in kinds]), strict=True))
        cache.update(zip(tailed, [cache[c] + ids[x] for c, x in zip(cores, marks, strict=True)], strict=True))
        return other

    def _marks(self, of) -> np.ndarray:
        out = np.zeros(self.tok.get_vocab_size() + 1, bool)
        for token, i in self.tok.get_vocab().items():
            out[i] = of(token)
        return out

    def _found(self, parts: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of each part; null where its cuts aren't certain."""
        used = parts.to_pylist()
        new = set(used).difference(self.cache)
        if new:
            if len(self.cache) > HELD:
                self.cache.clear()
                new = set(used)
            self._learn(new)
        return pa.array(map(self.cache.__getitem__, used), pa.large_binary())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        ready = [self._ready(x) for x in texts]
        parts = self._split_all(pa.array([b"" if x is None else x for x in ready], pa.large_binary()))
        ends = np.asarray(parts.offsets)
        coded = parts.values[ends[0] : ends[-1]].dictionary_encode()
        found, at = self._found(coded.dictionary.cast(pa.large_binary())), coded.indices
        ends = ends - ends[0]
        unsure = np.r_[0, np.cumsum(np.asarray(found.is_null())[np.asarray(at)])][ends] if found.null_count else ends * 0
        ids = found.fill_null(b"").take(at) if len(found) else found
        _, place, data = ids.buffers()
        place = np.frombuffer(place, np.int64)[ids.offset :][ends].tolist() if len(ids) else [0] * len(ends)
        raw = memoryview(data or b"")
        out = [bytes(raw[a:b]) for a, b in zip(place[:-1], place[1:], strict=True)]
        for i in {i for i, x in enumerate(ready) if x is None}.union(np.flatnonzero(np.diff(unsure)).tolist()):
            out[i] = self.whole(texts[i])  # a part has None: its cuts aren't certain
        return out


class WordIds(_Cached):
    """For word_bpe_49k: white space only separates, and letters are lower-cased."""

    plain = re.compile(rb"(%b+)(%b*)" % (_LOWER, _MARKS))

    def __init__(self, path: str):
        super().__init__(path)
        self.ends = self._marks(lambda t: t.endswith("</w>"))

    def _letters(self, words: list[bytes]) -> list[bytes]:
        return self._jointly(b" ".join(words).decode().split(), " ", self.ends, True, True)

    def _ready(self, text: bytes) -> bytes | None:
        if b"<|" in text:  # may hold a special token
            return None
        if b"\xcc" in text or b"\xcd" in text:  # marks that compose with a letter
            return text
        return text.lower()

    def _split_all(self, texts: pa.LargeBinaryArray) -> pa.LargeListArray:
        return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], texts.buffers()[2]))

    def _learn(self, new: set[bytes]) -> None:
        rest, single = [], []
        for w in self._learn_plain(new):
            x = w.decode("utf-8", "replace")
            mark = x[-1] if x[-1] in ".,;:!?" else ""
            core = x[: len(x) - len(mark)]
            if core.isalpha() and core.lower().isalpha():  # letters beyond ASCII, with a mark or none
                rest.append((w, core, mark))
            else:
                single.append((w, x))
        done = self._jointly([c for _, c, _ in rest], " ", self.ends, True)
        self.cache.update(zip([w for w, _ in single], self._singly([x for _, x in single]), strict=True))
        marks = dict(zip(".,;:!?", self._singly([*".,;:!?"]), strict=True)) | {"": b""}
        for (w, _, mark), ids in zip(rest, done, strict=True):
            self.cache[w] = ids + marks[mark]


class ByteIds(_Cached):
    """For byte_bpe_50k: a token may begin with one space and holds none elsewhere, unless it
    is of white space only. A part is a piece between single spaces, with the space before it
    but at the text's start; a text that has other runs of spaces is encoded as a whole."""

    _TAIL = frozenset(b".,;:!?")
    #: What a line may begin with to be cut from the one before: nothing that is white space.
    seen = re.compile(rb"[!-~\xc3]")
    #: A newline without such before it (or the second byte after C3) or behind it.
    torn = re.compile(rb"\n(?:(?![!-~\xc3])|(?<![!-~]\n)(?<!\xc3[\x00-\xff]\n))")
    plain = re.compile(rb"(%b+)(%b*)" % (_LATIN, _MARKS))

    def __init__(self, path: str):
        super().__init__(path)
        self.starts = self._marks(lambda t: t.startswith("Ġ"))
        self.mapped, self.alphabet = _per_line(self.tok, True), _alphabet()
        self.bang = self.tok.token_to_id("!")
        self.words, self.word_ids = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())

    def _letters(self, words: list[bytes]) -> list[bytes]:
        return self._jointly(b" ".join(words).decode().split(), " ", self.starts, False, True)

    def _lines(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts as ``_per_line`` gives them, without its search for bytes' letters."""
        found = self.mapped.encode_batch_fast([codecs.charmap_decode(x, "strict", self.alphabet)[0] for x in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def _spaced(self, words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Ids of words of ``_LATIN`` with a space before each, many at a time."""
        ends = np.r_[np.arange(0, len(words), _FEW), len(words)]
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), words), pa.scalar(b"\n ", pa.large_binary())).to_pylist()
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i, found in enumerate(self._lines([b" " + x for x in lines])):
            first = np.flatnonzero(self.starts[found])
            size = np.diff(first, append=len(found))
            if len(first) != ends[i + 1] - ends[i] or first[0]:
                singly = self._singly([" " + w.decode() for w in words[ends[i] : ends[i + 1]].to_pylist()])
                found, size = np.frombuffer(b"".join(singly), "<u4"), np.array([len(w) // 4 for w in singly])
            ids.append(found)
            sizes.append(size)
        return _binary(np.concatenate(ids), 4 * np.concatenate(sizes))

    def _unspaced(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of ``_LATIN`` with no space before them, a mark's line after each."""
        groups = [words[i : i + _FEW] for i in range(0, len(words), _FEW)]
        out: list[bytes] = []
        for group, ids in zip(groups, self._lines([b"\n!\n".join([*g, b""]) for g in groups]), strict=True):
            at = np.flatnonzero(ids == self.bang).tolist()
            if len(at) != len(group):
                out += self._singly([w.decode() for w in group])
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in zip([0, *(i + 1 for i in at[:-1])], at, strict=True)]
        return out

    def _held(self, words: pa.LargeBinaryArray) -> np.ndarray:
        """Places of distinct words among those that are held, with those that weren't."""
        if len(self.words) > WORDS:
            self.words, self.word_ids = words[:0], words[:0]
        known = pc.index_in(self.words, value_set=words).fill_null(-1).to_numpy()  # far more than the words
        at = np.flatnonzero(known >= 0)
        place = np.full(len(words), -1)
        place[known[at]] = at
        new = place < 0
        if new.any():
            place[new] = len(self.words) + np.arange(np.count_nonzero(new))
            new = words.filter(pa.array(new))
            self.word_ids = pa.concat_arrays([self.word_ids, self._spaced(new)])
            self.words = pa.concat_arrays([self.words, new])
        return place

    def _found(self, parts: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Parts of letters and marks without a Python object for each."""
        if not len(parts):
            return parts
        plain, words, marks = _letters_and_marks(parts)
        words, marks = words.dictionary_encode(), marks.dictionary_encode()
        kinds = [x.decode() for x in marks.dictionary.to_pylist()]
        of = self._held(words.dictionary)
        both = pa.concat_arrays([self.word_ids, pa.array(self._singly(kinds), pa.large_binary())])
        at = np.stack([of[np.asarray(words.indices)], np.asarray(marks.indices) + len(self.words)], 1).ravel()
        both = both.take(pa.array(at))
        _, place, data = both.buffers()
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.frombuffer(place, np.int64)[: len(at) + 1 : 2].copy()), data])
        rest = super()._found(parts.filter(pa.array(~plain)))
        order = np.where(plain, np.cumsum(plain) - 1, np.cumsum(~plain) - 1 + len(coded))
        return pa.concat_arrays([coded, rest]).take(pa.array(order))

    def _ready(self, text: bytes) -> bytes | None:
        if b"<|" in text or b" \n" in text or b"  " in text or text[:1] == b" " or text[-1:] == b" ":
            return None
        if b"\n" in text and self.seen.match(text[:1]) and self.seen.match(text[-1:] if text[-2:-1] != b"\xc3" else b"\xc3") and not self.torn.search(text):
            text = text.replace(b"\n", b" \n\n \n")
        return b"\n" + text if text else b""  # the newline marks that no space stands before

    def _split_all(self, texts: pa.LargeBinaryArray) -> pa.LargeListArray:
        return pc.split_pattern(texts, b" ")

    @staticmethod
    def _split(piece: bytes) -> list[bytes] | None:
        """Cuts a piece at single newlines and before one mark after a letter; each cut part
        but the piece's first has the newline mark. None where its ends are white space."""
        spaced = piece[:1] != b"\n"
        out: list[bytes] = []
        if piece == b"\n\n":
            return [piece]
        for i, x in enumerate((piece if spaced else piece[1:]).split(b"\n")):
            s = x.decode("utf-8", "replace")
            if not s or s[0].isspace() or s[-1].isspace():
                return None
            head = b"" if spaced and i == 0 else b"\n"
            if i:
                out.append(b"\n\n")
            if len(x) > 1 and x[-1] in ByteIds._TAIL and x[-2:-1].isalpha():
                out += [head + x[:-1], b"\n" + x[-1:]]
            else:
                out.append(head + x)
        return out

    def _learn(self, new: set[bytes]) -> None:
        split = {w: self._split(w) for w in self._learn_plain(new)}
        cores = set(self._learn_plain({c for p in split.values() if p for c in p}.difference(self.cache)))
        spaced = [c for c in cores if c[:1] != b"\n"]
        words = [c.decode("utf-8", "replace") for c in spaced]
        alpha = [w.isalpha() for w in words]
        self.cache.update(zip([c for c, a in zip(spaced, alpha, strict=True) if a], self._jointly([w for w, a in zip(words, alpha, strict=True) if a], " ", self.starts, False), strict=True))
        self.cache.update(zip([c for c, a in zip(spaced, alpha, strict=True) if not a], self._singly([" " + w for w, a in zip(words, alpha, strict=True) if not a]), strict=True))
        plain = [c for c in cores if c[:1] == b"\n"]
        words = [c for c in plain if (m := self.plain.fullmatch(c, 1)) and not m[2]]
        self.cache.update(zip(words, self._unspaced([c[1:] for c in words]), strict=True))
        plain = [*set(plain).difference(words)]
        self.cache.update(zip(plain, self._singly([c[1:].decode("utf-8", "replace") for c in plain]), strict=True))
        for w, p in split.items():
            if p is None:
                self.cache[w] = None
            elif p != [w]:
                self.cache[w] = b"".join([self.cache[c] for c in p])


def encoder(kind: type, path: str):
    """The worker's encoder for a vocabulary, made once."""
    made = worker_cache("tokens")
    if (kind, path) not in made:
        made[kind, path] = kind(path)
    return made[kind, path]
