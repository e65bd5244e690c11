"""Exact encoding with a public tokenizer file, one vocabulary lookup per distinct piece of a slice of text.

``PieceEncoder`` cuts a text only at places where the file's own pre-tokenizer provably ends a match whatever
stands on either side, so the ids of the text are those of its pieces in order. A slice of texts is cut and dictionary-encoded
in arrays; each distinct piece is encoded once, and the ids are gathered. A tokenizer file whose rules are not one of the two known below
is applied to whole texts. All cuts are at ASCII characters, so other white space and control characters stay inside pieces.

* white space dropped (normaliser NFC, runs of white space to one, lower case; split on classes without white
  space): no match holds white space and no character composes with a white-space character before it, so any
  white space is a cut.
* byte-level with the usual pattern: a character class never matches a space after its first character, so a match
  that holds a non-space character before white space ends there; the pattern only looks ahead, so what follows is
  encoded as if it began there. The same holds on both sides of a line feed between non-space characters.
* both: a match ends between a letter and a closing mark, and the mark's own match ends before white space.
* Special strings hold no white space and take none from their sides, so they stand within one piece.

A piece of letters of ASCII and Latin-1 (U+00C0 to U+00FF) is one pre-token, and its ids follow from the file's merges alone. Those are found by
``tiktoken`` from ranks read out of the same file: with every merge result ranked in merge order, the lowest-ranked
neighbouring pair is the pair the library merges next. All other pieces go through the library itself (a word with letters up to
U+017F through the ranks, too) and are remembered in a bounded table that keeps what is in use.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from farewise.llm.common import text_buffers

#: Distinct pieces other than plain words kept per Python worker, twice over (about 150 bytes each).
CACHE_PIECES = 200_000
#: Text cut at once; the arrays of a slice take some twenty times as much.
SLICE_BYTES = 4 << 20
#: Ids are kept as 16-bit integers where the vocabulary allows it.
SMALL_VOCABULARY = 1 << 16

_PUNCTUATION = ".,;:!?"
_SAFE_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
_WORD_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer for a file, without truncation or padding; one thread per task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def rules(path: str) -> str:
    """'spaced' or 'byte' for the two proven sets of rules, else 'whole'."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens") or []
    if any(not t["special"] or any(t[x] for x in ("normalized", "lstrip", "rstrip", "single_word"))
           or not re.fullmatch(r"<\|[a-z]+\|>", t["content"]) for t in added):
        return "whole"
    norm, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout") or spec.get("post_processor"):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "byte"
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers") or [{}]
    split = parts[0]
    if (kinds == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and norm["normalizers"][1]["content"] == " " and split.get("pattern") == {"Regex": _WORD_SPLIT}
            and split.get("invert") and split.get("behavior") == "Removed"
            and len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("use_regex")
            and not parts[1].get("add_prefix_space")):
        return "spaced"
    return "whole"


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (printable bytes stand for themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordRanks:
    """Ids of plain words from the merges of a tokenizer file; ``usable`` is False if the file is not of that form.

    A word-end mark is written as a trailing space, which no pre-token of such a file holds.
    """

    def __init__(self, path: str, mode: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, symbols, end = model["vocab"], byte_symbols(), model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        results = [vocab.get(a + b, -1) for a, b in merges]
        ranks = {}
        for token, i in vocab.items():
            stem, mark = (token[:-len(end)], b" ") if end and token.endswith(end) else (token, b"")
            if stem and all(c in symbols for c in stem):
                ranks[bytes(symbols[c] for c in stem) + mark] = i
        self.mark = " " if mode == "spaced" else "\n"
        single = [i for x, i in ranks.items() if len(x) == 1 or end and len(x) == 2 and x.endswith(b" ")]
        self.usable = (mode in ("spaced", "byte") and bool(end) == (mode == "spaced") and results == sorted(set(results))
                       and len(set(ranks.values())) == len(ranks) and max(single) < results[0]
                       and all(bytes([b]) in ranks for b in range(256)))
        if not self.usable:
            return
        pattern = "[^ ]+ " if self.mark == " " else "[^\n]+|\n"
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = lambda text: coder.encode_to_numpy(text, disallowed_special=())
        self.last = np.zeros(max(ranks.values()) + 1, bool)
        for x, i in ranks.items():
            self.last[i] = x.endswith(b" ") if self.mark == " " else x == b"\n"

    def ids(self, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, their number per word), all of them encoded in one call and cut at the marks."""
        n = len(offsets) - 1
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        marked = np.full(len(letters) + n, ord(self.mark), np.uint8)
        marked[np.arange(len(letters)) + np.repeat(np.arange(n), np.diff(offsets))] = letters
        flat = self.encode(marked.tobytes().decode()).astype(np.int64)
        last = self.last[flat]
        ends = np.flatnonzero(last) + 1
        if len(ends) != n:
            raise ValueError("a word holds the mark")
        counts = np.diff(ends, prepend=0)
        return (flat, counts) if self.mark == " " else (flat[~last], counts - 1)


_LETTER, _SPACE, _GRAPHIC, _MARK = (np.zeros(256, bool) for _ in range(4))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE[[32, *range(9, 14)]] = True
_GRAPHIC[33:127] = True
_MARK[[ord(c) for c in _PUNCTUATION]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the letters U+00C0 to U+00FF, whose class is the same in any library."""
    latin = np.append(False, raw[:-1] == 0xC3) & (raw >= 0x80) & (raw < 0xC0) & (raw != 0x97) & (raw != 0xB7)
    return _LETTER[raw] | latin | np.append(latin[1:], False)


def _lowered(raw: np.ndarray) -> np.ndarray:
    """The same letters in lower case; other bytes may change, so only words are taken from it."""
    out = _LOWER[raw]
    upper = np.append(False, raw[:-1] == 0xC3) & (raw >= 0x80) & (raw <= 0x9E)
    out[upper] += 32
    return out


def _after(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """What held for the byte before, within the text."""
    out = np.zeros(len(x), bool)
    out[1:] = x[:-1]
    out[edge] = False
    return out


def cut_pieces(mode: str, raw: np.ndarray, letter: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of texts that stand one after another and begin at ``edge`` (no empty text)."""
    space = _SPACE[raw]
    closes = np.append(space[1:], True)  # white space or another text follows
    closes[edge[1:] - 1] = True
    mark = _MARK[raw] & closes & _after(letter, edge)
    if mode == "spaced":
        first = np.append(False, space[:-1])
        first[edge] = True
        first &= ~space
        ends = ~space & closes
        ends[:-1] |= mark[1:]
        return np.flatnonzero(first | mark), np.flatnonzero(ends) + 1
    # a byte-level cut: known characters before white space, and on both sides of a line feed
    latin = raw == 0xC3
    solid = _GRAPHIC[raw] | (raw >= 0x80) & _after(latin, edge)
    first = mark | space & _after(solid, edge)
    feed = (raw == 10) & _after(solid, edge)
    first |= (_GRAPHIC[raw] | latin) & _after(feed, edge)
    first[edge] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(raw))


def _distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of the distinct value of each span, the distinct values)."""
    n = ends - starts
    offsets = np.append(0, np.cumsum(n))
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    values = raw[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    kind, width = (pa.large_binary(), np.int64) if len(raw) >= 2**31 else (pa.binary(), np.int32)
    coded = pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(values)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


class PieceEncoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False)`` of the library."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.tok = load(path)
        self.mode = rules(path)
        self.cap = cache_pieces
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= SMALL_VOCABULARY else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ranks = WordRanks(path, self.mode) if self.mode != "whole" else None
        if self.ranks is not None and not self.ranks.usable:
            self.ranks = None

    def _core(self, piece: str) -> str:
        """The word a piece consists of, lower-cased where the file does so; '' if it is anything else.

        Only letters below U+0180 count: their class and lower case are the same in any library.
        """
        bare = piece[1:] if self.mode == "byte" and piece[:1] == " " else piece
        if self.ranks is None or not bare.isalpha() or max(bare) >= "\u0180" or "\u0130" in bare:
            return ""
        return piece.lower() if self.mode == "spaced" else piece

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces as bytes of ``dtype``."""
        if len(self.known) + len(pieces) > self.cap:
            self.old, self.known = self.known, {}
        known, old, plain, rest = self.known, self.old, [], []
        for p in pieces:
            if p not in known:
                if p in old:
                    known[p] = old[p]
                elif core := self._core(text := p.decode()):
                    plain.append((p, core.encode()))
                else:
                    rest.append((p, text))
        if plain:
            offsets = np.append(0, np.cumsum([len(c) for _, c in plain]))
            flat, counts = self.ranks.ids(offsets, np.frombuffer(b"".join([c for _, c in plain]), np.uint8))
            raw, stops = flat.astype(self.dtype).tobytes(), (np.cumsum(counts) * self.dtype.itemsize).tolist()
            known.update((p, raw[a:b]) for (p, _), a, b in zip(plain, [0, *stops], stops))
        for lo in range(0, len(rest), 4096):
            some = rest[lo:lo + 4096]
            for (p, _), enc in zip(some, self.tok.encode_batch_fast([x for _, x in some], add_special_tokens=False)):
                known[p] = np.array(enc.ids, self.dtype).tobytes()
        return [known[p] for p in pieces]

    def _encode_slice(self, raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number per text) of texts that stand one after another."""
        letter = _letters(raw)
        starts, ends = cut_pieces(self.mode, raw, letter, edge)
        bad = np.append(0, np.cumsum(~letter, dtype=np.int32))
        bare = starts + (raw[starts] == 32 if self.mode == "byte" else 0)
        word = (bad[ends] == bad[bare]) & (ends > bare) if self.ranks is not None else np.zeros(len(starts), bool)
        code = np.empty(len(starts), np.int64)
        at, words = _distinct(_lowered(raw) if self.mode == "spaced" else raw, starts[word], ends[word])
        letters, offsets = text_buffers(words)
        flat, counts = self.ranks.ids(offsets - offsets[0], letters[offsets[0]:offsets[-1]]) if len(words) else (np.zeros(0, np.int64),) * 2
        code[word] = at
        at, others = _distinct(raw, starts[~word], ends[~word])
        found = self._look_up(others.to_pylist())
        code[~word] = len(words) + at
        flat = np.concatenate([flat.astype(self.dtype), np.frombuffer(b"".join(found), self.dtype)])
        counts = np.concatenate([counts, np.array([len(f) // self.dtype.itemsize for f in found], np.int64)])
        n = counts[code]
        begin = (np.cumsum(counts) - counts)[code]
        total = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[np.append(np.searchsorted(starts, edge), len(starts))])

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, as ``dtype``; number of ids of each text) of a column without nulls."""
        if self.mode == "whole":
            made = [self.tok.encode(t, add_special_tokens=False).ids for t in column.to_pylist()]
            return np.array([i for ids in made for i in ids], self.dtype), np.array([len(ids) for ids in made], np.int64)
        raw, offsets = text_buffers(column)
        sizes = np.diff(offsets.astype(np.int64))
        edge = offsets[:-1][sizes > 0].astype(np.int64)
        owner = np.flatnonzero(sizes)
        # longer texts are cut between words, so that no slice is much longer than ``SLICE_BYTES``
        for i in np.flatnonzero(sizes > SLICE_BYTES).tolist():
            lo, hi, more = int(offsets[i]), int(offsets[i + 1]), []
            view = raw[lo:hi].tobytes()
            while cut := _SAFE_CUT.search(view, (more[-1] - lo if more else 0) + SLICE_BYTES):
                more.append(lo + cut.start())
            edge, owner = np.append(edge, more), np.append(owner, [i] * len(more))
        order = np.argsort(edge, kind="stable")
        edge, owner = edge[order].astype(np.int64), owner[order].astype(np.int64)
        stop = np.append(edge[1:], int(offsets[-1]))
        counts, out, lo = np.zeros(len(column), np.int64), [np.zeros(0, self.dtype)], 0
        while lo < len(edge):
            hi = max(lo + 1, int(np.searchsorted(stop, edge[lo] + SLICE_BYTES, side="right")))
            ids, n = self._encode_slice(raw[edge[lo]:stop[hi - 1]], edge[lo:hi] - edge[lo])
            out.append(ids)
            np.add.at(counts, owner[lo:hi], n)
            lo = hi
        return np.concatenate(out), counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text as bytes of ``dtype``."""
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        raw, stops = ids.tobytes(), (np.cumsum(counts) * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and file; its table serves all tasks of the worker."""
    return PieceEncoder(path)
