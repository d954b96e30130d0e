"""Token ids of whole texts by the tokenizers library; stretches met before are looked up."""

from __future__ import annotations

import json
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

#: Stretches whose ids a Python worker keeps, and ids kept in all for each of them on average.
CACHED, IDS_EACH = 400_000, 8
#: Bytes of text whose words are looked up at a time; the arrays of their ids take some fifteen times that.
SLICE = 2 << 20
#: Characters encoded at a time, where a text can be cut there.
PART = 1 << 21
#: Stretches sent to the library in one text.
JOINED = 200
#: A stretch begins at a space or line feed after a non-blank.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Very long texts are also cut between a letter or digit and a mark.
_CUT_LONG = re.compile(r"(?<=\S)(?=[ \n])|(?<=[^\W_])(?=[.,;:!?。，、])")
#: Stands before each space and line feed while texts are split; texts that hold it are split one by one.
_AT = "\x01"
# White space of Unicode, and letters and marks of which any tokenizer knows what they are.
_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LETTER = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: For words in lower case: the letters above without the one whose lower case holds a combining mark.
_CASED = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_ASCII_BLANKS = " \t\n\r\x0b\x0c"


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).to_pylist()


class Encoder:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them, special tokens' strings in a text included.

    Byte-level BPE never joins a non-blank with a blank after it, and what comes before a blank doesn't matter to what
    follows. A text therefore falls into stretches, each from the blanks before a word to the next blank, whose ids are
    the same wherever they occur; marks after the last letter are a piece of their own. Arrow splits a column of texts
    and finds its distinct stretches. Those met for the first time go to the library, many joined into one text where
    each has one blank at its start and no other: the first id of each, and only that, starts with a blank.
    Texts with a special token's string go to the library whole.
    """

    #: Letters and digits after which marks at a stretch's end are pieces of their own.
    letters = _LETTER
    cut_long = _CUT_LONG

    def __init__(self, path: str, cached: int = CACHED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._mark_bounds(self.tokenizer.get_vocab(with_added_tokens=True))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cached = cached
        self._reset()

    def _mark_bounds(self, vocabulary: dict[str, int]) -> None:
        blanks = tuple(self.tokenizer.id_to_token(int(self._whole(x)[0])) for x in (" ", "\n"))
        self.is_start = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_start[[i for t, i in vocabulary.items() if t.startswith(blanks)]] = True

    def _stretches(self, text: str) -> list[str]:
        return _CUT.split(text)

    def _single(self, stretches: pa.Array) -> pa.Array:
        """Those that can be joined into one text from whose ids _starts_in finds each one's first."""
        return pc.match_substring_regex(stretches, f"^[ \n][^{_BLANK}]+$")

    def _joined(self, names: list[bytes]) -> str:
        return b"".join(names).decode()

    def _starts_in(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.is_start[ids])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.lens, self.met = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self._add([b""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _shrink(self) -> None:
        """Forgets the stretches met least often, half of them at least."""
        n = len(self.numbers)
        if n <= self.cached and self.used <= IDS_EACH * self.cached:
            return
        met = self.met[:n]
        kept = np.flatnonzero(met > max(1, np.median(met)))
        kept = kept[np.cumsum(self.lens[kept]) <= IDS_EACH * self.cached // 2]
        kept = kept[kept > 0]  # the empty stretch is there anyway
        names, flat, starts, lens = list(self.numbers), self.flat, self.starts[kept], self.lens[kept]
        self._reset()
        self._add([names[k] for k in kept], flat[ragged(starts, lens)], lens)

    def _add(self, names: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        first, end = len(self.numbers), len(self.numbers) + len(names)
        while end > len(self.starts):
            self.starts, self.lens, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.met))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(self.used, len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first:end], self.lens[first:end] = self.used + np.cumsum(lens) - lens, lens
        self.met[first:end] = 0
        self.used += len(ids)
        self.numbers.update(zip(names, range(first, end)))

    def _learn(self, stretches: pa.Array) -> None:
        """Keeps the ids of stretches, which are new and distinct."""
        single = self._single(stretches)
        names = _bytes(joined := stretches.filter(single))
        ids, lens = [], []
        for k in range(0, len(names), JOINED):  # one text at a time: the library would otherwise start threads
            part = names[k : k + JOINED]
            found = np.array(self.tokenizer.encode_batch_fast([self._joined(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = self._starts_in(found)
            if len(at) != len(part):
                each = [self._whole(x) for x in joined.slice(k, JOINED).to_pylist()]
                found, at = np.concatenate(each), np.cumsum([0, *map(len, each[:-1])])
            ids.append(found)
            lens.append(np.diff(at, append=len(found)))
        others = stretches.filter(pc.invert(single))
        for name in others.to_pylist():
            ids.append(self._whole(name))
            lens.append(np.array([len(ids[-1])], np.int64))
        self._add(names + _bytes(others), np.concatenate(ids), np.concatenate(lens))

    def _numbers_of(self, stretches: pa.Array) -> np.ndarray:
        """The numbers of distinct stretches."""
        names = _bytes(stretches)
        at = np.fromiter(map(self.numbers.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(stretches.take(pa.array(new)))
            at[new] = np.fromiter((self.numbers[names[k]] for k in new.tolist()), np.int64, len(new))
        self.met[at] += 1
        return at

    def _ids(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches, number of ids of each); equal ones are looked up once."""
        told = stretches.dictionary_encode()
        whole = told.dictionary
        stems = pc.utf8_rtrim(whole, _MARKS)
        cut = pc.and_(pc.match_substring_regex(stems, f"[{self.letters}]$"), pc.less(pc.binary_length(stems), pc.binary_length(whole)))
        cut = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        ends = pc.binary_length(stems).to_numpy()[cut].tolist()
        marks = pa.array([x[n:] for x, n in zip(_bytes(whole.take(pa.array(cut))), ends)], pa.large_binary()).cast(pa.large_string())
        keep = np.ones(len(whole), bool)
        keep[cut] = False
        stems = pc.if_else(pa.array(keep), whole, stems).dictionary_encode()
        marks = marks.dictionary_encode()
        parts = np.zeros((len(whole), 2), np.int64)  # the empty stretch has number 0
        parts[:, 0] = self._numbers_of(stems.dictionary)[stems.indices.to_numpy()]
        parts[cut, 1] = self._numbers_of(marks.dictionary)[marks.indices.to_numpy()]
        lens = self.lens[parts]
        flat = self.flat[ragged(self.starts[parts].ravel(), lens.ravel())]
        lens = lens.sum(axis=1)
        at = told.indices.to_numpy()
        return flat[ragged((np.cumsum(lens) - lens)[at], lens[at])], lens[at]

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return self._whole(text)
        out, at = [np.zeros(0, np.uint32)], 0
        while at < len(text):
            m = self.cut_long.search(text, at + PART)
            end = m.start() if m else len(text)
            out.append(self._ids(pa.array(self._stretches(text[at:end]), pa.large_string()))[0])
            at = end
            self._shrink()
        return np.concatenate(out)

    def _split(self, texts: pa.Array, odd: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(stretches of all texts but the odd ones, the first of each text, odd texts: those given and any others that must be encoded one by one)."""
        odd |= pc.match_substring(texts, _AT).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        for blank in (" ", "\n"):
            plain = pc.replace_substring(plain, blank, _AT + blank)
        split = pc.split_pattern(plain, _AT)
        stretches = split.flatten()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        # a stretch that ends with a blank belongs with the next one: such texts are split one by one
        bad = np.flatnonzero(pc.match_substring_regex(stretches, f"[{_BLANK}]$").to_numpy(zero_copy_only=False))
        odd[np.searchsorted(offsets, bad, side="right") - 1] = True
        return stretches, offsets, odd

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text has none."""
        self._shrink()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = pc.greater(pc.binary_length(texts), PART)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        stretches, offsets, odd = self._split(texts, odd.to_numpy(zero_copy_only=False).copy())
        flat, lens = self._ids(stretches)
        sizes = np.diff(np.concatenate([[0], np.cumsum(lens)])[offsets])
        if odd.any():
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for k in np.flatnonzero(odd).tolist():
                parts[k] = self.encode(texts[k].as_py())
                sizes[k] = len(parts[k])
            flat = np.concatenate(parts)
        return flat, sizes

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """column()'s result with end_id after each text's ids."""
        flat, sizes = self.column(texts)
        out = np.full(len(flat) + len(sizes), end_id, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
        return out, sizes + 1


class WordEncoder(Encoder):
    """Ids of a BPE over words in lower case whose last token carries an end mark (word_bpe_49k.json).

    White space is dropped and no word spans it, so a text falls into stretches between ASCII blanks. A run of
    letters alone, or of marks alone, is one word: many of those go to the library in one text, where each one's ids
    begin after an end mark.
    """

    letters = "0-9" + _CASED
    cut_long = re.compile(f"[{_ASCII_BLANKS}]")

    def _mark_bounds(self, vocabulary: dict[str, int]) -> None:
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    def _stretches(self, text: str) -> list[str]:
        return re.split(f"[{_ASCII_BLANKS}]+", text)

    def _single(self, stretches: pa.Array) -> pa.Array:
        marks = re.sub(r"([\\\]\[^-])", r"\\\1", _MARKS)
        return pc.match_substring_regex(stretches, f"^(?:[{_CASED}]+|[{marks}]+)$")

    def _joined(self, names: list[bytes]) -> str:
        return b" ".join(names).decode()

    def _starts_in(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.flatnonzero(self.is_end[ids[:-1]]) + 1])

    def _split(self, texts: pa.Array, odd: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        plain = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts) if odd.any() else texts
        split = pc.ascii_split_whitespace(plain)
        return split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py(), odd


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None, cached: int = CACHED) -> Encoder:
    """The Encoder of this process for a vocabulary file (None: public_tokenizers' byte_bpe_50k.json), keeping cached stretches."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        with open(path, encoding="utf-8") as file:
            words = json.load(file)["model"].get("end_of_word_suffix")
        _encoders[path] = (WordEncoder if words else Encoder)(path)
    _encoders[path].cached = cached
    return _encoders[path]
