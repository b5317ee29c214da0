"""Token ids of whole texts by the tokenizers library, with a bounded cache of word ids.

The byte-level tokenizer cuts a text before it merges bytes: a single space between two
printable characters always begins a new cut, and so does a single line feed between
them, on both of its sides (no printable character but the space is white space). Ids of
such words don't depend on what surrounds them, so a worker encodes each word once and
joins cached ids. Stops after letters are a cut by themselves, so a word of letters is held
once, with and without them. Texts with any other white space or unusual characters are
encoded whole.
"""

from __future__ import annotations

import os
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that the cache holds before it goes back to those used last.
CACHE_WORDS = 1_000_000
#: Characters of texts whose words are looked up together.
TOGETHER = 8_000_000
#: Characters that are cut from the end of a word of letters: ASCII's but the apostrophe, with which a cut can begin.
STOPS = string.punctuation.replace("'", "")


def byte_letters() -> dict[int, str]:
    """The character by which the byte-level tokenizer stands for each byte: itself if it is printed, else one from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def listed(words: pa.Array) -> list[str]:
    """The strings of an array without nulls; its to_pylist takes several times as long."""
    return words.to_numpy(zero_copy_only=False).tolist()


def cut(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Ids as bytes, in pieces that begin at starts and end where the next one does."""
    ends = np.append(starts, len(ids)).astype("<i4") * 4
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(texts): for each text the little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # the same model for words of letters alone, given as the characters of their bytes: cut where a space is, or at line feeds
        self.byte_letters = byte_letters()
        self.lettered, self.lined = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.lettered.pre_tokenizer = pre_tokenizers.Split(self.byte_letters[ord(" ")], "merged_with_next")
        self.lined.pre_tokenizer = pre_tokenizers.Split(self.byte_letters[ord("\n")], "isolated")
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        self.line = vocab[self.byte_letters[ord("\n")]]
        self.words, self.known = pa.array([], pa.string()), pa.array([], pa.binary())

    def whole(self, texts: list[str]) -> list[bytes]:
        """Every text encoded by one call of the library."""
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in got]

    def _flat(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> pa.Array:
        """The ids of words: those that follow a space in one call, cut where a token opens with that space.

        A word that starts with a line feed, or with the mark of a text's first word, stands for itself.
        """
        spelt = lambda text: text.encode().decode("latin1").translate(self.byte_letters)
        plain = [i for i, w in enumerate(words) if w[0] not in "\n\x01"]
        alone = [i for i, w in enumerate(words) if w[0] in "\n\x01"]
        letters = [i for i in plain if words[i].isalpha()]
        lines = [i for i in alone if words[i][1:].isalpha()]
        order, got = [], [pa.array([], pa.binary())]
        for some, tokenizer, spell in ((letters, self.lettered, spelt), (sorted({*plain} - {*letters}), self.tokenizer, str)):
            if some:
                ids = self._flat(tokenizer, spell(" " + " ".join([words[i] for i in some])))
                got.append(cut(ids, np.flatnonzero(self.opens[ids])))
                assert len(got[-1]) == len(some)
                order += some
        for mark in "\n\x01":
            some = [i for i in lines if words[i][0] == mark]
            if some:
                ids = self._flat(self.lined, spelt("\n" + "\n".join([words[i][1:] for i in some])))
                starts = np.flatnonzero(ids == self.line)
                if mark != "\n":  # the line feeds only part the words
                    ids, starts = ids[ids != self.line], starts - np.arange(len(starts))
                got.append(cut(ids, starts))
                assert len(got[-1]) == len(some)
                order += some
        rest = sorted({*alone} - {*lines})
        got.append(pa.array(self.whole([words[i].lstrip("\x01") for i in rest]) if rest else [], pa.binary()))
        at = np.empty(len(words), np.int64)
        at[np.array(order + rest, np.int64)] = np.arange(len(words))
        return pa.concat_arrays(got).take(pa.array(at))

    def _get(self, words: pa.Array) -> pa.Array:
        """The ids of each of these distinct words."""
        stems = pc.ascii_rtrim(words, STOPS)
        ends = pc.not_equal(pc.binary_length(stems), pc.binary_length(words))
        tailed, shorter = listed(words.filter(ends)), listed(stems.filter(ends))
        letters = [(s[1:] if s[:1] in ("\n", "\x01") else s).isalpha() for s in shorter]
        tails = pa.array([w[len(s) :] if ok else "" for w, s, ok in zip(tailed, shorter, letters)], pa.string()).dictionary_encode()
        held = pa.array([s if ok else w for w, s, ok in zip(tailed, shorter, letters)], pa.string())
        coded = pc.replace_with_mask(words, ends, held).dictionary_encode()
        out = self._stems(coded.dictionary).take(coded.indices)
        after = pa.array(self.whole(tails.dictionary.to_pylist()) if tailed else [], pa.binary()).take(tails.indices)
        return pc.replace_with_mask(out, ends, pc.binary_join_element_wise(out.filter(ends), after, b""))

    def _stems(self, words: pa.Array) -> pa.Array:
        """The ids of each of these distinct words, which are kept; those that are kept are looked up among these, of which there are fewer."""
        places = np.full(len(words), -1)
        where = pc.index_in(self.words, value_set=words)
        places[where.drop_null().to_numpy()] = np.flatnonzero(where.is_valid().to_numpy(zero_copy_only=False))
        fresh = places < 0
        missing = words.filter(pa.array(fresh))
        ids = pa.concat_arrays([self.known, self._learn(listed(missing))])
        places[fresh] = len(self.known) + np.arange(len(missing))
        out = ids.take(pa.array(places))
        self.words, self.known = pa.concat_arrays([self.words, missing]), ids
        if len(self.words) > CACHE_WORDS:
            self.words, self.known = words, out
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose words are split by spaces; each distinct word is looked up once."""
        words = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = words.values.dictionary_encode()
        flat = self._get(coded.dictionary).take(coded.indices)
        _, ends, data = flat.buffers()
        cuts = np.frombuffer(ends, "<i4")[words.offsets.to_numpy()].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        return [bytes(view[a:b]) for a, b in zip(cuts, cuts[1:])]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null or empty ones. Results equal those of whole()."""
        out: list[bytes] = [b""] * len(texts)
        at: list[int] = []
        ready: list[str] = []
        chars = 0

        def flush() -> None:
            nonlocal chars
            for i, b in zip(at, self._together(ready)):
                out[i] = b
            at.clear()
            ready.clear()
            chars = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            spaced = text.replace("\n", " \n")
            if "  " in spaced or "\n " in spaced or spaced[0] == " " or spaced[-1] in " \n" or not text.replace("\n", "").isprintable():
                out[i] = self.whole([text])[0]
                continue
            if ready and chars + len(text) > TOGETHER:
                flush()
            at.append(i)
            ready.append("\x01" + spaced)
            chars += len(text)
        if ready:
            flush()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file; workers keep it from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
