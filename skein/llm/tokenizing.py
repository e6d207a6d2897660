"""Exact batch encoding with the tokenizers library, each distinct word encoded once.

Both public BPE vocabularies used here split text before merging, and no piece
crosses the border between a character that is not white space and a following
blank or newline. Text cut at such borders therefore encodes to the same ids as
the whole, and the words of natural text repeat. Texts with any other white
space or control characters go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .cluster import worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space and separators other than blank and newline, and characters that some definitions count as white space.
_OTHER = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
MARK = "<|endoftext|>"
#: Letters with signs after them, an apostrophe (contractions) and brackets of special tokens aside.
_SIGNED = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([-!\"#$%&()*+,./:;=?@\\[\\]^_`{|}~]+)")
#: From here on lower-casing may depend on the neighbours or change a letter's kind.
_HIGH = re.compile("[\u0130-\U0010ffff]")
#: Letters that lower-casing and composition leave single letters.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the package comes with the environment."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """``ids([text])`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` as unsigned 32-bit bytes.

    Keeps at most ``most`` words of either kind: once full, other words are
    encoded anew for each call, unless most words of a call are such; then the
    memory starts afresh.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.exact: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # of the word after one blank
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.mark = self.tokenizer.token_to_id(MARK)
        size = max(vocab.values()) + 1
        self.last, self.first = np.zeros(size, bool), np.zeros(size, bool)
        for token, k in vocab.items():
            self.last[k] = token.endswith("</w>")
            self.first[k] = token.startswith("\u0120")  # the byte-level form of a blank
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: Words only: white space and upper case don't matter, letters and signs part.
        self.loose = bool(self.last.any()) and ids("A\n b,") == ids(" a b") + ids(",")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, known: dict[str, bytes], words: list[list[str]], before: str) -> list[str]:
        """Encode what isn't known; returns the words to forget after the call."""
        all_ = set().union(*words)
        new = all_.difference(known)
        if len(known) > self.most and 2 * len(new) > len(all_):
            known.clear()
            new = all_
        full = len(known) + len(new) > self.most
        signed = {w: m.groups() for w in new if (m := _SIGNED.fullmatch(w))} if before and self.loose else {}
        todo = list(new.difference(signed).union(*signed.values()).difference(known))
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            for w, ids in self._together(part) if before else ():
                known[w] = ids
            part = [w for w in part if w not in known] if before else part
            for w, e in zip(part, self.tokenizer.encode_batch_fast([before + w for w in part] if before else part, add_special_tokens=False), strict=True):
                known[w] = array("I", e.ids).tobytes()
        for w, (letters, signs) in signed.items():
            known[w] = known[letters] + known[signs]
        return list({*todo, *signed}) if full else []

    def _together(self, words: list[str]) -> list[tuple[str, bytes]]:
        """Words after a blank, many to a text, where the ids show the words' borders: cheaper than one by one."""
        marked = bool(self.last.any())  # the last piece of a run of letters has a mark
        plain = [w for w in words if _LETTERS.fullmatch(w)] if marked else words if self.first.any() else []
        out = self._cut(plain, "", lambda ids: np.flatnonzero(self.last[ids]) + 1 if marked else np.append(np.flatnonzero(self.first[ids])[1:], len(ids)))
        if marked and self.mark is not None:  # the others between special tokens
            rest = [w for w in words if "<" not in w and not _LETTERS.fullmatch(w)]
            out += [(w, ids[:-4]) for w, ids in self._cut(rest, MARK, lambda ids: np.flatnonzero(ids == self.mark) + 1)]
        return out

    def _cut(self, words: list[str], after: str, ends_of) -> list[tuple[str, bytes]]:
        texts = ["".join(f" {w}{after}" for w in words[a : a + 64]) for a in range(0, len(words), 64)]
        if not texts:
            return []
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = ends_of(ids)
        if len(ends) != len(words):
            return []
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [(w, raw[a:b]) for w, a, b in zip(words, at, at[1:], strict=False)]

    def _spaced_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with one blank between words; words are told apart by Arrow, ids gathered by numpy."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        at = np.asarray(split.offsets)
        codes = split.flatten().dictionary_encode()
        words, idx = codes.dictionary.to_pylist(), np.asarray(codes.indices)
        drop = self._learn(self.spaced, [words], " ")
        first = [words[k] for k in idx[at[:-1]].tolist()]
        drop_first = self._learn(self.exact, [first], "")
        ids = [self.spaced[w] for w in words]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(n) - n
        n_word = n[idx]
        n_word[at[:-1]] = 0  # a text's first word has no blank before it
        ends = np.cumsum(n_word)
        every = flat[np.arange(ends[-1]) + np.repeat(starts[idx] - (ends - n_word), n_word)]
        upto = np.concatenate(([0], ends))[at].tolist()
        out = [self.exact[f] + every[a:b].tobytes() for f, a, b in zip(first, upto, upto[1:], strict=False)]
        for known, gone in ((self.spaced, drop), (self.exact, drop_first)):
            for w in gone:
                del known[w]
        return out

    @staticmethod
    def _plainer(text: str) -> str:
        """A text with the same ids for a tokenizer of words: lower case, one blank between words; as it is where that isn't certain."""
        if _OTHER.search(text):
            return text
        text = text.replace("\n", " ").strip(" ")
        while "  " in text:
            text = text.replace("  ", " ")
        return text if "<|" in text or _HIGH.search(text) else text.lower()

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        even, odd = [], []
        if self.loose:
            texts = [self._plainer(t) for t in texts]
        for k, t in enumerate(texts):
            if _OTHER.search(t):
                out[k] = self.whole(t)
            elif "  " in t or " \n" in t or "\n " in t or t[:1] == " " or t[-1:] == " ":
                odd.append(k)
            elif t:
                even.append(k)
        if even:
            for k, x in zip(even, self._spaced_ids([texts[k] for k in even]), strict=True):
                out[k] = x
        if odd:
            cut = [_PIECE.findall(texts[k]) for k in odd]
            drop = self._learn(self.exact, cut, "")
            for k, words in zip(odd, cut, strict=True):
                out[k] = b"".join(map(self.exact.__getitem__, words))
            for w in drop:
                del self.exact[w]
        return out


def encoder(path: str, most: int = 500_000) -> WordEncoder:
    """The worker process's encoder for a file, loaded once."""
    kept = worker_cache("encoder")
    if (path, most) not in kept:
        kept[path, most] = WordEncoder(path, most)
    return kept[path, most]
