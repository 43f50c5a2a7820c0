"""Ids of texts by the tokenizers library, with a memory of the chunks between white space."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from granary.llm.shingles import mix, span_hashes, word_spans

#: Characters whose normal form, case and class are the same for Python and the library; texts with others go to the
#: library whole. Characters below U+0250 but dotted capital I, raised digits and fractions; white space; general punctuation.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ‐-‧‰-⁞€]*")
#: The file's own split into words, within a chunk.
_WORDS = re.compile(r"""'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+""")


#: The steps of a file for which the way through chunks is right.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


#: A second set of letters for hashes, so that two words are taken for one only if 128 bits agree.
_SECOND = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


class WordTokenizer:
    """Encodes whole texts as the library would with ``add_special_tokens=False``.

    A file whose normalizer, pre-tokenizer and end-of-word suffix are the ones above splits texts into words, so the ids of
    a lower-cased chunk between white space never depend on its neighbours. Chunks are found and hashed in NumPy; the
    library's model encodes each distinct chunk once, and texts are put together from the remembered ids. If these take
    more than ``most`` bytes, those of the latest texts stay. The library encodes whole what this does not hold for: texts
    with characters beyond ``_PLAIN`` or with the string of an added token, and all texts if the file has other steps.
    """

    def __init__(self, path: str, most: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        vocabulary = self.library.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        file = json.loads(self.library.to_str())
        self.chunked = file["normalizer"] == _NORMALIZER and file["pre_tokenizer"] == _PRE_TOKENIZER and file["model"].get("end_of_word_suffix") == "</w>"
        added = [t["content"] for t in file["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        if self.chunked:  # the file's model alone, for words that are split and normal already
            parts = file | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
            self.model = Tokenizer.from_str(json.dumps(parts))
            letters = _byte_letters()
            self.letters = {b: letters[b] for b in range(256) if b != 32}
        self._forget()

    def _forget(self) -> None:
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # hashes of chunks, sorted by the first
        self.start, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where their ids are
        self.ids = np.zeros(0, np.uint32)

    def _model_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after the other, and how many each has."""
        ids, many = [], []
        for first in range(0, len(chunks), 16_000):
            words = list(map(_WORDS.findall, chunks[first : first + 16_000]))
            counts = np.array(list(map(len, words)))
            flat = list(chain.from_iterable(words))
            texts = [" ".join(flat[i : i + 2000]).encode().decode("latin-1").translate(self.letters) for i in range(0, len(flat), 2000)]
            found = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) != len(flat):
                raise ValueError("a word does not end with an end-of-word token")
            ids.append(found)
            many.append(np.diff(np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]))
        return np.concatenate(ids), np.concatenate(many)

    def _plain(self, raw: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of consecutive lower-cased texts and how many each has; None if two chunks share a hash."""
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(sizes), np.int64)
        start, stop, words = word_spans(data, sizes)
        one, two = span_hashes(data, start, stop), span_hashes(data, start, stop, _SECOND)
        first, sample, entry = np.unique(one, return_index=True, return_inverse=True)
        second = two[sample]
        at = np.searchsorted(self.first, first)
        known = np.zeros(len(first), bool)
        inside = at < len(self.first)
        known[inside] = self.first[at[inside]] == first[inside]
        if (second[entry] != two).any() or (self.second[at[known]] != second[known]).any():
            return None
        if not known.all():
            fresh = np.flatnonzero(~known)
            spans = zip(start[sample[fresh]].tolist(), stop[sample[fresh]].tolist())
            ids, many = self._model_ids([raw[a:b].decode() for a, b in spans])
            self.start = np.insert(self.start, at[fresh], len(self.ids) + np.cumsum(many) - many)
            self.many = np.insert(self.many, at[fresh], many)
            self.first = np.insert(self.first, at[fresh], first[fresh])
            self.second = np.insert(self.second, at[fresh], second[fresh])
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.first, first)
        many = self.many[at][entry]
        total = np.concatenate([[0], np.cumsum(many)])
        out = self.ids[np.repeat(self.start[at][entry] - total[:-1], many) + np.arange(total[-1])]
        if 32 * len(self.first) + 4 * len(self.ids) > self.most:
            keep = np.zeros(len(self.first), bool)
            keep[at] = True
            many = self.many[keep]
            cut = np.cumsum(many)
            self.ids = self.ids[np.repeat(self.start[keep] - (cut - many), many) + np.arange(int(many.sum()))]
            self.first, self.second, self.start, self.many = self.first[keep], self.second[keep], cut - many, many
        return out, np.diff(total[np.concatenate([[0], np.cumsum(words)])])

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (null: empty), one after the other, each with ``end`` after it, and how many each has."""
        texts = [t or "" for t in texts]
        plain = np.array([self.chunked and _PLAIN.fullmatch(t) is not None and not (self.added and self.added.search(t)) for t in texts], bool)
        raw = [t.lower().encode() for t, ok in zip(texts, plain) if ok]
        got = self._plain(b"".join(raw), np.array([len(r) for r in raw], np.int64)) if raw else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if got is None:
            self._forget()
            plain[:], got = False, (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        tail = np.array([] if end is None else [end], np.uint32)
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = got[1]
        others = {}
        for k in np.flatnonzero(~plain):
            others[k] = np.asarray(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            sizes[k] = len(others[k])
        stop = np.cumsum(sizes + len(tail))
        ids = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint32)
        begin = stop - sizes - len(tail)
        if plain.all():
            place = np.ones(len(ids), bool)
            if len(tail):
                place[stop - 1] = False
            ids[place] = got[0]
        else:
            cuts = np.concatenate([[0], np.cumsum(got[1])])
            for n, k in enumerate(np.flatnonzero(plain)):
                ids[begin[k] : begin[k] + sizes[k]] = got[0][cuts[n] : cuts[n + 1]]
            for k, found in others.items():
                ids[begin[k] : begin[k] + sizes[k]] = found
        if len(tail):
            ids[stop - 1] = tail[0]
        return ids, sizes + len(tail)


_loaded: dict[tuple[str, int], WordTokenizer] = {}


def word_tokenizer(path: str, most: int = 48 << 20) -> WordTokenizer:
    """One per worker process, file and bytes of memory."""
    if (path, most) not in _loaded:
        _loaded[path, most] = WordTokenizer(path, most)
    return _loaded[path, most]
