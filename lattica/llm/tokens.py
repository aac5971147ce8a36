"""Token ids of whole texts, with the tokenizers library and, where that is sure, a cache of words.

Any file of the library gives the library's ids. For files whose normaliser, pre-tokenizer and
model are those in ``CACHEABLE``, characters on two sides of a blank are never joined, so a
text's ids are those of its blank-separated words in a row: words are numbered by Arrow, each
distinct one is looked up once for a group of texts, and a text is a gather over the cached ids. The
settings are compared when a file is loaded, and ``PROBES`` are then encoded both ways; any
difference leaves the file to the library. Beyond ``CACHE_WORDS`` words those go that were used
least. Nothing is left out: words that aren't in the cache are encoded, however many there are.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 300_000
#: Bytes that are encoded at a time; longer texts are cut at blanks. Stems that the library gets at once.
CHUNK, STEMS = 1 << 20, 8192
#: Of a line: letters that are their own NFC form, and which lower case maps one to one, then marks that pre-tokenization keeps together; or any other word.
_WORD = re.compile("^(?:([A-Za-zÀ-ÖØ-öø-ÿ]{0,64})([.,;:!?#$%&*|+=(){}/-]{0,16})|(.*))$", re.MULTILINE)
_CUT = re.compile("[ \n]")
#: Settings under which words can be encoded by themselves: fixed values, as a tokenizer file has them.
CACHEABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: The same of its model, which must be a BPE.
CACHEABLE_MODEL = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Texts that are encoded both ways when a file is loaded.
PROBES = ["Hello, world.\nnext  line", " a b  c\t\td ", "Äpfel ÀÖØöøÿ ß é", "it's don't WE'LL", "x.y, z... (q)", "12 3a b4", "日本 語", "e\u0301 İ Σς", "<|endoftext|> x", "word" * 20]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker process and file, so its cache outlives a task."""
    return WordEncoder(path)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = self.tokenizer.model
        # settings by themselves: a file as a whole has the vocabulary in it, which would be held twice
        parts = {name: getattr(self.tokenizer, name) for name in CACHEABLE}
        state = {name: json.loads(part.__getstate__()) if name in ("normalizer", "pre_tokenizer") and part is not None else part for name, part in parts.items()}
        known = state == CACHEABLE and type(model).__name__ == "BPE" and all(getattr(model, k) == v for k, v in CACHEABLE_MODEL.items())
        # words are separate only if no added token has a blank in it or takes blanks beside it
        added = self.tokenizer.get_added_tokens_decoder().values()
        apart = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or any(c.isspace() for c in t.content) for t in added)
        self.cached = known and apart
        if not self.cached:
            return
        # the same model over lines of lower-case letters: nothing to normalise, one word a line
        self.stemmer = Tokenizer(model)
        self.stemmer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(CACHEABLE_MODEL["end_of_word_suffix"])]] = True
        self.place: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.begin, self.size, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.cached = [i.tolist() for i in self._split(pa.array(PROBES))] == [self._ids(t) for t in PROBES]

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places, in a row, and how many there are up to the end of each."""
        sizes = self.size[at]
        upto = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[at] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)], upto

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Words that aren't there, with their ids in a row."""
        n, m = len(self.place), len(self.place) + len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while m > len(self.begin):
            self.begin, self.size, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.uses))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n:m] = self.used + np.cumsum(sizes) - sizes
        self.size[n:m] = sizes
        self.uses[n:m] = 0
        self.used += len(ids)
        self.place.update(zip(words, range(n, m)))

    def _trim(self) -> None:
        """Keep those of the words that were used most: half of CACHE_WORDS, and none that was used once."""
        uses = self.uses[: len(self.place)]
        kept = np.argsort(-uses, kind="stable")[: CACHE_WORDS // 2]
        kept = np.sort(kept[uses[kept] > 1])
        words = list(self.place)
        ids, sizes, uses = self._gather(kept)[0], self.size[kept], uses[kept] // 2
        self.place, self.used = {}, 0
        self._add([words[i] for i in kept.tolist()], ids, sizes)
        self.uses[: len(kept)] = uses

    def _stems(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words in a row, and how many each has."""
        found = [np.array(self.stemmer.encode_batch_fast(["\n".join(stems[i : i + STEMS])], add_special_tokens=False)[0].ids, np.uint32) for i in range(0, len(stems), STEMS)]
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) == len(stems):  # each word ends in one such token
            return ids, np.diff(ends, prepend=-1)
        return self._apart(stems)

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self._ids(w) for w in words]
        return np.array([i for g in got for i in g], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, words: list[str]) -> None:
        """Take in stems, marks and odd words, then the words made of a stem and a mark."""
        found = _WORD.findall("\n".join(words))
        stems = "\n".join([stem for stem, _, _ in found]).lower().split("\n")
        fresh = [w for w in dict.fromkeys(stems) if w and w not in self.place]
        self._add(fresh, *self._stems(fresh))
        fresh = [w for w in dict.fromkeys([odd or mark for _, mark, odd in found]) if w not in self.place]
        self._add(fresh, *self._apart(fresh))
        made = [i for i, w in enumerate(words) if w not in self.place]
        at = np.empty((len(made), 2), np.int64)
        at[:, 0] = [self.place[stems[i]] for i in made]
        at[:, 1] = [self.place[found[i][1]] for i in made]
        np.add.at(self.uses, at, 1)
        ids, upto = self._gather(at.ravel())
        self._add([words[i] for i in made], ids, np.diff(upto[1::2], prepend=0))

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        # as one string, which is split: no Arrow scalar for each word
        words = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), "\n")[0].as_py().split("\n")
        index = coded.indices.to_numpy()
        if len(self.place) > CACHE_WORDS:
            self._trim()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if (gaps := np.flatnonzero(at < 0)).size:
            lost = [words[i] for i in gaps.tolist()]
            self._learn(lost)
            at[gaps] = np.fromiter(map(self.place.__getitem__, lost), np.int64, len(lost))
        self.uses[at] += np.bincount(index, minlength=len(words))
        ids, upto = self._gather(at[index])
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        return ids, np.diff(upto[ends - 1], prepend=0)

    def encode(self, texts: Sequence[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is empty."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.cached:
            yield from (np.array(self._ids(t.as_py() or ""), np.uint32) for t in texts)
            return
        first = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy().tolist()):
            if held + n > CHUNK:
                yield from self._split(texts[first:i])
                first, held = i, 0
            if n > CHUNK:
                yield self._long(texts[i].as_py())
                first, n = i + 1, 0
            held += n
        yield from self._split(texts[first:])

    def _split(self, group: pa.Array) -> Iterator[np.ndarray]:
        if len(group):
            ids, sizes = self._part(pc.fill_null(group, ""))
            yield from np.split(ids, np.cumsum(sizes)[:-1])

    def _long(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + CHUNK)
            end = cut.start() + 1 if cut else len(text)
            parts.append(self._part(pa.array([text[at:end]]))[0])
            at = end
        return np.concatenate(parts)
