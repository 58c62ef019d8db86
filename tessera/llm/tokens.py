"""Token ids of whole texts by a public tokenizer file, for packing and token files.

A tokenizer whose rules drop white space and join nothing across it gives a text the ids of its chunks
between ASCII white space, one chunk after the other. So each distinct chunk goes through the library
once, and a text is a join over a bounded cache. `chunks_are_independent` proves the precondition from
the tokenizer's own definition; any other tokenizer encodes whole texts. Special strings count as the library's
plain call counts them: one id each, in the case that they are written in.
"""

from __future__ import annotations

import json

import numpy as np

from .common import claim, give_back

#: Entries that one worker's cache holds before it starts anew (about 200 bytes each), unless a caller asks for others.
CACHE_ENTRIES = 1_000_000

_BY_FILE: dict[str, "WordIds"] = {}


def _steps(definition: dict) -> list[dict]:
    own = definition.get("normalizer") or {}
    return own.get("normalizers", [own] if own else [])


def chunks_are_independent(definition: dict) -> bool:
    """True if normaliser, splitter and special strings act on each chunk between white space by itself and drop the space."""
    if not all(s.get("type") in ("NFC", "Lowercase") or s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in _steps(definition)):
        return False
    splits = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = splits[0] if splits else {}
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and first.get("pattern", {}).get("Regex", "").endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
    rest = all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in splits[1:])
    plain = not any(t[k] for t in definition.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    unbroken = not any(t["content"].split() != [t["content"]] for t in definition.get("added_tokens", []))
    return bool(drops and rest and plain and unbroken and definition.get("post_processor") is None)


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit integers; `known` maps chunks, lower-cased if the tokenizer does so, to theirs."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.entries = CACHE_ENTRIES
        self.library = Tokenizer.from_file(file)
        self.library.no_truncation()
        definition = json.loads(self.library.to_str())
        self.by_chunk = chunks_are_independent(definition)
        self.lowers = any(s.get("type") == "Lowercase" for s in _steps(definition))
        special = [t["content"] for t in definition.get("added_tokens", [])]
        self.folded = [bytes(s, "utf-8").lower().decode("utf-8") if self.lowers else s for s in special]
        self.known: dict[str, bytes] = {}
        self.as_written: dict[str, bytes] = {}  # chunks that hold a special string, in some case
        mark = definition["model"].get("end_of_word_suffix")
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if mark:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True

    def encode_all(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, new: list[str]) -> None:
        """Adds chunks. Words of letters alone go through the library many at a time, told apart by the tokens that end a word."""
        known = self.known
        words = [c for c in new if c.isalpha()]
        rest = [c for c in new if not c.isalpha()]
        marked = [c for c in rest if c[-1:] in (".", ",") and c[:-1].isalpha()]  # a word and a mark, which the splitter parts
        words += list({c[:-1] for c in marked}.difference(known).difference(words))
        others = list(set(rest).difference(marked)) + [m for m in (".", ",") if m not in known]
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, first = ids.tobytes(), 0
                for chunk, stop in zip(some, (4 * stops).tolist()):
                    known[chunk] = raw[first:stop]
                    first = stop
            else:  # some word isn't one unit to the library
                others += some
        for at in range(0, len(others), 2048):
            some = others[at : at + 2048]
            known.update(zip(some, self.encode_all(some)))
        for chunk in marked:
            known[chunk] = known[chunk[:-1]] + known[chunk[-1]]

    def _with_special(self, text: str) -> bytes:
        """The ids of a text that may hold special strings: chunks that do are looked up as they are written, the others as in encode()."""
        own = []
        for raw in text.encode("utf-8").split():
            low = (raw.lower() if self.lowers else raw).decode("utf-8")
            if any(f in low for f in self.folded):
                chunk = raw.decode("utf-8")
                if chunk not in self.as_written:
                    if len(self.as_written) > self.entries // 10:
                        self.as_written.clear()
                    self.as_written[chunk] = self.encode_all([chunk])[0]
                own.append(self.as_written[chunk])
            else:
                if low not in self.known:
                    self.learn([low])
                own.append(self.known[low])
        return b"".join(own)

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow array without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.by_chunk:
            return [self.encode_all([t])[0] for t in texts.to_pylist()]
        if len(self.known) > self.entries:
            self.known.clear()
        lower = pc.ascii_lower(texts) if self.lowers else texts
        found = self._encode_plain(lower)
        if found is None:  # some chunk holds a special string
            holds = _any_of(lower, self.folded)
            others = [k for k, hit in enumerate(holds) if not hit]
            plain = dict(zip(others, self._encode_plain(lower.take(pa.array(others, pa.int64())))))
            found = [plain[k] if k in plain else self._with_special(texts[k].as_py()) for k in range(len(texts))]
        return found

    def _encode_plain(self, lower) -> list[bytes] | None:
        """The ids of texts without special strings; None if there is one. No known chunk holds any, so only new ones are looked at."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        new = [c for c in chunks if c not in self.known]
        if new:
            joined = " ".join(new)
            if any(f in joined for f in self.folded):
                return None
            self.learn(new)
        packed = list(map(self.known.__getitem__, chunks))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(packed), "<u4")))
        raw = memoryview(lists.take(coded.indices).flatten().to_numpy(zero_copy_only=False)).cast("B")
        ends = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])])
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        at = (4 * ends[first]).tolist()
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]

    def encode_batch(self, texts, most_bytes: int | None = None):
        """Ids of the texts of an Arrow array, a piece at a time: 8 bytes of text for each entry of the cache, so that both follow one bound."""
        import pyarrow.compute as pc

        most_bytes = most_bytes or 8 * self.entries
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0, np.int64)
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield from self.encode(texts.slice(at, to - at))
            at = to


def _any_of(texts, strings: list[str]) -> list[bool]:
    import pyarrow.compute as pc

    found = None
    for s in strings:
        hit = pc.match_substring(texts, s)
        found = hit if found is None else pc.or_(found, hit)
    return found.to_pylist() if found is not None else [False] * len(texts)


def word_ids(file: str, entries: int = CACHE_ENTRIES) -> WordIds:
    """This worker's tokenizer for a file, with a cache of so many entries; what it has learnt lasts as long as the worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if file not in _BY_FILE:
        _BY_FILE[file] = WordIds(file)
        give_back()
    own = _BY_FILE[file]
    own.entries = entries
    claim(own.known)
    return own
