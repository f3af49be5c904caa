"""Token ids of whole texts with a public tokenizer file.

The tokenizer drops white space and treats what stands between two runs of it by itself, so a text's ids are
the ids of its chunks, joined. It also parts a letter or digit from the marks behind it and lowers letters, so a
chunk's ids are those of its lowered core and of its closing marks. Each Python worker keeps the ids of the cores
and marks that it has met, up to a bound; new ones of a batch are encoded by the library in one call. Arrow splits
the texts and finds the distinct chunks of a batch, numpy puts the kept ids together.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2  # Fixed value: appended to each document
CACHED = 500_000  # cores and marks that one worker keeps, about 125 MB
BYTES = 8 << 20  # of texts that are encoded together; a longer text is alone
CLOSING = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # marks that end a chunk
# Letters (composed, without the dotted capital I) whose lower case is one letter, wherever they stand.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
MARK = "\x01"  # stands between chunks in one call; texts that hold it are encoded whole

_loaded: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.chunked = bool(suffix) and not spec["model"].get("dropout")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if self.chunked:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.mark = self._ids(MARK)
            self.chunked = len(self.mark) == 1
            self.tokenizer.model._resize_cache(0)  # the chunks kept here serve instead
        self.kept = pa.array([""])  # the ids of kept[i] lie in pool from starts[i] on
        self.pool, self.starts, self.sizes, self.uses = (np.zeros(1 << 10, t) for t in (self.dtype, np.int64, np.int64, np.int64))
        self.used = 0
        # What the file's own steps do decides whether letters are lowered and closing marks parted here.
        letters = "".join(c for c in map(chr, range(0x250)) if re.match(f"[{LETTERS}]", c))
        small, normal, pre = "".join(sorted(set(letters.lower()))), self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lowers = normal is not None and normal.normalize_str(letters) == letters.lower()
        cut = pre.pre_tokenize_str if pre is not None else lambda t: [(t, None)]
        self.closing = CLOSING if all(len(cut(c + m)) == 2 for c in "0" + small for m in CLOSING) else ""
        # Words of small letters alone need none of these steps but their letters' signs in the vocabulary.
        self.signs = {ord(c): "".join(piece for piece, _ in cut(c)) for c in small}
        self.bare = None
        if self.lowers and [piece for piece, _ in cut(small)] == [small.translate(self.signs)]:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
            if self.chunked:
                self.bare.model._resize_cache(0)
        self.small = re.compile(f"[{small}]+")

    def _forget(self) -> None:
        """Keep what most batches have used, at most half of what may be kept."""
        n = len(self.kept)
        self.uses[0] = self.uses[:n].max() + 1
        often = np.argsort(-self.uses[:n], kind="stable")[:CACHED // 2]
        often = np.sort(often[self.uses[often] > 1])
        ids, sizes, uses = self.pool[_places(self.starts[often], self.sizes[often])], self.sizes[often], self.uses[often]
        self.kept = self.kept.take(pa.array(often))
        self.pool, self.used = ids, len(ids)
        self.starts, self.sizes, self.uses = np.cumsum(sizes) - sizes, sizes, uses // 2

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def _learn(self, chunks: list[str]) -> None:
        small, plain, other = [], [], []
        for c in chunks:
            (other if not c.isalpha() else small if self.bare and self.small.fullmatch(c) else plain).append(c)
        if small:
            signs = [c if c.isascii() else c.translate(self.signs) for c in small]
            joined = [" ".join(signs[i:i + 1000]) for i in range(0, len(signs), 1000)]
            ids = [i for x in self.bare.encode_batch_fast(joined, add_special_tokens=False) for i in x.ids]
            ids = np.asarray(ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(small):
                self._keep(small, ids, np.concatenate(([0], cuts[:-1])), cuts)
            else:
                plain += small
        if plain:
            ids = self._ids(" ".join(plain))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                self._keep(plain, ids, np.concatenate(([0], cuts[:-1])), cuts)
            else:
                other += plain
        if other:
            ids = self._ids(f" {MARK} ".join(other))
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(other) - 1:
                self._keep(other, ids, np.concatenate(([0], marks + 1)), np.concatenate((marks, [len(ids)])))
            else:
                found = [self._ids(c) for c in other]
                stops = np.cumsum([len(x) for x in found])
                self._keep(other, np.concatenate(found), np.concatenate(([0], stops[:-1])), stops)

    def _keep(self, chunks: list[str], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        first = len(self.kept)
        self.kept = pa.concat_arrays((self.kept, pa.array(chunks, pa.string())))
        last = len(self.kept)
        self.pool = _room(self.pool, self.used + len(ids))
        self.starts, self.sizes, self.uses = (_room(x, last) for x in (self.starts, self.sizes, self.uses))
        self.pool[self.used:self.used + len(ids)] = ids
        self.starts[first:last], self.sizes[first:last], self.uses[first:last] = self.used + starts, stops - starts, 0
        self.used += len(ids)

    def _slots(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slots of each chunk's core and of its closing marks; what is new is learnt."""
        core = pc.ascii_rtrim(chunks, characters=self.closing)
        core = pc.if_else(pc.match_substring_regex(core, f"[0-9{LETTERS}]$"), core, chunks)
        closed = pc.not_equal(pc.binary_length(core), pc.binary_length(chunks))
        marks = pc.replace_substring_regex(chunks.filter(closed), f"(?s)^.*[0-9{LETTERS}]", "")
        if self.lowers:
            core = pc.if_else(pc.match_substring_regex(core, f"^[{LETTERS}]+$"), pc.utf8_lower(core), core)
        keys, first = pa.concat_arrays((core, marks)), len(self.kept)
        found = pc.index_in(keys, value_set=self.kept)
        if found.null_count:
            new = keys.filter(pc.is_null(found))
            self._learn(new.unique().to_pylist())
            found = pc.replace_with_mask(found, pc.is_null(found), pc.add(
                pc.index_in(new, value_set=self.kept.slice(first)), pa.scalar(first, pa.int32())))
        slots, behind = found.to_numpy(), np.zeros(len(core), np.int64)
        behind[closed.to_numpy(zero_copy_only=False)] = slots[len(core):]
        return slots[:len(core)], behind

    def encode(self, texts: Iterable[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, END_ID appended; a null text counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        end = self.dtype.type(END_ID)
        if not self.chunked:
            return [np.append(self._ids(t), end) for t in texts.to_pylist()]
        whole = pc.match_substring(texts, MARK)
        for a in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, a))
        if len(self.kept) > CACHED:
            self._forget()
        lists = pc.ascii_split_whitespace(pc.if_else(whole, "", texts))
        chunks = lists.flatten().dictionary_encode()
        core, behind = self._slots(chunks.dictionary)
        # The batch's distinct chunks, core and marks joined, and the end id behind them.
        both = np.stack((core, behind), axis=1).ravel()
        self.uses[both] += 1
        sizes = self.sizes[both]
        pool = np.append(self.pool[_places(self.starts[both], sizes)], end)
        sizes = np.append(sizes.reshape(-1, 2).sum(axis=1), 1)
        starts = np.cumsum(sizes) - sizes
        stops = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        at = np.insert(chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64), stops, len(sizes) - 1)
        ids = pool[_places(starts[at], sizes[at])]
        ends = np.cumsum(sizes[at])[stops + np.arange(len(stops))].tolist()
        out = [ids[i:j] for i, j in zip([0, *ends], ends)]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.append(self._ids(texts[k].as_py()), end)
        return out


def _room(kept: np.ndarray, n: int) -> np.ndarray:
    """The array with place for n items, doubled if it is full."""
    if n <= len(kept):
        return kept
    return np.concatenate((kept, np.zeros(max(n, 2 * len(kept)) - len(kept), kept.dtype)))


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one span after the other."""
    stops = np.cumsum(sizes)
    return np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - stops + sizes, sizes)


def encoded_rows(enc: Encoder, batches: Iterable, key: int = 0, text: int = 1) -> Iterator[tuple]:
    """(key, ids) of the rows of Arrow batches; rows are encoded by the BYTES, so that chunks share their lookup."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BYTES, side="right")))
            some = b.slice(at, stop - at)
            yield from zip(some.column(key).to_pylist(), enc.encode(some.column(text)))
            at = stop
