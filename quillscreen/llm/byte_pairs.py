"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks every neighbouring pair up by binary search over the sorted pair keys,
takes the lowest rank of each word and merges all its occurrences, left to right. Words that can merge no further leave the array. As a symbol
always ranks above the merges that made its parts (checked when the file is read), merging all occurrences at once equals one merge at a time.

A word of over LONG bytes would need as many rounds as it holds distinct ranks, each over the whole word, so such words are merged rank by rank
through lists of positions instead, with the same lookups and the same result.

Words are cut from the text in windows, and a worker keeps the ids of words it has met, up to a bound, so memory does not follow the length of
a text. Characters newer than the library's Unicode tables are put in its classes by asking its own word splitter, once, on the driver.

Defined cases: a null text encodes like the empty text, to no ids; every row gives one row, repeated or not; an empty table gives no rows; a
null document id stays null; other columns are left out of the report, and columns named like a result are replaced by ``encode`` and ``decode``.
The string of a special token inside a text is that token. Ids that are not in the vocabulary are an error on decoding.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillscreen.llm.common import documents

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = "byte_bpe_50k.json"
#: Characters of a window of one text, and of the windows that are encoded together.
WINDOW, TOGETHER = 1_000_000, 2_000_000
#: A word of more bytes is merged by lists of positions.
LONG = 1024
#: A worker forgets its words beyond so many words or ids.
KNOWN_WORDS, KNOWN_IDS = 400_000, 4_000_000
#: No pair: sorts after all ranks.
NONE = np.int32(2**31 - 1)
#: Word pattern of byte-level BPE (fixed value), with places for the classes of letters and digits.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
ASCII_WORDS = re.compile(WORDS.format(L="[A-Za-z]", N="[0-9]", l="A-Za-z", n="0-9"), re.ASCII)
_compiled: dict[str, Coder] = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def unknown_to(splitter) -> str:
    """Letters and digits of the ``regex`` module that the library's word splitter takes for other characters.

    Only characters that Python's own tables do not know yet are asked; the others agree.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    fresh = (c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    return "".join(c for c in fresh if all(len(splitter.pre_tokenize_str(start + c)) > 1 for start in "a1"))


class Coder:
    """Tables of one byte-level model, and the words that this process has met."""

    def __init__(self, data: bytes, other: str) -> None:
        """``data`` is the model's file; ``other`` the characters that ``unknown_to`` found."""
        spec = json.loads(data)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only byte-level BPE without normaliser, prefix space, word ends, byte fallback and dropout is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in spec["added_tokens"]):
            raise ValueError("added tokens other than plain special ones are not supported")
        letter = byte_letters()
        byte_of = {c: b for b, c in enumerate(letter)}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        shown = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = max(shown) + 1
        parts = [shown.get(i, b"") for i in range(self.size)]
        self.in_vocabulary = np.array([i in shown for i in range(self.size)])
        self.bytes_n = np.array([len(p) for p in parts], np.int64)
        self.bytes_at = np.cumsum(self.bytes_n) - self.bytes_n
        self.bytes_all = np.frombuffer(b"".join(parts), np.uint8)
        self.id_of_byte = np.array([ids[c] for c in letter], np.int64)

        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([ids[t] for t in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        born = np.full(self.size, -1)
        born[made[::-1]] = np.arange(len(pairs))[::-1]
        if len(set(made.tolist())) < len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before those that make its parts, or two merges make one symbol")
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made

        self.rare = frozenset(other)
        if other:
            listed = "[" + "".join(map(regex.escape, other)) + "]"
            classes = {"L": rf"[\p{{L}}--{listed}]", "N": rf"[\p{{N}}--{listed}]", "l": rf"[\p{{L}}--{listed}]", "n": rf"[\p{{N}}--{listed}]"}
            self.rare_words = regex.compile(WORDS.format(**classes), regex.V1)
        self.words = regex.compile(WORDS.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}"))
        self.forget()

    def forget(self) -> None:
        """Drop all words met so far."""
        self.slot = {t: k for k, t in enumerate(self.special)}
        self.flat = np.fromiter(self.special.values(), np.uint32)
        self.lengths = np.ones(len(self.special), np.int64)

    # ---- words

    def split(self, text: str) -> Iterator[list[str]]:
        """The words of a text, special strings among them, in windows."""
        for k, part in enumerate(self.special_at.split(text) if self.special_at else [text]):
            if k % 2:
                yield [part]
            elif part:
                yield from self._windows(part)

    def _windows(self, text: str) -> Iterator[list[str]]:
        words = ASCII_WORDS if text.isascii() else self.words if self.rare.isdisjoint(set(text)) else self.rare_words
        at, width = 0, WINDOW
        while at < len(text):
            found = words.findall(text, at, at + width)
            if at + width >= len(text):
                yield found
                return
            # The end of a window can change its last two words: a cut word, or a quote and the first letter of a cut ending.
            if len(found) > 2:
                at, width = at + width - sum(map(len, found[-2:])), WINDOW
                yield found[:-2]
            else:
                width *= 2

    # ---- merging

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where the two never merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols, word = self.id_of_byte[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), sizes)
        far = sizes[word] > LONG
        done = [self._by_rank(symbols[far], word[far])] if far.any() else []
        done += self._rounds(symbols[~far], word[~far])
        symbols, word = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        return symbols[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merged (symbols, word) parts, in the order in which words came to an end."""
        done = [(symbols[:0], word[:0])]
        if not len(symbols):
            return done
        rank = self._neighbours(symbols, word, np.arange(len(symbols)))
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            if (least == NONE).any():
                going = np.repeat(least < NONE, count)
                done.append((symbols[~going], word[~going]))
                symbols, word, rank = symbols[going], word[going], rank[going]
                least, count = least[least < NONE], count[least < NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, count))
            hit = hit[alternate(np.diff(hit) == 1)]
            symbols[hit] = self.made[rank[hit]]
            gone = np.ones(len(symbols), bool)
            gone[hit + 1] = False
            symbols, word, rank = symbols[gone], word[gone], rank[gone]
            at = hit - np.arange(len(hit))
            touched = np.concatenate((at, at[at > 0] - 1))
            rank[touched] = self._neighbours(symbols, word, touched)
        return done

    def _neighbours(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at the places ``at``, NONE at the end of a word."""
        right = np.minimum(at + 1, len(symbols) - 1)
        return np.where((right > at) & (word[right] == word[at]), self._rank(symbols[at], symbols[right]), NONE)

    def _by_rank(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words: ranks in rising order, each with the list of places where its pair starts."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        rank = self._neighbours(symbols, word, np.arange(n))
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for group in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[group[0]])
                if r not in places:
                    heapq.heappush(heap, r)
                places.setdefault(r, []).append(group)

        note(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            at = at[alternate(after[at[:-1]] == at[1:])]
            second = after[at]
            symbols[at] = self.made[r]
            alive[second], rank[second] = False, NONE
            after[at] = after[second]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            touched = np.concatenate((at, before[at][before[at] >= 0]))
            right = np.minimum(after[touched], n - 1)
            rank[touched] = np.where((after[touched] < n) & (word[right] == word[touched]), self._rank(symbols[touched], symbols[right]), NONE)
            note(np.unique(touched))
        return symbols[alive], word[alive]

    # ---- texts

    def encode_windows(self, texts: Iterable[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(index of the text, ids of one window of it), in order; texts without words give nothing."""
        waiting, chars = [], 0
        for i, text in enumerate(texts):
            for words in self.split(text):
                waiting.append((i, words))
                chars += sum(map(len, words)) if len(words) < 1000 else WINDOW
                if chars >= TOGETHER:
                    yield from self._coded(waiting)
                    waiting, chars = [], 0
            chars += 64
        yield from self._coded(waiting)

    def _coded(self, windows: list[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray]]:
        slot = self.slot
        if len(slot) > KNOWN_WORDS or len(self.flat) > KNOWN_IDS:
            self.forget()
            slot = self.slot
        fresh = list({w for _, words in windows for w in words if w not in slot})
        if fresh:
            ids, lengths = self.merge([w.encode() for w in fresh])
            slot.update(zip(fresh, range(len(slot), len(slot) + len(fresh)), strict=True))
            self.flat, self.lengths = np.concatenate((self.flat, ids)), np.concatenate((self.lengths, lengths))
        starts = np.cumsum(self.lengths) - self.lengths
        for i, words in windows:
            at = np.fromiter(map(slot.__getitem__, words), np.int64, len(words))
            yield i, spread(self.flat, starts[at], self.lengths[at])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for i, ids in self.encode_windows(texts):
            found[i].append(ids)
        return [np.concatenate(f) if f else np.zeros(0, np.uint32) for f in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size or not self.in_vocabulary[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return spread(self.bytes_all, self.bytes_at[ids], self.bytes_n[ids]).tobytes().decode("utf-8", "replace")


def alternate(joined: np.ndarray) -> np.ndarray:
    """Which of some places in order to take when no two joined ones may be: the first, third, ... of each run of joined places."""
    take = np.ones(len(joined) + 1, bool)
    if joined.any():
        place = np.arange(len(take))
        run = np.maximum.accumulate(np.where(np.concatenate(([False], joined)), 0, place))
        take = (place - run) % 2 == 0
    return take


def spread(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + length]``, one after the other."""
    end = np.cumsum(length)
    return flat[np.repeat(start - end + length, length) + np.arange(end[-1] if len(end) else 0)]


def _loader(path: str):
    """Function that gives the tables, compiled once per worker; the file is read, and its splitter asked, on the driver."""
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        data = f.read()
    key, other = hashlib.sha256(data).hexdigest(), unknown_to(Tokenizer.from_str(data.decode()).pre_tokenizer)

    def load() -> Coder:
        if key not in _compiled:
            _compiled[key] = Coder(data, other)
        return _compiled[key]

    return load


def encode(docs: DataFrame, model_path: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text as an array."""
    load = _loader(model_path)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([i.astype(np.int64) for i in load().encode(texts.tolist())], dtype=object)

    return docs.withColumn(to, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``docs`` with the text of each array of ids; null ids give the empty text."""
    load = _loader(model_path)

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: load().decode(()) if x is None else load().decode(x))

    return docs.withColumn(to, text(F.col(ids_col)))


RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Rows whose texts are Python strings at once.
ROWS = 256


def token_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` with the number and digest of each document's ids and the digest of the text they decode to; ids stay in the worker."""
    load, kind = _loader(model_path), docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load()
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = [0] * part.num_rows
                coded, back = ([hashlib.sha256() for _ in n] for _ in range(2))
                # Windows end at whole words, so the bytes of each are whole characters.
                for i, ids in coder.encode_windows(t or "" for t in part.column(1).to_pylist()):
                    n[i] += len(ids)
                    coded[i].update(ids.astype("<u4").tobytes())
                    back[i].update(coder.decode(ids).encode())
                columns = [part.column(0), pa.array(n, pa.int64()), *(pa.array([h.hexdigest() for h in hs]) for hs in (coded, back))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, {RESULT}")


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of all documents with byte_bpe_50k.json."""
    import public_tokenizers

    return token_report(documents(spark, sf_dir), public_tokenizers.path(MODEL))
