"""Token counts by prefix dynamic programming.

A word of a byte-pair vocabulary with word ends is counted prefix by prefix. The encoding of a prefix
ends in exactly one token; without it, the rest is again the encoding of a shorter prefix. So the last
token of each prefix follows from earlier prefixes: it is the one suffix that is a token and that keeps
apart from the last token before it. Two counts are kept per prefix: the word goes on, or it ends there.
Counts of words add up to the count at every word end of a text, and the counts inside a word give
every place between. Truncation and budgets are read from these tables; nothing is encoded again.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from sitefacts.llm.common import TwoGenerations

VOCABULARY = "word_bpe_49k.json"
#: Words kept in each worker's cache; longer words are counted on their own and not kept.
CACHED, LONG = 300_000, 256
#: How the vocabulary file splits normalised text (fixed value, checked against the file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Python splits at these, the vocabulary's white space does not include them.
_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies, by their published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class PrefixCounter:
    """Exact token counts at every prefix, for vocabularies of the kind of ``VOCABULARY``."""

    def __init__(self, path: str, cached: int = CACHED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != SPLIT or model["ignore_merges"]:
            raise ValueError(f"{path}: only vocabularies that split by {SPLIT} are counted")
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        #: Each token to itself, so that tables hold one string per token.
        self.tokens = {t: t for t in model["vocab"]}
        self.longest = max(map(len, self.tokens))
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        self.split = regex.compile(SPLIT)
        self.letters = byte_letters()
        self.apart: dict[tuple[str, str], bool] = {}
        self.words = TwoGenerations(self._count_word, cached)
        self.chunks = TwoGenerations(self._count_chunk, cached)
        self.states = {"": ("", 0)}

    # --- one word ---------------------------------------------------------------------

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain merging by rank, for single tokens and pairs of them."""
        rank = self.rank
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                r = rank.get((symbols[k], symbols[k + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _stays(self, pair: tuple[str, str]) -> bool:
        """Whether merging leaves the second token whole and apart from the one before it, if any."""
        before, token = pair
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        expected = [before, token] if before else [token]
        stays = self._merged(list(before) + self._symbols(token)) == expected
        self.apart[pair] = stays
        return stays

    def _last(self, word: str, end: str, states: dict[str, tuple[str, int]]) -> tuple[str, int]:
        """Last token and count of ``word``, given all of its proper prefixes; ``end`` if it ends there."""
        tokens, apart = self.tokens, self.apart
        size = len(word)
        for start in range(size - self.longest if size > self.longest else 0, size):
            token = word[start:] + end
            if token in tokens:
                before, count = states[word[:start]]
                pair = (before, token)
                stays = apart.get(pair)
                if stays or stays is None and self._stays(pair):
                    return token, count + 1
        raise ValueError(f"no token ends {word!r}")

    def _count_spelled(self, word: str) -> int:
        """Fill in the states of proper prefixes from the longest known one on, then end the word."""
        states = self.states
        if len(states) > 3 * self.words.size:
            states = self.states = {"": ("", 0)}
        known = len(word) - 1
        while word[:known] not in states:
            known -= 1
        for size in range(known + 1, len(word)):
            prefix = word[:size]
            states[prefix] = self._last(prefix, "", states)
        return self._last(word, self.end, states)[1]

    def _count_long(self, word: str) -> int:
        """The same over offsets of one long word: the last token and the count at each, and no prefixes."""
        tokens, apart, longest = self.tokens, self.apart, self.longest
        lasts, counts = [""], array("q", [0])
        for size in range(1, len(word) + 1):
            end = self.end if size == len(word) else ""
            for start in range(max(0, size - longest), size):
                token = tokens.get(word[start:size] + end)
                if token is not None:
                    pair = (lasts[start], token)
                    stays = apart.get(pair)
                    if stays or stays is None and self._stays(pair):
                        lasts.append(token)
                        counts.append(counts[start] + 1)
                        break
            else:
                raise ValueError(f"no token ends a word of {len(word)} letters at {size}")
        return counts[-1]

    def _letters(self, word: str) -> str:
        return "".join(self.letters[b] for b in word.encode("utf-8"))

    def _count_word(self, word: str) -> int:
        spelled = word if word.isascii() and word.isprintable() else self._letters(word)
        return self._count_long(spelled) if len(spelled) > LONG else self._count_spelled(spelled)

    def word_prefixes(self, word: str) -> list[int]:
        """Tokens of each prefix of ``word`` that ends between characters, as if the text ended there."""
        return [self.words[word[:k]] for k in range(1, len(word) + 1)]

    # --- texts ------------------------------------------------------------------------

    def _pieces(self, chunk: str) -> list[str]:
        """Words of one stretch without white space or special strings."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            # letter by letter, as the vocabulary's lower-casing does it: no final sigma
            chunk = "".join(c.lower() for c in chunk)
        else:
            chunk = chunk.lower()
        return self.split.findall(chunk)

    def _count_chunk(self, chunk: str) -> int:
        if len(chunk) > LONG:
            return sum(self._count_word(w) if len(w) > LONG else self.words[w] for w in self._pieces(chunk))
        return sum(map(self.words.__getitem__, self._pieces(chunk)))

    def _count_chunks(self, chunks: list[str]) -> list[int]:
        known = self.chunks
        return [known[c] if len(c) <= LONG else self._count_chunk(c) for c in chunks]

    def _plain(self, text: str) -> list[str]:
        if _SEPARATORS.search(text):
            return regex.split(r"\s+", text)
        return text.split()

    def chunk_counts(self, text: str) -> np.ndarray:
        """Tokens of each stretch of a text between white space, special strings apart, in order."""
        if not any(s in text for s in self.special):
            return np.array(self._count_chunks(self._plain(text)), np.int64)
        counts, at = [], 0
        for hit in self.specials.finditer(text):
            counts += [*self._count_chunks(self._plain(text[at : hit.start()])), 1]
            at = hit.end()
        return np.array([*counts, *self._count_chunks(self._plain(text[at:]))], np.int64)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact count after each stretch; entry 0 is the empty prefix."""
        return np.concatenate([[0], np.cumsum(self.chunk_counts(text))])

    def fitting_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens, among prefixes up to the first that needs more.

        Whole stretches are found in the table of prefix counts, the last characters in that of the
        stretch they lie in. Texts with special strings are cut at stretches only.
        """
        table = self.prefix_counts(text)
        whole = int(np.searchsorted(table, budget, side="right")) - 1
        spans = [m.span() for m in regex.finditer(self._stretches(text), text)]
        if whole >= len(spans):
            return len(text)
        start, end = spans[whole]
        if self.specials.search(text):
            return start
        left = budget - int(table[whole])
        for size in range(1, end - start + 1):
            if self._count_chunk(text[start : start + size]) > left:
                return start + size - 1
        return end

    def _stretches(self, text: str) -> str:
        return "|".join(map(regex.escape, self.special)) + r"|(?:(?!" + "|".join(map(regex.escape, self.special)) + r")\S)+"


@lru_cache(maxsize=2)
def counter(name: str = VOCABULARY) -> PrefixCounter:
    return PrefixCounter(public_tokenizers.path(name))


def count_tokens(
    docs: DataFrame, limit: int = 2048, vocabulary: str = VOCABULARY, with_prefixes: bool = False
) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit[, prefixes].

    Null and empty texts have no bytes and no tokens. Repeated rows are counted each; a null doc_id is
    kept; further columns of ``docs`` are not read. ``prefixes`` holds the exact count after each
    stretch between white space. A map over the scan without any shuffle.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    schema += ", prefixes array<long>" if with_prefixes else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(vocabulary)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            counts = [own.chunk_counts(t) for t in texts]
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": [len(t.encode()) for t in texts]})
            out["n_tokens"] = [int(c.sum()) for c in counts]
            out["over_limit"] = out["n_tokens"] > limit
            if with_prefixes:
                out["prefixes"] = [np.concatenate([[0], np.cumsum(c)]).tolist() for c in counts]
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, schema)
