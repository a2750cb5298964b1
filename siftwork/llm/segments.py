"""Texts cut where tokenizers always end a token, so that what is worked out for a segment can be remembered.

Texts are cut before each space that follows something else than white space. A byte-level pre-tokenizer by words never
joins two such segments, and reads each as it does within the text; neither does a piece vocabulary in which nothing but a
space stands before a space.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

#: White space as Unicode has it; Python's \s has four characters more.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNEVEN = re.compile(f"[{BLANK}] ").search
_SEGMENT = re.compile(f"(?:^ ?|(?<=[^{BLANK}]) )[^ ]*(?:(?<=[{BLANK}]) [^ ]*)*")


def spaced(text: str) -> tuple[str, list[str]]:
    """The first segment of a text, and the others without the space that each begins with."""
    if not _UNEVEN(text):
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _SEGMENT.findall(text)
    return first, [s[1:] for s in rest]


class Remembered:
    """What work gives for keys, in two generations of about bound each: what is asked for again goes over to the next one."""

    def __init__(self, work: Callable[[list[str]], Iterator], bound: int = 250_000):
        self.work, self.bound, self.now, self.before = work, bound, {}, {}

    def of(self, split: list[list[str]]) -> list[list]:
        """For each list of keys, what was worked out for them; the lists share one call of work."""
        if len(self.now) > self.bound:
            self.now, self.before = {}, self.now
        new = set(chain.from_iterable(split)).difference(self.now)
        if old := list(filter(self.before.__contains__, new)):
            self.now.update(zip(old, map(self.before.__getitem__, old)))
            new.difference_update(old)
        if new:
            asked = list(new)
            self.now.update(zip(asked, self.work(asked)))
        return [list(map(self.now.__getitem__, s)) for s in split]


def byte_level(tokenizer) -> bool:
    """Whether a tokenizer of the tokenizers library cuts texts as segments are cut: byte level by words, and nothing else."""
    whole = json.loads(tokenizer.to_str())
    step = whole["pre_tokenizer"] or {}
    return whole["normalizer"] is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and not whole["truncation"]


def byte_letters() -> dict[str, int]:
    """The byte of each letter in which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Latin letters, signs of which none begins a contraction, and line ends: each run is one piece for a byte-level pre-tokenizer.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"(?: ?[{_LETTERS}]++| ?[{_SIGNS}]++|\n(?=[{_LETTERS}{_SIGNS}]))++").fullmatch


def ranked(tokenizer, special: tuple[str, ...]):
    """The merges of a byte-level tokenizer as ranks of their results, for tiktoken; None where these might differ.

    They are the same if results are numbered in the order of the merges and the tokenizer makes each token whole: two
    neighbours that make a token without being its merge would, by the same steps, be what is left of that token alone.
    """
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    numbers, letters = [model["vocab"].get("".join(p), -1) for p in pairs], byte_letters()
    usual = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    whole = lambda token, number: [t.id for t in tokenizer.model.tokenize(token)] == [number]
    tokens = {t: i for t, i in model["vocab"].items() if t not in special}
    if not usual or any(b <= a for a, b in zip(numbers, numbers[1:])) or not all(set(t) <= letters.keys() and whole(t, i) for t, i in tokens.items()):
        return None
    ranks = {bytes(map(letters.__getitem__, t)): i for t, i in tokens.items()}
    if not all(bytes([b]) in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("ranked", pat_str=f" ?[{_LETTERS}]+| ?[{_SIGNS}]+|\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ByteLevel:
    """Ids of segments by a byte-level tokenizer: plain ones by its ranks, the others by the tokenizer itself.

    special: tokens that are not to be read as text; segments with one of them are not plain.
    """

    def __init__(self, tokenizer, special: tuple[str, ...] = ()):
        self.encode = tokenizer.encode_batch_fast
        added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.quick = ranked(tokenizer, added) if byte_level(tokenizer) else None
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda s: None

    def ids(self, some: list[str]) -> Iterator[list[int]]:
        if self.quick is None:
            yield from (e.ids for e in self.encode(some, add_special_tokens=False))
            return
        plain = [_PLAIN(s) is not None and self.special(s) is None for s in some]
        other = iter(self.encode([s for s, p in zip(some, plain) if not p], add_special_tokens=False))
        for s, p in zip(some, plain):
            yield self.quick(s) if p else next(other).ids
