"""Byte-level BPE counts as Arrow functions."""
from __future__ import annotations

import functools
import itertools
import json
import os
import re

import pandas as pd
from pyspark.sql import functions as F


#: Where the 50k byte-level BPE vocabulary is looked for when no path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def default_vocabulary() -> str:
    if not os.path.exists(VOCABULARY):
        raise RuntimeError("pass the path of a byte-level BPE tokenizer file")
    return VOCABULARY


@functools.lru_cache(maxsize=2)
def _tokenizer(place: str):
    """One tokenizer per worker process and file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(place)


#: Characters encoded at once: an encoding takes some hundred bytes a token until it is counted.
ENCODED_CHARS = 1 << 20


def _sizes(tokenizer, texts: list[str]) -> list[int]:
    sizes, low, held = [], 0, 0
    for at, text in enumerate(texts):
        held += len(text or "")
        if held >= ENCODED_CHARS or at + 1 == len(texts):
            sizes += [len(e.ids) for e in tokenizer.encode_batch(texts[low : at + 1], add_special_tokens=False)]
            low, held = at + 1, 0
    return sizes


#: Words whose counts a worker remembers; longest word that it remembers.
KNOWN, WORD = 1 << 17, 48
#: A blank that no word follows; a line end between words.
_ODD, _LINE = re.compile(r" (?=\s|\Z)"), re.compile(r"(?<=\S)\n(?=\S)")


class _Words(dict):
    """Token counts of words, each with ``before`` in front of it, remembered up to a bound."""

    def __init__(self, tokenizer, before: str):
        super().__init__()
        self.tokenizer, self.before, self.bare = tokenizer, before, self

    def __missing__(self, word: str) -> int:
        lines = _LINE.split(word)
        if len(lines) > 1:
            return self[lines[0]] + (len(lines) - 1) * self.bare["\n"] + sum(map(self.bare.__getitem__, lines[1:]))
        count = len(self.tokenizer.encode(self.before + word, add_special_tokens=False).ids)
        if len(word) <= WORD:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = count
        return count


class _Counter:
    """Token counts of texts as sums over their words.

    No token of a byte-level vocabulary crosses the borders used here: before a blank that a non-blank follows, around a single line
    end between non-blanks, before the blanks at the end. So each word is encoded once and remembered. Texts with an added token,
    and all texts of a tokenizer of another kind, are encoded whole.
    """

    def __init__(self, tokenizer):
        spec = json.loads(tokenizer.to_str())
        rule = spec["pre_tokenizer"] or {}
        plain = not any(spec[part] for part in ("normalizer", "post_processor", "truncation", "padding")) and not spec["model"].get("dropout")
        self.tokenizer, self.added = tokenizer, [token["content"] for token in spec["added_tokens"]]
        self.apart = plain and spec["model"]["type"] == "BPE" and rule.get("type") == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"]
        self.bare, self.after_blank = _Words(tokenizer, ""), _Words(tokenizer, " ")
        self.after_blank.bare = self.bare

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return _sizes(self.tokenizer, texts)
        whole = {at for at, t in enumerate(texts) if t is None or any(token in t for token in self.added)}
        sizes = iter(_sizes(self.tokenizer, [texts[at] for at in sorted(whole)]))
        return [next(sizes) if at in whole else self._sum(t) for at, t in enumerate(texts)]

    def _sum(self, text: str) -> int:
        core, tail = text.rstrip(" \n"), 0
        if core and not core[-1].isspace():
            text, tail = core, self.bare[text[len(core):]]
        words = text.split(" ")
        if _ODD.search(text):
            joined = words[:1]
            for w in words[1:]:
                if not w or w[0].isspace():
                    joined[-1] += " " + w
                else:
                    joined.append(w)
            words = joined
        return self.bare[words[0]] + sum(map(self.after_blank.__getitem__, itertools.islice(words, 1, None))) + tail


@functools.lru_cache(maxsize=2)
def _counter(place: str) -> _Counter:
    """One memory of words per worker process and file."""
    return _Counter(_tokenizer(place))


def bpe_counter(vocabulary: str | None = None):
    """Function STRING -> INT: the token count."""
    place = vocabulary or default_vocabulary()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_counter(place)(texts.tolist()))

    return count


def _runs(items: list[tuple[int, str]], joins) -> list[tuple[int, str]]:
    """Greedy runs of neighbouring (tokens, text) items."""
    runs: list[list] = []
    for size, text in items:
        if runs and joins(runs[-1], size, text):
            runs[-1][0] += size
            runs[-1][1].append(text)
            runs[-1][2] += len(text)
        else:
            runs.append([size, [text], len(text)])
    return [(size, "".join(texts)) for size, texts, _ in runs]


def _token_cuts(tokenizer, text: str, size: int, sizes=None) -> list[tuple[int, str]]:
    """``text`` cut every ``size`` tokens. A character spread over several tokens is not torn: they share one start."""
    starts = [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]
    marks = sorted({0, len(text), *starts[::size]})
    pieces = [text[a:b] for a, b in zip(marks, marks[1:])]
    return list(zip(sizes(pieces) if sizes else _sizes(tokenizer, pieces), pieces))


def bpe_chunker(levels: tuple[str, ...], vocabulary: str | None = None):
    """Function (text, size, min_chars) -> chunks under the contract of ``operators.chunking``, sizes in tokens.

    One Arrow stage for all levels, because every level needs counts that only the tokenizer knows.
    """
    place = vocabulary or default_vocabulary()
    patterns = [re.compile(level.replace(r"\z", r"\Z")) for level in levels]

    @F.pandas_udf("array<struct<text:string,start_index:int,end_index:int,token_count:int>>")
    def chunks(texts: pd.Series, sizes: pd.Series, least: pd.Series) -> pd.Series:
        tokenizer, counts, out = _tokenizer(place), _counter(place), []
        for (text, whole), size, short in zip(zip(texts, counts(texts.tolist())), sizes, least):
            found = [(whole, text)]
            for pattern in patterns:
                parts = []
                for n, t in found:
                    if n <= size:
                        parts.append((n, t))
                        continue
                    pieces = [m.group() for m in pattern.finditer(t)]
                    parts += _runs(list(zip(counts(pieces), pieces)), lambda run, m, _: run[0] + m <= size)
                found = parts
            cut = [part for n, t in found for part in ([(n, t)] if n <= size else _token_cuts(tokenizer, t, int(size)))]
            final = _runs(cut, lambda run, m, t: (run[2] < short or len(t) < short) and run[0] + m <= size)
            rows, at = [], 0
            for n, t in final:
                rows.append({"text": t, "start_index": at, "end_index": at + len(t), "token_count": n})
                at += len(t)
            out.append(rows)
        return pd.Series(out)

    return chunks
