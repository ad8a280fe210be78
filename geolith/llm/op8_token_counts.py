"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split where no token can cross: at the boundaries of a byte-level tokenizer's pieces, and else at a
space between letters. A part that a process has met before is not encoded again; the others are encoded in
batches of about equal bytes.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from geolith.llm.batches import AT_TASK_END, field, id_and_text, map_batches, raw
from geolith.llm.pieces import PieceCache

#: Fixed value: the pieces of a byte-level pre-tokenizer with its own expression.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Boundaries that are found fast, and all others, which only long parts are searched for.
NARROW_CUT, SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])"), regex.compile(r"(?<=\p{L}) (?=\p{L})")
#: Parts that a process remembers, bytes of the longest of them, and seconds after which it forgets them while it does other work.
CACHE_PARTS, PART_BYTES, IDLE_SECONDS = 600_000, 64, 20.0


def splits_at_spaces(spec: dict | None) -> bool:
    """Whether a pre-tokenizer never joins a letter, a space and a letter."""
    if not spec:
        return False
    kind = spec["type"]
    if kind == "Sequence":
        return any(splits_at_spaces(x) for x in spec["pretokenizers"])
    if kind == "ByteLevel":
        return spec.get("use_regex", True) and not spec.get("add_prefix_space", True)
    if kind == "Split":  # besides a space before a word, the pattern must have nothing that takes a space with letters
        rest = spec["pattern"].get("Regex", " ")
        for x in (" ?", r"[^\s\p{L}\p{N}]", r"\s+(?!\S)", r"\s+"):
            rest = rest.replace(x, "")
        return " " not in rest and r"\s" not in rest and "." not in rest
    return kind in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")


def plain_normalizer(spec: dict | None) -> bool:
    """Whether a normalizer leaves spaces between letters where they are."""
    if not spec:
        return True
    if spec["type"] == "Sequence":
        return all(map(plain_normalizer, spec["normalizers"]))
    return spec["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or spec["type"] == "Replace" and spec["pattern"].get("Regex") == r"\s+" and spec["content"] == " "


class Lengths:
    """Tokens of texts, by the library for a tokenizer's file.

    ``cuts``: whether a text's length is the sum of its parts' lengths. ``lead`` stands before every part but the first.
    """

    def __init__(self, path: str, batch_bytes: int = 1 << 17):
        self.batch_bytes, self.used = batch_bytes, 0.0
        self.pieces: PieceCache | None = None
        self.known: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            inside = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            self.cuts, self.lead, self.wide = not inside and model.encode("a", out_type=str)[0].startswith("▁"), "", False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            spec = json.loads(tokenizer.to_str())
            self.encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            added = spec.get("added_tokens") or []
            whole = all(" " not in x["content"] and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in added)
            self.cuts, self.lead, self.wide = whole and splits_at_spaces(spec.get("pre_tokenizer")) and plain_normalizer(spec.get("normalizer")), " ", True
            kind = spec.get("pre_tokenizer") or {}
            if whole and len({x["normalized"] for x in added}) < 2 and spec.get("normalizer") is None and spec.get("post_processor") is None and kind == kind | {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}:
                names = sorted((x["content"] for x in added if x["content"]), key=len, reverse=True)  # the longest of those at a place is taken
                self.special = re.compile("|".join(map(re.escape, names))) if names else None
                self.pieces = PieceCache(BYTE_LEVEL, lambda parts: in_batches(parts, batch_bytes, lambda batch: [x.ids for x in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]))
        AT_TASK_END.append(self.forget_if_idle)

    def forget_if_idle(self) -> None:
        if self.known and time.monotonic() - self.used > IDLE_SECONDS:
            self.known = {}

    def parts(self, text: str) -> list[str]:
        """The parts of a text; those of over ``batch_bytes`` letters are cut at any letters, if they can be."""
        if not self.cuts:
            return [text]
        first, *rest = NARROW_CUT.split(text)
        out = [first, *(self.lead + x for x in rest)] if self.lead else [first, *rest]
        if self.wide and len(text) > self.batch_bytes and max(map(len, out)) > self.batch_bytes:
            out = [y for x in out for y in (cut(x, self.batch_bytes) if len(x) > self.batch_bytes else [x])]
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if self.pieces:
            split = [self.special.split(x) if self.special else [x] for x in texts]  # between special strings, each of which is a token
            found = iter(self.pieces.numbers([part for parts in split for part in parts]))
            sizes = np.diff(self.pieces.at[: len(self.pieces.index) + 1])
            return np.array([len(parts) - 1 + sum(int(sizes[next(found)].sum()) for _ in parts) for parts in split], np.int64)
        if len(self.known) > CACHE_PARTS:
            self.known = {}
        self.used = time.monotonic()
        split = [self.parts(x) for x in texts]
        new = list({p for parts in split for p in parts} - self.known.keys())
        found = dict(zip(new, in_batches(new, self.batch_bytes, self.encode), strict=True))
        self.known.update((p, n) for p, n in found.items() if len(p) <= PART_BYTES)
        get = self.known.get
        out = np.zeros(len(texts), np.int64)
        for i, parts in enumerate(split):
            numbers = [get(p) for p in parts]
            out[i] = sum(found[p] if n is None else n for p, n in zip(parts, numbers, strict=True)) if None in numbers else sum(numbers)
        return out


def cut(text: str, most: int) -> list[str]:
    """Parts of about ``most`` characters; a part is longer where no safe boundary follows."""
    parts, start = [], 0
    while len(text) - start > most and (m := SAFE_CUT.search(text, start + most)):
        parts.append(text[start : m.start()])
        start = m.start()
    return [*parts, text[start:]]


def balanced(parts: list[str], most: int) -> list[list[int]]:
    """The parts' numbers in batches of about equal bytes and about ``most``: the longest first, each to the batch with the fewest."""
    sizes = [len(p.encode()) for p in parts]
    batches: list[list[int]] = [[] for _ in range(-(-sum(sizes) // most) or 1)]
    heap = [(0, k) for k in range(len(batches))]
    for i in sorted(range(len(parts)), key=lambda i: -sizes[i]):
        held, k = heap[0]
        batches[k].append(i)
        heapq.heapreplace(heap, (held + sizes[i], k))
    return [b for b in batches if b]


def in_batches(parts: list[str], most: int, encode: Callable[[list[str]], list]) -> list:
    """What ``encode`` gives for each part, in balanced batches."""
    out: list = [None] * len(parts)
    for batch in balanced(parts, most):
        for i, found in zip(batch, encode([parts[i] for i in batch]), strict=True):
            out[i] = found
    return out


_loaded: dict[tuple[str, int], Lengths] = {}


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = 1 << 17) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and ids give repeated rows, a null
    id stays null, other columns are ignored, an empty table gives an empty one. No text is shortened:
    texts are cut at the pieces of a byte-level tokenizer, or else at spaces between letters if the settings
    show that no token crosses these, and the parts' lengths are summed; else each text is encoded whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, batch_bytes) not in _loaded:
            _loaded[path, batch_bytes] = Lengths(path, batch_bytes)
        lengths = _loaded[path, batch_bytes]
        for batch in batches:
            _, at = raw(batch.column(1))
            n = lengths(batch.column(1).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_batches(id_and_text(df, id_col, text_col), count, [field(df, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
