"""Token ids of texts by a public tokenizer."""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers, and bytes of text whose words are looked up together.
_MEMO, _BLOCK = 1_200_000, 16_000_000
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: White space of three and more characters, or two at the end, is cut by what surrounds it; such texts are encoded whole.
_WHOLE = rf"{_SPACE}{_SPACE}{_SPACE}|{_SPACE}{_SPACE}\z| \z"
#: Stands between words that are encoded together. It takes part in no merge, so it changes no ids.
_MARK = "\x01"
_ALONE = re.compile(r"\x01|\s\s\Z|\A(?! |[^\W\d_]+\Z)")
#: Letters with punctuation behind them: both vocabularies split these.
_PARTS = re.compile(r"( ?[^\W\d_]+)([.,;:!?]+)")


class _Table:
    """Ids of remembered words one after the other, with each word's row and where its ids end."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1 << 12, dtype=np.uint32), np.zeros(1 << 10, dtype=np.int64)

    def add(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.row)
        at = self.ends[n]
        while n + len(words) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.ends[n + 1 : n + 1 + len(words)] = ends + at
        self.flat[at : at + len(ids)] = ids
        self.row.update(zip(words, range(n, n + len(words)), strict=True))

    def gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these rows one after the other, and the end of each row's ids."""
        start = self.ends[row]
        n = self.ends[row + 1] - start
        ends = np.cumsum(n)
        at = np.repeat((start - ends + n).astype(np.int32), n)  # a table and a block hold far fewer than 2^31 ids
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at], ends


def _splits(word: str) -> bool:
    """Whether these are letters still, once normalised and lower-cased as the vocabularies do."""
    return word.isascii() or unicodedata.normalize("NFC", word).lower().strip(" ").isalpha()


@functools.lru_cache(maxsize=4)
def encoder(name: str, keep_spaces: bool):
    """A function from an Arrow array of texts to all their ids and the end of each text's ids, for a file in ``public_tokenizers``.

    Both public vocabularies split at spaces before they merge, and at a line feed, so a text's ids are those
    of its words one after the other. The words of a block of texts are made distinct first; a worker
    remembers words it has met and encodes new ones together. ``keep_spaces`` says that a word's leading
    space or line feed belongs to it (byte-level), else white space carries no ids. Byte-level texts with
    longer runs of white space are encoded whole. Null texts have no ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    (mark,) = tok.encode(_MARK, add_special_tokens=False).ids
    table = _Table()

    def raw(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))

    def fetch(words: list[str]) -> None:
        alone = [w for w in words if (_ALONE.search(w) if keep_spaces else _MARK in w)]
        if alone:
            table.add(alone, *raw(alone))
            words = [w for w in words if w not in table.row]
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            row = np.array([*tok.encode_batch_fast([(_MARK if keep_spaces else f" {_MARK} ").join(part)], add_special_tokens=False)[0].ids, mark], dtype=np.uint32)
            ends = np.flatnonzero(row == mark)
            table.add(part, row[row != mark], ends - np.arange(len(ends)))

    def learn(words: list[str]) -> None:
        made: dict[str, tuple[str, ...]] = {}
        for w in words:
            m = _PARTS.fullmatch(w, w[:1] == "\n")
            if m and _splits(m[1]):
                made[w] = ("\n", m[1], m[2]) if w[0] == "\n" else (m[1], m[2])
            elif w[:1] == "\n" and w[1:] and not w[1].isspace():
                made[w] = ("\n", w[1:])
        wanted = {w for w in words if w not in made}.union(*made.values())
        fetch([w for w in wanted if w not in table.row])
        more = [w for w in made if w not in table.row]
        row = np.fromiter(map(table.row.__getitem__, itertools.chain.from_iterable(map(made.__getitem__, more))), np.int64)
        ids, ends = table.gather(row)
        table.add(more, ids, np.append(0, ends)[np.cumsum([len(made[w]) for w in more], dtype=np.int64)])

    def rows(words: list[str]) -> np.ndarray:
        got = list(map(table.row.get, words))
        new = [w for w, r in zip(words, got, strict=True) if r is None]
        if new:
            learn(new)
            got = list(map(table.row.__getitem__, words))
        return np.array(got, dtype=np.int64)

    def spread(words: pa.Array, before: str) -> np.ndarray:
        """Each word's row, found once for each distinct word."""
        d = words.dictionary_encode()
        return rows([before + w for w in d.dictionary.to_pylist()])[d.indices.to_numpy(zero_copy_only=False)]

    def block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal table
        if len(table.row) > _MEMO:
            table = _Table()
        if not keep_spaces:
            parts = pc.ascii_split_whitespace(texts)
            row, last = spread(parts.flatten(), ""), np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        else:
            lines = pc.split_pattern(texts, "\n")
            last = np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))
            parts = pc.split_pattern(lines.flatten(), " ")
            ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            row, first = spread(parts.flatten(), " "), pc.list_element(parts, 0)  # a line's first word has no space before it
            new_text = np.zeros(len(parts), dtype=bool)
            new_text[np.append(0, last[:-1])] = True
            row[np.append(0, ends[:-1])] = np.where(new_text, spread(pc.if_else(new_text, first, ""), ""), spread(pc.if_else(new_text, "", first), "\n"))
            last = ends[last - 1]
        ids, ends = table.gather(row)
        return ids, np.append(0, ends)[last]

    def several(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not keep_spaces:
            return block(texts)
        whole = pc.match_substring_regex(texts, _WHOLE)
        if not pc.any(whole).as_py():
            return block(texts)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        ids, ends = block(pc.if_else(whole, "", texts))
        pieces = np.split(ids, ends[:-1])
        for i, text in zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist(), strict=True):
            pieces[i] = raw([text])[0]
        return np.concatenate(pieces), np.cumsum([len(x) for x in pieces])

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // _BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        ids, ends, before = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)], 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                x, e = several(texts.slice(a, b - a))
                ids.append(x)
                ends.append(e + before)
                before += len(x)
        return np.concatenate(ids), np.concatenate(ends)

    return encode
