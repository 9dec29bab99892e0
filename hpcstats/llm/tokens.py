"""Token ids of whole texts, by the ``tokenizers`` library, with a bounded memo of words.

The byte-level BPE never merges over the boundary between a character that is
not white space and a following single space or line end, nor between a letter
and a comma or full stop behind it, so the ids of a text are those of its
pieces cut there, one after another.  Corpora repeat their words, so a worker
keeps the ids of the pieces it has seen and sends only new ones to the
tokenizer, thousands in one call.  When the memo holds ``MEMO_PIECES``, it is
cut back to the pieces of the texts at hand.  A text with white space next to
white space, with other white space than spaces and line ends, with a NUL, or
with a string that the vocabulary has as an added token is encoded whole.
"""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PIECES = 800_000
# White space other than space and line end, by str.isspace.
OTHER_SPACE = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                                0x202F, 0x205F, 0x3000) if c != 0x0A]
NOT_CUT = ("  ", "\n\n", " \n", "\n ", "\0", *OTHER_SPACE)
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class TextEncoder:
    """Encodes lists of texts to little-endian unsigned 32-bit ids, as bytes.

    ``literal``: the strings of special tokens are ordinary text.  The operators
    encode plainly (``worker_encoder``): there such a string is its one id.
    """

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.not_cut = (*NOT_CUT, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.memo_pieces = memo_pieces
        self.memo: dict[str, bytes] = {}
        self.line_end = self._whole(["\n"])[0]
        # many words can share a call only if a line end is one id of its own between them
        probe = self._whole(["\n a"])[0]
        self.joinable = len(self.line_end) == 4 and probe[:4] == self.line_end

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Add the ids of new pieces: each without white space but for one space in front, or a line end."""
        memo, ends = self.memo, {}
        for p in pieces:  # a word with a comma or full stop behind it is the word and the mark
            if p[-1:] in (",", ".") and p[-2:-1].isalpha():
                ends[p] = p[:-1]
        words = [p for p in {*pieces.difference(ends), *ends.values(), ",", "."}.difference(memo) if p.strip()] if self.joinable else []
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            breaks = np.flatnonzero(ids == int.from_bytes(self.line_end, "little"))
            if len(breaks) != len(part) - 1:  # not reached with this vocabulary: a line end is one id between words
                memo.update(zip(part, self._whole(part)))
                continue
            data, stops = ids.tobytes(), (breaks * 4).tolist()
            memo.update(zip(part, [data[x:y] for x, y in zip([0, *[s + 4 for s in stops]], [*stops, len(data)])]))
        if self.joinable:
            for p, word in ends.items():
                memo[p] = memo[word] + memo[p[-1]]
        rest = [p for p in pieces if p not in memo]
        memo.update(zip(rest, self._whole(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not any(x in t for x in self.not_cut) and not t.startswith((" ", "\n")) and not t.endswith((" ", "\n")) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        at = [i for i, p in enumerate(plain) if p]
        for i, ids in zip(at, self._by_pieces([texts[i] for i in at])) if at else ():
            out[i] = ids
        if rest := [i for i, p in enumerate(plain) if not p]:
            for i, ids in zip(rest, self._whole([texts[i] for i in rest])):
                out[i] = ids
        return out

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Texts whose only white space is single spaces and line ends between other characters."""
        words = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n "), " ")
        coded = words.values.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        starts = words.offsets.to_numpy()
        # a word has a space in front unless it begins the text or a line; a line end has none
        line_end = names.index("\n") if "\n" in names else -1
        bare = codes == line_end
        bare[1:] |= bare[:-1]
        bare[starts[:-1]] = True
        # number the (word, bare or not) that occur by a table over all of them, without sorting the words
        coded = codes.astype(np.int64) * 2 + bare
        seen = np.zeros(2 * len(names), dtype=bool)
        seen[coded] = True
        kinds = np.flatnonzero(seen)
        place = (np.cumsum(seen) - 1)[coded]
        pieces = [names[k >> 1] if k & 1 else " " + names[k >> 1] for k in kinds.tolist()]
        if len(self.memo) + len(pieces) > self.memo_pieces:
            known = self.memo
            self.memo = {p: known[p] for p in pieces if p in known}
        found = list(map(self.memo.get, pieces))
        if missing := [i for i, f in enumerate(found) if f is None]:
            self._learn({pieces[i] for i in missing})
            for i in missing:
                found[i] = self.memo[pieces[i]]
        ids, sizes = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first = np.cumsum(sizes) - sizes
        many = sizes[place]
        ends = np.cumsum(many)
        flat = ids[np.repeat(first[place] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = 4 * np.concatenate([[0], ends])[starts]
        return [flat[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())]


def worker_encoder(path: str) -> TextEncoder:
    """The worker process's encoder: its memo serves all tasks that run in it.

    Tasks bring their own copy of this module, so the encoder is kept with the
    interpreter's modules.
    """
    cache = sys.modules.setdefault("_hpcstats_encoders", types.ModuleType("_hpcstats_encoders")).__dict__
    if path not in cache:
        cache[path] = TextEncoder(path, literal=False)
    return cache[path]


def sliced(values: list, most_chars: int = 8_000_000):
    """Ranges of a list of texts with at most so many characters each (or one text)."""
    start = chars = 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if i > start and chars + n > most_chars:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(values):
        yield start, len(values)
