"""Token ids of whole texts from a public tokenizer file, inside Arrow batches."""

from __future__ import annotations

import json
import os
import re

import numpy as np

KNOWN_WORDS = 800_000
LONG_WORD = 64
BATCH = 64

#: The pieces that such a tokenizer cuts words into, for characters up to U+00FF.
PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\s0-9²³¹¼½¾a-zªµºß-öø-ÿ]+"
)
#: What the ranks leave to the tokenizer: names like those of special tokens, and all but visible characters up to
#: U+00FF, which no normal form changes but for capitals.
OTHER = re.compile("<\\||[^!-~¡-ÿ\n]")
#: What the file must say for ``PIECES`` and the ranks to give its ids.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_loaded: dict[str, "Encoder"] = {}


def _letters() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: visible ones for themselves, then the others."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


def rebuilds(merges: list[tuple[bytes, bytes]], ranks: dict[bytes, int]) -> bool:
    """Whether each merged token, merged from its bytes by falling priority, ends with its own listed pair.

    If so, merging any neighbours whose joint bytes are a token is the same as merging listed pairs only: up to
    the rank of a token, what lies inside its span has been merged as it is when the token stands alone.
    """
    for one, two in merges:
        token = one + two
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joint = [ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            least = min(joint)
            at = joint.index(least)
            if least == 1 << 30 or len(parts[at]) + len(parts[at + 1]) == len(token):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != [one, two]:
            return False
    return True


def word_ranks(path: str) -> dict[bytes, int] | None:
    """Ids of a byte-level vocabulary with word ends by bytes, the end as a zero byte; None if a file is otherwise."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, letters = made["model"], _letters()
    first = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    if (
        model.get("type") != "BPE"
        or model.get("end_of_word_suffix") != "</w>"
        or first.get("pattern") != {"Regex": SPLIT}
        or len(model["vocab"]) != 512 + len(model["merges"])
    ):
        return None

    def raw(token: str) -> bytes:
        ended = token.endswith("</w>")
        return bytes(letters[c] for c in (token[:-4] if ended else token)) + b"\0" * ended

    merges = [tuple(map(raw, pair)) for pair in model["merges"]]
    ranks = {raw(token): i for token, i in model["vocab"].items()}
    in_turn = all(ranks.get(a + b) == 512 + i for i, (a, b) in enumerate(merges))
    return ranks if len(ranks) == len(model["vocab"]) and in_turn and rebuilds(merges, ranks) else None


class Encoder:
    """Ids of texts by a tokenizer that lower-cases and drops white space.

    Such a tokenizer never joins what blanks part, so a text's ids are its words' ids in turn. Words met before
    are looked up; the table is emptied when it holds ``KNOWN_WORDS``, and words of more than ``LONG_WORD`` bytes
    do not enter it, so memory stays bounded. New words of plain characters are encoded by the vocabulary's ranks,
    if the file is such that ranks give its ids; all others by the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.ranks, ranks = None, word_ranks(path)
        if ranks is not None:
            import tiktoken

            # A piece ends with a zero byte, a word with a line end.
            self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})
            self.line = ranks[b"\n"]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, others = [], []
        for at in range(0, len(words), 2_000):
            some = words[at : at + 2_000]
            spelled = b"\n".join(some).decode()
            if self.ranks is not None and not OTHER.search(spelled):
                plain.extend(zip(some, spelled.split("\n")))
                continue
            for word, letters in zip(some, spelled.split("\n")):
                if self.ranks is None or OTHER.search(letters):
                    others.append(word)
                else:
                    plain.append((word, letters))
        return self._by_ranks(plain) | self._by_tokenizer(others)

    def _by_ranks(self, words: list[tuple[bytes, str]]) -> dict[bytes, bytes]:
        made: dict[bytes, bytes] = {}
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            spelled = "\n".join(w for _, w in some).lower() + "\n"
            ids = np.array(self.ranks.encode_ordinary(PIECES.sub("\\g<0>\0", spelled)), "<u4")
            ends = np.flatnonzero(ids == self.line)
            flat = ids[ids != self.line].tobytes()
            begin = 0
            for (word, _), end in zip(some, ((ends - np.arange(len(ends))) * 4).tolist()):
                made[word] = flat[begin:end]
                begin = end
        return made

    def _by_tokenizer(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encode words joined by blanks and deal the ids out by where in the joined text they come from."""
        known: dict[bytes, bytes] = {}
        for at in range(0, len(words), 5_000):
            some = [word.decode() for word in words[at : at + 5_000]]
            starts = np.cumsum([0] + [len(word) + 1 for word in some])
            made = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(made.ids, "<u4")
            first = np.array([offset[0] for offset in made.offsets], np.int64)
            ends = np.searchsorted(first, starts[1:]) * 4
            flat, begin = ids.tobytes(), 0
            for word, end in zip(words[at : at + 5_000], ends.tolist()):
                known[word] = flat[begin:end]
                begin = end
        return known

    def encode(self, texts: list[bytes | None], end: int) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then ``end``; a NULL text is an empty one."""
        # Few texts at a time, so that their words stay in the processor's cache.
        return [ids for at in range(0, len(texts), BATCH) for ids in self._some(texts[at : at + BATCH], end)]

    def _some(self, texts: list[bytes | None], end: int) -> list[bytes]:
        tail = end.to_bytes(4, "little")
        # Capitals count as small letters, but the names of special tokens are exact.
        split = [(text if b"<|" in text else text.lower()).split() if text else [] for text in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        look = self.known.get
        found = [list(map(look, words)) for words in split]
        missing = [words[i] for words, ids in zip(split, found) if None in ids for i, x in enumerate(ids) if x is None]
        if missing:
            made = self._learn(list(dict.fromkeys(missing)))
            self.known.update((word, ids) for word, ids in made.items() if len(word) <= LONG_WORD)
            learned = map(made.__getitem__, missing)
            found = [[next(learned) if x is None else x for x in ids] if None in ids else ids for ids in found]
        return [b"".join(ids) + tail for ids in found]


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
