"""Byte-level BPE by walking the trie of the distinct words depth first.

Texts are cut into words by the vocabulary's pattern. The new words of many texts are sorted, which is the depth-first
order of their trie: the path to a word keeps the stretch that it shares with the word before. Each node on
the path holds the last token of its prefix's encoding: the one vocabulary entry t that ends the prefix and
may follow the last token of the prefix without t. Two tokens may stand side by side if merging by rank would
not have joined anything across their border. So the encoding of a prefix is worked out once for all words that
share it, and a word's ids are read off by stepping back from its node.

The entries that end a prefix are found by walking back from its last byte through a trie of the
reversed vocabulary, shortest first, without cutting out a substring; at most one of them may follow.

Finished words and chunks (words between blanks) are remembered in the Python worker, across its batches. Both memos have a
young and an old half: entries met again move to the young one, and when that is full the old one goes, so
frequent ones stay. Memory is bounded, results do not depend on it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from recordloom.llm.common import prepare

#: Fixed value: the word pattern of the vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of texts that are encoded together.
TOGETHER = 2 << 20
#: Entries in one half of the memos of chunks and of words.
MOST_CHUNKS = 100_000
MOST_BORDERS = 200_000
#: White space beside a blank: only then may a blank not begin a word of its own.
UNEVEN = regex.compile(r"\s | \s")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str, cutting: bool = True) -> dict:
    """The parts of a tokenizer file that encoding needs, plain enough to be broadcast (about 2 MB)."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    spec = json.loads(raw)
    letters = byte_letters()
    to_bytes = lambda s: bytes(letters[c] for c in s)
    ids = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    return {"ids": ids, "merges": [(to_bytes(a), to_bytes(b)) for a, b in merges], "special": special,
            "odd": odd_letters(raw) if cutting else "", "raw": raw}


@lru_cache(maxsize=2)
def odd_letters(raw: str) -> str:
    """A pattern for the code points that this regex library and the tokenizer's own pattern class
    differently (letters of late Unicode versions). Texts with one are cut by the tokenizer's own rule."""
    cut = Tokenizer.from_str(raw).pre_tokenizer
    ours, odd = regex.compile(PATTERN), []
    for start in [*range(0, 0x40000, 0x1000), 0xE0000]:  # the other planes hold no letters or digits
        points = [c for c in range(start, start + 0x1000) if not 0xD800 <= c < 0xE000]  # no surrogates
        line = "\n".join(f"a{chr(c)}1" for c in points)
        if [m.span() for m in ours.finditer(line)] != [o for _, o in cut.pre_tokenize_str(line)]:
            odd += [c for c in points if [m.span() for m in ours.finditer(f"a{chr(c)}1")]
                    != [o for _, o in cut.pre_tokenize_str(f"a{chr(c)}1")]]
    runs, begin = [], None
    for a, b in zip(odd, [*odd[1:], None]):
        begin = a if begin is None else begin
        if b != a + 1:
            runs.append(f"{regex.escape(chr(begin))}-{regex.escape(chr(a))}")
            begin = None
    return f"[{''.join(runs)}]" if runs else ""


class TrieEncoder:
    """Words to ids, with shared prefixes encoded once."""

    def __init__(self, model: dict, most_chunks: int = MOST_CHUNKS):
        self.most_chunks = most_chunks
        self.special = model["special"]
        self.cut = Tokenizer.from_str(model["raw"]).pre_tokenizer
        self.words_of = regex.compile(PATTERN).findall
        self.odd = regex.compile(model["odd"]) if model["odd"] else None
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        ids = model["ids"]
        # tokens in order of birth: single bytes, then one per merge; lower ranks merge first
        births = [bytes([b]) for b in range(256)] + [a + b for a, b in model["merges"]]
        self.rank = {t: r for r, t in reversed(list(enumerate(births)))}
        self.id_of = [ids[t] for t in births]
        self.size = [len(t) for t in births]
        self.halves: list[tuple[int, int] | None] = [None] * 256 + [(self.rank[a], self.rank[b]) for a, b in model["merges"]]
        self.joined = {pair: r for r, pair in enumerate(self.halves) if pair}
        self.back, self.token_at = self.reversed_trie(births)
        self.border: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.coded: dict[str, bytes] = {}
        self.coded_before: dict[str, bytes] = {}

    @staticmethod
    def reversed_trie(births: list[bytes]) -> tuple[dict[int, int], list[int]]:
        """Steps (node << 8 | byte -> node) from the end of a token backwards, and the token that ends at each node or -1."""
        step, token_at = {}, [-1]
        for rank, token in enumerate(births):
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                node = step.get(key, -1)
                if node < 0:
                    step[key] = node = len(token_at)
                    token_at.append(-1)
            if token_at[node] < 0:
                token_at[node] = rank
        return step, token_at

    def may_meet(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between two finished tokens alone.

        Undo the later of the two merges again and again, keeping the parts that touch the
        border; a merge across it of lower rank than what is undone would have come first.
        """
        key = left << 20 | right
        known = self.border.get(key)
        if known is None:
            if len(self.border) > MOST_BORDERS:
                self.border.clear()
            known = self.border[key] = self._may_meet(left, right)
        return known

    def _may_meet(self, left: int, right: int) -> bool:
        # a merge across the border wins if it ranks before both merges still to come on its sides;
        # on equal rank the leftmost is done first
        bound = 1 << 40
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def encode_words(self, words: list[bytes]) -> Iterator[bytes]:
        """The packed ids of sorted words: a walk of their trie, depth first."""
        back, token_at, border, size, id_of = self.back, self.token_at, self.border, self.size, self.id_of
        last: list[int] = [-1]  # of the prefixes on the path to the current word
        before = b""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:]
            for end in range(shared, len(word)):
                begin, tail = end + 1, 0
                while True:
                    begin -= 1
                    tail = back[tail << 8 | word[begin]]
                    token = token_at[tail]
                    if token >= 0:
                        if not begin:
                            break
                        left = last[begin]
                        fits = border.get(left << 20 | token)
                        if fits or fits is None and self.may_meet(left, token):
                            break
                last.append(token)
            before = word
            ids, end = array("i"), len(word)
            while end:
                token = last[end]
                ids.append(id_of[token])
                end -= size[token]
            ids.reverse()
            yield ids.tobytes()

    def words(self, text: str) -> list[str]:
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            return [text[a:b] for _, (a, b) in self.cut.pre_tokenize_str(text)]
        return self.words_of(text)

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as packed 32-bit numbers.

        A blank between two other characters always begins a word, so an even text is cut at its
        blanks first; chunks already seen are not cut into words again.
        """
        if len(self.young) > self.most_chunks:
            self.old, self.young = self.young, {}
        if len(self.coded) > self.most_chunks:
            self.coded_before, self.coded = self.coded, {}
        young, old, coded, coded_before = self.young, self.old, self.coded, self.coded_before
        parts: list[list] = []  # of each text: packed ids, lists of words, or (first words, chunks)
        fresh: dict[str, list[str]] = {}
        new: set[str] = set()
        for text in texts:
            made: list = []
            for i, piece in enumerate(self.marks.split(text) if self.marks else [text]):
                if i % 2:
                    made.append(array("i", [self.special[piece]]).tobytes())
                    continue
                even = not UNEVEN.search(piece)
                first, *rest = piece.split(" ") if even else (piece,)
                words = self.words(first)
                new.update(words)
                made += [words, tuple(rest)]
                for chunk in set(rest).difference(young):
                    known = old.get(chunk)
                    if known is not None:
                        young[chunk] = known
                    elif chunk not in fresh:
                        fresh[chunk] = words = self.words(" " + chunk)
                        new.update(words)
            parts.append(made)
        todo = {}
        for word in new.difference(coded):
            known = coded_before.get(word)
            if known is None:
                todo[word.encode()] = word
            else:
                coded[word] = known
        order = sorted(todo)
        for raw, ids in zip(order, self.encode_words(order)):
            coded[todo[raw]] = ids
        for chunk, words in fresh.items():
            young[chunk] = b"".join(map(coded.__getitem__, words))
        return [b"".join([p if isinstance(p, bytes) else b"".join(map((young if isinstance(p, tuple) else coded).__getitem__, p)) for p in made])
                for made in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Decoder:
    """Ids to text. Held apart from the encoder, whose tables a decoding worker has no use for."""

    def __init__(self, model: dict):
        texts = {i: t for t, i in model["ids"].items()} | {i: s.encode() for s, i in model["special"].items()}
        self.texts = pa.array([texts.get(i, b"") for i in range(max(texts) + 1)], pa.binary())

    def decode_all(self, lists: pa.ListArray) -> list[str | None]:
        """Bytes of each list's tokens in order, broken UTF-8 replaced; null stays null."""
        flat = self.texts.take(lists.flatten())
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1]
        body = memoryview(flat.buffers()[2] or b"")
        sizes = np.diff(lists.offsets.to_numpy())
        sizes[np.asarray(lists.is_null())] = 0
        at = ends[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [str(body[a:b], "utf-8", "replace") if known else None for a, b, known in zip(at, at[1:], lists.is_valid().to_pylist())]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0]


_CODERS: dict[tuple, TrieEncoder | Decoder] = {}


def coder_for(model: dict, kind: type):
    """One encoder or decoder for each vocabulary in a Python worker, kept from task to task."""
    key = kind, hash((model["raw"], model["odd"]))
    if key not in _CODERS:
        _CODERS[key] = kind(model)
    return _CODERS[key]


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns named by `keep`, and ids (array<int>) of every row's text; null counts as empty.

    `path` names the vocabulary file. It is read on the driver and broadcast; its size is fixed.
    Special tokens in a text become their ids, none are added. Repeated rows stay repeated, an
    empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    box = spark.sparkContext.broadcast(load(path))
    source = docs.select(*keep, F.col("text").cast("string").alias("_body"))
    names = list(keep)

    def rows(batches):
        coder = coder_for(box.value, TrieEncoder)
        held, chars = [], 0

        def flush():
            """Many batches at once: their new words share one walk."""
            packed = coder.encode_all([t for _, texts in held for t in texts])
            at = 0
            for batch, texts in held:
                own = packed[at:at + len(texts)]
                at += len(texts)
                ends = np.cumsum([0] + [len(p) // 4 for p in own]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], [*names, "ids"])
        for batch in batches:
            texts = [t or "" for t in batch.column("_body").to_pylist()]
            held.append((batch, texts))
            chars += sum(map(len, texts))
            if chars > TOGETHER:
                yield from flush()
                held, chars = [], 0
        yield from flush()

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(rows, f"{kept}ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` to a frame that has `ids`; null ids give null."""
    spark = prepare(encoded.sparkSession)
    model = load(path, cutting=False)
    box = spark.sparkContext.broadcast({**model, "merges": []})
    names = [c for c in encoded.columns if c != "decoded"]

    def rows(batches):
        coder = coder_for(box.value, Decoder)
        for batch in batches:
            texts = coder.decode_all(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(texts, pa.string())], [*names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "decoded")
    return encoded.select(*names).mapInArrow(rows, f"{kept}, decoded string")
