"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is split into units that no vocabulary piece crosses: a run of spaces and the word after it, or a line feed.
Each unit is merged on its own by an agenda of adjacent symbol pairs: the pair whose union has the best score is merged
first, the leftmost among equals, until no union of neighbours is in the vocabulary. Units that occur again are looked
up. Every new unit is compared with the sentencepiece library, in one call for an Arrow batch, and one whole text a
batch is compared in both directions.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, groupby, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Bytes that a worker spends on units that it remembers, about; beyond it those that were met once go.
REMEMBERED_BYTES = 128 << 20
#: Characters of text that are encoded at once.
AT_ONCE = 2_000_000
#: Symbols up to which an agenda is a plain list, and from which a unit is cut where no piece has both neighbours.
SHORT, LONG = 40, 256
#: Longest text that is compared whole.
COMPARED_WHOLE = 100_000
#: Rank of a pair without a piece, and a symbol that no piece has.
NEVER, LAST = 1 << 30, "\udfff"


class Words(dict):
    """Unit -> its number; a new unit gets the next one and is put on a list."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.new.append(unit)
        return n


class Vocabulary:
    """Scores of mergeable pieces, bytes and the units met so far; one for each Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.vocab_size()
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        places = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: places[x] for p, x in scores.items()}
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.texts = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.values = {i: b for b, i in enumerate(self.bytes)}
        self.end = self.library.eos_id()
        self.crossing = any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.unit = re.compile(r"(?s).+" if self.crossing else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.before = self.library.encode("\n")
        self.forget()

    def forget(self) -> None:
        """Nothing is remembered but the empty unit, which stands for the end of a text."""
        self.known = Words()
        self.flat, self.first, self.many = np.array([self.end], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.odd, self.met = np.zeros(1, bool), np.zeros(1, np.int64)
        self.surfaces: dict[int, str] = {}
        self.held = 0

    def forget_rare(self) -> None:
        """Units that were met once go, or all where that isn't half of the memory."""
        stay = np.flatnonzero(self.met > 1)
        stay = np.concatenate(([0], stay[stay > 0]))
        keys, many, surfaces = list(self.known), self.many[stay], self.surfaces
        ids = self.flat[np.arange(many.sum()) + np.repeat(self.first[stay] - np.cumsum(many) + many, many)]
        self.forget()
        held = _size(keys := [keys[k] for k in stay.tolist()], len(ids))
        if held > REMEMBERED_BYTES // 2:
            return
        self.known.update((u, k) for k, u in enumerate(keys))
        self.flat, self.first, self.many, self.held = ids, np.cumsum(many) - many, many, held
        self.odd, self.met = np.zeros(len(stay), bool), np.ones(len(stay), np.int64)
        self.surfaces = {k: surfaces[old] for k, old in enumerate(stay.tolist()) if old in surfaces}
        self.odd[list(self.surfaces)] = True

    def merge(self, unit: str) -> list[str]:
        """Pieces of a unit, by the agenda: one place for each pair, with the rank of its union's score. No piece has the mark at the end."""
        if len(unit) > SHORT:
            return self.merge_long(unit)
        rank, symbols = self.rank.get, [*unit, LAST]
        agenda = list(map(rank, map(add, symbols, symbols[1:]), repeat(NEVER)))
        while (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] = union = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            agenda[i] = rank(union + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + union, NEVER)
        symbols.pop()
        return symbols

    def merge_long(self, unit: str) -> list[str]:
        """As ``merge``, with the agenda in a heap. An entry holds the rank of a union's score and, in its low bits, the left symbol's place."""
        symbols: list[str] = list(unit)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        agenda = [rank[s] << 32 | i for i in range(n - 1) if (s := unit[i : i + 2]) in rank]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or not symbols[i] or rank.get(union := symbols[i] + symbols[j]) != entry >> 32:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = union, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := union + symbols[k]) in rank:
                    heappush(agenda, rank[s] << 32 | i)
            if (h := before[i]) >= 0 and (s := symbols[h] + union) in rank:
                heappush(agenda, rank[s] << 32 | h)
        return [s for s in symbols if s]

    def encode_unit(self, unit: str) -> list[int]:
        """A piece outside the vocabulary becomes the pieces of its bytes."""
        ids, pieces = self.ids, self.merge(unit)
        try:
            return list(map(ids.__getitem__, pieces))
        except KeyError:
            return list(chain.from_iterable((ids[p],) if p in ids else (self.bytes[b] for b in p.encode()) for p in pieces))

    def surface(self, ids: list[int]) -> str:
        """Text of ids: pieces side by side, runs of bytes read as UTF-8, each byte that isn't as U+FFFD."""
        try:
            return "".join(map(self.texts.__getitem__, ids))
        except KeyError:
            runs = groupby(ids, lambda i: i in self.texts)
            return "".join("".join(self.texts[i] for i in run) if plain else _read(bytes(self.values[i] for i in run if i in self.values)) for plain, run in runs)

    def cut(self, unit: str) -> list[str]:
        """Parts of a long unit between which nothing can be merged, as no piece has the two characters side by side."""
        if len(unit) <= LONG:
            return [unit]
        near = self.neighbours
        at = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in near), len(unit)]
        return [unit[a:b] for a, b in zip(at, at[1:], strict=False)]

    def units(self, text: str) -> list[str]:
        """Keys of a text's units. A key without the space mark has it before it, but for one that begins with a line feed."""
        lines = text.replace("\n", " \n")
        if not (self.crossing or SPACE in text or "  " in lines or lines[0] == " " or lines[-1] == " "):
            return lines.split(" ")
        return [u if u[0] == SPACE else u + SPACE for u in self.unit.findall(SPACE + text.replace(" ", SPACE))]

    def learn(self) -> None:
        """Encodes new units and compares them with the library's, which are read after a line feed so that it adds no space."""
        new, self.known.new = self.known.new, []
        texts = [(k if k[0] == "\n" else SPACE + k) if SPACE not in k else k if k[0] == SPACE else k[:-1] for k in new]
        if self.crossing:
            parts = [[t] for t in texts]
        else:
            parts = [[p for u in self.unit.findall(t) for p in self.cut(u)] if t[0] == "\n" or len(t) > LONG else [t] for t in texts]
        # Parts of long units are short and repeat, so each is encoded once.
        flat = list(dict.fromkeys(chain.from_iterable(parts)))
        skip, found = len(self.before), {p: self.encode_unit(p) for p in flat}
        for part, theirs in zip(flat, self.library.encode(["\n" + p for p in flat], num_threads=1), strict=True):
            if found[part] != theirs[skip:]:
                raise ValueError(f"the agenda and the library differ on {part[:100]!r}: {found[part][:50]} and {theirs[skip:][:50]}")
        each, number = [], len(self.first)
        for text, own in zip(texts, parts, strict=True):
            mine = found[text] if len(own) == 1 else np.fromiter(chain.from_iterable(map(found.__getitem__, own)), np.int32)
            each.append(mine)
            if (surface := self.surface(mine if len(own) == 1 else mine.tolist())) != text.replace(SPACE, " "):
                self.surfaces[number] = surface
            number += 1
        many = list(map(len, each))
        n = np.array(many, np.int64)
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(n) - n))
        self.many = np.concatenate((self.many, n))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(each), np.int32, int(n.sum()))))
        self.odd = np.zeros(number, bool)
        self.odd[list(self.surfaces)] = True
        self.met = np.concatenate((self.met, np.zeros(len(n), np.int64)))
        self.held += _size(new, int(n.sum()))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts side by side with end ids, where each text's begin, and decoded texts."""
        if self.held > REMEMBERED_BYTES:
            self.forget_rare()
        each = [[*self.units(t), ""] if t else [""] for t in texts]
        ends = np.cumsum([0, *map(len, each)])
        code = np.fromiter(map(self.known.__getitem__, chain.from_iterable(each)), np.int64, ends[-1])
        if self.known.new:
            self.learn()
        self.met += np.bincount(code, minlength=len(self.met))
        many = self.many[code]
        upto = np.cumsum(many)
        ids = self.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.first[code] - upto + many, many)]
        begin = np.concatenate(([0], upto))[ends]
        decoded = [t.replace(SPACE, " ") for t in texts]
        for k in np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(self.odd[code])))[ends])):
            found = [self.surfaces.get(c) for c in code[ends[k] : ends[k + 1] - 1].tolist()]
            whole = (s if s is not None else self.surface(self.flat[self.first[c] : self.first[c] + self.many[c]].tolist()) for s, c in zip(found, code[ends[k] :].tolist(), strict=False))
            decoded[k] = "".join(whole)[1:]  # without the space that was put before the text
        k = next((k for k, t in enumerate(texts) if len(t) <= COMPARED_WHOLE), None)
        if k is not None:
            mine = ids[begin[k] : begin[k + 1]].tolist()
            if self.library.encode(texts[k]) + [self.end] != mine or self.library.decode([mine], num_threads=1) != decoded[k : k + 1]:
                raise ValueError(f"the agenda and the library differ on the text {texts[k][:100]!r}")
        return ids, begin, decoded


def _size(units: list[str], ids: int) -> int:
    """Bytes, about, that units and their ids take in ``Vocabulary``."""
    return 200 * len(units) + 4 * sum(map(len, units)) + 4 * ids


def _read(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        return re.sub(r"[\udc80-\udcff]", "�", run.decode(errors="surrogateescape"))


_VOCABULARIES: dict[int, Vocabulary] = {}


def encode_decode(docs: DataFrame, model_path: str, keep_text: bool = True) -> DataFrame:
    """docs with ``text`` -> with ``ids`` (array of int, an end id last) and ``decoded`` (string).

    Null text counts as empty: the end id alone, and an empty string. The model's file is read once, on the driver.
    Columns of ``docs`` named ids or decoded are replaced. All other rows and columns stay.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kept = docs.drop("ids", "decoded")
    outer = [f for f in kept.schema.fields if keep_text or f.name != "text"]
    names = [f.name for f in outer]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _VOCABULARIES.get(hash(model)) or _VOCABULARIES.setdefault(hash(model), Vocabulary(model))
        gc.disable()  # the many small lists of a batch have no cycles
        try:
            yield from encoded(vocabulary, batches)
        finally:
            gc.enable()

    def encoded(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            while at < len(texts):
                end, length = at, 0
                while end < len(texts) and (end == at or length + len(texts[end]) <= AT_ONCE):
                    length += len(texts[end])
                    end += 1
                ids, begin, decoded = vocabulary.encode(texts[at:end])
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), lists, pa.array(decoded, pa.string())], [*names, "ids", "decoded"])
                at = end

    schema = T.StructType([*outer, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(run, schema)
