"""Hierarchical multi-length packing of documents into training sequences.

A document's token ids (and the id that ends it) are routed to tiers of context
sizes, here 1024, 512, 256 and 128. Whole windows of the longest tier are cut off
first and stand alone; what remains goes to the smallest tier that holds it. Each
tier, longest first, opens its windows with its own remainders and fills the gap
behind each with the largest remainders of shorter tiers that fit, then with a
piece cut from one that does not. A window is thus full when it is emitted, and a
sequence whose length is a power of two needs no padding. Full windows of a tier
are dealt into step groups of equally many tokens.

Each task packs the documents of its split while they stream through: there is
no shuffle, a hot source or a group of copies is like any other, and memory is
bounded by ``window`` remainders of under 1,024 tokens. At its end a task cuts
its last remainders into the tiers below; only the rest, under 128 tokens a task,
is padded. Ids depend on the split, so they are the same when a lost task runs
again on the same files.

Defined results: a null or empty text is one piece holding just the end id;
repeated rows are packed each; documents without an id are packed under a null
id; no document gives no piece. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (1024, 512, 256, 128)
END = 0
#: Remainders that a task holds before it packs them.
WINDOW = 2048
#: Tokens of a step group.
GROUP_TOKENS = 8192
#: Sequence and group ids of a task start at its number shifted by this.
TASK_BITS = 36

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)


#: Fixed value: how byte-level BPE splits a text before its merges.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: long runs of what ``\\s`` stands for in it. The pattern backtracks over a run,
#: so these are cut out before: all of a run is one piece, but for its last character
#: where something follows.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes of the tokens by id, if ids rank the merges; else None."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab, merges = model.get("vocab", {}), model.get("merges", [])
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    ids = [vocab.get(j) for j in joined]
    if None in ids or ids != sorted(ids) or any(c not in vocab for c in byte):
        return None
    if ids and ids[0] < max(vocab[c] for c in byte):
        return None
    return {bytes(byte[c] for c in t): vocab[t] for t in [*byte, *joined]}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    The ids are those of the ``tokenizers`` file. Byte-level BPE whose ids rank
    its merges is run on the same ranks by ``tiktoken``, which is about four times
    as fast and gives the same ids; other files, and texts that hold the text of a
    special token, are encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        special = [t["content"] for t in layout.get("added_tokens", [])]
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        before = layout.get("pre_tokenizer") or {}
        plain = layout.get("normalizer") is None and before.get("type") == "ByteLevel" and (
            before.get("use_regex", True) and not before.get("add_prefix_space", True))
        ranks = _ranks(layout["model"]) if plain else None
        self._ranked = ranks and tiktoken.Encoding(
            "ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _split(self, text: str) -> bytes:
        return self._ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _piece(self, text: str) -> bytes:
        from array import array

        return array("I", self._ranked._encode_single_piece(text)).tobytes()

    def of(self, text: str) -> bytes:
        if self._ranked and not (self._special and self._special.search(text)):
            out, at = [], 0
            for run in BLANKS.finditer(text):
                end = run.end() if run.end() == len(text) else run.end() - 1
                out += [self._split(text[at:run.start()]), self._piece(text[run.start():end])]
                at = end
            return b"".join([*out, self._split(text[at:])])
        from array import array

        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@dataclass(slots=True)
class _Rest:
    """A remainder: ``ids`` from ``start`` on of a document of ``tokens`` ids."""

    doc: int | None
    start: int
    tokens: int
    ids: bytes

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[_Rest, _Rest]:
        return (
            _Rest(self.doc, self.start, self.tokens, self.ids[: 4 * n]),
            _Rest(self.doc, self.start + n, self.tokens, self.ids[4 * n:]),
        )


class Packer:
    """The packing of one task; :meth:`rows` are the pieces made since last asked."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, window: int = WINDOW,
                 group_tokens: int = GROUP_TOKENS):
        self.tiers, self.window, self.group_tokens = tiers, window, group_tokens
        self._base = task << TASK_BITS
        self._sequences = self._groups = 0
        #: Open step group and windows still missing in it, by tier.
        self._open = {t: (0, 0) for t in tiers}
        #: Remainders by length; those of equal length in order of arrival, last first out.
        self._rests: dict[int, list[_Rest]] = {}
        self._lengths: list[int] = []
        self._count = 0
        self._rows: list[tuple] = []

    def rows(self) -> list[tuple]:
        out, self._rows = self._rows, []
        return out

    def add(self, doc: int | None, ids: bytes) -> None:
        tokens, longest = len(ids) // 4, self.tiers[0]
        whole = tokens // longest * longest
        for start in range(0, whole, longest):
            self._emit([_Rest(doc, start, tokens, ids[4 * start: 4 * (start + longest)])], longest)
        if whole < tokens:
            self._put(_Rest(doc, whole, tokens, ids[4 * whole:]))
        if self._count >= self.window:
            self._pack()

    def finish(self) -> None:
        """Pack everything: what fills no window goes down a tier, the last rest is padded."""
        self._pack()
        for tier in self.tiers:
            while self._lengths and self._lengths[-1] >= tier:
                head, tail = self._take(self._lengths[-1]).cut(tier)
                self._emit([head], tier)
                if len(tail):
                    self._put(tail)
            self._pack()
        if self._count:
            last = [self._take(self._lengths[-1]) for _ in range(self._count)]
            self._emit(last, self.tiers[-1])

    def _put(self, rest: _Rest) -> None:
        n = len(rest)
        if n not in self._rests:
            self._rests[n] = []
            insort(self._lengths, n)
        self._rests[n].append(rest)
        self._count += 1

    def _take(self, n: int) -> _Rest:
        rest = self._rests[n].pop()
        if not self._rests[n]:
            del self._rests[n]
            self._lengths.remove(n)
        self._count -= 1
        return rest

    def _pack(self) -> None:
        total = sum(n * len(r) for n, r in self._rests.items())
        for i, tier in enumerate(self.tiers):
            shorter = self.tiers[i + 1] if i + 1 < len(self.tiers) else 0
            # A window opens with a remainder of its own tier, while there is enough to fill it.
            while total >= tier and self._lengths and self._own(tier, shorter):
                first = self._take(self._lengths[bisect_right(self._lengths, tier) - 1])
                pieces, gap = [first], tier - len(first)
                while gap:
                    at = bisect_right(self._lengths, gap)
                    if at:
                        piece = self._take(self._lengths[at - 1])
                    else:
                        piece, rest = self._take(self._lengths[0]).cut(gap)
                        self._put(rest)
                    pieces.append(piece)
                    gap -= len(piece)
                self._emit(pieces, tier)
                total -= tier

    def _own(self, tier: int, shorter: int) -> bool:
        at = bisect_right(self._lengths, tier)
        return at > 0 and self._lengths[at - 1] > shorter

    def _emit(self, pieces: list[_Rest], tier: int) -> None:
        group, missing = self._open[tier]
        if not missing:
            group, missing = self._groups, max(1, self.group_tokens // tier)
            self._groups += 1
        self._open[tier] = group, missing - 1
        offset = 0
        for p in pieces:
            self._rows.append((
                p.doc, p.start, len(p), zlib.crc32(p.ids), p.tokens,
                self._base + self._sequences, offset, tier, self._base + group,
            ))
            offset += len(p)
        self._sequences += 1


def pack(
    docs: DataFrame,
    tokenizer: str,
    tiers: tuple[int, ...] = TIERS,
    window: int = WINDOW,
    group_tokens: int = GROUP_TOKENS,
    batch: int = 64,
) -> DataFrame:
    """A row per piece (see ``SCHEMA``) of ``docs`` (``doc_id``, ``text``).

    ``tokenizer`` is the path of a vocabulary file that every executor can read.
    """
    end = END.to_bytes(4, "little")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, packer = Ids(tokenizer), Packer(TaskContext.get().partitionId(), tiers, window, group_tokens)
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

        def out():
            rows = packer.rows()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for i in range(0, b.num_rows, batch):
                for doc, text in zip(keys.slice(i, batch).to_pylist(), texts.slice(i, batch).to_pylist()):
                    packer.add(doc, ids.of(text or "") + end)
                if len(packer._rows) > 10_000:
                    yield from out()
        packer.finish()
        yield from out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)
