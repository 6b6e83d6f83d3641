"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import rows_of

#: The split pattern that byte-level vocabularies of this family were made with.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries a worker remembers before it starts afresh; bounds memory, not results.
REMEMBERED = 1_200_000


class PairMerger:
    """Counts byte-pair tokens of strings under one vocabulary's merge list."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only plain byte-level BPE vocabularies are supported")
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.byte = [number(c) for c in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((number(a), number(b)), (rank, number(a + b)))
        special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.double = regex.compile(r" (?=\s)")
        self.known = _Remembered(self)

    def piece(self, raw: bytes) -> int:
        """Initial symbols minus merges of one pre-token."""
        symbols: list[int] = [self.byte[b] for b in raw]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = merges.get((made, symbols[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], made))
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
        return left

    def fragment(self, text: str) -> int:
        return sum(self.piece(p.encode()) for p in self.pieces.findall(text))

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings.

        No token reaches across a single space that a non-space follows, so a text without
        other runs of spaces is the sum of its space-separated fragments, each remembered.
        """
        if not text:
            return 0
        if self.double.search(text) or text[-1] == " ":
            known = self.known
            return sum(map(known.__getitem__, self.pieces.findall(text)))
        head, *rest = text.split(" ")
        known = self.known
        return (self.fragment(head) if head else 0) + sum(map(known.__getitem__, map(" ".__add__, rest)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        total = at = 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:] if at else text)


class _Remembered(dict):
    def __init__(self, merger: PairMerger):
        super().__init__()
        self.merger = merger

    def __missing__(self, text: str) -> int:
        n = self.merger.fragment(text)
        if len(text) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = n
        return n


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def merger(vocabulary: str) -> PairMerger:
    return PairMerger(vocabulary)


def vocabulary_path(name: str) -> str:
    """A vocabulary's file: ``name`` itself if it has a folder, else the installed file of that name."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    Null texts count as empty (0 bytes, 0 tokens). Special strings of the vocabulary count one
    token each. Whole texts are counted however long; a pre-token of n bytes takes O(n log n).
    Repeated rows and rows without an id are counted each. Rows are counted where they are
    read: no shuffle. A worker remembers ``REMEMBERED`` fragments at most.
    """

    def run(batches):
        m = merger(vocabulary_path(vocabulary))
        for b in rows_of(batches):
            texts = b.column("text").to_pylist()
            n = [m.count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
