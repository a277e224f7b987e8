"""Best-fit packing of tokenized documents into fixed-length sequences, with certified bin counts.

Round 0 deals all pieces to partitions by a hash of their row number and packs each by best-fit decreasing. A
dual-feasible-function bound (every f with sum f(x) <= 1 whenever sum x <= 1 bounds the bins from below) certifies each
partition: where the bins equal the bound nothing can be gained and the partition is closed, but for its emptiest bin.
Elsewhere the fullest bins are closed and the documents of the others go to an exchange: they are dealt anew and packed
again, round after round, until every partition is certified or a round saves no sequence. Each row carries its
partition's bins and bound.

A partition's pieces are bounded by a parameter (dealt by row number, so no source, document, repeated row or missing id
makes one large), and each round shuffles only what still has gaps, a few dozen bytes a piece.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, table

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


#: Words beyond printable ASCII on which the vocabulary's normalizer does nothing but lower-case: the letters of Latin-1 too.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: How the vocabulary cuts a word before merging (a fixed value of its file).
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_WORD_END = "</w>"
_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def _byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte: itself where Latin-1 shows it, else the next from U+0100 on."""
    shown = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


def _merger(path: str) -> tuple:
    """The vocabulary's merges as ranks over bytes, a zero byte standing for its word end, and each rank's id.

    A byte and the word end are one symbol there, so those pairs merge before all others.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = _byte_alphabet()
    byte = {c: b for b, c in shown.items()}
    ranks, ids = {bytes([b]): b for b in range(256)}, np.zeros(512 + len(model["merges"]), dtype="<u4")
    for b in range(1, 256):
        ranks[bytes([b, 0])] = 255 + b
        ids[b], ids[255 + b] = model["vocab"][shown[b]], model["vocab"][shown[b] + _WORD_END]
    for k, pair in enumerate(model["merges"], 512):
        token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
        ranks[bytes(byte[c] for c in token.removesuffix(_WORD_END)) + (b"\0" if token.endswith(_WORD_END) else b"")] = k
        ids[k] = model["vocab"][token]
    return tiktoken.Encoding("word-ends", pat_str=r"[^\x00\n]*\x00|\n", mergeable_ranks=ranks, special_tokens={}), ids


class WordCache:
    """Token ids of texts as little-endian uint32 bytes, looked up by white-space-delimited word.

    The vocabulary's patterns never cross ASCII white space, so a text's ids are its words' ids in a row. The words of a
    batch that are met for the first time are cut by the vocabulary's own pattern and merged in one call; words beyond
    plain Latin letters, marks and digits go through the whole tokenizer. The cache is emptied when it holds ``limit`` words.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tok, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.merger, self.ids = _merger(path)

    def _learn(self, new: list[bytes]) -> None:
        known, plain, texts = self.known, [], []
        for w in new:
            text = w.decode("utf-8", "replace")
            if (text.isprintable() if text.isascii() else _PLAIN.fullmatch(text)) and "<|" not in text:
                plain.append(w)
                texts.append(text)
            else:
                known[w] = np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if plain:
            got = self.merger.encode_to_numpy(_CUT.sub("\\g<0>\0", "\n".join(texts).lower()) + "\n")
            ids, ends = self.ids[got].tobytes(), np.flatnonzero(got == ord("\n"))
            for w, a, b in zip(plain, [0, *(4 * ends[:-1] + 4).tolist()], (4 * ends).tolist(), strict=True):
                known[w] = ids[a:b]

    def encode_all(self, texts: list[str | None], at_once: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text; about ``at_once`` bytes of text are split and looked up at a time, however long a text is."""
        held, ready, size = [], [], 0  # lists of words with their text's place; ids of texts that are not ended
        for t in texts:
            data = t.encode("utf-8", "surrogatepass") if t else b""
            at = 0
            while True:
                cut = _SPACE.search(data, at + at_once) if len(data) - at > at_once else None
                held.append((data[at : cut.start()].split() if cut else (data[at:] if at else data).split(), not cut))
                size += (cut.start() if cut else len(data)) - at
                if size >= at_once:
                    yield from self._look_up(held, ready)
                    held, size = [], 0
                if not cut:
                    break
                at = cut.start()
        yield from self._look_up(held, ready)

    def _look_up(self, held: list[tuple[list[bytes], bool]], ready: list[bytes]) -> Iterator[bytes]:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = set(chain.from_iterable(words for words, _ in held)).difference(known)
        if new:
            self._learn(list(new))
        for words, ended in held:
            ready.append(b"".join([known[w] for w in words]))
            if ended:
                yield ready[0] if len(ready) == 1 else b"".join(ready)
                ready.clear()

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut only beyond ``capacity``.

    A null or empty text is a lone end id; null ids are kept; repeated rows come as often as they are there; other
    columns are not read; an empty table gives no rows. One text's ids are held at a time, four bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path is None:
            import public_tokenizers

            cache = WordCache(public_tokenizers.path("word_bpe_49k.json"))
        else:
            cache = WordCache(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(cache.encode_all(b.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            kind = pa.int64()
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, kind)), pa.array(piece, pa.int32()), pa.array(start, kind), pa.array(length, kind), pa.array(crc, kind)], list(PIECE_COLUMNS))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and each bin's fill. Residuals are small integers: a bit set finds the tightest bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    mask, fill = 0, []
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        m = mask >> n
        if m:
            room = n + (m & -m).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            open_at[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(fill, dtype=np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions over the length histogram."""
    if not len(lengths):
        return 0
    x, n = np.unique(lengths, return_counts=True)
    best = -(-int((x * n).sum()) // capacity)
    for a in x[x <= capacity // 2].tolist():  # f(x) = capacity beyond capacity - a, 0 below a, x between
        f = np.where(x > capacity - a, capacity, np.where(x < a, 0, x))
        best = max(best, -(-int((f * n).sum()) // capacity))
    for k in range(1, 21):  # u_k: x if (k + 1) x is whole, else floor((k + 1) x) / k
        up = (k + 1) * x
        whole = up % capacity == 0
        # in units of capacity * k, to stay in integers
        f = np.where(whole, x * k, up // capacity * capacity)
        best = max(best, -(-int((f * n).sum()) // (capacity * k)))
    return best


def _packer(r: int, parts: int, capacity: int):
    """What packs one partition in round ``r`` of ``parts`` partitions."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.drop_columns(["part_"]).sort_by([("length", "descending"), ("row_", "ascending")])
        n = t["length"].to_numpy()
        bins, offsets, fill = best_fit_decreasing(n, capacity)
        bound = lower_bound(n, capacity)
        gap = len(fill) - bound
        is_open = np.zeros(len(fill), dtype=bool)
        if gap and not (r and parts == 1):  # release every bin with room, and enough full ones' worth of short pieces to fill it
            by_fill = np.argsort(fill, kind="stable")
            room = np.cumsum(capacity - fill[by_fill])
            some = max(int((fill < capacity * 0.98).sum()), min(len(fill), 4 * gap), int(np.searchsorted(room, capacity)) + 1)
            is_open[by_fill[:some]] = True
        elif parts > 1:  # certified: only its emptiest bin may still fill up with those of others
            is_open[np.argmin(fill)] = fill.min() < capacity
        t = t.append_column("sequence_id", pa.array((r << 56) + (key[0].as_py() << 24) + bins)).append_column("offset", pa.array(offsets))
        for name, value in (("round", np.int32(r)), ("part_bins", np.int64(len(fill))), ("part_bound", np.int64(bound))):
            t = t.append_column(name, pa.array(np.full(len(n), value)))
        return t.append_column("open", pa.array(is_open[bins]))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = 40_000) -> DataFrame:
    """Rows of ``pieces`` with sequence_id, offset, round, part_bins and part_bound.

    Equal rows are placed one by one; no row is dropped; an empty table gives no rows. ``per_partition`` bounds what one
    task packs (on average; the deal is a hash of a row number). round is that in which a row's sequence was closed;
    part_bins sequences were made there of its partition's pieces, which need part_bound at least: where the two are
    equal, the partition is certified. Rounds end when nothing is left open or the last one saved no sequence.
    """
    schema = PIECES + ", row_ long, sequence_id long, offset long, round int, part_bins long, part_bound long, open boolean"
    live = numbered = durable(pieces.select(*PIECE_COLUMNS, F.monotonically_increasing_id().alias("row_")), "pieces")
    done, r, before = [], 0, None
    while True:
        parts = max(1, -(-live.count() // per_partition))
        dealt = live.withColumn("part_", F.pmod(F.xxhash64("row_", F.lit(r)), F.lit(parts)).cast("long"))
        packed = durable(dealt.groupBy("part_").applyInArrow(_packer(r, parts, capacity), schema), "packed")
        if before is not None and packed.select("sequence_id").distinct().count() >= before.select("sequence_id").distinct().count():
            done.append(before)  # nothing saved: what the round before had made stays
            discard(packed)
            break
        done.append(packed.where("not open"))
        live = before = packed.where("open")
        if parts == 1 and r or live.isEmpty():
            break
        live, r = live.select(*PIECE_COLUMNS, "row_"), r + 1
    discard(numbered)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.drop("row_", "open")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, **options: int) -> DataFrame:
    """Tokenize and pack: rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset, round, part_bins, part_bound).

    Null and empty texts are a lone end id; repeated rows are packed as often as they come; null ids are kept; other
    columns are not read.
    """
    return pack(tokenize(docs, tokenizer_path, capacity=capacity), capacity, **options)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
