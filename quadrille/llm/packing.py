"""Packing documents into sequences of a fixed length.

Documents are dealt at random to groups, and each group is packed by itself: first-fit decreasing, where a
tournament tree over the bins' free room finds the first bin that holds a piece. What first fit leaves open is then
filled by cutting the pieces of the emptiest bins, and the last bin, by cutting it at powers of two, whose sequences
need no padding. A group is never larger than its bound, whatever repeats among the rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Memo, partitions, quoted, read, slices, written

LENGTH, END, GROUP_DOCS = 4096, 2, 1_000
#: Groups that one task packs on average, and ids that are dealt copy by copy at most.
TASK_GROUPS, HOT_IDS = 32, 10_000

# How the tokenizer file cuts a text into pieces, after normalisation and lower-casing.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Strings that the tokenizer or Python treats apart: such texts go through the tokenizer itself.
APART = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Words of ASCII and of whole Latin, Greek, Cyrillic and Han letters, which no normalisation changes and whose lower case is one letter.
SIMPLE = regex.compile(r"[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u0391-\u03a1\u03a4-\u03a9\u03b1-\u03c9\u0410-\u044f\u4e00-\u9fa5]+")


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Ids:
    """Token ids of whole texts as little-endian bytes, from memos of words and pieces.

    A piece never spans white space, so a text's ids are those of its words, and few words are new. Words that are not
    SIMPLE go through the tokenizer itself, so its normalisation and its tables of characters hold. An id takes 16 bits
    where the vocabulary allows and else 32: kind. Each process has one object a tokenizer file; its memos are bounded.
    """

    made: dict[str, Ids] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.kind = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.model, self.bytes, self.cut = self.whole.model, byte_table(), regex.compile(PIECE)
        self.pieces = Memo(self.of_piece, 400_000)
        self.words = Memo(self.of_word, 700_000)

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def of_piece(self, piece: str) -> bytes:
        return array(self.kind, [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes))]).tobytes()

    def of_text(self, text: str) -> bytes:
        return array(self.kind, self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def of_word(self, word: str) -> bytes:
        if not SIMPLE.fullmatch(word):
            return self.of_text(word)
        low = word.lower()
        if low.isalpha():
            return self.pieces[low]
        if low[-1] in ".,;:!?" and low[:-1].isalpha():
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return b"".join([self.pieces[p] for p in self.cut.findall(low)])

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in APART):
            return self.of_text(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def tokenised(path: str, end: int) -> Callable:
    """Rows (id, grp, text) to (id, grp, ids): ids of the text and, last, the end id, as little-endian bytes of Ids.kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.of(path)
        last = array(ids.kind, [end]).tobytes()
        for batch in slices(batches):
            found = [ids(t.as_py() or "") + last for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("grp"), pa.array(found, pa.binary())], ["id", "grp", "ids"])

    return run


class Tournament:
    """The free room of bins at the leaves, the larger of two rooms above them."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)
        self.used = 0

    def first(self, size: int) -> int:
        """The first bin with room for size, which then has so much less."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        bin_ = i - self.leaves
        room[i] -= size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        self.used = max(self.used, bin_ + 1)
        return bin_


Piece = tuple[int, int, int]  # document, start, length


def first_fit(lengths: list[int], length: int) -> list[list[Piece]]:
    """Bins of pieces: whole sequences cut off long documents, then first-fit decreasing of the rest.

    Documents are taken by falling length, ties in their given order.
    """
    full: list[list[Piece]] = []
    rest: list[Piece] = []
    for d, n in enumerate(lengths):
        whole = n // length * length
        full += [[(d, at, length)] for at in range(0, whole, length)]
        if n > whole:
            rest.append((d, whole, n - whole))
    rest.sort(key=lambda p: (-p[2], p[0]))
    tree = Tournament(len(rest), length) if rest else None
    bins: list[list[Piece]] = [[] for _ in rest]
    for piece in rest:
        bins[tree.first(piece[2])].append(piece)
    return full + bins[: tree.used if tree else 0]


def _take(pieces: list[Piece], n: int) -> list[Piece]:
    """The first n tokens of a bin, taken out of it; a piece may be cut."""
    out = []
    while n:
        d, at, size = pieces[0]
        if size <= n:
            out.append(pieces.pop(0))
        else:
            out.append((d, at, n))
            pieces[0] = (d, at + n, size - n)
        n -= out[-1][2]
    return out


def filled(bins: list[list[Piece]], length: int) -> list[list[Piece]]:
    """The same tokens without padding: the emptiest bins fill the fullest, and the last is cut at powers of two."""
    size = lambda b: sum(p[2] for p in b)
    done = [b for b in bins if size(b) == length]
    part = sorted((b for b in bins if size(b) < length), key=size)
    low, high = 0, len(part) - 1
    while low < high:
        given = _take(part[low], min(length - size(part[high]), size(part[low])))
        part[high] += given
        if size(part[high]) == length:
            done.append(part[high])
            high -= 1
        if not part[low]:
            low += 1
    if low == high and part[low]:
        left = size(part[low])
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                done.append(_take(part[low], 1 << bit))
    return done


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _packed(kids: list, ids: list[bytes], first: int, kind: str, length: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of one group; its sequences are numbered from first on."""
    order = sorted(range(len(ids)), key=lambda i: (kids[i] is None, kids[i] or 0, ids[i]))
    docs = [np.frombuffer(ids[i], "<u2" if kind == "H" else "<u4").astype("<u4") for i in order]
    cols: list[list] = [[] for _ in range(8)]
    for s, pieces in enumerate(filled(first_fit([len(d) for d in docs], length), length)):
        offset = 0
        for d, at, n in pieces:
            piece = docs[d][at : at + n].tobytes()
            row = (kids[order[d]], at, n, zlib.crc32(piece), len(docs[d]), first + s, offset, piece if with_ids else None)
            for c, x in zip(cols, row, strict=True):
                c.append(x)
            offset += n
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], names=[x.split()[0] for x in OUT.split(", ")])


def _packer(path: str, length: int, group_docs: int, with_ids: bool) -> Callable:
    """Rows (id, grp, ids) in the order of grp to pieces; more than group_docs rows of one grp are several groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = Ids.of(path).kind
        kids, ids, now, taken = [], [], None, 0

        def done() -> pa.RecordBatch:
            nonlocal kids, ids, taken
            out = _packed(kids, ids, (now << 32) + taken, kind, length, with_ids)
            taken = pc.max(out.column("sequence_id")).as_py() + 1 - (now << 32)
            kids, ids = [], []
            return out

        for batch in slices(batches, "ids"):
            for kid, grp, one in zip(*(batch.column(c).to_pylist() for c in ("id", "grp", "ids")), strict=True):
                if ids and (grp != now or len(ids) >= 2 * group_docs):
                    yield done()
                if grp != now:
                    now, taken = grp, 0
                kids.append(kid)
                ids.append(one)
        if ids:
            yield done()

    return run


def _dealt(rows: DataFrame, total: int, groups: int, group_docs: int) -> DataFrame:
    """(id, text, grp) of rows (id, text): groups by a hash of both and, for ids that fill groups by themselves, of the copy.

    Such an id, at most HOT_IDS of them, has more than group_docs rows and more than one in HOT_IDS of all; its rows of
    equal texts are counted, which Spark does inside each partition first, and then dealt one by one.
    """
    grp = lambda *c: F.pmod(F.xxhash64(*c), F.lit(groups)).cast("long").alias("grp")
    most = max(group_docs, total // HOT_IDS)
    hot = written(rows.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("id").alias("hot")), "pack-hot")
    if hot.isEmpty():
        return rows.select("id", "text", grp("id", "text"))
    marked = rows.join(F.broadcast(hot.withColumn("many", F.lit(True))), F.col("id").eqNullSafe(F.col("hot")), "left")
    few = marked.where("many IS NULL").select("id", "text", grp("id", "text"))
    counted = marked.where("many").groupBy("id", "text").agg(F.count("*").alias("n"))
    copies = counted.repartition(partitions(rows), "id", "text").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return few.unionAll(copies.select("id", "text", grp("id", "text", "nth")))


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, group_docs: int = GROUP_DOCS, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence; ids: the piece's ids as little-endian 32-bit numbers.

    A document is its ids by the tokenizer file, then the id end. Null and empty texts are that id alone. Documents
    with null ids or with ids that repeat are packed row by row like all others, and ties in length follow the id.
    Groups are dealt by a hash, about group_docs rows each; rows that repeat id and text are spread over groups too,
    and a task holds at most twice group_docs rows at a time. The exchange has a partition for every TASK_GROUPS groups.
    sequence_id is the group's number times 2**32 plus the sequence's in it. An empty table gives no rows.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    total = rows.count()
    groups = max(1, -(-total // group_docs))
    ids = _dealt(rows, total, groups, group_docs).select("id", "grp", "text").mapInArrow(tokenised(tokenizer, end), "id long, grp long, ids binary")
    tasks = max(1, min(groups, max(partitions(docs), -(-groups // TASK_GROUPS))))
    return ids.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(_packer(tokenizer, length, group_docs, with_ids), OUT)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")
