"""Token ids of all documents as Simple-8b files, in ascending order of document id.

A file holds a range of documents: blocks of ``BLOCK`` ids, each packed on its own (``simple8b``), then a footer:

    magic | words and tail of block 0 | words and tail of block 1 | ... | footer | footer's place, its crc32, magic

All numbers are little-endian 64-bit. The footer holds the numbers of documents and blocks and the block size, then per
document its id, whether it has one, and its number of ids, then per block the place of its words, the length of its tail
and the crc32 of both. Places per block let a reader begin anywhere, and it unpacks all words of a selector at once.

Files are written by tasks below the shared folder ``spark.checkpoint.dir``, each attempt under a name of its own; the
manifest names those of attempts that ended, so a repeated or lost task leaves no wrong data behind.
"""

from __future__ import annotations

import functools
import itertools
import operator
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import common, simple8b
from tabloom.session import staging_path

MAGIC = b"TBS8B\x001\n"
BLOCK = 1 << 15
READ_BLOCKS = 16
END_ID = 2
KEPT = 1 << 20
BYTES = 1 << 23
TOKENIZER = "byte_bpe_50k.json"
_BLANK = r"\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}"
_GLUE = "\0"
_ODD = f"[{_BLANK}] |\\x00"
_LINE_END = f"([^{_BLANK}]\\n)([^{_BLANK}])"
_MARKS = ".,;:!?"
_MARKED = rf"([\p{{L}}\p{{N}}])([{_MARKS}])"
_WORD = re.compile(r"\S+")
_BEFORE = re.compile(r"(?<=\S)(?= )")


def write_file(out, docs: Iterable[tuple[int | None, np.ndarray]], block: int = BLOCK) -> tuple[int, int]:
    """Write (id, token ids) pairs to the open stream ``out``; returns how many documents and ids that were.

    No more than a block and one document is held; the footer grows by 24 bytes a document.
    """
    ids: list[int | None] = []
    sizes: list[int] = []
    index: list[tuple[int, int, int]] = []
    waiting: list[np.ndarray] = []
    held = place = 0

    def flush(values: np.ndarray) -> None:
        nonlocal place
        words, tail = simple8b.encode(values)
        data = words.astype("<u8").tobytes() + tail.astype("<u8").tobytes()
        out.write(data)
        index.append((place, len(tail), zlib.crc32(data)))
        place += len(words) + len(tail)

    out.write(MAGIC)
    for key, tokens in docs:
        ids.append(key)
        sizes.append(len(tokens))
        waiting.append(np.asarray(tokens))
        held += len(tokens)
        if held >= block:
            values = np.concatenate(waiting)
            whole = held // block * block
            for a in range(0, whole, block):
                flush(values[a:a + block])
            waiting, held = [values[whole:]], held - whole
    if held:
        flush(np.concatenate(waiting))
    index.append((place, 0, 0))
    head = np.array([len(ids), len(index) - 1, block], "<i8")
    known = np.array([k is not None for k in ids], "<i8")
    footer = b"".join(p.tobytes() for p in (
        head, np.array([k or 0 for k in ids], "<i8"), known, np.array(sizes, "<i8"), np.array(index, "<i8").T.copy()))
    out.write(footer)
    out.write(np.array([len(MAGIC) + 8 * place, zlib.crc32(footer)], "<i8").tobytes() + MAGIC)
    return len(ids), sum(sizes)


def read_file(source, blocks: int = READ_BLOCKS) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, token ids) of each document of a seekable file, some blocks at a time."""
    source.seek(source.size() - 24)
    end = source.read(24)
    source.seek(0)
    if source.read(8) != MAGIC or end[16:] != MAGIC:
        raise ValueError("not a token file")
    at, check = np.frombuffer(end[:16], "<i8").tolist()
    source.seek(at)
    footer = source.read(source.size() - 24 - at)
    if zlib.crc32(footer) != check:
        raise ValueError("the footer is damaged")
    numbers = np.frombuffer(footer, "<i8")
    n, n_blocks, block = numbers[:3].tolist()
    ids, known, sizes = numbers[3:3 + 3 * n].reshape(3, n)
    place, tails, sums = numbers[3 + 3 * n:].reshape(3, n_blocks + 1)
    total = int(sizes.sum())
    rest, doc = np.zeros(0, np.uint64), 0
    for a in range(0, max(n_blocks, 1), blocks):
        parts = [rest]
        b = min(a + blocks, n_blocks)
        source.seek(len(MAGIC) + 8 * int(place[a]))
        data = source.read(8 * int(place[b] - place[a]))
        for i in range(a, b):
            own = data[8 * int(place[i] - place[a]):8 * int(place[i + 1] - place[a])]
            if zlib.crc32(own) != sums[i]:
                raise ValueError(f"block {i} is damaged")
            words = np.frombuffer(own, "<u8")
            cut = len(words) - int(tails[i])
            parts.append(simple8b.decode(words[:cut], words[cut:], min(block, total - i * block)))
        rest, used = np.concatenate(parts), 0
        while doc < n and used + sizes[doc] <= len(rest):
            yield (int(ids[doc]) if known[doc] else None), rest[used:used + int(sizes[doc])]
            used += int(sizes[doc])
            doc += 1
        rest = rest[used:]


def pieces(text: str) -> list[str]:
    """A text cut before every blank that follows another character than white space.

    A byte-level tokenizer of this kind cuts there in any case, whatever comes before, so the ids of the pieces one
    after another are those of the text. A stretch without such a blank stays whole.
    """
    return _BEFORE.split(text) if text else []


def _byte_spelling() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the others from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


_SPELLING = _byte_spelling()


class Coder:
    """Ids of texts by a tokenizer file, given by its path or by its name among the public vocabularies of the worker.

    Words come again and again, so the ids of pieces are kept: each piece goes through the tokenizer once as long as it is
    remembered. When the memory holds ``KEPT`` pieces, those of the last texts stay, or none if they are over half of that;
    one batch may go beyond that.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.isabs(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(name)
        self.line_feed, = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.begin: dict[str, int] = {}
        self.after: dict[str, int] = {}
        self.pieces = self.used = 0
        self.ids, self.end = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _forget(self, recent: np.ndarray) -> None:
        """Keep no pieces but those at the places ``recent``."""
        stay = np.unique(recent)
        if len(stay) > KEPT // 2:
            stay = stay[:0]
        size = self.end[stay + 1] - self.end[stay]
        self.ids, self.end = self._gather(stay, size), np.append(0, np.cumsum(size))
        number = np.full(self.pieces, -1)
        number[stay] = np.arange(len(stay))
        number = number.tolist()
        self.begin = {piece: number[i] for piece, i in self.begin.items() if number[i] >= 0}
        self.after = {piece: number[i] for piece, i in self.after.items() if number[i] >= 0}
        self.pieces, self.used = len(stay), len(self.ids)

    def _coded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in a row, and how many each has.

        A call for a piece costs far more than the piece. Pieces of one word are therefore joined by line feeds, which
        such a tokenizer gives an id of their own there.
        """
        if not _WORD.fullmatch(new[0].removeprefix(" ")):
            coded = [c.ids for c in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            return np.array([*itertools.chain.from_iterable(coded)], np.uint32), np.array([*map(len, coded)], np.int64)
        whole, = self.tokenizer.encode_batch_fast(["\n".join(new)], add_special_tokens=False)
        joined = np.array(whole.ids, np.uint32)
        gap = joined == self.line_feed
        stop = np.append(np.flatnonzero(gap), len(joined))
        return joined[~gap], np.diff(stop, prepend=-1) - 1

    def _spelled(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of letters alone, which are one word to the model: it gets them as it spells bytes."""
        spelled = "\n".join(new).encode("utf-8", "surrogatepass").decode("latin-1").translate(_SPELLING).split(_SPELLING[10])
        tokenize, number = self.tokenizer.model.tokenize, operator.attrgetter("id")
        ids, sizes = [], []
        for word in spelled:
            found = tokenize(word)
            sizes.append(len(found))
            ids += map(number, found)
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def _learn(self, new: list[str], known: dict[str, int], blank: str) -> None:
        """Keep the ids of new pieces.

        A word with marks or a line feed behind has the ids of the word and then those of the rest.
        """
        letters, words, other, marked = [], [], [], []
        for piece in new:
            if piece.isalpha():
                letters.append(piece)
                continue
            bare = piece[:-1] if piece[-1:] == "\n" else piece.rstrip(_MARKS)
            if len(bare) < len(piece) and bare and (bare[-1].isalnum() or piece[-1] == "\n") and _WORD.fullmatch(bare):
                marked.append((piece, bare))
            else:
                (words if _WORD.fullmatch(piece) else other).append(piece)
        if letters:
            self._keep(letters, *self._spelled([blank + p for p in letters]), known)
        for part in (words, other):
            for a in range(0, len(part), 4096):
                self._keep(part[a:a + 4096], *self._coded([blank + p for p in part[a:a + 4096]]), known)
        if marked:
            place = np.stack([self._places([bare for _, bare in marked], blank),
                              self._places([piece[len(bare):] for piece, bare in marked], "")], 1).ravel()
            size = self.end[place + 1] - self.end[place]
            self._keep([piece for piece, _ in marked], self._gather(place, size), size.reshape(-1, 2).sum(1), known)

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray, known: dict[str, int]) -> None:
        first, stop = self.pieces, self.used + len(ids)
        self.pieces += len(sizes)
        if stop > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(stop, np.uint32)])
        if self.pieces >= len(self.end):
            self.end = np.concatenate([self.end, np.zeros(self.pieces, np.int64)])
        self.ids[self.used:stop] = ids
        self.end[first + 1:self.pieces + 1] = self.used + np.cumsum(sizes)
        known.update(zip(pieces, range(first, self.pieces)))
        self.used = stop

    def _gather(self, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The ids of pieces one after another."""
        return self.ids[np.repeat(self.end[place] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def _places(self, found: list[str], blank: str) -> np.ndarray:
        """Where the ids of each of some pieces are, that stand behind ``blank``; new ones are learned."""
        known = self.after if blank else self.begin
        get = known.get
        place = np.fromiter(map(get, found, itertools.repeat(-1)), np.int64, len(found))
        new = np.flatnonzero(place < 0)
        if len(new):
            self._learn(list(dict.fromkeys([found[i] for i in new])), known, blank)
            place[new] = [known[found[i]] for i in new]
        return place

    def code(self, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text, with ``end_id`` behind.

        Where no blank follows white space, pieces are what stands between blanks: Arrow cuts them and numbers the different
        ones, so that only these are looked up one by one. A line feed inside such a piece, with other characters than white
        space around it, has an id of its own, so the text is cut behind it too, by a blank that is not coded. Within a
        text no other piece ends with a line feed. A mark behind a letter or digit begins a piece that is glued to it.
        """
        texts = pc.fill_null(texts, "")
        stop = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy()))
        row = 0
        while row < len(texts):
            after = max(row + 1, int(np.searchsorted(stop, stop[row] + BYTES, side="right")) - 1)
            part = texts.slice(row, after - row)
            row = after
            plain = pc.invert(pc.match_substring_regex(part, _ODD))
            lines = pc.replace_substring_regex(pc.if_else(plain, part, ""), _LINE_END, r"\1 \2")
            lines = pc.replace_substring_regex(lines, _MARKED, rf"\1 {_GLUE}\2")
            cut = pc.split_pattern(lines, " ")
            start = cut.offsets.to_numpy() - cut.offsets[0].as_py()
            named = cut.flatten().dictionary_encode()
            kinds = named.dictionary.to_numpy(zero_copy_only=False).tolist()
            at = named.indices.to_numpy()
            ended = pc.ends_with(named.dictionary, "\n").to_numpy(zero_copy_only=False)
            begin = np.append(True, ended[at[:-1]])  # what begins a text or a line has no blank before it
            begin[start[:-1]] = True
            glued = pc.starts_with(named.dictionary, _GLUE).to_numpy(zero_copy_only=False)
            place = np.zeros(len(kinds), np.int64)
            place[glued] = self._places([kinds[i][1:] for i in np.flatnonzero(glued)], "")
            used = np.flatnonzero((np.bincount(at[~begin], minlength=len(kinds)) > 0) & ~glued)
            place[used] = self._places([kinds[i] for i in used], " ")
            place = place[at]
            place[begin] = self._places([kinds[i] for i in at[begin]], "")
            count = np.diff(start)
            odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
            if len(odd):
                own = [pieces(part[int(i)].as_py()) for i in odd]
                own = [np.append(self._places(p[:1], ""), self._places([x[1:] for x in p[1:]], " ")) for p in own]
                rows = np.split(place, start[1:-1])
                for i, found in zip(odd, own):
                    rows[i], count[i] = found, len(found)
                place = np.concatenate(rows)
            size = self.end[place + 1] - self.end[place]
            found = self._gather(place, size)
            if self.pieces > KEPT:
                self._forget(place)
            for own in np.split(found, np.cumsum(size)[np.cumsum(count)[:-1] - 1]):
                yield np.append(own, np.uint32(end_id))


@functools.cache
def coder(name: str) -> Coder:
    """One per worker: loading a vocabulary takes longer than coding many a small task's texts."""
    return Coder(name)


MANIFEST = "part int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"


def write(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID,
          folder: str | None = None) -> DataFrame:
    """Write the ids of every ``text`` and return the manifest: part, file, n_docs, n_ids and n_bytes of each file.

    Documents are ordered by ``key``, null first, and rows of one key by their place in the table, so a hot key may span
    several files. A null or empty text has the end id alone. ``key`` is a whole number. An empty table has no files.
    """
    spark = docs.sparkSession
    folder = folder or staging_path(spark, "token-files")
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"),
                       F.monotonically_increasing_id().alias("r"))
    order = ["k", "r"]  # needs no text, so the ranges are found from the keys alone
    ranged = rows.repartitionByRange(*[F.asc(c) for c in order]).sortWithinPartitions(*order).select("k", "t")

    def work(batches):
        coded = functools.partial(coder(tokenizer).code, end_id=end_id)
        part = TaskContext.get().partitionId()
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        disk, root = common.file_system(folder)
        disk.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.s8b"

        def rows():
            for batch in itertools.chain([first], batches):
                yield from zip(batch.column(0).to_pylist(), coded(batch.column(1)))

        with disk.open_output_stream(f"{root}/{name}") as out:
            n_docs, n_ids = write_file(out, rows())
            n_bytes = out.tell()
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "file": f"{folder}/{name}", "n_docs": n_docs, "n_ids": n_ids, "n_bytes": n_bytes}],
            pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
                       ("n_bytes", pa.int64())]))

    return common.staged(ranged.mapInArrow(work, MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of a manifest.

    ``start`` counts the ids of all documents before it: those of earlier files from the manifest, which has a row per
    file, and those before it in its own file.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before).select("part", "file", "before")
    files = files.repartition(max(manifest.count(), 1), "part")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches):
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                disk, name = common.file_system(path)
                rows: list[tuple] = []
                with disk.open_input_file(name) as source:
                    for key, ids in read_file(source):
                        rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return files.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
