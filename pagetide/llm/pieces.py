"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

The pieces of a model file and their scores form a lattice over the text; the encoding is the path with the largest sum
of scores. Characters without a piece become byte pieces, so decoding gives back every text exactly. Blanks become
"▁" and one is put in front, as the model's files expect; a "▁" of the text itself is written as bytes.

A giant document is cut into chunks at fixed places. The state at a cut is how far a piece of the chunk before reaches
over it. A chunk yields a matrix: for each state at its begin and each at its end the best score between them. Such
matrices are combined with (max, +), which is associative: first the chunks of a block, then the blocks of a document.
From the states at block ends follow those inside the blocks, and then every chunk is traced back on its own.

No piece holds a "▁" after another character, so a path always passes where a word begins. Words between
two such places are encoded once and remembered.

Defined results: a null text has null ids; an empty text has no ids, and decodes to "". Of paths with equal score the
one with the longest last pieces is taken. Empty tables give empty results. All other columns are kept as they are;
ids, n_ids and chunks must not be among them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm import shared
from pagetide.session import stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384  # characters; texts of twice as many or more are cut
CUT = 64  # chunks in a batch, and at least in a task
BLOCK = 256  # chunks whose matrices are combined in one step
REMEMBERED = 150_000  # words of each of two generations that a worker keeps
MARK, OWN = "▁", "▁"  # a blank; OWN[0] never reaches the lattice
NONE = float("-inf")


@dataclass
class Pieces:
    """Pieces and scores of a model file: as many as the file has, fixed in advance."""

    ids: dict[str, int]
    scores: dict[str, float]
    data: list[bytes]  # of every id
    first_byte: int
    longest: int
    unknown: float
    begins: dict[str, float | None]  # every begin of a piece; the score if it is a piece
    chars: frozenset[str]  # that are pieces
    name: str  # of the model file

    def lattice(self, text: str, own: set[int], start: int, stop: int, ends: int) -> tuple[list[float], list[int]]:
        """Best scores of reaching each place from `start` by pieces that begin before `stop`, and the piece lengths.

        Places are counted from start up to `ends`; `own` are the places of a MARK that is a character of the text.
        """
        n = ends - start
        best, length = [NONE] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        begins = self.begins
        for i in range(min(stop - start, n)):
            here = best[i]
            if here == NONE:
                continue
            single = False
            at = start + i
            if at not in own:
                for k in range(1, min(self.longest, n - i) + 1):
                    if own and k > 1 and at + k - 1 in own:
                        break
                    score = begins.get(text[at : at + k], NONE)
                    if score == NONE:
                        break
                    if score is not None:
                        single = single or k == 1
                        if here + score > best[i + k] or here + score == best[i + k] and k > length[i + k]:
                            best[i + k], length[i + k] = here + score, k
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], length[i + 1] = here + self.unknown, 1
        return best, length

    def trace(self, text: str, own: set[int], start: int, length: list[int], place: int) -> list[int]:
        """Ids of the best path from start to a place."""
        out = []
        while place > 0:
            k = length[place]
            piece = text[start + place - k : start + place]
            known = self.ids.get(piece) if k > 1 or start + place - 1 not in own else None
            out += [known] if known is not None else [self.first_byte + b for b in reversed(piece.encode())]
            place -= k
        return out[::-1]

    def best_ids(self, word: str) -> bytes:
        """Ids (int32) of the best path through a word without marks of its own."""
        n = len(word)
        if not self.chars.issuperset(word):
            _, length = self.lattice(word, set(), 0, n, n)
            return _raw(self.trace(word, set(), 0, length, n))
        best, last = [0.0] + [NONE] * n, [(0, b"")] * (n + 1)
        for end, piece in _matcher(self).iter(word):  # by their ends; of those with one end, longer ones come first
            score = best[end + 1 - piece[0]] + piece[1]
            if score > best[end + 1]:
                best[end + 1], last[end + 1] = score, piece
        out, place = [], n
        while place:
            piece = last[place]
            out.append(piece[2])
            place -= piece[0]
        return b"".join(reversed(out))


class Words(dict):
    """Ids of the latest words that a worker has met, and in `older` those of the generation before."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.older = pieces, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word) or self.pieces.best_ids(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


# of this worker, by model
_words: dict[str, Words] = {}
_matchers: dict[str, ahocorasick.Automaton] = {}


def _matcher(pieces: Pieces) -> ahocorasick.Automaton:
    """Finds all pieces in a text: length, score and id."""
    found = _matchers.get(pieces.name)
    if found is None:
        found = ahocorasick.Automaton()
        for piece, score in pieces.scores.items():
            found.add_word(piece, (len(piece), score, _raw([pieces.ids[piece]])))
        found.make_automaton()
        _matchers[pieces.name] = found
    return found


def _raw(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, data, first_byte = {}, {}, [], -1
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            first_byte = i if piece == "<0x00>" else first_byte
            data.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            data.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            data.append(piece.replace(MARK, " ").encode())
    if first_byte < 0:
        raise ValueError("the model has no byte pieces")
    if any(re.search(rf"[^{MARK}]{MARK}|[{LETTER}][^\w{MARK}]", p) for p in ids):
        raise ValueError("a piece reaches over the begin of a word")
    begins: dict[str, float | None] = {p[:k]: None for p in ids for k in range(1, len(p))}
    begins.update(scores)
    chars = frozenset(p for p in ids if len(p) == 1)
    return Pieces(ids, scores, data, first_byte, max(map(len, ids)), min(scores.values()) - 10, begins, chars, path)


def _marked(text: str) -> tuple[str, set[int]]:
    """The text with marks for blanks and one in front, and the places of marks that are characters of the text."""
    own = {m.start() + 1 for m in re.finditer(MARK, text)} if MARK in text else set()
    return MARK + text.replace(" ", MARK), own


# from one place that every path passes to the next: before a mark, and between a letter and what is no word character
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
WORD = re.compile(rf"(?=.){MARK}*[^{MARK}{LETTER}]*(?:[{LETTER}]++(?=\w)[^{MARK}{LETTER}]+)*[{LETTER}]*", re.DOTALL)


def _encode_part(pieces: Pieces, text: str, own: set[int], start: int, end: int) -> bytes:
    """Ids (int32) of text[start:end], where both places are passed by every path."""
    if own:
        _, length = pieces.lattice(text, own, start, end, end)
        return _raw(pieces.trace(text, own, start, length, end - start))
    words = _words.get(pieces.name)
    if words is None:
        words = _words[pieces.name] = Words(pieces)
    return b"".join(map(words.__getitem__, WORD.findall(text, start, end)))


def _id_lists(ids: list[bytes | None]) -> pa.Array:
    """An Arrow column of lists of ids."""
    sizes = np.array([len(x or b"") // 4 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(x or b"" for x in ids), np.int32)
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    missing = pa.array([x is None for x in ids], pa.bool_())
    return pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()), mask=missing)


# ---- chunks

def _passed(text: str, own: set[int], start: int, end: int) -> tuple[int, int]:
    """The first and last place in [start, end] that every path passes, or (-1, -1)."""
    if own:
        return -1, -1
    at = [m.start() + 1 for m in (re.compile(f"[^{MARK}]{MARK}").search(text, max(start - 1, 0), end),) if m]
    if not at:
        return -1, -1
    last = end
    while not (text[last - 1] == MARK and text[last - 2] != MARK):
        last -= 1
    return at[0], last - 1


def _matrix(pieces: Pieces, text: str, own: set[int], size: int, first: bool) -> np.ndarray:
    """Best score from each entry state to each exit state; `text` reaches over the chunk's `size` by what follows.

    Where all paths pass two places, what lies between adds the same to every score and is left out.
    """
    states = pieces.longest
    out = np.full((states, states), NONE)
    reach = min(len(text), size + states - 1)
    a, b = _passed(text, own, states, size)
    for s in range(1 if first else states):
        if a < 0:
            best, _ = pieces.lattice(text, own, s, size, reach)
            out[s, : reach - size + 1] = best[size - s :]
        else:
            best, _ = pieces.lattice(text, own, s, a, a)
            out[s, :] = best[-1]
    if a >= 0:
        best, _ = pieces.lattice(text, own, b, size, reach)
        tail = np.full(states, NONE)
        tail[: reach - size + 1] = best[size - b :]
        out = out + tail
    return out


def _traced(pieces: Pieces, text: str, own: set[int], size: int, s: int, t: int) -> bytes:
    """Ids of the pieces that begin in the chunk, between two states."""
    a, b = _passed(text, own, pieces.longest, size)
    if a < 0:
        _, length = pieces.lattice(text, own, s, size, size + t)
        return _raw(pieces.trace(text, own, s, length, size + t - s))
    _, length = pieces.lattice(text, own, s, a, a)
    head = pieces.trace(text, own, s, length, a - s)
    _, length = pieces.lattice(text, own, b, size, size + t)
    tail = pieces.trace(text, own, b, length, size + t - b)
    return _raw(head) + _encode_part(pieces, text, own, a, b) + _raw(tail)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product with (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _states(matrices: list[np.ndarray], s: int, t: int) -> list[int]:
    """States at the cuts of the best path from state s to state t."""
    reached = [np.where(np.arange(len(matrices[0])) == s, 0.0, NONE)]
    for m in matrices:
        reached.append((reached[-1][:, None] + m).max(axis=0))
    out = [t]
    for m, before in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        out.append(int((before + m[:, out[-1]]).argmax()))
    return out[::-1]


def _in_order(group: pa.Table, by: str) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(group.column(by).to_numpy())
    raw = group.column("matrix").to_pylist()
    size = int((len(raw[0]) / 8) ** 0.5)
    return [group.column(by)[i].as_py() for i in order], [np.frombuffer(raw[i]).reshape(size, size) for i in order]


def _block_product(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    _, matrices = _in_order(group, "chunk")
    while len(matrices) > 1:
        pairs = [_times(*matrices[i : i + 2]) for i in range(0, len(matrices) - 1, 2)]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return pa.table({"uid": [key[0].as_py()], "block": [key[1].as_py()], "matrix": [matrices[0].tobytes()]})


def _block_states(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    blocks, matrices = _in_order(group, "block")
    at = _states(matrices, 0, 0)
    return pa.table({"uid": [key[0].as_py()] * len(blocks), "block": blocks, "s": at[:-1], "t": at[1:]})


def _chunk_states(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    chunks, matrices = _in_order(group, "chunk")
    at = _states(matrices, group.column("s")[0].as_py(), group.column("t")[0].as_py())
    return pa.table({"uid": [key[0].as_py()] * len(chunks), "chunk": chunks, "s": at[:-1], "t": at[1:]})


# ---- tables

def encode(docs: DataFrame, pieces: Pieces, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs with ids (array of int), n_ids (long) and chunks (int)."""
    if chunk < 2 * pieces.longest:
        raise ValueError("chunks must be longer than two pieces")
    giant = F.coalesce(F.length("text") + 1 >= 2 * chunk, F.lit(False))
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("chunks", T.IntegerType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.few_rows(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            ids = []
            for text in column.to_pylist():
                marked, own = _marked(text) if text else ("", ())
                ids.append(None if text is None else _encode_part(pieces, marked, own, 0, len(marked)))
            ids = _id_lists(ids)
            n = ids.value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, ids, n, pa.array(np.ones(len(ids), np.int32))], [*batch.schema.names, "ids", "n_ids", "chunks"]
            )

    whole = docs.filter(~giant).mapInArrow(small, schema)
    long_docs = stage(docs.filter(giant).withColumn("uid", F.monotonically_increasing_id()), "giant")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of each chunk with what pieces that begin in it may reach; a character before tells word begins."""
        for batch in shared.few_rows(batches, 1):
            uid, text = batch.column(0)[0], f" {batch.column(1)[0].as_py()}"
            n = len(text) // chunk
            at = [i * len(text) // n for i in range(n + 1)]
            for lo in range(0, n, CUT):
                some = range(lo, min(lo + CUT, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid.as_py()] * len(some), pa.int64()), pa.array([n] * len(some), pa.int64()), pa.array(some, pa.int64()),
                     pa.array([at[i + 1] - at[i] for i in some], pa.int32()), pa.array([text[at[i] : at[i + 1] + pieces.longest] for i in some])],
                    ["uid", "n", "chunk", "size", "part"],
                )

    # one walk over each text; the chunks of a document are then spread over tasks
    total = long_docs.agg(F.sum(F.floor((F.length("text") + 1) / chunk))).first()[0] or 0
    tasks_wide = max(min(total // CUT, 2_000), total // 4_096) + 1
    cut_texts = long_docs.select("uid", "text").mapInArrow(cut, "uid long, n long, chunk long, size int, part string")
    chunks = stage(cut_texts.repartition(tasks_wide, "uid", "chunk"), "parts")

    def opened(text: str) -> tuple[str, set[int]]:
        own = {m.start() for m in re.finditer(MARK, text)} if MARK in text else set()
        return text.replace(" ", MARK), own

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.few_rows(batches):
            uid, _, at, size, part = (c.to_pylist() for c in batch.columns)
            found = [_matrix(pieces, *opened(p), k, i == 0).tobytes() for p, k, i in zip(part, size, at, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([i // BLOCK for i in at], pa.int64()), pa.array(found, pa.binary())],
                ["uid", "chunk", "block", "matrix"],
            )

    parts = stage(chunks.mapInArrow(matrices, "uid long, chunk long, block long, matrix binary"), "matrices")
    blocks = parts.groupBy("uid", "block").applyInArrow(_block_product, "uid long, block long, matrix binary")
    states = blocks.groupBy("uid").applyInArrow(_block_states, "uid long, block long, s long, t long")
    inside = parts.join(states, ["uid", "block"]).groupBy("uid", "block").applyInArrow(
        _chunk_states, "uid long, chunk long, s long, t long"
    )

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.few_rows(batches):
            uid, _, at, size, part, s, t = (c.to_pylist() for c in batch.columns)
            ids = [_traced(pieces, *opened(p), *x) for p, x in zip(part, zip(size, s, t, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _id_lists(ids)], ["uid", "chunk", "ids"])

    tasks = chunks.join(inside, ["uid", "chunk"]).select("uid", "n", "chunk", "size", "part", "s", "t")
    done = tasks.mapInArrow(traced, "uid long, chunk long, ids array<int>").groupBy("uid").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"),
        F.count("*").cast("int").alias("chunks"),
    )
    cut_up = long_docs.join(done, "uid").select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_ids"), "chunks")
    return whole.unionByName(cut_up)


def decode(encoded: DataFrame, pieces: Pieces, into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in the column `into`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = pa.array(pieces.data, pa.large_binary())
        for batch in shared.few_rows(batches):
            ids = batch.column(batch.schema.get_field_index("ids"))
            found = data.take(ids.flatten())
            _, at, raw = found.buffers()
            places = np.frombuffer(at, np.int64) if at else np.zeros(1, np.int64)
            ends = places[np.cumsum(ids.value_lengths().fill_null(0).to_numpy())].tolist()
            raw = memoryview(raw or b"")
            # the first byte is the blank put in front
            texts = [str(raw[a + 1 : b], "utf-8") for a, b in zip([0, *ends], ends)]
            out = [x if known else None for x, known in zip(texts, ids.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, into])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))
