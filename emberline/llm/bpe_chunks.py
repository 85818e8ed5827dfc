"""BPE encoding and decoding that encodes shared stretches of text once.

Texts are cut where a rolling hash over the last bytes meets a condition, so that equal stretches of
different documents are cut alike. Chunks that several documents or places hold are encoded once, by
their digest; the rest of a text is encoded where it lies. A chunk's first and last word may belong
to a longer word, so each join is repaired: the words around it are encoded again from the text, with
a word of the chunk more, and compared with the ids that the chunk alone has there. Where both agree,
the chunk's ids begin or end; where they don't, the join is widened into the chunk, by twice as much each
time. A chunk in which no place agrees is encoded with the text around it.

Which chunks are shared is told to the tasks by a sketch of at most 8 MB, whatever the input: a bit
a digest. Where it is wrong a chunk of one document is sent around like a shared one; no id changes.

Null text counts as empty and has no ids. Repeated rows each give a row. A text with the string of a
special token is encoded as a whole. Other columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import sketch
from emberline.llm.encoding import WordUnits, encoder, tokenizer
from emberline.llm.store import Workspace
from emberline.llm.words import blocks, rolling_hashes

#: Bytes that the rolling hash sees, and the least, mean and largest size of a chunk.
WINDOW, LEAST, MEAN, MOST = 32, 256, 512, 8192
_GAPS = b" \t\n\x0b\x0c\r"
_GAP, _WORD = re.compile(rb"[ \t\n\x0b\x0c\r]"), re.compile(rb"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]*")
#: Stretches around joins whose ids one worker remembers.
KNOWN_JOINS = 20_000

PIECES = ("doc_id long, row long, seq int, digest binary, ids binary, drop_head int, drop_tail int, "
          "chunk binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """For each text the ends of its chunks; every end is that of a character."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    last = np.arange(WINDOW, len(data) + 1)
    rolled = rolling_hashes(data, last - WINDOW, last)
    places = last[(rolled & np.uint64(MEAN - 1)) == 0]
    out, start = [], 0
    for text in texts:
        stop = start + len(text)
        a, b = np.searchsorted(places, (start + WINDOW, stop))
        ends, from_ = [], start
        for place in [*places[a:b].tolist(), stop]:
            while place - from_ > MOST:
                from_ = _character(data, from_ + MOST, stop)
                ends.append(from_ - start)
            if place - from_ >= LEAST or place == stop:
                place = _character(data, place, stop)
                if place > from_:
                    ends.append(place - start)
                from_ = place
        out.append(ends)
        start = stop + 1
    return out


def _character(data: np.ndarray, place: int, stop: int) -> int:
    while place < stop and data[place] & 0xC0 == 0x80:
        place += 1
    return place


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _hashes(batches):
    for batch in batches:
        found = []
        for _, texts in blocks(_texts(batch)):
            for text, ends in zip(texts, chunk_ends(texts), strict=True):
                found += [_short(_digest(text[a:b])) for a, b in zip([0, *ends][:-1], ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["h"])


def shared_sketch(docs: DataFrame) -> np.ndarray:
    """The chunks that occur more than once, each known by 64 bits of its digest."""
    shared = docs.select("text").mapInArrow(_hashes, "h long").groupBy("h").count().where("count > 1")
    return sketch.build(shared, "h")


@lru_cache(maxsize=KNOWN_JOINS)
def _library(path: str, part: bytes) -> tuple[list[int], list[tuple[int, int]]]:
    """The ids of a stretch of text and the characters that each comes from."""
    found = tokenizer(path).encode(part.decode("utf-8"), add_special_tokens=False)
    return found.ids, found.offsets


def _cut(encoded: tuple, before: bytes) -> tuple[list[int], list[int]] | None:
    """The ids before and after the end of `before`; None if one comes from both sides of it."""
    (ids, offsets), place = encoded, len(before.decode("utf-8"))
    n = sum(end <= place for _, end in offsets)
    if any(end > place for _, end in offsets[:n]) or any(start < place for start, _ in offsets[n:]):
        return None
    return ids[:n], ids[n:]


def _last_word(part: bytes) -> int:
    """Where the last word of `part` begins."""
    part = part.rstrip(_GAPS)
    return max(part.rfind(g) for g in _GAPS) + 1


def join_head(encode, text: bytes, a: int, b: int, done: int) -> tuple[int, int] | None:
    """(place, ids of the chunk text[a:b] before it): the first place tried from which the chunk's ids are those
    that the text from `done` on has there; None if there is none."""
    if a == 0:
        return 0, 0
    place, reach = a, 0
    if not (text[a - 1] in _GAPS or text[a] in _GAPS):
        found = _GAP.search(text, a, b)
        place = found.start() if found else b
    low = done + _last_word(text[done:a]) if place < b else a
    while place < b:
        stop = _WORD.match(text, place, b).end()
        alone, joined = _cut(encode(text[a:stop]), text[a:place]), _cut(encode(text[low:stop]), text[low:place])
        if alone and joined and alone[1] == joined[1]:
            return place, len(alone[0])
        reach = max(2 * reach, stop - a)
        found = _GAP.search(text, a + reach, b)
        place = found.start() if found else b
    return None


def join_tail(encode, text: bytes, a: int, b: int) -> tuple[int, int] | None:
    """(place, ids of the chunk text[a:b] after it): the last place tried up to which the chunk's ids are those of the text."""
    if b == len(text):
        return b, 0
    place, reach = b, 0
    if not (text[b - 1] in _GAPS or text[b] in _GAPS):
        place = a + max(text[a:b].rfind(g) for g in _GAPS) + 1
    high = _WORD.match(text, b).end() if place > a else b
    while place > a:
        start = a + _last_word(text[a:place])
        alone, joined = _cut(encode(text[start:b]), text[start:place]), _cut(encode(text[start:high]), text[start:place])
        if alone and joined and alone[0] == joined[0]:
            return place, len(alone[1])
        reach = max(2 * reach, b - start)
        place = a + max(text[a:max(a, b - reach)].rfind(g) for g in _GAPS) + 1
    return None


def _segments(text: bytes, ends: list[int], bits: np.ndarray, encode):
    """(bytes to encode here) or (chunk, digest, drop_head, drop_tail), in the order of the text."""
    done, out = 0, []
    cuts = list(zip([0, *ends][:-1], ends, strict=True))
    digests = [_digest(text[a:b]) for a, b in cuts]
    known = sketch.may_hold(bits, np.array([_short(d) for d in digests], np.int64)).tolist()
    for (a, b), digest, shared in zip(cuts, digests, known, strict=True):
        head = join_head(encode, text, a, b, done) if shared else None
        tail = join_tail(encode, text, a, b) if head else None
        if not tail or head[0] >= tail[0]:
            continue
        if head[0] > done:
            out.append(text[done:head[0]])
        out.append((text[a:b], digest, head[1], tail[1]))
        done = tail[0]
    if done < len(text) or not out:
        out.append(text[done:])
    return out


class _Finish:
    """Digests of the ids and of the decoded text, as the tokenizer's decode() puts it."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.plain = self.tokenizer.decoder is None
        if self.plain:
            self.token = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]

    def __call__(self, ids: np.ndarray) -> tuple[int, str, str]:
        listed = ids.tolist()
        text = b" ".join(map(self.token.__getitem__, listed)) if self.plain else self.tokenizer.decode(
            listed, skip_special_tokens=False).encode()
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_PIECE_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(),
                pa.int64(), pa.string(), pa.string()]


def _width(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def _encode_pieces(path: str, sent_bits):
    def run(batches):
        from pyspark import TaskContext

        engine, finish, width, bits = encoder(WordUnits, path), _Finish(path), _width(path), sent_bits.value
        library = lambda part: _library(path, part)
        row, sent = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for first, texts in blocks(_texts(batch)):
                cut = [[t] if engine.odd(t) else _segments(t, ends, bits, library)
                       for t, ends in zip(texts, chunk_ends(texts), strict=True)]
                local = iter(engine.texts([s for segments in cut for s in segments if isinstance(s, bytes)]))
                rows = []
                for doc_id, segments in zip(ids_of[first:first + len(texts)], cut, strict=True):
                    row += 1
                    if len(segments) == 1 and isinstance(segments[0], bytes):
                        rows.append((doc_id, row, 0, None, None, None, None, None, *finish(next(local))))
                        continue
                    for seq, s in enumerate(segments):
                        if isinstance(s, bytes):
                            rows.append((doc_id, row, seq, None, next(local).astype(width).tobytes(), *[None] * 6))
                        else:
                            text, digest, head, tail = s
                            rows.append((doc_id, row, seq, digest, None, head, tail,
                                         None if digest in sent else text, None, None, None))
                            sent.add(digest)
                if len(sent) > 200_000:
                    sent.clear()
                yield _batch(rows, _PIECE_NAMES, _PIECE_KINDS)
    return run


def _encode_chunks(path: str):
    def run(batches):
        engine, width = encoder(WordUnits, path), _width(path)
        for batch in batches:
            rows, digests = [], batch.column("digest").to_pylist()
            for first, texts in blocks(batch.column("chunk").to_pylist()):
                rows += [(digests[first + i], ids.astype(width).tobytes()) for i, ids in enumerate(engine.texts(texts))]
            yield _batch(rows, ["digest", "ids"], [pa.binary(), pa.binary()])
    return run


def _join_pieces(path: str):
    def run(batches):
        finish, width = _Finish(path), _width(path)
        held, doc_id, parts = None, None, []

        def whole():
            return (doc_id, *finish(np.frombuffer(b"".join(parts), width)))

        for batch in batches:
            rows = []
            for d, row, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "ids")), strict=True):
                if row != held and held is not None:
                    rows.append(whole())
                    parts = []
                held, doc_id = row, d
                parts.append(ids)
            yield _batch(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                         [pa.int64(), pa.int64(), pa.string(), pa.string()])
        if held is not None:
            yield _batch([whole()], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                         [pa.int64(), pa.int64(), pa.string(), pa.string()])
    return run


def _shared_ids(pieces: DataFrame, path: str) -> DataFrame:
    """(doc_id, row, seq, ids) of the shared chunks where they occur, each chunk encoded once."""
    chunks = pieces.where("chunk is not null").select("digest", "chunk").dropDuplicates(["digest"])
    codes = chunks.mapInArrow(_encode_chunks(path), "digest binary, ids binary")
    size = 2 if _width(path) == "<u2" else 4
    return pieces.where("digest is not null").drop("ids").join(codes, "digest").select("doc_id", "row", "seq", F.expr(
        f"substring(ids, 1 + {size} * drop_head, greatest(0, octet_length(ids) - {size} * (drop_head + drop_tail)))").alias("ids"))


def _pieces(docs: DataFrame, path: str, work: Workspace) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(shared_sketch(docs))
    pieces = work.table(docs.mapInArrow(_encode_pieces(path, bits), PIECES), "pieces")
    bits.unpersist()
    return pieces


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, for a tokenizer at `path`
    that drops white space.

    Texts are read twice and not shuffled. What moves are the digests, the distinct shared chunks and
    the ids of documents that hold one.
    """
    with Workspace(docs.sparkSession) as work:
        pieces = _pieces(docs, path, work)
        local = pieces.where("ids is not null").select("doc_id", "row", "seq", "ids")
        joined = local.union(_shared_ids(pieces, path)).repartition("row").sortWithinPartitions("row", "seq").mapInArrow(
            _join_pieces(path), RESULT)
        whole = pieces.where("n_tokens is not null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
        return work.result(whole.union(joined))


def reuse(docs: DataFrame, path: str) -> DataFrame:
    """One row: n_ids, the ids of all documents, n_reused, those taken from shared chunks, and n_chunks, the chunks
    encoded for them."""
    with Workspace(docs.sparkSession) as work:
        pieces = _pieces(docs, path, work)
        size = 2 if _width(path) == "<u2" else 4
        count = F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)).cast("long")
        own = pieces.agg((F.coalesce(F.sum("n_tokens"), F.lit(0)) + count / size).cast("long").alias("n_own"),
                         F.countDistinct("digest").alias("n_chunks"))
        taken = _shared_ids(pieces, path).agg((count / size).cast("long").alias("n_reused"))
        return work.result(own.crossJoin(F.broadcast(taken)).select(
            (F.col("n_own") + F.col("n_reused")).alias("n_ids"), "n_reused", "n_chunks"))
