"""Fill-in-the-middle texts from seekable compressed frames.

`framed` stores a text as independent zstandard frames of FRAME_CHARS code points, each with the numbers of
code points and of complete units (lines, or characters) before it. A cut is a number of units: the frame
that holds it is found in these counts, and only the frames of the two cuts are decompressed. `transformed`
moves all other frames as they are, in the order of the output, and compresses the pieces of the cut frames
anew, so a text of any length is handled a frame at a time. The output frames, one after another, are a valid
zstandard stream; `digests` reads them as one, in order, and rebuilds the text from what it reads.

With S the seed, h1 to h4 are the first four 8-digit groups of the hex sha256 of "S:" and the document's id.
Of n units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1), the middle after the larger. A
text is left plain if it is empty, holds one of the marks, or by its share (h3); h4 chooses between
suffix-prefix-middle and prefix-suffix-middle.

Null text counts as empty; a null id counts as an empty one. Equal rows give equal results, row by row; a line
may be longer than a frame. Columns named like those added are replaced, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.params import FRAME_CHARS

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, SHARE, SPM_SHARE = 7, 100, 50
LEVEL = 3
_FRAME = "struct<units: long, chars: long, data: binary>"
STORED = {"n": "long", "n_code_points": "long", "n_bytes": "long", "marked": "boolean", "frames": f"array<{_FRAME}>"}
MADE = {"form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "array<binary>"}
HASHED = {"output_sha256": "string", "restored_sha256": "string"}


def _with(docs: DataFrame, columns: dict[str, str], drop: tuple[str, ...], make) -> DataFrame:
    """Add columns that `make` computes from each row of a batch; `drop` names columns it uses up."""
    kept = docs.drop(*columns)
    names = [f for f in kept.columns if f not in drop]
    types = pa.schema([pa.field(c, _ARROW[c]) for c in columns])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names),
                        *(f"{c} {kind}" for c, kind in columns.items())])

    def run(batches):
        for batch in batches:
            rows = [make(row) for row in zip(*(batch.column(c) for c in make.reads), strict=True)]
            new = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, *columns])

    return kept.mapInArrow(run, schema)


_ARROW = {
    "n": pa.int64(), "n_code_points": pa.int64(), "n_bytes": pa.int64(), "marked": pa.bool_(),
    "frames": pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())])),
    "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.list_(pa.binary()),
    "output_sha256": pa.string(), "restored_sha256": pa.string()}


class _Store:
    """Text to frames with cumulative counts."""

    reads = ("text",)

    def __init__(self, unit: str, marks: tuple[str, str, str], size: int):
        self.unit, self.marks, self.size = unit, marks, size

    def __call__(self, row):
        text = row[0].as_py() or ""
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        frames, units, n_bytes = [], 0, 0
        for at in range(0, len(text), self.size):
            piece = text[at:at + self.size]
            data = piece.encode()
            frames.append({"units": units, "chars": at, "data": squeeze(data)})
            units += piece.count("\n") if self.unit == "line" else len(piece)
            n_bytes += len(data)
        if self.unit == "line" and text and not text.endswith("\n"):
            units += 1
        return units, len(text), n_bytes, any(m in text for m in self.marks), frames


def framed(docs: DataFrame, unit: str = "line", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
           size: int = FRAME_CHARS) -> DataFrame:
    """The documents with `frames` in place of `text`, the counts n (units), n_code_points and n_bytes, and `marked`.

    `marked` tells whether the text holds one of the marks, which forbids to transform it.
    """
    if unit not in ("line", "char"):
        raise ValueError("a unit is a line or a char")
    text = docs.withColumn("text", F.col("text").cast("string"))
    return _with(text, STORED, ("text",), _Store(unit, marks, size))


def _inflate(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode()


def cut_at(frames: list[dict], units: int, n: int, length: int, unit: str) -> int:
    """The code point at which the first `units` of `n` units end; decompresses one frame at most."""
    if units == 0:
        return 0
    if units == n:
        return length
    if unit == "char":
        return units
    low, high = 0, len(frames)
    while high - low > 1:  # the last frame with fewer units before it holds the end of this one
        middle = (low + high) // 2
        low, high = (middle, high) if frames[middle]["units"] < units else (low, middle)
    text, at = _inflate(frames[low]["data"]), -1
    for _ in range(units - frames[low]["units"]):
        at = text.index("\n", at + 1)
    return frames[low]["chars"] + at + 1


def between(frames: list[dict], start: int, stop: int, length: int, squeeze) -> list[bytes]:
    """Compressed frames of the code points from start to stop: whole ones as stored, cut ones anew."""
    out = []
    ends = [*(f["chars"] for f in frames[1:]), length]
    for frame, end in zip(frames, ends, strict=True):
        a, b = max(start, frame["chars"]), min(stop, end)
        if a >= b:
            continue
        whole = (a, b) == (frame["chars"], end)
        out.append(frame["data"] if whole else squeeze(_inflate(frame["data"])[a - frame["chars"]:b - frame["chars"]].encode()))
    return out


class _Transform:
    """Frames of a text to the frames of its output."""

    reads = ("doc_id", "n", "n_code_points", "marked", "frames")

    def __init__(self, unit: str, marks: tuple[str, str, str], seed: int, share: int, spm_share: int):
        self.unit, self.marks, self.seed, self.share, self.spm_share = unit, marks, seed, share, spm_share

    def __call__(self, row):
        doc_id, n, length, marked, frames = (v.as_py() for v in row)
        key = f"{self.seed}:{'' if doc_id is None else doc_id}"
        h1, h2, h3, h4 = (int(hashlib.sha256(key.encode()).hexdigest()[i:i + 8], 16) for i in (0, 8, 16, 24))
        if not length or marked or h3 % 100 >= self.share:
            return "plain", None, None, [f["data"] for f in frames]
        low, high = (cut_at(frames, h, n, length, self.unit) for h in sorted((h1 % (n + 1), h2 % (n + 1))))
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        prefix, middle, suffix = (between(frames, a, b, length, squeeze)
                                  for a, b in ((0, low), (low, high), (high, length)))
        mark_p, mark_s, mark_m = (squeeze(m.encode()) for m in self.marks)
        if h4 % 100 < self.spm_share:
            return "spm", low, high - low, [mark_s, *suffix, mark_p, *prefix, mark_m, *middle]
        return "psm", low, high - low, [mark_p, *prefix, mark_s, *suffix, mark_m, *middle]


def transformed(stored: DataFrame, unit: str = "line", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
                seed: int = SEED, share: int = SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """Stored documents with `output`, the frames of the transformed text, in place of `frames`.

    Adds form, prefix_chars and middle_chars, the last two null for plain texts. `share` and `spm_share` are percent.
    """
    return _with(stored, MADE, ("frames", "marked"), _Transform(unit, marks, seed, share, spm_share))


def stream(output: list[bytes]) -> Iterator[bytes]:
    """The output's bytes, a frame at a time."""
    inflate = zstandard.ZstdDecompressor().decompress
    return map(inflate, output)


def sections(pieces: Iterator[bytes], marks: tuple[bytes, ...]) -> Iterator[tuple[int, bytes]]:
    """(place of the section, bytes) of a stream that is divided by the marks in this order.

    What could be the beginning of the next mark is held back until more bytes decide about it.
    """
    place, held = -1, b""
    for piece in pieces:
        held += piece
        while place + 1 < len(marks) and (at := held.find(marks[place + 1])) >= 0:
            yield place, held[:at]
            held, place = held[at + len(marks[place + 1]):], place + 1
        keep = len(marks[place + 1]) - 1 if place + 1 < len(marks) else 0
        if len(held) > keep:
            yield place, held[:len(held) - keep]
            held = held[len(held) - keep:]
    yield place, held


def restored(output: list[bytes], form: str, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Iterator[bytes]:
    """The original text's bytes in order, rebuilt from the output and its form.

    The suffix stands before the middle, so the output is read twice and never held as a whole.
    """
    if form == "plain":
        yield from stream(output)
        return
    p, s, m = (x.encode() for x in marks)
    order, prefix, suffix = ((s, p, m), 1, 0) if form == "spm" else ((p, s, m), 0, 1)
    for wanted in ((prefix, 2), (suffix,)):
        yield from (data for place, data in sections(stream(output), order) if place in wanted)


class _Digest:
    """Digests of the output and of the text rebuilt from it."""

    reads = ("output", "form")

    def __init__(self, marks: tuple[str, str, str]):
        self.marks = marks

    def __call__(self, row):
        output, form = row[0].as_py(), row[1].as_py()
        return _hashed(stream(output)), _hashed(restored(output, form, self.marks))


def _hashed(pieces: Iterator[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def digests(made: DataFrame, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Transformed documents with the sha256 of output and rebuilt text in place of `output`."""
    return _with(made, HASHED, ("output",), _Digest(marks))


class _Text:
    reads = ("output",)

    def __call__(self, row):
        return (b"".join(stream(row[0].as_py())).decode(),)


def texts(made: DataFrame) -> DataFrame:
    """Transformed documents with the whole output as `text`."""
    return _with(made, {"text": "string"}, ("output",), _Text())


_ARROW["text"] = pa.string()

_UNITS = "CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END END"
#: The contract's digest columns, with whole texts in place of frames.
SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  counted AS (SELECT doc_id, t, CAST({_UNITS} AS BIGINT) AS n, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3,
    CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM docs),
  cut AS (SELECT *, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {SHARE} THEN 'plain'
      WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM counted)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM cut"""
