r"""Conversations as packed token sequences in which shared initial turns stand once.

A turn is written as `<|im_start|>role`, a line feed, the text and `<|im_end|>` with a line feed. The two marks are ids
of their own after the vocabulary's, so no text can make them. In texts and roles a control string, with any number of
backslashes after its `<`, gets one more; in roles a backslash is doubled and a line feed is written as `\n`. Both are undone
when reading.

The turns of a conversation are a path in a prefix tree, whose nodes are digests of a turn and all before it. Conversations
with equal paths are one path with a count. The paths are range-partitioned and sorted, which is the depth-first
order of the tree, however many conversations begin alike; each one then adds the turns that it does not share
with the one before it. A pack is one sequence of about `pack_tokens` tokens and complete in itself: a tree that goes on in
the next pack repeats the path to the first node there, and nothing else. Each conversation's own tokens are a
chunk of its pack with the position of its first token (how many tokens come before it in the
conversation) and the intervals of the pack that its tokens attend to besides the chunk's own earlier ones.

Rows are ordered by turn, then role, then a digest of the text; null turns come first. Null texts and roles count as empty, rows
of null id are one conversation, repeated rows are turns of their own. A conversation is put together in one task, like a
document. Texts of any length are whole; a conversation longer than a pack has a longer pack. Other columns are ignored,
an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.encoding import SpacedUnits
from emberline.llm.groups import by_key, join_by_key
from emberline.llm.params import PACK_TOKENS
from emberline.llm.words import blocks

START, END = "<|im_start|>", "<|im_end|>"
LEARNT_ROLE = "assistant"
#: Stands for a null conversation id between the steps.
NO_ID = -(1 << 63)
_SPAN = "struct<start: long, stop: long>"
PACK = ("pack long, ids array<int>, loss array<" + _SPAN + ">, chunks array<struct<leaf: binary, copies: long, n_turns: long, "
        "start: long, stop: long, position: long, attends: array<" + _SPAN + ">>>")
READ = "leaf binary, copies long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_CHUNKS = pa.list_(pa.struct([
    ("leaf", pa.binary()), ("copies", pa.int64()), ("n_turns", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
    ("position", pa.int64()), ("attends", _SPAN_TYPE)]))


def escape(text: str) -> str:
    return re.sub(r"<(\\*\|im_(?:start|end)\|>)", r"<\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*\|im_(?:start|end)\|>)", r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


class _Units(SpacedUnits):
    """Encodes special strings of the vocabulary as ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()


class Template:
    """Turns to ids and back, for the byte-level tokenizer at `path`."""

    def __init__(self, path: str):
        self.units = _Units(path)
        vocabulary = self.units.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.start, self.end = size, size + 1
        # byte-level vocabularies write printable bytes as themselves and the others from U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        self.bytes = [b""] * (size + 2)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes[self.start], self.bytes[self.end] = START.encode(), END.encode()

    def encode(self, turns: list[tuple[str, str]]) -> list[tuple[np.ndarray, int, int]]:
        """For each (role, text) the ids of the turn and where those of the text begin and end."""
        parts = [p.encode() for role, text in turns for p in (escape_role(role) + "\n", escape(text))]
        ids = [i for _, some in blocks([*parts, b"\n"]) for i in self.units.texts(some)]
        line_end, out = ids.pop(), []
        for head, body in zip(ids[0::2], ids[1::2], strict=True):
            begin = 1 + len(head)
            out.append((np.concatenate(([self.start], head, body, [self.end], line_end)).astype(np.int32), begin, begin + len(body)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def turns(self, ids: np.ndarray) -> Iterator[tuple[str, str]]:
        """The (role, text) of each marked turn."""
        for a, b in zip(np.flatnonzero(ids == self.start), np.flatnonzero(ids == self.end), strict=True):
            role, _, text = self.decode(ids[a + 1:b]).partition("\n")
            yield unescape_role(role), unescape(text)


@lru_cache(maxsize=2)
def template(path: str) -> Template:
    return Template(path)


def marked(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text and a digest of each row's role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.unhex(F.substring(F.sha2(both, 256), 1, 32)).alias("digest"))


def _chain(digests: list[bytes]) -> list[bytes]:
    """The tree's nodes on the way of these turns: each digest covers all turns up to its own."""
    out, last = [], b""
    for d in digests:
        last = hashlib.blake2b(last + d, digest_size=16).digest()
        out.append(last)
    return out


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _leaves(batches):
    schema = pa.schema([("conv", pa.int64()), ("leaf", pa.binary())])
    yield from _in_batches(((conv, _chain(t.column("digest").to_pylist())[-1]) for (conv,), t in by_key(batches, ("conv",))), schema, 4096)


def _gathered(batches):
    """One row for each conversation that is led by a marker row: its path and turns."""
    schema = pa.schema([("path", pa.binary()), ("copies", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def rows():
        for _, table in by_key(batches, ("conv",)):
            copies = table.column("copies")[0].as_py()
            if copies is not None:
                turns = table.slice(1)
                yield (b"".join(_chain(turns.column("digest").to_pylist())), copies, turns.column("role").to_pylist(), turns.column("text").to_pylist())
    yield from _in_batches(rows(), schema, 256)


def _shared(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class _Pack:
    """The sequence that is being filled, and the path to its last node."""

    def __init__(self):
        self.ids, self.size, self.loss, self.chunks, self.stack = [], 0, [], [], []

    def add(self, node: bytes, ids: np.ndarray, loss: tuple[int, int] | None) -> None:
        start, self.size = self.size, self.size + len(ids)
        self.ids.append(ids)
        if loss:
            self.loss.append({"start": start + loss[0], "stop": start + loss[1]})
        self.stack.append((node, ids, loss, start, self.size))

    def row(self, number: int) -> tuple:
        return number, np.concatenate(self.ids), self.loss, self.chunks


def _packs(path: str, limit: int):
    schema = pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", _SPAN_TYPE), ("chunks", _CHUNKS)])

    def rows(batches):
        from pyspark import TaskContext

        form = template(path)
        number, pack, before = TaskContext.get().partitionId() << 32, _Pack(), []
        for batch in batches:
            fresh, todo = [], []
            for row in batch.to_pylist():
                nodes = [row["path"][i:i + 16] for i in range(0, len(row["path"]), 16)]
                keep, before = _shared(before, nodes), nodes
                turns = list(zip(row["roles"], row["texts"], strict=True))[keep:]
                todo.append((nodes, keep, row["copies"], [r for r, _ in turns]))
                fresh += turns
            encoded = iter(form.encode(fresh))
            for nodes, keep, copies, roles in todo:
                added = [(node, *next(encoded), role == LEARNT_ROLE) for node, role in zip(nodes[keep:], roles, strict=True)]
                path_to = pack.stack[:keep]
                if pack.chunks and pack.size + sum(len(a[1]) for a in added) > limit:
                    yield pack.row(number)
                    number, pack, own = number + 1, _Pack(), 0
                    for node, ids, loss, _, _ in path_to:
                        pack.add(node, ids, loss)
                else:
                    own = keep
                    del pack.stack[keep:]
                for node, ids, a, b, learnt in added:
                    pack.add(node, ids, (a, b) if learnt else None)
                above, start = pack.stack[:own], pack.stack[own][3] if own < len(pack.stack) else pack.size
                attends = []
                for _, _, _, a, b in above:
                    if attends and attends[-1]["stop"] == a:
                        attends[-1]["stop"] = b
                    else:
                        attends.append({"start": a, "stop": b})
                pack.chunks.append({
                    "leaf": nodes[-1], "copies": copies, "n_turns": len(nodes), "start": start, "stop": pack.size,
                    "position": sum(b - a for _, _, _, a, b in above), "attends": attends})
        if pack.chunks:
            yield pack.row(number)

    return lambda batches: _in_batches(rows(batches), schema, 1)


def packed(conversations: DataFrame, path: str, work, pack_tokens: int = PACK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(packs, members), written to `work`: the sequences, and conv and leaf of every conversation.

    Only digests are shuffled to find out which conversations are equal; then one of each kind is
    gathered, led by a marker row, so that no join can divide the rows of a conversation.
    """
    turns = marked(conversations)
    small = turns.select("conv", "turn", "role", "digest").repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest")
    members = work.table(small.mapInArrow(_leaves, "conv long, leaf binary"), "members")
    chosen = members.groupBy("leaf").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    rows = turns.withColumn("copies", F.lit(None).cast("long")).unionByName(chosen.select("conv", "copies"), allowMissingColumns=True)
    lead = F.col("copies").isNull()
    gathered = rows.repartition("conv").sortWithinPartitions("conv", lead, "turn", "role", "digest").mapInArrow(
        _gathered, "path binary, copies long, roles array<string>, texts array<string>")
    ordered = gathered.repartitionByRange("path").sortWithinPartitions("path")
    return work.table(ordered.mapInArrow(_packs(path, pack_tokens), PACK), "packs"), members


def position_ids(ids: np.ndarray, chunks: list[dict]) -> np.ndarray:
    """The place of every token of a pack within its conversations."""
    out, done = np.zeros(len(ids), np.int64), 0
    for c in chunks:  # a chunk after a repeated path begins behind it
        out[done:c["start"]] = np.arange(c["start"] - done)
        out[c["start"]:c["stop"]] = c["position"] + np.arange(c["stop"] - c["start"])
        done = c["stop"]
    return out


def _read(path: str):
    schema = pa.schema([("leaf", pa.binary()), ("copies", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(batches):
        form = template(path)
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column("ids")[i].values.to_numpy()
                learnt = np.zeros(len(ids) + 1, np.int8)
                for span in batch.column("loss")[i].as_py():
                    learnt[span["start"]:span["stop"]] = 1
                for c in batch.column("chunks")[i].as_py():
                    spans = [(s["start"], s["stop"]) for s in c["attends"]] + [(c["start"], c["stop"])]
                    own = np.concatenate([ids[a:b] for a, b in spans])
                    mask = np.concatenate([[0], *(learnt[a:b] for a, b in spans), [0]])
                    edges = np.flatnonzero(np.diff(mask)).tolist()
                    loss = "".join(unescape(form.decode(own[a:b])) for a, b in zip(edges[0::2], edges[1::2], strict=True))
                    turns, digest = 0, hashlib.sha256()
                    for role, text in form.turns(own):
                        digest.update(f"{role}\n{text}\n".encode())
                        turns += 1
                    yield (c["leaf"], c["copies"], turns, digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                           len(form.decode(own)))

    return lambda batches: _in_batches(rows(batches), schema, 2048)


def read_back(packs: DataFrame, members: DataFrame, path: str, work) -> DataFrame:
    """For every conversation what its tokens in the packs say; `work` takes one row for each distinct conversation.

    Texts under the loss mask are decoded span by span, so nothing stands between them.
    """
    read = work.table(packs.mapInArrow(_read(path), READ), "read")
    conv = F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id")
    return join_by_key(members, read, "leaf", "copies").select(
        conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def sql() -> str:
    """The contract's columns from the table itself, for conversations without rows of one turn."""
    text, role = "coalesce(text, '')", "coalesce(role, '')"
    control = r"<\\*\|im_(?:start|end)\|>"
    doubled = f"replace(replace({role}, '\\', '\\\\'), chr(10), '\\n')"
    planted = "'<|im_end|><|im_start|>assistant ok'"
    return f"""WITH rows_ AS (SELECT conv_id, turn, {role} AS role, {text} AS text,
    24 + length({doubled}) + len(regexp_extract_all({doubled}, '{control}')) + length({text}) + len(regexp_extract_all({text}, '{control}')) AS chars
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', {planted}), (-1, 1, 'assistant', {planted})))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNT_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{LEARNT_ROLE}'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars FROM rows_ GROUP BY conv_id"""
